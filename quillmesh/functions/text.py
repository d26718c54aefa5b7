"""Text normalisation and sparse term vectors as Spark columns."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stem import stem

#: Words that carry no topic; they are dropped before stemming.
STOP_WORDS = (
    "a about after an and are as at based be between by for from in into is it of on or over study the their "
    "through to toward towards under using via was we were with without"
).split()
_STOP = frozenset(STOP_WORDS)


def folded_text(value: str) -> str:
    """NFKD without combining marks, in lower case."""
    if value.isascii():
        return value.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c)).lower()


@F.arrow_udf(T.StringType())
def _fold(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else folded_text(v) for v in values.to_pylist()], pa.string())


def fold(text: Column) -> Column:
    """folded_text() as a column. ASCII stays in the JVM; only other values travel to Python."""
    ascii_only = text.rlike("^\\p{ASCII}*$")
    return F.when(ascii_only, F.lower(text)).otherwise(_fold(F.when(~ascii_only, text)))


def tokens_of(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit("([a-z0-9]+)"), 1)


def tokens(text: Column) -> Column:
    """Runs of [a-z0-9] of the folded text; null has none."""
    return tokens_of(F.coalesce(fold(text), F.lit("")))


def content_words(text: Column) -> Column:
    """Tokens of more than one character that are no stop words."""
    return F.filter(tokens(text), lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))


def counts(words: Column) -> Column:
    """A term map of a short list of words."""
    return F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("t"), F.size(F.filter(words, lambda x: x == w)).alias("n"))))


@F.arrow_udf(T.MapType(T.StringType(), T.IntegerType()))
def _stemmed_counts(texts: pa.Array) -> pa.Array:
    """Each distinct text of a batch is looked at once, each word stemmed once as long as it is remembered."""
    coded = texts.dictionary_encode()
    maps = [list(_counted(re.findall("[a-z0-9]+", folded_text(t))).items()) for t in coded.dictionary.to_pylist()]
    return pa.DictionaryArray.from_arrays(pc.fill_null(coded.indices, len(maps)), pa.array([*maps, []], pa.map_(pa.string(), pa.int32()))).dictionary_decode()


def _counted(words: list[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for w in words:
        if x := _content_stem(w):
            out[x] = out.get(x, 0) + 1
    return out


@lru_cache(maxsize=1 << 16)
def _content_stem(word: str) -> str:
    return "" if len(word) < 2 or word in _STOP else stem(word)


def terms(text: Column) -> Column:
    """Stemmed content words with their counts."""
    return _stemmed_counts(text)


def sparse_cosine(left: Column, right: Column) -> Column:
    """Cosine of two term maps; 0 where one is empty or nothing is shared."""
    number = lambda m, k: F.element_at(m, k).cast("double")
    common = F.array_intersect(F.map_keys(left), F.map_keys(right))
    dot = F.aggregate(common, F.lit(0.0), lambda acc, k: acc + number(left, k) * number(right, k))
    square = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda acc, v: acc + v.cast("double") * v)
    return F.when(F.size(common) == 0, 0.0).otherwise(dot / F.sqrt(square(left) * square(right)))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)^\\s+|\\s+$", "")


def document_text(title: Column, venue: Column) -> Column:
    """What an encoder sees of a publication."""
    head = F.concat(F.lit("Title: "), trimmed(title))
    return F.when(trimmed(venue) == "", head).otherwise(F.concat(head, F.lit("\nVenue: "), trimmed(venue)))
