"""Person names: compatibility and keys under which a name's forms meet, as columns and as plain functions.

The columns take token lists that text.tokens() has made before: a Python UDF cannot run inside a lambda.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import folded_text


def token_compatible(a: Column, b: Column) -> Column:
    """Equal, or one is the other's initial."""
    return (a == b) | ((F.substring(a, 1, 1) == F.substring(b, 1, 1)) & ((F.length(a) == 1) | (F.length(b) == 1)))


def similar_tokens(left: Column, right: Column) -> Column:
    """Every token of the shorter name (of equals, the left) finds a compatible one of its own in the longer.

    Longest tokens choose first, each takes the first free one: greedy, and not symmetric for equal lengths.
    """
    left_is_short = F.size(left) <= F.size(right)
    short, long = F.when(left_is_short, left).otherwise(right), F.when(left_is_short, right).otherwise(left)
    # sort by falling length; equal lengths keep their order
    order = F.array_sort(F.transform(short, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t"))))
    start = F.struct(F.lit(True).alias("ok"), F.array().cast("array<int>").alias("used"))

    def choose(state: Column, token: Column) -> Column:
        places = F.transform(long, lambda o, i: F.when(token_compatible(token["t"], o) & ~F.array_contains(state["used"], i), i))
        free = F.array_min(F.filter(places, lambda p: p.isNotNull()))
        return F.struct((state["ok"] & free.isNotNull()).alias("ok"), F.when(free.isNull(), state["used"]).otherwise(F.array_append(state["used"], free)).alias("used"))

    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(False)).otherwise(F.aggregate(order, start, choose, lambda s: s["ok"]))


def is_long(token_list: Column) -> Column:
    """Two tokens or more that are not initials."""
    return F.size(F.filter(token_list, lambda t: F.length(t) > 1)) > 1


def keys_of_tokens(token_list: Column) -> Column:
    """Sorted distinct keys; a form with initials shares a part key with the full form."""
    exact = F.concat(F.lit("exact:"), F.array_join(F.array_sort(token_list), ":"))
    initials = lambda i: F.array_join(F.array_sort(F.transform(F.filter(token_list, lambda _, j: j != i), lambda t: F.substring(t, 1, 1))), "")
    parts = F.filter(F.transform(token_list, lambda t, i: F.when(F.length(t) > 1, F.concat(F.lit("part:"), t, F.lit(":"), initials(i)))), lambda k: k.isNotNull())
    many = F.array_sort(F.array_distinct(F.concat(F.array(exact), parts)))
    one = F.array(F.concat(F.lit("only:"), F.get(token_list, F.lit(0))))
    return F.when(F.size(token_list) == 0, F.array().cast("array<string>")).when(F.size(token_list) == 1, one).otherwise(many)


def record_keys(coauthor_tokens: Column, author_tokens: Column) -> Column:
    """Distinct keys of all coauthors but the author, from token lists."""
    others = F.filter(coauthor_tokens, lambda c: ~similar_tokens(c, author_tokens))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(others, keys_of_tokens))))


# --- the same comparison for the functions that work on whole groups


@lru_cache(maxsize=1 << 17)
def names_match(left: tuple[str, ...], right: tuple[str, ...]) -> bool:
    """similar_tokens() of two token tuples."""
    if not left or not right:
        return False
    few, free = (left, list(right)) if len(left) <= len(right) else (right, list(left))
    for token in sorted(few, key=lambda t: -len(t)):
        for at, other in enumerate(free):
            if token == other or (token[0] == other[0] and 1 in (len(token), len(other))):
                del free[at]
                break
        else:
            return False
    return True


@lru_cache(maxsize=1 << 17)
def token_tuple(folded: str) -> tuple[str, ...]:
    return tuple(re.findall("[a-z0-9]+", folded))


@lru_cache(maxsize=1 << 17)
def keys_of(tokens: tuple[str, ...]) -> tuple[str, ...]:
    """keys_of_tokens() of a token tuple."""
    if len(tokens) < 2:
        return tuple(f"only:{t}" for t in tokens)
    parts = [f"part:{t}:{''.join(sorted(x[0] for k, x in enumerate(tokens) if k != at))}" for at, t in enumerate(tokens) if len(t) > 1]
    return tuple(sorted({f"exact:{':'.join(sorted(tokens))}", *parts}))


def _letters(tokens: tuple[str, ...]) -> int:
    return sum(1 << int(c, 36) for c in {t[0] for t in tokens})


def alike(names: list[tuple[str, ...]], name: np.ndarray, owners: list[tuple[str, ...]], owner: np.ndarray) -> np.ndarray:
    """names_match(names[name], owners[owner]) for two arrays of places.

    Every token of the shorter name needs one of the same first letter in the longer: hardly any others are compared.
    """
    facts = [(np.array([_letters(x) for x in of], "i8").reshape(-1), np.array([len(x) for x in of], "i8")) for of in (names, owners)]
    (a, m), (b, n) = ((letters[at], size[at]) for (letters, size), at in zip(facts, (name, owner), strict=True))
    left_is_short = m <= n
    short, long = np.where(left_is_short, a, b), np.where(left_is_short, b, a)
    out = (m > 0) & (n > 0) & (short & ~long == 0)
    at = np.flatnonzero(out)
    if len(at):
        some, back = np.unique(name[at] * np.int64(len(owners)) + owner[at], return_inverse=True)
        out[at] = np.array([names_match(names[k // len(owners)], owners[k % len(owners)]) for k in some.tolist()], bool)[back]
    return out


def _places(values: pa.Array, fold) -> tuple[list[tuple[str, ...]], np.ndarray]:
    """Tokens of the distinct values, and each value's place among them."""
    coded = pc.fill_null(values, "").dictionary_encode()
    return [token_tuple(fold(v)) for v in coded.dictionary.to_pylist()], coded.indices.to_numpy(zero_copy_only=False).astype("i8")


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All elements, and how many every list has."""
    return lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype("i8")


def _bounds(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())


@F.arrow_udf(T.ArrayType(T.StringType()))
def others(lists: pa.Array, own: pa.Array) -> pa.Array:
    """The names of a list that are not similar to the own one; only A-Z are lowered, accents stay."""
    values, sizes = _flat(lists)
    names, name = _places(values, str.lower)
    owners, owner = _places(own, str.lower)
    row = np.repeat(np.arange(len(sizes)), sizes)
    left = ~alike(names, name, owners, owner[row]) & pc.is_valid(values).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(_bounds(np.bincount(row[left], minlength=len(sizes))), values.filter(pa.array(left)))


def _keys(lists: pa.Array, fold, own: pa.Array | None = None) -> pa.Array:
    values, sizes = _flat(lists)
    names, name = _places(values, fold)
    keys = [keys_of(t) for t in names]
    if own is not None:
        owners, owner = _places(own, fold)
        gone = alike(names, name, owners, owner[np.repeat(np.arange(len(sizes)), sizes)]).tolist()
    out, at, name = [], 0, name.tolist()
    for n in sizes.tolist():
        out.append(sorted({k for x in range(at, at + n) if own is None or not gone[x] for k in keys[name[x]]}))
        at += n
    return pa.array(out, pa.list_(pa.string()))


@F.arrow_udf(T.ArrayType(T.StringType()))
def keys_of_names(lists: pa.Array) -> pa.Array:
    """Sorted distinct keys of a list of names, which are lowered but not folded."""
    return _keys(lists, str.lower)


@F.arrow_udf(T.ArrayType(T.StringType()))
def keys_of_others(lists: pa.Array, own: pa.Array) -> pa.Array:
    """record_keys() of folded names."""
    return _keys(lists, folded_text, own)
