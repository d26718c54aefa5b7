"""Quality rules: one threshold table compiled into one projection of built-in expressions.

A null text has no words, lines or symbols. Texts are read whole. Rows are judged one by one, so repeated rows and
ties need no rule, an empty table gives an empty table, and columns of the input whose names clash with a metric are
replaced by the metric.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, words

#: Words of a repeated window.
WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages of the corpus.
STOP_WORDS = {
    "en": "the of and to in is that it for was on are as with his they at be this have from or had by but not what all were we when your can said there an which their if do will how about up out them then she many some so these would other into has more her two like him see time could no make than been its who now my made over did only way find use may down",
    "fr": "le la les de des du un une et en est que qui dans pour par sur pas au aux avec ce cette il elle nous vous ne se son sa ses plus ou mais",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man",
    "es": "el la los las de y en que un una del se por con no para su al lo como más o pero sus le ya es este sí porque esta entre cuando muy sin sobre",
}
#: metric, comparison that rejects, bound, texts that the rule is for. Ratios are integer comparisons: 100 * part against
#: bound * whole. "latin" are texts of less than 1.5 bytes a character: the stop words, and words of that length between
#: spaces, say nothing of texts in other scripts.
RULES = (
    ("n_words", "<", 10, "all"),
    ("repeat_word_pct", ">", 20, "all"),
    ("mean_word_chars", "<", 2, "latin"),
    ("mean_word_chars", ">", 20, "latin"),
    ("symbol_pct", ">", 30, "all"),
    ("stop_word_pct", "<", 2, "latin"),
    ("dup_line_pct", ">", 50, "all"),
)
#: The rules that the base verdict takes; the others refine it.
BASE = 2
#: metric -> (part column, whole column, scale of the part)
RATIOS = {
    "n_words": ("n_words", None, 1),
    "repeat_word_pct": ("n_repeat_words", "n_words", 100),
    "mean_word_chars": ("word_chars", "n_words", 1),
    "symbol_pct": ("n_symbols", "n_words", 100),
    "stop_word_pct": ("n_stop_words", "n_words", 100),
    "dup_line_pct": ("n_dup_lines", "n_lines", 100),
}
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "text_bytes", "text_chars")


def repeat_words(ws: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window of `window` words that the text has twice or more."""

    def counted(keys: Column) -> Column:
        def runs(s: Column) -> Column:
            twin = lambda x, i: (F.get(s, i - 1)["k"] == x["k"]) | (F.get(s, i + 1)["k"] == x["k"])
            starts = F.array_sort(F.transform(F.filter(s, lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: x["i"]))
            step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(window), i - acc["last"])).alias("n"), i.alias("last"))
            return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")), step, lambda acc: acc["n"])

        tagged = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(let(tagged, runs))

    # A 64-bit hash stands for the window's words; array_distinct() is linear on numbers, but not on structs.
    key = lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(window)])
    keys = F.transform(F.sequence(F.lit(0), F.size(ws) - window), key)
    return F.when(F.size(ws) <= window, F.lit(0)).otherwise(let(keys, counted))


def metrics(text: Column) -> Column:
    """A struct of all METRICS (long)."""
    t = F.coalesce(text, F.lit(""))
    stops = sorted({v for w in " ".join(STOP_WORDS.values()).split() for v in (w, w.capitalize())})

    def of(ws: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
        by_line = let(lines, lambda ls: F.struct(F.size(ls).alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("dup")))
        return let(
            by_line,
            lambda ln: F.struct(
                F.size(ws).cast("long").alias("n_words"),
                F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
                (F.length(t) - F.length(F.regexp_replace(t, f"[{SYMBOLS}]", ""))).cast("long").alias("n_symbols"),
                ln["dup"].cast("long").alias("n_dup_lines"),
                repeat_words(ws).cast("long").alias("n_repeat_words"),
                F.size(F.filter(ws, lambda w: w.isin(stops))).cast("long").alias("n_stop_words"),
                ln["n"].cast("long").alias("n_lines"),
                F.octet_length(t).cast("long").alias("text_bytes"),
                F.length(t).cast("long").alias("text_chars"),
            ),
        )

    return let(words(text), of)


def verdict(rules=RULES) -> Column:
    """True where any rule rejects; a ratio over nothing rejects nothing."""

    def rejects(metric: str, how: str, bound, texts: str) -> Column:
        part, whole, scale = RATIOS[metric]
        left, right = F.col(part) * scale, F.lit(bound) * (F.col(whole) if whole else F.lit(1))
        hit = left < right if how == "<" else left > right
        if texts == "latin":
            hit &= F.col("text_bytes") * 2 < F.col("text_chars") * 3
        return hit if whole is None else hit & (F.col(whole) > 0)

    return reduce(Column.__or__, [rejects(*r) for r in rules])


def judged(docs: DataFrame, text: str = "text", rules=RULES, base: int = BASE) -> DataFrame:
    """docs with METRICS, base_failed and kept."""
    m = "_metrics"
    made = {*METRICS, "base_failed", "kept", m}
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in made]
    got = docs.select(*keep, metrics(F.col(text)).alias(m)).select(*keep, *[F.col(f"{m}.{c}").alias(c) for c in METRICS])
    return got.withColumns({"base_failed": verdict(rules[:base]), "kept": ~verdict(rules)})


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judged(docs).drop("text")


_STOPS = ", ".join(f"'{w}'" for w in sorted({v for x in " ".join(STOP_WORDS.values()).split() for v in (x, x.capitalize())}))
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i:i + 4] AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)),
h AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM h, (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(ws, lambda w: w IN ({_STOPS}))) AS BIGINT) AS n_stop_words, CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(strlen(text) AS BIGINT) AS text_bytes, CAST(length(text) AS BIGINT) AS text_chars
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d) d LEFT JOIN p ON d.doc_id = p.doc_id)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR (n_words > 0 AND (100 * n_symbols > 30 * n_words
    OR (2 * text_bytes < 3 * text_chars AND (word_chars < 2 * n_words OR word_chars > 20 * n_words OR 100 * n_stop_words < 2 * n_words)))) OR (n_lines > 0 AND 100 * n_dup_lines > 50 * n_lines)) AS kept
FROM m
"""
