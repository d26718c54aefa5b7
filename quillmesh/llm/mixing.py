"""Mixing sources to target weights by systematic sampling.

Each source's documents are put in a fixed order, each document's expected copies (its source's target over its
source's size) are prefix-summed along it, one offset in [0, 1) is added, and a document is emitted once for every
integer the running sum crosses. The order runs through size bins, so a source's words come near its target and not
only its documents.

Null sources form one source, ranked last. Null texts and blank texts have size 0: they are sampled like any others
and take no words. Empty input gives empty output. Rows that repeat a doc_id are sampled as rows of their own.
Sources without a single word have target 0 and emit nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words, own_name, running

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source's target and a document's copies stop at this many times what there is.
MOST = 3
#: A source's offset comes from the first 8 hexadecimal digits of md5(seed:source).
SEED = 17
#: Hexadecimal digits of md5(doc_id), of a hash of the text where that is null, that split a hot size bin; 4,096 parts.
SALT_DIGITS = 3


def source_key(source: Column) -> Column:
    """Null-safe: '' for null, '=' before any other, so that code-point order is kept among the others."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """From (skey, size) rows one row per source: skey, source_size, target.

    All words are shared by weight; a source is held at `most` times its size and the excess goes to the others by
    weight until none is above. That fixed point is one water level: with sources ordered by the level at which they
    fill up, the level is where it first no longer fills the next one, so prefix sums give it in one pass.
    """
    spark = sizes.sparkSession
    sources = cut(sizes.groupBy("skey").agg(F.sum("size").alias("source_size")), "sources")
    ranked = running(sources, [F.col("skey") == "", F.col("skey")], {"rank": F.lit(1)}, ["skey", "source_size"])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    ranked = cut(ranked.select("skey", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("cap")), "weights")
    total, total_weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return ranked.select("skey", "source_size", F.lit(0.0).alias("target"))
    fills_at = F.col("cap") / F.col("weight")
    filled = running(ranked, [fills_at, F.col("skey")], {"cap_before": F.col("cap"), "weight_before": F.col("weight")}, ["cap", "weight"])
    level = (F.lit(total) - F.col("cap_before")) / (F.lit(total_weight) - F.col("weight_before"))
    found = filled.select(level.alias("level"), fills_at.alias("at")).where("level <= at").agg(F.min_by("level", "at")).first()[0]
    target = F.least(F.col("cap").cast("double"), F.lit(float(found)) * F.col("weight"))
    return ranked.select("skey", "source_size", target.alias("target"))


def offset(skey: Column, seed: int = SEED) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), skey).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """docs with the columns size, source_size, target and copies (clashing names of docs are replaced).

    A hot source does not meet in one task: ranks come from (source, size bin, salt) groups, whose counts are summed
    over salts within a bin and over bins within a source.
    """
    made = ("size", "source_size", "target", "copies")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    tie = own_name(docs, "tie")
    tied = F.xxhash64(F.col(text)) if text in docs.columns else F.lit(0)
    rows = docs.withColumns({"size": n_words(F.col(text)) if text in docs.columns else F.lit(0).cast("long"), tie: tied})
    return _sampled(rows, tie, weights, most, seed, source, doc_id)


def mixed_sizes(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The decisions only: (doc_id, size, source_size, target, copies); texts are read once and never shuffled."""
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("_tie"))
    return _sampled(cut(rows, "sizes"), "_tie", weights, most, seed, "source", "doc_id")


def _sampled(rows: DataFrame, tie: str, weights, most: int, seed: int, source: str, doc_id: str) -> DataFrame:
    out = [c for c in rows.columns if c != tie]
    skey, bin_, salt, start, place = (own_name(rows, c) for c in ("skey", "bin", "salt", "start", "place"))
    digits = F.col("size").cast("string")
    keys = {
        skey: source_key(F.col(source)),
        bin_: F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int"),
        salt: F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.col(tie).cast("string")).cast("binary")), 1, SALT_DIGITS),
    }
    rows = rows.withColumns(keys)
    group = [skey, bin_, salt]
    wanted = targets(rows.select(F.col(skey).alias("skey"), "size"), weights, most)
    counts = cut(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")), "mixcounts")
    first = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    in_bin = counts.withColumn("_in_bin", F.coalesce(F.sum("_n").over(first(skey, bin_).orderBy(salt)), F.lit(0)))
    bins = counts.groupBy(skey, bin_).agg(F.sum("_n").alias("_b"))
    bins = bins.select(skey, bin_, F.coalesce(F.sum("_b").over(first(skey).orderBy(bin_)), F.lit(0)).alias("_before"))
    starts = in_bin.join(bins, [skey, bin_]).join(wanted.withColumnRenamed("skey", skey), skey)
    starts = starts.select(*group, (F.col("_in_bin") + F.col("_before")).alias(start), "source_size", "target")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("size", doc_id, tie))
    placed = rows.withColumn(place, rank).join(starts, group)
    k, each = F.col(start) + F.col(place), F.when(F.col("source_size") == 0, 0.0).otherwise(F.col("target") / F.col("source_size"))
    u = offset(F.col(skey), seed)
    copies = F.least(F.floor(each * k + u) - F.floor(each * (k - 1) + u), F.lit(most)).cast("long")
    return placed.select(*[F.col(f"`{c}`") for c in out], "source_size", "target", copies.alias("copies"))


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Every document as often as it has copies."""
    copy = own_name(mixed, "copy")
    return mixed.where("copies > 0").select(*[F.col(f"`{c}`") for c in columns], F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias(copy)).drop(copy)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mixed_sizes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS skey
  FROM documents),
s AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey),
r AS (SELECT *, row_number() OVER (ORDER BY skey = '', skey) - 1 AS rank FROM s),
w AS (SELECT skey, source_size, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM r),
f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
             coalesce(sum(weight) OVER (ORDER BY cap / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before FROM w),
l AS (SELECT CAST((SELECT sum(source_size) FROM s) - cap_before AS DOUBLE) / CAST((SELECT sum(weight) FROM w) - weight_before AS DOUBLE) AS level, cap / weight AS fills FROM f),
t AS (SELECT skey, source_size, least(CAST(cap AS DOUBLE), (SELECT arg_min(level, fills) FROM l WHERE level <= fills) * weight) AS target FROM w),
o AS (SELECT d.*, source_size, target, CASE WHEN source_size = 0 THEN 0.0 ELSE target / source_size END AS each,
             CAST('0x' || substr(md5('17:' || d.skey), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u,
             row_number() OVER (PARTITION BY d.skey ORDER BY length(CAST(size AS VARCHAR)) * 100 + CAST(substr(CAST(size AS VARCHAR), 1, 2) AS INT),
                                substr(md5(CAST(doc_id AS VARCHAR)), 1, 3), size, doc_id) AS k
      FROM d JOIN t ON d.skey = t.skey),
c AS (SELECT *, CAST(least(floor(each * k + u) - floor(each * (k - 1) + u), 3) AS BIGINT) AS copies FROM o)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""
