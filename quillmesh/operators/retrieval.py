"""Which clusters of a block could be one author: vector scores, name compatibility, nearest neighbours, diagnostics.

All of it is DataFrame work on tables of clusters: members (block, cluster, name_tokens, label, embedding), one row for
each record, and clusters (block, cluster, ...). Blocks join themselves on equality of the block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, vectors

BLOCK = ["block", "cluster"]


def centroids(members: DataFrame) -> DataFrame:
    """block, cluster, size, centroid: the sum of the members' vectors, position by position."""
    each = members.select(*BLOCK, F.posexplode("embedding").alias("pos", "v"))
    sums = each.groupBy(*BLOCK, "pos").agg(F.sum(F.col("v").cast("double")).alias("v"), F.count(F.lit(1)).alias("size"))
    whole = sums.groupBy(*BLOCK).agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("at"))
    return whole.select(*BLOCK, "size", F.transform("at", lambda s: s["v"]).alias("centroid"))


def _sides(table: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    return tuple(table.select("block", F.col("cluster").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns]) for s in "ij")


def centroid_scores(clusters: DataFrame) -> DataFrame:
    """block, i < j, score of clusters (block, cluster, centroid)."""
    lengths = clusters.withColumn("unit", F.when(vectors.norm(F.col("centroid")) == 0, F.col("centroid")).otherwise(vectors.unit(F.col("centroid"))))
    left, right = _sides(lengths, "unit")
    return left.join(right, "block").where("i < j").select("block", "i", "j", F.round(vectors.dot(F.col("unit_i"), F.col("unit_j")), 12).alias("score"))


def hybrid_scores(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """The larger of the centroids' cosine and of the best pair of members."""
    left, right = _sides(members, "embedding")
    best = left.join(right, "block").where("i < j").groupBy("block", "i", "j").agg(F.max(vectors.cosine(F.col("embedding_i"), F.col("embedding_j"))).alias("best"))
    return centroid_scores(clusters).join(best, ["block", "i", "j"]).select("block", "i", "j", F.round(F.greatest("score", "best"), 12).alias("score"))


def name_sets(members: DataFrame) -> DataFrame:
    return members.groupBy(*BLOCK).agg(F.collect_set("name_tokens").alias("names"))


def compatible_pairs(members: DataFrame) -> DataFrame:
    """block, i < j where every name of i is similar to every name of j."""
    left, right = _sides(name_sets(members), "names")
    fits = F.forall("names_i", lambda a: F.forall("names_j", lambda b: names.similar_tokens(a, b)))
    return left.join(right, "block").where(F.col("i") < F.col("j")).where(fits).select("block", "i", "j")


def eligible(scores: DataFrame, compatible: DataFrame, threshold: float) -> DataFrame:
    """Pairs at the threshold or above whose names fit."""
    return scores.where(F.col("score") >= threshold).join(compatible, ["block", "i", "j"])


def candidates(pairs: DataFrame, top_k: int) -> DataFrame:
    """block, i, j, score, position: pairs that one side has among its top_k neighbours (0: all), best first."""
    if top_k:
        both = pairs.select("block", "i", "j", "score", F.explode(F.array(F.struct(F.col("i").alias("own"), F.col("j").alias("other")), F.struct(F.col("j").alias("own"), F.col("i").alias("other")))).alias("s"))
        nearest = F.row_number().over(Window.partitionBy("block", "s.own").orderBy(F.col("score").desc(), "s.other"))
        pairs = both.withColumn("nearest", nearest).where(F.col("nearest") <= top_k).select("block", "i", "j", "score").distinct()
    return pairs.withColumn("position", F.row_number().over(Window.partitionBy("block").orderBy(F.col("score").desc(), "i", "j")))


def true_pairs(members: DataFrame) -> DataFrame:
    """block, i < j of clusters that are both of one and the same known author."""
    label = F.trim(F.coalesce("label", F.lit("")))
    pure = members.groupBy(*BLOCK).agg(F.min(label).alias("lo"), F.max(label).alias("hi")).where("lo = hi AND lo <> ''")
    left, right = _sides(pure, "lo")
    return left.join(right.withColumnRenamed("lo_j", "lo_i"), ["block", "lo_i"]).where("i < j").select("block", "i", "j")


def ideal_labels(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """pairs (block, i, j) with same_author: null where a side has several authors or a blank label."""
    label = F.trim(F.coalesce("label", F.lit("")))
    facts = members.groupBy(*BLOCK).agg(F.min(label).alias("lo"), F.max(label).alias("hi"))
    facts = facts.select(*BLOCK, F.when((F.col("lo") == F.col("hi")) & (F.col("lo") != ""), F.col("lo")).alias("author"))
    left, right = _sides(facts, "author")
    return pairs.join(left, ["block", "i"]).join(right, ["block", "j"]).select("block", "i", "j", (F.col("author_i") == F.col("author_j")).alias("same_author"))


def diagnostics(members: DataFrame, scores: DataFrame, threshold: float, top_k: int, budget: int) -> DataFrame:
    """One row of counts: how many true pairs survive names, scores, neighbours and the first budget."""
    keys = ["block", "i", "j"]
    true, fits = true_pairs(members), compatible_pairs(members)
    allowed = eligible(scores, fits, threshold)
    chosen = candidates(allowed, top_k)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    first = chosen.where(F.col("position") <= budget) if budget else chosen
    out = n(true, "true_pairs").join(n(true.join(fits, keys), "name_compatible_true_pairs")).join(n(true.join(allowed, keys), "semantic_true_pairs"))
    return out.join(n(true.join(chosen, keys), "top_k_true_pairs")).join(n(true.join(first, keys), "initial_budget_true_pairs")).join(n(chosen, "candidate_pairs"))
