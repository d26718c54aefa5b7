"""Clustering evaluation from contingency cells.

Everything starts from one aggregation, the counts n of (block, label, cluster); marginals are window sums over those
cells, never joins back to the records.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .groups import grouped


def choose2(n: Column) -> Column:
    return F.call_function("div", n * (n - 1), F.lit(2))


def cells(pairs: DataFrame, *keys: str) -> DataFrame:
    """n of every (label, cluster), within `keys` if given."""
    return pairs.groupBy(*keys, "label", "cluster").agg(F.count(F.lit(1)).alias("n"))


def with_sizes(counted: DataFrame, *keys: str) -> DataFrame:
    """cells with label_size and cluster_size."""
    total = lambda c: F.sum("n").over(Window.partitionBy(*keys, c))
    return counted.select("*", total("label").alias("label_size"), total("cluster").alias("cluster_size"))


def contingency(pairs: DataFrame) -> DataFrame:
    return with_sizes(cells(pairs))


def ratio(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def sized(counted: DataFrame, *keys: str) -> DataFrame:
    """(keys, gl, s, q): of every label (gl 0) and every cluster (gl 1) the sum of its cells' n and of their squares."""
    sets = [[*keys, "label"], [*keys, "cluster"]]
    tag = F.grouping("label").alias("gl")
    return counted.groupingSets(sets, *keys, "label", "cluster").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"), tag, F.max("label").isNotNull().alias("named_label"), F.max("cluster").isNotNull().alias("named_cluster"))


def overall(counted: DataFrame, *keys: str) -> DataFrame:
    """One row (for each of the keys) of all sums that the global figures need, of cells within blocks.

    The pairs within cells are (sum of squares - records) / 2, so one pass over labels and clusters gives everything.
    """
    groups = sized(counted.groupBy(*keys, "label", "cluster").agg(F.sum("n").alias("n")), *keys)
    of = lambda gl, v: F.coalesce(F.sum(F.when(F.col("gl") == gl, v)), F.lit(0).cast("long"))
    share = lambda gl: F.sum(F.when(F.col("gl") == gl, F.col("q") / F.col("s")))
    return groups.groupBy(*keys).agg(
        of(1, F.col("s")).alias("records"),
        of(0, F.when(F.col("named_label"), 1).otherwise(0).cast("long")).alias("true_authors"),
        of(1, F.when(F.col("named_cluster"), 1).otherwise(0).cast("long")).alias("predicted_clusters"),
        F.call_function("div", of(1, F.col("q")) - of(1, F.col("s")), F.lit(2)).alias("tp"),
        of(1, choose2(F.col("s"))).alias("predicted"),
        of(0, choose2(F.col("s"))).alias("true"),
        share(1).alias("b3p"),
        share(0).alias("b3r"),
    )


def rates(sums: DataFrame, *keep: str) -> DataFrame:
    """Pairwise and B-cubed figures of overall()'s row; nothing predicted is precision 1, nothing true recall 1."""
    p, r, some = ratio(F.col("tp"), F.col("predicted"), 1.0), ratio(F.col("tp"), F.col("true"), 1.0), F.expr("nullif(records, 0)")
    parts = sums.select(*keep, p.alias("p"), r.alias("r"), (F.col("b3p") / some).alias("b3_precision"), (F.col("b3r") / some).alias("b3_recall"))
    return parts.select(
        *keep,
        F.col("p").alias("pairwise_precision"),
        F.col("r").alias("pairwise_recall"),
        f1(F.col("p"), F.col("r")).alias("pairwise_f1"),
        "b3_precision",
        "b3_recall",
        f1(F.col("b3_precision"), F.col("b3_recall")).alias("b3_f1"),
    )


def pairwise(pairs: DataFrame) -> DataFrame:
    """pairwise_precision, pairwise_recall, pairwise_f1 over all records, whatever their block."""
    return rates(overall(cells(pairs))).select("pairwise_precision", "pairwise_recall", "pairwise_f1")


def pairwise_of(counted: DataFrame, *keys: str) -> DataFrame:
    """pairwise() of cells, for each of the keys."""
    return rates(overall(counted, *keys), *keys).select(*keys, "pairwise_precision", "pairwise_recall", "pairwise_f1")


def bcubed(pairs: DataFrame) -> DataFrame:
    """b3_precision, b3_recall, b3_f1 over all records."""
    return rates(overall(cells(pairs))).select("b3_precision", "b3_recall", "b3_f1")


def purity_of(counted: DataFrame) -> DataFrame:
    """block, acp, aap, k of cells within blocks."""
    of = lambda gl: F.sum(F.when(F.col("gl") == gl, F.col("q") / F.col("s"))) / F.sum(F.when(F.col("gl") == gl, F.col("s")))
    each = sized(counted, "block").groupBy("block").agg(of(1).alias("acp"), of(0).alias("aap"))
    return each.withColumn("k", F.sqrt(F.col("acp") * F.col("aap")))


def purity_by_block(pairs: DataFrame) -> DataFrame:
    return purity_of(cells(pairs, "block"))


def purity_means(blocks: DataFrame) -> DataFrame:
    return blocks.agg(F.avg("acp").alias("average_cluster_purity"), F.avg("aap").alias("average_author_purity"), F.avg("k").alias("k_metric"))


def evaluate(pairs: DataFrame) -> DataFrame:
    """All twelve figures in one row, of pairs (block, label, cluster). No records, no row.

    Both halves start from the same cells, whose shuffle Spark runs once: the records are looked at one time.
    """
    counted = cells(pairs, "block")
    facts = ["records", "true_authors", "predicted_clusters"]
    return rates(overall(counted).where("records > 0"), *facts).join(purity_means(purity_of(counted)))


def pair_sums(pairs: DataFrame, names: list[str], subsets: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row: for each subset of names the number of record pairs within blocks that agree in all of it.

    Blocks are counted one after the other, so that a task holds one block's rows, not the groups of all its blocks.
    """

    def count(batches):
        sums = dict.fromkeys(subsets, 0)
        for _, table in grouped(batches, ["block"]):
            codes = {c: table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype("i8") for c in names}
            for subset, held in subsets.items():
                key = np.zeros(table.num_rows, "i8")
                for c in held:
                    # Numbered again after each column: products of the columns' sizes stay below the square of the rows.
                    key = np.unique(key * (codes[c].max() + 1) + codes[c], return_inverse=True)[1]
                n = np.bincount(key)
                sums[subset] += int((n * (n - 1) // 2).sum())
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in sums.values()], names=list(sums))

    rows = pairs.select("block", *names).repartition("block").sortWithinPartitions("block")
    counted = rows.mapInArrow(count, ", ".join(f"`{s}` long" for s in subsets))
    return counted.agg(*[F.coalesce(F.sum(s), F.lit(0).cast("long")).alias(s) for s in subsets])


def confusion_by_block(pairs: DataFrame) -> DataFrame:
    """tp, fp, fn, tn over record pairs within blocks, from pair counts instead of pairs."""
    sums = pair_sums(pairs, ["label", "cluster"], {"all": (), "true": ("label",), "predicted": ("cluster",), "tp": ("label", "cluster")})
    return sums.select("tp", (F.col("predicted") - F.col("tp")).alias("fp"), (F.col("true") - F.col("tp")).alias("fn"), (F.col("all") - F.col("predicted") - F.col("true") + F.col("tp")).alias("tn"))


def error_changes(pairs: DataFrame) -> DataFrame:
    """Merges and splits that `extension` corrects or introduces against `base`, over pairs within blocks.

    pairs: block, label, base, extension. Six counts replace the enumeration of pairs.
    """
    l, b, e = "label", "base", "extension"
    sums = pair_sums(pairs, [l, b, e], {"b": (b,), "e": (e,), "lb": (l, b), "le": (l, e), "be": (b, e), "lbe": (l, b, e)})
    return sums.select(
        F.expr("(b - lb) - (be - lbe)").alias("merges_corrected"),
        F.expr("(e - le) - (be - lbe)").alias("merges_introduced"),
        F.expr("le - lbe").alias("splits_corrected"),
        F.expr("lb - lbe").alias("splits_introduced"),
    )


def statistics(records: DataFrame) -> DataFrame:
    """Size of a cohort (block, label, paper_id) and min, max and mean of its three distributions."""
    block = records.groupBy("block").agg(F.count(F.lit(1)).alias("papers"), F.countDistinct("label").alias("authors"))
    author = records.groupBy("label").agg(F.count(F.lit(1)).alias("papers"))
    three = lambda c, name: [F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max"), F.avg(c).alias(f"{name}_mean")]
    sizes = records.agg(F.count(F.lit(1)).alias("records"), F.countDistinct("paper_id").alias("papers"), F.countDistinct("block").alias("blocks"), F.countDistinct("label").alias("authors"))
    return sizes.join(block.agg(*three("authors", "authors_per_block"), *three("papers", "records_per_block"))).join(author.agg(*three("papers", "records_per_author")))


def method_deltas(scores: DataFrame, baseline: str) -> DataFrame:
    """Scores (method, b3_f1, pairwise_f1, k_metric, predicted_clusters) against the baseline, in percentage points."""
    base = scores.where(F.col("method") == baseline).select(*[F.col(c).alias(f"_{c}") for c in scores.columns if c != "method"])
    rates = [c for c in scores.columns if c not in ("method", "predicted_clusters")]
    points = [((F.col(c) - F.col(f"_{c}")) * 100).alias(f"{c}_points") for c in rates]
    return scores.join(F.broadcast(base)).select(*scores.columns, *points, (F.col("predicted_clusters") - F.col("_predicted_clusters")).alias("clusters_delta"))


def best_method(scores: DataFrame, metric: str = "b3_f1") -> DataFrame:
    """The method with the largest metric; of equals the first by `position`."""
    return scores.agg(F.max_by("method", F.struct(metric, (-F.col("position")))).alias("best"))


def judged_counts(decisions: DataFrame, threshold: float) -> DataFrame:
    """Audit of valid labelled decisions (valid, label, same_author, p): confusion counts, Brier score, recall.

    Null where there is nothing to divide by.
    """
    rows = decisions.where("valid AND label IS NOT NULL AND same_author IS NOT NULL")
    accepted = F.col("same_author") & (F.col("p") >= threshold)
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    y = F.col("label")
    out = rows.agg(
        F.count(F.lit(1)).alias("comparisons"),
        n(accepted & y).alias("tp"),
        n(accepted & ~y).alias("fp"),
        n(~accepted & y).alias("fn"),
        n(~accepted & ~y).alias("tn"),
        F.avg((F.col("p") - y.cast("double")) * (F.col("p") - y.cast("double"))).alias("brier_score"),
    )
    return out.withColumn("recall", F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))))


def confidence_bins(decisions: DataFrame) -> DataFrame:
    """Ten bins of p: lower, upper, count, mean_probability, observed_same_author_rate; an empty bin has nulls."""
    rows = decisions.where("valid AND label IS NOT NULL AND same_author IS NOT NULL")
    found = rows.groupBy(F.least(F.lit(9), F.floor(F.col("p") * 10)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("p").alias("mean_probability"), F.avg(F.col("label").cast("double")).alias("observed_same_author_rate")
    )
    bins = decisions.sparkSession.range(10).select(F.col("id").cast("int").alias("bin"))
    return bins.join(F.broadcast(found), "bin", "left").select(
        (F.col("bin") / 10).alias("lower"), ((F.col("bin") + 1) / 10).alias("upper"), F.coalesce("_n", F.lit(0)).alias("count"), "mean_probability", "observed_same_author_rate"
    )
