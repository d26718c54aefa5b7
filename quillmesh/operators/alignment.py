"""Alignment of several methods' predictions, and their checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.records import occurrence

KEYS = ["paper_id", "ambiguous_name", "label"]


def checked(name: str, rows: DataFrame) -> DataFrame:
    """Predictions whose identifiers must be complete."""
    if missing := sorted({*KEYS, "predicted_cluster"} - {*rows.columns}):
        raise ValueError(f"{name}: missing prediction columns: {missing}")
    gaps = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in [*KEYS, "predicted_cluster"]])
    if not rows.where(gaps).isEmpty():
        raise ValueError(f"{name}: predictions need complete identifiers and labels")
    return rows


def aligned(methods: dict[str, DataFrame], reference: str, order: str = "row_index") -> DataFrame:
    """One row for each record of the reference method, with cluster_<method> of every method.

    Records are matched by identifiers and their occurrence among equal ones. Extra records of other methods are left
    out; a record that another method lacks is an error.
    """
    on = [*KEYS, "occurrence"]
    numbered = {m: occurrence(checked(m, rows), KEYS, order).select(*on, F.col("predicted_cluster").alias(f"cluster_{m}")) for m, rows in methods.items()}
    common = numbered[reference]
    for method, rows in numbered.items():
        if method != reference:
            common = common.join(rows, on)
    return common


def unmatched(left: DataFrame, right: DataFrame, keys: list[str] = KEYS, order: str = "row_index") -> DataFrame:
    """Left records, by occurrence, without a partner on the right."""
    return occurrence(left, keys, order).join(occurrence(right, keys, order).select(*keys, "occurrence"), [*keys, "occurrence"], "left_anti")


def require_complete(common: DataFrame, methods: dict[str, DataFrame], reference: str) -> None:
    n, m = common.count(), methods[reference].count()
    if n != m:
        raise ValueError(f"some records of {reference} have no prediction of every method")
    if not n:
        raise ValueError("no record to compare")


def long_form(common: DataFrame, methods: list[str]) -> DataFrame:
    """method, block, label, cluster: the shape that the metrics take."""
    pair = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"cluster_{m}").alias("cluster")) for m in methods])).alias("p")
    return common.select(F.col("ambiguous_name").alias("block"), "label", pair).select("p.method", "block", "label", "p.cluster")
