"""Bibliographic records: the CSV scan, sampling of whole blocks, and a view derived from the driver tables."""

from __future__ import annotations

import ast
import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUIRED = ("ambiguous_name", "paper_id", "author_name", "coauthors", "title", "venue")
LABEL = "label"


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """Records of a CSV file with a header, all strings, empty cells "", plus row_index in file order.

    Missing required columns are an error before anything is read; further columns are kept.
    """
    head = spark.read.text(path).limit(1)
    names = next(iter(_split_header(r[0]) for r in head.collect()), [])
    check_columns(names)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    # The quote is its own escape in CSV; Spark's default would read a backslash as one.
    rows = spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8", mode="FAILFAST")
    return numbered(rows).na.fill("", names)


def _split_header(line: str) -> list[str]:
    import csv

    return next(csv.reader([line.removeprefix("﻿")]))


def check_columns(names) -> None:
    if missing := sorted({*REQUIRED} - {*names}):
        raise ValueError(f"missing required columns: {', '.join(missing)}")


def numbered(rows: DataFrame) -> DataFrame:
    """row_index by position: in the order of file names where rows is a scan, else in that of partitions.

    A CSV scan has no row numbers of its own, and its tasks don't follow the order of file names. Rows are counted by file
    split once, in the JVM; the counts, one row for each split, are broadcast. Both looks must see the same splits, as
    those of files do; a table made otherwise has to be the same each time that it is computed.
    """
    names = rows.columns
    place = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start")] if rows.inputFiles() else [F.lit(""), F.lit(0).cast("long")]
    at = rows.select("*", place[0].alias("_file"), place[1].alias("_split"), F.monotonically_increasing_id().alias("_id"))
    # Rows of one task have ids in a row; a task may read several files.
    at = at.withColumn("_task", F.shiftright("_id", 33))
    counts = at.groupBy("_file", "_split", "_task").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_split", "_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before).drop("_n")
    out = at.join(F.broadcast(counts), ["_file", "_split", "_task"])
    return out.select(*[F.col(f"`{c}`") for c in names], (F.col("_before") + F.col("_id") - F.col("_first")).cast("long").alias("row_index"))


def sample_blocks(records: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """All records of n blocks, drawn from the sorted block names by the standard library's seeded sample.

    The names, one for each block, are the only thing that reaches the driver; this form exists to agree with runs
    made elsewhere. sample_blocks_by_hash() samples without that.
    """
    if n < 1:
        raise ValueError("the number of blocks must be positive")
    names = sorted(r[0] for r in records.select("ambiguous_name").distinct().collect())
    if n > len(names):
        raise ValueError(f"{n} blocks were asked for, but there are only {len(names)}")
    chosen = records.sparkSession.createDataFrame([(x,) for x in random.Random(seed).sample(names, n)], "ambiguous_name string")
    return records.join(chosen, "ambiguous_name", "left_semi")


def sample_blocks_by_hash(records: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """All records of the n blocks whose md5(seed:name) is smallest."""
    names = records.select("ambiguous_name").distinct()
    order = F.md5(F.concat(F.lit(f"{seed}:"), "ambiguous_name").cast("binary"))
    return records.join(names.orderBy(order, "ambiguous_name").limit(n), "ambiguous_name", "left_semi")


def _literal_names(text: str | None) -> list[str]:
    try:
        names = ast.literal_eval(text or "")
    except (SyntaxError, ValueError) as error:
        raise ValueError(f"invalid coauthors value {text!r}") from error
    if not isinstance(names, list) or not all(isinstance(x, str) for x in names):
        raise ValueError(f"coauthors must be a list of strings, got {text!r}")
    return names


@F.arrow_udf(T.ArrayType(T.StringType()))
def _literal_lists(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else _literal_names(v) for v in values.to_pylist()], pa.list_(pa.string()))


#: A list of plain string literals: no escapes, prefixes or control characters, nothing that Python and JSON read differently.
_PLAIN_STRING = r"""(?:'[^'\\\x00-\x1f]*'|"[^"\\\x00-\x1f]*")"""
_PLAIN_LIST = rf"^ *\[ *(?:{_PLAIN_STRING}(?: *, *{_PLAIN_STRING})*)? *\]$"


def coauthor_list(text: Column) -> Column:
    """The list of names that a Python list literal holds; anything else is an error.

    Plain lists are read in the JVM; only those of another form go through Python.
    """
    text = F.coalesce(text, F.lit(""))
    plain = text.rlike(_PLAIN_LIST)
    return F.when(plain, F.from_json(text, "array<string>", {"allowSingleQuotes": "true"})).otherwise(_literal_lists(F.when(~plain, text)))


def bib_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bibliographic reading of the order tables: an order is a publication, its customer the true author.

    rid, paper_id, ambiguous_name, label, author_name, coauthors, title, venue; ten customers share a block.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    orders = read("orders").select("o_orderkey", "o_custkey")
    items = read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    parts, suppliers = read("part").select("p_partkey", "p_name", "p_type"), read("supplier").select("s_suppkey", "s_name")
    lines = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    # One list for everything: each list of its own is a buffer that is written and read again by the aggregation.
    told = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "p_name", "s_name", "p_type"))).alias("x"))
    told = told.select(
        "l_orderkey",
        F.sort_array(F.array_except(F.col("x.s_name"), F.array(F.lit(None).cast("string")))).alias("coauthors"),
        F.array_join("x.p_name", " ").alias("title"),
        F.array_min("x.p_type").alias("venue"),
    )
    block = F.floor(F.col("o_custkey") / 10)
    given = F.element_at(F.array(*map(F.lit, ("alice", "bruno", "carla", "dmitri", "elena"))), (F.col("o_custkey") % 5 + 1).cast("int"))
    family = F.element_at(F.array(*map(F.lit, ("silva", "wang", "muller", "garcia", "rossi", "kim", "novak"))), (block % 7 + 1).cast("int"))
    form = F.col("o_orderkey") % 4
    author = (
        F.when(form == 0, F.concat_ws(" ", given, family))
        .when(form == 1, F.concat(F.substring(given, 1, 1), F.lit(". "), family))
        .when(form == 2, F.concat(family, F.lit(", "), given))
        .otherwise(F.concat(given, F.lit(" j "), family))
    )
    return orders.join(told, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("rid"),
        F.col("o_orderkey").cast("string").alias("paper_id"),
        F.concat(F.lit("block-"), block.cast("string")).alias("ambiguous_name"),
        F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")).alias("label"),
        author.alias("author_name"),
        "coauthors",
        "title",
        "venue",
    )


def occurrence(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows with `occurrence`, counting from 0 the rows of the same keys in order."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
