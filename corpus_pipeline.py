"""The corpus pipeline: quality rules, line dedup, MinHash near-dedup, mixing and byte-level BPE, one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import bpe, lines, minhash, mixing, quality
from quillmesh.llm.common import WORD, cut


#: Columns of documents that stages read or rewrite.
READ = ("doc_id", "text", "source", "n_chars")


def apart(docs: DataFrame, work) -> DataFrame:
    """docs.columns of work(docs), with names of its own for all columns that no stage reads: what an operator adds never hides one."""
    held = {c: f"_held_{i}" for i, c in enumerate(docs.columns) if c not in READ}
    out = work(docs.withColumnsRenamed(held))
    return out.select(*[F.col(held.get(c, c)).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return apart(docs, lambda rows: quality.judged(rows).where("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one line of each group of near-equal lines; those of which no word is left go."""

    def work(rows: DataFrame) -> DataFrame:
        left = lines.without_lines(rows, added=("all_lines", "removed_lines")).where(F.col("text").rlike(WORD) | (F.col("removed_lines") == 0))
        return left.withColumn("n_chars", F.length("text").cast(rows.schema["n_chars"].dataType)) if "n_chars" in rows.columns else left

    return apart(docs, work)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return apart(docs, lambda rows: mixing.emit(mixing.mix(rows), rows.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's token ids, with digests of the ids and of what they decode to."""
    return bpe.encoded(docs, ("n_tokens", "ids", "ids_sha256", "decoded_sha256")).drop("text")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixture),
    ("byte_bpe", tokens),
]

#: Near-duplicates and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
