"""Token counts through a digest cache.

A text's digest and the tokenizer version's digest name a stored count. Only distinct texts without one are encoded;
their counts are appended to the cache, and every document takes its count from there.

Content is normalised as far as no count can change: a null text becomes the empty text. Rows are independent, so ties
and repeated rows need no rule (equal texts are encoded once); an empty table gives an empty table; an input column
whose name clashes with an output is replaced by the output. An append that was lost half way only leaves counts that
are stored twice, and reading takes one of them.
"""

from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, own_name

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Rows encoded at a time inside an Arrow batch.
ROWS = 256
CACHE_SCHEMA = "digest string, version string, n_tokens long"

_counters: dict = {}


def version_of(path: str) -> str:
    """Digest of the vocabulary file and of how it is used."""
    with open(path, "rb") as model:
        return hashlib.sha256(b"plain 1\0" + model.read()).hexdigest()


def counter(path: str):
    """texts -> numbers of tokens; one tokenizer for each worker process and file."""
    if path not in _counters:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _counters[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _counters[path] = lambda texts: [len(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    return _counters[path]


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    try:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE_SCHEMA)
    return rows.where(F.col("version") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def counted(docs: DataFrame, cache: str | None = None, path: str | None = None, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit.

    `cache` is a folder in a store that all executors share; without one, a new folder is used.
    """
    spark, path = docs.sparkSession, path or public_tokenizers.path(MODEL)
    cache, version = cache or new_path(spark, "token-counts"), version_of(path)
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_bytes", "n_tokens", "over_limit")]
    content = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.sha2(content, 256).alias("digest"), content.alias("content"))
    # Equal texts meet before the shuffle, so a hot one is sent once by each task.
    distinct = texts.groupBy("digest").agg(F.first("content").alias("content"))
    misses = distinct.join(read_cache(spark, cache, version), "digest", "left_anti")

    def work(batches):
        count = counter(path)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                n = pa.array(count(batch.column(1).to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([version] * batch.num_rows, pa.string()), n], names=["digest", "version", "n_tokens"])

    misses.select("digest", "content").mapInArrow(work, CACHE_SCHEMA).write.mode("append").parquet(cache)
    known = own_name(docs, "digest")
    stored = read_cache(spark, cache, version).withColumnRenamed("digest", known)
    out = docs.select(*keep, F.octet_length(content).cast("long").alias("n_bytes"), F.sha2(content, 256).alias(known)).join(stored, known, "left")
    return out.withColumn("over_limit", F.col("n_tokens") > limit).drop(known)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # The text is read for its length and digest, but only those reach the join.
    return counted(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")
