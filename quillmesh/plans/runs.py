"""Whole runs of the three methods: scan, cluster, write predictions, metrics and a manifest."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import clusters, embedding, generative, metrics, retrieval
from ..operators.judging import Judge, Settings, named_judge
from ..sources import sinks
from ..sources.durable import kept
from ..sources.records import coauthor_list, sample_blocks, sample_blocks_by_hash, scan_csv


@dataclass(frozen=True)
class Job:
    """What all methods need: where records come from, which blocks of them, and where results go."""

    input: str
    output: str
    title: float = clusters.TITLE
    venue: float = clusters.VENUE
    blocks: int | None = None
    seed: int = 42
    by_hash: bool = False
    metrics_output: str | None = None

    def __post_init__(self) -> None:
        check_thresholds(self.title, self.venue)
        if self.blocks is not None and self.blocks < 1:
            raise ValueError("the number of blocks must be positive")

    def parameters(self) -> dict:
        shown = {"input": self.input, "output": self.output, "title_threshold": self.title, "venue_threshold": self.venue, "n_ambiguous_group": self.blocks, "seed": self.seed}
        return shown | ({"sample_by_hash": True} if self.by_hash else {})

    def records(self, spark: SparkSession) -> DataFrame:
        rows = scan_csv(spark, self.input)
        if self.blocks is not None:
            rows = (sample_blocks_by_hash if self.by_hash else sample_blocks)(rows, self.blocks, self.seed)
        return kept(rows.withColumn("coauthors", coauthor_list(F.col("coauthors"))), "records")

    def summary_path(self, method: str) -> Path:
        return Path(self.metrics_output) if self.metrics_output else Path(self.output) / f"{method}_metrics.json"


def check_thresholds(title: float, venue: float, semantic: float = 0.0) -> None:
    if not (0 <= title <= 1 and 0 <= venue <= 1 and -1 <= semantic <= 1):
        raise ValueError("a threshold is out of range")


def finish(job: Job, records: DataFrame, found: DataFrame, method: str, summary: dict, parameters: dict, started: float, device: str = "cpu") -> dict:
    """Sinks and evaluation, which is left out where there are no labels. Records and predictions must be as many."""
    spark = records.sparkSession
    rows = kept(sinks.predictions(records, found), "predictions")
    if (n := records.count()) != rows.count() or n != found.count():
        raise ValueError("records and predictions differ in number")
    sinks.write_predictions(rows, str(Path(job.output) / f"{method}_predictions"))
    if "label" in records.columns:
        summary |= sinks.first_row(metrics.evaluate(rows.select(F.col("ambiguous_name").alias("block"), "label", F.col("predicted_cluster").alias("cluster"))))
    summary |= {"method": method, "ambiguous_groups": records.select("ambiguous_name").distinct().count(), "runtime_seconds": round(time.perf_counter() - started, 3)}
    sinks.write_json(job.summary_path(method), summary)
    sinks.write_manifest(job.summary_path(method), method, parameters, device, spark)
    return summary


def run_lexical(spark: SparkSession, job: Job) -> dict:
    started, parameters = time.perf_counter(), job.parameters()
    records = job.records(spark)
    found = kept(clusters.lexical(clusters.prepared(records), job.title, job.venue), "lexical")
    return finish(job, records, found, "lexical", dict(parameters), parameters, started)


@dataclass(frozen=True)
class Vectors:
    """How records are embedded: the model, its limits, and the cache."""

    model: str = "hashing-64"
    max_length: int = 256
    batch_size: int = 16
    device: str = "auto"
    cache: str | None = None
    rebuild: bool = False
    model_cache: str | None = None

    def __post_init__(self) -> None:
        if self.max_length < 1 or self.batch_size < 1:
            raise ValueError("a count is out of range")

    def of(self, records: DataFrame, encoder=None) -> tuple[DataFrame, bool, float]:
        """Vectors of all records, whether they came from the cache, and the seconds that it took."""
        started = time.perf_counter()
        if encoder is None:
            options = {} if self.model in embedding.ENCODERS else {"device": self.device, "max_length": self.max_length, "batch": self.batch_size, "cache": self.model_cache}
            encoder = embedding.model_encoder(self.model, **options)
        if self.cache:
            vectors, hit = embedding.with_cache(records, self.cache, self.model, self.max_length, encoder, self.rebuild)
        else:
            vectors, hit = kept(embedding.encoded(records, encoder), "vectors"), False
        return vectors, hit, round(time.perf_counter() - started, 3)


def run_semantic(spark: SparkSession, job: Job, semantic: float = clusters.SEMANTIC, vectors: Vectors = Vectors(), encoder=None) -> dict:
    check_thresholds(job.title, job.venue, semantic)
    device = embedding.resolve_device(vectors.device)
    started = time.perf_counter()
    parameters = job.parameters() | {"semantic_threshold": semantic, "model": vectors.model, "batch_size": vectors.batch_size, "max_length": vectors.max_length, "device": vectors.device, "embedding_cache": vectors.cache, "model_cache": vectors.model_cache, "rebuild_cache": vectors.rebuild}
    records = job.records(spark)
    embedded, hit, seconds = vectors.of(records, encoder)
    features = clusters.prepared(records).join(embedded.select("row_index", "embedding"), "row_index")
    found = kept(clusters.semantic(features, job.title, job.venue, semantic), "semantic")
    summary = dict(parameters) | {"embedding_cache_hit": hit, "embedding_seconds": seconds, "device": device}
    return finish(job, records, found, "semantic", summary, parameters, started, device)


@dataclass(frozen=True)
class Judging:
    """Who judges and where decisions and prompts are kept; paths of None have names in the output folder."""

    revision: str = "main"
    max_new_tokens: int = 128
    cpu_threads: int = 4
    cpu_int8: bool = False
    device: str = "auto"
    model_cache: str | None = None
    decision_cache: str | None = None
    decision_lines: str | None = None
    decisions_output: str | None = None
    prompts_output: str | None = None
    retrieval_diagnostics: bool = False

    def __post_init__(self) -> None:
        if min(self.max_new_tokens, self.cpu_threads) < 1:
            raise ValueError("a count is out of range")

    def judge(self, model: str) -> Judge:
        return named_judge(model, revision=self.revision, device=self.device, max_new_tokens=self.max_new_tokens, cpu_threads=self.cpu_threads, cpu_int8=self.cpu_int8, cache=self.model_cache)


def known_decisions(spark: SparkSession, judging: Judging) -> DataFrame | None:
    """Decisions of earlier runs: of the Parquet cache, and of JSON lines as other tools write them; both are validated."""
    found = None
    if judging.decision_cache and embedding.stored(spark, judging.decision_cache):
        found = generative.valid_decisions(spark.read.schema(generative.CACHE).parquet(judging.decision_cache))
    if judging.decision_lines:
        lines = generative.parse_cache_lines(spark.read.text(judging.decision_lines))
        found = lines if found is None else found.unionByName(lines)
    # Of several decisions under one key the first by its text is taken.
    return None if found is None else found.groupBy("ambiguous_name", "key").agg(F.min(F.struct("same_author", "same_author_probability", "reason")).alias("d")).select("ambiguous_name", "key", "d.*")


def run_generative(spark: SparkSession, job: Job, settings: Settings = Settings(), vectors: Vectors = Vectors(), judging: Judging = Judging(), judge: Judge | None = None, encoder=None) -> dict:
    judge = judge or judging.judge(settings.model)
    device = embedding.resolve_device(judging.device, 6 * 1024)
    started, out = time.perf_counter(), Path(job.output)
    parameters = job.parameters() | asdict(settings) | {f"judging_{k}" if k in ("device",) else k: v for k, v in asdict(judging).items()}
    parameters |= {"embedding_model": vectors.model, "embedding_cache": vectors.cache, "rebuild_cache": vectors.rebuild}
    records = job.records(spark)
    if "label" not in records.columns:
        records = records.withColumn("label", F.lit(""))
    lexical = kept(clusters.lexical(clusters.prepared(records), job.title, job.venue), "lexical")
    embedded, hit, _ = vectors.of(records, encoder)
    run = generative.generative(embedded, lexical, settings, judge, known_decisions(spark, judging))
    summary = dict(parameters) | sinks.first_row(run.totals()) | {"embedding_cache_hit": hit, "retrieval_diagnostics_enabled": judging.retrieval_diagnostics, "retrieval_diagnostics": {}}
    audit = generative.decisions(run.log)
    counted = sinks.first_row(metrics.judged_counts(audit, settings.confidence))
    names = {"comparisons": "labeled_valid_comparisons", "tp": "true_positive", "fp": "false_positive", "fn": "false_negative", "tn": "true_negative"}
    summary["decision_diagnostics"] = {names.get(k, k): v for k, v in counted.items()}
    summary["decision_diagnostics"]["confidence_bins"] = [r.asDict() for r in metrics.confidence_bins(audit).orderBy("lower").collect()]
    if judging.retrieval_diagnostics:
        members = embedded.join(lexical.select("row_index", "cluster_no"), "row_index").select(F.col("ambiguous_name").alias("block"), F.col("cluster_no").alias("cluster"), text.tokens(F.col("author_name")).alias("name_tokens"), "label", "embedding")
        members = kept(members, "members")
        centres = retrieval.centroids(members)
        scores = retrieval.centroid_scores(centres) if settings.score == "centroid" else retrieval.hybrid_scores(centres, members)
        summary["retrieval_diagnostics"] = sinks.first_row(retrieval.diagnostics(members, scores, settings.threshold, settings.top_k, settings.budget))
    # As many parts as tasks, in order.
    generative.log_json(run.log).write.mode("overwrite").text(judging.decisions_output or str(out / "generative_decisions"))
    prompts = run.log.select("label", F.explode("prompts").alias("prompt")).select("prompt", "label")
    summary["prompts_recorded"] = prompts.count()
    sinks.write_prompt_log(prompts, judging.prompts_output or str(out / "generative_prompts.json"))
    out_summary = finish(job, records, run.clusters, "generative", summary, parameters, started, device)
    if judging.decision_cache:
        run.new_decisions().write.mode("append").parquet(judging.decision_cache)
    return out_summary
