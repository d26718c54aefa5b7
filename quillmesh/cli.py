"""Command line: python -m quillmesh.cli {lexical,semantic,generative,sweep,report} ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .operators.judging import Settings

ALL, VECTORS, JUDGED = ("lexical", "semantic", "generative", "sweep"), ("semantic", "generative", "sweep"), ("generative", "sweep")
#: Characters that stand for a token where no tokenizer is at hand.
TOKEN_CHARS = 4
#: flag: commands that know it, then what argparse is told of it.
FLAGS: dict[str, tuple[tuple[str, ...], dict]] = {
    "--title-threshold": (ALL, {"type": float, "default": 0.30}),
    "--venue-threshold": (ALL, {"type": float, "default": 0.50}),
    "--n-ambiguous-group": (ALL, {"type": int, "help": "sample this many whole blocks"}),
    "--seed": (ALL, {"type": int, "default": 42}),
    "--sample-by-hash": (ALL, {"action": "store_true", "help": "draw blocks by a hash of their names, without collecting the names"}),
    "--metrics-output": (ALL, {"help": "path of the metrics file"}),
    "--no-progress": (ALL, {"action": "store_true", "help": "no progress bar"}),
    "--semantic-threshold": (("semantic",), {"type": float, "default": 0.80}),
    "--embedding-model": (JUDGED, {"default": "hashing-64"}),
    "--embedding-cache": (VECTORS, {}),
    "--rebuild-cache": (VECTORS, {"action": "store_true"}),
    "--batch-size": (VECTORS, {"type": int, "default": 16}),
    "--max-length": (VECTORS, {"type": int, "default": 256}),
    "--device": (VECTORS, {"choices": ("auto", "cpu", "cuda"), "default": "auto"}),
    "--model-cache": (VECTORS, {"help": "folder of downloaded models"}),
    "--llm-confidence-threshold": (JUDGED, {"type": float, "default": 0.70}),
    "--semantic-candidate-threshold": (JUDGED, {"type": float, "default": 0.55}),
    "--candidate-score": (JUDGED, {"choices": ("centroid", "hybrid"), "default": "centroid"}),
    "--semantic-top-k": (JUDGED, {"type": int, "default": 5}),
    "--max-llm-comparisons-per-group": (JUDGED, {"type": int, "default": 25}),
    "--max-records-per-cluster": (JUDGED, {"type": int, "default": 8}),
    "--max-input-tokens": (JUDGED, {"type": int, "default": 2048, "help": f"a token counts as {TOKEN_CHARS} characters"}),
    "--max-new-tokens": (JUDGED, {"type": int, "default": 128}),
    "--llm-retries": (JUDGED, {"type": int, "default": 1}),
    "--model-revision": (JUDGED, {"default": "main"}),
    "--cpu-threads": (JUDGED, {"type": int, "default": 4}),
    "--cpu-int8": (JUDGED, {"action": "store_true"}),
    "--decision-cache": (JUDGED, {"help": "folder of decisions, read and appended to"}),
    "--decision-lines": (JUDGED, {"help": "JSON lines of earlier decisions, read only"}),
    "--decisions-output": (JUDGED, {"help": "folder of the decision log"}),
    "--prompts-output": (JUDGED, {"help": "file of the prompt log"}),
    "--retrieval-diagnostics": (JUDGED, {"action": "store_true"}),
    "--least-precision": (("sweep",), {"type": float, "default": 0.0}),
    "--output-dir": (("report",), {"default": "outputs"}),
    "--report-dir": (("report",), {"default": "figs"}),
    "--readme": (("report",), {}),
    "--no-update-readme": (("report",), {"action": "store_true"}),
    "--language": (("report",), {"choices": ("en", "pt_BR"), "default": "pt_BR"}),
    "--show": (("report",), {"action": "store_true", "help": "print the text sections"}),
    "--source": (("report",), {"help": "publications for examples; by default the input of the last method's run"}),
    "--examples": (("report",), {"type": int, "default": 1, "help": "example blocks, and example pairs of each outcome"}),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillmesh", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for command in (*ALL, "report"):
        p = sub.add_parser(command)
        if command != "report":
            p.add_argument("input")
            p.add_argument("-o", "--output", default="outputs", help="folder for predictions, metrics and manifest")
        if command in VECTORS:
            p.add_argument("--model", default="hashing-64" if command == "semantic" else Settings.model)
        if command == "sweep":
            for flag, values in (("--confidences", (0.6, 0.7, 0.8)), ("--candidate-thresholds", (0.45, 0.55, 0.65)), ("--top-ks", (3, 5))):
                p.add_argument(flag, type=type(values[0]), nargs="+", default=list(values))
        for flag, (commands, told) in FLAGS.items():
            if command in commands:
                p.add_argument(flag, **told)
    return top


def settings_of(a: argparse.Namespace) -> Settings:
    return Settings(
        model=a.model, max_records=a.max_records_per_cluster, max_input_chars=a.max_input_tokens * TOKEN_CHARS, retries=a.llm_retries,
        confidence=a.llm_confidence_threshold, threshold=a.semantic_candidate_threshold, top_k=a.semantic_top_k, budget=a.max_llm_comparisons_per_group, score=a.candidate_score,
    )


def main(argv: list[str] | None = None) -> dict:
    from .plans import runs, sweep
    from .report import generate

    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("quillmesh").config("spark.ui.showConsoleProgress", str(not getattr(a, "no_progress", True)).lower()).getOrCreate()
    if a.command == "report":
        return generate.report(spark, a.output_dir, a.report_dir, a.language, None if a.no_update_readme else a.readme, a.source, a.examples, a.seed if "seed" in a else 42, a.show)
    job = runs.Job(a.input, a.output, a.title_threshold, a.venue_threshold, a.n_ambiguous_group, a.seed, a.sample_by_hash, a.metrics_output)
    if a.command == "lexical":
        return runs.run_lexical(spark, job)
    vectors = runs.Vectors(a.model if a.command == "semantic" else a.embedding_model, a.max_length, a.batch_size, a.device, a.embedding_cache, a.rebuild_cache, a.model_cache)
    if a.command == "semantic":
        return runs.run_semantic(spark, job, a.semantic_threshold, vectors)
    judging = runs.Judging(a.model_revision, a.max_new_tokens, a.cpu_threads, a.cpu_int8, a.device, a.model_cache, a.decision_cache, a.decision_lines, a.decisions_output, a.prompts_output, a.retrieval_diagnostics)
    if a.command == "generative":
        return runs.run_generative(spark, job, settings_of(a), vectors, judging)
    return sweep.run_sweep(spark, job, settings_of(a), vectors, judging, (a.confidences, a.candidate_thresholds, a.top_ks), a.least_precision)


if __name__ == "__main__":
    print(json.dumps(main(), indent=2, sort_keys=True, default=str))
