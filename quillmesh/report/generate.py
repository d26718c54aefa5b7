"""From aligned predictions to report files: scores, charts, examples and the text sections of a README."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alignment, metrics, sampling
from ..sources import sinks
from ..sources.durable import kept
from ..sources.records import occurrence, scan_csv
from . import charts, text
from .tables import LANGUAGES, Cohort, check_time, duration, group_section, number, pair_section, score_rows, statistics_rows, word

CHANGES = ("merges_corrected", "merges_introduced", "splits_corrected", "splits_introduced")
METHODS = ("lexical", "semantic", "generative")
PREFIX = "REPORT"


def load(spark: SparkSession, folder: str, methods=METHODS) -> tuple[Cohort, DataFrame]:
    """Runs of a folder (<method>_predictions, <method>_metrics.json, <method>_experiment.json) on common records.

    The last method defines the cohort: extra records of the others are left out, missing ones are an error.
    """
    frames = {m: sinks.read_predictions(spark, f"{folder}/{m}_predictions") for m in methods}
    common = alignment.aligned(frames, methods[-1])
    common = kept(common, "aligned")
    alignment.require_complete(common, frames, methods[-1])
    long = alignment.long_form(common, list(methods))
    scores = {m: sinks.first_row(metrics.evaluate(long.where(F.col("method") == m))) for m in methods}
    runs = {m: sinks.read_run(folder, m, m) for m in methods}
    pairs = common.select(F.col("ambiguous_name").alias("block"), "label", "paper_id", *[f"cluster_{m}" for m in methods])
    changes = {}
    for m in methods[1:]:
        both = pairs.select("block", "label", F.col(f"cluster_{methods[0]}").alias("base"), F.col(f"cluster_{m}").alias("extension"))
        changes[m] = sinks.first_row(metrics.error_changes(both))
    stats = sinks.first_row(metrics.statistics(pairs))
    return Cohort(list(methods), scores, {m: r[0] for m, r in runs.items()}, {m: r[1] for m, r in runs.items() if r[1]}, stats, changes), common


def with_source(rows: DataFrame, source: DataFrame) -> DataFrame:
    """Aligned rows with the publication fields of their source records; a row without one is an error."""
    keyed = occurrence(source, alignment.KEYS, "row_index")
    on = [*alignment.KEYS, "occurrence"]
    if not rows.join(keyed.select(*on), on, "left_anti").isEmpty():
        raise ValueError("some aligned records are missing from the source publications")
    return rows.join(keyed.select(*on, "row_index", "author_name", "coauthors", "title", "venue"), on)


def group_examples(common: DataFrame, source: DataFrame, n: int = 1, per_block: int = 5, seed: int = 42, least_authors: int = 1, language: str = "en") -> str:
    """HTML of example records of a few sampled blocks."""
    blocks = common.withColumn("block", F.col("ambiguous_name"))
    out = []
    for name in sampling.sampled_blocks(blocks, n, seed, least_authors):
        own = with_source(blocks.where(F.col("block") == name), source)
        shown = [r.asDict() for r in sampling.group_examples(own, per_block).orderBy("position").collect()]
        size = own.agg(F.count(F.lit(1)), F.countDistinct("label")).first()
        out.append(group_section(name, shown, size[0], size[1], seed, language))
    return "".join(out)


def pair_examples(common: DataFrame, source: DataFrame, methods: list[str], n: int = 1, seed: int = 42, language: str = "en") -> str:
    """HTML of example pairs of every method and outcome, with exact counts; only the drawn records are collected."""
    full = with_source(common, source).withColumn("rid", F.col("row_index"))
    out = []
    for m in methods:
        pairs = full.select(F.col("ambiguous_name").alias("block"), "rid", "label", F.col(f"cluster_{m}").alias("cluster"))
        counts = {r["outcome"]: r["n"] for r in sampling.pair_outcomes(pairs).collect()}
        drawn = sampling.pair_sample(pairs, n, seed).orderBy("outcome", "place").collect()
        ids = sorted({r[s] for r in drawn for s in ("left_id", "right_id")})
        records = {r["rid"]: r.asDict() for r in full.where(F.col("rid").isin(ids)).collect()}
        show = lambda i: {k: records[i][k] for k in ("paper_id", "author_name", "coauthors", "title", "venue", "label")} | {"cluster": records[i][f"cluster_{m}"]}  # noqa: B023, E731
        for o in sampling.OUTCOMES:
            out.append(pair_section(m, o, counts[o], [(show(r["left_id"]), show(r["right_id"])) for r in drawn if r["outcome"] == o], language))
    return "".join(out)


def chart_data(c: Cohort) -> dict[str, list[dict]]:
    """The numbers of every chart: stem -> rows of method, metric and value. Charts are drawn from these and nothing else."""
    rates = {"pairwise_metrics": ("pairwise_precision", "pairwise_recall", "pairwise_f1"), "bcubed_metrics": ("b3_precision", "b3_recall", "b3_f1"), "purity_k_metrics": ("average_cluster_purity", "average_author_purity", "k_metric")}
    row = lambda m, k, v: {"method": m, "metric": k, "value": v}
    out = {stem: [row(m, k, c.scores[m][k]) for m in c.methods for k in keys] for stem, keys in rates.items()}
    out["error_changes"] = [row(m, k, v[k]) for m, v in c.changes.items() for k in CHANGES]
    out["execution_time"] = [row(m, "s", check_time(c.runs.get(m, {}).get("runtime_seconds"))) for m in c.methods]
    return out


def bar_chart(title: str, rows: list[dict], style: charts.Style, language: str, by: str = "metric", **options) -> str:
    """Groups of bars along `by`, one bar of each for every value of the other column."""
    other = "method" if by == "metric" else "metric"
    groups, series = (list(dict.fromkeys(r[c] for r in rows)) for c in (by, other))
    value = {(r[by], r[other]): r["value"] for r in rows}
    return charts.bars(title, [word(g, language) for g in groups], {word(s, language): [value[g, s] for g in groups] for s in series}, style, **options)


def generate(c: Cohort, folder: str | Path, language: str = "pt_BR", style: charts.Style = charts.Style()) -> list[Path]:
    """Eight files; Portuguese ones have the suffix -pt_BR."""
    if language not in LANGUAGES:
        raise ValueError(f"unknown language {language!r}")
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    data = chart_data(c)
    whole = lambda v: number(v, ",", language)
    files = {
        "data_statistics": charts.table(*statistics_rows(c, language), style),
        "pairwise_metrics": bar_chart(word("pairs", language), data["pairwise_metrics"], style, language),
        "bcubed_metrics": bar_chart("B-cubed", data["bcubed_metrics"], style, language),
        "purity_k_metrics": bar_chart("K", data["purity_k_metrics"], style, language),
        "reports_table": charts.table(*score_rows(c, language), style),
        "error_changes": bar_chart(word("changes", language), data["error_changes"], style, language, label=whole),
        "execution_time": bar_chart(word("runtime", language), data["execution_time"], style, language, by="method", log=True, label=lambda v: duration(v, language)),
        "methodology": charts.steps(word("method", language), list(c.methods), style),
    }
    out = []
    for stem, body in files.items():
        out.append(folder / chart_name(stem, language))
        out[-1].write_text(body, encoding="utf-8")
    return out


def chart_name(stem: str, language: str) -> str:
    return f"{stem}{'-pt_BR' if language == 'pt_BR' else ''}.svg"


def update_readme(path: str | Path, c: Cohort, language: str = "en", report_dir: str | Path = "figs") -> None:
    """Replace the seven marked sections; nothing is written unless all markers are right."""
    path = Path(path)
    links = {stem: sinks.relative(Path(report_dir) / chart_name(stem, language), path) for stem in text.CAPTIONS}
    path.write_text(sinks.replace_sections(path.read_text(encoding="utf-8"), text.sections(c, language, links), PREFIX), encoding="utf-8")


def report(spark: SparkSession, output_dir: str, report_dir: str, language: str = "pt_BR", readme: str | None = None, source: str | None = None, examples: int = 1, seed: int = 42, show: bool = False) -> dict:
    """Charts, examples and, if asked for, a README's sections, from the runs in output_dir.

    Examples need the publications: those of `source`, or of the last method's input if that is still there.
    """
    cohort, common = load(spark, output_dir)
    files = generate(cohort, report_dir, language)
    path = source or cohort.runs[cohort.methods[-1]].get("input")
    if examples and path and (source or readable(spark, path)):
        publications = kept(scan_csv(spark, path), "publications")
        for name, body in (
            ("group_examples", group_examples(common, publications, examples, seed=seed, language=language)),
            ("pair_examples", pair_examples(common, publications, cohort.methods, examples, seed, language)),
        ):
            files.append(Path(report_dir) / chart_name(name, language).replace(".svg", ".html"))
            files[-1].write_text(body, encoding="utf-8")
    if readme:
        update_readme(readme, cohort, language, report_dir)
    if show:
        print("\n\n".join(text.sections(cohort, language).values()))
    return {"files": [str(f) for f in files]}


def readable(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
