"""Report tables: formats, the score tables, machines, parameters and examples, in English or Brazilian Portuguese."""

from __future__ import annotations

import html
import math
from dataclasses import dataclass, field

LANGUAGES = ("pt_BR", "en")
#: Words of the reports: key -> (English, Portuguese).
WORDS = {
    "metric": ("Metric", "Métrica"),
    "pairs": ("Pairwise", "Por pares"),
    "changes": ("Changed pairs", "Pares alterados"),
    "method": ("Method", "Método"),
    "records": ("Records", "Registros"),
    "papers": ("Papers", "Publicações"),
    "blocks": ("Blocks", "Blocos"),
    "authors": ("Authors", "Autores"),
    "predicted_clusters": ("Predicted clusters", "Clusters previstos"),
    "true_authors": ("True authors", "Autores verdadeiros"),
    "pairwise_precision": ("Pairwise precision", "Precisão por pares"),
    "pairwise_recall": ("Pairwise recall", "Revocação por pares"),
    "pairwise_f1": ("Pairwise F1", "F1 por pares"),
    "b3_precision": ("B-cubed precision", "Precisão B-cubed"),
    "b3_recall": ("B-cubed recall", "Revocação B-cubed"),
    "b3_f1": ("B-cubed F1", "F1 B-cubed"),
    "average_cluster_purity": ("Average cluster purity", "Pureza média dos clusters"),
    "average_author_purity": ("Average author purity", "Pureza média dos autores"),
    "k_metric": ("K", "K"),
    "runtime": ("Run time", "Tempo de execução"),
    "against": ("against", "em relação a"),
    "points": ("pp", "p.p."),
    "not_recorded": ("Not recorded", "Não registrado"),
    "recorded_for": ("recorded for", "registrado para"),
    "parameter": ("Parameter", "Parâmetro"),
    "value": ("Value", "Valor"),
    "component": ("Component", "Componente"),
    "merges_corrected": ("Wrong merges corrected", "Fusões incorretas corrigidas"),
    "merges_introduced": ("Wrong merges introduced", "Fusões incorretas introduzidas"),
    "splits_corrected": ("Wrong splits corrected", "Separações incorretas corrigidas"),
    "splits_introduced": ("Wrong splits introduced", "Separações incorretas introduzidas"),
    "authors_per_block": ("Authors per block", "Autores por bloco"),
    "records_per_block": ("Records per block", "Registros por bloco"),
    "records_per_author": ("Records per author", "Registros por autor"),
    "slower": ("times slower", "vezes mais lento"),
    "TP": ("True positive: one author, joined", "Verdadeiro positivo: um autor, unido"),
    "TN": ("True negative: two authors, apart", "Verdadeiro negativo: dois autores, separados"),
    "FP": ("False positive: two authors, joined", "Falso positivo: dois autores, unidos"),
    "FN": ("False negative: one author, apart", "Falso negativo: um autor, separado"),
}
RATES = ("b3_precision", "b3_recall", "b3_f1", "pairwise_precision", "pairwise_recall", "pairwise_f1", "average_cluster_purity", "average_author_purity", "k_metric")
#: Arguments that say where a run was done rather than how.
PLACES = {"input", "output", "metrics_output", "embedding_cache", "rebuild_cache", "model_cache", "decision_cache", "decisions_output", "prompts_output", "no_progress"}


def word(key: str, language: str) -> str:
    if language not in LANGUAGES:
        raise ValueError(f"unknown language {language!r}")
    return WORDS.get(key, (key, key))[language == "pt_BR"]


def number(value, form: str, language: str = "en") -> str:
    """Python's format; Portuguese swaps comma and point."""
    text = format(value, form)
    return text.translate(str.maketrans(",.", ".,")) if language == "pt_BR" else text


def duration(seconds: float, language: str = "en") -> str:
    """Below a second three digits, else hours, minutes and seconds without leading zero parts."""
    if seconds < 1:
        return number(seconds, ".3f", language) + " s"
    whole = round(seconds)
    parts = [(whole // 3600, "h"), (whole % 3600 // 60, "min"), (whole % 60, "s")]
    first = next((i for i, (n, _) in enumerate(parts) if n), 2)
    return " ".join(f"{n} {unit}" for n, unit in parts[first:])


def check_time(seconds) -> float:
    if isinstance(seconds, bool) or not isinstance(seconds, (int, float)) or not math.isfinite(seconds) or seconds <= 0:
        raise ValueError(f"a run time must be finite and positive, got {seconds!r}")
    return float(seconds)


def markdown(head: list[str], rows: list[list[str]]) -> str:
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(head), line([":--", *["--:"] * (len(head) - 1)]), *map(line, rows)])


def html_table(head: list[str], rows: list[list[str]]) -> str:
    cell = lambda tag, x: f"<{tag}>{html.escape(str(x))}</{tag}>"
    body = "".join("<tr>" + "".join(cell("td", c) for c in r) + "</tr>" for r in rows)
    return "<table><thead><tr>" + "".join(cell("th", h) for h in head) + f"</tr></thead><tbody>{body}</tbody></table>"


def config_cell(value, language: str = "en") -> str:
    """A value for a Markdown cell."""
    if value is None or value == "":
        return word("not_recorded", language)
    if isinstance(value, bool):
        return str(value).lower()
    return html.escape(str(value)).replace("|", "&#124;").replace("\n", " ")


def gibibytes(mib, language: str = "en") -> str:
    return word("not_recorded", language) if mib is None else number(mib / 1024, ".2f", language) + " GiB"


@dataclass
class Cohort:
    """What a report is made of: scores of every method on aligned records, and what their runs say of themselves."""

    methods: list[str]
    scores: dict[str, dict]
    runs: dict[str, dict] = field(default_factory=dict)
    manifests: dict[str, dict] = field(default_factory=dict)
    statistics: dict = field(default_factory=dict)
    changes: dict[str, dict] = field(default_factory=dict)

    @property
    def baseline(self) -> str:
        return self.methods[0]

    def best(self, metric: str = "b3_f1") -> str:
        return max(self.methods, key=lambda m: self.scores[m][metric])


def score_rows(c: Cohort, language: str = "en") -> tuple[list[str], list[list[str]]]:
    """Twelve rows: rates with their change in points, counts with their difference, run times with their ratio."""
    others, base, points = c.methods[1:], c.scores[c.baseline], word("points", language)
    head = [word("metric", language), *c.methods, *[f"{m} {word('against', language)} {c.baseline}" for m in others]]
    rows = []
    for key in RATES:
        delta = [number((c.scores[m][key] - base[key]) * 100, "+.2f", language) + f" {points}" for m in others]
        rows.append([word(key, language), *[number(c.scores[m][key] * 100, ".2f", language) + "%" for m in c.methods], *delta])
    for key in ("true_authors", "predicted_clusters"):
        rows.append([word(key, language), *[number(c.scores[m][key], ",", language) for m in c.methods], *[number(c.scores[m][key] - base[key], "+,", language) for m in others]])
    times = {m: c.runs.get(m, {}).get("runtime_seconds") for m in c.methods}
    if all(t is not None for t in times.values()):
        times = {m: check_time(t) for m, t in times.items()}
        slower = [number(times[m] / times[c.baseline], ".1f", language) + f" {word('slower', language)}" for m in others]
        rows.append([word("runtime", language), *[duration(times[m], language) for m in c.methods], *slower])
    return head, rows


def statistics_rows(c: Cohort, language: str = "en") -> tuple[list[str], list[list[str]]]:
    s = c.statistics
    rows = [[word(k, language), number(s[k], ",", language)] for k in ("records", "papers", "blocks", "authors")]
    for k in ("authors_per_block", "records_per_block", "records_per_author"):
        rows.append([f"{word(k, language)} (min / max / mean)", f"{number(s[k + '_min'], ',', language)} / {number(s[k + '_max'], ',', language)} / {number(s[k + '_mean'], '.2f', language)}"])
    return [word("metric", language), word("value", language)], rows


def change_rows(c: Cohort, language: str = "en") -> tuple[list[str], list[list[str]]]:
    keys = ("merges_corrected", "merges_introduced", "splits_corrected", "splits_introduced")
    return [word("method", language), *[word(k, language) for k in keys]], [[m, *[number(v[k], ",", language) for k in keys]] for m, v in c.changes.items()]


def machine_rows(c: Cohort, language: str = "en") -> tuple[list[str], list[list[str]]]:
    """One column for each distinct machine, with the methods it was recorded for if not all."""
    machines: list[tuple[dict, list[str]]] = []
    for m in c.methods:
        env = c.manifests.get(m, {}).get("environment")
        if env is None:
            continue
        for known, used in machines:
            if known == env:
                used.append(m)
                break
        else:
            machines.append((env, [m]))
    name = lambda used: word("value", language) if len(machines) == 1 and len(used) == len(c.methods) else f"({word('recorded_for', language)} {', '.join(used)})"
    of = lambda env, *path: of(env.get(path[0]) or {}, *path[1:]) if len(path) > 1 else env.get(path[0])
    lines = {
        "CPU": lambda e: config_cell(of(e, "cpu", "model"), language),
        "Logical CPUs": lambda e: config_cell(of(e, "cpu", "logical_processors"), language),
        "RAM": lambda e: gibibytes(of(e, "system_memory_mib"), language),
        "GPU": lambda e: config_cell(of(e, "gpu", "model"), language),
        "GPU memory": lambda e: gibibytes(of(e, "gpu", "memory_mib"), language),
        "OS": lambda e: config_cell(of(e, "operating_system"), language),
        "Python": lambda e: config_cell(of(e, "python_version"), language),
        "Spark": lambda e: config_cell(of(e, "spark", "version"), language),
    }
    return [word("component", language), *[name(used) for _, used in machines]], [[k, *[f(env) for env, _ in machines]] for k, f in lines.items()]


def parameter_tables(c: Cohort, language: str = "en") -> list[tuple[list[str], list[str], list[list[str]]]]:
    """(methods, head, rows): methods with equal settings share a table; paths and caches are left out."""
    groups: dict[tuple, list[str]] = {}
    for m in c.methods:
        shown = {k: v for k, v in c.manifests.get(m, {}).get("parameters", {}).items() if k not in PLACES}
        groups.setdefault(tuple(sorted((k, str(v)) for k, v in shown.items())), []).append(m)
    return [(ms, [word("parameter", language), word("value", language)], [[k, config_cell(v, language)] for k, v in settings]) for settings, ms in groups.items()]


def empty_bins(bins: list[dict]) -> tuple[int, int]:
    """Over bins of mean probability 0: comparisons, and how many of them were of one author."""
    zero = [b for b in bins if b["count"] and b["mean_probability"] == 0]
    return sum(b["count"] for b in zero), sum(round(b["count"] * b["observed_same_author_rate"]) for b in zero)


def group_section(name: str, shown: list[dict], total: int, authors: int, seed: int, language: str = "en") -> str:
    """HTML of one block's example records."""
    columns = [c for c in ("paper_id", "author_name", "coauthors", "title", "venue", "label") if shown and c in shown[0]]
    counts = f"{number(total, ',', language)} {word('records', language)} · {number(authors, ',', language)} {word('authors', language)} · {len(shown)} / {total} · seed {seed}"
    return f"<section><h3>{html.escape(name)}</h3><p>{html.escape(counts)}</p>{html_table(columns, [[r[c] for c in columns] for r in shown])}</section>"


def pair_section(method: str, outcome: str, count: int, pairs: list[tuple[dict, dict]], language: str = "en") -> str:
    """HTML of example pairs of one outcome."""
    body = "".join(html_table(list(a), [list(a.values()), list(b.values())]) for a, b in pairs) or "<p>–</p>"
    return f"<section><h3>{html.escape(method)}: {html.escape(word(outcome, language))}</h3><p>{number(count, ',', language)}</p>{body}</section>"
