"""Charts as hand-written SVG: grouped bars, log-scale times and the order of a method's steps."""

from __future__ import annotations

import html
import math
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Style:
    background: str = "#ffffff"
    text: str = "#222222"
    border: str = "#cccccc"
    series: tuple[str, ...] = ("#4c6a92", "#c9803a", "#5b8c5a", "#8a5a83")
    font: str = "sans-serif"
    width: int = 760
    height: int = 360


def _svg(body: str, style: Style) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {style.width} {style.height}" font-family="{style.font}" font-size="12"><rect width="100%" height="100%" fill="{style.background}"/>{body}</svg>'


def _text(x: float, y: float, value: str, style: Style, anchor: str = "middle") -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" text-anchor="{anchor}" fill="{style.text}">{html.escape(value)}</text>'


def bars(title: str, groups: list[str], series: dict[str, list[float]], style: Style = Style(), log: bool = False, label=lambda v: f"{v:.2f}") -> str:
    """One bar for each group and series, from zero, or from a power of ten below the least value on a log scale."""
    values = [v for vs in series.values() for v in vs]
    if not values or any(not math.isfinite(v) or v < 0 or (log and v <= 0) for v in values):
        raise ValueError("bars need finite values, on a log scale positive ones")
    low = math.floor(math.log10(min(values))) if log else 0.0
    at = (lambda v: math.log10(v) - low) if log else (lambda v: v)
    top = max(map(at, values)) or 1.0
    left, bottom, height = 50, style.height - 50, style.height - 110
    step = (style.width - left - 20) / len(groups)
    wide = step * 0.8 / len(series)
    out = [_text(style.width / 2, 24, title, style), f'<line x1="{left}" x2="{style.width - 20}" y1="{bottom}" y2="{bottom}" stroke="{style.border}"/>']
    for g, group in enumerate(groups):
        out.append(_text(left + step * (g + 0.5), bottom + 18, group, style))
        for s, (name, vs) in enumerate(series.items()):
            h, x = height * at(vs[g]) / top, left + step * g + step * 0.1 + wide * s
            out.append(f'<rect x="{x:.1f}" y="{bottom - h:.1f}" width="{wide * 0.92:.1f}" height="{h:.1f}" fill="{style.series[s % len(style.series)]}"><title>{html.escape(name)}</title></rect>')
            out.append(_text(x + wide * 0.46, bottom - h - 4, label(vs[g]), style))
    for s, name in enumerate(series):
        out.append(f'<rect x="{left + 130 * s}" y="34" width="10" height="10" fill="{style.series[s % len(style.series)]}"/>' + _text(left + 130 * s + 14, 43, name, style, "start"))
    return _svg("".join(out), style)


def table(head: list[str], rows: list[list[str]], style: Style = Style()) -> str:
    """A ruled table: the first column to the left, all others to the right, rows shaded in turn."""
    longest = [max(len(r[k]) for r in [head, *rows]) + 2 for k in range(len(head))]
    ends, total = [], sum(longest)
    for n in longest:
        ends.append((ends[-1] if ends else 20) + (style.width - 40) * n / total)
    high = 24
    out = []
    for i, r in enumerate([head, *rows]):
        y = 20 + high * i
        if i % 2:
            out.append(f'<rect x="20" y="{y}" width="{style.width - 40}" height="{high}" fill="{style.border}" fill-opacity="0.25"/>')
        for k, cell in enumerate(r):
            out.append(_text(26 if k == 0 else ends[k] - 6, y + 16, cell, style, "start" if k == 0 else "end"))
    below = 20 + high * len(rows) + high
    out.append(f'<line x1="20" x2="{style.width - 20}" y1="{20 + high}" y2="{20 + high}" stroke="{style.text}"/>')
    return _svg("".join(out), replace(style, height=below + 20))


def steps(title: str, names: list[str], style: Style = Style()) -> str:
    """Boxes joined by arrows."""
    wide = (style.width - 40) / len(names)
    out, y = [_text(style.width / 2, 24, title, style)], style.height / 2
    for i, name in enumerate(names):
        x = 20 + wide * i
        out.append(f'<rect x="{x:.1f}" y="{y - 30:.1f}" width="{wide * 0.8:.1f}" height="60" rx="6" fill="none" stroke="{style.series[0]}"/>' + _text(x + wide * 0.4, y + 4, name, style))
        if i:
            out.append(f'<line x1="{x - wide * 0.2:.1f}" x2="{x:.1f}" y1="{y:.1f}" y2="{y:.1f}" stroke="{style.text}"/>')
    return _svg("".join(out), style)
