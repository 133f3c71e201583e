"""Reports: the summary pivoted to scenarios by methods, and an HTML page of it."""

from __future__ import annotations

import html
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

NAME_PARTS = ("sketch", "sketch_config", "estimator", "sketch_epsilon", "estimate_epsilon", "max_frequency")


def name_parts(name: Column) -> list[Column]:
    """The five or six parts of a plain method name; missing ones are null."""
    parts = F.split(name, "-")
    return [F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(NAME_PARTS)]


def with_name_parts(df: DataFrame, column: str = "sketch_estimator") -> DataFrame:
    return df.select("*", *name_parts(F.col(column)))


def signed_round(c: Column, digits: int) -> Column:
    """Rounded as IEEE arithmetic has it: the multiple decides on halves, which go away from zero, and a
    negative number that rounds to zero keeps its sign. Spark's own takes the decimal digits and drops the sign."""
    power = F.lit(10.0**digits)
    return F.signum(c) * F.abs(F.round(c * power) / power)


def cell(metric: str) -> Column:
    """'20 (0.0012, 0.0257)': sets, mean and deviation; -0.0000 is a small negative number."""
    number = lambda c: F.when(F.col(c).isNull(), "nan").otherwise(F.format_string("%.4f", signed_round(F.col(c), 4)))
    return F.concat(F.col("num_estimable_sets").cast("string"), F.lit(" ("), number(f"{metric}_mean"), F.lit(", "), number(f"{metric}_std"), F.lit(")"))


def pivoted(summary: DataFrame, metric: str = "relative_error_1") -> DataFrame:
    """A row per criterion and method, a column per scenario."""
    crit = F.concat(F.round(F.col("proportion_of_runs") * 100).cast("int"), F.lit("%/"), F.round(F.col("error_margin") * 100).cast("int"), F.lit("%"))
    rows = summary.select(crit.alias("criteria"), "sketch_estimator", "scenario", cell(metric).alias("cell"))
    return rows.groupBy("criteria", "sketch_estimator").pivot("scenario").agg(F.concat_ws("", F.array_sort(F.collect_list("cell"))))


def epsilon_pairs(df: DataFrame) -> DataFrame:
    return df.select("sketch_epsilon", "estimate_epsilon").distinct()


def by_epsilons(summary: DataFrame, metric: str = "relative_error_1") -> dict[str, DataFrame]:
    """A pivoted table for each pair of a sketch's and an estimate's epsilon, under the pair's name.

    The pairs are a handful of the methods' parameters.
    """
    named = summary if "sketch_epsilon" in summary.columns else with_name_parts(summary)
    out = {}
    for row in epsilon_pairs(named).orderBy("sketch_epsilon", "estimate_epsilon").collect():
        own = named.where(F.col("sketch_epsilon").eqNullSafe(F.lit(row[0])) & F.col("estimate_epsilon").eqNullSafe(F.lit(row[1])))
        out[f"sketch epsilon {row[0]}, estimate epsilon {row[1]}"] = pivoted(own, metric)
    return out


def frequency_rows(bars: DataFrame) -> DataFrame:
    """A bar plot's numbers (analyze.bar_plot) side by side: estimated and true cardinality by level."""
    return bars.groupBy("scenario", "sketch_estimator", "frequency_level").pivot("source", ["estimated_cardinality", "true_cardinality"]).agg(F.first("cardinality"))


#: The drawing's size and margins, in pixels.
WIDTH, HEIGHT, EDGE = 260, 150, 22


def scaled(low: float, high: float, size: int) -> Callable[[float], float]:
    span = (high - low) or 1.0
    return lambda v: EDGE + (v - low) / span * (size - 2 * EDGE)


def svg(parts: list[str], title: str) -> str:
    return f"<svg width='{WIDTH}' height='{HEIGHT}' xmlns='http://www.w3.org/2000/svg'><text x='4' y='12' font-size='9'>{html.escape(title)}</text>{''.join(parts)}</svg>"


def box_svg(rows: list, title: str) -> str:
    """One cell of the grid of box plots: the errors of a method in a scenario, by number of sets."""
    good = [r for r in rows if r.low is not None and r.low == r.low]
    if not good:
        return svg([], title)
    y = scaled(min(0.0, *(r.low for r in good)), max(0.0, *(r.high for r in good)), HEIGHT)
    x = scaled(0.5, max(r.num_sets for r in good) + 0.5, WIDTH)
    up, half = (lambda v: HEIGHT - y(v)), max(1.5, (x(1) - x(0.5)) * 0.7)
    parts = [f"<line x1='{EDGE}' x2='{WIDTH - EDGE}' y1='{up(0):.1f}' y2='{up(0):.1f}' stroke='#bbb'/>"]
    for r in good:
        at = x(r.num_sets)
        parts.append(f"<line x1='{at:.1f}' x2='{at:.1f}' y1='{up(r.low):.1f}' y2='{up(r.high):.1f}' stroke='#456'/>")
        parts.append(f"<rect x='{at - half:.1f}' y='{up(r.q3):.1f}' width='{2 * half:.1f}' height='{max(0.5, up(r.q1) - up(r.q3)):.1f}' fill='#cde' stroke='#456'/>")
        parts.append(f"<line x1='{at - half:.1f}' x2='{at + half:.1f}' y1='{up(r.median):.1f}' y2='{up(r.median):.1f}' stroke='#c33'/>")
    return svg(parts, title)


def bar_svg(rows: list, title: str) -> str:
    """Estimated beside true cardinality, by frequency level."""
    most = max((v for r in rows for v in (r.estimated_cardinality, r.true_cardinality) if v is not None and v == v), default=1.0)
    y, x = scaled(0.0, max(most, 1e-9), HEIGHT), scaled(0.5, max((r.frequency_level for r in rows), default=1) + 0.5, WIDTH)
    half = max(1.5, (x(1) - x(0.5)) * 0.8)
    parts = []
    for r in rows:
        for value, left, colour in ((r.estimated_cardinality, -half, "#68a"), (r.true_cardinality, 0.0, "#ccc")):
            tall = y(max(0.0, value)) - EDGE if value is not None and value == value else 0.0
            parts.append(f"<rect x='{x(r.frequency_level) + left:.1f}' y='{HEIGHT - EDGE - tall:.1f}' width='{half:.1f}' height='{tall:.1f}' fill='{colour}'/>")
    return svg(parts, title)


def grid(df: DataFrame, draw: Callable[[list, str], str], order: str) -> str:
    """A drawing for each method (a row) and scenario (a column). Plots are small: a row per set or level."""
    cells: dict[str, dict[str, list]] = {}
    for row in df.orderBy("sketch_estimator", "scenario", order).collect():
        cells.setdefault(row.sketch_estimator, {}).setdefault(row.scenario, []).append(row)
    columns = sorted({s for own in cells.values() for s in own})
    lines = ["".join(f"<td>{draw(own.get(s, []), f'{method} / {s}')}</td>" for s in columns) for method, own in cells.items()]
    return "<table class='plots'>" + "".join(f"<tr>{line}</tr>" for line in lines) + "</table>"


def table(df: DataFrame, order: list[str]) -> str:
    """A small result as an HTML table; summaries have a row per method and criterion."""
    rows = df.orderBy(*order).collect()
    cells = lambda values, tag: "<tr>" + "".join(f"<{tag}>{html.escape(str('' if v is None else v))}</{tag}>" for v in values) + "</tr>"
    return "<table>" + cells(df.columns, "th") + "".join(cells(r, "td") for r in rows) + "</table>"


def report(summary: DataFrame, times: DataFrame, boxes: DataFrame, path: str, metric: str = "relative_error_1", title: str = "Evaluation report", bars: DataFrame | None = None, boxplots: bool = True, barplots: bool = True) -> str:
    """Write the page: estimable sets, in all and by epsilons, running times, and the box plots by method and scenario.

    bars (of a frequency analysis) adds each level's cardinalities. The plots are drawn as SVG, which needs no plotting library.
    """
    parts = [f"<h1>{html.escape(title)}</h1>", "<h2>Estimable sets</h2>", table(pivoted(summary, metric), ["criteria", "sketch_estimator"]), "<h2>By privacy budget</h2>"]
    for name, own in by_epsilons(summary, metric).items():
        parts += [f"<h3>{html.escape(name)}</h3>", table(own, ["criteria", "sketch_estimator"])]
    parts += ["<h2>Running time (hours)</h2>", table(times, ["sketch_estimator"]), "<h2>Errors by number of sets</h2>"]
    if boxplots:
        parts.append(grid(boxes, box_svg, "num_sets"))
    for row in boxes.select("scenario").distinct().orderBy("scenario").collect():
        parts += [f"<h3>{html.escape(row.scenario)}</h3>", table(boxes.where(F.col("scenario") == row.scenario).drop("scenario"), ["sketch_estimator", "num_sets"])]
    if bars is not None:
        levels = frequency_rows(bars)
        parts += ["<h2>Cardinality by frequency</h2>", table(levels, ["scenario", "sketch_estimator", "frequency_level"])]
        if barplots:
            parts.append(grid(levels, bar_svg, "frequency_level"))
    page = "<!DOCTYPE html><html><head><meta charset='utf-8'><style>td,th{border:1px solid #999;padding:2px 6px}.plots td{border:0}</style></head><body>" + "".join(parts) + "</body></html>"
    Path(path).write_text(page, encoding="utf-8")
    return path
