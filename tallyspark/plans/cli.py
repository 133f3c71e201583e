"""Command line: evaluate, analyze and report in one go."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from tallyspark.plans import analyze, evaluate, registry, report


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyspark", description=__doc__)
    p.add_argument("--evaluation", default="smoke_test", choices=sorted(registry.EVALUATIONS))
    p.add_argument("--methods", nargs="+", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--num-runs", type=int, default=registry.NUM_RUNS)
    p.add_argument("--universe-size", type=int)
    p.add_argument("--max-frequency", type=int, default=1)
    p.add_argument("--error-margin", type=float, nargs="+", default=[0.05])
    p.add_argument("--proportion-of-runs", type=float, nargs="+", default=[0.95])
    p.add_argument("--analysis-type", choices=sorted(analyze.METRICS), default="cardinality")
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--num-workers", type=int, default=4, help="methods that run at a time")
    p.add_argument("--analysis-out", help="folder of the analysis (default: --out)")
    p.add_argument("--report-out", help="folder of the report (default: --out)")
    p.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    for plot in ("boxplot", "barplot"):
        p.add_argument(f"--no-{plot}", action="store_true")
    for stage in ("evaluate", "analyze", "report"):
        p.add_argument(f"--no-{stage}", action="store_true")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if len(a.error_margin) != len(a.proportion_of_runs):
        raise ValueError("give as many error margins as proportions of runs")
    spark = SparkSession.builder.appName("tallyspark").getOrCreate()
    options = {"num_runs": a.num_runs} | ({"universe_size": a.universe_size} if a.universe_size else {})
    analysis, page = a.analysis_out or a.out, a.report_out or a.out
    if not a.no_evaluate:
        evaluate.evaluate(spark, registry.find_evaluation(a.evaluation, **options), registry.find_methods(a.methods, a.max_frequency), a.out, max_frequency=a.max_frequency, overwrite=a.overwrite, file_format=a.format, workers=a.num_workers)
    if not a.no_analyze:
        found = analyze.summary(spark, evaluate.read_results(spark, a.out, a.format), list(zip(a.error_margin, a.proportion_of_runs)), a.analysis_type)
        writer = found.write.mode("overwrite")
        writer.option("header", True).csv(f"{analysis}/summary") if a.format == "csv" else writer.parquet(f"{analysis}/summary")
    if not a.no_report:
        metric = analyze.METRICS[a.analysis_type]
        raw = evaluate.read_results(spark, a.out, a.format)
        summary = analyze.read_summary(spark, f"{analysis}/summary", metric) if a.format == "csv" else spark.read.parquet(f"{analysis}/summary")
        times = evaluate.running_times(spark.read.parquet(f"{a.out}/times"))
        bars = analyze.bar_plot(analyze.at_most_sets(analyze.per_frequency(analyze.long_frequencies(raw)))) if a.analysis_type == "frequency" else None
        Path(page).mkdir(parents=True, exist_ok=True)
        report.report(summary, times, analyze.box_plot(raw, metric), f"{page}/report.html", metric, bars=bars, boxplots=not a.no_boxplot, barplots=not a.no_barplot)


if __name__ == "__main__":
    main()
