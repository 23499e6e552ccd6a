"""Figures of benchmark runs, and the integrity rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_figures(runs: DataFrame, by: str, value: str, at: str) -> DataFrame:
    """runs: a value and a time in microseconds for each operation. throughput is operations by elapsed seconds, null for none."""
    v, elapsed = F.col(value), F.max(at) - F.min(at)
    figures = [F.count("*").alias("runs"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_samp(v), 4).alias("stddev"), F.min(v).alias("least"), F.max(v).alias("most")]
    throughput = F.when(elapsed > 0, F.round(F.count("*") * 1e6 / elapsed, 6))
    return runs.groupBy(by).agg(*figures, throughput.alias("throughput"), F.bool_and(v >= 0).alias("all_ok"))


def quantiles(runs: DataFrame, by: str, value: str) -> DataFrame:
    """Exact quantiles of pooled values."""
    return runs.groupBy(by).agg(*[F.round(F.percentile(value, q), 6).alias(n) for n, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))])


def integrity(pushed: DataFrame, live: DataFrame, ended: DataFrame, by: str) -> DataFrame:
    """Whether what was pushed equals what is found: ids of the log, of live tasks in a store, and of tasks that ended."""
    counts = [x.select(by, "id").distinct().groupBy(by).agg(F.count("*").alias(n)) for x, n in ((pushed, "pushed"), (live, "live"), (ended, "ended"))]
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = counts[0].join(counts[1], by, "full").join(counts[2], by, "full").select(by, *[zero(c) for c in ("pushed", "live", "ended")])
    return out.withColumn("ok", F.col("pushed") == F.col("live") + F.col("ended"))


def markdown(figures: DataFrame, order: list[str]) -> DataFrame:
    """at, line: a Markdown table of figures, a few rows, in the order of these columns; nulls are empty cells."""
    heads = [f"| {' | '.join(figures.columns)} |", f"|{'---|' * len(figures.columns)}"]
    top = figures.sparkSession.createDataFrame(list(enumerate(heads)), "at bigint, line string")
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in figures.columns]
    at = F.row_number().over(Window.orderBy(*order)) + len(heads) - 1
    return top.unionByName(figures.select(at.cast("bigint").alias("at"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line")))


def write_results(figures: DataFrame, order: list[str], path: str) -> None:
    """One CSV file with a head in `path`/csv and a Markdown table in `path`/markdown."""
    figures.orderBy(*order).coalesce(1).write.csv(f"{path}/csv", header=True)
    markdown(figures, order).orderBy("at").coalesce(1).select("line").write.text(f"{path}/markdown")
