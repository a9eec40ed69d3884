"""Line coverage: merging, percentages, gates, ranges.

Logical tables: coverage ``(path, line, covered)``, diff ``(path, line)`` and
``(path, old_path, status)``.  All operators are partial aggregates and
equi-joins on ``path`` or ``(path, line)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(coverage: DataFrame) -> DataFrame:
    """One row per instrumented line; covered if any report covers it."""
    return coverage.filter("path is not null and line is not null").groupBy("path", "line").agg(F.max(F.coalesce("covered", F.lit(False))).alias("covered"))


def merge_counts(branches: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Branch or function hit counts of several reports, summed."""
    return branches.groupBy(*keys).agg(F.sum(value).cast("bigint").alias(value))


def percent(part: Column, whole: Column) -> Column:
    """100 part / whole to six places; null without a whole."""
    return F.round(100.0 * part / F.nullif(whole, F.lit(0)), 6)


def by_file(merged: DataFrame) -> DataFrame:
    """``path, instrumented, covered, pct``."""
    g = merged.groupBy("path").agg(F.count("*").alias("instrumented"), F.count_if("covered").alias("covered"))
    return g.withColumn("pct", percent(F.col("covered"), F.col("instrumented")))


def total(merged: DataFrame) -> DataFrame:
    """One row: the ratio of sums over all files."""
    g = merged.agg(F.count("*").alias("instrumented"), F.count_if("covered").alias("covered"))
    return g.withColumn("pct", percent(F.col("covered"), F.col("instrumented")))


def below(files: DataFrame, threshold: float) -> DataFrame:
    """Files below a threshold; no percentage counts as 0."""
    return files.filter(F.coalesce("pct", F.lit(0.0)) < threshold)


def line_ranges(lines: DataFrame) -> DataFrame:
    """Gaps and islands: ``path, first_line, last_line`` of runs of consecutive lines."""
    island = F.col("line") - F.row_number().over(Window.partitionBy("path").orderBy("line"))
    runs = lines.select("path", "line").distinct().withColumn("__island", island)
    return runs.groupBy("path", "__island").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line")).drop("__island")


def missing_ranges(merged: DataFrame) -> DataFrame:
    """The uncovered lines of each file as ranges."""
    return line_ranges(merged.filter("not covered"))


def range_text(ranges: DataFrame) -> DataFrame:
    """``path, ranges``: ``1-3, 7, 10-15``, ordered; one string per file."""
    text = F.when(F.col("first_line") == F.col("last_line"), F.col("first_line").cast("string")).otherwise(F.concat_ws("-", "first_line", "last_line"))
    g = ranges.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("first_line", text.alias("t")))).alias("r"))
    return g.select("path", F.concat_ws(", ", F.expr("transform(r, x -> x.t)")).alias("ranges"))


def changed(merged: DataFrame, diff: DataFrame) -> DataFrame:
    """Changed lines that count: ``path, line, covered``.

    In a file the coverage knows, only instrumented lines count.  In a file it
    does not know, all changed lines count as uncovered.
    """
    known = merged.select("path").distinct().withColumn("known", F.lit(True))
    d = diff.select("path", "line").distinct().join(known, "path", "left").join(merged, ["path", "line"], "left")
    return d.filter("known is null or covered is not null").select("path", "line", F.coalesce("covered", F.lit(False)).alias("covered"))


def gate(merged: DataFrame, diff: DataFrame, added_files: DataFrame, *, least_total: float | None = None, least_changed: float | None = None, least_new: float | None = None) -> DataFrame:
    """One row: the three percentages, ``passed`` and the sorted ``violations``.

    A percentage without lines is null and never violates a threshold.
    """
    t = total(merged).select(F.col("pct").alias("total_pct"))
    c = changed(merged, diff).agg(percent(F.count_if("covered"), F.count("*")).alias("changed_pct"))
    n = merged.join(added_files.select("path").distinct(), "path", "left_semi").agg(percent(F.count_if("covered"), F.count("*")).alias("new_pct"))
    rows = t.crossJoin(c).crossJoin(n)  # three rows of one
    limits = {"total_pct": least_total, "changed_pct": least_changed, "new_pct": least_new}
    found = F.array_compact(F.array(*[F.when(F.col(k) < v, F.lit(k)) for k, v in limits.items() if v is not None], F.lit(None).cast("string")))
    return rows.withColumn("violations", F.array_join(F.array_sort(found), ",")).withColumn("passed", F.col("violations") == "")
