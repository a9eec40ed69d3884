"""Diagnostics: normalising, removing repeats, histograms, gates.

Logical table: ``issues(path, line, severity, rule_id, message, source, fingerprint)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from artefold.functions.text import ascii_lower


def severity(col: Column) -> Column:
    """error, warning or note; words that are neither of the first two are notes."""
    low = ascii_lower(F.trim(col))
    return F.when(low.isin("error", "err", "fatal", "critical", "severe"), "error").when(low.isin("warning", "warn"), "warning").otherwise("note")


def severity_rank(col: Column) -> Column:
    return F.when(col == "error", 3).when(col == "warning", 2).otherwise(1)


def path(col: Column) -> Column:
    """A path without scheme, drive, ``./`` and backslashes."""
    p = F.regexp_replace(F.trim(col), r"\\", "/")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(p, "^file://(localhost)?", ""), "^/?[A-Za-z]:/", ""), r"^(\./)+", "")


def normalised(issues: DataFrame) -> DataFrame:
    """Paths and severities in one spelling; line 0 and null paths are dropped; a missing fingerprint is derived."""
    own = F.substring(F.sha2(F.concat_ws(":", "path", F.col("line").cast("string"), "severity", F.coalesce("rule_id", F.lit("unknown")), F.coalesce("message", F.lit(""))), 256), 1, 16)
    rows = issues.filter("path is not null and line > 0").withColumns({"path": path(F.col("path")), "severity": severity(F.col("severity"))})
    return rows.withColumn("fingerprint", F.coalesce("fingerprint", own))


def keep_first(issues: DataFrame, *, order: str = "issue_id") -> DataFrame:
    """The first issue of each (path, fingerprint).

    Firsts are found by a partial aggregate and matched on ``order``, which
    must be unique, so a fingerprint repeated very often is no hot key.
    """
    firsts = issues.groupBy("path", "fingerprint").agg(F.min(order).alias(order)).select(order)
    return issues.join(firsts, order, "left_semi")


def histogram(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity").agg(F.count("*").alias("n"))


def on_changed_lines(issues: DataFrame, diff: DataFrame) -> DataFrame:
    """Issues on changed lines; several issues of a line all stay."""
    return issues.join(diff.select("path", "line").distinct(), ["path", "line"], "left_semi")


def gate(issues: DataFrame, *, most_errors: int | None = None, most_warnings: int | None = None, most_issues: int | None = None) -> DataFrame:
    """One row: counts by severity, ``passed``, ``violations``."""
    g = issues.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count("*").alias("total"))
    limits = {"errors": most_errors, "warnings": most_warnings, "total": most_issues}
    found = F.array_compact(F.array(*[F.when(F.col(k) > v, F.lit(k)) for k, v in limits.items() if v is not None], F.lit(None).cast("string")))
    return g.withColumn("violations", F.array_join(F.array_sort(found), ",")).withColumn("passed", F.col("violations") == "")


def worst_first(issues: DataFrame, n: int) -> DataFrame:
    """The report's first ``n`` issues: by path, line, notes before errors on one line."""
    return issues.orderBy("path", "line", severity_rank(F.col("severity")), "issue_id").limit(n)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return rows.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
