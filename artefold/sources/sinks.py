"""Reports and stores written from result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def markdown_coverage(files: DataFrame) -> DataFrame:
    """``path, text``: one table row per file, percentages cut to one place, green from 80, yellow from 60."""
    mark = F.when(F.col("pct") >= 80, "green").when(F.col("pct") >= 60, "yellow").otherwise("red")
    return files.select("path", F.format_string("| %s | %d | %d | %.1f%% | %s |", "path", "covered", "instrumented", F.floor(F.coalesce("pct", F.lit(0.0)) * 10) / 10, mark).alias("text"))


def annotation(issue_severity: Column) -> Column:
    return F.when(issue_severity == "error", "error").when(issue_severity == "warning", "warning").otherwise("notice")


def github_annotations(issues: DataFrame) -> DataFrame:
    """``issue_id, text``: workflow commands; ``%``, line ends and separators are escaped."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "%", "%25"), "\r", "%0D"), "\n", "%0A")
    text = F.concat(F.lit("::"), annotation(F.col("severity")), F.lit(" file="), esc(F.col("path")), F.lit(",line="), F.col("line").cast("string"), F.lit("::"), esc(F.coalesce("message", F.lit(""))))
    return issues.select("issue_id", text.alias("text"))


def sarif_results(issues: DataFrame) -> DataFrame:
    """``issue_id, result``: one SARIF result object per issue."""
    level = F.col("severity")
    loc = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    row = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(loc).alias("locations"), F.struct(F.col("fingerprint").alias("primary")).alias("fingerprints"))
    return issues.select("issue_id", F.to_json(row).alias("result"))


def write_table(df: DataFrame, path: str, *, by: str | None = None, sort: str = "path") -> None:
    """Parquet sorted by ``sort`` inside its files, so that readers can skip by it; optionally partitioned."""
    rows = df.sortWithinPartitions(sort)
    writer = rows.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_artifacts(packets: DataFrame, path: str) -> None:
    """Packets as JSON lines, partitioned by the first byte of their handle."""
    packets.withColumn("shard", F.substring("handle", 1, 2)).write.mode("overwrite").partitionBy("shard").json(path)


CACHE_VERSION = 2  # fixed value: the layout of a stored cache


def save_cache(entries: DataFrame, path: str, *, ttl_secs: int, now: int) -> None:
    """Writes the entries ``(cache_key, created, ...)`` that are still alive, under the version of the layout; 0 keeps all."""
    live = entries if ttl_secs == 0 else entries.filter(F.lit(now) - F.col("created") <= ttl_secs)
    live.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/version={CACHE_VERSION}")


def load_cache(spark, path: str, *, ttl_secs: int, now: int) -> tuple[DataFrame | None, dict[str, int]]:
    """The live entries of a stored cache, and counters of what was left out.

    ``old_version`` and ``unreadable`` count stores, ``expired`` entries.  A
    store of another version, or a broken one, gives no entries and no error.
    """
    counters = {"old_version": 0, "unreadable": 0, "expired": 0}
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    versions = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    if f"version={CACHE_VERSION}" not in versions:
        counters["old_version"] = sum(v.startswith("version=") for v in versions)
        return None, counters
    try:
        rows = spark.read.parquet(f"{path}/version={CACHE_VERSION}")
        age = F.lit(now) - F.col("created")
        counters["expired"] = rows.filter(age > ttl_secs).count() if ttl_secs else 0
    except Exception:  # a broken store is started anew
        counters["unreadable"] = 1
        return None, counters
    return (rows.filter(age <= ttl_secs) if ttl_secs else rows), counters


def report_json(files: DataFrame) -> DataFrame:
    """``path, text``: one JSON object per file of a coverage report."""
    return files.select("path", F.to_json(F.struct("path", "covered", "instrumented", F.round("pct", 2).alias("pct"))).alias("text"))


def pr_comment(files: DataFrame, *, most: int = 20) -> DataFrame:
    """``ord, text``: the lines of a comment: total, then the ``most`` least covered files."""
    total = files.agg(F.sum("covered").alias("c"), F.sum("instrumented").alias("i"))
    head = total.select(F.lit(0).alias("ord"), F.format_string("**Coverage: %.1f%%**", F.coalesce(F.col("c") * 100.0 / F.nullif("i", F.lit(0)), F.lit(0.0))).alias("text"))
    rows = files.orderBy(F.coalesce("pct", F.lit(0.0)), "path").limit(most)
    body = rows.select(F.lit(1).alias("ord"), F.format_string("- `%s` %.1f%%", "path", F.coalesce("pct", F.lit(0.0))).alias("text"))
    return head.unionByName(body)
