"""Test impact, timings and sharding.

Logical tables: testmap ``(test_id, path, line)``, diff files ``(path,
old_path)`` and lines ``(path, line)``, timings ``(test_id, duration_ms,
sample_count, last_seen)``, tasks ``(id, est_ms)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from artefold.session import written


def language(test_id: Column) -> Column:
    return F.when(test_id.contains("::") | test_id.contains(".py"), "python").otherwise("java")


def testmap(observed: DataFrame) -> DataFrame:
    """Distinct cells; the inverse index is the same table read by path."""
    return observed.filter("test_id is not null and path is not null").select("test_id", "path", "line").distinct()


def testmap_stats(cells: DataFrame) -> DataFrame:
    """One row: number of tests, files and non-empty (test, file) cells."""
    pairs = cells.select("test_id", "path").distinct()
    return pairs.agg(F.countDistinct("test_id").alias("tests"), F.countDistinct("path").alias("files"), F.count("*").alias("cells"))


def changed_paths(diff_files: DataFrame) -> DataFrame:
    """New and old paths of the changed files."""
    return diff_files.select(F.explode(F.array_compact(F.array("path", "old_path"))).alias("path")).distinct()


def impacted(cells: DataFrame, diff_files: DataFrame) -> DataFrame:
    """Tests that touch a changed path, by its new or old name."""
    return cells.join(changed_paths(diff_files), "path", "left_semi").select("test_id").distinct()


def missing(cells: DataFrame, diff_files: DataFrame) -> DataFrame:
    """Changed files of which the test map knows neither name."""
    known = cells.select(F.col("path").alias("__p")).distinct()
    by_new = diff_files.join(known, F.col("path") == F.col("__p"), "left_anti")
    return by_new.join(known, F.col("old_path") == F.col("__p"), "left_anti").select("path").distinct()


def confidence(cells: DataFrame, diff_files: DataFrame, *, stale: bool = False, escalate_over: float = 0.4) -> DataFrame:
    """One row: changed and mapped files, selected and all tests, confidence, whether to run all."""
    changed = diff_files.select("path").distinct().agg(F.count("*").alias("changed_files"))
    lost = missing(cells, diff_files).agg(F.count("*").alias("missing_files"))
    chosen = impacted(cells, diff_files).agg(F.count("*").alias("selected"))
    every = cells.agg(F.countDistinct("test_id").alias("tests"))
    row = changed.crossJoin(lost).crossJoin(chosen).crossJoin(every)  # four rows of one
    share = (F.col("changed_files") - F.col("missing_files")) / F.nullif(F.col("changed_files"), F.lit(0))
    return row.withColumn("confidence", F.round(F.coalesce(share, F.lit(1.0)) * (0.75 if stale else 1.0), 6)).withColumn("run_all", F.coalesce(F.col("selected") / F.nullif(F.col("tests"), F.lit(0)) > escalate_over, F.lit(False)))


def greedy_plan(cells: DataFrame, diff: DataFrame, *, max_tests: int = 25, target: float = 0.9) -> DataFrame:
    """``rank, test_id, gain, overlap``: tests by greedy cover of the changed lines.

    Each step takes the test with most lines not yet covered, then most
    changed lines at all, then the least id, until ``max_tests`` or the
    ``target`` share is reached.  A step is one aggregate and one anti-join on
    a written table; only the chosen row comes to the driver.
    """
    spark = cells.sparkSession
    hits = written(cells.join(diff.select("path", "line").distinct(), ["path", "line"], "left_semi").select("test_id", "path", "line"), "plan-hits")
    whole = hits.select("path", "line").distinct().count()
    overlap = written(hits.groupBy("test_id").agg(F.count("*").alias("overlap")), "plan-overlap")
    rows, done, rest = [], 0, hits
    while rest is not None and len(rows) < max_tests and whole and done < target * whole:
        best = rest.groupBy("test_id").agg(F.count("*").alias("gain")).join(overlap, "test_id").orderBy(F.desc("gain"), F.desc("overlap"), "test_id").limit(1).collect()
        if not best:
            break
        rows.append((len(rows) + 1, best[0].test_id, best[0].gain, best[0].overlap))
        done += best[0].gain
        covered = hits.filter(F.col("test_id") == F.lit(best[0].test_id)).select("path", "line")
        rest = written(rest.join(covered, ["path", "line"], "left_anti"), "plan-rest")
    return spark.createDataFrame(rows, f"rank int, test_id {dict(cells.dtypes)['test_id']}, gain bigint, overlap bigint")


def upsert_timings(known: DataFrame, observed: DataFrame) -> DataFrame:
    """Weighted running means with whole-number division; counts add up."""
    new = observed.filter("test_id is not null").groupBy("test_id").agg(F.expr("cast(sum(duration_ms) as bigint) div count(*)").alias("avg"), F.count("*").alias("n"), F.max("seen").alias("seen"))
    both = known.join(new, "test_id", "full_outer")
    return both.select(
        "test_id",
        F.expr("case when n is null then duration_ms when sample_count is null then avg else (duration_ms * sample_count + avg * n) div (sample_count + n) end").alias("duration_ms"),
        (F.coalesce("sample_count", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("bigint").alias("sample_count"),
        F.greatest("last_seen", "seen").alias("last_seen"),
    )


def whale_threshold(tasks: DataFrame) -> DataFrame:
    """One row: p95 by nearest rank and max(30 s, twice that); 30 s without tasks."""
    p = tasks.agg(F.expr("percentile_disc(0.95) within group (order by est_ms)").cast("bigint").alias("p95_ms"))
    return p.withColumn("threshold_ms", F.greatest(F.lit(30_000).cast("bigint"), F.coalesce(F.col("p95_ms") * 2, F.lit(0))))


def with_estimates(tests: DataFrame, timings: DataFrame, *, unknown_ms: int = 8000) -> DataFrame:
    """``id, est_ms``: known durations, a default for the rest."""
    return tests.join(timings.select("test_id", "duration_ms"), "test_id", "left").select(F.col("test_id").alias("id"), F.coalesce("duration_ms", F.lit(unknown_ms)).cast("bigint").alias("est_ms"))


def lpt_shards(tasks: DataFrame, shards: int) -> DataFrame:
    """``shard_id, id, est_ms``: longest task first to the least loaded shard, ties to the lower shard.

    The rule is sequential over one sorted list: one task sorts it, on disk
    where it must, and reads it batch by batch; it holds only the loads.
    """
    kind = dict(tasks.dtypes)["id"]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import heapq

        heap = [(0, k) for k in range(shards)]
        for pdf in batches:
            out = []
            for ms in pdf["est_ms"]:
                load, k = heapq.heappop(heap)
                out.append(k)
                heapq.heappush(heap, (load + int(ms), k))
            yield pdf.assign(shard_id=out)[["shard_id", "id", "est_ms"]]

    ranked = tasks.select("id", "est_ms").repartition(1).sortWithinPartitions(F.desc("est_ms"), "id")
    return ranked.mapInPandas(assign, f"shard_id int, id {kind}, est_ms bigint")


def shard_metrics(assigned: DataFrame, shards: int, *, whale_ms: int | None = None) -> DataFrame:
    """One row: makespan, total, imbalance over the median, efficiency, share of the ten longest tasks, number of whales (longer than ``whale_ms``)."""
    loads = assigned.groupBy("shard_id").agg(F.sum("est_ms").alias("load"))
    m = loads.agg(F.max("load").alias("makespan_ms"), F.sum("load").cast("bigint").alias("total_ms"), F.expr("percentile(load, 0.5)").alias("median"))
    top = assigned.orderBy(F.desc("est_ms")).limit(10).agg(F.sum("est_ms").alias("top"))
    whales = assigned.agg((F.count_if(F.col("est_ms") > whale_ms) if whale_ms is not None else F.lit(0)).cast("bigint").alias("whales"))
    m = m.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(whales))  # one row each
    return m.select(
        "makespan_ms", "total_ms", F.round(F.col("makespan_ms") / F.nullif(F.col("median"), F.lit(0.0)), 6).alias("imbalance"),
        F.round(F.col("total_ms") / F.nullif(F.col("makespan_ms") * shards, F.lit(0)), 6).alias("efficiency"),
        F.round(F.coalesce(F.col("top") / F.nullif(F.col("total_ms"), F.lit(0)), F.lit(0.0)), 6).alias("top_10_share"), "whales",
    )


def by_tags(tasks: DataFrame, *, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Tasks with any of the included and none of the excluded tags, whatever their case."""
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower)
    lit = lambda xs: F.array(*[F.lit(x.lower()) for x in xs])
    keep = F.lit(True)
    if include:
        keep = keep & F.arrays_overlap(tags, lit(include))
    if exclude:
        keep = keep & ~F.arrays_overlap(tags, lit(exclude))
    return tasks.filter(keep)
