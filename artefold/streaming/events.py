"""The state operators over unbounded input.

``snapshot_stream`` keeps a fold per task, ``exactly_once_stream`` and
``admit_batches`` admit each event once, ``debounce_stream`` finds bursts by
session windows, ``append_log`` numbers events per task in an append-only log.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from artefold.operators.exactly_once import SeenStore, admitted_rows, canonical_uuid


def _timed(events: DataFrame, at: str) -> DataFrame:
    """Times without zone are read in the session's zone, as watermarks need."""
    return events.withColumn(at, F.col(at).cast("timestamp"))


def exactly_once_stream(events: DataFrame, *, late: str = "30 days", at: str = "delivered_at", key: str = "event_id") -> DataFrame:
    """The first arrival of each identifier by order of arrival; state is dropped once the watermark has passed it.

    Unlike in batch, rows without a usable identifier are left out.
    """
    return _timed(events, at).withColumn("__key", canonical_uuid(key)).filter("__key is not null").withWatermark(at, late).dropDuplicatesWithinWatermark(["__key"]).drop("__key")


def admit_batches(store: SeenStore, sink: str):
    """A ``foreachBatch`` function: admits a micro-batch against the store and writes what it lets through to a folder of the batch.

    The store commits first, under the id of the batch.  If the writer is lost
    between the two, the repeated batch gets the arrivals of that commit again
    and overwrites the folder, so none is lost and none comes twice.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        admitted_rows(batch, store, tag=str(batch_id)).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return run


def event_source(spark, folder: str, schema: str, *, files_at_once: int = 100):
    """A stream of event files (JSON lines) that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(folder)


def append_log(log: str):
    """A ``foreachBatch`` function: appends events ``(task_id, kind, occurred_at_unix, data_json)`` to a log of JSON lines with ``seq``, from 1 without gaps in each task.

    Numbers go on from those in the log.  A batch that is repeated after a
    failure overwrites its own part, so no event is logged twice.
    """
    schema = "seq bigint, task_id string, kind string, occurred_at_unix bigint, data_json string"

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(log)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        parts = [str(s.getPath()) for s in (fs.listStatus(at) if fs.exists(at) else []) if s.getPath().getName() != f"batch={batch_id}"]
        old = spark.read.schema(schema).json(parts) if parts else spark.createDataFrame([], schema)
        tops = old.groupBy("task_id").agg(F.max("seq").alias("top"))
        w = Window.partitionBy("task_id").orderBy("occurred_at_unix", "kind", "data_json")
        rows = batch.filter("task_id is not null").withColumn("n", F.row_number().over(w)).join(tops, "task_id", "left")
        rows.select((F.col("n") + F.coalesce("top", F.lit(0))).alias("seq"), "task_id", "kind", "occurred_at_unix", "data_json").write.mode("overwrite").json(f"{log}/batch={batch_id}")

    return run


def tumbling_stream(events: DataFrame, *, width: str = "6 hours", late: str = "1 day", at: str = "delivered_at") -> DataFrame:
    w = _timed(events, at).withWatermark(at, late).groupBy(F.window(at, width).alias("w"), "kind").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "kind", "n")


def debounce_stream(events: DataFrame, *, gap: str = "10 minutes", late: str = "1 day", at: str = "delivered_at") -> DataFrame:
    w = _timed(events, at).withWatermark(at, late).groupBy("task_id", F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return w.select("task_id", F.col("w.start").alias("first_at"), "n")


SNAPSHOT = "task_id string, events bigint, last_at bigint, last_kind string"


def snapshot_stream(events: DataFrame) -> DataFrame:
    """``task_id, events, last_at, last_kind`` after each micro-batch, from a state of one row per task."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, at, event, kind = state.get if state.exists else (0, -1, -1, "")
        for f in frames:
            n += len(f)
            top = f.sort_values(["occurred_at_unix", "delivery_id"]).iloc[-1]
            if (top["occurred_at_unix"], top["delivery_id"]) > (at, event):
                at, event, kind = int(top["occurred_at_unix"]), int(top["delivery_id"]), top["kind"]
        state.update((n, at, event, kind))
        yield pd.DataFrame([(key[0], n, at, kind)], columns=["task_id", "events", "last_at", "last_kind"])

    slim = events.filter("task_id is not null").select("task_id", "occurred_at_unix", "delivery_id", "kind")
    return slim.groupBy("task_id").applyInPandasWithState(fold, SNAPSHOT, "n bigint, at bigint, event bigint, kind string", "update", GroupStateTimeout.NoTimeout)
