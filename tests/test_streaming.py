"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from artefold.operators import state as S
from artefold.operators.exactly_once import SeenStore, admitted_rows, canonical_uuid
from artefold.streaming import events as E


def _stream(spark, small):
    return spark.readStream.schema(spark.read.parquet(f"{small}/agent_events.parquet").schema).option("pathGlobFilter", "agent_events.parquet").parquet(small)


def _run(df, name, mode, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_snapshot_equals_batch(spark, small, tmp_path):
    _run(E.snapshot_stream(_stream(spark, small)), "snap", "update", tmp_path)
    batch = spark.read.parquet(f"{small}/agent_events.parquet").selectExpr("task_id as task", "occurred_at_unix as at", "delivery_id as event_id", "kind")
    want = {(r.task, r.events, r.last_at, r.last_kind) for r in S.snapshot(batch).collect()}
    assert {tuple(r) for r in spark.table("snap").collect()} == want


def test_tumbling_counts_reach_the_batch_result(spark, small, tmp_path):
    _run(E.tumbling_stream(_stream(spark, small)), "tumbling", "complete", tmp_path)
    batch = spark.read.parquet(f"{small}/agent_events.parquet").withColumn("delivered_at", F.col("delivered_at").cast("timestamp"))
    want = {tuple(r) for r in S.tumbling(batch, "delivered_at", "6 hours").collect()}
    assert {tuple(r) for r in spark.table("tumbling").collect()} == want


def test_batches_are_admitted_once(spark, small, tmp_path):
    store = SeenStore(spark, f"file://{tmp_path}/seen", shards=16)
    q = _stream(spark, small).writeStream.foreachBatch(E.admit_batches(store, f"{tmp_path}/out")).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {r.delivery_id for r in admitted_rows(spark.read.parquet(f"{small}/agent_events.parquet")).collect()}
    assert {r.delivery_id for r in spark.read.parquet(f"{tmp_path}/out/batch=0").collect()} == want


def test_a_batch_lost_after_the_commit_comes_again(spark, small, tmp_path):
    store = SeenStore(spark, f"file://{tmp_path}/seen", shards=16)
    batch = spark.read.parquet(f"{small}/agent_events.parquet")
    want = store.admit(batch, tag="0").count()  # the sink was not written
    E.admit_batches(store, f"{tmp_path}/out")(batch, 0)
    out = spark.read.parquet(f"{tmp_path}/out/batch=0")
    assert store.version() == 1 and out.filter(canonical_uuid("event_id").isNotNull()).count() == want


def test_log_numbers_go_on_and_repeats_overwrite(spark, tmp_path):
    rows = lambda *xs: spark.createDataFrame(xs, "task_id string, kind string, occurred_at_unix long, data_json string")
    run = E.append_log(f"{tmp_path}/log")
    for batch_id, batch in ((0, rows(("t", "a", 1, None), ("u", "a", 1, None))), (1, rows(("t", "b", 0, "{}"), ("t", "c", 5, None))), (1, rows(("t", "b", 0, "{}"), ("t", "c", 5, None)))):
        run(batch, batch_id)
    got = spark.read.json(f"{tmp_path}/log").select("task_id", "seq", "kind").collect()
    assert sorted(tuple(r) for r in got) == [("t", 1, "a"), ("t", 2, "b"), ("t", 3, "c"), ("u", 1, "a")]


def test_event_files_are_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"task_id": "t", "kind": "a", "occurred_at_unix": 1}\n')
    q = E.event_source(spark, f"{tmp_path}/in", "task_id string, kind string, occurred_at_unix long").writeStream.format("memory").queryName("arrived").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("arrived").collect()] == [("t", "a", 1)]


def test_exactly_once_and_bursts(spark, small, tmp_path):
    _run(E.exactly_once_stream(_stream(spark, small)), "once", "append", tmp_path)
    batch = spark.read.parquet(f"{small}/agent_events.parquet")
    known = batch.select(canonical_uuid("event_id").alias("k")).filter("k is not null").distinct().count()
    assert spark.table("once").count() == known
    _run(E.debounce_stream(_stream(spark, small).filter("task_id is not null"), late="2 years"), "bursts", "append", tmp_path)
    assert spark.table("bursts").count() == 0  # nothing is final before the watermark passes
