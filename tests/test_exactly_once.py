"""Admission: spelling of ids, order of firsts, batches, restarts, edge cases."""

from datetime import datetime

from pyspark.sql import functions as F

from artefold.operators import exactly_once as X

A, B = "70828b8a-a9f6-445d-baa8-1e5e41d3f072", "00217e95-4d09-44b7-8b2b-9ba769efbcd7"
SCHEMA = "delivery_id long, event_id string, delivered_at timestamp, shard string, code string"


def rows(spark, *xs):
    return spark.createDataFrame([(i, e, at and datetime(2025, 1, at), "s", "c") for i, e, at in xs], SCHEMA)


def test_spellings_of_one_uuid(spark):
    spelt = [A, A.upper(), f" {A}\n", "{" + A + "}", "urn:uuid:" + A, A.replace("-", ""), "\t" + A.upper() + " ", "URN:UUID:" + A.upper()]
    df = spark.createDataFrame([(s,) for s in [*spelt, "", " ", None, "zz" + A[2:], A[:-1]]], "e string")
    got = [r[0] for r in df.select(X.canonical_uuid("e")).collect()]
    assert got == [A.replace("-", "")] * len(spelt) + [None] * 5


def test_first_by_time_then_id_and_what_matches_nothing(spark):
    df = rows(spark, (1, A, 3), (2, A.upper(), 2), (3, A, 2), (4, None, 1), (5, " ", 1), (6, "", 1), (7, B, None), (8, B, 9), (9, "bad", 1), (10, "bad", 2))
    assert {r[0] for r in X.repeated_rows(df).collect()} == {1, 3, 7}
    assert {r.delivery_id for r in X.admitted_rows(df).collect()} == {2, 4, 5, 6, 8, 9, 10}


def test_batches_against_a_store(spark, tmp_path):
    store = X.SeenStore(spark, f"file://{tmp_path}/seen", shards=3)
    assert {r[0] for r in X.repeated_rows(rows(spark, (1, A, 1), (2, A, 2)), store).collect()} == {2}
    assert {r[0] for r in X.repeated_rows(rows(spark, (3, "{" + A + "}", 1), (4, B, 2), (5, B, 1)), store).collect()} == {3, 4}
    again = X.SeenStore(spark, store.path, shards=3)
    assert again.version() == 2 and X.admitted_rows(rows(spark, (6, B, 1)), again).collect() == []
    codes = again.dictionary().collect()
    assert len(codes) == 2 == len({(r.shard, r.code) for r in codes})
    assert again.bitmaps().agg(F.sum(F.expr("bitmap_count(bits)"))).collect()[0][0] == 2


def test_a_batch_that_did_not_commit_leaves_no_trace(spark, tmp_path):
    store = X.SeenStore(spark, f"file://{tmp_path}/seen")
    store._commit = lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    try:
        store.admit(rows(spark, (1, A, 1)))
    except RuntimeError:
        pass
    store = X.SeenStore(spark, store.path)
    assert store.version() == 0 and [r[0] for r in X.admitted_rows(rows(spark, (1, A, 1)), store).select("delivery_id").collect()] == [1]


def test_repeated_rows_hot_key_and_empty_table(spark):
    hot = spark.range(1, 3001).select(F.col("id").alias("delivery_id"), F.lit(A).alias("event_id"), F.timestamp_seconds(F.lit(0)).alias("delivered_at"), F.lit("s").alias("shard"), F.lit("c").alias("code"))
    both = hot.unionByName(hot)
    assert X.repeated_rows(both).count() == 2999 and X.admitted_rows(both).count() == 1
    assert X.repeated_rows(hot.limit(0)).collect() == [] and X.admitted_rows(hot.limit(0)).collect() == []


def test_of_two_writers_one_commits(spark, tmp_path):
    one, two = (X.SeenStore(spark, f"file://{tmp_path}/seen", shards=3) for _ in range(2))
    commit, failed = one._commit, []

    def late(*args):
        two.admit(rows(spark, (1, A, 1)))  # another writer commits the same version first
        commit(*args)

    one._commit = late
    try:
        one.admit(rows(spark, (2, B, 1)))
    except RuntimeError:
        failed.append(True)
    assert failed and one.version() == 1
    assert [r["__key"] for r in two.dictionary().collect()] == [A.replace("-", "")]
    del one._commit
    assert [r["__row"] for r in one.admit(rows(spark, (2, B, 1), (3, A, 1))).collect()] == [2]


def test_a_repeated_tag_gives_the_same_arrivals(spark, tmp_path):
    store = X.SeenStore(spark, f"file://{tmp_path}/seen")
    batch = rows(spark, (1, A, 1), (2, A, 2))
    for _ in range(2):
        assert [r["__row"] for r in store.admit(batch, tag="7").collect()] == [1]
    assert store.version() == 1 and store.admit(batch, tag="8").collect() == []


def test_parts_are_merged(spark, tmp_path):
    store = X.SeenStore(spark, f"file://{tmp_path}/seen", shards=2, compact_every=3)
    ids = [f"{k:08x}-0000-0000-0000-000000000000" for k in range(4)]
    for k, i in enumerate(ids):
        assert store.admit(rows(spark, (k, i, 1), (9, ids[0], 2))).count() == 1
    last = store.manifest(4)
    assert len(last["bitmaps"]) == 2 and store.dictionary().count() == 4
    assert store.bitmaps().agg(F.sum(F.expr("bitmap_count(bits)"))).collect()[0][0] == 4


def test_batches_by_time(spark):
    df = rows(spark, (1, A, 1), (2, A, 9), (3, B, None), (4, B, 5))
    assert [sorted(r[0] for r in b.select("delivery_id").collect()) for b in X.batches_by_time(df, 2)] == [[1, 4], [2, 3]]
    assert len(X.batches_by_time(df.limit(0), 2)) == 1
