"""Exactly-once admission of messages that were delivered at least once.

Identifiers are encoded exactly by a dictionary (identifier -> shard, code),
the codes already admitted are kept as bitmaps sharded by identifier hash, and
a batch admits one arrival for each code whose bit is unset.  A batch writes
new codes and bits to a folder of its own; both become visible together when
the commit file that names the folder is created, which fails if another
writer created it first.  What the loser wrote is read by nobody.

Skew: arrivals of one identifier are reduced to their first by a partial
aggregate before any shuffle, and rows are matched back by their unique
delivery id, so an identifier that holds a third of all rows is no hot key.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from artefold.functions.times import utc_seconds
from artefold.session import scratch_path

#: Codes per bitmap, fixed by Spark's bitmap functions.
BITMAP_BITS = 32768


def canonical_uuid(col: Column | str) -> Column:
    """The 32 lower-case hex digits of a UUID, however spelled; else null.

    White space around it, braces, a ``urn:uuid:`` head, hyphens and letter
    case do not matter.  Blank or otherwise malformed text gives null.
    """
    text = F.lower(F.regexp_replace(F.col(col) if isinstance(col, str) else col, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    digits = F.regexp_replace(F.regexp_replace(text, r"^\{?(?:urn:uuid:)?\{?|\}$", ""), "-", "")
    return F.when(digits.rlike("^[0-9a-f]{32}$"), digits)


def first_arrivals(batch: DataFrame, *, key: str = "event_id", row_id: str = "delivery_id", at: str = "delivered_at") -> DataFrame:
    """One row for each identifier: ``__key`` and the row id of its first arrival.

    First by ``at`` (nulls last), then by ``row_id``.  Rows whose identifier
    or row id is null take no part.
    """
    return (
        batch.select(canonical_uuid(key).alias("__key"), F.col(row_id).alias("__row"), F.col(at).alias("__at"))
        .filter("__key is not null and __row is not null")
        .groupBy("__key")
        .agg(F.min(F.struct(F.col("__at").isNull().alias("late"), F.col("__at").alias("at"), F.col("__row").alias("row"))).alias("first"))
        .select("__key", F.col("first.row").alias("__row"))
    )


def _bit_is_set(bitmap: str, bit: str) -> Column:
    return F.expr(f"coalesce(getbit(cast(conv(hex(substring({bitmap}, cast({bit} div 8 as int) + 1, 1)), 16, 10) as int), cast({bit} % 8 as int)) = 1, false)")


@dataclass
class SeenStore:
    """Dictionary and seen-bitmaps below ``path``; ``shards`` is fixed at its creation.

    ``shards`` bounds the work of one task when codes are given out: take it
    so that identifiers over shards stays near a million or less.  Every
    ``compact_every`` batches the parts of dictionary and bitmaps are merged.
    The file system must create a file exclusively (HDFS and local disks do).
    """

    spark: SparkSession
    path: str
    shards: int = 4096
    compact_every: int = 16

    def _fs(self):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(conf), lambda s: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{s}")

    def version(self) -> int:
        """The number of committed batches."""
        fs, at = self._fs()
        if not fs.exists(at("commits")):
            return 0
        return max((int(s.getPath().getName()) for s in fs.listStatus(at("commits")) if s.getPath().getName().isdigit()), default=0)

    def manifest(self, version: int) -> dict:
        """What a commit names: ``dictionary`` and ``bitmaps`` parts, ``arrivals`` and ``tag``; of version 0, nothing."""
        if not version:
            return {"dictionary": [], "bitmaps": [], "arrivals": None, "tag": None}
        fs, at = self._fs()
        stream = fs.open(at(f"commits/{version}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        if not text:
            raise RuntimeError(f"commit {version} of {self.path} is not complete; wait for its writer, or remove the file if that is gone")
        return json.loads(text)

    def _commit(self, version: int, manifest: dict) -> None:
        fs, at = self._fs()
        fs.mkdirs(at("commits"))
        try:
            stream = fs.create(at(f"commits/{version}"), False)
        except Exception as e:
            raise RuntimeError(f"batch {version} of {self.path} was committed by another writer") from e
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()

    def _read(self, schema: str, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def dictionary(self, version: int | None = None) -> DataFrame:
        """``__key, shard, code``: every identifier known so far."""
        return self._read("__key string, shard int, code bigint", self.manifest(self.version() if version is None else version)["dictionary"])

    def bitmaps(self, version: int | None = None) -> DataFrame:
        """``shard, bucket, bits``: the codes admitted so far."""
        parts = self._read("shard int, bucket bigint, bits binary", self.manifest(self.version() if version is None else version)["bitmaps"])
        return parts.groupBy("shard", "bucket").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))

    def tagged(self, tag: str) -> int | None:
        """The version of the batch committed under ``tag``, if it is among the last ones."""
        last = self.version()
        return next((v for v in range(last, max(0, last - self.compact_every), -1) if self.manifest(v)["tag"] == tag), None)

    def admit(self, batch: DataFrame, *, key: str = "event_id", row_id: str = "delivery_id", at: str = "delivered_at", tag: str | None = None) -> DataFrame:
        """Admit a batch; gives ``__key, __row``, the arrivals let through.

        The result reads the committed batch, so it may be used many times.
        A crash before the commit leaves the store as it was.  A batch whose
        ``tag`` was committed before gives what it gave then.
        """
        done = self.tagged(tag) if tag is not None else None
        if done is None:
            done = self._admit(batch, key, row_id, at, tag)
        arrivals = self.spark.read.parquet(f"{self.path}/{self.manifest(done)['arrivals']}")
        return arrivals.filter("not seen").select("__key", "__row")

    def _admit(self, batch: DataFrame, key: str, row_id: str, at: str, tag: str | None) -> int:
        old = self.version()
        before, own = self.manifest(old), f"batches/{uuid.uuid4().hex}"
        coded = first_arrivals(batch, key=key, row_id=row_id, at=at).join(self.dictionary(old), "__key", "left")
        # new identifiers are encoded behind the last code of their shard
        tops = self.dictionary(old).groupBy("shard").agg(F.max("code").alias("top"))
        fresh = coded.filter("code is null").withColumn("shard", F.pmod(F.xxhash64("__key"), F.lit(self.shards)).cast("int")).join(tops, "shard", "left")
        fresh = fresh.withColumn("code", F.row_number().over(Window.partitionBy("shard").orderBy("__key")) + F.coalesce("top", F.lit(0)))
        every = fresh.select("__key", "__row", "shard", "code", F.lit(True).alias("new")).unionByName(coded.filter("code is not null").withColumn("new", F.lit(False)))
        # an arrival is let through if the bit of its code is unset
        every = every.withColumn("bucket", F.expr("bitmap_bucket_number(code)")).join(self.bitmaps(old), ["shard", "bucket"], "left")
        every.select("__key", "__row", "shard", "code", "new", _bit_is_set("bits", "bitmap_bit_position(code)").alias("seen")).write.parquet(f"{self.path}/{own}/arrivals")
        arrivals = self.spark.read.parquet(f"{self.path}/{own}/arrivals")
        words = arrivals.filter("new").select("__key", "shard", "code")
        bits = arrivals.filter("not seen").groupBy("shard", F.expr("bitmap_bucket_number(code)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(code))").alias("bits"))
        whole = len(before["bitmaps"]) + 1 >= self.compact_every
        if whole:
            words = words.unionByName(self.dictionary(old))
            bits = bits.unionByName(self.bitmaps(old)).groupBy("shard", "bucket").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))
        words.write.parquet(f"{self.path}/{own}/dictionary")
        bits.write.option("compression", "zstd").parquet(f"{self.path}/{own}/bitmaps")
        parts = {k: ([] if whole else before[k]) + [f"{own}/{k}"] for k in ("dictionary", "bitmaps")}
        self._commit(old + 1, parts | {"arrivals": f"{own}/arrivals", "tag": tag})
        return old + 1


def admitted_rows(batch: DataFrame, store: SeenStore | None = None, *, key: str = "event_id", row_id: str = "delivery_id", at: str = "delivered_at", tag: str | None = None) -> DataFrame:
    """``batch`` without the later copies of each message.

    Rows with a blank, null or malformed identifier, or a null ``row_id``,
    match nothing and stay.  Rows of one ``row_id`` are one delivery and come
    out once.  All columns of the first arrival are kept as they were.
    """
    store = store or SeenStore(batch.sparkSession, scratch_path(batch.sparkSession, "seen"))
    admitted = store.admit(batch, key=key, row_id=row_id, at=at, tag=tag).select(F.col("__row").alias(row_id))
    matched = canonical_uuid(key).isNotNull() & F.col(row_id).isNotNull()
    kept = batch.filter(matched).join(admitted, row_id, "left_semi").dropDuplicates([row_id])
    return kept.unionByName(batch.filter(~matched)).select(*batch.columns)


def repeated_rows(batch: DataFrame, store: SeenStore | None = None, *, key: str = "event_id", row_id: str = "delivery_id", at: str = "delivered_at") -> DataFrame:
    """The ``row_id`` of every row of ``batch`` that the store did not admit."""
    store = store or SeenStore(batch.sparkSession, scratch_path(batch.sparkSession, "seen"))
    admitted = store.admit(batch, key=key, row_id=row_id, at=at).select(F.col("__row").alias(row_id))
    return batch.filter(canonical_uuid(key).isNotNull() & F.col(row_id).isNotNull()).select(row_id).join(admitted, row_id, "left_anti").distinct()


def batches_by_time(rows: DataFrame, parts: int, *, at: str = "delivered_at") -> list[DataFrame]:
    """``rows`` in ``parts`` batches in the order of ``at``, of equal spans of time; null times are in the last.

    Only the least and the greatest time reach the driver.
    """
    seconds = utc_seconds(rows, at)
    ends = rows.agg(F.min(seconds).alias("a"), F.max(seconds).alias("b")).first()
    if ends.a is None or parts < 2:
        return [rows]
    cuts = [ends.a + (ends.b - ends.a) * k // parts for k in range(1, parts)]
    number = sum(((seconds > c).cast("int") for c in cuts), F.lit(0))
    number = F.when(F.col(at).isNull(), parts - 1).otherwise(number)
    return [rows.filter(number == k) for k in range(parts)]
