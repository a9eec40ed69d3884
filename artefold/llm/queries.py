"""Queries of the problems of training data over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from artefold.llm import leak, mix, pack, pii
from artefold.session import table


def p4_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assembled context of each packet or piece of each request, and the space left in it.

    Packets are distinct by id, the first recorded counts.  A null or zero
    estimate is no estimate: tokens are then a quarter of the bytes, bytes
    four times the tokens, and those of the body where both are missing.
    """
    cost = F.col("budget_cost")
    given = lambda name: F.when(cost[name] > 0, cost[name])
    body = F.octet_length("body").cast("bigint")
    packets = table(spark, sf_dir, "packets").filter("packet_id is not null and task_id is not null").select(
        "packet_id", "task_id", F.struct("recorded_at", "record_id").alias("rank"),
        F.struct(
            F.coalesce(given("est_tokens"), F.floor(given("est_bytes") / 4), F.floor(body / 4), F.lit(0)).cast("bigint").alias("tokens"),
            F.coalesce(given("est_bytes"), given("est_tokens") * 4, body, F.lit(0)).cast("bigint").alias("bytes"),
        ).alias("size"),
    )
    distinct = packets.groupBy("task_id", "packet_id").agg(F.min_by("size", "rank").alias("size"))
    requests = table(spark, sf_dir, "assemble_requests").select("request_id", "task_id", "budget_tokens", "budget_bytes")
    items = distinct.join(requests, "task_id").select(F.col("request_id").alias("grp"), F.col("packet_id").alias("item"), "size.tokens", "size.bytes", "budget_tokens", "budget_bytes")
    return pack.pack(items).withColumnsRenamed({"grp": "request_id", "item": "packet_id", "bin": "context"})


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with every item it leaks."""
    return leak.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def _draws(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    counts = mix.prepared(table(spark, sf_dir, "documents"))
    wanted = mix.quotas(table(spark, sf_dir, "mix_targets"), counts)
    return mix.sharded(mix.offsets(counts), wanted), wanted


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents each mix draws, over all its shards, with their number of copies."""
    return mix.chosen(_draws(spark, sf_dir)[0])


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share each source was to reach and really reached."""
    draws, wanted = _draws(spark, sf_dir)
    return mix.shares(mix.chosen(draws), wanted)


def p7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draws of each mix in shuffled output shards."""
    return _draws(spark, sf_dir)[0]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mention of personal information with its type and place."""
    return pii.find(table(spark, sf_dir, "documents")).select("doc_id", "pii_type", "start_char")


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts with typed placeholders."""
    return pii.redact(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p4_contexts, p6_found, p7_mix, p7_shares, p7_shards, p8_found, p8_redacted)}
#: None of these can be put in SQL; tests/llm holds brute-force comparisons.
ORACLE: dict[str, str] = {}
