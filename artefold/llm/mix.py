"""Mixing sources to target weights.

Each source's documents stand in one random order, found without gathering a
source: a hash gives the order, and token offsets come from prefix sums of two
levels (inside hash buckets, then over buckets).  That order is cut into
blocks of about ``block_tokens``.  A quota in tokens is so many passes over
all blocks and a rest, for which a mix takes blocks in an order of its own, a
permutation by hash, up to the document that fills the quota.

A multivariate-hypergeometric splitting tree gives each output shard its exact
number of block draws of each source; a shard draws disjoint ranges of the
permuted block draws, and documents are shuffled within their shard.  A mix is
the union of its shards.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from artefold.session import written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern of that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS = 4096


def token_counts(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), tokenizer: str = TOKENIZER) -> DataFrame:
    """The id, the ``keep`` columns and ``n_tokens`` of the whole text; null texts have 0."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) if isinstance(t, str) else 0 for t in texts], dtype="int64")

    return documents.select(id_col, *keep, count(F.col(text_col)).alias("n_tokens"))


def source_name(col) -> "F.Column":
    """One spelling of a source: trimmed, lower case, ``_`` for hyphens and spaces; blank becomes null."""
    name = F.regexp_replace(F.lower(F.trim(col)), r"[\s-]+", "_")
    return F.when(name != "", name)


def offsets(counts: DataFrame, *, id_col: str = "doc_id", seed: int = 0) -> DataFrame:
    """Adds ``start``, the tokens before the document in its source's random order, and ``size``, those of the source.

    Documents without tokens or source are left out; exact repeats of a row
    are documents of their own.
    """
    rows = counts.filter("n_tokens > 0 and source is not null").withColumn("__order", F.xxhash64(F.lit(seed), id_col)).withColumn("__bucket", F.pmod("__order", F.lit(BUCKETS)))
    sums = rows.groupBy("source", "__bucket").agg(F.sum("n_tokens").alias("__held"))
    by_source = Window.partitionBy("source")
    sums = sums.select(
        "source", "__bucket",
        F.coalesce(F.sum("__held").over(by_source.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"),
        F.sum("__held").over(by_source).alias("size"),
    )
    inside = Window.partitionBy("source", "__bucket").orderBy("__order", id_col).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(sums, ["source", "__bucket"]).select(*counts.columns, (F.col("__base") + F.col("__in")).alias("start"), "size")


def quotas(targets: DataFrame, counts: DataFrame) -> DataFrame:
    """``mix_id, source, target_share, total_tokens, target_tokens, quota, max_repeats, size``.

    The shares are the weights over their sum in the mix; null and negative
    weights count as 0, repeated sources of a mix are added up and take the
    least cap.  ``total_tokens`` is ``total_ratio`` times the tokens of the
    whole corpus.  ``quota`` is what the cap allows of ``target_tokens``; what
    a source lacks is not given to others, so that none exceeds its target.
    """
    sizes = counts.groupBy("source").agg(F.sum("n_tokens").alias("size"))
    corpus = counts.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("corpus"))
    wanted = targets.select("mix_id", source_name(F.col("source")).alias("source"), F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"), "max_repeats", "total_ratio")
    wanted = wanted.filter("source is not null").groupBy("mix_id", "source").agg(F.sum("weight").alias("weight"), F.min("max_repeats").alias("max_repeats"), F.max("total_ratio").alias("total_ratio"))
    share = F.col("weight") / F.nullif(F.sum("weight").over(Window.partitionBy("mix_id")), F.lit(0.0))
    wanted = wanted.withColumn("target_share", F.coalesce(share, F.lit(0.0))).join(sizes, "source", "left").crossJoin(F.broadcast(corpus))  # one row
    total = F.round(F.max("total_ratio").over(Window.partitionBy("mix_id")) * F.col("corpus")).cast("bigint")
    wanted = wanted.withColumn("total_tokens", total).withColumn("target_tokens", F.round(F.col("target_share") * F.col("total_tokens")).cast("bigint"))
    size = F.coalesce("size", F.lit(0))
    most = F.when(F.col("max_repeats").isNull(), F.when(size > 0, F.col("target_tokens")).otherwise(0)).otherwise(size * F.greatest("max_repeats", F.lit(0)))
    return wanted.select("mix_id", "source", "target_share", "total_tokens", "target_tokens", F.least("target_tokens", most).cast("bigint").alias("quota"), "max_repeats", size.alias("size"))


def _running(rows: DataFrame, keys: list[str], order: str, value: str | None, name: str) -> DataFrame:
    """Adds ``name``, the sum of ``value`` (or the number) of the rows before in ``order``, a hash, by prefix sums of two levels."""
    amount = F.col(value) if value else F.lit(1)
    rows = rows.withColumn("__part", F.shiftright(order, 52))
    inside = Window.partitionBy(*keys, "__part").orderBy(order, "block", "pass").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "__part").agg(F.sum(amount).alias("__held")).select(*keys, "__part", F.coalesce(F.sum("__held").over(before), F.lit(0)).alias("__base"))
    rows = rows.withColumn("__in", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return rows.join(sums, [*keys, "__part"]).withColumn(name, F.col("__base") + F.col("__in")).drop("__part", "__in", "__base")


def block_draws(placed: DataFrame, wanted: DataFrame, *, block_tokens: int, seed: int) -> DataFrame:
    """``mix_id, source, block, pass, first, base, rest``: every block each mix draws in each pass.

    ``first`` is the offset of the block's first document.  In the last,
    incomplete pass ``base`` tokens of blocks come before in the mix's order,
    of the ``rest`` it wants; in full passes ``rest`` is null.
    """
    blocks = placed.groupBy("source", F.expr(f"start div {block_tokens}").alias("block")).agg(F.min("start").alias("first"), F.sum("n_tokens").alias("tokens"), F.max("size").alias("size"))
    rows = blocks.join(wanted.filter("quota > 0").select("mix_id", "source", "quota"), "source").withColumn("pass", F.expr("quota div size")).withColumn("order", F.xxhash64(F.lit(seed), "mix_id", "source", "block"))
    rows = written(_running(rows, ["mix_id", "source"], "order", "tokens", "base"), "mix-blocks")
    full = rows.filter("pass > 0").withColumn("pass", F.explode(F.expr("sequence(0L, pass - 1)"))).withColumn("rest", F.lit(None).cast("bigint"))
    last = rows.withColumn("rest", F.expr("quota % size")).filter("base < rest")
    return full.unionByName(last).select("mix_id", "source", "block", "pass", "first", "base", "rest")


def shares(drawn: DataFrame, wanted: DataFrame) -> DataFrame:
    """What each source of each mix was to reach and really reached."""
    got = drawn.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("actual_tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    rows = wanted.join(got, ["mix_id", "source"], "left").withColumn("actual_tokens", F.coalesce("actual_tokens", F.lit(0)))
    share = F.col("actual_tokens") / F.nullif(F.sum("actual_tokens").over(Window.partitionBy("mix_id")), F.lit(0))
    return rows.select(
        "mix_id", "source", F.round("target_share", 6).alias("target_share"), "target_tokens", "actual_tokens", F.round(F.coalesce(share, F.lit(0.0)), 6).alias("actual_share"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), (F.col("quota") < F.col("target_tokens")).alias("capped"),
    )


def split_tree(blocks: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source (columns) for each of ``shards`` outputs (rows), by recursive multivariate-hypergeometric splits.

    Column sums are ``blocks``; row sums differ by at most one.
    """
    if shards == 1:
        return blocks[None, :].copy()
    left = shards // 2
    take = int(blocks.sum()) * left // shards
    part = rng.multivariate_hypergeometric(blocks, take, method="marginals") if blocks.sum() else np.zeros_like(blocks)
    return np.concatenate([split_tree(part, left, rng), split_tree(blocks - part, shards - left, rng)])


def shard_ends(draws: DataFrame, *, shards: int, seed: int) -> DataFrame:
    """``mix_id, source, ends``: up to which draw of a source each shard takes, by the splitting tree of the mix.

    A mix is split in one task; it has one row for each of its sources.
    """

    def split(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source")
        rng = np.random.default_rng([seed, *str(key[0]).encode()])
        ends = np.cumsum(split_tree(pdf["n"].to_numpy(np.int64), shards, rng), axis=0)
        return pd.DataFrame({"mix_id": pdf["mix_id"].tolist(), "source": pdf["source"].tolist(), "ends": [ends[:, k].tolist() for k in range(len(pdf))]})

    counts = draws.groupBy("mix_id", "source").agg(F.count("*").alias("n"))
    return counts.groupBy("mix_id").applyInPandas(split, "mix_id string, source string, ends array<bigint>")


def sharded(placed: DataFrame, wanted: DataFrame, *, id_col: str = "doc_id", shards: int = 8, block_tokens: int = 4096, seed: int = 0) -> DataFrame:
    """``mix_id, shard, shuffle_key, id, source, n_tokens, pass``: the draws in output shards.

    Sort a shard by ``shuffle_key`` to read it shuffled.  A document is in the
    last, incomplete pass if at least half of it lies within the quota, so a
    source misses its quota by at most half a document.
    """
    draws = written(block_draws(placed, wanted, block_tokens=block_tokens, seed=seed), "mix-draws")
    ranked = _running(draws.withColumn("order", F.xxhash64(F.lit(seed + 1), "mix_id", "source", "block", "pass")), ["mix_id", "source"], "order", None, "spot")
    ranked = ranked.join(shard_ends(draws, shards=shards, seed=seed), ["mix_id", "source"]).withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("spot"))))
    slim = ranked.select("mix_id", "source", "block", "pass", "first", "base", "rest", "shard")
    rows = placed.withColumn("block", F.expr(f"start div {block_tokens}")).select(id_col, "source", "n_tokens", "start", "block").join(slim, ["source", "block"])
    rows = rows.filter("rest is null or (base + start - first) * 2 + n_tokens <= 2 * rest")
    return rows.select("mix_id", "shard", F.xxhash64(F.lit(seed + 2), id_col, "pass").alias("shuffle_key"), id_col, "source", "n_tokens", "pass")


def chosen(draws: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """``mix_id, id, source, n_tokens, copies``: every document the shards of a mix draw, and how often."""
    return draws.groupBy("mix_id", id_col, "source", "n_tokens").agg(F.count("*").alias("copies"))


def prepared(documents: DataFrame, *, tokenizer: str = TOKENIZER) -> DataFrame:
    """Token counts with one spelling of each source, written once for all readers."""
    return written(token_counts(documents.withColumn("source", source_name(F.col("source"))), keep=("source",), tokenizer=tokenizer), "mix-counts")
