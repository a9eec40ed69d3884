"""Filling containers of fixed capacity with items, never dividing an item that fits one.

Bulk-synchronous best fit.  Items and gaps of a group are sorted by size, and
one sweep over that order matches them like brackets: each gap takes the
largest item below it that no smaller gap took, so each item goes to the least
gap that is free.  Conflicts for a gap are thereby resolved by rank; gaps are
updated and the sweep is repeated until nothing is left.

Sizes have two dimensions, tokens and bytes.  An item counts by the larger of
its shares of the two budgets and a gap by the smaller of its free shares,
so what a sweep matches fits in both.

Larger groups are swept in distributed form: bracket depths are prefix sums of
two levels, partners meet by (group, depth).  Once at most ``local_items``
items of a group are left, the same sweeps go on within one task from the gaps reached.  Both take item by item in one order,
so the containers do not depend on where a sweep runs.  Items of size 0 go to
the first container.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from artefold.session import written

UNIT = 1 << 20  # size of a container in sweeps; items are rounded up, gaps down
SEGMENT = 10  # sizes that agree but for so many bits share a segment
ITEM_FIELDS = ["grp", "item", "piece", "tokens", "bytes", "size"]


def pieces(items: DataFrame) -> DataFrame:
    """``items`` (grp, item, tokens, bytes, budget_tokens, budget_bytes) with larger ones cut; adds ``piece, pieces, size``.

    Only an item that alone exceeds a budget is cut, into as few pieces as the
    budgets allow, all but the last as large as can be.  A null budget is no
    limit; a budget of 0 or less is read as null.
    """
    share = lambda v, b: F.when(F.col(b) > 0, F.col(v) / F.col(b)).otherwise(0.0)
    rows = items.withColumn("__s", F.greatest(share("tokens", "budget_tokens"), share("bytes", "budget_bytes")))
    rows = rows.withColumn("pieces", F.greatest(F.ceil("__s"), F.lit(1)).cast("int")).withColumn("piece", F.explode(F.expr("sequence(0, pieces - 1)")))
    cut = lambda v: F.expr(f"case when pieces = 1 then {v} when piece < pieces - 1 then least({v}, cast(floor({v} / __s) as bigint)) else {v} - (pieces - 1) * cast(floor({v} / __s) as bigint) end")
    rows = rows.withColumns({"tokens": cut("tokens"), "bytes": cut("bytes")})
    size = F.least(F.ceil(F.greatest(share("tokens", "budget_tokens"), share("bytes", "budget_bytes")) * UNIT), F.lit(UNIT)).cast("bigint")
    # a remainder can exceed the budget by rounding of the other pieces; it then gets a piece more
    over = F.greatest(share("tokens", "budget_tokens"), share("bytes", "budget_bytes")) > 1
    spill = F.when(over & (F.col("pieces") > 1), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("__over", F.size(spill) > 1).withColumn("__part", F.explode(spill))
    split = lambda v: F.expr(f"case when not __over then {v} when __part = 0 then {v} div 2 else {v} - {v} div 2 end")
    rows = rows.withColumns({"tokens": split("tokens"), "bytes": split("bytes")}).withColumn("piece", F.col("piece") + F.col("__part"))
    return rows.withColumn("size", size).drop("__s", "__over", "__part", "pieces")


def sweep(sizes: np.ndarray, gaps: np.ndarray) -> list[tuple[int, int]]:
    """(item, gap) pairs of one sweep over sorted ``sizes`` and ``gaps``, both ascending."""
    out, stack, i = [], [], 0
    for g, gap in enumerate(gaps):
        while i < len(sizes) and sizes[i] <= gap:
            stack.append(i)
            i += 1
        if stack:
            out.append((stack.pop(), g))
    return out


def pack_group(pdf: pd.DataFrame, gaps: np.ndarray | None = None) -> pd.DataFrame:
    """All sweeps of one group, from the ``gaps`` of its containers if it has any; ``bin`` is added. Bins are numbered from 0."""
    pdf = pdf.sort_values(["size", "item", "piece"], kind="stable").reset_index(drop=True)
    size = pdf["size"].to_numpy(np.int64)
    bins = np.full(len(pdf), -1, np.int64)
    left = np.arange(len(pdf))
    if gaps is None:
        gaps = np.full(max(1, -(-int(size.sum()) // UNIT)), UNIT, np.int64)
    while len(left):
        order = np.argsort(gaps, kind="stable")
        pairs = sweep(size[left], gaps[order])
        if not pairs:
            gaps = np.concatenate([gaps, np.full(max(1, -(-int(size[left].sum()) // UNIT)), UNIT, np.int64)])
            continue
        took = np.array(pairs)
        bins[left[took[:, 0]]] = order[took[:, 1]]
        gaps[order[took[:, 1]]] -= size[left[took[:, 0]]]
        left = np.delete(left, took[:, 0])
    return pdf.assign(bin=bins)


def _matched(items: DataFrame, bins: DataFrame) -> DataFrame:
    """(grp, item, piece, size, bin) of one distributed sweep over items (grp, item, piece, size) and bins (grp, bin, gap)."""
    none = lambda c: F.lit(None).cast(items.schema[c].dataType).alias(c)
    events = items.select("grp", F.col("size").alias("at"), F.lit(0).alias("kind"), "item", "piece", F.lit(None).cast("bigint").alias("bin")).unionByName(
        bins.filter("gap > 0").select("grp", F.col("gap").alias("at"), F.lit(1).alias("kind"), none("item"), none("piece"), "bin")
    )
    events = events.withColumn("seg", F.shiftright("at", SEGMENT)).withColumn("step", F.when(F.col("kind") == 0, 1).otherwise(-1))
    order = ["at", "kind", "item", "piece", "bin"]
    inside = Window.partitionBy("grp", "seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("grp").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    ends = events.groupBy("grp", "seg").agg(F.sum("step").alias("sum")).select("grp", "seg", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    events = events.withColumn("in", F.sum("step").over(inside)).join(ends, ["grp", "seg"])
    depth = F.col("base") + F.col("in") + F.when(F.col("kind") == 1, 1).otherwise(0)
    events = events.withColumn("depth", depth)
    level = Window.partitionBy("grp", "depth").orderBy(*order)
    pairs = events.withColumns({"next_kind": F.lead("kind").over(level), "next_bin": F.lead("bin").over(level)})
    return pairs.filter("kind = 0 and next_kind = 1").select("grp", "item", "piece", F.col("at").alias("size"), F.col("next_bin").alias("bin"))


def pack_distributed(items: DataFrame, *, local_items: int = 0) -> DataFrame:
    """``items`` with ``bin``, by distributed sweeps until each group has at most ``local_items`` left, then within its task."""
    spark = items.sparkSession
    key = ["grp", "item", "piece"]
    whole = written(items, "pack-items")
    left, done = whole.select(*key, "size"), []
    bins = written(_new_bins(left, spark.createDataFrame([], "grp bigint, top bigint")), "pack-bins")
    while not left.groupBy("grp").count().filter(F.col("count") > local_items).isEmpty():
        pairs = written(_matched(left, bins), "pack-pairs")
        done.append(pairs.select(*key, "bin"))
        took = pairs.groupBy("grp", "bin").agg(F.sum("size").alias("took"))
        bins = bins.join(took, ["grp", "bin"], "left").select("grp", "bin", (F.col("gap") - F.coalesce("took", F.lit(0))).alias("gap"))
        left = written(left.join(pairs, key, "left_anti"), "pack-left")
        # a group of which nothing found a gap needs new containers
        stuck = left.join(took.select("grp").distinct(), "grp", "left_anti")
        bins = written(bins.unionByName(_new_bins(stuck, bins.groupBy("grp").agg(F.max("bin").alias("top")))), "pack-bins")
    kind = {f.name: f.dataType.simpleString() for f in whole.schema}

    def rest(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        return pack_group(pdf, own.sort_values("bin")["gap"].to_numpy(np.int64, copy=True))[[*key, "bin"]] if len(pdf) else pdf.assign(bin=0)[[*key, "bin"]]

    placed = left.groupBy("grp").cogroup(bins.groupBy("grp")).applyInPandas(rest, ", ".join(f"{c} {kind[c]}" for c in key) + ", bin bigint")
    for more in done:
        placed = placed.unionByName(more)
    return whole.join(placed, key)


def _new_bins(items: DataFrame, tops: DataFrame) -> DataFrame:
    """Empty containers for the volume of ``items``, numbered after ``top``."""
    need = items.groupBy("grp").agg(F.greatest(F.ceil(F.sum("size") / UNIT), F.lit(1)).cast("bigint").alias("n")).join(tops, "grp", "left")
    first = F.coalesce(F.col("top") + 1, F.lit(0))
    return need.select("grp", F.explode(F.sequence(first, first + F.col("n") - 1)).alias("bin"), F.lit(UNIT).cast("bigint").alias("gap"))


def pack(items: DataFrame, *, local_items: int = 1_000) -> DataFrame:
    """Containers for (grp bigint, item, tokens, bytes, budget_tokens, budget_bytes), one row for each item or piece.

    Adds ``piece``, ``bin`` and the space left in the container,
    ``left_tokens`` and ``left_bytes`` (null where there is no such budget).
    Null sizes count as 0; items of size 0 still get a container.  Repeated
    items should be removed before: equal rows are items of their own only if
    ``item`` differs.
    """
    rows = items.withColumns({c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("bigint") for c in ("tokens", "bytes")})
    cut = written(pieces(rows).withColumn("size", F.greatest("size", F.lit(0))), "pack-pieces")
    counts = cut.filter("size > 0").groupBy("grp").agg(F.count("*").alias("n"))
    slim = cut.filter("size > 0").select(*ITEM_FIELDS)
    kind = {f.name: f.dataType.simpleString() for f in slim.schema}
    schema = ", ".join(f"{c} {kind[c]}" for c in ITEM_FIELDS) + ", bin bigint"
    spark = items.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)  # small rows, much work: not coalesced
    small = slim.join(counts.filter(F.col("n") <= local_items).select("grp"), "grp", "left_semi").repartition(tasks, "grp").groupBy("grp").applyInPandas(_pack_small, schema)
    big_groups = written(counts.filter(F.col("n") > local_items).select("grp"), "pack-big")
    placed = small.unionByName(cut.filter("size = 0").select(*ITEM_FIELDS, F.lit(0).cast("bigint").alias("bin")))
    if not big_groups.isEmpty():
        placed = placed.unionByName(pack_distributed(slim.join(big_groups, "grp", "left_semi"), local_items=local_items).select(*ITEM_FIELDS, "bin"))
    placed = written(placed, "pack-placed")
    used = placed.groupBy("grp", "bin").agg(F.sum("tokens").alias("used_tokens"), F.sum("bytes").alias("used_bytes"))
    budgets = cut.groupBy("grp").agg(F.max("budget_tokens").alias("budget_tokens"), F.max("budget_bytes").alias("budget_bytes"))
    used = used.join(budgets, "grp")
    left = lambda b, u: F.when(F.col(b) > 0, F.col(b) - F.col(u))
    return placed.join(used, ["grp", "bin"]).select("grp", "item", "piece", "tokens", "bytes", "bin", left("budget_tokens", "used_tokens").alias("left_tokens"), left("budget_bytes", "used_bytes").alias("left_bytes"))


def _pack_small(pdf: pd.DataFrame) -> pd.DataFrame:
    return pack_group(pdf)[[*ITEM_FIELDS, "bin"]]
