"""Path mapping: common roots, the resolver cascade, diagnosis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from artefold.functions.text import basename


def common_root(paths: DataFrame) -> DataFrame:
    """One row ``root``: the longest directory all absolute paths share; '' where one is relative or none is there.

    The least and the greatest path bound all others, so two values decide.
    """
    ends = paths.filter("path is not null").agg(F.min("path").alias("a"), F.max("path").alias("b"), F.bool_and(F.col("path").startswith("/")).alias("abs"))
    pairs = F.arrays_zip(F.split("a", "/").alias("x"), F.split("b", "/").alias("y"))
    fold = F.aggregate(pairs, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda acc, z: F.struct((acc.n + (acc.go & (z.x == z.y)).cast("int")).alias("n"), (acc.go & F.coalesce(z.x == z.y, F.lit(False))).alias("go")))
    dirs = F.least(fold["n"], F.size(F.split("a", "/")) - 1)
    return ends.select(F.when(F.col("abs"), F.array_join(F.slice(F.split("a", "/"), 1, F.greatest(dirs, F.lit(1))), "/")).otherwise("").alias("root"))


def stripped(paths: DataFrame, prefixes: list[str]) -> DataFrame:
    """``path, stripped``: without the first prefix of the list that matches."""
    hit = F.coalesce(*[F.when(F.col("path").startswith(p), F.expr(f"substring(path, {len(p) + 1})")) for p in prefixes], F.col("path"))
    return paths.select("path", F.regexp_replace(hit, r"^(\./|/)+", "").alias("stripped"))


def resolved(observed: DataFrame, known: DataFrame, *, ignore: str | None = None, rules: dict[str, str] | None = None, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """``path, strategy, target`` for each distinct observed path.

    In this order: ignored, exact, rule (longest ``from`` first), prefix
    (longest first), suffix (the known file of the same name that shares most
    trailing segments, then the smallest path), unmapped.
    """
    o = observed.select("path").filter("path is not null").distinct()
    k = known.select(F.col("path").alias("target")).distinct()
    tries = [o.select("path", F.lit(1).alias("prio"), F.lit("exact").alias("strategy"), F.col("path").alias("want"))]
    for a in sorted(rules or {}, key=len, reverse=True):
        tries.append(o.filter(F.col("path").startswith(a)).select("path", F.lit(2).alias("prio"), F.lit("rule").alias("strategy"), F.concat(F.lit(rules[a]), F.expr(f"substring(path, {len(a) + 1})")).alias("want")))
    for p in sorted(prefixes, key=len, reverse=True):
        tries.append(o.filter(F.col("path").startswith(p)).select("path", F.lit(3).alias("prio"), F.lit("prefix").alias("strategy"), F.expr(f"substring(path, {len(p) + 1})").alias("want")))
    wanted = tries[0]
    for t in tries[1:]:
        wanted = wanted.unionByName(t)
    direct = wanted.join(k, F.col("want") == F.col("target")).select("path", "prio", "strategy", "target", F.lit(0).alias("score"))
    rest = o.join(direct.select("path").distinct(), "path", "left_anti")
    named = rest.withColumn("__b", basename(F.col("path"))).join(k.withColumn("__b", basename(F.col("target"))), "__b")
    same = F.aggregate(F.zip_with(F.reverse(F.split("path", "/")), F.reverse(F.split("target", "/")), lambda x, y: F.coalesce(x == y, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda acc, e: F.struct((acc.n + (acc.go & e).cast("int")).alias("n"), (acc.go & e).alias("go")))["n"]
    suffix = named.select("path", F.lit(4).alias("prio"), F.lit("suffix").alias("strategy"), "target", same.alias("score"))
    best = direct.unionByName(suffix).groupBy("path").agg(F.min(F.struct("prio", (-F.col("score")).alias("s"), "target", "strategy")).alias("b"))
    out = o.join(best, "path", "left").select("path", F.coalesce("b.strategy", F.lit("unmapped")).alias("strategy"), F.col("b.target").alias("target"))
    if ignore:
        skip = F.col("path").rlike(ignore)
        out = out.select("path", F.when(skip, "ignored").otherwise(F.col("strategy")).alias("strategy"), F.when(~skip, F.col("target")).alias("target"))
    return out


def diagnosis(mapped: DataFrame) -> DataFrame:
    """``strategy, n``: how many paths each strategy resolved."""
    return mapped.groupBy("strategy").agg(F.count("*").alias("n"))


def unmapped_prefixes(mapped: DataFrame, *, top: int = 10) -> DataFrame:
    """``prefix, n``: the first segments of unmapped paths, most frequent first."""
    g = mapped.filter("strategy = 'unmapped'").groupBy(F.substring_index("path", "/", 1).alias("prefix")).agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), "prefix").limit(top)


def by_content(observed: DataFrame, known: DataFrame) -> DataFrame:
    """``path, target`` where exactly one known file has the same content hash."""
    one = known.groupBy("hash").agg(F.min("path").alias("target"), F.count("*").alias("n")).filter("n = 1")
    return observed.join(one, "hash").select("path", "target")


def merkle(files: DataFrame) -> DataFrame:
    """``dir, root``: the hash of the sorted paths and hashes below each first directory."""
    g = files.groupBy(F.substring_index("path", "/", 1).alias("dir")).agg(F.array_sort(F.collect_set(F.concat("path", "hash"))).alias("h"))
    return g.select("dir", F.sha2(F.array_join("h", ""), 256).alias("root"))


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; paths that became equal by normalising collide so."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
