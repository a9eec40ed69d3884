"""Correlation, assembly within budgets, policy checks and packet bookkeeping.

References are ``(packet, kind, ref)``.  Packets that share a reference form
the class of that reference; classes and memberships are returned instead of
all pairs, from which every pair follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from artefold.functions.text import ascii_lower, basename

#: Confidence of a finding by its rule.
CONFIDENCE = {"shared_file": 0.74, "shared_symbol": 0.70, "shared_test": 0.68, "map_edge_connects": 0.76, "task_focus_overlap": 0.73, "diff_vs_build": 0.84, "diff_vs_impact": 0.78}


def shared_classes(refs: DataFrame, kind: str) -> DataFrame:
    """``rule, ref, packets, first_packet``: each reference of ``kind`` that at least two packets hold."""
    g = refs.filter(F.col("kind") == kind).select("packet", "ref").distinct().groupBy("ref").agg(F.count("*").alias("packets"), F.min("packet").alias("first_packet"))
    return g.filter("packets > 1").select(F.lit(f"shared_{kind}").alias("rule"), "ref", "packets", "first_packet")


def shared_members(refs: DataFrame, kind: str) -> DataFrame:
    """``packet, ref, links``: the classes a packet is in and how many others it meets there."""
    g = refs.filter(F.col("kind") == kind).select("packet", "ref").distinct()
    return g.join(shared_classes(refs, kind), "ref").select("packet", "ref", (F.col("packets") - 1).alias("links"))


def edge_links(edges: DataFrame, refs: DataFrame) -> DataFrame:
    """``from_path, to_path, left_packets, right_packets``: map edges whose two ends are held by packets, whichever way."""
    held = refs.filter("kind = 'file'").select("packet", "ref").distinct().groupBy("ref").agg(F.count("*").alias("n"))
    return edges.join(held.select(F.col("ref").alias("from_path"), F.col("n").alias("left_packets")), "from_path").join(held.select(F.col("ref").alias("to_path"), F.col("n").alias("right_packets")), "to_path").select("from_path", "to_path", "left_packets", "right_packets")


def untouched(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Files diagnosed but not changed."""
    return files.select("path").distinct().join(changed.select("path").distinct(), "path", "left_anti")


def focus_overlap(refs: DataFrame, focus: DataFrame) -> DataFrame:
    """``packet, matched, confidence``: packets that hold a focus path (0.73), or only its name where that name is unique among the focus paths (0.61)."""
    f = focus.select("path").distinct().withColumn("name", basename(F.col("path")))
    unique = f.groupBy("name").agg(F.count("*").alias("n"), F.min("path").alias("path")).filter("n = 1").select("name", F.col("path").alias("p2"))
    held = refs.filter("kind = 'file'").select("packet", "ref").distinct()
    exact = held.join(f, held.ref == f.path).select("packet", "path", F.lit(0.73).alias("c"))
    named = held.withColumn("name", basename(F.col("ref"))).join(unique, "name").filter("ref <> p2").select("packet", F.col("p2").alias("path"), F.lit(0.61).alias("c"))
    return exact.unionByName(named).groupBy("packet").agg(F.countDistinct("path").alias("matched"), F.max("c").alias("confidence"))


def distinct_bodies(packets: DataFrame, body: str, order: str) -> DataFrame:
    """Packets without later copies of the same body."""
    h = packets.withColumn("__h", F.sha2(F.col(body), 256))
    firsts = h.groupBy("__h").agg(F.min(order).alias(order)).select(order)
    return packets.join(firsts, order, "left_semi")


def section_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """``id, status``: added, changed, removed or unchanged sections of ``(id, body)``."""
    b, a = before.select("id", F.col("body").alias("b"), F.lit(True).alias("was")), after.select("id", F.col("body").alias("a"), F.lit(True).alias("now"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("a").eqNullSafe(F.col("b")), "unchanged").otherwise("changed")
    return b.join(a, "id", "full_outer").select("id", status.alias("status"))


def working_set(ranked: DataFrame, *, evict: int = 8) -> DataFrame:
    """``grp, rank, id, role``: of candidates ``(grp, rank, id, kept)`` the kept ones work; eviction candidates are the ``evict`` that follow as many positions as were kept."""
    n = F.sum(F.col("kept").cast("int")).over(Window.partitionBy("grp"))
    role = F.when(F.col("kept"), "working").when((F.col("rank") > n) & (F.col("rank") <= n + evict), "evict").otherwise("none")
    return ranked.withColumn("role", role).select("grp", "rank", "id", "role")


def not_allowed(items: DataFrame, allowed: DataFrame, col: str) -> DataFrame:
    """Values of ``col`` that the allow-list does not name, whatever the case, with their number."""
    ok = allowed.select(ascii_lower(F.col(col)).alias("__a")).distinct()
    rows = items.withColumn("__a", ascii_lower(F.col(col))).join(ok, "__a", "left_anti")
    return rows.groupBy(col).agg(F.count("*").alias("n"))


def glob_regex(glob: str) -> str:
    """``**`` crosses directories, ``*`` and ``?`` do not."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in r".+()[]{}^$|\\" else c
            i += 1
    return f"^{out}$"


def glob_audit(paths: DataFrame, allow: list[str], deny: list[str]) -> DataFrame:
    """``path, finding``: paths a deny glob matches, else those no allow glob matches."""
    any_of = lambda globs: F.coalesce(F.col("path").rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)), F.lit(False)) if globs else F.lit(False)
    return paths.withColumn("finding", F.when(any_of(deny), "denied").when(~any_of(allow), "not_allowed")).filter("finding is not null").select("path", "finding")


def pattern_findings(texts: DataFrame, id_col: str, text_col: str, patterns: dict[str, str]) -> DataFrame:
    """``id, rule, n``: how often each pattern stands in each text, in one pass over the texts."""
    hits = F.array(*[F.struct(F.lit(r).alias("rule"), F.size(F.regexp_extract_all(F.col(text_col), F.lit(p), F.lit(0))).alias("n")) for r, p in patterns.items()])
    return texts.select(F.col(id_col).alias("id"), F.explode(hits).alias("h")).select("id", "h.rule", "h.n").filter("n > 0")


def over_caps(packets: DataFrame, caps: dict[str, int]) -> DataFrame:
    """``grp, measure, used, cap`` for each sum that exceeds its cap."""
    g = packets.groupBy("grp").agg(*[F.sum(F.coalesce(c, F.lit(0))).cast("bigint").alias(c) for c in caps])
    rows = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("used"), F.lit(v).cast("bigint").alias("cap")) for c, v in caps.items()])
    return g.select("grp", F.explode(rows).alias("r")).select("grp", "r.measure", "r.used", "r.cap").filter("used > cap")


def usage(packets: DataFrame) -> DataFrame:
    """One row: packets, tokens (a quarter of the bytes where missing), bytes, run time."""
    return packets.agg(
        F.count("*").alias("packets"), F.sum(F.coalesce("est_tokens", F.expr("est_bytes div 4"), F.lit(0))).cast("bigint").alias("tokens"),
        F.sum(F.coalesce("est_bytes", F.lit(0))).cast("bigint").alias("bytes"), F.sum(F.coalesce("runtime_ms", F.lit(0))).cast("bigint").alias("runtime_ms"),
    )


def assembled(items: DataFrame, *, budget: int) -> DataFrame:
    """``grp, ord, id, weight`` kept by first fit in rank order: what does not fit is skipped, the rest goes on.

    The rows of one group are folded in one task, in order; groups are
    bounded by what one request ranks.
    """
    from artefold.operators.reduce import first_fit_fold

    g = items.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("ord", "id", F.col("weight").cast("bigint").alias("weight")))).alias("items"))
    return first_fit_fold(g, "items", "weight", budget).select("grp", "k.ord", "k.id", "k.weight")


def boosted(relevance: Column, n_refs: Column, focus_hits: Column) -> Column:
    """Rank of a section: relevance, 0.05 for each reference, up to 0.35 for focus."""
    return F.round(relevance + n_refs * 0.05 + F.least(focus_hits * 0.35, F.lit(0.35)), 6)
