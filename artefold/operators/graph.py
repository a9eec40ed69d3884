"""Repository maps: edges, centrality, ranking, symbol queries, schedules."""

from __future__ import annotations

import re
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from artefold.functions.text import ascii_lower, basename, dirname
from artefold.operators.segments import running_sum
from artefold.session import written

# Patterns of symbols and imports.
SYMBOL = r"^\s*(?:(fn|struct|enum|trait|impl|class|interface|def|function)\s+)([A-Za-z_][A-Za-z0-9_]*)"
IMPORT = r"""^\s*(?:use|from|#include|import(?:\s+static)?)\s+[<"']?([A-Za-z0-9_./:-]+)"""


def symbols(lines: DataFrame) -> DataFrame:
    """``path, line, kind, name`` of the definitions in ``(path, line, text)``."""
    return lines.filter(F.col("text").rlike(SYMBOL)).select("path", "line", F.regexp_extract("text", SYMBOL, 1).alias("kind"), F.regexp_extract("text", SYMBOL, 2).alias("name"))


def imports(lines: DataFrame) -> DataFrame:
    """``path, line, target`` of the import lines."""
    return lines.filter(F.col("text").rlike(IMPORT)).select("path", "line", F.regexp_extract("text", IMPORT, 1).alias("target"))


def edges(pairs: DataFrame) -> DataFrame:
    """Distinct ``from_path, to_path`` without loops."""
    return pairs.filter("from_path <> to_path").select("from_path", "to_path").distinct()


def import_edges(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Imports ``(path, target)`` resolved to files ``(path)`` by module name.

    Of several files the one in the importing directory, then the smallest
    path is taken.
    """
    stem = lambda c: ascii_lower(F.regexp_replace(basename(F.regexp_replace(c, r"::|\.(?=[a-z_]+$)", "/")), r"\.[A-Za-z0-9]+$", ""))
    to = files.select(F.col("path").alias("to_path"), ascii_lower(F.regexp_replace(basename(F.col("path")), r"\.[A-Za-z0-9]+$", "")).alias("stem"))
    near = F.when(dirname(F.col("to_path")) == dirname(F.col("from_path")), 0).otherwise(1)
    rows = wanted.select(F.col("path").alias("from_path"), "target", stem(F.col("target")).alias("stem")).distinct().join(to, "stem").filter("from_path <> to_path")
    return rows.groupBy("from_path", "target").agg(F.min(F.struct(near.alias("n"), "to_path")).alias("b")).select("from_path", "target", "b.to_path")


def degree(edge: DataFrame) -> DataFrame:
    """``path, degree, centrality``: edges in and out, over the largest."""
    ends = edge.select(F.explode(F.array("from_path", "to_path")).alias("path"))
    d = ends.groupBy("path").agg(F.count("*").alias("degree"))
    most = d.agg(F.max("degree").alias("most"))
    return d.crossJoin(F.broadcast(most)).select("path", "degree", F.round(F.col("degree") / F.col("most"), 6).alias("centrality"))  # one row


def ranked(files: DataFrame, *, with_symbols: bool = False) -> DataFrame:
    """``path, score`` from ``focus, near, centrality, recent`` (nulls are 0)."""
    w1, w2 = (0.55, 0.10) if with_symbols else (0.45, 0.20)
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return files.select("path", F.round(z("focus") * w1 + z("near") * 0.25 + z("centrality") * w2 + z("recent") * 0.1, 6).alias("score"))


def match_score(name: Column, query: str) -> Column:
    """1 for the exact name, 0.98 whatever the case, 0.6 less 0.05 for a part of it, else null."""
    low = ascii_lower(name)
    return F.when(name == query, 1.0).when(low == query.lower(), 0.98).when(low.contains(query.lower()), 0.55)


def pattern_regex(query: str) -> str:
    """``$NAME`` stands for an identifier, ``$_`` for anything, ``$$$X`` for anything or nothing; white space for white space."""
    out = []
    for part in re.split(r"(\$\$\$[A-Za-z_]*|\$[A-Za-z_][A-Za-z0-9_]*|\s+)", query.strip()):
        if part.startswith("$$$"):
            out.append(".*?")
        elif part == "$_":
            out.append(".+?")
        elif part.startswith("$"):
            out.append("[A-Za-z_][A-Za-z0-9_]*")
        elif part.isspace():
            out.append(r"\s+")
        else:
            out.append(re.escape(part))
    return "".join(out)


def levels(nodes: DataFrame, depends: DataFrame) -> DataFrame:
    """``id, level``: 0 without dependencies, else one more than the deepest of them.

    Layers are peeled by anti-joins on written tables; what is left when a
    round peels nothing lies on a cycle, which is an error.  Dependencies on
    unknown nodes do not count.
    """
    left = written(nodes.select("id").distinct(), "levels-nodes")
    deps = written(depends.select("id", "needs").distinct().join(left.select(F.col("id").alias("needs")), "needs", "left_semi"), "levels-edges")
    done = None
    for level in count():
        blocked = deps.join(left.select(F.col("id").alias("needs")), "needs", "left_semi").select("id").distinct()
        free = written(left.join(blocked, "id", "left_anti").withColumn("level", F.lit(level)), "levels-free")
        if free.isEmpty():
            if left.isEmpty():
                break
            raise ValueError("the dependencies have a cycle")
        done = free if done is None else done.unionByName(free)
        left = written(left.join(free, "id", "left_anti"), "levels-nodes")
    return done if done is not None else left.withColumn("level", F.lit(0))


def prefix_cut(steps: DataFrame, budget: int) -> DataFrame:
    """``run, ord, cost, status``: steps run in order up to the first that would exceed the budget; it and the rest do not."""
    seg = F.floor(F.col("ord") / 4096)
    used = running_sum(steps, ["run"], ["ord"], seg, F.col("cost"), "used", inclusive=True)
    stops = used.filter(F.col("used") > budget).groupBy("run").agg(F.min("ord").alias("stop"))
    rows = used.join(stops, "run", "left")
    return rows.select("run", "ord", "cost", F.when(F.col("stop").isNull() | (F.col("ord") < F.col("stop")), "ran").otherwise("budget_exceeded").alias("status"))


def plan_violations(steps: DataFrame) -> DataFrame:
    """``plan, ord, rule`` for steps ``(plan, ord, action, path, needs)``.

    ``read_before_edit``: no earlier step of the plan reads the edited path;
    ``missing_test_gate``: no later step tests; ``dependency_order``: a step
    needs itself or a later one.
    """
    read = steps.filter("action = 'read'").groupBy("plan", "path").agg(F.min("ord").alias("first_read"))
    tests = steps.filter("action = 'test'").groupBy("plan").agg(F.max("ord").alias("last_test"))
    edit = steps.filter("action = 'edit'").join(read, ["plan", "path"], "left").join(tests, "plan", "left")
    unread = edit.filter("first_read is null or first_read >= ord").select("plan", "ord", F.lit("read_before_edit").alias("rule"))
    untested = edit.filter("last_test is null or last_test <= ord").select("plan", "ord", F.lit("missing_test_gate").alias("rule"))
    order = steps.filter("needs >= ord").select("plan", "ord", F.lit("dependency_order").alias("rule"))
    return unread.unionByName(untested).unionByName(order)
