"""Query terms, scopes, commands, replanning and packet-level correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from artefold.functions.text import ascii_lower

# Words that say nothing in a query.
STOP_WORDS = (
    "about across all and are code codebase defined do does file files find for from function functions how into is line lines me method methods not "
    "show symbol symbols task test tests the this those usage usages used uses what when where which with"
).split()
# Programs by family of reducer.
FAMILIES = {
    "git": ("git",), "fs": ("ls", "find", "cat", "head", "tail", "sed", "diff"), "rust": ("cargo",), "github": ("gh",), "go": ("go", "golangci-lint"),
    "infra": ("docker", "kubectl", "curl", "aws"), "python": ("python", "python3", "pytest", "ruff", "pip", "pip3", "uv", "mypy"),
    "javascript": ("npm", "pnpm", "yarn", "npx", "tsc", "eslint", "vitest", "prettier", "next", "prisma", "playwright"),
}
# Line and block comment marks by kind of language.
COMMENTS = {"c": (("//",), "/*", "*/"), "hash": (("#",), "\"\"\"", "\"\"\""), "sql": (("--",), "/*", "*/")}


def query_terms(col: Column) -> Column:
    """The telling words of a question: at least three bytes, lower case, each once, in order."""
    words = F.filter(F.split(ascii_lower(col), "[^a-z0-9_-]+"), lambda w: (F.octet_length(w) >= 3) & ~w.isin(STOP_WORDS))
    return F.array_distinct(words)


def infer_scope(paths: DataFrame, terms: list[str], *, top: int = 6) -> DataFrame:
    """``path, hits``: the paths that hold most of the terms; ``score`` breaks ties, then the path."""
    hit = sum((F.col("low").contains(t).cast("int") for t in terms), F.lit(0))
    rows = paths.withColumn("low", ascii_lower(F.col("path"))).withColumn("hits", hit).filter("hits > 0")
    return rows.orderBy(F.desc("hits"), F.desc("score"), "path").limit(top).select("path", "hits")


def containing(values: DataFrame, col: str, needles: list[str]) -> DataFrame:
    """``col, needle`` for each needle a value contains; the few needles are literals of the plan."""
    held = F.filter(F.array(*[F.lit(n) for n in needles]), lambda n: F.col(col).contains(n))
    return values.select(col, F.explode(held).alias("needle"))


def bare_command(col: Column) -> Column:
    """A command without leading assignments, trailing redirects and ``| head``, ``| tail``, ``| sed -n``; null where it composes or expands."""
    c = F.regexp_replace(F.trim(col), r"(\s+[0-9]?>(&[0-9]|\s*/dev/null))+\s*$", "")
    c = F.regexp_replace(c, r"(\s*\|\s*(head|tail|sed -n)[^|;&]*)+$", "")
    c = F.trim(F.regexp_replace(c, r"^([A-Za-z_][A-Za-z0-9_]*=\S*\s+)+", ""))
    return F.when((c != "") & ~c.rlike(r"[|;&`]|\$\(|\$\{|\$[A-Za-z_]"), c)


def command_family(col: Column) -> Column:
    """The family whose reducer takes the output of a command, or null."""
    program = F.split_part(bare_command(col), F.lit(" "), F.lit(1))
    out = None
    for family, programs in FAMILIES.items():
        out = F.when(program.isin(*programs), family) if out is None else out.when(program.isin(*programs), family)
    return out


def without_comments(col: Column, kind: str) -> Column:
    """A source text without comment lines and blocks; of blank lines in a row one stays, none at the end.

    A fold over the lines of the one text, inside the JVM.
    """
    marks, begin, end = COMMENTS[kind]
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("block"), F.lit(False).alias("blank"))

    def step(acc, raw):
        line, trimmed = F.rtrim(raw), F.trim(raw)
        opens = trimmed.startswith(begin)
        closes = F.instr(F.substr(trimmed, F.lit(len(begin) + 1)), F.lit(end)) > 0
        comment = F.lit(False)
        for m in marks:
            comment = comment | trimmed.startswith(m)
        blank = trimmed == ""
        in_block = acc["block"]
        drop = in_block | opens | comment | (blank & acc["blank"])
        return F.struct(
            F.when(drop, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(line))).alias("kept"),
            F.when(in_block, ~trimmed.contains(end)).otherwise(opens & ~closes).alias("block"),
            F.when(in_block | opens | comment, acc["blank"]).otherwise(blank).alias("blank"),
        )

    kept = F.aggregate(F.split(col, "\n"), start, step)["kept"]
    return F.regexp_replace(F.array_join(kept, "\n"), r"\n*$", "")


def canonical_hash(col: Column) -> Column:
    """The SHA-256 of a JSON text with its keys in order and without spaces; null where it is no JSON."""
    return F.sha2(F.to_json(F.try_parse_json(col)), 256)


def source_tier_score(tier: Column, *, mode: str = "conceptual", matched: Column, scoped: Column, explicit: Column) -> Column:
    """Curated memory first, telemetry last, unless telemetry is asked for."""
    more = F.when(matched, 1.0).otherwise(0.0) + F.when(scoped, 0.5).otherwise(0.0)
    if mode == "telemetry":
        return F.when(tier == "curated", 0.5).when(tier == "telemetry", 3.0 + more).otherwise(0.0)
    return F.when(tier == "curated", 3.0).when(tier == "telemetry", F.when(explicit, -1.25).otherwise(-4.25) + more).otherwise(0.0)


def replan(steps: DataFrame, completed: DataFrame, changed: DataFrame) -> DataFrame:
    """``step, action, reason`` for steps ``(step, path)``: cancel the completed ones and, if anything changed, those whose path did not."""
    done = completed.select("step").distinct().withColumn("done", F.lit(True))
    touched = changed.select("path").distinct().withColumn("touched", F.lit(True))
    some = changed.agg((F.count("*") > 0).alias("some"))
    rows = steps.join(done, "step", "left").join(touched, "path", "left").crossJoin(F.broadcast(some))  # one row
    reason = F.when(F.col("done"), "completed_step").when(F.col("some") & F.col("touched").isNull(), "inputs_unchanged")
    return rows.select("step", F.when(reason.isNotNull(), "cancel").otherwise("keep").alias("action"), reason.alias("reason"))


def against_changes(refs: DataFrame, changed: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """``grp, packet, relation, confidence`` of packets ``(grp, packet, path)`` against the changed files ``(grp, path)`` of their group.

    related (0.92) if they share a file; else possibly_related (0.62) if an
    edge of the map links them or there is no map, else unrelated (0.86).
    """
    c = changed.select("grp", "path").distinct()
    held = refs.select("grp", "packet", "path").distinct()
    groups = c.select("grp").distinct()
    packets = held.select("grp", "packet").distinct().join(groups, "grp", "left_semi")
    hit = held.join(c, ["grp", "path"], "left_semi").select("grp", "packet").distinct().withColumn("hit", F.lit(True))
    rows = packets.join(hit, ["grp", "packet"], "left")
    if edges is None:
        linked = F.lit(True)
    else:
        both = edges.select(F.col("from_path").alias("a"), F.col("to_path").alias("b")).union(edges.select("to_path", "from_path")).distinct()
        near = held.join(both, held.path == both.a).select("grp", "packet", F.col("b").alias("path")).join(c, ["grp", "path"], "left_semi").select("grp", "packet").distinct().withColumn("near", F.lit(True))
        rows = rows.join(near, ["grp", "packet"], "left")
        linked = F.coalesce("near", F.lit(False))
    relation = F.when(F.col("hit"), "related").when(linked, "possibly_related").otherwise("unrelated")
    rows = rows.withColumn("relation", relation)
    return rows.select("grp", "packet", "relation", F.when(F.col("relation") == "related", 0.92).when(F.col("relation") == "unrelated", 0.86).otherwise(0.62).alias("confidence"))


def trimmed_sections(sections: DataFrame, budget: int) -> DataFrame:
    """``grp, kind, kept``: how many rows of each kind of ``(grp, kind, prio, ord, size)`` fit a byte budget.

    Kinds of lower ``prio`` are cut first, from their end: rows are kept in
    the order of falling priority while the running size fits.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("grp").orderBy(F.desc("prio"), "ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = sections.withColumn("used", F.sum("size").over(w))
    return rows.groupBy("grp", "kind").agg(F.count_if(F.col("used") <= budget).alias("kept"))


def registered_functions(spark) -> list[str]:
    """Temporary SQL functions for the text expressions; gives their names."""
    made = {
        "ascii_lower(s STRING) RETURNS STRING": "translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')",
        "message_template(s STRING) RETURNS STRING": "trim(regexp_replace(ascii_lower(s), '[0-9]+', '#'))",
        "tokens_by_bytes(s STRING) RETURNS BIGINT": "octet_length(s) div 4",
        "tokens_by_chars(s STRING) RETURNS BIGINT": "(length(s) + 3) div 4",
        "path_basename(s STRING) RETURNS STRING": "substring_index(s, '/', -1)",
    }
    for head, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in made]
