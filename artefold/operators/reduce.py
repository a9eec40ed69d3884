"""Reducing logs and command output.

Lines are ``(log, line_no, text)``.  What depends on the order of lines runs in
segments of a log (``carry_previous``), so a very long log is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from artefold.functions.text import ascii_lower, fingerprint, message_template
from artefold.operators.segments import carry_previous

# Patterns of diagnostics and stack frames.
FILE = r"[A-Za-z0-9_./\\-]+\.[A-Za-z0-9_+-]+"
GCC = rf"^({FILE}):([0-9]+):([0-9]+):\s*(error|warning|note|info):\s*(.*?)(?:\s+\[([^\]]+)\])?$"
MSVC = rf"^({FILE})\(([0-9]+),([0-9]+)\):\s*(error|warning|note|info)\s*([A-Za-z0-9_]+)?:?\s*(.*)$"
RUSTC_HEAD = r"^(error|warning|note)(?:\[([^\]]+)\])?:\s*(.*)$"
RUSTC_PLACE = rf"^\s*-->\s+({FILE}):([0-9]+):([0-9]+)"
JAVA_FRAME = r"^at +([\w.$<>]+)\(([^:()]+):([0-9]+)\)"
PYTHON_FRAME = r'^File +"([^"]+)", +line +([0-9]+), +in +(.+)$'
PLAIN_FRAME = r"([A-Za-z0-9_./-]+\.[A-Za-z0-9_+-]+):([0-9]+)(?::[0-9]+)?(?: +in +([\w.$<>:]+))?"
HEADER_WORDS = r"exception|panic|fatal|traceback|error:|failed"
FOREIGN_CODE = r"/rustc/|site-packages|node_modules|/usr/lib/|/lib/|java\.base"


def split_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``log, line_no, text``, numbered from 1."""
    return docs.select(F.col(id_col).alias("log"), F.posexplode(F.split(F.regexp_replace(text_col, "\r", ""), "\n")).alias("pos", "text")).select("log", (F.col("pos") + 1).alias("line_no"), "text")


def run_length(lines: DataFrame, *, key: Column | None = None, segment: int = 4096) -> DataFrame:
    """``log, first_line, text, n``: runs of consecutive lines that are equal by ``key``; the last raw line of a run stays."""
    seg = F.floor(F.col("line_no") / segment)
    rows = lines.select("log", "line_no", "text", (F.col("text") if key is None else key).alias("k"))
    rows = carry_previous(rows, ["log"], ["line_no"], seg, {"before": F.struct("k")})
    new = F.col("before").isNull() | ~F.col("k").eqNullSafe(F.col("before.k"))
    rows = carry_previous(rows, ["log"], ["line_no"], seg, {"first_line": F.when(new, F.col("line_no"))}, inclusive=True)
    return rows.groupBy("log", "first_line").agg(F.max_by("text", "line_no").alias("text"), F.count("*").alias("n"))


def without_time(col: Column) -> Column:
    """A line without a leading 19-character timestamp."""
    return F.when(col.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}"), F.substring(col, 20, 1 << 30)).otherwise(col)


def collapse_blanks(lines: DataFrame, *, segment: int = 4096) -> DataFrame:
    """Of consecutive blank lines the first."""
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    rows = carry_previous(lines, ["log"], ["line_no"], F.floor(F.col("line_no") / segment), {"__was": blank})
    return rows.filter(~blank | ~F.coalesce("__was", F.lit(False))).drop("__was")


#: Fixed value: what looks like a path in command output.
PATHISH = r"([A-Za-z0-9_./\\-]+\.[A-Za-z0-9]+|[A-Za-z0-9_./\\-]+/[A-Za-z0-9_./\\-]+)"


def line_class(col: Column) -> Column:
    """error, warning, git_change, path or other."""
    low = ascii_lower(col)
    return (
        F.when(low.rlike("error|fatal"), "error")
        .when(low.contains("warn"), "warning")
        .when(col.rlike("^[MAD]"), "git_change")
        .when(col.rlike(PATHISH), "path")
        .otherwise("other")
    )


def class_score(kind: Column) -> Column:
    return F.when(kind == "error", 100).when(kind == "warning", 90).when(kind == "git_change", 80).when(kind == "path", 70).otherwise(50)


def command_reduce(lines: DataFrame, *, budget_bytes: int = 24_000) -> DataFrame:
    """``log, line_no, class, text`` kept within the byte budget of each command.

    Repeated trimmed lines count once; best classes first, in line order; a
    line that does not fit is skipped, not the rest.  A command's distinct
    lines are folded in one row, in order.
    """
    once = lines.select("log", "line_no", F.trim(F.translate("text", "\t", " ")).alias("text")).filter("text <> ''").groupBy("log", "text").agg(F.min("line_no").alias("line_no"))
    ranked = once.withColumn("class", line_class(F.col("text"))).withColumn("w", F.octet_length("text").cast("bigint"))
    item = F.struct((-class_score(F.col("class"))).alias("s"), "line_no", "w", "class", "text")
    folded = ranked.groupBy("log").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return first_fit_fold(folded, "items", "w", budget_bytes).select("log", "k.line_no", "k.class", "k.text")


def first_fit_fold(df: DataFrame, items: str, weight: str, budget: int) -> DataFrame:
    """``df`` exploded to the items kept, as ``k``, when they are taken in order as long as they fit."""
    kind = df.schema[items].dataType.simpleString()
    start = f"named_struct('used', 0L, 'kept', cast(array() as {kind}))"
    fold = f"aggregate({items}, {start}, (a, x) -> if(a.used + x.{weight} <= {budget}, named_struct('used', a.used + x.{weight}, 'kept', concat(a.kept, array(x))), a))"
    return df.withColumn("__f", F.expr(fold)).withColumn("k", F.explode("__f.kept"))


def class_histogram(lines: DataFrame) -> DataFrame:
    return lines.filter("trim(text) <> ''").groupBy(line_class(F.col("text")).alias("class")).agg(F.count("*").alias("n"), F.countDistinct("log").alias("logs"))


def frames(lines: DataFrame) -> DataFrame:
    """``log, line_no, function, file, line, actionable`` of every stack frame."""
    t = F.trim("text")
    pick = lambda p, g: F.when(t.rlike(p), F.regexp_extract(t, p, g))
    file = F.coalesce(pick(JAVA_FRAME, 2), pick(PYTHON_FRAME, 1), pick(PLAIN_FRAME, 1))
    rows = lines.select(
        "log", "line_no", F.coalesce(pick(JAVA_FRAME, 1), pick(PYTHON_FRAME, 3), F.nullif(pick(PLAIN_FRAME, 3), F.lit(""))).alias("function"), file.alias("file"),
        F.coalesce(pick(JAVA_FRAME, 3), pick(PYTHON_FRAME, 2), pick(PLAIN_FRAME, 2)).try_cast("int").alias("line"),
    )
    return rows.filter("file is not null").withColumn("actionable", ~F.col("file").rlike(FOREIGN_CODE))


def is_failure_header(col: Column) -> Column:
    low = ascii_lower(F.trim(col))
    return low.rlike(HEADER_WORDS) & ~low.rlike("^(at |file )")


def stack_blocks(lines: DataFrame, *, segment: int = 4096) -> DataFrame:
    """Failure blocks: ``log, block, title, fingerprint, n_frames``.

    A header line opens a block and the first blank line after it closes it;
    lines before the first header belong to none.  The fingerprint is of the
    lower-case title and the first three frames.  Blocks without frames are
    left out.
    """
    head = is_failure_header(F.col("text"))
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    seg = F.floor(F.col("line_no") / segment)
    own = carry_previous(lines, ["log"], ["line_no"], seg, {"block": F.when(head, F.col("line_no")), "gap": F.when(blank, F.col("line_no"))}, inclusive=True)
    own = own.filter("block is not null and (gap is null or gap < block)")
    titles = own.filter("block = line_no").select("log", "block", F.trim("text").alias("title"))
    fr = frames(own.select(F.struct("log", "block").alias("log"), "line_no", "text")).select("log.log", "log.block", "line_no", "function", "file", "line")
    shown = F.struct("line_no", F.concat_ws("|", F.coalesce("function", F.lit("")), "file", F.col("line").cast("string")).alias("f"))
    grouped = fr.groupBy("log", "block").agg(F.count("*").alias("n_frames"), F.slice(F.array_sort(F.collect_list(shown)), 1, 3).alias("top"))
    rows = titles.join(grouped, ["log", "block"])
    return rows.select("log", "block", "title", fingerprint(ascii_lower(F.col("title")), F.array_join(F.expr("transform(top, x -> x.f)"), "|")).alias("fingerprint"), "n_frames")


def stack_slice(blocks: DataFrame, *, max_failures: int | None = None) -> DataFrame:
    """``fingerprint, title, occurrences, n_frames``: one row per distinct failure, shown by its first block.

    ``max_failures`` keeps the first so many in order of appearance.
    """
    key = F.struct("log", "block")
    rows = blocks.groupBy("fingerprint").agg(F.min(key).alias("__first"), F.min_by("title", key).alias("title"), F.count("*").alias("occurrences"), F.min_by("n_frames", key).alias("n_frames"))
    rows = rows if max_failures is None else rows.orderBy("__first").limit(max_failures)
    return rows.drop("__first")


def slice_totals(sliced: DataFrame) -> DataFrame:
    """One row: all failures, distinct ones, and how many repeats were removed."""
    t = sliced.agg(F.coalesce(F.sum("occurrences"), F.lit(0)).cast("bigint").alias("total"), F.count("*").alias("distinct_failures"))
    return t.withColumn("duplicates_removed", F.col("total") - F.col("distinct_failures"))


def diagnostics(lines: DataFrame, *, segment: int = 4096) -> DataFrame:
    """Compiler diagnostics of three layouts: ``log, line_no, file, line, column_no, severity, code, message``.

    A bare header (``error[E1]: text``) waits for its ``-->`` line, and takes
    that line's number; another diagnostic or header in between makes it void.
    One still waiting at the end of its log has the place ``<unknown>:0:0``.
    """
    t = F.col("text")
    kind = F.when(t.rlike(GCC), "gcc").when(t.rlike(MSVC), "msvc").when(t.rlike(RUSTC_HEAD), "head").when(t.rlike(RUSTC_PLACE), "place")
    events = lines.withColumn("kind", kind).filter("kind is not null").select("log", "line_no", "text", "kind")
    carried = carry_previous(events, ["log"], ["line_no"], F.floor(F.col("line_no") / segment), {"before": F.struct("kind", "text")})
    last = events.groupBy("log").agg(F.max_by(F.struct("kind", "text", "line_no"), "line_no").alias("e")).filter("e.kind = 'head'")

    def rows(df: DataFrame, places: tuple[Column, Column, Column], told: tuple[Column, Column, Column]) -> DataFrame:
        file, line, column = places
        severity, code, message = told
        return df.select(
            "log", "line_no", file.alias("file"), line.cast("int").alias("line"), column.cast("int").alias("column_no"),
            severity.alias("severity"), F.nullif(code, F.lit("")).alias("code"), F.trim(message).alias("message"),
        )

    get = lambda text, pattern, *groups: tuple(F.regexp_extract(text, pattern, g) for g in groups)
    head = lambda text: get(text, RUSTC_HEAD, 1, 2, 3)
    return (
        rows(events.filter("kind = 'gcc'"), get(t, GCC, 1, 2, 3), get(t, GCC, 4, 6, 5))
        .unionByName(rows(events.filter("kind = 'msvc'"), get(t, MSVC, 1, 2, 3), get(t, MSVC, 4, 5, 6)))
        .unionByName(rows(carried.filter("kind = 'place' and before.kind = 'head'"), get(t, RUSTC_PLACE, 1, 2, 3), head(F.col("before.text"))))
        .unionByName(rows(last.select("log", F.col("e.line_no").alias("line_no"), F.col("e.text").alias("text")), (F.lit("<unknown>"), F.lit(0), F.lit(0)), head(t)))
    )


def root_causes(found: DataFrame, *, order: list[str]) -> DataFrame:
    """``cause, severity, n``: distinct diagnostics grouped by severity and code, or else message template."""
    once = found.groupBy("severity", "code", "message", "path", "line").agg(F.min(F.struct(*order)).alias("__o"))
    cause = F.concat_ws(":", "severity", F.coalesce("code", message_template(F.col("message"))))
    return once.groupBy(cause.alias("cause")).agg(F.max("severity").alias("severity"), F.count("*").alias("n"))


#: How the output of tools is counted, (counter, pattern of a line).
COUNTERS = {
    "git_status": (("changed", r"^\s*(modified:|new file:|deleted:|renamed:)"), ("untracked", r"^\t[^:]+$")),
    "git_diff": (("added", r"^\+(?!\+\+)"), ("removed", r"^-(?!--)"), ("files", r"^diff --git ")),
    "cargo_build": (("errors", r"^error"), ("warnings", r"^warning"), ("places", r"^\s*-->")),
    "pytest": (("failed", r"^FAILED "), ("summary", r" (passed|failed)")),
    "ruff": (("findings", r"^\S+\.py:[0-9]+"),),
    "eslint": (("problems", r"[0-9]+ problems"), ("errors", r"error TS[0-9]+")),
    "go_test": (("ok", r"^ok\t"), ("failed", r"^(FAIL\t|--- FAIL:)")),
    "kubectl": (("rows", r"^\S+\s+[0-9]+/[0-9]+\s"), ("pending", r"\sPending(\s|$)")),
    "vitest": (("failed", r"^\s*FAIL\s"), ("summary", r"Tests.*[0-9]+ (passed|failed)")),
}


def count_output(lines: DataFrame, tool: str) -> DataFrame:
    """``log`` and the counters of a tool; commands without any counted line are left out."""
    counters = COUNTERS[tool]
    g = lines.groupBy("log").agg(*[F.count_if(F.coalesce(F.col("text").rlike(p), F.lit(False))).alias(n) for n, p in counters])
    return g.filter(" or ".join(f"{n} > 0" for n, _ in counters))
