"""Event-sourced task state, in batch: folds, sequences, epochs, sessions.

Events are ``(task, at, event_id, kind, ...)`` in the order (at, event_id),
``at`` in Unix seconds.  Ordered operators run in segments of a day, so that a
task with a large part of all events is spread over many tasks of Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from artefold.operators.segments import carry_previous, running_sum


def _day() -> Column:
    return F.floor(F.col("at") / 86400)


def ordered(*cols: str) -> Column:
    return F.struct(*cols)


def last_per_item(events: DataFrame, *, item: str = "item") -> DataFrame:
    """``task, item, kind, at``: the last event of each item, by a partial aggregate."""
    return events.groupBy("task", item).agg(F.max_by("kind", ordered("at", "event_id")).alias("kind"), F.max("at").alias("at"))


def open_set(events: DataFrame, *, add: list[str], remove: list[str], clear: list[str]) -> DataFrame:
    """``task, item``: items whose last addition is after their last removal and the task's last clearing.

    Both are partial aggregates; the clear of a task meets its items by a
    join on the few tasks that have one.
    """
    key = ordered("at", "event_id")
    last = events.groupBy("task", "item").agg(F.max(F.when(F.col("kind").isin(add), key)).alias("a"), F.max(F.when(F.col("kind").isin(remove), key)).alias("r"))
    cleared = events.filter(F.col("kind").isin(clear)).groupBy("task").agg(F.max(key).alias("c"))
    rows = last.filter("item is not null and a is not null").join(cleared, "task", "left")
    return rows.filter("(r is null or a > r) and (c is null or a > c)").select("task", "item")


def snapshot(events: DataFrame) -> DataFrame:
    """``task`` with the number of events, last time, last kind and the counts of the main kinds."""
    kinds = ("file_read", "file_edited", "decision_added", "question_opened", "checkpoint_saved")
    return events.groupBy("task").agg(
        F.count("*").alias("events"), F.max("at").alias("last_at"), F.max_by("kind", ordered("at", "event_id")).alias("last_kind"),
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds],
    )


def agent_parts(events: DataFrame) -> DataFrame:
    """``task, part, item``: the state of each task, folded from its events ``(task, at, event_id, kind, paths, symbols, data_json)``.

    Every event adds items to parts, removes items or clears a part; an item
    is there if its last addition is after its last removal and the last
    clearing of the part.  All are partial aggregates, so no task is hot.
    Parts of one value hold the latest.
    """
    field = lambda n: F.get_json_object("data_json", f"$.{n}")
    one = lambda c: F.array_compact(F.array(c))
    none, nothing = F.lit(None).cast("array<string>"), F.array().cast("array<string>")
    is_ = lambda *kinds: F.col("kind").isin(*kinds)
    cleared_all = is_("focus_cleared") & (field("clear_all") == "true")
    # (part, adds, removes, clears)
    rules = (
        ("focus_paths", F.when(is_("focus_set"), F.col("paths")), F.when(is_("focus_cleared"), F.col("paths")), cleared_all),
        ("focus_symbols", F.when(is_("focus_set"), F.col("symbols")), F.when(is_("focus_cleared"), F.col("symbols")), cleared_all),
        ("files_read", F.when(is_("file_read"), F.col("paths")), none, F.lit(False)),
        ("files_edited", F.when(is_("file_edited"), F.col("paths")), none, F.lit(False)),
        ("changed_paths", F.when(is_("file_edited"), F.col("paths")), none, is_("checkpoint_saved")),
        ("changed_symbols", F.when(is_("file_edited"), F.col("symbols")), none, is_("checkpoint_saved")),
        ("decisions", F.when(is_("decision_added"), one(field("decision_id"))), F.when(is_("decision_added"), one(field("supersedes"))).when(is_("decision_superseded"), one(field("decision_id"))), F.lit(False)),
        ("completed_steps", F.when(is_("step_completed"), one(field("step_id"))), none, F.lit(False)),
        ("open_questions", F.when(is_("question_opened"), one(field("question_id"))), F.when(is_("question_resolved"), one(field("question_id"))), F.lit(False)),
        ("evidence", F.when(is_("evidence_captured"), one(field("artifact_id"))), none, F.lit(False)),
        ("failed_tools", F.when(is_("tool_invocation_failed"), one(field("tool_name"))), none, F.lit(False)),
        ("checkpoint_paths", F.when(is_("checkpoint_saved"), F.coalesce("paths", nothing)), none, F.lit(False)),
        ("checkpoint", F.when(is_("checkpoint_saved"), one(field("checkpoint_id"))), none, F.lit(False)),
    )
    touched = F.array_compact(F.array(*[
        F.when(adds.isNotNull() | removes.isNotNull() | clears, F.struct(F.lit(part).alias("part"), F.coalesce(adds, nothing).alias("adds"), F.coalesce(removes, nothing).alias("removes"), clears.alias("clears")))
        for part, adds, removes, clears in rules
    ]))
    rows = events.select("task", ordered("at", "event_id").alias("key"), F.explode(touched).alias("t")).select("task", "key", "t.*")
    items = F.array_union(F.transform("adds", lambda x: F.struct(x.alias("item"), F.lit(True).alias("add"))), F.transform("removes", lambda x: F.struct(x.alias("item"), F.lit(False).alias("add"))))
    long = rows.select("task", "part", "key", F.explode(items).alias("i")).filter("i.item is not null")
    last = long.groupBy("task", "part", F.col("i.item").alias("item")).agg(F.max(F.when(F.col("i.add"), F.col("key"))).alias("a"), F.max(F.when(~F.col("i.add"), F.col("key"))).alias("r"))
    clears = rows.filter("clears").groupBy("task", "part").agg(F.max("key").alias("c"))
    latest = rows.filter("part in ('checkpoint', 'checkpoint_paths')").groupBy("task", "part").agg(F.max("key").alias("l"))
    there = last.filter("a is not null").join(clears, ["task", "part"], "left").join(latest, ["task", "part"], "left")
    return there.filter("(r is null or a > r) and (c is null or a > c) and (l is null or a = l)").select("task", "part", "item")


def replayed(events: DataFrame, n: int) -> DataFrame:
    """The last ``n`` events of each task in their order; 0 is all."""
    return events if n == 0 else last_n(events, n).drop("back")


def last_n(events: DataFrame, n: int) -> DataFrame:
    """The last ``n`` events of each task, newest first as ``back`` 1."""
    w = Window.partitionBy("task").orderBy(F.desc("at"), F.desc("event_id"))
    return events.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n)


def sequence(events: DataFrame) -> DataFrame:
    """Adds ``seq``, from 1 without gaps in each task."""
    return running_sum(events, ["task"], ["at", "event_id"], _day(), F.lit(1), "seq", inclusive=True)


def since_checkpoint(events: DataFrame, *, boundary: str = "checkpoint_saved") -> DataFrame:
    """``task, kind, n``: events after the last boundary of their task."""
    marks = events.filter(F.col("kind") == boundary).groupBy("task").agg(F.max(ordered("at", "event_id")).alias("m"))
    rows = events.join(marks, "task", "left").filter(F.col("m").isNull() | (ordered("at", "event_id") > F.col("m")))
    return rows.groupBy("task", "kind").agg(F.count("*").alias("n"))


def epochs(events: DataFrame, *, mutates: list[str]) -> DataFrame:
    """Adds ``epoch``: how many mutations of the task came before."""
    return running_sum(events, ["task"], ["at", "event_id"], _day(), F.col("kind").isin(mutates).cast("int"), "epoch")


def cache_hits(calls: DataFrame) -> DataFrame:
    """``task, calls, hits``: a call hits if an earlier one of its task had the same fingerprint in the same epoch."""
    groups = calls.groupBy("task", "fingerprint", "epoch").agg(F.count("*").alias("n"))
    return groups.groupBy("task").agg(F.sum("n").alias("calls"), F.sum(F.col("n") - 1).alias("hits"))


def debounced(events: DataFrame, gap_seconds: int) -> DataFrame:
    """``task, first_at, last_at, n``: bursts of events, each at most ``gap_seconds`` after the one before."""
    rows = carry_previous(events.select("task", "at", "event_id"), ["task"], ["at", "event_id"], _day(), {"before": F.col("at")})
    new = F.coalesce(F.col("at") - F.col("before") > gap_seconds, F.lit(True))
    rows = carry_previous(rows, ["task"], ["at", "event_id"], _day(), {"burst": F.when(new, F.struct("at", "event_id"))}, inclusive=True)
    return rows.groupBy("task", "burst").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("n")).drop("burst")


def threshold_level(used: Column, budget: int, *, warn: float = 0.5, prepare: float = 0.75, force: float = 0.9) -> Column:
    """The highest level reached."""
    at = lambda f: round(budget * (f if f > 0 else 0.5))
    return F.when(used >= at(force), "force").when(used >= at(prepare), "prepare").when(used >= at(warn), "warn").otherwise("none")


def token_windows(events: DataFrame, *, boundary: str, budget: int) -> DataFrame:
    """``task, part, tokens, level``: tokens since each boundary and the level they reach."""
    rows = running_sum(events, ["task"], ["at", "event_id"], _day(), (F.col("kind") == boundary).cast("int"), "part")
    g = rows.groupBy("task", "part").agg(F.sum("tokens").cast("bigint").alias("tokens"))
    return g.withColumn("level", threshold_level(F.col("tokens"), budget))


def tumbling(events: DataFrame, ts: str, width: str) -> DataFrame:
    """``start, kind, n`` per window of event time."""
    return events.groupBy(F.window(ts, width).alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def fail_then_success(rows: DataFrame, *, segment: int = 4096) -> DataFrame:
    """``grp, ord, program``: a failure directly followed by a success of the same program; rows ``(grp, ord, program, failed)``."""
    own = rows.select("grp", "ord", "program", "failed")
    pairs = carry_previous(own, ["grp"], ["ord"], F.floor(F.col("ord") / segment), {"before": F.struct("ord", "program", "failed")})
    return pairs.filter("not failed and before.failed and before.program = program").select("grp", "before.ord", "program")


def gain(rows: DataFrame) -> DataFrame:
    """One row: raw, reduced and saved tokens and the saved share."""
    g = rows.agg(F.count("*").alias("n"), F.sum("raw").cast("bigint").alias("raw"), F.sum("reduced").cast("bigint").alias("reduced"), F.sum(F.greatest(F.col("raw") - F.col("reduced"), F.lit(0))).cast("bigint").alias("saved"))
    return g.withColumn("pct", F.round(100.0 * F.col("saved") / F.nullif(F.col("raw"), F.lit(0)), 6))


def gain_by(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.greatest(F.col("raw") - F.col("reduced"), F.lit(0))).cast("bigint").alias("saved"))


def discovery(rows: DataFrame, supported: list[str], *, top: int = 20) -> DataFrame:
    """``program, n, tokens``: the programs without a reducer that cost most."""
    g = rows.groupBy("program").agg(F.count("*").alias("n"), F.sum("tokens").cast("bigint").alias("tokens"))
    return g.filter(~F.col("program").isin(supported)).orderBy(F.desc("tokens"), "program").limit(top)
