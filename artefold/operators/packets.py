"""Packets as JSON: walks, shapes, extraction, keys, budgets; merging, audit and ranking over packets."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from artefold.functions.text import ascii_lower, camel_pieces
from artefold.operators.broker import STOP_WORDS
from artefold.operators.issues import severity_rank

#: Fields of an envelope that differ between equal runs, and what stands for them in its hash.
VOLATILE_COST = {"runtime_ms": 0, "est_bytes": 0, "est_tokens": 0, "payload_est_bytes": None, "payload_est_tokens": None}


def json_nodes(df: DataFrame, *, body: str, keys: list[str]) -> DataFrame:
    """``keys, path, kind, size, text``: every node of every readable JSON text, before what is in it.

    ``kind`` is object, array, string, number, bool or null; ``size`` the
    number of members of an object or array; ``text`` that of a string.
    Unreadable and null texts give no rows.
    """
    source = df.select(*keys, F.col(body).alias("__body")).filter("__body is not null")
    schema = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys) + ", path string, kind string, size int, text string"

    def walk(root) -> Iterator[tuple]:
        todo = [("$", root)]
        while todo:
            path, value = todo.pop()
            if isinstance(value, dict):
                yield path, "object", len(value), None
                todo += [(f"{path}.{k}", v) for k, v in reversed(value.items())]
            elif isinstance(value, list):
                yield path, "array", len(value), None
                todo += [(f"{path}[{i}]", value[i]) for i in range(len(value) - 1, -1, -1)]
            elif isinstance(value, str):
                yield path, "string", None, value
            else:
                yield path, "null" if value is None else "bool" if isinstance(value, bool) else "number", None, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for *key, text in pdf.itertuples(index=False, name=None):
                try:
                    root = json.loads(text)
                except (ValueError, RecursionError):
                    continue
                rows += [(*key, *n) for n in walk(root)]
            out = pd.DataFrame(rows, columns=[*keys, "path", "kind", "size", "text"])
            yield out.astype({"size": "Int32"})

    return source.mapInPandas(run, schema)


def json_shape(nodes: DataFrame) -> DataFrame:
    """``path, kind, n``: the places of a set of JSON texts and what stands there; of arrays the first element is looked at."""
    return nodes.filter(~F.col("path").rlike(r"\[[1-9]")).groupBy("path", "kind").agg(F.count("*").alias("n"))


def first_balanced(text: str | None, opening: str = "{") -> str | None:
    """The first object (or array) of a noisy text, to its closing bracket; brackets inside strings do not count."""
    closing = {"{": "}", "[": "]"}[opening]
    start = text.find(opening) if text else -1
    if start < 0:
        return None
    depth, quoted, i = 0, False, start
    while i < len(text):
        c = text[i]
        if quoted and c == "\\":
            i += 1
        elif c == '"':
            quoted = not quoted
        elif not quoted and c == opening:
            depth += 1
        elif not quoted and c == closing:
            depth -= 1
            if not depth:
                return text[start : i + 1]
        i += 1
    return None


def extracted(df: DataFrame, *, id_col: str, text_col: str, opening: str = "{") -> DataFrame:
    """The id and ``found``, the first balanced object or array of the text; rows without one are left out."""

    @F.pandas_udf("string")
    def pick(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: first_balanced(t, opening))

    return df.filter(F.col(text_col).contains(opening)).select(id_col, pick(text_col).alias("found")).filter("found is not null")


def envelope_hash(body: Column) -> Column:
    """The SHA-256 of an envelope with its keys in order and its volatile fields made equal; null where it is no JSON object."""

    @F.pandas_udf("string")
    def plain(texts: pd.Series) -> pd.Series:
        return texts.map(_canonical)

    return F.sha2(plain(body), 256)


def _canonical(text: str | None) -> str | None:
    try:
        value = json.loads(text) if text is not None else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(value, dict):
        return None
    value["hash"] = ""
    if isinstance(value.get("budget_cost"), dict):
        value["budget_cost"] |= VOLATILE_COST
    if isinstance(value.get("provenance"), dict):
        value["provenance"]["generated_at_unix"] = 0
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def cache_key(target: Column, body: Column) -> Column:
    """The key of a cached result: the hash of its target and the hash of its input."""
    return F.sha2(F.concat(target, F.lit("::"), F.sha2(body, 256)), 256)


def self_sized(base: Column, rounds: int = 5) -> Column:
    """The size of a text of ``base`` bytes that names its own size: repeated until it is stable, at most ``rounds`` times."""
    size = base
    for _ in range(rounds):
        size = base + F.length(size.cast("string"))
    return size.cast("bigint")


def merged(inputs: DataFrame, readable: Column, *, by: list[str], strict: bool = False) -> DataFrame:
    """``by, merged, skipped``: how many inputs can be merged; with ``strict`` an unreadable one is an error."""
    ok = F.coalesce(readable, F.lit(False))
    if strict:
        ok = F.when(ok, ok).otherwise(F.raise_error(F.lit("an input cannot be read")).cast("boolean"))
    return inputs.groupBy(*by).agg(F.count_if(ok).alias("merged"), F.count_if(~ok).alias("skipped"))


def audit(packets: DataFrame) -> DataFrame:
    """One row of totals over ``(kind, task, tokens, bytes, runtime_ms, calls)``; calls are at least one for each packet."""
    total = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).cast("bigint").alias(c)
    rows = packets.agg(F.count("*").alias("packets"), F.countDistinct("kind").alias("kinds"), F.countDistinct("task").alias("tasks"), total("tokens"), total("bytes"), total("runtime_ms"), total("calls"))
    return rows.withColumn("calls", F.greatest("calls", "packets"))


def relevance(rows: DataFrame, col: str) -> DataFrame:
    """``col, n, relevance``: how often a value stands, over the most frequent one."""
    counts = rows.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n").alias("most"))
    return counts.crossJoin(F.broadcast(most)).select(col, "n", F.round(F.col("n") / F.col("most"), 6).alias("relevance"))  # one row


def ranked_refs(refs: DataFrame, k: int) -> DataFrame:
    """The ``k`` first references ``(kind, value)``: by relevance over the most frequent, then kind and value."""
    counts = refs.filter("value is not null").groupBy("kind", "value").agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n").alias("most"))
    rows = counts.crossJoin(F.broadcast(most)).select("kind", "value", F.round(F.col("n") / F.col("most"), 6).alias("relevance"))  # one row
    return rows.orderBy(F.desc("relevance"), "kind", "value").limit(k)


#: The keys by which searched files are ranked, all descending.
FILE_KEYS = ("definition_len", "exact_definitions", "symbol_len", "exact_symbols", "phases", "definitions", "matches")


def ranked_files(files: DataFrame, k: int) -> DataFrame:
    """The ``k`` (at least one) best files ``(path, FILE_KEYS)``, ties by path."""
    return files.orderBy(*[F.desc(c) for c in FILE_KEYS], "path").limit(max(k, 1))


def ranked_causes(found: DataFrame, *, order: list[str], cause: Column, most: int | None = None) -> DataFrame:
    """``cause, severity, rank, n, first_at`` of diagnostics ``(file, line, severity, message, ...)``, repeats counted once.

    ``most`` keeps the first so many by ``order`` before repeats are removed.
    Report them by falling rank, falling n, then cause.
    """
    kept = found if most is None else found.orderBy(*order).limit(most)
    once = kept.select("severity", "message", "file", "line", cause.alias("cause")).distinct()
    rows = once.groupBy("cause").agg(F.max("severity").alias("severity"), F.count("*").alias("n"), F.min(F.struct("file", "line", "message")).alias("f"))
    return rows.select("cause", "severity", severity_rank(F.col("severity")).alias("rank"), "n", F.concat_ws(":", "f.file", F.col("f.line").cast("string")).alias("first_at"))


def expanded_terms(names: DataFrame, col: str) -> DataFrame:
    """``col, term``: the camel-case pieces of identifiers, of at least three bytes and no stop words, in lower case, each once."""
    chunks = F.split(F.regexp_replace(F.col(col), "::", "."), r"[./\\_-]+")
    pieces = names.select(col, F.explode(F.flatten(F.transform(chunks, camel_pieces))).alias("piece"))
    return pieces.select(col, ascii_lower(F.trim("piece")).alias("term")).filter((F.octet_length("term") >= 3) & ~F.col("term").isin(STOP_WORDS)).distinct()


def unique_basename_links(refs: DataFrame) -> DataFrame:
    """``left, right, n``: packets ``(packet, path)`` that share a file name no third packet has, and no path.

    A name of exactly two packets gives one pair, so a common name gives none.
    """
    name = F.substring_index("path", "/", -1)
    held = refs.select("packet", "path", name.alias("name")).distinct()
    per = held.groupBy("name").agg(F.count_distinct("packet").alias("packets"), F.min("packet").alias("left"), F.max("packet").alias("right")).filter("packets = 2")
    pairs = per.groupBy("left", "right").agg(F.count("*").alias("n"))
    own = held.select("packet", "path").distinct()
    shared = pairs.join(own.withColumnRenamed("packet", "left"), "left").join(own.withColumnRenamed("packet", "right"), ["right", "path"]).select("left", "right").distinct()
    return pairs.join(shared, ["left", "right"], "left_anti").select("left", "right", "n")


#: What makes a changed path none of a step's inputs, by target.
REPORTS = r"(\.info|\.lcov|\.xml)$|coverage|report"
STEP_INPUTS = {
    "mapy.repo": ("not", REPORTS, True),
    "diffy.analyze": ("not", REPORTS + r"|\.log$", False),
    "stacky.slice": ("is", r"(\.log|\.txt)$|report|diagnostic", False),
    "contextq.assemble": ("any", "", True),
    "guardy.check": ("any", "", False),
}


def affected_steps(changed: DataFrame, symbols: DataFrame) -> DataFrame:
    """``task, target, affected``: which steps the changed paths ``(task, path)`` and symbols ``(task, symbol)`` of a task reach.

    One aggregate over the paths; a target that asks for symbols is reached
    by any of them.
    """

    def reached(rule: str, pattern: str) -> Column:
        path = F.col("path")
        hit = F.lit(True) if rule == "any" else path.rlike(pattern) if rule == "is" else ~path.rlike(pattern)
        return F.coalesce(F.bool_or(F.when(F.col("path").isNotNull(), hit)), F.lit(False))

    names = {t: f"p{i}" for i, t in enumerate(STEP_INPUTS)}
    rows = changed.select("task", "path", F.lit(False).alias("symbol")).unionByName(symbols.filter("symbol is not null").select("task", F.lit(None).cast("string").alias("path"), F.lit(True).alias("symbol")))
    per = rows.groupBy("task").agg(F.bool_or("symbol").alias("symbols"), *[reached(*STEP_INPUTS[t][:2]).alias(n) for t, n in names.items()])
    steps = F.array(*[F.struct(F.lit(t).alias("target"), (F.col(n) | (F.col("symbols") if STEP_INPUTS[t][2] else F.lit(False))).alias("affected")) for t, n in names.items()])
    return per.select("task", F.explode(steps).alias("s")).select("task", "s.target", "s.affected")


def fitted(items: DataFrame, *, tokens: int, bytes_: int) -> DataFrame:
    """``grp, id, score`` of the items ``(grp, id, score, tokens, bytes)`` kept when they are taken best first as long as both budgets allow.

    What does not fit is skipped.  One group is folded in one row; take
    groups that one request assembles.
    """
    item = F.struct((-F.col("score")).alias("s"), "id", F.col("tokens").cast("bigint").alias("tokens"), F.col("bytes").cast("bigint").alias("bytes"))
    rows = items.groupBy("grp").agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = rows.schema["items"].dataType.simpleString()
    start = f"named_struct('t', 0L, 'b', 0L, 'kept', cast(array() as {kind}))"
    fits = f"a.t + x.tokens <= {tokens} and a.b + x.bytes <= {bytes_}"
    fold = f"aggregate(items, {start}, (a, x) -> if({fits}, named_struct('t', a.t + x.tokens, 'b', a.b + x.bytes, 'kept', concat(a.kept, array(x))), a))"
    return rows.select("grp", F.explode(F.expr(fold)["kept"]).alias("k")).select("grp", "k.id", (-F.col("k.s")).alias("score"))


def governed(items: DataFrame, *, allowed: list[str], denied_text: str, tokens: int, bytes_: int) -> DataFrame:
    """``fitted`` over the items ``(..., kind, text)`` that policy lets through: kinds of the allow-list, texts without a denied pattern."""
    ok = F.col("kind").isin(allowed) & ~F.coalesce(F.col("text").rlike(denied_text), F.lit(False))
    return fitted(items.filter(ok), tokens=tokens, bytes_=bytes_)


def section_boost(rows: DataFrame, focus: DataFrame, question: list[str]) -> DataFrame:
    """``id, boost``: 0.35 if a path, 0.25 if a symbol of ``(grp, id, paths, symbols, text)`` is in the focus ``(grp, kind, value)`` of its group; up to 0.25 for the share of the question's words in the text."""
    refs = rows.select("id", "grp", F.lit("path").alias("kind"), F.explode("paths").alias("value")).unionByName(rows.select("id", "grp", F.lit("symbol").alias("kind"), F.explode("symbols").alias("value")))
    hits = refs.join(focus.select("grp", "kind", "value").distinct(), ["grp", "kind", "value"], "left_semi").groupBy("id").agg(F.bool_or(F.col("kind") == "path").alias("p"), F.bool_or(F.col("kind") == "symbol").alias("s"))
    low = ascii_lower(F.coalesce("text", F.lit("")))
    matched = sum((low.contains(q).cast("int") for q in question), F.lit(0))
    asked = F.least(matched / len(question) * 0.25, F.lit(0.25)) if question else F.lit(0.0)
    score = F.when(F.col("p"), 0.35).otherwise(0.0) + F.when(F.col("s"), 0.25).otherwise(0.0) + asked
    return rows.join(hits, "id", "left").select("id", F.round(score, 6).alias("boost"))


def regions(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """``id, line_no, text``: the lines ``(id, line_no, text)`` in the ranges ``(id, first, last)``, each once."""
    hit = lines.join(wanted, "id").filter("line_no between first and last").select("id", "line_no").distinct()
    return lines.join(hit, ["id", "line_no"], "left_semi").select("id", "line_no", "text")


def first_per_file(matches: DataFrame) -> DataFrame:
    """``id, line_no, more``: the first match of each document and how many follow."""
    return matches.groupBy("id").agg(F.min("line_no").alias("line_no"), (F.count("*") - 1).alias("more"))


def listed(entries: DataFrame, *, target: str | None = None, query: str | None = None, since: int | None = None, until: int | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
    """One page of stored entries ``(id, target, text, created)``: newest first, then by id; conditions that are None do not count."""
    rows = entries
    if target is not None:
        rows = rows.filter(ascii_lower(F.col("target")).contains(target.lower()))
    if query is not None:
        rows = rows.filter(ascii_lower(F.col("text")).contains(query.lower()))
    if since is not None:
        rows = rows.filter(F.col("created") >= since)
    if until is not None:
        rows = rows.filter(F.col("created") <= until)
    return rows.orderBy(F.desc("created"), "id").offset(offset).limit(limit)


def _holds(part: str):
    return lambda x: ascii_lower(x).contains(part.lower())


def recalled(entries: DataFrame, *, target: str | None = None, since: int | None = None, until: int | None = None, types: tuple[str, ...] = (), task: str | None = None, scope: str = "global") -> DataFrame:
    """Entries ``(target, created, types, task, ...)`` that recall may score, with ``local``, whether they are of the task.

    Every one of ``types`` must be part of a type of the entry.  Scope
    ``task_only`` keeps the entries of the task (none without one), the
    others keep all.
    """
    rows = entries.withColumn("local", F.coalesce(F.col("task") == task, F.lit(False)) if task is not None else F.lit(False))
    if target is not None:
        rows = rows.filter(ascii_lower(F.col("target")).contains(target.lower()))
    if since is not None:
        rows = rows.filter(F.col("created") >= since)
    if until is not None:
        rows = rows.filter(F.col("created") <= until)
    for t in types:
        rows = rows.filter(F.size(F.filter("types", _holds(t))) > 0)
    return rows.filter("local") if scope == "task_only" else rows


def bigrams(col: Column) -> Column:
    """The distinct two-character substrings."""
    n = F.length(col)
    return F.when(n >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(col, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))
