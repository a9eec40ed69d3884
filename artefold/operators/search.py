"""Regular-expression search with an n-gram index.

``plan`` turns a pattern into a formula of substrings every match must hold;
``candidates`` answers the formula on the posting table; ``verify`` checks the
pattern line by line.  The index only prunes: results equal a full scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as sre
from re import _parser

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from artefold.functions.text import trigrams


@dataclass(frozen=True)
class Plan:
    """``kind`` is all (no constraint), grams (all of ``grams``), and, or."""

    kind: str
    grams: tuple[str, ...] = ()
    parts: tuple["Plan", ...] = ()


ALL = Plan("all")


def _literal(text: str) -> Plan:
    return Plan("grams", tuple(dict.fromkeys(text[i : i + 3] for i in range(len(text) - 2)))) if len(text) >= 3 else ALL


def _join(kind: str, parts: list[Plan]) -> Plan:
    if kind == "or" and any(p.kind == "all" for p in parts):
        return ALL
    parts = [p for p in parts if p.kind != "all"]
    return ALL if not parts else parts[0] if len(parts) == 1 else Plan(kind, parts=tuple(parts))


def plan(pattern: str) -> Plan:
    """What any match of ``pattern`` must hold; ``all`` for patterns that ignore case."""
    tree = _parser.parse(pattern)
    if tree.state.flags & sre.SRE_FLAG_IGNORECASE:
        return ALL

    def walk(items) -> Plan:
        parts, run = [], ""
        for op, arg in items:
            if op is sre.LITERAL:
                run += chr(arg)
                continue
            if op is sre.SUBPATTERN and not arg[1] and not arg[2] and all(o is sre.LITERAL for o, _ in arg[3]):
                run += "".join(chr(a) for _, a in arg[3])
                continue
            parts.append(_literal(run))
            run = ""
            if op is sre.SUBPATTERN:
                parts.append(ALL if arg[1] & sre.SRE_FLAG_IGNORECASE else walk(arg[3]))
            elif op is sre.BRANCH:
                parts.append(_join("or", [walk(b) for b in arg[1]]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                parts.append(walk(arg[2]))
        parts.append(_literal(run))
        return _join("and", parts)

    return walk(tree)


def needed(formula: Plan) -> tuple[str, ...]:
    """The grams a formula speaks of."""
    return tuple(dict.fromkeys((*formula.grams, *(g for p in formula.parts for g in needed(p)))))


def index(docs: DataFrame, id_col: str, text_col: str, *, only: tuple[str, ...] | None = None) -> DataFrame:
    """``gram, id``: each distinct trigram of each document.

    A store writes all of them once, partitioned on ``gram``; without a store
    the postings of the ``only`` few grams a search needs are found by plain
    containment, which is much cheaper than listing every gram of every text.
    """
    text = F.col(text_col)
    grams = trigrams(text) if only is None else F.filter(F.array(*[F.lit(g) for g in only]), lambda g: F.contains(text, g))
    return docs.filter(F.length(text_col) >= 3).select(F.col(id_col).alias("id"), F.explode(grams).alias("gram"))


def candidates(grams: DataFrame, formula: Plan) -> DataFrame | None:
    """``id`` of documents that satisfy the formula; None where it excludes nothing.

    One pass over the postings: a document's needed grams, bounded by the
    pattern, are gathered and the formula is evaluated on them.
    """
    if formula.kind == "all":
        return None

    def holds(f: Plan):
        if f.kind == "grams":
            parts = [F.array_contains("held", g) for g in f.grams]
        else:
            parts = [holds(p) for p in f.parts]
        out = parts[0]
        for p in parts[1:]:
            out = (out | p) if f.kind == "or" else (out & p)
        return out

    held = grams.filter(F.col("gram").isin(*needed(formula))).groupBy("id").agg(F.collect_set("gram").alias("held"))
    return held.filter(holds(formula)).select("id")


def verify(lines: DataFrame, pattern: str, *, fixed: bool = False) -> DataFrame:
    """The lines that match, of ``(id, line_no, text)``."""
    return lines.filter(F.col("text").contains(pattern) if fixed else F.col("text").rlike(pattern))


def indexed_search(docs: DataFrame, id_col: str, text_col: str, pattern: str, *, grams: DataFrame | None = None) -> DataFrame:
    """``id, line_no, text`` of all matching lines, found through the index."""
    formula = plan(pattern)
    found = candidates(index(docs, id_col, text_col, only=needed(formula)) if grams is None else grams, formula)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    if found is not None:
        rows = rows.join(found, "id", "left_semi")
    return verify(rows.select("id", F.posexplode(F.split("t", "\n")).alias("p", "text")).select("id", (F.col("p") + 1).alias("line_no"), "text"), pattern)


def shown(matches: DataFrame, *, per_doc: int = 12, total: int = 50) -> DataFrame:
    """What a result list shows: by document and line, at most ``per_doc`` of each and ``total`` in all (1 to 200)."""
    w = Window.partitionBy("id").orderBy("line_no")
    return matches.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= per_doc).drop("k").orderBy("id", "line_no").limit(min(max(total, 1), 200))


def overlaid(base: DataFrame, overlay: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Base rows that are neither replaced nor deleted, and the overlay without deleted ones."""
    kept = base.join(overlay.select(key).distinct(), key, "left_anti").join(deleted.select(key).distinct(), key, "left_anti")
    return kept.unionByName(overlay.join(deleted.select(key).distinct(), key, "left_anti"))
