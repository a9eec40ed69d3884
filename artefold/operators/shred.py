"""Adjacency-table shredding of nested JSON into related flat tables.

``shred`` stores every node of every document as a row: node, parent, label,
ordinal, kind and scalar, with the place of the node and of the nearest listed
element around it.  ``entity_table`` puts object nodes together with their
scalar children and pivots them into the table of one kind of element.

A document is walked in one pass within its own row, in Arrow batches, since
its depth is open and Catalyst has no operator for that; all that follows is
relational.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_FIELDS = "node_id bigint, parent_id bigint, label string, ordinal int, kind string, scalar string, node_path string, parent_path string, entity string, owner_id bigint"

#: The arrays whose elements are entities, below ``payload``.
PAYLOAD_LISTS = (
    "failures", "frames", "groups", "children", "diagnostics", "related", "tests", "covers",
    "blocks", "sections", "refs", "findings", "evidence", "changes", "hunks",
)
#: Those at other places of the envelope.
ENVELOPE_LISTS = (("", "files"), ("", "symbols"), ("/provenance", "inputs"))


@dataclass(frozen=True)
class ShredSpec:
    """What counts as an element: ``fixed`` gives (path, label) pairs, ``anywhere`` labels at any depth below ``below``."""

    fixed: tuple[tuple[str, str], ...] = ENVELOPE_LISTS
    anywhere: tuple[str, ...] = PAYLOAD_LISTS
    below: str = "/payload"
    wrapper: str = "packet"


def decoded(value):
    """``value``, or what it holds where it is text that holds a JSON object or array, however often encoded."""
    held, first = value, True
    while isinstance(held, str) and held.lstrip()[:1] in ("{", "[", '"'):
        try:
            held = json.loads(held)
        except (ValueError, RecursionError):
            return value
    return held if isinstance(held, (dict, list)) else value


def envelope(body: str | None, spec: ShredSpec) -> dict | None:
    """The plain envelope in ``body``: decoded and without wrappers; None where unreadable."""
    if not isinstance(body, str):
        return None
    try:
        found = decoded(json.loads(body))
    except (ValueError, RecursionError):
        return None
    while isinstance(found, dict) and spec.wrapper in found and "payload" not in found:
        inner = decoded(found[spec.wrapper])
        if not isinstance(inner, dict):
            break
        found = inner
    return found if isinstance(found, dict) else None


def _kind(value) -> str:
    if value is None:
        return "null"
    for types, name in (((bool,), "boolean"), ((int,), "integer"), ((float,), "decimal"), ((str,), "string"), ((list,), "array")):
        if isinstance(value, types):
            return name
    return "object"


def nodes(root: dict, spec: ShredSpec) -> Iterator[tuple]:
    """The rows of one document in document order; a JSON null is a node of kind ``null``."""
    lists, fixed = frozenset(spec.anywhere), frozenset(spec.fixed)
    number = 0
    todo = [(root, None, None, None, "", "", None, None)]
    while todo:
        value, parent, label, ordinal, path, around, entity, owner = todo.pop()
        value = decoded(value)
        kind, me = _kind(value), number
        number += 1
        scalar = None
        if kind == "string":
            scalar = value
        elif kind not in ("object", "array", "null"):
            scalar = json.dumps(value)
        yield me, parent, label, ordinal, kind, scalar, path, around, entity if kind != "null" else None, owner
        inner, holder = (path, me) if entity and kind != "null" else (around, owner)
        below = []
        if kind == "object":
            inside = path == spec.below or path.startswith(spec.below + "/")
            for i, (k, v) in enumerate(value.items()):
                v = decoded(v)
                at = f"{path}/{k}"
                if (path, k) in fixed or (inside and k in lists):
                    if isinstance(v, list):
                        below += [(x, me, k, j, f"{at}/{j}", inner, k, holder) for j, x in enumerate(v)]
                        continue
                    if isinstance(v, dict):
                        below.append((v, me, k, 0, f"{at}/0", inner, k, holder))
                        continue
                below.append((v, me, k, i, at, inner, None, holder))
        elif kind == "array":
            below = [(x, me, label, j, f"{path}/{j}", inner, None, holder) for j, x in enumerate(value)]
        todo += reversed(below)


def shred(df: DataFrame, *, body: str, keys: list[str], spec: ShredSpec = ShredSpec()) -> DataFrame:
    """The adjacency table of the JSON texts in ``body``: ``keys`` and the node columns.

    ``entity`` names the list a node is an element of, else null; ``owner_id``
    is the node of the nearest listed element around, at ``parent_path``.  Null and
    unreadable bodies give no rows; clashing column names in ``df`` do not
    matter, as only ``keys`` and ``body`` are read.
    """
    source = df.select(*keys, F.col(body).alias("__body"))
    names = [f.split()[0] for f in NODE_FIELDS.split(", ")]
    schema = ", ".join([f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys] + [NODE_FIELDS])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for *key, text in pdf.itertuples(index=False, name=None):
                root = envelope(text, spec)
                if root is not None:
                    rows += [(*key, *n) for n in nodes(root, spec)]
                if len(rows) > 200_000:  # very large documents leave in several batches
                    yield pd.DataFrame(rows, columns=[*keys, *names])
                    rows = []
            yield pd.DataFrame(rows, columns=[*keys, *names])

    return source.mapInPandas(run, schema)


def one_record_each(df: DataFrame, *, key: str, row_id: str, at: str, body: str) -> DataFrame:
    """``df`` with one row for each ``key``: the first readable by ``at``, then ``row_id``.

    Only keys recorded more than once are looked up, so bodies are not
    shuffled for the sake of a few copies.  Rows with a null key are each
    their own.  The ``row_id`` must be unique and not null.
    """
    rank = F.struct(F.expr(f"try_parse_json(`{body}`)").isNull().alias("unreadable"), F.col(at).alias("at"), F.col(row_id).alias("row"))
    firsts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(rank).alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = df.select(key, row_id).join(firsts, key).filter(F.col(row_id) != F.col("first.row")).select(row_id)
    return df.join(copies, row_id, "left_anti").select(*df.columns)


def elements(adjacency: DataFrame, keys: list[str]) -> DataFrame:
    """The non-null elements of the listed arrays: ``keys, entity, node_id, node_path, parent_path, ordinal``."""
    return adjacency.filter("entity is not null").select(*keys, "entity", "node_id", "node_path", "parent_path", "ordinal")


def entity_table(adjacency: DataFrame, entity: str, fields: dict[str, str], keys: list[str]) -> DataFrame:
    """One row for each element of ``entity``: keys, places, ``value`` and the scalar ``fields``.

    ``fields`` maps a label to its type; text that cannot be cast gives null
    and stands in ``rest``.  ``value`` is the text of an element that is itself
    a scalar, or the field of that name.  Other scalar children go to the JSON
    object ``rest``; scalars deeper in the element,
    such as those of plain arrays and objects, to the JSON array ``nested`` of
    their ``path`` below the element and ``value``, in document order.  So
    none is lost.  What lies in a listed element inside belongs to that one.
    Element nodes and what they own meet on the document and node id.
    """
    own = F.col("entity").isNotNull()
    path = F.expr("substring(node_path, length(parent_path) + 2)")
    direct = ~F.col("own") & (F.col("path") == F.col("label"))
    deeper = ~F.col("own") & (F.col("path") != F.col("label"))
    rows = adjacency.filter((F.col("entity") == entity) | (F.col("entity").isNull() & F.col("scalar").isNotNull() & F.col("owner_id").isNotNull()))
    rows = rows.select(*keys, F.when(own, F.col("node_id")).otherwise(F.col("owner_id")).alias("at"), own.alias("own"), path.alias("path"), "node_id", "label", "scalar", "node_path", "parent_path", "ordinal")
    typed = F.lit(False)
    for f, t in fields.items():
        typed = typed | ((F.col("label") == f) & F.col("scalar").try_cast(t).isNotNull())
    of = lambda c: F.max(F.when(F.col("own"), F.col(c)))
    held = rows.groupBy(*keys, "at").agg(
        of("node_path").alias("node_path"),
        of("parent_path").alias("parent_path"),
        of("ordinal").alias("ordinal"),
        of("scalar").alias("value"),
        *[F.max(F.when(direct & (F.col("label") == f), F.col("scalar"))).try_cast(t).alias(f"f_{f}") for f, t in fields.items()],
        F.sort_array(F.collect_list(F.when(direct & ~typed, F.struct("label", "scalar")))).alias("__rest"),
        F.sort_array(F.collect_list(F.when(deeper, F.struct("node_id", "path", F.col("scalar").alias("value"))))).alias("__nested"),
    )
    rest = F.when(F.size("__rest") > 0, F.to_json(F.map_from_entries("__rest"))).alias("rest")
    nested = F.when(F.size("__nested") > 0, F.to_json(F.transform("__nested", lambda x: F.struct(x["path"].alias("path"), x["value"].alias("value"))))).alias("nested")
    value = F.coalesce("value", "f_value").alias("value") if "value" in fields else F.col("value")
    return held.filter("node_path is not null").select(*keys, "node_path", "parent_path", "ordinal", value, *[F.col(f"f_{f}").alias(f) for f in fields if f != "value"], rest, nested)


def plain_scalars(adjacency: DataFrame, keys: list[str]) -> DataFrame:
    """The scalars that lie in no listed element: ``keys, node_path, kind, value``."""
    return adjacency.filter("entity is null and owner_id is null and scalar is not null").select(*keys, "node_path", "kind", F.col("scalar").alias("value"))
