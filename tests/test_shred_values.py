"""Every scalar of a packet comes out in exactly one table."""

import json
from collections import Counter
from datetime import datetime

from artefold.operators import shred
from artefold.plans.p_queries import ENTITIES, PARTS, _adjacency
from artefold.plans.registry import queries

SCHEMA = "record_id long, packet_id string, recorded_at timestamp, body string, label string"


def _count(row, fields):
    """How many scalars a row of an entity table holds."""
    return sum(row[c] is not None for c in {"value", *fields}) + len(json.loads(row.rest or "{}")) + len(json.loads(row.nested or "[]"))


def test_plain_arrays_and_objects_of_an_element_are_kept(spark):
    body = {"tool": "t", "budget_cost": {"est_tokens": 5}, "payload": {"unique": 3, "tests": [{"id": "x", "covers": [{"path": "a", "lines": list(range(12)), "o": {"p": {"q": True}}, "o/p": 1, "none": [None]}, [7, 8], "text"]}]}}
    df = spark.createDataFrame([(0, "p", datetime(2025, 1, 1), json.dumps(body), "")], SCHEMA)
    adjacency = shred.shred(df, body="body", keys=["packet_id"])
    rows = {r.ordinal: r for r in shred.entity_table(adjacency, "covers", ENTITIES["covers"], ["packet_id"]).collect()}
    assert [(x["path"], x["value"]) for x in json.loads(rows[0].nested)] == [(f"lines/{i}", str(i)) for i in range(12)] + [("o/p/q", "true")]
    assert rows[0].path == "a" and json.loads(rows[0].rest) == {"o/p": "1"}
    assert [x["value"] for x in json.loads(rows[1].nested)] == ["7", "8"] and rows[1].rest is None and rows[2].value == "text"
    tests = shred.entity_table(adjacency, "tests", ENTITIES["tests"], ["packet_id"]).collect()
    assert [(r.id, r.rest, r.nested) for r in tests] == [("x", None, None)]
    assert sorted((r.node_path, r.value) for r in shred.plain_scalars(adjacency, ["packet_id"]).collect()) == [("/budget_cost/est_tokens", "5"), ("/payload/unique", "3"), ("/tool", "t")]


def test_no_scalar_of_the_small_tables_is_lost(spark, small):
    nodes = _adjacency(spark, small).filter("scalar is not null").collect()
    got, every = Counter(), queries()
    for name in ENTITIES:
        for r in every[f"p3_{name}"](spark, small).collect():
            got[r.packet_id] += _count(r, ENTITIES[name])
    for name in PARTS:
        for r in every[f"p3_{name}"](spark, small).collect():
            got[r.packet_id] += 1
    assert got == Counter(r.packet_id for r in nodes)
