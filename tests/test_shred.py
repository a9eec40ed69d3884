"""Shredding: round trip, uneven shapes, wrappers, edge cases."""

import json
from datetime import datetime

from artefold.operators import shred
from artefold.plans.p_queries import ENTITIES

SCHEMA = "record_id long, packet_id string, recorded_at timestamp, body string, label string"


def packets(spark, *bodies):
    return spark.createDataFrame([(i, f"p{i}", datetime(2025, 1, 1), b, "clash") for i, b in enumerate(bodies)], SCHEMA)


def places(spark, body):
    df = shred.shred(packets(spark, body), body="body", keys=["packet_id"])
    return sorted((r.node_path, r.parent_path) for r in shred.elements(df, ["packet_id"]).collect())


def test_nesting_nulls_lone_objects_and_text_that_holds_json(spark):
    body = {
        "files": ["a", None, {"path": "b"}], "symbols": {"name": "f"}, "provenance": {"inputs": ["i", None, "j"]},
        "payload": json.dumps(json.dumps({"groups": [{"diagnostics": {"file": "x", "related": [{"line": 1}]}, "children": json.dumps([{"diagnostics": [None, {"line": 2}]}])}], "files": ["no element"], "tests": None, "refs": "text"})),
    }
    g = "/payload/groups/0"
    want = [("/files/0", ""), ("/files/2", ""), (g, ""), (f"{g}/children/0", g), (f"{g}/children/0/diagnostics/1", f"{g}/children/0"), (f"{g}/diagnostics/0", g), (f"{g}/diagnostics/0/related/0", f"{g}/diagnostics/0"), ("/provenance/inputs/0", ""), ("/provenance/inputs/2", ""), ("/symbols/0", "")]
    assert places(spark, json.dumps(body)) == sorted(want)
    assert places(spark, json.dumps({"schema_version": 1, "packet": json.dumps(body)})) == sorted(want)
    assert places(spark, json.dumps(json.dumps(body))) == sorted(want)


def test_unreadable_bodies_give_no_rows(spark):
    df = shred.shred(packets(spark, None, "", "{", "[1]", '"x"', "7", '{"files": [tru'), body="body", keys=["packet_id"])
    assert df.collect() == []
    assert shred.shred(packets(spark, "{}").limit(0), body="body", keys=["packet_id"]).collect() == []


def _rebuilt(rows):
    value, below = {}, {}
    for r in rows:
        below.setdefault(r.parent_id, []).append(r)
    cast = {"string": str, "integer": int, "decimal": float, "boolean": lambda x: x == "true"}

    def make(r):
        own = sorted(below.get(r.node_id, []), key=lambda x: x.node_id)
        if r.kind == "object":
            out = {}
            for c in own:
                if c.entity or c.node_path.rsplit("/", 2)[-2] == c.label and c.kind == "null" and c.node_path.rsplit("/", 1)[-1].isdigit():
                    out.setdefault(c.label, []).append(make(c))
                else:
                    out[c.label] = make(c)
            return out
        if r.kind == "array":
            return [make(c) for c in own]
        return None if r.kind == "null" else cast[r.kind](r.scalar)

    return make(below[None][0])


def test_round_trip(spark):
    body = {"files": [{"path": "a", "n": 1}, None, "s"], "x": [[1, 2.5], {"y": True}], "e": {}, "none": None, "payload": {"findings": [{"evidence": ["q"]}], "deep": {"a": {"b": ["c", None]}}}}
    rows = shred.shred(packets(spark, json.dumps(body)), body="body", keys=["packet_id"]).collect()
    assert _rebuilt(rows) == body


def test_first_readable_record_of_a_packet(spark):
    rows = [(1, "p", datetime(2025, 1, 1), "{bad", ""), (2, "p", datetime(2025, 1, 3), '{"files": ["late"]}', ""), (3, "p", datetime(2025, 1, 2), '{"files": ["x"]}', ""), (4, None, None, "{}", ""), (5, None, None, "{}", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = shred.one_record_each(df, key="packet_id", row_id="record_id", at="recorded_at", body="body")
    assert sorted(r.record_id for r in kept.collect()) == [3, 4, 5]


def test_entity_tables_type_their_fields_and_keep_the_rest(spark):
    body = {"files": [{"path": "a", "relevance": 0.5, "odd": 1, "more": {"deep": 1}}, "plain", {"relevance": "x"}]}
    adjacency = shred.shred(packets(spark, json.dumps(body)), body="body", keys=["packet_id"])
    rows = {r.ordinal: r for r in shred.entity_table(adjacency, "files", ENTITIES["files"], ["packet_id"]).collect()}
    assert rows[0].path == "a" and rows[0].relevance == 0.5 and json.loads(rows[0].rest) == {"odd": "1"}
    assert rows[1].value == "plain" and rows[2].relevance is None and rows[2].path is None and len(rows) == 3


def test_very_long_document(spark):
    body = json.dumps({"files": [f"f{i}" for i in range(50_000)]})
    df = shred.elements(shred.shred(packets(spark, body), body="body", keys=["packet_id"]), ["packet_id"])
    assert df.count() == 50_000
