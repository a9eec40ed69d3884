"""Packets: extraction, hashes, merging, ranking and assembly on small cases."""

import pytest
from pyspark.sql import functions as F

from artefold.operators import packets as P
from artefold.operators import state as S


def test_first_balanced():
    assert P.first_balanced('noise {"a": "}{", "b": {"c": "\\""}} tail {"x": 1}') == '{"a": "}{", "b": {"c": "\\""}}'
    assert P.first_balanced("log [1, [2]] more", "[") == "[1, [2]]"
    assert P.first_balanced("open { never") is P.first_balanced(None) is P.first_balanced("") is None


def test_extracted_and_nodes_edge_cases(spark):
    df = spark.createDataFrame([(1, 'x {"a": [1, null, "t"]} y'), (2, None), (3, ""), (4, "{ open"), (5, '{"path": true}')], "id long, body string")
    got = {r.id: r.found for r in P.extracted(df, id_col="id", text_col="body").collect()}
    assert got == {1: '{"a": [1, null, "t"]}', 5: '{"path": true}'}
    nodes = P.json_nodes(spark.createDataFrame([(1, '{"a": [1, null, "t"], "b": {}}'), (2, "broken"), (3, None)], "id long, body string"), body="body", keys=["id"])
    assert [(r.path, r.kind, r["size"], r.text) for r in nodes.collect()] == [("$", "object", 2, None), ("$.a", "array", 3, None), ("$.a[0]", "number", None, None), ("$.a[1]", "null", None, None), ("$.a[2]", "string", None, "t"), ("$.b", "object", 0, None)]
    assert P.json_nodes(df.limit(0), body="body", keys=["id"]).collect() == []


def test_envelope_hash_leaves_out_what_differs_between_runs(spark):
    a = '{"tool": "t", "hash": "1", "budget_cost": {"runtime_ms": 5, "est_tokens": 1, "tool_calls": 2}, "provenance": {"generated_at_unix": 9}}'
    b = '{"budget_cost": {"tool_calls": 2, "est_bytes": 7}, "provenance": {"generated_at_unix": 1}, "hash": "2", "tool": "t"}'
    c = b.replace('"t"}', '"u"}')
    h = [r[0] for r in spark.createDataFrame([(x,) for x in (a, b, c, "[]", "no", None)], "b string").select(P.envelope_hash(F.col("b"))).collect()]
    assert h[0] == h[1] != h[2] and h[3:] == [None] * 3


def test_strict_merge_is_an_error(spark):
    df = spark.createDataFrame([("s", "{}"), ("s", "no"), ("t", None)], "s string, c string")
    ok = F.expr("try_parse_json(c)").isNotNull()
    assert {tuple(r) for r in P.merged(df, ok, by=["s"]).collect()} == {("s", 1, 1), ("t", 0, 1)}
    with pytest.raises(Exception, match="cannot be read"):
        P.merged(df, ok, by=["s"], strict=True).collect()


def test_size_that_counts_itself(spark):
    got = [r[0] for r in spark.createDataFrame([(8,), (9,), (98,), (997,)], "n int").select(P.self_sized(F.col("n"))).collect()]
    assert got == [9, 11, 101, 1001] and all(g == n + len(str(g)) for g, n in zip(got, (8, 9, 98, 997)))


def test_fit_skips_what_exceeds_either_budget(spark):
    items = spark.createDataFrame([("g", 1, 0.9, 60, 10), ("g", 2, 0.8, 50, 10), ("g", 3, 0.7, 40, 95), ("g", 4, 0.6, 40, 90), ("h", 5, 0.1, 0, 0)], "grp string, id long, score double, tokens long, bytes long")
    assert {r.id for r in P.fitted(items, tokens=100, bytes_=100).collect()} == {1, 4, 5}
    assert P.fitted(items.limit(0), tokens=1, bytes_=1).collect() == []


def test_agent_parts_add_remove_and_clear(spark):
    e = [
        ("t", 1, 1, "focus_set", ["a", "b"], ["s"], "{}"), ("t", 2, 1, "focus_cleared", ["a"], [], "{}"), ("t", 3, 1, "focus_set", ["c"], None, "{}"),
        ("t", 4, 1, "decision_added", [], [], '{"decision_id": "d1"}'), ("t", 5, 1, "decision_added", [], [], '{"decision_id": "d2", "supersedes": "d1"}'),
        ("t", 6, 1, "question_opened", [], [], '{"question_id": "q1"}'), ("t", 7, 1, "question_resolved", [], [], '{"question_id": "q1"}'), ("t", 8, 1, "question_opened", [], [], '{"question_id": "q2"}'),
        ("t", 9, 1, "file_edited", ["x"], ["f"], "{}"), ("t", 10, 1, "checkpoint_saved", ["k"], [], '{"checkpoint_id": "c1"}'), ("t", 11, 1, "file_edited", ["y"], [], "{}"),
        ("u", 1, 1, "focus_set", ["z"], ["s"], "{}"), ("u", 2, 1, "focus_cleared", [], [], '{"clear_all": true}'), ("u", 3, 1, "file_read", None, None, None),
    ]
    df = spark.createDataFrame(e, "task string, at long, event_id long, kind string, paths array<string>, symbols array<string>, data_json string")
    want = {("t", "focus_paths", "b"), ("t", "focus_paths", "c"), ("t", "focus_symbols", "s"), ("t", "decisions", "d2"), ("t", "open_questions", "q2"), ("t", "files_edited", "x"), ("t", "files_edited", "y"), ("t", "changed_paths", "y"), ("t", "checkpoint_paths", "k"), ("t", "checkpoint", "c1")}
    assert {tuple(r) for r in S.agent_parts(df).collect()} == want
    assert S.agent_parts(df.limit(0)).collect() == []
