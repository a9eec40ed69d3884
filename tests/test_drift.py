"""Schema drift: against brute force on the test tables, and the stated edge cases."""

import json
from datetime import datetime


from artefold.operators import drift
from artefold.plans.p_queries import STORES, APPROVED

KEYS = {s.array: s.key for s in STORES}


def _type(v):
    return {bool: "boolean", int: "integer", float: "decimal", str: "string", list: "array", dict: "object"}[type(v)]


def brute(rows):
    """Changes by plain loops over the files of each stream."""
    out, state, done = [], {}, set()
    for file_id, stream, _, content in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if file_id in done:
            continue
        try:
            doc = json.loads(content)
        except (ValueError, TypeError):
            continue
        if not isinstance(doc, dict):
            continue
        done.add(file_id)
        array = next((a for a in KEYS if a in doc), None)
        root = {"": {k: v for k, v in doc.items() if k != array and v is not None}}
        recs = {r[KEYS[array]]: {f"{array}.{k}": v for k, v in r.items() if v is not None} for r in (doc.get(array) or [])} if array else {}
        for part, now in (("root", root), ("rec", recs)):
            if not now:
                continue
            was = state.get((stream, part))
            state[stream, part] = now
            if was is None:
                continue
            types = [{}, {}]
            for i, side in enumerate((was, now)):
                for r in side.values():
                    for k, v in r.items():
                        types[i].setdefault(k, []).append(_type(v))
            types = [{k: max(set(v), key=v.count) for k, v in t.items()} for t in types]
            gone, come = set(types[0]) - set(types[1]), set(types[1]) - set(types[0])
            best = []
            for a in gone:
                for b in come:
                    both = [(was[k][a], now[k][b]) for k in was if k in now and a in was[k] and b in now[k]]
                    same = sum(json.dumps(x, sort_keys=True) == json.dumps(y, sort_keys=True) for x, y in both)
                    if both and same / len(both) >= (1 if types[0][a] == "boolean" else 0.5):
                        best.append((-same / len(both), -same, a, b))
            for _, _, a, b in sorted(best):
                if a in gone and b in come:
                    out.append((file_id, "renamed", a, b))
                    gone.discard(a)
                    come.discard(b)
            out += [(file_id, "removed", a, "") for a in gone] + [(file_id, "added", b, "") for b in come]
            out += [(file_id, "retyped", k, "") for k in types[0] if k in types[1] and types[0][k] != types[1][k]]
    return sorted(out)


def test_changes_equal_brute_force(spark, small):
    files = spark.read.parquet(f"{small}/state_files.parquet")
    rows = [(r.file_id, r.stream_id, r.written_at, r.content) for r in files.collect()]
    got = sorted(tuple(r) for r in drift.changes(files, STORES).collect())
    assert got == brute(rows) and got


SCHEMA = "file_id bigint, stream_id string, file_name string, written_at timestamp, ingested_at timestamp, content string"


def _files(spark, *contents, stream="s"):
    rows = [(i, stream, "f", datetime(2025, 1, 1 + i), datetime(2025, 2, 1), c) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, SCHEMA)


def test_files_without_records_broken_and_null_are_compared_across(spark):
    files = _files(
        spark,
        '{"version": 1, "entries": [{"cache_key": "a", "target": "x"}]}',
        '{"version": 1, "entries": []}',
        None,
        "",
        '{"version": 2, "entr',
        "[1]",
        '{"version": "2", "entries": [{"cache_key": "a", "goal": "x", "n": null}]}',
    )
    files = files.unionByName(files)  # ingested twice
    assert sorted(tuple(r) for r in drift.changes(files, STORES).collect()) == [(6, "renamed", "entries.target", "entries.goal"), (6, "retyped", "version", "")]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert drift.changes(empty, STORES).collect() == []
    assert drift.replay(drift.ingest(empty, STORES), STORES[0], {}, APPROVED).collect() == []


def test_replay_types_former_names_units_text_and_keeps_the_rest(spark):
    files = _files(
        spark,
        json.dumps({"version": 1, "entries": [{"cache_key": "a", "runtime_ms": 5, "token_usage": {"v": 7, "unit": None}, "odd": [1]}, {"cache_key": "b", "runtime_ms": "6", "token_usage": 1.5, "it's": 1}, {"cache_key": "c", "wall": 8, "created_at_unix": "2025-01-01T00:00:01Z"}, 3]}),
    )
    got = {r.cache_key: r for r in drift.replay(drift.ingest(files, STORES), STORES[0], {"entries.wall": "entries.runtime_ms"}, {}).collect()}
    assert [got[k].runtime_ms for k in "abc"] == [5, 6, 8]
    assert got["a"].token_usage == 7 and json.loads(got["a"].rescued) == {"odd": [1]}
    assert got["b"].token_usage is None and json.loads(got["b"].rescued) == {"token_usage": 1.5, "it's": 1}
    assert got["c"].created_at_unix == 1735689601 and got["c"].rescued is None
    assert json.loads(got[None].rescued) == {"": 3}


def test_aliases_follow_chains(spark):
    found = spark.createDataFrame([(1, "renamed", "entries.target", "entries.t"), (2, "renamed", "entries.t", "entries.T"), (3, "renamed", "entries.odd", "entries.even")], "file_id long, change_type string, field_path string, new_path string")
    assert drift.aliases(found, STORES) == {"entries.t": "entries.target", "entries.T": "entries.target"}
