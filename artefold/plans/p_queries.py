"""Queries of the general problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from artefold.operators import drift, exactly_once, logmine, shred
from artefold.session import scratch_path, table


def _admission(spark: SparkSession, sf_dir: str, admit) -> DataFrame:
    """The table in two batches by time of delivery, one after the other against one store of seen identifiers."""
    store = exactly_once.SeenStore(spark, scratch_path(spark, "seen"))
    first, *later = [admit(b, store) for b in exactly_once.batches_by_time(table(spark, sf_dir, "agent_events"), 2)]
    for more in later:
        first = first.unionByName(more)
    return first


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivery that is not the first of its event."""
    return _admission(spark, sf_dir, exactly_once.repeated_rows)


def p5_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, each once, as first delivered; deliveries without a usable id stay."""
    return _admission(spark, sf_dir, exactly_once.admitted_rows)


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = table(spark, sf_dir, "packets")
    return shred.one_record_each(packets, key="packet_id", row_id="record_id", at="recorded_at", body="body")


def _adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred.shred(_packets(spark, sf_dir), body="body", keys=["packet_id"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element of the listed arrays with the element around it."""
    return shred.elements(_adjacency(spark, sf_dir), ["packet_id"]).select("packet_id", "node_path", "parent_path")


#: Typed scalar fields of each entity; other scalars go to ``rest``.
ENTITIES: dict[str, dict[str, str]] = {
    "files": {"path": "string", "relevance": "double", "source": "string"},
    "symbols": {"name": "string", "file": "string", "kind": "string", "relevance": "double"},
    "inputs": {},
    "failures": {"fingerprint": "string", "message": "string", "occurrences": "bigint"},
    "frames": {"function": "string", "file": "string", "line": "bigint", "actionable": "boolean"},
    "groups": {"root_cause": "string", "severity": "string"},
    "children": {"root_cause": "string", "severity": "string"},
    "diagnostics": {"file": "string", "line": "bigint", "severity": "string", "message": "string", "code": "string", "column": "bigint"},
    "related": {"file": "string", "line": "bigint"},
    "tests": {"id": "string", "confidence": "double"},
    "covers": {"path": "string"},
    "blocks": {"start": "bigint", "end": "bigint"},
    "sections": {"title": "string", "body": "string"},
    "refs": {"kind": "string", "value": "string"},
    "findings": {"rule": "string", "relation": "string", "confidence": "double"},
    "evidence": {"kind": "string", "value": "string"},
    "changes": {"path": "string", "status": "string"},
    "hunks": {"start": "bigint", "count": "bigint"},
}


def _entity(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shred.entity_table(_adjacency(spark, sf_dir), name, ENTITIES[name], ["packet_id"])

    run.__doc__ = f"The flat table of the {name} elements."
    return run


#: The parts of a packet whose scalars outside the listed arrays have a table each.
PARTS = {
    "envelope": "node_path not like '/provenance/%' and node_path not like '/payload/%'",
    "provenance": "node_path like '/provenance/%'",
    "payload": "node_path like '/payload/%'",
}


def _part(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shred.plain_scalars(_adjacency(spark, sf_dir), ["packet_id"]).filter(PARTS[name])

    run.__doc__ = f"The scalars of the {name} outside the listed arrays, by packet and place."
    return run


#: Target schemas of the three kinds of state files.
STORES = (
    drift.Store(
        "packet_cache", "entries", "cache_key",
        {"version": "integer"},
        {"target": "string", "input_hash": "string", "created_at_unix": "integer", "metadata_json": "string", "runtime_ms": "integer", "token_usage": "integer", "delta_ratio": "decimal", "reused_from": "string"},
    ),
    drift.Store(
        "diagnostics", "issues", "fingerprint",
        {"schema_version": "integer", "path_norm_version": "integer", "normalized_paths": "boolean", "repo_root_id": "string"},
        {"path": "string", "line": "integer", "end_line": "integer", "severity": "string", "rule_id": "string", "message": "string", "source": "string"},
    ),
    drift.Store(
        "testmap", "tests", "test_id",
        {"schema_version": "integer", "generated_at_unix": "integer"},
        {"language": "string", "duration_ms": "integer", "sample_count": "integer", "last_seen": "integer", "coverage_reports": "array"},
    ),
)
#: Further fields promoted into every table.
APPROVED = {"tier": "string", "owner_team": "string", "weight": "decimal", "score": "decimal", "ttl_secs": "integer", "retries": "integer", "est_bytes": "integer", "shard_hint": "integer", "pinned": "boolean", "quarantined": "boolean", "origin": "object", "agent": "object", "note": "string", "workspace": "string", "locale": "string"}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field added, removed, renamed or retyped, with the file where it happened."""
    return drift.changes(table(spark, sf_dir, "state_files"), STORES)


def _store_table(store: drift.Store):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = table(spark, sf_dir, "state_files")
        renames = drift.aliases(drift.changes(files, STORES), STORES)
        return drift.replay(drift.ingest(files, STORES), store, renames, APPROVED)

    run.__doc__ = f"The consistent table of the {store.name} records."
    return run


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "diag_lines")
    return logmine.entries(lines, table(spark, sf_dir, "diag_reports"), logmine.heads(lines))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of all checker output with their place, time, severity and component."""
    return _entries(spark, sf_dir).select("report_id", "first_line", "last_line", "ts_unix", "severity", "component")


def p2_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries with message, path, line and rule."""
    return _entries(spark, sf_dir)


def p2_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mined line templates and how many lines each covers."""
    return logmine.mine(table(spark, sf_dir, "diag_lines")).selectExpr("bucket", "array_join(template, ' ') as template", "n", "head is not null as begins_entry")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_entries": p2_entries, "p2_templates": p2_templates, "p3_found": p3_found, "p5_found": p5_found, "p5_admitted": p5_admitted} | {f"p3_{n}": _entity(n) for n in ENTITIES} | {f"p3_{n}": _part(n) for n in PARTS} | {f"p1_{s.name}": _store_table(s) for s in STORES}

_UUID = r"regexp_replace(regexp_replace(lower(regexp_replace(event_id, '^\s+|\s+$', '', 'g')), '^\{?(urn:uuid:)?\{?|\}$', '', 'g'), '-', '', 'g')"
_RANKED = f"""
with k as (select *, {_UUID} as u from agent_events),
r as (select *, regexp_matches(u, '^[0-9a-f]{{32}}$') as ok,
  row_number() over (partition by u order by delivered_at nulls last, delivery_id) as rn from k)
"""

ORACLE = {
    "p5_found": f"{_RANKED} select delivery_id from r where ok and rn > 1",
    "p5_admitted": f"{_RANKED} select delivery_id, batch_id, delivered_at, task_id, event_id, occurred_at_unix, actor, kind, paths, symbols, data_json from r where coalesce(not ok, true) or rn = 1",
}
