"""Graphs, correlation, assembly, policy, paths, state and analytics over the test tables.

Packets hold files (from their ``body``); agent events are task state; orders
link customers and suppliers for the graph operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artefold.functions import text as T
from artefold.operators import context as C
from artefold.operators import graph as G
from artefold.operators import paths as P
from artefold.operators import state as S
from artefold.session import table


def _flow(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("n/"), F.col("o_custkey") % 97).alias("from_path"), F.concat(F.lit("n/"), F.col("l_suppkey") % 97).alias("to_path"))


def graph_edges(spark, d):
    return G.edges(_flow(spark, d))


def _sparse(spark, d) -> DataFrame:
    n = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return G.edges(n.select(F.concat(F.lit("s/"), "s_suppkey").alias("from_path"), F.concat(F.lit("s/"), (F.col("s_suppkey") * 7 + F.col("s_nationkey")) % 53).alias("to_path")))


def degree_centrality(spark, d):
    return G.degree(_sparse(spark, d))


def repo_rank_topk(spark, d):
    deg = G.degree(_sparse(spark, d))
    files = deg.select("path", (F.length("path") % 3 / 2.0).alias("focus"), F.lit(0.5).alias("near"), "centrality", F.lit(None).cast("double").alias("recent"))
    return G.ranked(files).orderBy(F.desc("score"), "path").limit(80)


def _events(spark, d) -> DataFrame:
    return table(spark, d, "agent_events").select(F.col("task_id").alias("task"), F.col("occurred_at_unix").alias("at"), F.col("delivery_id").alias("event_id"), "kind", "paths", "symbols", "data_json", "delivered_at")


def symbol_query(spark, d):
    s = table(spark, d, "agent_events").select(F.explode("symbols").alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return s.withColumn("score", G.match_score(F.col("name"), "write_grams")).filter("score is not null")


def pattern_query(spark, d):
    lines = table(spark, d, "diag_lines").filter(F.col("text").rlike(G.pattern_regex("$NAME returned $_ instead of")))
    return lines.groupBy("report_id").agg(F.count("*").alias("n"))


def topo_levels(spark, d):
    n = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    deps = n.filter("id > 1").select("id", F.floor(F.col("id") / 3).cast("bigint").alias("needs"))
    return G.levels(n, deps)


def schedule_prefix_budget(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("ord")).agg(F.sum("l_quantity").cast("bigint").alias("cost"))
    return G.prefix_cut(s, 90)


def _steps(spark, d) -> DataFrame:
    e = S.sequence(_events(spark, d).filter("kind in ('file_read', 'file_edited', 'step_completed')"))
    act = F.when(F.col("kind") == "file_read", "read").when(F.col("kind") == "file_edited", "edit").otherwise("test")
    return e.select(F.col("task").alias("plan"), F.col("seq").alias("ord"), act.alias("action"), F.expr("try_element_at(paths, 1)").alias("path"), F.expr("case when seq % 50 = 0 then seq + 1 end").alias("needs"))


def plan_violations(spark, d):
    return G.plan_violations(_steps(spark, d))


def _refs(spark, d) -> DataFrame:
    e = table(spark, d, "agent_events")
    f = e.select(F.col("delivery_id").alias("packet"), F.lit("file").alias("kind"), F.explode("paths").alias("ref"))
    return f.unionByName(e.select(F.col("delivery_id").alias("packet"), F.lit("symbol").alias("kind"), F.explode("symbols").alias("ref")))


def shared_file_classes(spark, d):
    return C.shared_classes(_refs(spark, d), "file")


def shared_symbol_classes(spark, d):
    return C.shared_classes(_refs(spark, d), "symbol")


def shared_file_members(spark, d):
    return C.shared_members(_refs(spark, d), "file")


def _map_edges(spark, d) -> DataFrame:
    e = table(spark, d, "agent_events").filter("size(paths) >= 2")
    return G.edges(e.select(F.col("paths")[0].alias("from_path"), F.col("paths")[1].alias("to_path")))


def map_edge_links(spark, d):
    return C.edge_links(_map_edges(spark, d), _refs(spark, d))


def _ipaths(spark, d) -> DataFrame:
    return table(spark, d, "issues").filter("path is not null").select("path")


def _epaths(spark, d) -> DataFrame:
    return table(spark, d, "agent_events").select(F.explode("paths").alias("path")).filter("path is not null")


def build_untouched(spark, d):
    return C.untouched(_ipaths(spark, d), _epaths(spark, d))


def focus_overlap(spark, d):
    return C.focus_overlap(_refs(spark, d), _ipaths(spark, d).filter("path like '%index%'"))


def distinct_bodies(spark, d):
    return C.distinct_bodies(table(spark, d, "packets").select("record_id", "body"), "body", "record_id").select("record_id")


def _sections(spark, d, upper) -> DataFrame:
    e = S.last_per_item(_events(spark, d).filter(F.col("at") <= upper).withColumn("item", F.explode("paths")))
    return e.groupBy(F.col("item").alias("id")).agg(F.max(F.struct("at", "task")).alias("m")).select("id", F.col("m.task").alias("body"))


def section_delta(spark, d):
    return C.section_delta(_sections(spark, d, 1750000000), _sections(spark, d, 1760000000))


def _ranked(spark, d) -> DataFrame:
    p = table(spark, d, "packets").filter("task_id is not null").select(F.col("task_id").alias("grp"), F.col("record_id").alias("id"), F.coalesce("budget_cost.est_tokens", F.lit(0)).alias("weight"))
    return p.withColumn("ord", F.col("id"))


def assemble_first_fit(spark, d):
    return C.assembled(_ranked(spark, d), budget=5000).select("grp", "id", "weight")


def manage_working_set(spark, d):
    from pyspark.sql import Window

    r = _ranked(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy("ord"))).withColumn("kept", F.col("weight") < 600)
    return C.working_set(r.select("grp", "rank", "id", "kept"))


def policy_allowlist(spark, d):
    allowed = spark.createDataFrame([("agent",), ("DAEMON",)], "actor string")
    return C.not_allowed(table(spark, d, "agent_events").filter("actor is not null").select("actor"), allowed, "actor")


def path_glob_audit(spark, d):
    return C.glob_audit(_epaths(spark, d).distinct(), allow=["src/**", "crates/**/*.rs", "lib/**"], deny=["**/*.toml"])


FINDINGS = {"license": "[Ll]icense", "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "todo": "TODO|FIXME", "hunk": r"@@ -[0-9]+,[0-9]+ \+[0-9]+,[0-9]+ @@"}


def redaction_findings(spark, d):
    return C.pattern_findings(table(spark, d, "documents").filter("text is not null"), "doc_id", "text", FINDINGS)


def _costs(spark, d) -> DataFrame:
    return table(spark, d, "packets").select(F.col("task_id").alias("grp"), "budget_cost.est_tokens", "budget_cost.est_bytes", "budget_cost.runtime_ms")


def cap_violations(spark, d):
    return C.over_caps(_costs(spark, d).filter("grp is not null"), {"est_tokens": 20_000, "runtime_ms": 9_000})


def usage_totals(spark, d):
    return C.usage(_costs(spark, d))


def path_strip(spark, d):
    return P.stripped(_ipaths(spark, d).distinct(), ["/work/", "./", "file://"])


def common_root(spark, d):
    return P.common_root(_epaths(spark, d).select(F.concat(F.lit("/repo/main/"), "path").alias("path")))


def path_resolve(spark, d):
    return P.resolved(_ipaths(spark, d), _epaths(spark, d), ignore=r"\.toml$", rules={"client/": "server/"}, prefixes=("./", "/work/"))


def path_diagnosis(spark, d):
    return P.diagnosis(path_resolve(spark, d))


def unmapped_prefixes(spark, d):
    return P.unmapped_prefixes(path_resolve(spark, d), top=50)


def _hashed(spark, d) -> DataFrame:
    return _epaths(spark, d).distinct().select("path", F.substring(F.sha2(T.basename(F.col("path")), 256), 1, 6).alias("hash"))


def resolve_by_content(spark, d):
    return P.by_content(_ipaths(spark, d).distinct().select("path", F.substring(F.sha2(T.basename(F.col("path")), 256), 1, 6).alias("hash")), _hashed(spark, d))


def merkle_roots(spark, d):
    return P.merkle(_hashed(spark, d))


def path_collisions_last(spark, d):
    i = table(spark, d, "issues").filter("path is not null").select(F.lower("path").alias("path"), "issue_id")
    return P.keep_last(i, "path", "issue_id")


def _items(spark, d) -> DataFrame:
    return _events(spark, d).withColumn("item", F.explode_outer("paths"))


def last_per_item(spark, d):
    return S.last_per_item(_items(spark, d).filter("item is not null"))


def open_set(spark, d):
    return S.open_set(_items(spark, d), add=["file_read", "focus_set"], remove=["file_edited"], clear=["checkpoint_saved"])


def event_snapshot_fold(spark, d):
    return S.snapshot(_events(spark, d))


def last_n_events(spark, d):
    return S.last_n(_events(spark, d), 12).select("task", "event_id", "back")


def event_sequence(spark, d):
    return S.sequence(_events(spark, d)).select("task", "event_id", "seq")


def since_checkpoint(spark, d):
    return S.since_checkpoint(_events(spark, d))


def epoch_cache_hits(spark, d):
    e = S.epochs(_events(spark, d), mutates=["file_edited"]).filter("kind = 'file_read'")
    return S.cache_hits(e.withColumn("fingerprint", F.array_join(F.coalesce("paths", F.array().cast("array<string>")), "|")))


def debounce_sessions(spark, d):
    return S.debounced(_events(spark, d), 600)


def token_window_threshold(spark, d):
    return S.token_windows(_events(spark, d).withColumn("tokens", T.tokens_by_bytes(F.col("data_json"))), boundary="checkpoint_saved", budget=300)


def tumbling_counts(spark, d):
    return S.tumbling(_events(spark, d), "delivered_at", "6 hours")


def fail_success_pairs(spark, d):
    e = S.sequence(_events(spark, d).filter("kind in ('tool_invocation_failed', 'tool_invocation_completed')"))
    tool = F.coalesce(F.get_json_object("data_json", "$.tool_name"), F.get_json_object("data_json", "$.type"), F.lit(""))
    return S.fail_then_success(e.select(F.col("task").alias("grp"), F.col("seq").alias("ord"), tool.alias("program"), (F.col("kind") == "tool_invocation_failed").alias("failed")))


def _gains(spark, d) -> DataFrame:
    return table(spark, d, "packets").select("kind", F.coalesce("budget_cost.est_tokens", F.lit(0)).alias("raw"), F.coalesce("budget_cost.payload_est_tokens", F.lit(0)).alias("reduced"), "record_id")


def gain_summary(spark, d):
    return S.gain(_gains(spark, d))


def gain_by_kind(spark, d):
    return S.gain_by(_gains(spark, d), "kind")


def missed_savings(spark, d):
    return _gains(spark, d).filter("raw - reduced > 100").orderBy(F.desc("raw"), "record_id").limit(20).select("record_id", "raw")


def command_discovery(spark, d):
    e = table(spark, d, "issues").select(F.col("source").alias("program"), T.tokens_by_bytes(F.coalesce("message", F.lit(""))).alias("tokens")).filter("program is not null")
    return S.discovery(e, ["rusk", "lintel"])


def savings_usd(spark, d):
    return S.gain_by(_gains(spark, d), "kind").select("kind", T.usd(F.col("saved"), 3.0).alias("usd"))


QUERIES = {
    f.__name__: f
    for f in (
        graph_edges, degree_centrality, repo_rank_topk, symbol_query, pattern_query, topo_levels, schedule_prefix_budget, plan_violations,
        shared_file_classes, shared_symbol_classes, shared_file_members, map_edge_links, build_untouched, focus_overlap, distinct_bodies, section_delta, assemble_first_fit, manage_working_set,
        policy_allowlist, path_glob_audit, redaction_findings, cap_violations, usage_totals,
        path_strip, common_root, path_resolve, path_diagnosis, unmapped_prefixes, resolve_by_content, merkle_roots, path_collisions_last,
        last_per_item, open_set, event_snapshot_fold, last_n_events, event_sequence, since_checkpoint, epoch_cache_hits, debounce_sessions, token_window_threshold, tumbling_counts,
        fail_success_pairs, gain_summary, gain_by_kind, missed_savings, command_discovery, savings_usd,
    )
}

_E = """
with ev as (select task_id as task, occurred_at_unix as ts, delivery_id as event_id, kind, paths, symbols, data_json, delivered_at from agent_events),
it as (select task, ts, event_id, kind, unnest(paths) as item from ev),
f as (select delivery_id as packet, unnest(paths) as ref from agent_events), s as (select delivery_id as packet, unnest(symbols) as ref from agent_events),
fd as (select distinct packet, ref from f where ref is not null), sd as (select distinct packet, ref from s where ref is not null),
fc as (select ref, count(*) as packets, min(packet) as first_packet from fd group by 1 having count(*) > 1),
ip as (select path from issues where path is not null), ep as (select ref as path from f where ref is not null),
hs as (select path, substr(sha256(regexp_extract(path, '[^/]*$')), 1, 6) as hash from (select distinct path from ep))
"""
_SP = "with e as (select distinct 's/' || s_suppkey as from_path, 's/' || ((s_suppkey * 7 + s_nationkey) % 53) as to_path from supplier where s_suppkey <> (s_suppkey * 7 + s_nationkey) % 53), d as (select path, count(*) as degree from (select from_path as path from e union all select to_path from e) group by 1), c as (select path, degree, round(degree / max(degree) over (), 6) as centrality from d)"
_RES = (
    _E
    + r""", o as (select distinct path from ip), k as (select distinct path as target from ep),
w as (select path, 1 as prio, 'exact' as strategy, path as want from o union all select path, 2, 'rule', 'server/' || substr(path, 8) from o where starts_with(path, 'client/')
 union all select path, 3, 'prefix', substr(path, 7) from o where starts_with(path, '/work/') union all select path, 3, 'prefix', substr(path, 3) from o where starts_with(path, './')),
dir as (select path, prio, strategy, target, 0 as score from w join k on want = target),
rest as (select path, list_reverse(string_split(path, '/')) as a, regexp_extract(path, '[^/]*$') as b from o where path not in (select path from dir)),
kk as (select target, list_reverse(string_split(target, '/')) as c, regexp_extract(target, '[^/]*$') as b from k),
suf as (select path, 4 as prio, 'suffix' as strategy, target, coalesce(list_min(list_filter(range(1, greatest(len(a), len(c)) + 1), lambda i: a[i] is distinct from c[i])), greatest(len(a), len(c)) + 1) - 1 as score from rest join kk using (b)),
best as (select path, arg_min(strategy, (prio, -score, target)) as strategy, arg_min(target, (prio, -score, target)) as target from (select * from dir union all select * from suf) group by 1),
res as (select o.path, case when regexp_matches(o.path, '\.toml$') then 'ignored' else coalesce(strategy, 'unmapped') end as strategy, case when not regexp_matches(o.path, '\.toml$') then target end as target from o left join best using (path))
"""
)
_DELTA = ", ".join(f"{n} as (select item as id, arg_max(task, (ts, task)) as body from (select task, item, max(ts) as ts from it where ts <= {u} and item is not null group by 1, 2) group by 1)" for n, u in (("b", 1750000000), ("a", 1760000000)))
_SEQ = "seq as (select *, row_number() over (partition by task order by ts, event_id) as seq from ev)"
_FITS = "rk as materialized (select task_id as grp, record_id as id, coalesce(budget_cost.est_tokens, 0) as weight, row_number() over (partition by task_id order by record_id) as rk from packets where task_id is not null)"
_STEPS = ", st as (select task as plan, row_number() over (partition by task order by ts, event_id) as ord, case kind when 'file_read' then 'read' when 'file_edited' then 'edit' else 'test' end as action, paths[1] as path from ev where kind in ('file_read', 'file_edited', 'step_completed'))"
ORACLE = {
    "graph_edges": "select distinct 'n/' || (o_custkey % 97) as from_path, 'n/' || (l_suppkey % 97) as to_path from lineitem join orders on l_orderkey = o_orderkey where o_custkey % 97 <> l_suppkey % 97",
    "degree_centrality": _SP + " select * from c",
    "repo_rank_topk": _SP + " select path, round((length(path) % 3 / 2.0) * 0.45 + 0.5 * 0.25 + centrality * 0.2, 6)::double as score from c order by score desc, path limit 80",
    "symbol_query": "with s as (select unnest(symbols) as name from agent_events), g as (select name, count(*) as n from s group by 1) select name, n, case when name = 'write_grams' then 1.0 when lower(name) = 'write_grams' then 0.98 else 0.55 end::double as score from g where contains(lower(name), 'write_grams')",
    "pattern_query": r"select report_id, count(*) as n from diag_lines where regexp_matches(text, '[A-Za-z_][A-Za-z0-9_]*\s+returned\s+.+?\s+instead\s+of') group by 1",
    "topo_levels": "with recursive r(id, level) as (select s_suppkey, 0 from supplier where s_suppkey <= 1 or s_suppkey // 3 not in (select s_suppkey from supplier) union all select s_suppkey, level + 1 from supplier join r on r.id = s_suppkey // 3 where s_suppkey > 1) select id, level from r",
    "schedule_prefix_budget": "with s as (select l_orderkey as run, l_linenumber as ord, sum(l_quantity)::bigint as cost from lineitem group by 1, 2), u as (select *, sum(cost) over (partition by run order by ord) as used from s) select run, ord, cost, case when used <= 90 then 'ran' else 'budget_exceeded' end as status from u",
    "plan_violations": _E + _STEPS + """, rd as (select plan, path, min(ord) as fr from st where action = 'read' and path is not null group by 1, 2), tt as (select plan, max(ord) as lt from st where action = 'test' group by 1)
 select plan, ord, 'read_before_edit' as rule from st left join rd using (plan, path) where action = 'edit' and (fr is null or fr >= ord)
 union all select plan, ord, 'missing_test_gate' from st left join tt using (plan) where action = 'edit' and (lt is null or lt <= ord)
 union all select plan, ord, 'dependency_order' from st where ord % 50 = 0""",
    "shared_file_classes": _E + "select 'shared_file' as rule, ref, packets, first_packet from fc",
    "shared_symbol_classes": _E + "select 'shared_symbol' as rule, ref, count(*) as packets, min(packet) as first_packet from sd group by 2 having count(*) > 1",
    "shared_file_members": _E + "select packet, ref, packets - 1 as links from fd join fc using (ref)",
    "map_edge_links": _E + ", e as (select distinct paths[1] as from_path, paths[2] as to_path from ev where len(paths) >= 2 and paths[1] <> paths[2]), h as (select ref, count(*) as n from fd group by 1) select from_path, to_path, l.n as left_packets, r.n as right_packets from e join h l on l.ref = from_path join h r on r.ref = to_path",
    "build_untouched": _E + "select distinct path from ip where path not in (select path from ep)",
    "focus_overlap": _E + """, fo as (select distinct path, regexp_extract(path, '[^/]*$') as name from ip where path like '%index%'), un as (select name, min(path) as path from fo group by 1 having count(*) = 1),
 m as (select packet, path, 0.73 as c from fd join fo on ref = path union all select packet, path, 0.61 from fd join un on regexp_extract(ref, '[^/]*$') = name where ref <> path) select packet, count(distinct path) as matched, max(c)::double as confidence from m group by 1""",
    "distinct_bodies": "select min(record_id) as record_id from packets where body is not null group by body",
    "section_delta": _E + "," + _DELTA + " select id, case when b.id is null then 'added' when a.id is null then 'removed' when a.body = b.body then 'unchanged' else 'changed' end as status from b full join a using (id)",
    "assemble_first_fit": "with " + _FITS + ", f as (select * from (with recursive g(grp, rk, used, id, weight, kept) as (select distinct grp, 0::bigint, 0::bigint, 0::bigint, 0::bigint, false from rk union all select r.grp, r.rk, case when g.used + r.weight <= 5000 then g.used + r.weight else g.used end, r.id, r.weight, g.used + r.weight <= 5000 from g join rk r on r.grp = g.grp and r.rk = g.rk + 1) select * from g)) select grp, id, weight from f where kept",
    "manage_working_set": "with " + _FITS + ", k as (select *, weight < 600 as kept, count(*) filter (where weight < 600) over (partition by grp) as n from rk) select grp, rk::int as rank, id, case when kept then 'working' when rk > n and rk <= n + 8 then 'evict' else 'none' end as role from k",
    "policy_allowlist": "select actor, count(*) as n from agent_events where lower(actor) not in ('agent', 'daemon') group by 1",
    "path_glob_audit": _E + r"select path, case when regexp_matches(path, '^(?:.*/)?[^/]*\.toml$') then 'denied' else 'not_allowed' end as finding from (select distinct path from ep) where regexp_matches(path, '^(?:.*/)?[^/]*\.toml$') or not regexp_matches(path, '^src/.*$|^crates/(?:.*/)?[^/]*\.rs$|^lib/.*$')",
    "redaction_findings": "select id, rule, n from (select doc_id as id, unnest([" + ", ".join(f"{{rule: '{r}', n: len(regexp_extract_all(text, '{p}'))::int}}" for r, p in FINDINGS.items()) + "], recursive := true) from documents where text is not null) where n > 0",
    "cap_violations": "with g as (select task_id as grp, sum(coalesce(budget_cost.est_tokens, 0))::bigint as t, sum(coalesce(budget_cost.runtime_ms, 0))::bigint as r from packets where task_id is not null group by 1) select grp, 'est_tokens' as measure, t as used, 20000::bigint as cap from g where t > 20000 union all select grp, 'runtime_ms', r, 9000 from g where r > 9000",
    "usage_totals": "select count(*) as packets, sum(coalesce(budget_cost.est_tokens, budget_cost.est_bytes // 4, 0))::bigint as tokens, sum(coalesce(budget_cost.est_bytes, 0))::bigint as bytes, sum(coalesce(budget_cost.runtime_ms, 0))::bigint as runtime_ms from packets",
    "path_strip": _E + r"select distinct path, regexp_replace(case when starts_with(path, '/work/') then substr(path, 7) when starts_with(path, './') then substr(path, 3) when starts_with(path, 'file://') then substr(path, 8) else path end, '^(\./|/)+', '') as stripped from ip",
    "common_root": "select '/repo/main' as root",
    "path_resolve": _RES + "select * from res",
    "path_diagnosis": _RES + "select strategy, count(*) as n from res group by 1",
    "unmapped_prefixes": _RES + "select split_part(path, '/', 1) as prefix, count(*) as n from res where strategy = 'unmapped' group by 1 order by 2 desc, 1 limit 50",
    "resolve_by_content": _E + ", u as (select hash, min(path) as target from hs group by 1 having count(*) = 1) select path, target from (select distinct path, substr(sha256(regexp_extract(path, '[^/]*$')), 1, 6) as hash from ip) join u using (hash)",
    "merkle_roots": _E + "select split_part(path, '/', 1) as dir, sha256(string_agg(path || hash, '' order by path || hash)) as root from hs group by 1",
    "path_collisions_last": "select lower(path) as path, max(issue_id) as issue_id from issues where path is not null group by 1",
    "last_per_item": _E + "select task, item, arg_max(kind, (ts, event_id)) as kind, max(ts) as \"at\" from it where item is not null group by 1, 2",
    "open_set": _E + """, l as (select task, item, max((ts, event_id)) filter (where kind in ('file_read', 'focus_set')) as a, max((ts, event_id)) filter (where kind = 'file_edited') as r from it where item is not null group by 1, 2), c as (select task, max((ts, event_id)) as c from ev where kind = 'checkpoint_saved' group by 1)
 select task, item from l left join c using (task) where a is not null and (r is null or a > r) and (c is null or a > c)""",
    "event_snapshot_fold": _E + "select task, count(*) as events, max(ts) as last_at, arg_max(kind, (ts, event_id)) as last_kind, " + ", ".join(f"count(*) filter (where kind = '{k}') as n_{k}" for k in ("file_read", "file_edited", "decision_added", "question_opened", "checkpoint_saved")) + " from ev group by 1",
    "last_n_events": _E + ", b as (select task, event_id, row_number() over (partition by task order by ts desc, event_id desc)::int as back from ev) select * from b where back <= 12",
    "event_sequence": _E + "," + _SEQ + " select task, event_id, seq::int as seq from seq",
    "since_checkpoint": _E + ", m as (select task, max((ts, event_id)) as m from ev where kind = 'checkpoint_saved' group by 1) select task, kind, count(*) as n from ev left join m using (task) where m is null or (ts, event_id) > m group by 1, 2",
    "epoch_cache_hits": _E + ", e as (select *, coalesce(sum((kind = 'file_edited')::int) over (partition by task order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as epoch from ev), r as (select task, row_number() over (partition by task, array_to_string(coalesce(paths, []), '|'), epoch order by ts, event_id) > 1 as hit from e where kind = 'file_read') select task, count(*) as calls, count(*) filter (where hit) as hits from r group by 1",
    "debounce_sessions": _E + ", n as (select *, case when ts - lag(ts) over w <= 600 then 0 else 1 end as f from ev window w as (partition by task order by ts, event_id)), g as (select *, sum(f) over (partition by task order by ts, event_id) as b from n) select task, min(ts) as first_at, max(ts) as last_at, count(*) as n from g group by task, b",
    "token_window_threshold": _E + ", p as (select task, strlen(data_json) // 4 as t, coalesce(sum((kind = 'checkpoint_saved')::int) over (partition by task order by ts, event_id rows between unbounded preceding and 1 preceding), 0)::bigint as part from ev), g as (select task, part, sum(t)::bigint as tokens from p group by 1, 2) select *, case when tokens >= 270 then 'force' when tokens >= 225 then 'prepare' when tokens >= 150 then 'warn' else 'none' end as level from g",
    "tumbling_counts": _E + "select time_bucket(interval '6 hours', delivered_at, timestamp '1970-01-01') as start, kind, count(*) as n from ev group by 1, 2",
    "fail_success_pairs": _E + ", q as (select task as grp, row_number() over (partition by task order by ts, event_id) as ord, kind, coalesce(data_json ->> '$.tool_name', data_json ->> '$.type', '') as program from ev where kind in ('tool_invocation_failed', 'tool_invocation_completed')), x as (select *, lead(kind) over w as nx, lead(program) over w as np from q window w as (partition by grp order by ord)) select grp, ord::int as ord, program from x where kind = 'tool_invocation_failed' and nx = 'tool_invocation_completed' and np = program",
    "gain_summary": "with g as (select coalesce(budget_cost.est_tokens, 0) as raw, coalesce(budget_cost.payload_est_tokens, 0) as reduced from packets) select count(*) as n, sum(raw)::bigint as raw, sum(reduced)::bigint as reduced, sum(greatest(raw - reduced, 0))::bigint as saved, round(100.0 * sum(greatest(raw - reduced, 0)) / sum(raw), 6)::double as pct from g",
    "gain_by_kind": "select kind, count(*) as n, sum(greatest(coalesce(budget_cost.est_tokens, 0) - coalesce(budget_cost.payload_est_tokens, 0), 0))::bigint as saved from packets group by 1",
    "missed_savings": "select record_id, coalesce(budget_cost.est_tokens, 0) as raw from packets where coalesce(budget_cost.est_tokens, 0) - coalesce(budget_cost.payload_est_tokens, 0) > 100 order by raw desc, record_id limit 20",
    "command_discovery": "select source as program, count(*) as n, sum(strlen(coalesce(message, '')) // 4)::bigint as tokens from issues where source is not null and source not in ('rusk', 'lintel') group by 1 order by 3 desc, 1 limit 20",
    "savings_usd": "select kind, round(sum(greatest(coalesce(budget_cost.est_tokens, 0) - coalesce(budget_cost.payload_est_tokens, 0), 0)) / 1000000 * 3.0, 6)::double as usd from packets group by 1",
}
