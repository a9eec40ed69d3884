"""Packets, references, task state and assembly over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artefold.functions import text as T
from artefold.operators import issues as I
from artefold.operators import packets as P
from artefold.operators import recall as R
from artefold.operators import reduce as L
from artefold.operators import search as X
from artefold.operators import state as S
from artefold.plans.text_queries import _BLOCKS, _FRAMES, _LINES, _doc_lines, _logs
from artefold.session import table

QUESTION = ["index", "cache", "stale"]
ALLOWED_KINDS = ["suite.diff.analyze.v1", "suite.build.reduce.v1", "suite.test.impact.v1"]
DENIED_TEXT = r"password|secret|[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[a-z]+"


def _nodes(spark, d) -> DataFrame:
    return P.json_nodes(table(spark, d, "packets"), body="body", keys=["record_id"])


def json_strings(spark, d):
    return _nodes(spark, d).filter("kind = 'string'").groupBy("record_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("bigint").alias("chars"))


def json_shape(spark, d):
    return P.json_shape(_nodes(spark, d))


def json_extracted(spark, d):
    """The first JSON object in the free text of each document."""
    return P.extracted(table(spark, d, "documents"), id_col="doc_id", text_col="text").select("doc_id", F.length("found").alias("chars"))


def envelope_hashes(spark, d):
    return table(spark, d, "packets").select("record_id", P.envelope_hash(F.col("body")).alias("hash"))


def cache_keys(spark, d):
    return table(spark, d, "packets").filter("body is not null").select("record_id", P.cache_key(F.col("kind"), F.col("body")).alias("cache_key"))


def self_sized_budget(spark, d):
    return table(spark, d, "packets").filter("body is not null").select("record_id", P.self_sized(F.octet_length("body")).alias("est_bytes"))


def merged_inputs(spark, d):
    return P.merged(table(spark, d, "state_files"), F.expr("try_parse_json(content)").isNotNull(), by=["stream_id"])


def _costs(spark, d) -> DataFrame:
    cost = F.col("budget_cost")
    return table(spark, d, "packets").select("record_id", "kind", F.col("task_id").alias("task"), cost.est_tokens.alias("tokens"), cost.est_bytes.alias("bytes"), cost.runtime_ms.alias("runtime_ms"), cost.tool_calls.alias("calls"))


def audit_totals(spark, d):
    return P.audit(_costs(spark, d))


def frame_file_relevance(spark, d):
    return P.relevance(L.frames(_doc_lines(spark, d)), "file")


def symbol_relevance(spark, d):
    return P.relevance(table(spark, d, "agent_events").select(F.explode("symbols").alias("symbol")), "symbol")


def _refs(spark, d) -> DataFrame:
    e = table(spark, d, "agent_events")
    return e.select(F.lit("file").alias("kind"), F.explode("paths").alias("value")).unionByName(e.select(F.lit("symbol").alias("kind"), F.explode("symbols").alias("value")))


def refs_ranked(spark, d):
    return P.ranked_refs(_refs(spark, d), 50)


def broker_file_rank(spark, d):
    i = table(spark, d, "issues").filter("path is not null and rule_id is not null")
    bad = I.severity(F.col("severity")) == "error"
    files = i.groupBy("path").agg(
        F.max(F.when(bad, F.length("rule_id"))).alias("definition_len"), F.count_if(bad).alias("exact_definitions"), F.max(F.length("rule_id")).alias("symbol_len"), F.countDistinct("rule_id").alias("exact_symbols"),
        F.countDistinct("source").alias("phases"), F.countDistinct("line").alias("definitions"), F.count("*").alias("matches"),
    )
    return P.ranked_files(files.withColumn("definition_len", F.coalesce("definition_len", F.lit(0))), 12)


def diagnostic_causes_ranked(spark, d):
    i = table(spark, d, "issues").filter("message is not null and path is not null and line is not null").withColumn("severity", I.severity(F.col("severity")))
    i = i.select("issue_id", "severity", "message", F.col("path").alias("file"), "line")
    return P.ranked_causes(i, order=["issue_id"], cause=F.concat_ws(":", "severity", T.message_template(F.col("message"))), most=1500)


def symbol_terms_expanded(spark, d):
    names = table(spark, d, "agent_events").select(F.explode("symbols").alias("name")).filter("name is not null").distinct()
    return P.expanded_terms(names, "name")


def unique_basename_links(spark, d):
    refs = table(spark, d, "agent_events").select(F.col("delivery_id").alias("packet"), F.explode("paths").alias("path")).filter("path is not null")
    return P.unique_basename_links(refs)


def _events(spark, d) -> DataFrame:
    return table(spark, d, "agent_events").filter("task_id is not null").select(F.col("task_id").alias("task"), F.col("occurred_at_unix").alias("at"), F.col("delivery_id").alias("event_id"), "kind", "paths", "symbols", "data_json")


def agent_snapshot(spark, d):
    """The whole state of each task: what is in focus, read, edited, changed since the checkpoint, decided, done and open."""
    return S.agent_parts(_events(spark, d))


def replayed_events(spark, d):
    return S.replayed(_events(spark, d), 5).select("task", "event_id")


def affected_steps(spark, d):
    e = _events(spark, d).filter("kind = 'file_edited'")
    return P.affected_steps(e.select("task", F.explode("paths").alias("path")), e.select("task", F.explode("symbols").alias("symbol")))


def section_boosts(spark, d):
    e = table(spark, d, "agent_events").filter("task_id is not null")
    focus = e.filter("kind = 'focus_set'")
    focus = focus.select(F.col("task_id").alias("grp"), F.lit("path").alias("kind"), F.explode("paths").alias("value")).unionByName(focus.select(F.col("task_id").alias("grp"), F.lit("symbol").alias("kind"), F.explode("symbols").alias("value")))
    rows = e.filter("kind = 'file_edited'").select(F.col("task_id").alias("grp"), F.col("delivery_id").alias("id"), "paths", "symbols", F.concat_ws(" ", "paths", "symbols").alias("text"))
    return P.section_boost(rows, focus, QUESTION)


def _items(spark, d) -> DataFrame:
    p = table(spark, d, "packets").filter("task_id is not null and body is not null")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return p.select(F.col("task_id").alias("grp"), F.col("record_id").alias("id"), T.inferred_relevance(F.col("body"), F.lit(0)).alias("score"), z("budget_cost.est_tokens").alias("tokens"), z("budget_cost.est_bytes").alias("bytes"), "kind", F.col("body").alias("text"))


def assemble_scored(spark, d):
    return P.fitted(_items(spark, d), tokens=5000, bytes_=18_000)


def governed_assemble(spark, d):
    return P.governed(_items(spark, d), allowed=ALLOWED_KINDS, denied_text=DENIED_TEXT, tokens=5000, bytes_=18_000)


def region_lines(spark, d):
    wanted = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 3 + 1).alias("first"), (F.col("doc_id") % 3 + 3).alias("last"))
    return P.regions(_doc_lines(spark, d).withColumnRenamed("log", "id"), wanted)


def search_files_only(spark, d):
    return P.first_per_file(X.verify(_doc_lines(spark, d).withColumnRenamed("log", "id"), "report", fixed=True))


def _entries(spark, d) -> DataFrame:
    return table(spark, d, "packets").select(F.col("record_id").alias("id"), F.col("kind").alias("target"), F.coalesce("body", F.lit("")).alias("text"), F.unix_timestamp("recorded_at").alias("created"), F.array("kind").alias("types"), F.col("task_id").alias("task"))


def store_listing(spark, d):
    return P.listed(_entries(spark, d), target="Reduce", query="warning", since=1735689600, until=1764547200, offset=3, limit=40).select("id", "created")


def recall_filtered(spark, d):
    return P.recalled(_entries(spark, d), target="suite", since=1738368000, types=("build", "v1")).select("id", "created", "local")


def recall_task_only(spark, d):
    e = _entries(spark, d)
    task = e.filter("task is not null").groupBy("task").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "task").select("task").first()
    return P.recalled(e, task=task.task if task else "", scope="task_only").select("id", "created")


def stack_slice_limited(spark, d):
    return L.stack_slice(L.stack_blocks(_logs(spark, d)), max_failures=25)


def stack_slice_totals(spark, d):
    return L.slice_totals(L.stack_slice(L.stack_blocks(_logs(spark, d))))


def bigram_index(spark, d):
    return table(spark, d, "issues").filter("message is not null").select("issue_id", F.explode(P.bigrams(F.col("message"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("issues"))


def newest_of_kind(spark, d):
    return R.latest_per_key(_entries(spark, d), "target", "created", "id").select("target", "id")


QUERIES = {
    f.__name__: f
    for f in (
        json_strings, json_shape, json_extracted, envelope_hashes, cache_keys, self_sized_budget, merged_inputs, audit_totals, frame_file_relevance, symbol_relevance, refs_ranked, broker_file_rank,
        diagnostic_causes_ranked, symbol_terms_expanded, unique_basename_links, agent_snapshot, replayed_events, affected_steps, section_boosts, assemble_scored, governed_assemble, region_lines,
        search_files_only, store_listing, recall_filtered, recall_task_only, stack_slice_limited, stack_slice_totals, bigram_index, newest_of_kind,
    )
}

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TREE = "t as (select p.record_id, t.* from (select record_id, body from packets where json_valid(body)) p, json_tree(p.body) t)"
_SEV = "case when lower(trim(severity)) in ('error', 'err', 'fatal', 'critical', 'severe') then 'error' when lower(trim(severity)) in ('warning', 'warn') then 'warning' else 'note' end"
_EV = "ev as (select task_id as task, (occurred_at_unix, delivery_id) as key, occurred_at_unix as ts, delivery_id as event_id, kind, paths, symbols, data_json as j from agent_events where task_id is not null)"
_SCORE = f"round(0.5 + case when regexp_matches({_LOW.format('body')}, 'critical|fail|error|regression|panic') then 0.7 else 0 end + case when regexp_matches({_LOW.format('body')}, 'warning|uncovered|missing|stale') then 0.3 else 0 end + case when regexp_matches({_LOW.format('body')}, 'passed|ok|green') then 0.1 else 0 end, 6)::double"
_ENT = "e as (select record_id as id, kind as target, coalesce(body, '') as text, epoch(date_trunc('second', recorded_at))::bigint as created, task_id as task from packets)"


def _fit_sql(where: str) -> str:
    return f"""with recursive it as (select task_id as grp, record_id as id, {_SCORE} as score, coalesce(budget_cost.est_tokens, 0) as t, coalesce(budget_cost.est_bytes, 0) as b from packets where task_id is not null and body is not null{where}),
rk as materialized (select *, row_number() over (partition by grp order by score desc, id) as rk from it),
g(grp, rk, t, b, id, score, kept) as (select distinct grp, 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::double, false from rk union all
 select r.grp, r.rk, case when g.t + r.t <= 5000 and g.b + r.b <= 18000 then g.t + r.t else g.t end, case when g.t + r.t <= 5000 and g.b + r.b <= 18000 then g.b + r.b else g.b end, r.id, r.score, g.t + r.t <= 5000 and g.b + r.b <= 18000
 from g join rk r on r.grp = g.grp and r.rk = g.rk + 1) select grp, id, score from g where kept"""


_REL = "c as (select {0}, count(*) as n from {1} where {0} is not null group by 1) select {0}, n, round(n / (select max(n) from c), 6) as relevance from c"
ORACLE = {
    "json_strings": f"with {_TREE} select record_id, count(*) as n, sum(length(atom ->> '$'))::bigint as chars from t where type = 'VARCHAR' group by 1",
    "json_shape": f"with {_TREE} select replace(fullkey, '\"', '') as path, case type when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'bool' when 'NULL' then 'null' else 'number' end as kind, count(*) as n from t where not regexp_matches(fullkey, '\\[[1-9]') group by 1, 2",
    "cache_keys": "select record_id, sha256(kind || '::' || sha256(body)) as cache_key from packets where body is not null",
    "self_sized_budget": "with a as (select record_id, strlen(body) as n from packets where body is not null), b as (select *, n + length((n)::varchar) as s1 from a), c as (select *, n + length(s1::varchar) as s2 from b), e as (select *, n + length(s2::varchar) as s3 from c), f as (select *, n + length(s3::varchar) as s4 from e) select record_id, (n + length(s4::varchar))::bigint as est_bytes from f",
    "merged_inputs": "select stream_id, count(*) filter (where json_valid(content)) as merged, count(*) filter (where not coalesce(json_valid(content), false)) as skipped from state_files group by 1",
    "audit_totals": "select count(*) as packets, count(distinct kind) as kinds, count(distinct task_id) as tasks, sum(coalesce(budget_cost.est_tokens, 0))::bigint as tokens, sum(coalesce(budget_cost.est_bytes, 0))::bigint as bytes, sum(coalesce(budget_cost.runtime_ms, 0))::bigint as runtime_ms, greatest(sum(coalesce(budget_cost.tool_calls, 0))::bigint, count(*)) as calls from packets",
    "frame_file_relevance": _LINES + "," + _FRAMES.format(src="lines") + "," + _REL.format("file", "frames"),
    "symbol_relevance": "with s as (select unnest(symbols) as symbol from agent_events), " + _REL.format("symbol", "s"),
    "refs_ranked": "with r as (select 'file' as kind, unnest(paths) as value from agent_events union all select 'symbol', unnest(symbols) from agent_events), c as (select kind, value, count(*) as n from r where value is not null group by 1, 2) select kind, value, round(n / (select max(n) from c), 6) as relevance from c order by n desc, kind, value limit 50",
    "broker_file_rank": f"with i as (select *, {_SEV} = 'error' as bad from issues where path is not null and rule_id is not null), f as (select path, coalesce(max(case when bad then length(rule_id) end), 0) as definition_len, count(*) filter (where bad) as exact_definitions, max(length(rule_id)) as symbol_len, count(distinct rule_id) as exact_symbols, count(distinct source) as phases, count(distinct line) as definitions, count(*) as matches from i group by 1) select * from f order by definition_len desc, exact_definitions desc, symbol_len desc, exact_symbols desc, phases desc, definitions desc, matches desc, path limit 12",
    "diagnostic_causes_ranked": f"with i as (select issue_id, {_SEV} as severity, message, path, line from issues where message is not null and path is not null and line is not null order by issue_id limit 1500), o as (select distinct severity, message, path, line, concat_ws(':', severity, trim(regexp_replace({_LOW.format('message')}, '[0-9]+', '#', 'g'))) as cause from i) select cause, max(severity) as severity, case max(severity) when 'error' then 3 when 'warning' then 2 else 1 end as rank, count(*) as n, arg_min(path || ':' || line, (path, line, message)) as first_at from o group by 1",
    "symbol_terms_expanded": "with n as (select distinct unnest(symbols) as name from agent_events), c as (select name, unnest(string_split_regex(replace(name, '::', '.'), '[./\\\\_-]+')) as chunk from n where name is not null), p as (select name, unnest(string_split(regexp_replace(regexp_replace(chunk, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), ' ')) as piece from c) select distinct name, " + _LOW.format("trim(piece)") + " as term from p where strlen(trim(piece)) >= 3 and " + _LOW.format("trim(piece)") + " not in (" + ", ".join(f"'{w}'" for w in P.STOP_WORDS) + ")",
    "unique_basename_links": "with h as (select distinct packet, path, regexp_extract(path, '[^/]*$') as name from (select delivery_id as packet, unnest(paths) as path from agent_events) where path is not null), n as (select name, min(packet) as l, max(packet) as r from h group by 1 having count(distinct packet) = 2), p as (select l, r, count(*) as n from n group by 1, 2) select l as \"left\", r as \"right\", n from p where not exists (select 1 from h a join h b using (path) where a.packet = l and b.packet = r)",
    "agent_snapshot": f"""with {_EV}, cp as (select task, max(key) as c from ev where kind = 'checkpoint_saved' group by 1),
 a as (select task, 'focus_paths' as part, unnest(paths) as item, key from ev where kind = 'focus_set' union all select task, 'focus_symbols', unnest(symbols), key from ev where kind = 'focus_set'
 union all select task, 'files_read', unnest(paths), key from ev where kind = 'file_read' union all select task, 'files_edited', unnest(paths), key from ev where kind = 'file_edited'
 union all select task, 'changed_paths', unnest(paths), key from ev left join cp using (task) where kind = 'file_edited' and (c is null or key > c) union all select task, 'changed_symbols', unnest(symbols), key from ev left join cp using (task) where kind = 'file_edited' and (c is null or key > c)
 union all select task, 'checkpoint_paths', unnest(paths), key from ev join cp using (task) where key = c union all select task, 'checkpoint', j ->> '$.checkpoint_id', key from ev join cp using (task) where key = c
 union all select task, 'decisions', j ->> '$.decision_id', key from ev where kind = 'decision_added' union all select task, 'completed_steps', j ->> '$.step_id', key from ev where kind = 'step_completed'
 union all select task, 'open_questions', j ->> '$.question_id', key from ev where kind = 'question_opened' union all select task, 'evidence', j ->> '$.artifact_id', key from ev where kind = 'evidence_captured'
 union all select task, 'failed_tools', j ->> '$.tool_name', key from ev where kind = 'tool_invocation_failed'),
 gone as (select task, 'decisions' as part, j ->> '$.supersedes' as item, max(key) as r from ev where kind = 'decision_added' group by 1, 3 union all select task, 'open_questions', j ->> '$.question_id', max(key) from ev where kind = 'question_resolved' group by 1, 3),
 l as (select task, part, item, max(key) as a from a where item is not null group by 1, 2, 3) select task, part, item from l left join gone using (task, part, item) where r is null or a > r""",
    "replayed_events": f"with {_EV}, b as (select *, row_number() over (partition by task order by ts desc, event_id desc) as k from ev) select task, event_id from b where k <= 5",
    "affected_steps": f"""with {_EV}, e as (select task, paths, symbols from ev where kind = 'file_edited'), p as (select task, unnest(paths) as p, false as s from e union all select task, null, true from (select task, unnest(symbols) as y from e) where y is not null),
 g as (select task, bool_or(s) as s, coalesce(bool_or(not regexp_matches(p, '(\\.info|\\.lcov|\\.xml)$|coverage|report')), false) as m, coalesce(bool_or(not regexp_matches(p, '(\\.info|\\.lcov|\\.xml)$|coverage|report|\\.log$')), false) as d, coalesce(bool_or(regexp_matches(p, '(\\.log|\\.txt)$|report|diagnostic')), false) as k, coalesce(bool_or(p is not null), false) as y from p group by 1)
 select task, 'mapy.repo' as target, m or s as affected from g union all select task, 'diffy.analyze', d from g union all select task, 'stacky.slice', k from g union all select task, 'contextq.assemble', y or s from g union all select task, 'guardy.check', y from g""",
    "section_boosts": f"""with {_EV}, f as (select task, list(distinct p) as fp from (select task, unnest(paths) as p from ev where kind = 'focus_set') group by 1), y as (select task, list(distinct s) as fs from (select task, unnest(symbols) as s from ev where kind = 'focus_set') group by 1),
 r as (select event_id as id, task, paths, symbols, {_LOW.format("concat_ws(' ', nullif(array_to_string(coalesce(paths, []), ' '), ''), nullif(array_to_string(coalesce(symbols, []), ' '), ''))")} as text from ev where kind = 'file_edited')
 select id, round(case when coalesce(list_has_any(paths, fp), false) then 0.35 else 0 end + case when coalesce(list_has_any(symbols, fs), false) then 0.25 else 0 end + least((contains(text, 'index')::int + contains(text, 'cache')::int + contains(text, 'stale')::int) / 3 * 0.25, 0.25), 6)::double as boost from r left join f using (task) left join y using (task)""",
    "assemble_scored": _fit_sql(""),
    "governed_assemble": _fit_sql(" and kind in (" + ", ".join(f"'{k}'" for k in ALLOWED_KINDS) + ") and not regexp_matches(body, '" + DENIED_TEXT + "')"),
    "region_lines": _LINES + " select log as id, line_no, text from lines where line_no between log % 3 + 1 and log % 3 + 3",
    "search_files_only": _LINES + " select log as id, min(line_no) as line_no, count(*) - 1 as more from lines where contains(text, 'report') group by 1",
    "store_listing": f"with {_ENT} select id, created from e where contains(lower(target), 'reduce') and contains(lower(text), 'warning') and created between 1735689600 and 1764547200 order by created desc, id limit 40 offset 3",
    "recall_filtered": f"with {_ENT} select id, created, false as local from e where contains(lower(target), 'suite') and created >= 1738368000 and contains(lower(target), 'build') and contains(lower(target), 'v1')",
    "recall_task_only": f"with {_ENT} select id, created from e where task = (select task from e where task is not null group by 1 order by count(*) desc, task limit 1)",
    "stack_slice_limited": _BLOCKS + "select fingerprint, arg_min(title, (log, block)) as title, count(*) as occurrences, arg_min(n_frames, (log, block)) as n_frames from blocks group by 1 order by min((log, block)) limit 25",
    "stack_slice_totals": _BLOCKS + "select count(*)::bigint as total, count(distinct fingerprint) as distinct_failures, count(*) - count(distinct fingerprint) as duplicates_removed from blocks",
    "bigram_index": "with g as (select distinct issue_id, unnest(list_transform(range(1, length(message)), lambda i: substr(message, i, 2))) as gram from issues where length(message) >= 2) select gram, count(*) as issues from g group by 1",
    "newest_of_kind": f"with {_ENT} select target, arg_max(id, (created, id)) as id from e group by 1",
}
