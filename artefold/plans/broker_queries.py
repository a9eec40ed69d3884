"""Broker, report and remaining recall operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artefold.operators import broker as B
from artefold.operators import coverage as C
from artefold.operators import reduce as L
from artefold.plans import coverage_queries as cq
from artefold.plans import text_queries as tq
from artefold.session import table
from artefold.sources import sinks


def query_terms(spark, d):
    return table(spark, d, "eval_items").select("item_id", F.explode(B.query_terms(F.col("text"))).alias("term"))


def scope_paths(spark, d):
    p = table(spark, d, "issues").filter("path is not null").groupBy("path").agg(F.count("*").alias("score"))
    return B.infer_scope(p, ["cache", "index", "core", "py"], top=20)


def needle_join(spark, d):
    p = table(spark, d, "issues").filter("path is not null").select("path").distinct()
    return B.containing(p, "path", ["merge", "frame", "CACHE", ".rs"])


COMMANDS = ["git status", "A=1 cargo test 2>&1", "ls -la | head -5", "echo $HOME", "rm -rf x && ls", "pytest -q > /dev/null", "kubectl get pods | grep x", ""]


def command_families(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.element_at(F.array(*[F.lit(c) for c in COMMANDS]), (F.col("doc_id") % len(COMMANDS) + 1).cast("int")).alias("c"))
    return docs.groupBy(B.command_family(F.col("c")).alias("family")).agg(F.count("*").alias("n"))


def comments_stripped(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.length(B.without_comments(F.col("text"), "hash")).alias("chars"))


def canonical_hashes(spark, d):
    return table(spark, d, "agent_events").select("delivery_id", B.canonical_hash(F.col("data_json")).alias("hash"))


def tier_scores(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.when(F.col("source") == "readme", "curated").when(F.col("source") == "build_log", "telemetry").otherwise("standard").alias("tier"), (F.col("lang") == "en").alias("m"), F.col("task_id").isNotNull().alias("s"))
    return t.select("doc_id", B.source_tier_score(F.col("tier"), matched=F.coalesce("m", F.lit(False)), scoped=F.col("s"), explicit=F.lit(False)).alias("score"))


def replan_steps(spark, d):
    e = table(spark, d, "agent_events")
    steps = e.filter("kind = 'file_edited' and size(paths) > 0").select(F.col("delivery_id").alias("step"), F.col("paths")[0].alias("path"))
    done = steps.filter("step % 5 = 0").select("step")
    changed = e.filter("kind = 'file_read' and delivery_id % 2 = 0").select(F.explode("paths").alias("path"))
    return B.replan(steps, done, changed)


def _task_refs(spark, d, kind) -> DataFrame:
    return table(spark, d, "agent_events").filter(F.col("kind") == kind).select(F.col("task_id").alias("grp"), F.col("delivery_id").alias("packet"), F.explode("paths").alias("path")).filter("path is not null")


def diff_vs_stack(spark, d):
    return B.against_changes(_task_refs(spark, d, "file_read"), _task_refs(spark, d, "file_edited"))


def diff_vs_stack_with_map(spark, d):
    e = table(spark, d, "agent_events").filter("size(paths) >= 2").select(F.col("paths")[0].alias("from_path"), F.col("paths")[1].alias("to_path")).distinct()
    return B.against_changes(_task_refs(spark, d, "file_read"), _task_refs(spark, d, "file_edited"), e)


def packet_trim(spark, d):
    s = table(spark, d, "diag_lines").groupBy(F.col("report_id").alias("grp"), "line_no").agg(F.min("text").alias("text"))
    k = L.line_class(F.col("text"))
    s = s.select("grp", k.alias("kind"), L.class_score(k).alias("prio"), F.col("line_no").alias("ord"), F.octet_length("text").alias("size"))
    return B.trimmed_sections(s, 2500)


def report_markdown(spark, d):
    return sinks.markdown_coverage(C.by_file(cq._merged(spark, d)))


def report_annotations(spark, d):
    return sinks.github_annotations(cq._issues(spark, d))


def report_sarif(spark, d):
    return sinks.sarif_results(cq._issues(spark, d))


def run_length_without_time(spark, d):
    return L.run_length(tq._logs(spark, d), key=L.line_class(L.without_time(F.col("text")))).groupBy("log").agg(F.count("*").alias("runs"), F.max("n").alias("longest"))


QUERIES = {
    f.__name__: f
    for f in (
        query_terms, scope_paths, needle_join, command_families, comments_stripped, canonical_hashes, tier_scores, replan_steps, diff_vs_stack, diff_vs_stack_with_map, packet_trim,
        report_markdown, report_annotations, report_sarif, run_length_without_time,
    )
}

_STOP = ", ".join(f"'{w}'" for w in B.STOP_WORDS)
_T = """with r as (select distinct task_id as grp, delivery_id as packet, unnest(paths) as path from agent_events where kind = 'file_read'), c as (select distinct task_id as grp, unnest(paths) as path from agent_events where kind = 'file_edited'),
p as (select distinct grp, packet from r where path is not null and grp in (select grp from c where path is not null)), h as (select distinct grp, packet from r semi join c using (grp, path))"""
ORACLE = {
    "query_terms": f"select item_id, unnest(list_distinct(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9_-]+'), lambda w: strlen(w) >= 3 and w not in ({_STOP})))) as term from eval_items",
    "scope_paths": "with p as (select path, count(*) as score from issues where path is not null group by 1), h as (select path, score, contains(lower(path), 'cache')::int + contains(lower(path), 'index')::int + contains(lower(path), 'core')::int + contains(lower(path), 'py')::int as hits from p) select path, hits from h where hits > 0 order by hits desc, score desc, path limit 20",
    "needle_join": "select path, needle from (select distinct path from issues where path is not null), (values ('merge'), ('frame'), ('CACHE'), ('.rs')) n(needle) where contains(path, needle)",
    "command_families": "select case doc_id % 8 when 0 then 'git' when 1 then 'rust' when 2 then 'fs' when 5 then 'python' end as family, count(*) as n from documents group by 1",
    "tier_scores": "select doc_id, case when source = 'readme' then 3.0 when source = 'build_log' then -4.25 + case when coalesce(lang = 'en', false) then 1.0 else 0 end + case when task_id is not null then 0.5 else 0 end else 0.0 end::double as score from documents",
    "replan_steps": "with s as (select delivery_id as step, paths[1] as path from agent_events where kind = 'file_edited' and len(paths) > 0), c as (select distinct unnest(paths) as path from agent_events where kind = 'file_read' and delivery_id % 2 = 0) select step, case when step % 5 = 0 or path is null or path not in (select path from c where path is not null) then 'cancel' else 'keep' end as action, case when step % 5 = 0 then 'completed_step' when path is null or path not in (select path from c where path is not null) then 'inputs_unchanged' end as reason from s",
    "diff_vs_stack": _T + " select grp, packet, case when (grp, packet) in (select (grp, packet) from h) then 'related' else 'possibly_related' end as relation, case when (grp, packet) in (select (grp, packet) from h) then 0.92 else 0.62 end::double as confidence from p",
    "diff_vs_stack_with_map": _T + """, e as (select distinct paths[1] as a, paths[2] as b from agent_events where len(paths) >= 2), b2 as (select a, b from e union select b, a from e), n as (select distinct r.grp, r.packet from r join b2 on r.path = b2.a join c on c.grp = r.grp and c.path = b2.b),
 q as (select p.*, case when (grp, packet) in (select (grp, packet) from h) then 'related' when (grp, packet) in (select (grp, packet) from n) then 'possibly_related' else 'unrelated' end as relation from p) select *, case relation when 'related' then 0.92 when 'unrelated' then 0.86 else 0.62 end::double as confidence from q""",
    "packet_trim": tq._LOGS + f", k as (select log as grp, line_no as ord, strlen(text) as size, {tq._CLASS.format('text')} as kind from logs), u as (select *, sum(size) over (partition by grp order by case kind when 'error' then 100 when 'warning' then 90 when 'git_change' then 80 when 'path' then 70 else 50 end desc, ord rows unbounded preceding) as used from k) select grp, kind, count(*) filter (where used <= 2500) as kept from u group by 1, 2",
    "report_markdown": cq._M + " select path, format('| {} | {} | {} | {:.1f}% | {} |', path, covered, instrumented, floor(pct * 10) / 10, case when pct >= 80 then 'green' when pct >= 60 then 'yellow' else 'red' end) as text from files",
    "report_annotations": cq._I + ", m as (select n.*, i.message from norm n join issues i using (issue_id)) select issue_id, concat('::', case severity when 'error' then 'error' when 'warning' then 'warning' else 'notice' end, ' file=', replace(path, '%', '%25'), ',line=', line, '::', replace(replace(replace(coalesce(message, ''), '%', '%25'), chr(13), '%0D'), chr(10), '%0A')) as text from m",
    "run_length_without_time": tq._LOGS + f", x as (select *, case when regexp_matches(text, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') then substr(text, 20) else text end as body from logs), k as (select *, {tq._CLASS.format('body')} as k from x), s as (select *, case when lag(line_no) over w is null or k is distinct from lag(k) over w then 1 else 0 end as f from k window w as (partition by log order by line_no)), r as (select *, sum(f) over (partition by log order by line_no) as run from s), g as (select log, run, count(*) as n from r group by 1, 2) select log, count(*) as runs, max(n) as longest from g group by 1",
}
