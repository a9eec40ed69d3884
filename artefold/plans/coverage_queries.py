"""Coverage, issues, impact and sharding over the test tables.

Coverage is read from ``lineitem``: a part is a file, an order a line, a line
status a report; changed lines are the orders of two months.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from artefold.operators import coverage as C
from artefold.operators import impact as I
from artefold.operators import issues as S
from artefold.session import table

FROM, UNTIL = "1998-01-01", "1998-03-01"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.concat(F.lit("part/"), "l_partkey").alias("path"), F.col("l_orderkey").alias("line"), (F.col("l_returnflag") != "R").alias("covered"), F.col("l_linestatus").alias("report"))


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return C.merge(_lines(spark, d))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter((F.col("o_orderdate") >= FROM) & (F.col("o_orderdate") < UNTIL))


def _diff(spark: SparkSession, d: str) -> DataFrame:
    orders = _orders(spark, d)
    known = table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("part/"), "l_partkey").alias("path"), F.col("l_orderkey").alias("line"))
    return known.unionByName(orders.select(F.concat(F.lit("cust/"), "o_custkey").alias("path"), F.col("o_orderkey").alias("line")))


def _diff_files(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d).select("path").distinct().withColumn("old_path", F.when(F.col("path").startswith("cust/1"), F.concat(F.lit("part/"), F.substring_index("path", "/", -1))))


def _added(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter("p_size <= 5").select(F.concat(F.lit("part/"), "p_partkey").alias("path"))


def coverage_merge(spark, d):
    return _merged(spark, d)


def coverage_total(spark, d):
    return C.total(_merged(spark, d))


def coverage_by_file(spark, d):
    return C.by_file(_merged(spark, d)).orderBy("pct", "path").limit(50)


def coverage_below_threshold(spark, d):
    return C.below(C.by_file(_merged(spark, d)), 60.0)


def coverage_missing_ranges(spark, d):
    return C.missing_ranges(_merged(spark, d))


def coverage_range_text(spark, d):
    return C.range_text(C.missing_ranges(_merged(spark, d)))


def coverage_changed_lines(spark, d):
    return C.changed(_merged(spark, d), _diff(spark, d))


def coverage_gate(spark, d):
    return C.gate(_merged(spark, d), _diff(spark, d), _added(spark, d), least_total=70.0, least_changed=50.0, least_new=80.0)


def coverage_counts_merge(spark, d):
    counts = table(spark, d, "lineitem").select(F.concat(F.lit("part/"), "l_partkey").alias("path"), F.col("l_linenumber").alias("block"), F.col("l_quantity").cast("bigint").alias("taken"))
    return C.merge_counts(counts, ["path", "block"], "taken")


def _issues(spark, d):
    return S.normalised(table(spark, d, "issues"))


def issue_normalised(spark, d):
    return _issues(spark, d).select("issue_id", "path", "line", "severity", "fingerprint")


def issue_keep_first(spark, d):
    return S.keep_first(_issues(spark, d)).select("issue_id", "path", "fingerprint")


def issue_severity_histogram(spark, d):
    return S.histogram(S.keep_first(_issues(spark, d)))


def _issue_diff(spark, d):
    return _issues(spark, d).filter("severity = 'error' or pmod(line, 3) = 0").select("path", "line")


def issues_on_changed_lines(spark, d):
    return S.on_changed_lines(_issues(spark, d), _issue_diff(spark, d)).select("issue_id", "path", "line", "severity")


def issue_gate(spark, d):
    return S.gate(S.on_changed_lines(_issues(spark, d), _issue_diff(spark, d)), most_errors=0, most_warnings=10**9, most_issues=1000)


def issue_report_first(spark, d):
    return S.worst_first(_issues(spark, d), 50).select("issue_id", "path", "line", "severity")


def _cells(spark, d):
    return I.testmap(table(spark, d, "lineitem").select(F.concat(F.lit("t/"), "l_suppkey").alias("test_id"), F.concat(F.lit("part/"), "l_partkey").alias("path"), F.col("l_orderkey").alias("line")))


def testmap_build(spark, d):
    return _cells(spark, d)


def testmap_stats(spark, d):
    return I.testmap_stats(_cells(spark, d))


def impacted_tests(spark, d):
    return I.impacted(_cells(spark, d), _diff_files(spark, d))


def missing_mappings(spark, d):
    return I.missing(_cells(spark, d), _diff_files(spark, d))


def impact_confidence(spark, d):
    return I.confidence(_cells(spark, d), _diff_files(spark, d))


def greedy_test_plan(spark, d):
    return I.greedy_plan(_cells(spark, d), _diff(spark, d), max_tests=8)


def _known(spark, d):
    return table(spark, d, "supplier").filter("s_suppkey % 3 <> 0").select(F.concat(F.lit("t/"), "s_suppkey").alias("test_id"), (F.col("s_suppkey") * 100 + 7).alias("duration_ms"), (F.col("s_suppkey") % 9 + 1).alias("sample_count"), F.lit(800_000_000).cast("bigint").alias("last_seen"))


def timings_upsert(spark, d):
    seen = table(spark, d, "lineitem").filter("l_returnflag = 'A'").select(F.concat(F.lit("t/"), "l_suppkey").alias("test_id"), F.col("l_quantity").cast("bigint").alias("duration_ms"), F.unix_timestamp("l_shipdate").alias("seen"))
    return I.upsert_timings(_known(spark, d), seen)


def _tasks(spark, d):
    return I.with_estimates(table(spark, d, "supplier").select(F.concat(F.lit("t/"), "s_suppkey").alias("test_id")), _known(spark, d))


def test_estimates(spark, d):
    return _tasks(spark, d)


def whale_threshold(spark, d):
    return I.whale_threshold(_tasks(spark, d))


def lpt_shards(spark, d):
    return I.lpt_shards(_tasks(spark, d), 4)


def shard_metrics(spark, d):
    return I.shard_metrics(table(spark, d, "lineitem").select((F.col("l_suppkey") % 7).alias("shard_id"), F.col("l_quantity").cast("bigint").alias("est_ms")), 7, whale_ms=48)


def tag_filter(spark, d):
    tasks = table(spark, d, "part").select("p_partkey", F.split("p_type", " ").alias("tags"))
    return I.by_tags(tasks, include=["BRASS", "tin", "small"], exclude=["polished"]).select("p_partkey")


QUERIES = {
    f.__name__: f
    for f in (
        coverage_merge, coverage_total, coverage_by_file, coverage_below_threshold, coverage_missing_ranges, coverage_range_text, coverage_changed_lines, coverage_gate, coverage_counts_merge,
        issue_normalised, issue_keep_first, issue_severity_histogram, issues_on_changed_lines, issue_gate, issue_report_first,
        testmap_build, testmap_stats, impacted_tests, missing_mappings, impact_confidence, greedy_test_plan, timings_upsert, test_estimates, whale_threshold, lpt_shards, shard_metrics, tag_filter,
    )
}

_M = """
with merged as (select 'part/' || l_partkey as path, l_orderkey as line, bool_or(l_returnflag <> 'R') as covered from lineitem group by 1, 2),
files as (select path, count(*) as instrumented, count(*) filter (where covered) as covered, round(100.0 * count(*) filter (where covered) / count(*), 6) as pct from merged group by path),
ords as (select * from orders where o_orderdate >= timestamp '1998-01-01' and o_orderdate < timestamp '1998-03-01'),
diff as (select distinct 'part/' || l_partkey as path, l_orderkey as line from lineitem join ords on l_orderkey = o_orderkey union select 'cust/' || o_custkey, o_orderkey from ords),
changed as (select d.path, d.line, coalesce(m.covered, false) as covered from diff d left join merged m using (path, line) where m.covered is not null or d.path not in (select path from merged)),
islands as (select path, line, line - row_number() over (partition by path order by line) as i from merged where not covered),
ranges as (select path, min(line) as first_line, max(line) as last_line from islands group by path, i),
dfiles as (select distinct path, case when path like 'cust/1%' then 'part/' || split_part(path, '/', 2) end as old_path from diff),
cells as (select distinct 't/' || l_suppkey as test_id, 'part/' || l_partkey as path, l_orderkey as line from lineitem),
lost as (select path from dfiles where path not in (select path from cells) and (old_path is null or old_path not in (select path from cells))),
hit as (select distinct test_id from cells where path in (select path from dfiles union select old_path from dfiles where old_path is not null)),
known as (select 't/' || s_suppkey as test_id, s_suppkey * 100 + 7 as duration_ms, s_suppkey % 9 + 1 as sample_count, 800000000::bigint as last_seen from supplier where s_suppkey % 3 <> 0),
tasks as (select 't/' || s_suppkey as id, coalesce(duration_ms, 8000)::bigint as est_ms from supplier left join known on test_id = 't/' || s_suppkey)
"""
_I = r"""
with low as (select *, translate(trim(severity), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as s from issues where path is not null and line > 0),
n0 as (select issue_id, regexp_replace(regexp_replace(regexp_replace(replace(trim(path), '\', '/'), '^file://(localhost)?', ''), '^/?[A-Za-z]:/', ''), '^(\./)+', '') as path, line,
  case when s in ('error', 'err', 'fatal', 'critical', 'severe') then 'error' when s in ('warning', 'warn') then 'warning' else 'note' end as severity, rule_id, message, fingerprint as fp from low),
norm as (select issue_id, path, line, severity, coalesce(fp, substr(sha256(concat_ws(':', path, line::varchar, severity, coalesce(rule_id, 'unknown'), coalesce(message, ''))), 1, 16)) as fingerprint from n0),
firsts as (select * from norm where issue_id in (select min(issue_id) from norm group by path, fingerprint)),
idiff as (select distinct path, line from norm where severity = 'error' or line % 3 = 0),
onch as (select n.* from norm n where (path, line) in (select path, line from idiff))
"""
ORACLE = {
    "coverage_merge": _M + "select * from merged",
    "coverage_total": _M + "select count(*) as instrumented, count(*) filter (where covered) as covered, round(100.0 * count(*) filter (where covered) / count(*), 6) as pct from merged",
    "coverage_by_file": _M + "select * from files order by pct, path limit 50",
    "coverage_below_threshold": _M + "select * from files where pct < 60",
    "coverage_missing_ranges": _M + "select * from ranges",
    "coverage_range_text": _M + "select path, string_agg(case when first_line = last_line then first_line::varchar else first_line || '-' || last_line end, ', ' order by first_line) as ranges from ranges group by path",
    "coverage_changed_lines": _M + "select * from changed",
    "coverage_gate": _M + """, p as (select (select round(100.0 * count(*) filter (where covered) / count(*), 6) from merged) as total_pct,
 (select round(100.0 * count(*) filter (where covered) / nullif(count(*), 0), 6) from changed) as changed_pct,
 (select round(100.0 * count(*) filter (where covered) / nullif(count(*), 0), 6) from merged where path in (select 'part/' || p_partkey from part where p_size <= 5)) as new_pct)
 select *, concat_ws(',', case when changed_pct < 50 then 'changed_pct' end, case when new_pct < 80 then 'new_pct' end, case when total_pct < 70 then 'total_pct' end) as violations, not coalesce(changed_pct < 50 or new_pct < 80 or total_pct < 70, false) as passed from p""",
    "coverage_counts_merge": "select 'part/' || l_partkey as path, l_linenumber as block, sum(l_quantity::bigint)::bigint as taken from lineitem group by 1, 2",
    "issue_normalised": _I + "select issue_id, path, line, severity, fingerprint from norm",
    "issue_keep_first": _I + "select issue_id, path, fingerprint from firsts",
    "issue_severity_histogram": _I + "select severity, count(*) as n from firsts group by 1",
    "issues_on_changed_lines": _I + "select issue_id, path, line, severity from onch",
    "issue_gate": _I + ", g as (select count(*) filter (where severity = 'error') as errors, count(*) filter (where severity = 'warning') as warnings, count(*) as total from onch) select *, concat_ws(',', case when errors > 0 then 'errors' end, case when total > 1000 then 'total' end) as violations, not (errors > 0 or total > 1000) as passed from g",
    "issue_report_first": _I + "select issue_id, path, line, severity from norm order by path, line, case severity when 'error' then 3 when 'warning' then 2 else 1 end, issue_id limit 50",
    "testmap_build": _M + "select * from cells",
    "testmap_stats": _M + "select count(distinct test_id) as tests, count(distinct path) as files, count(*) as cells from (select distinct test_id, path from cells)",
    "impacted_tests": _M + "select * from hit",
    "missing_mappings": _M + "select * from lost",
    "impact_confidence": _M + ", r as (select (select count(*) from dfiles) as changed_files, (select count(*) from lost) as missing_files, (select count(*) from hit) as selected, (select count(distinct test_id) from cells) as tests) select *, round((changed_files - missing_files) / changed_files, 6) as confidence, selected / tests > 0.4 as run_all from r",
    "timings_upsert": _M + """, new as (select 't/' || l_suppkey as test_id, sum(l_quantity::bigint)::bigint // count(*) as avg, count(*) as n, max(epoch(l_shipdate)::bigint) as seen from lineitem where l_returnflag = 'A' group by 1)
 select test_id, case when n is null then duration_ms when sample_count is null then avg else (duration_ms * sample_count + avg * n) // (sample_count + n) end as duration_ms, (coalesce(sample_count, 0) + coalesce(n, 0))::bigint as sample_count, greatest(last_seen, seen) as last_seen from known full join new using (test_id)""",
    "test_estimates": _M + "select * from tasks",
    "whale_threshold": _M + "select quantile_disc(est_ms, 0.95)::bigint as p95_ms, greatest(30000, 2 * quantile_disc(est_ms, 0.95))::bigint as threshold_ms from tasks",
    "lpt_shards": _M + """, ranked as (select id, est_ms, row_number() over (order by est_ms desc, id) as rk from tasks),
 r as (select t.* from (with recursive f(rk, l0, l1, l2, l3, id, est_ms, k) as (
  select 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint, ''::varchar, 0::bigint, -1
  union all
  select q.rk, f.l0 + case when s = 0 then q.est_ms else 0 end, f.l1 + case when s = 1 then q.est_ms else 0 end, f.l2 + case when s = 2 then q.est_ms else 0 end, f.l3 + case when s = 3 then q.est_ms else 0 end, q.id, q.est_ms, s
  from f join ranked q on q.rk = f.rk + 1, lateral (select case when f.l0 <= least(f.l1, f.l2, f.l3) then 0 when f.l1 <= least(f.l2, f.l3) then 1 when f.l2 <= f.l3 then 2 else 3 end as s) x)
  select * from f) t) select k as shard_id, id, est_ms from r where k >= 0""",
    "shard_metrics": "with l as (select sum(l_quantity::bigint)::bigint as load from lineitem group by l_suppkey % 7) select max(load) as makespan_ms, sum(load)::bigint as total_ms, round(max(load) / median(load), 6) as imbalance, round(sum(load)::double / (max(load) * 7), 6) as efficiency, round((select sum(q) from (select l_quantity::bigint as q from lineitem order by q desc limit 10))::double / sum(load), 6) as top_10_share, (select count(*) from lineitem where l_quantity::bigint > 48) as whales from l",
    "tag_filter": "select p_partkey from part where list_has_any(list_transform(string_split(p_type, ' '), lambda x: lower(x)), ['brass', 'tin', 'small']) and not list_has_any(list_transform(string_split(p_type, ' '), lambda x: lower(x)), ['polished'])",
}
