"""The format readers over texts made from the test tables; every text holds the lines of a bounded range of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from artefold.sources import formats as R
from artefold.sources import sinks
from artefold.session import table


def _points(spark, d) -> DataFrame:
    """``path, line, hits``: the line items as covered lines of a few files."""
    li = table(spark, d, "lineitem")
    return li.select(F.format_string("src/s%d_%d.rs", F.col("l_suppkey") % 40, F.expr("l_orderkey div 5000")).alias("path"), ((F.col("l_partkey") % 300) * 7 + F.col("l_linenumber")).cast("int").alias("line"), (F.col("l_quantity").cast("int") % 3).alias("hits"))


def _texts(points: DataFrame, head: Column, each: Column, glue: str, tail: Column) -> DataFrame:
    """One text for each path, its lines in order."""
    rows = points.select("path", F.struct("line", "hits", each.alias("t")).alias("x")).groupBy("path").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return rows.select("path", F.concat(head, F.array_join(F.col("xs.t"), glue), tail).alias("content"))


def lcov_read(spark, d):
    p = _points(spark, d)
    f = _texts(p, F.concat(F.lit("TN:\nSF:"), "path", F.lit("\n")), F.format_string("DA:%d,%d", "line", "hits"), "\n", F.lit("\nend_of_record\n"))
    return R.coverage(f.withColumn("path", F.concat("path", F.lit(".info")))).drop("format")


def gocov_read(spark, d):
    p = _points(spark, d)
    f = _texts(p, F.lit("mode: set\n"), F.format_string("github.com/u/p/%s:%d.1,%d.9 1 %d", "path", "line", F.col("line") + 2, "hits"), "\n", F.lit("\n"))
    return R.coverage(f).drop("format")


def llvmcov_read(spark, d):
    p = _points(spark, d)
    f = _texts(p, F.concat(F.lit('{"data": [{"files": [{"filename": "'), "path", F.lit('", "segments": [')), F.format_string("[%d, 1, %d, true, true]", "line", "hits"), ", ", F.lit("]}]}]}"))
    return R.coverage(f).drop("format")


def jacoco_read(spark, d):
    p = _points(spark, d)
    f = _texts(p, F.concat(F.lit('<?xml version="1.0"?><report name="r"><package name="com/e"><sourcefile name="'), F.regexp_replace("path", ".*/", ""), F.lit('">')), F.format_string('<line nr="%d" mi="0" ci="%d"/>', "line", "hits"), "", F.lit("</sourcefile></package></report>"))
    return R.coverage(f).drop("format")


def cobertura_read(spark, d):
    p = _points(spark, d)
    head = F.concat(F.lit('<?xml version="1.0"?><coverage><packages><package name="p"><classes><class name="c" filename="'), "path", F.lit('"><lines>'))
    f = _texts(p, head, F.format_string('<line number="%d" hits="%d"/>', "line", "hits"), "", F.lit("</lines></class></classes></package></packages></coverage>"))
    return R.coverage(f).drop("format")


def diff_read(spark, d):
    p = _points(spark, d)
    head = F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path", F.lit("\n"))
    return R.diff_lines(_texts(p, head, F.format_string("@@ -1,1 +%d,%d @@", "line", "hits"), "\n+x\n", F.lit("\n")))


def junit_read(spark, d):
    li = table(spark, d, "lineitem").select(F.expr("l_orderkey div 5000").alias("part"), (F.col("l_suppkey") % 40).alias("s"), (F.col("l_partkey") % 100).alias("k"), F.col("l_quantity").cast("int").alias("q"))
    case = F.format_string('<testcase classname="c.S%d" name="t%d" time="%.3f"/>', "s", "k", F.col("q") / 8)
    f = li.groupBy(F.concat(F.lit("r"), "s", F.lit("_"), "part").alias("path")).agg(F.array_sort(F.collect_list(case)).alias("xs")).select("path", F.concat(F.lit("<testsuite>"), F.array_join("xs", ""), F.lit("</testsuite>")).alias("content"))
    return R.junit_timings(f)


def sarif_read(spark, d):
    i = table(spark, d, "issues").filter("path is not null and line is not null and rule_id is not null and message is not null")
    place = F.struct(F.struct(F.concat(F.lit("f"), F.col("issue_id") % 90).alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region"))
    prints = F.create_map(F.lit("b"), F.coalesce("fingerprint", F.lit("none")), F.lit("a"), F.lit(""))
    result = F.to_json(F.struct(F.col("rule_id").alias("ruleId"), F.lit("error").alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(F.struct(place.alias("physicalLocation"))).alias("locations"), prints.alias("partialFingerprints")))
    rows = i.groupBy(F.format_string("%012d", F.expr("issue_id div 1000")).alias("path")).agg(F.array_sort(F.collect_list(F.struct("issue_id", result.alias("t")))).alias("xs"))
    f = rows.select("path", F.concat(F.lit('{"$schema": "sarif", "runs": [{"tool": {"driver": {"name": "lintel"}}, "results": ['), F.array_join(F.col("xs.t"), ","), F.lit("]}]}")).alias("content"))
    return R.sarif_issues(f).groupBy("path", "rule_id", "source", "severity").agg(F.count("*").alias("n"), F.min("line").alias("line"))


def _files(spark, d) -> DataFrame:
    p = _points(spark, d).groupBy("path", "line").agg(F.max(F.col("hits") > 0).alias("c"))
    g = p.groupBy("path").agg(F.count_if("c").alias("covered"), F.count("*").alias("instrumented"))
    return g.withColumn("pct", F.col("covered") * 100.0 / F.col("instrumented"))


def report_json(spark, d):
    return sinks.report_json(_files(spark, d)).select("path", F.get_json_object("text", "$.covered").cast("bigint").alias("covered"), F.get_json_object("text", "$.pct").cast("double").alias("pct"))


def report_pr_comment(spark, d):
    return sinks.pr_comment(_files(spark, d), most=10)


QUERIES = {f.__name__: f for f in (lcov_read, gocov_read, llvmcov_read, jacoco_read, cobertura_read, diff_read, junit_read, sarif_read, report_json, report_pr_comment)}

_P = "with p as (select 'src/s' || (l_suppkey % 40) || '_' || (l_orderkey // 5000) || '.rs' as path, ((l_partkey % 300) * 7 + l_linenumber)::int as line, trunc(l_quantity)::int % 3 as hits from lineitem)"
_F = _P + ", l as (select path, line, max(hits) > 0 as c from p group by 1, 2), f as (select path, count(*) filter (where c) as covered, count(*) as instrumented, count(*) filter (where c) * 100.0 / count(*) as pct from l group by 1)"
ORACLE = {
    "lcov_read": _P + " select path, line, max(hits) > 0 as covered from p group by 1, 2",
    "gocov_read": _P + ", r as (select path, unnest(range(line, line + 3))::int as line, hits from p) select path, line, max(hits) > 0 as covered from r group by 1, 2",
    "llvmcov_read": _P + ", s as (select *, lead(line) over (partition by path order by line, hits) as nxt from p), r as (select path, unnest(range(line, greatest(line, coalesce(nxt - 1, line)) + 1))::int as line, hits from s) select path, line, max(hits) > 0 as covered from r group by 1, 2",
    "jacoco_read": _P + " select 'com/e/' || regexp_extract(path, '[^/]*$') as path, line, max(hits) > 0 as covered from p group by 1, 2",
    "cobertura_read": _P + " select path, line, max(hits) > 0 as covered from p group by 1, 2",
    "diff_read": _P + " select distinct path, unnest(range(line, line + hits))::int as line from p",
    "junit_read": "select 'c.S' || (l_suppkey % 40) || '.t' || (l_partkey % 100) as test_id, sum(trunc(l_quantity)::bigint * 125)::bigint as duration_ms from lineitem group by 1",
    "sarif_read": "with i as (select 'f' || (issue_id % 90) as path, line, rule_id, coalesce(fingerprint, 'none') as fp, issue_id as o from issues where path is not null and line > 0 and rule_id is not null and message is not null), k as (select *, row_number() over (partition by path, fp order by o) as k from i) select path, rule_id, 'lintel' as source, 'error' as severity, count(*) as n, min(line) as line from k where k = 1 group by 1, 2",
    "report_json": _F + " select path, covered, round(pct, 2)::double as pct from f",
    "report_pr_comment": _F + " select 0 as ord, printf('**Coverage: %.1f%%**', sum(covered) * 100.0 / sum(instrumented)) as text from f union all select 1, printf('- `%s` %.1f%%', path, pct::double) from (select * from f order by pct, path limit 10)",
}
