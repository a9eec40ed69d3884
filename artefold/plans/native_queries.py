"""Relational breadth that comes with the engine: grouping sets, ranks, set operations, sketches, event-time windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from artefold.session import table


def _sales(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("bigint").alias("q"))


def rollup_sales(spark, d):
    return _sales(spark, d).rollup("l_returnflag", "l_linestatus").agg(F.sum("q").alias("qty"), F.count("*").alias("n"))


def cube_sales(spark, d):
    return _sales(spark, d).cube("l_returnflag", "l_linestatus").agg(F.sum("q").alias("qty"))


def pivot_sales(spark, d):
    return _sales(spark, d).groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum("q"))


def rank_suppliers(spark, d):
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", F.rank().over(w).alias("rk"), F.ntile(4).over(w).alias("quartile"))


def intersect_parts(spark, d):
    li = table(spark, d, "lineitem")
    return li.filter("l_returnflag = 'R'").select("l_partkey").intersect(li.filter("l_linestatus = 'O'").select("l_partkey"))


def except_customers(spark, d):
    return table(spark, d, "customer").select("c_custkey").exceptAll(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct())


def session_counts(spark, d):
    e = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("w.start").alias("start"), "n")


def sliding_counts(spark, d):
    e = table(spark, d, "events").groupBy(F.window("ts", "1 day", "12 hours").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return e.select(F.col("w.start").alias("start"), "event_type", "n")


def approx_users(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"))


QUERIES = {f.__name__: f for f in (rollup_sales, cube_sales, pivot_sales, rank_suppliers, intersect_parts, except_customers, session_counts, sliding_counts, approx_users)}
_S = "with s as (select l_returnflag, l_linestatus, l_quantity::bigint as q from lineitem) "
ORACLE = {
    "rollup_sales": _S + "select l_returnflag, l_linestatus, sum(q)::bigint as qty, count(*) as n from s group by rollup (l_returnflag, l_linestatus)",
    "cube_sales": _S + "select l_returnflag, l_linestatus, sum(q)::bigint as qty from s group by cube (l_returnflag, l_linestatus)",
    "pivot_sales": _S + "select l_returnflag, (sum(q) filter (where l_linestatus = 'F'))::bigint as \"F\", (sum(q) filter (where l_linestatus = 'O'))::bigint as \"O\" from s group by 1",
    "rank_suppliers": "select s_suppkey, rank() over w::int as rk, ntile(4) over w::int as quartile from supplier window w as (partition by s_nationkey order by s_acctbal desc, s_suppkey)",
    "intersect_parts": "select l_partkey from lineitem where l_returnflag = 'R' intersect select l_partkey from lineitem where l_linestatus = 'O'",
    "except_customers": "select c_custkey from customer where c_custkey not in (select o_custkey from orders)",
    "session_counts": "with n as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '2 hours' then 0 else 1 end as f from events), g as (select *, sum(f) over (partition by user_id order by ts rows unbounded preceding) as s from n) select user_id, min(ts) as start, count(*) as n from g group by user_id, s",
    "sliding_counts": "with w as (select event_type, time_bucket(interval '12 hours', ts, timestamp '1970-01-01') as b from events), e as (select event_type, b as start from w union all select event_type, b - interval '12 hours' from w) select start, event_type, count(*) as n from e group by 1, 2",
}
