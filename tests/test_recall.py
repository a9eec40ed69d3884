"""Recall of many queries: against plain BM25 in Python, and every query of the rule."""

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from artefold.functions import text as T
from artefold.operators import recall
from artefold.plans import registry
from artefold.session import table


def _words(text):
    """The search terms, by one pass over the characters."""
    low = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x)
    out = set()
    for part in re.split(r"[^\w:/]+", text):
        for segment in [part, *re.split("[/:._-]+", part)]:
            out.add(low(segment))
            if segment != part or not re.search("[/:._-]", part):
                now = ""
                for k, c in enumerate(segment):
                    before, after = segment[k - 1 : k], segment[k + 1 : k + 2]
                    upper = lambda x: x.isascii() and x.isupper()
                    digit = lambda x: x.isascii() and x.isdigit()
                    lower = lambda x: x.isascii() and x.islower()
                    if now and ((upper(c) and lower(before)) or digit(c) != digit(before) or (upper(before) and upper(c) and after and lower(after))):
                        out.add(low(now))
                        now = ""
                    now += c
                out.add(low(now))
    return {w for w in out if len(w.encode()) >= 2}


def brute(docs, queries, k):
    """{id: text}, {query: text} -> (query, id, score, matched, rank) rows."""
    tf = {i: Counter(w for line in t.split("\n") for w in _words(line)) for i, t in docs.items()}
    tf = {i: c for i, c in tf.items() if c}
    df = Counter(w for c in tf.values() for w in c)
    size = {i: sum(c.values()) for i, c in tf.items()}
    avg = sum(size.values()) / len(size)
    holders = defaultdict(list)
    for i, c in tf.items():
        for w in c:
            holders[w].append(i)
    out = []
    for q, text in queries.items():
        score, matched = Counter(), Counter()
        for w in _words(text):
            for i in holders[w]:
                score[i] += math.log((len(tf) - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[i][w] * 2.5 / (tf[i][w] + 1.5 * (0.25 + 0.75 * size[i] / avg))
                matched[i] += 1
        best = sorted((-round(s, 6), i) for i, s in score.items())[:k]
        out += [(q, i, round(-s, 4), matched[i], r) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def _rows(df):
    return sorted((r.query_id, r.id, round(r.score, 4), r.matched, r["rank"]) for r in df.collect())


def test_every_twentieth_issue_is_a_query(spark, small):
    docs = {r.doc_id: r.text for r in table(spark, small, "documents").collect() if r.text is not None}
    queries = {r.issue_id: r.message for r in table(spark, small, "issues").collect() if r.issue_id % 20 == 0 and r.message is not None}
    got = _rows(registry.queries()["bm25_recall"](spark, small))
    assert len({r[0] for r in got}) > 10 and got == brute(docs, queries, 8)


def test_blocks_ties_and_queries_without_hits(spark):
    docs = {i: f"alpha beta{i % 3}\nalpha gamma" if i % 2 else f"beta{i % 3} delta" for i in range(40)}
    queries = {i: t for i, t in enumerate(["alpha beta1", "delta", "nothing here", "gamma beta2 beta0", ""])}
    post = recall.postings(spark.createDataFrame(list(docs.items()), "d long, t string").selectExpr("d", "split(t, '\n') as s"), "d", "s")
    asked = spark.createDataFrame([(q, w) for q, t in queries.items() for w in _words(t)], "query_id long, term string")
    assert _rows(recall.best_bm25(post, asked, 3, docs_at_once=7, queries_at_once=2)) == brute(docs, queries, 3)
    assert recall.best_bm25(post, asked.limit(0), 3).collect() == []


def test_tokenize_expands_identifiers(spark):
    got = spark.range(1).select(T.tokenize(F.lit("parseHTTPServer2 src/app_core.rs:12 élan-vital a")).alias("t")).first().t
    assert got == ["parsehttpserver2", "parse", "http", "server", "src/app_core", "src", "app", "core", "rs:12", "rs", "12", "élan", "vital"]
    assert set(got) == _words("parseHTTPServer2 src/app_core.rs:12 élan-vital a")
