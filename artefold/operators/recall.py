"""Recall: inverted index, BM25, filters, store upkeep."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from artefold.functions.text import tokenize
from artefold.session import written

K1, B = 1.5, 0.75


def postings(docs: DataFrame, id_col: str, strings: "F.Column") -> DataFrame:
    """``id, term, tf``: in how many strings of a document's array a term stands, each string counting a term once."""
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(strings).alias("pos", "s")).select("id", "pos", F.explode(tokenize(F.col("s"))).alias("term"))
    return rows.groupBy("id", "term").agg(F.count("*").alias("tf"))


def lengths(post: DataFrame) -> DataFrame:
    """``id, length``: the unique terms per string, summed."""
    return post.groupBy("id").agg(F.sum("tf").alias("length"))


def _gain() -> "F.Column":
    """What a term adds to the score of a document."""
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg")))


def bm25(post: DataFrame, queries: DataFrame, *, n_docs: DataFrame | None = None) -> DataFrame:
    """``query_id, id, score, matched`` for queries ``(query_id, term)``.

    Document counts, their average length and document frequencies are
    aggregates over all documents.
    """
    size = lengths(post)
    stats = size.agg(F.count("*").alias("n"), F.avg("length").alias("avg"))
    wanted = queries.select("query_id", "term").distinct()
    hits = post.join(wanted, "term")
    df = post.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    rows = hits.join(df, "term").join(size, "id").crossJoin(F.broadcast(stats))  # one row
    return rows.groupBy("query_id", "id").agg(F.round(F.sum(_gain()), 6).alias("score"), F.count("*").alias("matched"))


def _weighted(post: DataFrame, wanted: DataFrame) -> DataFrame:
    """``id, term, w``: what each wanted term adds to the scores of the documents that hold it."""
    size = lengths(post)
    stats = size.agg(F.count("*").alias("n"), F.avg("length").alias("avg"))
    hits = post.join(wanted.select("term").distinct(), "term", "left_semi")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    return hits.join(df, "term").join(size, "id").crossJoin(F.broadcast(stats)).select("id", "term", _gain().alias("w"))  # one row


def best(scored: DataFrame, k: int, *, tie: str = "id") -> DataFrame:
    """The ``k`` best of each query; ties go to the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), tie)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(k, 1))


def best_bm25(post: DataFrame, queries: DataFrame, k: int, *, docs_at_once: int = 2_000, queries_at_once: int = 20_000) -> DataFrame:
    """``best(bm25(post, queries), k)`` for many queries, without a row for each pair of query and document.

    Blocks of documents meet blocks of queries; each pair of blocks is scored
    as a matrix, of which only the ``k`` best of each query leave, so that no
    pair that could be among them is lost.
    """
    wanted = written(queries.select("query_id", "term").distinct(), "recall-queries")
    weights = written(_weighted(written(post, "recall-postings"), wanted), "recall-weights")
    n_docs = 1 + weights.select("id").distinct().count() // docs_at_once
    n_queries = 1 + wanted.select("query_id").distinct().count() // queries_at_once
    kind = {c: t for c, t in wanted.dtypes + weights.dtypes}
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = weights.withColumns({"db": F.pmod(F.xxhash64("id"), F.lit(n_docs)).cast("int"), "qb": spread(n_queries)})
    right = wanted.withColumns({"qb": F.pmod(F.xxhash64("query_id"), F.lit(n_queries)).cast("int"), "db": spread(n_docs)})

    def score(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        return _block_best(held, asked, max(k, 1))

    tasks = max(n_docs * n_queries, 1)
    pairs = left.repartition(tasks, "db", "qb").groupBy("db", "qb").cogroup(right.repartition(tasks, "db", "qb").groupBy("db", "qb"))
    found = best(pairs.applyInPandas(score, f"query_id {kind['query_id']}, id {kind['id']}, score double"), k).select("query_id", "id")
    rows = found.join(wanted, "query_id").join(weights, ["id", "term"])
    return best(rows.groupBy("query_id", "id").agg(F.round(F.sum("w"), 6).alias("score"), F.count("*").alias("matched")), k)


def _block_best(held: pd.DataFrame, asked: pd.DataFrame, k: int, width: int = 512) -> pd.DataFrame:
    """``query_id, id, score``: the ``k`` best of each query ``(query_id, term)`` among documents ``(id, term, w)``."""
    asked = asked[asked["term"].isin(held["term"].unique())]
    out = [pd.DataFrame({"query_id": asked["query_id"][:0], "id": held["id"][:0], "score": np.zeros(0)})]
    query_ids, at = np.unique(asked["query_id"].to_numpy(), return_inverse=True)
    who = {t: np.sort(at[i]) for t, i in asked.groupby("term").indices.items()}
    held = held[held["term"].isin(list(who))]
    ids, place = np.unique(held["id"].to_numpy(), return_inverse=True)  # ascending: the first of equals is the smaller id
    terms, w = held["term"].to_numpy(), held["w"].to_numpy(np.float64)
    for start in range(0, len(ids), width):
        inside = np.flatnonzero((place >= start) & (place < start + width))
        scores = np.zeros((len(query_ids), min(width, len(ids) - start)))
        for term, i in pd.Series(terms[inside]).groupby(terms[inside]).indices.items():
            scores[np.ix_(who[term], place[inside[i]] - start)] += w[inside[i]]
        scores = np.where(scores > 0, np.round(scores, 6), -1.0)  # -1: no term in common
        row = np.arange(len(query_ids))
        for _ in range(min(k, scores.shape[1])):
            top = scores.argmax(axis=1)
            value = scores[row, top]
            hit = value >= 0
            if not hit.any():
                break
            out.append(pd.DataFrame({"query_id": query_ids[hit], "id": ids[start + top[hit]], "score": value[hit]}))
            scores[row, top] = -1.0
    full = pd.concat(out, ignore_index=True).sort_values(["score", "id"], ascending=[False, True], kind="stable")
    return full.groupby("query_id", sort=False).head(k)


def recency_bonus(age_seconds: "F.Column") -> "F.Column":
    """At most 0.25, halved after a day."""
    return F.lit(0.25) * F.least(1 / (1 + F.greatest(age_seconds, F.lit(0)) / 86400), F.lit(1.0))


def fresh(entries: DataFrame, ttl_seconds: int, as_of: "F.Column") -> DataFrame:
    """Entries younger than the time to live; 0 keeps all."""
    return entries if ttl_seconds == 0 else entries.filter(as_of - F.col("created") <= ttl_seconds)


def latest_per_key(entries: DataFrame, key: str, at: str, row_id: str) -> DataFrame:
    """The newest entry of each key: a partial aggregate, so no key is hot."""
    newest = entries.groupBy(key).agg(F.max(F.struct(F.col(at).alias("at"), F.col(row_id).alias("r"))).alias("n")).select(F.col("n.r").alias(row_id))
    return entries.join(newest, row_id, "left_semi")


def stats(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("entries"), F.min("created").alias("oldest"), F.max("created").alias("newest"), F.countDistinct("kind").alias("kinds"))


def page(entries: DataFrame, *, contains: str | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
    """One page of the listing: newest first, then by id."""
    rows = entries if contains is None else entries.filter(F.col("kind").contains(contains))
    return rows.orderBy(F.desc("created"), "id").offset(offset).limit(limit)
