"""Evaluation texts that leaked into a corpus.

A case is a pair of document and test item where the document reproduces a
stretch of at least ``stretch`` running words of the item with at most one
word in ``per_edit`` replaced, dropped or added, and in it at least ``RUN``
equal words in a row that are the item's own.  Not its own are the words of
stock passages: runs of fewer than ``stock_words`` words that ``stock_items``
or more different item texts share.  So an instruction sentence with a word that
happens to agree behind it is no case of all items that begin with it.

Candidates: windows of ``stretch`` words of items and documents are embedded
by CGK random walks, which turn a small edit distance into a small Hamming
distance, and hashed by sampled coordinates of the embedding; ``tables``
independent walks and samples bring the recall of a single window above the
target.  Documents are read once, whatever the number of items: a bitmap of
bounded size holds the keys of all items, and of documents with a key in it
the word codes and those keys are written.  Keys of documents and items then
meet in a join, and every candidate pair is verified exactly, by alignment.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artefold.session import written

_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile("[​-‏⁠﻿­]")
_ATTRIBUTE = r"""\s+[\w:@.-]+(?:\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=]+))?"""
_TAG = re.compile(rf"</?[A-Za-z][\w:.-]*(?:{_ATTRIBUTE})*\s*/?>|<!--.*?-->", re.S)
_WRAPPED = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t]*(?:(?:>|\||\*|#|//|--)[ \t]*)*(?=[^\W\d_])")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\([nrtbf])|\\(?=\W)")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")


def _unescaped(m: re.Match) -> str:
    return chr(int(m[1], 16)) if m[1] else " " if m[2] else ""


def _unquoted(m: re.Match) -> str:
    return bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace")


def words(text: str | None) -> list[str]:
    """The words that count: without case, punctuation, markup, escapes and layout."""
    if not isinstance(text, str) or not text:
        return []
    if "\\" in text:
        text = _ESCAPE.sub(_unescaped, text)
    if "%" in text:
        text = _PERCENT.sub(_unquoted, text)
    if "&" in text:
        text = html.unescape(html.unescape(text))
    text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if "<" in text:
        text = _TAG.sub("", text)
    if "-" in text:
        text = _WRAPPED.sub("", text)
    return _WORD.findall(unicodedata.normalize("NFKC", text.casefold()))


@dataclass(frozen=True)
class LeakSpec:
    """``tables`` and ``bits`` set recall against work; tests/llm measures the recall.

    ``filter_bits`` bounds the bitmaps sent to all tasks (64 MB each); a
    fuller bitmap lets more documents through and loses none.
    """

    stretch: int = 12
    per_edit: int = 8
    tables: int = 16
    bits: int = 7
    seed: int = 7
    stock_items: int = 3
    stock_words: int = 24
    filter_bits: int = 1 << 29


def word_codes(tokens: list[str]) -> np.ndarray:
    """A 64-bit hash for each word."""
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in tokens), np.uint64, len(tokens))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


class Embedding:
    """CGK walks over windows of words and the bit-sampling keys of their embeddings."""

    def __init__(self, spec: LeakSpec) -> None:
        self.spec = spec
        rng = np.random.default_rng(spec.seed)
        self.steps = 3 * spec.stretch
        self.salts = rng.integers(1, 2**63, (spec.tables, self.steps), dtype=np.uint64) | np.uint64(1)
        # coordinates are sampled from the part of the walk that a window always reaches
        self.sampled = np.stack([np.sort(rng.choice(int(1.6 * spec.stretch), spec.bits, replace=False)) for _ in range(spec.tables)])
        self.names = rng.integers(1, 2**63, spec.tables, dtype=np.uint64)

    def keys(self, codes: np.ndarray, starts: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The keys of the window at each of ``starts``, one row per table: hashes of the sampled coordinates.

        Second, whether a sampled coordinate is a word of ``own``, a mask of the words.

        At each step the walk writes the word it stands on and moves on if a
        random bit of (step, word) says so; behind the end it writes 0.  All
        tables walk at once, over some thousands of windows at a time.
        """
        own = np.ones(len(codes), bool) if own is None else own
        parts = [self._keys(codes, starts[k : k + 8192], own) for k in range(0, len(starts), 8192)]
        none = np.empty((self.spec.tables, 0))
        return (np.concatenate([p[0] for p in parts], axis=1), np.concatenate([p[1] for p in parts], axis=1)) if parts else (none.astype(np.uint64), none.astype(bool))

    def _keys(self, codes: np.ndarray, starts: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width, last = self.spec.stretch, len(codes) - 1
        at = np.zeros((self.spec.tables, len(starts)), np.int64)
        key = np.repeat(self.names[:, None], len(starts), axis=1)
        met = np.zeros(key.shape, bool)
        for step in range(self.sampled.max() + 1):
            inside = at < width
            here = np.where(inside, codes[np.minimum(starts + at, last)], np.uint64(0))
            wanted = np.flatnonzero((self.sampled == step).any(axis=1))
            if len(wanted):
                key[wanted] = _mix(key[wanted] * np.uint64(0x9E3779B97F4A7C15) + here[wanted])
                met[wanted] |= (inside & own[np.minimum(starts + at, last)])[wanted]
            move = (_mix(here * self.salts[:, step, None]) >> np.uint64(40)) & np.uint64(1)
            at += move.astype(np.int64) & inside
        return key, met


RUN = 5  # a case of 12 words or more has so many equal words in a row; see ``verified``
_FIVE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)


def _run_keys(codes: np.ndarray) -> np.ndarray:
    """A hash of each ``RUN`` words."""
    n = len(codes) - RUN + 1
    return sum((codes[k : k + n] * _FIVE[k] for k in range(RUN)), np.zeros(max(n, 0), np.uint64)) if n > 0 else np.empty(0, np.uint64)


def _snake(a: list, b: list, i: int, j: int) -> int:
    n = 0
    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
        n += 1
    return n


def _reach(a: list, b: list, most: int) -> list[int]:
    """For 0..most edits, the most words of ``a`` that an alignment of prefixes with so many edits covers, if it ends on equal words.

    Furthest-reaching points by diagonal; of each way to a point the match
    that follows is noted before only the furthest is carried on.
    """
    n = _snake(a, b, 0, 0)
    best, front = [n], {0: n}
    for _ in range(most):
        top, nxt = best[-1], {}
        ways: dict[int, set[int]] = {}
        for d, i in front.items():  # i words of a and i + d of b are used
            if i < len(a) and i + d < len(b):
                ways.setdefault(d, set()).add(i + 1)  # replaced
            if i < len(a):
                ways.setdefault(d - 1, set()).add(i + 1)  # dropped from a
            if i + d < len(b):
                ways.setdefault(d + 1, set()).add(i)  # added in b
        for d, starts in ways.items():
            for i in starts:
                n = _snake(a, b, i, i + d)
                # without a match to follow, the last words may be equal all the same: the edit is then moved before them
                if i + n > top and (n or (i and i + d and a[i - 1] == b[i + d - 1])):
                    top = i + n
                nxt[d] = max(nxt.get(d, 0), i + n)
        front = nxt
        best.append(top)
    return best


def verified(item: np.ndarray, doc: np.ndarray, spec: LeakSpec, own: np.ndarray | None = None) -> bool:
    """Whether ``doc`` has a stretch of ``item`` as the case wants, exactly; ``own`` masks the words of the item that are no stock.

    The stretch begins and ends on equal words; with n item words and e edits
    it is a case if n is at least ``stretch`` and ``per_edit`` times e at most
    n.  n - e equal words in e + 1 runs mean that one run has ``RUN`` words at
    least, so every case goes through a run found by hash; from it the
    alignment is extended to both sides with 0, 1, 2 and 3 edits.

    With 12 words and one edit in eight, three edits are enough to look for.
    Let a smallest case have runs of equal words r0, r1, ... parted by groups
    of neighbouring edits.  Then each run has at most 11 words, two runs with
    a group of k edits between them fewer than max(12, 8k), and so on; adding
    these up, n stays below 8e for every grouping of e > 3 edits.
    """
    most = 3 if (spec.stretch, spec.per_edit) == (12, 8) else len(item) // spec.per_edit
    sorted_runs, order = _sorted_runs(item)
    runs = _run_keys(doc)
    left, right = np.searchsorted(sorted_runs, runs, "left"), np.searchsorted(sorted_runs, runs, "right")
    pairs = {(int(j), int(i)) for j in np.flatnonzero(right > left) for i in order[left[j] : right[j]]}
    if own is not None:
        counted = set(own_runs(own).tolist())
        seeds = {(j, i) for j, i in pairs if i in counted}
    else:
        seeds = pairs
    if not seeds:
        return False
    a, b = item.tolist(), doc.tolist()
    for j, i in seeds:
        if (j - 1, i - 1) in seeds or a[i : i + RUN] != b[j : j + RUN]:
            continue  # inside a longer run, or a clash of hashes
        # both ways go through the whole run, so that an edit at its edge can change places with a word of it
        while i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        run, far = _snake(a, b, i, j), spec.per_edit * (most + 4)
        ahead = _reach(a[i : i + run + far], b[j : j + run + far + most], most)
        behind = _reach(a[max(0, i - far) : i + run][::-1], b[max(0, j - far - most) : j + run][::-1], most)
        for e, more in enumerate(ahead):
            for f, less in enumerate(behind[: most + 1 - e]):
                if more + less - run >= max(spec.stretch, spec.per_edit * (e + f)):
                    return True
    return False


def _sorted_runs(item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = _run_keys(item)
    order = np.argsort(keys, kind="stable")
    return keys[order], order


def own_words(n: int, stock: np.ndarray, spec: LeakSpec) -> np.ndarray:
    """A mask of ``n`` words, false in stock passages; ``stock`` are the places of shared runs of ``RUN`` words, ascending."""
    own = np.ones(n, bool)
    for part in np.split(stock, np.flatnonzero(np.diff(stock) != 1) + 1) if len(stock) else []:
        if part[-1] - part[0] + RUN < spec.stock_words:
            own[part[0] : part[-1] + RUN] = False
    return own


def own_runs(own: np.ndarray) -> np.ndarray:
    """Where ``RUN`` own words in a row begin."""
    sums = np.concatenate([[0], np.cumsum(own)])
    return np.flatnonzero(sums[RUN:] - sums[:-RUN] == RUN)


def _signed(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.uint64).view(np.int64)


def _unsigned(codes) -> np.ndarray:
    return np.asarray(codes, np.int64).view(np.uint64)


def prepared_items(items: DataFrame, spec: LeakSpec, *, item_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The distinct texts (``tid, codes, stock``) and the items of each (``item, tid``).

    Texts with fewer words than a stretch can have no case and are left out.
    """
    kind = items.schema[item_id].dataType.simpleString()

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, _signed(word_codes(words(t)))) for i, t in zip(pdf["item"], pdf["text"])]
            yield pd.DataFrame([r for r in rows if len(r[1]) >= spec.stretch], columns=["item", "codes"])

    given = items.select(F.col(item_id).alias("item"), F.col(text).alias("text")).filter("item is not null and text is not null").distinct()
    coded = written(given.mapInPandas(code, f"item {kind}, codes array<bigint>"), "leak-coded")
    texts = coded.groupBy("codes").agg(F.min("item").alias("first")).select(F.xxhash64("codes", "first").alias("tid"), "codes")
    texts = written(texts, "leak-texts")
    members = coded.join(texts, "codes").select("item", "tid").distinct()
    grams = texts.select("tid", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("codes") - RUN), lambda i: F.xxhash64(F.slice("codes", i + 1, RUN)))).alias("at", "gram"))
    shared = grams.select("gram", "tid").distinct().groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") >= spec.stock_items).select("gram")
    stock = grams.join(shared, "gram").groupBy("tid").agg(F.sort_array(F.collect_list("at")).alias("stock"))
    texts = texts.join(stock, "tid", "left").withColumn("stock", F.coalesce("stock", F.array().cast("array<int>")))
    return written(texts, "leak-items"), members


def item_keys(texts: DataFrame, spec: LeakSpec) -> DataFrame:
    """``key, tid``: the keys of the windows with a run of own words, as far as they sample an own word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embedding = Embedding(spec)
        for pdf in batches:
            for tid, codes, stock in zip(pdf["tid"], pdf["codes"], pdf["stock"]):
                codes = _unsigned(codes)
                own = own_words(len(codes), np.asarray(stock, np.int64), spec)
                held = np.zeros(len(codes) + 1, np.int64)
                held[own_runs(own) + 1] = 1
                sums = np.cumsum(held)
                starts = np.arange(len(codes) - spec.stretch + 1)
                starts = starts[sums[starts + spec.stretch - RUN + 1] > sums[starts]]
                keys, met = embedding.keys(codes, starts, own)
                keys = np.unique(keys[met])
                yield pd.DataFrame({"key": keys.view(np.int64), "tid": np.full(len(keys), tid, np.int64)})

    return texts.mapInPandas(run, "key bigint, tid bigint")


def bit_filter(values: DataFrame, column: str, n: int, spec: LeakSpec) -> np.ndarray:
    """A bitmap of the low bits of ``column``: about 32 bits for each of ``n`` values, at most ``filter_bits``.

    The bitmaps are built in the executors; what reaches the driver has that size.
    """
    bits = min(max(1 << 20, 1 << (32 * max(n, 1)).bit_length()), spec.filter_bits)
    slot = F.pmod(F.col(column), F.lit(bits)).alias("slot")
    rows = values.select(slot).groupBy(F.expr("slot div 32768").alias("part")).agg(F.expr("bitmap_construct_agg(slot % 32768)").alias("bits"))
    table = np.zeros(bits // 8, np.uint8)
    for r in rows.toLocalIterator():
        table[r.part * 4096 : (r.part + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return table


def _in(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    slot = values & np.uint64(8 * len(table) - 1)
    return (table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def document_keys(codes: np.ndarray, vocabulary: np.ndarray, known: np.ndarray, embedding: Embedding) -> np.ndarray:
    """The distinct keys of the document's windows that may be keys of an item."""
    spec = embedding.spec
    if len(codes) < spec.stretch - 1:
        return np.empty(0, np.uint64)
    # a window within two edits of an item window has all but two of its words in the items; at the end it may be two short
    codes = np.concatenate([codes, np.zeros(2, np.uint64)])
    inside = _in(vocabulary, codes)
    inside[-2:] = False
    sums = np.concatenate([[0], np.cumsum(inside)])
    starts = np.flatnonzero(sums[spec.stretch :] - sums[: -spec.stretch] >= spec.stretch - 2)
    keys = embedding.keys(codes, starts)[0].ravel()
    return np.unique(keys[_in(known, keys)])


def find_leaks(documents: DataFrame, items: DataFrame, spec: LeakSpec = LeakSpec(), *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row (doc_id, item_id) for each document that reproduces a stretch of an item.

    Null and blank texts, and items with fewer words than a stretch, have no
    cases.  Repeated ids count once, whatever their texts.  Only the bitmaps
    reach the driver, and their size is bounded by ``spec``.
    """
    spark = documents.sparkSession
    kind = documents.schema[doc_id].dataType.simpleString()
    texts, members = prepared_items(items, spec, item_id=item_id, text=text)
    keys = written(item_keys(texts, spec), "leak-keys")
    codes = texts.select(F.explode("codes").alias("code")).distinct()
    known = spark.sparkContext.broadcast(bit_filter(keys, "key", keys.count(), spec))
    vocabulary = spark.sparkContext.broadcast(bit_filter(codes, "code", codes.count(), spec))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embedding = Embedding(spec)
        for pdf in batches:
            out = []
            for row, i, t in zip(pdf["row"], pdf["doc"], pdf["text"]):
                own = word_codes(words(t))
                found = document_keys(own, vocabulary.value, known.value, embedding)
                if len(found):
                    out.append((row, i, _signed(own), found.view(np.int64)))
            yield pd.DataFrame(out, columns=["row", "doc", "words", "keys"])

    source = documents.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc"), F.col(text).alias("text")).filter("text is not null and doc is not null")
    hits = written(source.mapInPandas(read, f"row bigint, doc {kind}, words array<bigint>, keys array<bigint>"), "leak-hits")
    met = hits.select("row", F.explode("keys").alias("key")).join(keys, "key").select("row", "tid").distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, tid, doc, item, stock in zip(pdf["doc"], pdf["tid"], pdf["words"], pdf["codes"], pdf["stock"]):
                item = _unsigned(item)
                if verified(item, _unsigned(doc), spec, own_words(len(item), np.asarray(stock, np.int64), spec)):
                    out.append((i, tid))
            yield pd.DataFrame(out, columns=["doc", "tid"])

    pairs = met.join(hits.select("row", "doc", "words"), "row").join(texts, "tid").select("doc", "tid", "words", "codes", "stock").mapInPandas(verify, f"doc {kind}, tid bigint")
    return pairs.join(members, "tid").select(F.col("doc").alias(doc_id), F.col("item").alias(item_id)).distinct()
