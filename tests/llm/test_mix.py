"""Mixing: quotas, caps, exactness of the splitting tree, edge cases."""

import numpy as np

from artefold.llm import mix


def _plan(spark, docs, targets):
    counts = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    wanted = mix.quotas(spark.createDataFrame(targets, "mix_id string, source string, weight double, max_repeats int, total_ratio double"), counts)
    placed = mix.offsets(counts)
    return placed, wanted, mix.chosen(mix.sharded(placed, wanted, block_tokens=40))


def test_shares_caps_and_missing_sources(spark):
    docs = [(i, "a", 10) for i in range(100)] + [(1000 + i, "b", 5) for i in range(20)] + [(5000, None, 7), (5001, "a", 0)]
    placed, wanted, drawn = _plan(spark, docs, [("m", "A ", 1.0, None, 2.0), ("m", "b", 1.0, 3, 2.0), ("m", "none", 2.0, None, 2.0), ("m", "z", None, 1, 2.0)])
    total = round(2.0 * (1000 + 100 + 7))
    got = {r.source: r for r in mix.shares(drawn, wanted).collect()}
    assert got["a"].target_tokens == round(total / 4) and abs(got["a"].actual_tokens - total / 4) <= 5
    assert got["b"].capped and got["b"].actual_tokens == 300 and got["b"].most_copies == 3
    assert got["none"].actual_tokens == 0 and got["z"].target_share == 0
    assert all(r.copies <= 3 for r in drawn.filter("source = 'b'").collect())


def test_offsets_are_prefix_sums_of_one_order(spark):
    docs = [(i, "s", 1 + i % 7) for i in range(500)] + [(3, "s", 4)]
    rows = sorted((r.start, r.n_tokens) for r in mix.offsets(spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")).collect())
    at = 0
    for start, n in rows:
        assert start == at
        at += n


def test_split_tree_keeps_source_and_shard_sums():
    blocks = np.array([1000, 3, 0, 77])
    tree = mix.split_tree(blocks, 7, np.random.default_rng(1))
    assert (tree.sum(axis=0) == blocks).all() and tree.min() >= 0 and np.ptp(tree.sum(axis=1)) <= 1


def test_a_mix_is_the_union_of_its_shards(spark):
    placed, wanted, _ = _plan(spark, [(i, "ab"[i % 2], 50) for i in range(200)], [("m", "a", 3.0, None, 1.5), ("m", "b", 1.0, None, 1.5)])
    for size in (50, 200, 100_000):
        rows = mix.sharded(placed, wanted, shards=4, block_tokens=size).collect()
        assert len(rows) == len({(r.doc_id, r["pass"]) for r in rows})
        per = {s: sum(r.source == s for r in rows) for s in "ab"}
        assert per == {"a": 225, "b": 75}  # of 15,000 tokens
        if size < 100_000:
            assert {r.shard for r in rows} == {0, 1, 2, 3}


def test_blocks_of_a_shard_are_spread_over_the_source(spark):
    """The permutation leaves no neighbourhood: of two neighbouring blocks about a quarter share a shard of four."""
    placed, wanted, _ = _plan(spark, [(i, "a", 10) for i in range(4000)], [("m", "a", 1.0, None, 1.0)])
    draws = mix.sharded(placed, wanted, shards=4, block_tokens=10).join(placed.select("doc_id", "start"), "doc_id").orderBy("start").collect()
    same = sum(a.shard == b.shard for a, b in zip(draws, draws[1:])) / (len(draws) - 1)
    assert len(draws) == 4000 and 0.2 < same < 0.3


def test_tokens_of_whole_texts_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, ""), (4, "word " * 40_000)], "doc_id long, text string")
    n = {r.doc_id: r.n_tokens for r in mix.token_counts(docs).collect()}
    assert n[1] == 2 and n[2] == n[3] == 0 and n[4] >= 40_000
    _, wanted, drawn = _plan(spark, [], [("m", "a", 1.0, None, 1.0)])
    assert drawn.collect() == [] and mix.shares(drawn, wanted).collect()[0].actual_tokens == 0
