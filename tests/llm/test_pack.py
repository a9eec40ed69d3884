"""Packing: nothing lost, nothing over budget or divided without need, both paths, quality."""

from collections import defaultdict

import pytest

from artefold.llm import pack

SCHEMA = "grp long, item string, tokens long, bytes long, budget_tokens long, budget_bytes long"


def check(spark, rows, **how):
    out = pack.pack(spark.createDataFrame(rows, SCHEMA), **how).collect()
    want = {(r[0], r[1]): (r[2] or 0, r[3] or 0, r[4], r[5]) for r in rows}
    sums, bins, n = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), defaultdict(int)
    for r in out:
        for box, key in ((sums, (r.grp, r.item)), (bins, (r.grp, r.bin))):
            box[key][0] += r.tokens
            box[key][1] += r.bytes
        n[r.grp, r.item] += 1
    assert {k: tuple(v) for k, v in sums.items()} == {k: v[:2] for k, v in want.items()}
    budget = {r[0]: r[4:] for r in rows}
    for (g, _), (t, b) in bins.items():
        bt, bb = budget[g]
        assert (not bt or t <= bt) and (not bb or b <= bb)
    for k, (t, b, bt, bb) in want.items():
        assert n[k] == 1 or (bt and t > bt) or (bb and b > bb), k
    for r in out:
        bt, bb = budget[r.grp]
        assert r.left_tokens == (bt - bins[r.grp, r.bin][0] if bt else None) and r.left_bytes == (bb - bins[r.grp, r.bin][1] if bb else None)
    return {g: len({b for h, b in bins if h == g}) for g in budget}


def _items(g, n, bt, bb):
    return [(g, f"i{k}", (k * 7919) % 3001, ((k * 7919) % 3001) * 4 + k % 5, bt, bb) for k in range(n)]


def test_both_budgets_one_budget_and_none(spark):
    rows = _items(1, 300, 4000, 16000) + _items(2, 40, None, 9000) + _items(3, 9, None, None) + [(4, "big", 9001, 36004, 2000, 8000), (4, "zero", 0, 0, 2000, 8000), (5, "null", None, None, 100, None)]
    used = check(spark, rows)
    assert used[3] == 1 and used[5] == 1 and used[4] == 5
    volume = sum(max(r[2] / 4000, r[3] / 16000) for r in rows if r[0] == 1)
    assert used[1] <= volume * 1.1 + 1


def test_distributed_sweeps_pack_as_well(spark):
    rows = _items(1, 400, 4000, 16000) + _items(2, 3, 4000, 16000)
    near = check(spark, rows)
    far = check(spark, rows, local_items=50)
    assert far[1] <= near[1] * 1.12 + 1


@pytest.mark.parametrize("local", [0, 5000])
def test_ties_and_equal_sizes(spark, local):
    assert check(spark, [(1, f"i{k}", 50, 0, 100, None) for k in range(40)], local_items=local)[1] == 20


def test_empty(spark):
    assert pack.pack(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sweep_takes_the_largest_item_below_each_gap():
    assert pack.sweep([3, 5, 8], [4, 6, 6]) == [(0, 0), (1, 1)]
