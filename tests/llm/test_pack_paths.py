"""Packing: the containers are the same wherever the sweeps run."""

import pytest

from artefold.llm import pack

SCHEMA = "grp long, item string, tokens long, bytes long, budget_tokens long, budget_bytes long"


@pytest.mark.parametrize("local", [0, 40])
def test_small_items_fill_gaps_one_by_one_on_both_paths(spark, local):
    rows = [(1, f"i{k}", (k * k * 37) % 199 if k % 3 else (k * 7919) % 3001, 5, 4000, 16000) for k in range(60)] + [(2, f"n{k}", 3, 3, None, None) for k in range(90)] + [(3, "big", 9001, 0, 2000, None), (3, "a", 10, 0, 2000, None)]
    items = spark.createDataFrame(rows, SCHEMA)
    key = lambda df: sorted(tuple(r) for r in df.select("grp", "item", "piece", "tokens", "bin").collect())
    assert key(pack.pack(items, local_items=local)) == key(pack.pack(items))
