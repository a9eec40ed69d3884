"""Every query of this subpackage runs over the whole small tables."""

import pytest

from artefold.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert len(df.collect()) > 0 and len(set(df.columns)) == len(df.columns)


def test_a_mix_is_its_shards(spark, small):
    shards = QUERIES["p7_shards"](spark, small).groupBy("mix_id", "doc_id").count().collect()
    mix = QUERIES["p7_mix"](spark, small).select("mix_id", "doc_id", "copies").collect()
    assert sorted(map(tuple, shards)) == sorted(map(tuple, mix))
