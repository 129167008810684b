import pytest
from pyspark.sql import functions as F

from arcseq.llm import vector_search
from arcseq.llm.common import sampled, share_of


@pytest.mark.parametrize("n", [10, 10**6, 10**9, 10**12, 10**15])
def test_the_share_of_a_sample_does_not_vanish(n):
    most = 2000
    steps = int(share_of(n, most) * 2.0**63)
    assert steps / 2.0**63 * n == pytest.approx(min(n, most), rel=1e-6)


def test_samples_are_as_large_as_told(spark):
    rows = spark.range(200_000)
    assert rows.where(sampled(F.xxhash64("id"), 1.0)).count() == 200_000
    assert 800 < rows.where(sampled(F.xxhash64("id"), share_of(200_000, 1000))).count() < 1200


def test_only_crowded_shards_are_copied(spark, monkeypatch):
    """Many queries: the result is that of one block, and a vector is copied only for the blocks of its own shard."""
    import numpy as np

    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((3000, 8)))], "vec_id long, embedding array<double>")
    plain = sorted(map(tuple, vector_search.search(df, 5, 2).collect()))
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 400)
    assert sorted(map(tuple, vector_search.search(df, 5, 2).collect())) == plain and len(plain) == 7500
