import numpy as np
import pytest
from pyspark.sql import functions as F

from arcseq.llm import feast_whitening as fw

SCHEMA = "vec_id long, embedding array<double>"


def spectrum(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    v = (q * np.array(values, float)) @ q.T
    return (v + v.T) / 2


@pytest.mark.parametrize(
    "values",
    [[5] * 20 + [1] * 20, [3] * 40, [9, 8, 7] + [0] * 37, [1e-3] * 10 + [2] * 10 + [1] * 20, list(np.geomspace(1e6, 1e-2, 40)), [4.0], [2.0, 1.0], list(range(1, 80)), [1 + 1e-12 * k for k in range(40)]],
)
def test_feast_finds_every_large_eigenvalue(values):
    v = spectrum(values)
    e, b = fw.feast(v, 32)
    want = np.linalg.eigvalsh(v)[::-1][: min(32, sum(x > 0 for x in values))]
    assert len(e) == len(want) and np.abs(e - want).max() <= 1e-13 * want[0]
    assert np.abs(v @ b - b * e).max() <= 1e-13 * want[0] and np.abs(b.T @ b - np.eye(len(e))).max() <= 1e-13


def test_inertia_counts_and_intervals():
    v = spectrum([1, 2, 2, 3, 5, 8, 13])
    d, o = fw.tridiagonal(v)
    assert [fw.above(d, o, x) for x in (0.5, 1.5, 2.5, 4, 6, 10, 14)] == [7, 6, 4, 3, 2, 1, 0]
    cut = fw.intervals(d, o, 6, 2)
    assert [c for _, _, c in cut] == [2, 2, 2] or sum(c for _, _, c in cut) >= 6
    assert all(a[0] == b[1] for a, b in zip(cut, cut[1:], strict=False))


def test_a_missed_eigenvalue_is_an_error(monkeypatch):
    monkeypatch.setattr(fw, "inside", lambda v, low, high, count, rng, block: (np.zeros(count - 1), np.zeros((len(v), count - 1))))
    with pytest.raises(ArithmeticError):
        fw.feast(spectrum([3, 2, 1]), 3)


def rows_of(spark, vectors):
    return spark.createDataFrame([(i, v) for i, v in vectors], SCHEMA)


def test_equals_numpy(spark):
    rng = np.random.default_rng(3)
    m = rng.standard_normal((400, 6)) @ rng.standard_normal((6, 6)) + 2
    odd = [(900, None), (901, [1.0, None, 1.0]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, [1.0]), (905, [])]
    vectors = [(k, row.tolist()) for k, row in enumerate(m)] + [(7, m[7].tolist()), (None, m[8].tolist())]
    df = rows_of(spark, vectors + odd).withColumn("n", F.lit("clash")).withColumn("v", F.lit(1)).withColumn("whitened", F.lit("x")).repartition(5)
    got = fw.whiten(df, 4).toPandas()
    x = (np.floor(64 * np.array([v for _, v in vectors])) + 1_000_000).astype(np.int64)
    n, s = len(x), x.sum(axis=0)
    z = x - s / n
    e, b = np.linalg.eigh(z.T @ z / n)
    e, b = e[::-1], b[:, ::-1]
    assert len(got) == 4 * n and set(got.component) == {1, 2, 3, 4} and (got.n == n).all()
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    for k in range(1, 5):
        own = got[got.component == k].sort_values("vec_id")
        white = dict(zip(own.vec_id.fillna(-1), own.whitened, strict=True))
        want = z @ b[:, k - 1] / np.sqrt(e[k - 1])
        sign = np.sign(want[0] * white[0])
        assert all(abs(white[-1 if i is None else i] * sign - want[j]) < 1e-9 for j, (i, _) in enumerate(vectors))
        assert np.allclose(own.explained, e[k - 1] / e.sum(), rtol=1e-9)
    dev = dict(zip(got.vec_id.fillna(-1), got.deviation, strict=True))
    assert all(dev[-1 if i is None else i] == int(((n * x[j] - s) ** 2).sum()) for j, (i, _) in enumerate(vectors))


def test_sums_and_deviations_beyond_double_precision():
    c = fw.Centre(3, [3 * 2**54 + 1, 7])
    assert c.deviations(np.array([[2**54, 2]], np.int64)).tolist() == [1 + 1]
    with pytest.raises(OverflowError):
        c.deviations(np.array([[-(2**62), 2]], np.int64))


def test_no_components(spark):
    want = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for vectors in ([], [(1, [1.0, 2.0])], [(k, [0.5, 0.5]) for k in range(5)], [(1, None)], [(1, []), (2, [])]):
        got = fw.whiten(rows_of(spark, vectors))
        assert got.columns == want and got.collect() == []
    same = fw.whiten(rows_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 3.0]), (3, [1.0, 4.0])]))
    assert {r["component"] for r in same.collect()} == {1} and dict(same.dtypes) == dict(fw.whiten(rows_of(spark, [])).dtypes)
