import numpy as np
import pytest
from pyspark.sql import functions as F

from arcseq.functions import bessel
from arcseq.functions import circular as C


@pytest.fixture(scope="module")
def angles(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b)) for a, b in rng.uniform(-20, 20, (300, 2))]
    return spark.createDataFrame(rows, "a double, b double"), np.array(rows)


def column(df, expr):
    return np.array([r[0] for r in df.select(expr).collect()], dtype=float)


def test_circular_difference(angles):
    df, x = angles
    want = np.angle(np.exp(1j * (x[:, 0] - x[:, 1])))
    np.testing.assert_allclose(column(df, C.circ_diff(F.col("a"), F.col("b"))), want, atol=1e-12)
    np.testing.assert_allclose(column(df, C.wrap_pi(F.col("a"))), (x[:, 0] + np.pi) % (2 * np.pi) - np.pi, atol=1e-12)
    np.testing.assert_allclose(column(df, C.deg2rad(F.col("a"))), np.deg2rad(x[:, 0] % 360), atol=1e-12)


def test_five_and_355_degrees_are_ten_apart(spark):
    d = C.circ_diff(C.deg2rad(F.lit(5.0)), C.deg2rad(F.lit(355.0)))
    assert spark.range(1).select(F.degrees(d)).first()[0] == pytest.approx(10.0)


def test_softmax_and_logsumexp(angles):
    df, x = angles
    cols = [F.col("a") * 40, F.col("b") * 40, F.lit(3.0)]
    z = np.column_stack([x * 40, np.full(len(x), 3.0)])
    top = z.max(axis=1, keepdims=True)
    want = np.exp(z - top) / np.exp(z - top).sum(axis=1, keepdims=True)
    got = np.column_stack([column(df, p) for p in C.softmax(cols)])
    np.testing.assert_allclose(got, want, atol=1e-12)
    np.testing.assert_allclose(column(df, C.logsumexp(cols)), top[:, 0] + np.log(np.exp(z - top).sum(axis=1)), rtol=1e-12)


def test_bessel_against_quadrature():
    t = np.linspace(0, np.pi, 200_001)
    for k in (1e-3, 0.7, 5.0, 19.9, 20.1, 80.0, 400.0):
        w = np.exp(k * (np.cos(t) - 1))
        i0 = np.trapezoid(w, t) / np.pi
        i1 = np.trapezoid(w * np.cos(t), t) / np.pi
        assert bessel.log_i0(k) == pytest.approx(np.log(i0) + k, rel=1e-9)
        assert bessel.i1_over_i0(k) == pytest.approx(i1 / i0, rel=1e-8)


def test_native_bessel_equals_numpy(spark):
    ks = [1e-6, 0.3, 4.0, 19.999, 20.0, 55.0, 500.0]
    df = spark.createDataFrame([(k,) for k in ks], "k double")
    np.testing.assert_allclose(column(df, C.log_i0(F.col("k"))), bessel.log_i0(np.array(ks)), rtol=1e-12, atol=1e-15)
    np.testing.assert_allclose(column(df, C.i1_over_i0(F.col("k"))), bessel.i1_over_i0(np.array(ks)), rtol=1e-12)


def test_exact_kappa_inverts_and_is_bounded():
    k = np.array([1e-5, 0.01, 1.0, 12.0, 333.0])
    np.testing.assert_allclose(bessel.kappa_exact(bessel.i1_over_i0(k)), k, rtol=1e-8)
    np.testing.assert_allclose(bessel.kappa_exact(np.array([-0.5, 0.0, 0.99999, 1.0])), [1e-6, 1e-6, 500, 500])


def test_approximate_kappa_is_monotone_and_native_equal(spark):
    r = np.linspace(0, 1, 101)
    k = bessel.kappa_approx(r)
    assert (np.diff(k) > -0.02).all() and k[0] == 1e-8 and k[-1] == 5000
    df = spark.createDataFrame([(float(x),) for x in r], "r double")
    np.testing.assert_allclose(column(df, C.kappa_from_r(F.col("r"))), k, rtol=1e-9)


def test_bins_labels_and_guards(spark):
    df = spark.createDataFrame([(-180.0,), (-165.0,), (179.99,), (180.0,)], "x double")
    assert column(df, C.hist_bin(F.col("x"))).tolist() == [0, 1, 23, 23]
    got = spark.range(1).select(
        *[C.conflict_bin(F.lit(v)) for v in (29.9, 30.0, 60.0)],
        C.block_id(F.lit(3), F.lit(12), F.lit(1234)),
        C.condition_label(F.lit(0.06), F.lit(10.0)),
        C.geometric_run(F.lit(1.0)),
        C.geometric_run(F.lit(0.75)),
        C.argmax_state([F.lit(0.4), F.lit(0.4), F.lit(0.2)]),
    ).first()
    assert got[0].startswith("near") and got[1].startswith("medium") and got[2].startswith("far")
    assert got[3] == "s03_session012_run1234" and got[4] == "0.06/10" and got[5] == float("inf") and got[6] == 4.0
    assert got[7] == "sensory"


def test_directions_on_an_edge_fall_in_one_bin_whatever_their_last_bits(spark):
    near = [-60.00000000000001, -60.0, -59.99999999999999, -180.0, 180.0, -179.99999999999997, 179.99999999999997, -179.99]
    df = spark.createDataFrame([(float(np.radians(x)),) for x in near], "x double")
    assert column(df, C.hist_bin(C.relative_deg(F.col("x")))).tolist() == [8, 8, 8, 23, 23, 23, 23, 0]
