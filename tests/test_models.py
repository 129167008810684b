import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcseq.columns import SEQ
from arcseq.operators import checks as ck
from arcseq.operators import comparison as cmp
from arcseq.operators import conditions as cond
from arcseq.operators import em
from arcseq.operators import recursions as rec
from arcseq.operators import resampling as rs
from arcseq.operators import scoring as sc
from arcseq.operators import trial_table as tt
from arcseq.operators.kernels import Chain, Ragged
from arcseq.operators.params import values_table
from arcseq.plans.fixed import COH, MAIN, PRIOR, START
from arcseq.session import release, stage

X = tuple(tt.X_COLS)
A3 = np.array([[0.8, 0.1, 0.1], [0.2, 0.7, 0.1], [0.3, 0.2, 0.5]])


def brute(b, pi, a):
    """Posteriors, LL and best path by enumeration of all state paths."""
    n = len(b)
    gamma, xi, total, best = np.zeros((n, 3)), np.zeros((n - 1, 3, 3)), 0.0, (-1, None)
    for path in itertools.product(range(3), repeat=n):
        p = pi[path[0]] * b[0, path[0]]
        for t in range(1, n):
            p *= a[path[t - 1], path[t]] * b[t, path[t]]
        total += p
        best = max(best, (p, path))
        for t in range(n):
            gamma[t, path[t]] += p
        for t in range(n - 1):
            xi[t, path[t], path[t + 1]] += p
    return gamma / total, xi / total, np.log(total), best[1]


def test_chain_kernel_against_enumeration():
    rng = np.random.default_rng(1)
    lens = [3, 1, 5, 4]
    rg = Ragged(lens)
    b = rng.uniform(0.05, 1, (rg.n, 3))
    b[:3] = [[0.6, 0.3, 0.1], [0.2, 0.7, 0.1], [0.2, 0.2, 0.6]]
    pi = np.array([0.5, 0.4, 0.1])
    chain = Chain(rg, np.log(b), np.repeat(A3[None], len(lens), axis=0))
    _, filt, scale, ll = chain.forward(np.repeat(pi[None], len(lens), axis=0))
    beta = chain.backward(scale, np.ones((len(lens), 3)))
    gamma = chain.gamma(filt, beta)
    xi = chain.xi(filt, beta, np.zeros((len(lens), 3)), rg.starts)
    path = chain.viterbi(np.log(np.repeat(pi[None], len(lens), axis=0)), np.full(len(lens), -1))
    np.testing.assert_allclose(gamma.sum(axis=1), 1)
    for s, n in zip(rg.starts, lens):
        g, x, total, best = brute(b[s : s + n], pi, A3)
        np.testing.assert_allclose(gamma[s : s + n], g, atol=1e-12)
        np.testing.assert_allclose(xi[s + 1 : s + n], x, atol=1e-12)
        assert ll[s : s + n].sum() == pytest.approx(total)
        assert tuple(path[s : s + n]) == best
        assert np.isnan(xi[s]).all()


@pytest.fixture(scope="module")
def feat(trials):
    return stage(tt.features(trials), "feat")


def history(fits):
    return [np.diff(f.history) for f in fits]


def test_em_likelihoods_do_not_fall(feat):
    packed = rec.pack(feat, COH, PRIOR)
    rows = em.level_rows(feat, COH, PRIOR)
    keys = [{"subject_id": None}]
    stop = em.Stop(6, None)
    runs = {
        "mixture": em.fit_mixture(rows, em.model_from([START], keys, COH, PRIOR, ["weights"]), stop, exact=True, smoothing=1e-6),
        "conditioned": em.fit_mixture(rows, em.model_from([START], keys, COH, PRIOR, ["condition_weights"]), stop, exact=True),
        "block": em.fit_block(rows, em.model_from([START], keys, COH, PRIOR, ["rho", "class_weights"]), stop),
        "chain": em.fit_hmm(packed, em.model_from([START], keys, COH, PRIOR, ["pi", "A"]), stop, exact=True, smoothing=1e-6),
        "hybrid": em.fit_hybrid(packed, em.model_from([START], keys, COH, PRIOR, ["rho", "class_pi", "class_A"]), stop),
    }
    for name, fits in runs.items():
        for d in history(fits):
            assert np.isfinite(d).all() and (d >= -1e-3).all(), name
    release()


def test_covariate_chain_fit_improves_and_centres(feat):
    df = tt.transition_covariates(feat)
    row = sc.fit_scaler(df).first()
    packed = rec.pack(df, COH, PRIOR, arrays=X)
    m = em.model_from([MAIN], [{"subject_id": None}], COH, PRIOR, ["pi", "B"])
    m.extra["mean"] = np.array([[row[f"mean_{c}"] for c in X]])
    m.extra["sd"] = np.array([[row[f"sd_{c}"] for c in X]])
    fit = em.fit_covariate_hmm(packed, m, em.Stop(2, None), X)[0]
    assert fit.history[1] > fit.history[0]
    np.testing.assert_allclose(np.array(fit.params.B).sum(axis=1), 0, atol=1e-9)
    release()


def test_row_gradient_matches_differences():
    rng = np.random.default_rng(0)
    x, xi, v = rng.normal(size=(97, 5)), rng.gamma(1, 1, (97, 3, 3)), rng.normal(0, 0.3, (3, 10))
    q, g, h = em.logit_sums(x, xi, v)
    for i in range(3):
        for c in (0, 4, 9):
            hi, lo = v.copy(), v.copy()
            hi[i, c] += 1e-5
            lo[i, c] -= 1e-5
            qh, gh, _ = em.logit_sums(x, xi, hi)
            ql, gl, _ = em.logit_sums(x, xi, lo)
            assert (qh[i] - ql[i]) / 2e-5 == pytest.approx(g[i, c], rel=1e-5, abs=1e-5)
            np.testing.assert_allclose((gh[i] - gl[i]) / 2e-5, h[i, :, c], rtol=1e-4, atol=1e-4)


def test_relative_stop_updates_and_absolute_stop_keeps(feat):
    rows = em.level_rows(feat, COH, PRIOR)
    m = em.model_from([START], [{"subject_id": None}], COH, PRIOR, ["weights"])
    a = em.fit_mixture(rows, m, em.Stop(200, 1e-4, rule="absolute"), exact=True, smoothing=1e-6)[0]
    assert a.converged and abs(a.history[-1] - a.history[-2]) < 1e-4
    again = em.model_from([a.params], [{"subject_id": None}], COH, PRIOR, ["weights"])
    assert em.mixture_step(rows, again, None)["ll"][0] == pytest.approx(a.history[-1], abs=1e-9)
    release()


def test_trial_scores_add_up(feat):
    packed = rec.pack(feat, COH, PRIOR)
    scored = rec.chain_scores(packed, rec.one_key(MAIN, COH, PRIOR), smooth=True)
    out = cmp.reconcile_summary(
        cmp.reconcile(
            scored.groupBy(*SEQ).agg(F.sum("trial_ll").alias("v")),
            rec.sequence_ll(packed, rec.one_key(MAIN, COH, PRIOR)).select(*SEQ, F.col("ll").alias("v")),
            SEQ,
            "v",
        )
    ).first()
    assert out["n_keys"] == out["n_both"] and out["n_duplicated"] == 0 and out["max_abs_difference"] < 1e-9
    qc = cmp.score_checks(scored, {"filtered": rec.FILT, "smoothed": rec.SMOOTH}).first()
    assert qc["rows"] == qc["unique_trials"] and qc["not_finite"] == 0 and qc["max_smoothed_error"] < 1e-10
    release()


def test_stationary_distribution(spark):
    names = [f"{a}_to_{b}" for a in ("sensory", "prior", "lapse") for b in ("sensory", "prior", "lapse")]
    r = sc.stationary(values_table(spark, names, [tuple(A3.ravel())])).first()
    p = np.array([r["stationary_sensory"], r["stationary_prior"], r["stationary_lapse"]])
    assert (p >= 0).all() and p.sum() == pytest.approx(1)
    np.testing.assert_allclose(p @ A3, p, atol=1e-12)


def scores(spark):
    rows = [(s % 2, 1, s, 1, m, -(base + s), 10) for s in range(4) for m, base in (("base", 10.0), ("better", 9.0))]
    return values_table(spark, ["fold", "subject_id", "session_id", "run_id", "model", "test_ll", "n_test"], rows)


def test_bootstrap_of_a_constant_difference(spark):
    r = rs.bootstrap_diff(scores(spark), "base", ["better"], 50).first()
    assert r["n_sequences"] == 4
    for c in ("observed_delta_ll_per_trial", "ci_low", "ci_high", "bootstrap_mean"):
        assert r[c] == pytest.approx(0.1)


def test_resample_draws_with_replacement_whatever_the_partitioning(spark):
    units = spark.range(400).select("id", (F.col("id") % 17).cast("double").alias("x"), F.lit(1.0).alias("one"))
    a = rs.resample(units, ["id"], ["x", "one"], 300, 1).toPandas().sort_values("draw")
    again = rs.resample(units.repartition(3), ["id"], ["x", "one"], 300, 1).toPandas().sort_values("draw")
    assert (a["one"] == 400).all() and a["x"].tolist() == again["x"].tolist()
    values = np.arange(400) % 17
    assert abs(a["x"].mean() - values.sum()) < 4 * values.std() * 20 / 17 and 0.8 < a["x"].std() / (values.std() * 20) < 1.25


def test_effect_intervals_bracket_the_point(feat):
    df = tt.transition_covariates(feat)
    row = sc.fit_scaler(df).first()
    packed = rec.pack(df, COH, PRIOR, arrays=X)
    keyset = rec.one_key(MAIN, COH, PRIOR, [(row[f"mean_{c}"], row[f"sd_{c}"]) for c in X])
    a = rs.effect_intervals(packed, keyset, X, 100).toPandas()
    b = rs.effect_intervals(packed, keyset, X, 100).toPandas()
    assert len(a) == 54 and (a["ci_low"] <= a["ci_high"]).all()
    np.testing.assert_allclose(a["bootstrap_mean"], b["bootstrap_mean"], rtol=1e-9, atol=1e-12)
    assert (abs(a["bootstrap_mean"] - a["delta_plus_minus"]) < 4 * a["bootstrap_sd"] + 1e-3).mean() > 0.9
    release()


def test_effect_intervals_of_several_fits(feat):
    """A fit that uses all folds equals the only fit of all data; a fit of one fold equals the fit of that fold's rows alone."""
    df = stage(tt.transition_covariates(feat).withColumn("fold", F.col("session_id") % 2), "effects-test")
    row = sc.fit_scaler(df).first()
    one = rec.one_key(MAIN, COH, PRIOR, [(row[f"mean_{c}"], row[f"sd_{c}"]) for c in X])
    two = {f: np.repeat(getattr(one, f), 2, axis=0) for f in ("pi", "A", "kappa_s", "kappa_p", "B", "mean", "sd")}
    keyset = rec.KeySet(names=[0, 1], subject=[None] * 2, folds=[{0, 1}, {1}], **two).prepare()
    got = rs.effect_intervals(rec.pack(df, COH, PRIOR, carry=("fold",), arrays=X), keyset, X, 50, fold="fold").toPandas()
    assert len(got) == 108
    for key, rows in ((0, df), (1, df.filter("fold = 1"))):
        alone = rs.effect_intervals(rec.pack(rows, COH, PRIOR, arrays=X), one, X, 50).toPandas()
        mine = got[got.fit_key == key]
        assert mine["n_sequences"].tolist() == alone["n_sequences"].tolist()
        np.testing.assert_allclose(mine[["ci_low", "ci_high", "bootstrap_sd"]].to_numpy(), alone[["ci_low", "ci_high", "bootstrap_sd"]].to_numpy(), rtol=1e-7, atol=1e-10)


def test_multiplied_scores_against_plain_numbers(spark):
    """Units in any partitioning give the sums of a plain loop over whole-number arithmetic."""
    mask = (1 << 64) - 1

    def number(unit, j):
        z = ((unit & mask) + j * 0x9E3779B97F4A7C15) & mask
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = ((z ^ (z >> shift)) * factor) & mask
        return (((z ^ (z >> 31)) >> 11) + 0.5) / 2**53

    rows = [(u * 7919 - 40000, u % 2, [float(u), -0.5 * u * u]) for u in range(60)]
    means, draws = np.array([[1.0, 2.0], [3.0, -4.0]]), 5
    df = spark.createDataFrame(rows, "unit bigint, fit_key bigint, score array<double>")
    got = {(r.fit_key, r.draw): r.score for r in rs.multiplied_scores(df.repartition(4), means, draws).collect()}
    for key in (0, 1):
        for d in range(draws):
            plain = np.zeros(2)
            for unit, k, score in rows:
                if k == key:
                    g = np.sqrt(-2 * np.log(number(unit, d + 1))) * np.cos(2 * np.pi * number(unit, draws + d + 1))
                    plain += g * (np.array(score) - means[key])
            np.testing.assert_allclose(got[key, d], plain, rtol=1e-9)
    many = rs.normals(np.arange(20000), 3)
    assert abs(many.mean()) < 0.02 and abs(many.std() - 1) < 0.02


def test_occupancy_bins(spark):
    cols = ["row_index", "motion_direction", "prior_mean", "motion_coherence", "prior_std", "p_sensory", "p_prior", "p_lapse"]
    df = values_table(spark, cols, [(i, d, 225.0, 0.06, 10.0, 0.5, 0.3, 0.2) for i, d in enumerate((225.0, 260.0, 330.0))])
    got = {r["conflict_bin"][:3]: r["mean_conflict_deg"] for r in cond.occupancy(df).collect()}
    assert got == {"nea": 0.0, "med": 35.0, "far": 105.0}


def test_float_keys_meet(spark):
    rows = [("observed", -1, 0.06, 10.0)] + [("simulated", i, c, 10.0) for i, c in enumerate((0.0599999999999999, 0.0600000000000001))]
    df = values_table(spark, ["source", "simulation", "motion_coherence", "prior_std"], rows)
    df = df.withColumns({m: F.lit(1.0) + F.col("simulation") for m in cond.METRICS})
    out = ck.metric_intervals(df)
    assert out.count() == 5 and out.select("motion_coherence").distinct().count() == 1


def test_retention_rates(spark):
    rows = [(s, i, 0.06, 10.0, st) for s, i in (("observed", -1), ("simulated", 0)) for st in ["sensory"] * 80 + ["lapse"] * 20]
    df = values_table(spark, ["source", "simulation", "motion_coherence", "prior_std", "decoded_state"], rows)
    r = ck.retention_summary(ck.retention(df)).first()
    assert r["observed_retained_n"] == 80 and r["simulated_retained_rate_mean"] == pytest.approx(0.8)


def test_serial_coefficients_against_a_fine_grid(feat):
    """Refined coefficients of each fold lie within the last step of the best point of a fine grid around them."""
    from arcseq.operators import cv
    from arcseq.plans.fixed import GRID

    df = stage(tt.serial_previous(feat).withColumn("fold", F.col("session_id") % 3), "serial-test")
    got = {(r.model, r.fold): (r.alpha_stim, r.alpha_resp) for r in cv.serial_cv(df, MAIN, GRID).select("model", "fold", "alpha_stim", "alpha_resp").distinct().collect()}
    assert len(got) == 12 and all(got["independent_switching", f] == (0.0, 0.0) for f in range(3))
    rows = sc.serial_terms(df, MAIN, ("fold",)).toPandas()
    w = MAIN.weights

    def ll(t, a, b):
        s = np.exp(t.kappa_s * np.cos(t.y - (t.theta + a * t.ds + b * t.dr)) - t.norm_s)
        return np.log(w[0] * s + w[1] * np.exp(t.kappa_p * t.cos_p - t.norm_p) + w[2] / (2 * np.pi)).sum()

    fine = np.arange(-384, 385) / 512
    for f in range(3):
        t = rows[rows.fold != f]
        stim, resp = got["serial_stimulus", f][0], got["serial_response", f][1]
        assert abs(fine[np.argmax([ll(t, a, 0.0) for a in fine])] - stim) <= 0.005
        assert abs(fine[np.argmax([ll(t, 0.0, b) for b in fine])] - resp) <= 0.005
        a, b = got["serial_both", f]
        coarse = np.arange(-12, 13) / 16
        assert ll(t, a, b) >= max(ll(t, x, z) for x in coarse for z in coarse) - 1e-6


def test_coverage_takes_a_hundred_replicates(spark):
    """As many as the reference draws, with the metrics of `condition_metrics`; the SQL draws as many."""
    from arcseq.plans import checks as plan
    from oracles.checks import ORACLES

    sf = "/root/testdata/sf0.001"
    got = plan.covered_metrics(spark, sf).toPandas().sort_values(plan.SUMMARY, ignore_index=True)
    assert set(got["simulation"]) == {-1, *range(100)} and "range(100)" in ORACLES["p8_covered"] and "range(4)" not in ORACLES["p8_covered"]
    f = plan.features(spark, sf)
    rows = ck.union_sources(ck.responded(f.select(*plan.COLUMNS)), ck.permuted_replicates(f.select(*plan.COLUMNS), 100))
    want = cond.condition_metrics(stage(rows, "coverage-test"), plan.SUMMARY).toPandas().sort_values(plan.SUMMARY, ignore_index=True)
    assert (got["n"] == want["n"]).all()
    np.testing.assert_allclose(got[cond.METRICS], want[cond.METRICS], rtol=1e-9, atol=1e-12)
