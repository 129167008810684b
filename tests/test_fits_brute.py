"""Fits that SQL does not check, against plain loops on a small table."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcseq.columns import SEQ
from arcseq.functions.bessel import kappa_approx, kappa_exact, log_norm
from arcseq.operators import cv, em
from arcseq.operators import recursions as rec
from arcseq.operators import scoring as sc
from arcseq.operators import trial_table as tt
from arcseq.plans.fixed import COH, MAIN, PRIOR, START
from arcseq.session import release, stage


@pytest.fixture(scope="module")
def folded(trials):
    return stage(tt.features(trials).withColumn("fold", (F.col("run_id") % 2).cast("int")), "folded")


@pytest.fixture(scope="module")
def sequences(folded):
    pdf = folded.orderBy(*SEQ, "pos").toPandas()
    return [(k[0], int(g["fold"].iloc[0]), g) for k, g in pdf.groupby(SEQ)]


def densities(g, ks, kp):
    a = np.array([ks[c] for c in g["motion_coherence"]])
    b = np.array([kp[w] for w in g["prior_std"]])
    return np.exp(
        np.column_stack([a * g["cos_s"] - log_norm(a), b * g["cos_p"] - log_norm(b), np.full(len(g), -np.log(2 * np.pi))])
    )


def passes(b, pi, a):
    n = len(b)
    f, c = np.empty((n, 3)), np.empty(n)
    for t in range(n):
        u = (pi if t == 0 else f[t - 1] @ a) * b[t]
        c[t] = u.sum()
        f[t] = u / c[t]
    beta = np.ones((n, 3))
    for t in range(n - 2, -1, -1):
        beta[t] = a @ (b[t + 1] * beta[t + 1]) / c[t + 1]
    xi = [np.outer(f[t], b[t + 1] * beta[t + 1]) * a / c[t + 1] for t in range(n - 1)]
    return np.log(c).sum(), f * beta, np.sum(xi, axis=0) if xi else np.zeros((3, 3))


def one_update(train, pi, a, ks, kp):
    ll, p, t = 0.0, np.zeros(3), np.zeros((3, 3))
    gam, frames = [], []
    for _, _, g in train:
        l, gamma, xi = passes(densities(g, ks, kp), pi, a)
        ll, p, t = ll + l, p + gamma[0], t + xi
        gam.append(gamma)
        frames.append(g[["motion_coherence", "prior_std", "cos_s", "cos_p"]].to_numpy())
    gam, x = np.concatenate(gam), np.concatenate(frames)
    r_s = {c: (gam[x[:, 0] == c, 0] @ x[x[:, 0] == c, 2]) / gam[x[:, 0] == c, 0].sum() for c in ks}
    r_p = {w: (gam[x[:, 1] == w, 1] @ x[x[:, 1] == w, 3]) / gam[x[:, 1] == w, 1].sum() if (x[:, 1] == w).any() else 0.0 for w in kp}
    new = (p + 1e-6) / (p + 1e-6).sum(), (t + 1e-6) / (t + 1e-6).sum(axis=1, keepdims=True)
    fit = lambda r: {k: float(kappa_exact(np.array(v))) for k, v in r.items()}
    return ll, (*new, fit(r_s), fit(r_p))


def test_cross_validated_chain(folded, sequences):
    subject = 2
    keys = [{"subject_id": subject, "folds": [0], "fold": 1}]
    row = cv.run_cv(folded, ["hmm"], START, keys, COH, PRIOR, em.Stop(3, 1e-9, rule="absolute")).first()
    release()
    train = [s for s in sequences if s[0] == subject and s[1] == 0]
    test = [s for s in sequences if s[0] == subject and s[1] == 1]
    p = (np.array(START.pi), np.array(START.A), START.kappa_s, START.kappa_p)
    for _ in range(2):
        _, p = one_update(train, *p)
    ll, _ = one_update(train, *p)
    held = sum(passes(densities(g, p[2], p[3]), p[0], p[1])[0] for _, _, g in test)
    assert row["train_ll"] == pytest.approx(ll, rel=1e-9) and row["n_iter"] == 3
    assert row["test_ll"] == pytest.approx(held, rel=1e-9)
    assert row["n_test"] == sum(len(g) for _, _, g in test)


def plain_covariate_update(train, cols, mean, sd, pi, big, ks, kp):
    """LL and the parameters after one update of the covariate chain, by loops and many Newton steps on the summed objective."""
    ll, first, levels, xs, xis = 0.0, np.zeros(3), [], [], []
    for _, _, g in train:
        dens = densities(g, ks, kp)
        x = np.column_stack([np.ones(len(g)), (g[cols].to_numpy(dtype=float) - mean) / sd])
        logits = np.einsum("ijp,np->nij", big, x)
        a = np.exp(logits - logits.max(axis=2, keepdims=True))
        a /= a.sum(axis=2, keepdims=True)
        n = len(g)
        f, c, beta = np.empty((n, 3)), np.empty(n), np.ones((n, 3))
        for t in range(n):
            u = (pi if t == 0 else f[t - 1] @ a[t]) * dens[t]
            c[t] = u.sum()
            f[t] = u / c[t]
        for t in range(n - 2, -1, -1):
            beta[t] = a[t + 1] @ (dens[t + 1] * beta[t + 1]) / c[t + 1]
        ll, first = ll + np.log(c).sum(), first + f[0] * beta[0]
        xis += [np.outer(f[t], dens[t + 1] * beta[t + 1]) * a[t + 1] / c[t + 1] for t in range(n - 1)]
        xs += list(x[1:])
        levels.append((f * beta, g[["motion_coherence", "prior_std", "cos_s", "cos_p"]].to_numpy()))
    gam, z = (np.concatenate(v) for v in zip(*levels))
    xs, xis = np.array(xs), np.array(xis)
    free = (big[:, :2] - big[:, 2:]).copy()
    for i in range(3):
        for _ in range(40):
            score = np.column_stack([xs @ free[i].T, np.zeros(len(xs))])
            p = np.exp(score - score.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            m = xis[:, i].sum(axis=1)
            grad = np.concatenate([(m * p[:, k] - xis[:, i, k]) @ xs for k in range(2)]) + free[i].ravel()
            hess = np.block([[(xs * (m * p[:, k] * ((k == r) - p[:, r]))[:, None]).T @ xs for r in range(2)] for k in range(2)]) + np.eye(len(grad))
            free[i] -= np.linalg.solve(hess, grad).reshape(2, -1)
    new = np.concatenate([free, np.zeros((3, 1, xs.shape[1]))], axis=1)
    ratio = lambda col, k, j, s: kappa_approx((gam[z[:, col] == k, s] @ z[z[:, col] == k, j]) / gam[z[:, col] == k, s].sum())
    return ll, (first + 1e-3) / (first + 1e-3).sum(), new - new.mean(axis=1, keepdims=True), {k: float(ratio(0, k, 2, 0)) for k in ks}, {k: float(ratio(1, k, 3, 1)) for k in kp}


def test_covariate_chain_takes_one_recursion_an_iteration(folded, monkeypatch):
    df = tt.transition_covariates(folded)
    row = sc.fit_scaler(df).first()
    mean, sd = (np.array([row[f"{t}_{c}"] for c in cv.X]) for t in ("mean", "sd"))
    packed = rec.pack(df, COH, PRIOR, arrays=cv.X)
    model = em.model_from([MAIN], [{"subject_id": None}], COH, PRIOR, ["pi", "B"])
    model.extra |= {"mean": mean[None], "sd": sd[None]}
    recursions, light, run_kernel, logit_pass = [], [], em.run_kernel, em.logit_pass
    monkeypatch.setattr(em, "run_kernel", lambda *a, **k: recursions.append(1) or run_kernel(*a, **k))
    monkeypatch.setattr(em, "logit_pass", lambda *a, **k: light.append(1) or logit_pass(*a, **k))
    fit = em.fit_covariate_hmm(packed, model, em.Stop(3, None), cv.X)[0]
    release()
    assert len(recursions) == 3 and len(light) > 3
    train = [(k[0], 0, g) for k, g in df.orderBy(*SEQ, "pos").toPandas().groupby(SEQ)]
    p = (np.array(MAIN.pi), np.array(MAIN.B), MAIN.kappa_s, MAIN.kappa_p)
    for seen in fit.history:
        ll, *p = plain_covariate_update(train, list(cv.X), mean, sd, *p)
        assert seen == pytest.approx(ll, rel=1e-8)
    np.testing.assert_allclose(fit.params.B, p[1], atol=1e-5)


def test_keyed_cross_validation_runs_until_flat(folded, sequences):
    """Each key by itself goes on until an update gains less than the tolerance, as a plain loop does."""
    stop = em.Stop(60, 1e-4, min_iter=2)
    packed = rec.pack(folded, COH, PRIOR, carry=("fold",))
    keys = folded.filter("subject_id IN (2, 3)").select("subject_id").distinct()
    rows = cv.keyed_cv(packed, ["hmm"], [START], keys, [[0], [1]], [1, 0], stop).collect()
    release()
    assert len(rows) == 4 and all(r["converged"] for r in rows)
    for row in rows:
        train = [s for s in sequences if s[0] == row["subject_id"] and s[1] != row["fold"]]
        test = [s for s in sequences if s[0] == row["subject_id"] and s[1] == row["fold"]]
        p, history = (np.array(START.pi), np.array(START.A), START.kappa_s, START.kappa_p), []
        while True:
            ll, p = one_update(train, *p)
            history.append(ll)
            gain = ll - history[-2] if len(history) > 1 else np.inf
            if len(history) > 2 and gain >= -1e-5 and gain / max(1.0, abs(history[-2])) < 1e-4:
                break
        assert row["n_iter"] == len(history) and row["train_ll"] == pytest.approx(history[-1], rel=1e-9)
        held = sum(passes(densities(g, p[2], p[3]), p[0], p[1])[0] for _, _, g in test)
        assert row["test_ll"] == pytest.approx(held, rel=1e-8) and row["n_test"] == sum(len(g) for _, _, g in test)


def test_hybrid_likelihood_and_class_shares(folded, sequences):
    packed = rec.pack(folded, COH, PRIOR, carry=("fold",))
    model = em.model_from([START], [{"subject_id": 3, "folds": [0, 1]}], COH, PRIOR, ["rho", "class_pi", "class_A"])
    sums = em.hybrid_step(packed, model, "fold")
    scored = rec.score_hybrid(packed, model.keyset(), "fold").agg(F.sum("trial_ll")).first()[0]
    release()
    total, share = 0.0, np.zeros(3)
    for s, _, g in sequences:
        if s == 3:
            b = densities(g, START.kappa_s, START.kappa_p)
            logs = np.array([np.log(START.rho[c]) + passes(b, np.array(START.class_pi[c]), np.array(START.class_A[c]))[0] for c in range(3)])
            norm = np.logaddexp.reduce(logs)
            total, share = total + norm, share + np.exp(logs - norm)
    assert sums["ll"][0] == pytest.approx(total, rel=1e-10) and scored == pytest.approx(total, rel=1e-10)
    np.testing.assert_allclose(sums["rc"][0], share, rtol=1e-8)


def test_stage_likelihoods_chain_up(folded):
    packed = rec.pack(folded, COH, PRIOR)
    model = em.model_from([START] * 2, [{"subject_id": s} for s in (2, 3)], COH, PRIOR, ["pi", "A"])
    rows = em.em_diagnostics(packed, model, 3)
    release()
    for k in range(2):
        mine = [r for r in rows if r["fit_key"] == k]
        for a, b in zip(mine, mine[1:]):
            assert b["ll_before"] == pytest.approx(a["ll_after_kappa"], abs=1e-6)
            assert a["ll_after_kappa"] >= a["ll_before"] - 1e-6 and a["first_decreasing_step"] == "none"


def test_logit_sums_against_rows():
    """Objective, gradient and Hessian by matrix products against sums written out row by row; large scores stay finite."""
    rng = np.random.default_rng(3)
    for scale in (1.0, 300.0):
        x, counts, v = rng.normal(size=(40, 7)), rng.random((40, 3, 3)), scale * rng.normal(size=(3, 14))
        q, g, h = em.logit_sums(x, counts, v)
        for i in range(3):
            own_q, own_g, own_h = 0.0, np.zeros(14), np.zeros((14, 14))
            for t in range(40):
                z = np.append(v[i].reshape(2, 7) @ x[t], 0.0)
                log_p = z - np.logaddexp.reduce(z)
                p, mass = np.exp(log_p[:2]), counts[t, i].sum()
                own_q -= counts[t, i] @ log_p
                own_g += np.kron(mass * p - counts[t, i, :2], x[t])
                own_h += np.kron(mass * (np.diag(p) - np.outer(p, p)), np.outer(x[t], x[t]))
            np.testing.assert_allclose(q[i], own_q, rtol=1e-10)
            np.testing.assert_allclose(g[i], own_g, rtol=1e-9, atol=1e-9)
            np.testing.assert_allclose(h[i], own_h, rtol=1e-9, atol=1e-9)


def test_posteriors_of_an_iteration_are_deleted_after_it(folded, monkeypatch):
    """However many iterations a fit takes, one forward-backward pass lies on disk, with its covariates once for all keys."""
    df = tt.transition_covariates(folded)
    keys = [{"subject_id": None, "folds": [0]}, {"subject_id": None, "folds": [0, 1]}]
    model = em.model_from([MAIN] * 2, keys, COH, PRIOR, ["pi", "B"])
    model.extra |= {"mean": np.zeros((2, len(cv.X))), "sd": np.ones((2, len(cv.X)))}
    made, passes = [], em.chain_posteriors
    held = lambda: [p for p in made if os.path.exists(p.path)]

    def watched(*a, **k):
        assert not held()
        made.append(passes(*a, **k))
        rows = made[-1].df.selectExpr("size(fit_key) AS keys", "size(x_conflict) AS n", "size(before) + size(after) AS m").collect()
        assert len(rows) == df.select(*SEQ, "chunk").distinct().count() and all(r["m"] == 6 * r["n"] * r["keys"] for r in rows)
        return made[-1]

    monkeypatch.setattr(em, "chain_posteriors", watched)
    em.fit_covariate_hmm(rec.pack(df, COH, PRIOR, carry=("fold",), arrays=cv.X), model, em.Stop(2, None), cv.X, "fold")
    release()
    assert len(made) == 2 and not held()
