"""Cross-validated fits and scores of several models in keyed jobs."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcseq.columns import SEQ
from arcseq.operators import em, keyed
from arcseq.operators import recursions as rec
from arcseq.operators import scoring as sc
from arcseq.operators.params import Params, values_table
from arcseq.operators.trial_table import X_COLS
from arcseq.session import stage

X = tuple(X_COLS)

# model -> (parts of the parameters, fitting function)
PARTS = {
    "subject_iid": ["weights"],
    "prior_conditioned_iid": ["condition_weights"],
    "exchangeable_block_mixture": ["rho", "class_weights"],
    "hmm": ["pi", "A"],
    "covariate_hmm": ["pi", "B", "mean", "sd"],
    "block_plus_markov": ["rho", "class_pi", "class_A"],
}


def fold_keys(subjects: list[int] | None, folds: list[list[int]], labels: list[int], label: str = "fold") -> list[dict]:
    """One fit key per (subject, training folds); `labels` name the held-out unit."""
    return [
        {"subject_id": s, "folds": train, label: name}
        for s in (subjects if subjects is not None else [None])
        for train, name in zip(folds, labels)
    ]


def leave_one_out(n: int) -> tuple[list[list[int]], list[int]]:
    return [[f for f in range(n) if f != k] for k in range(n)], list(range(n))


def scaler_arrays(scalers: DataFrame, keys: list[dict], label: str) -> tuple[np.ndarray, np.ndarray]:
    """Training scaler of every key (one row per held-out unit)."""
    rows = {r[label]: r for r in scalers.collect()}
    mean = np.array([[rows[k[label]][f"mean_{c}"] for c in X] for k in keys])
    sd = np.array([[rows[k[label]][f"sd_{c}"] for c in X] for k in keys])
    return mean, sd


def start_model(model: str, init: Params, keys: list[dict], coh, prior, scalers=None, label: str = "fold") -> em.Model:
    parts = [p for p in PARTS[model] if p not in ("mean", "sd")]
    out = em.model_from([init] * len(keys), keys, coh, prior, parts)
    if model == "covariate_hmm":
        mean, sd = scaler_arrays(scalers, keys, label)
        out = replace(out, extra={**out.extra, "mean": mean, "sd": sd})
    return out


def fit(model: str, start: em.Model, rows: DataFrame | None, packed: rec.Packed | None, stop: em.Stop, fold: str, keys=SEQ, exact=True):
    smoothing = 1e-6 if exact else 1e-3
    if model in ("subject_iid", "prior_conditioned_iid"):
        return em.fit_mixture(rows, start, stop, fold, exact, smoothing)
    if model == "exchangeable_block_mixture":
        return em.fit_block(rows, start, stop, fold, keys, exact)
    if model == "hmm":
        return em.fit_hmm(packed, start, stop, fold, exact, smoothing)
    if model == "covariate_hmm":
        return em.fit_covariate_hmm(packed, start, stop, X, fold)
    return em.fit_hybrid(packed, start, stop, fold, exact)


def test_model(fits: list[em.Fit], start: em.Model, label: str, test_of) -> em.Model:
    """The fitted parameters with keys that select the held-out rows instead of the training rows."""
    out = em.model_from(
        [f.params for f in fits],
        [{**f.key, "folds": [test_of(f.key[label])]} for f in fits],
        start.coh,
        start.prior,
        [k for k in start.extra if k not in ("mean", "sd")],
    )
    return replace(out, extra={**out.extra, **{k: start.extra[k] for k in ("mean", "sd") if k in start.extra}})


def held_out(model: str, test: em.Model, rows: DataFrame | None, packed: rec.Packed | None, fold: str, keys=SEQ) -> DataFrame:
    """LL and length of every held-out sequence under the key that left it out: fit_key, keys, ll, n."""
    if model in ("hmm", "covariate_hmm"):
        x = X if model == "covariate_hmm" else ()
        return rec.sequence_ll(packed, test.keyset(), x, fold)
    if model == "block_plus_markov":
        scored = rec.score_hybrid(packed, test.keyset(), fold)
        return scored.groupBy(*keys, "fit_key").agg(F.sum("trial_ll").alias("ll"), F.count(F.lit(1)).alias("n"))
    matched = em.match_keys(rows, test, fold)
    e = em.emission_columns()
    if model == "exchangeable_block_mixture":
        # the LL of a whole block telescopes: log sum over classes of share x product of its trials
        classes = range(test.extra["rho"].shape[1])
        sums = matched.groupBy(*keys, "fit_key").agg(
            F.count(F.lit(1)).alias("n"),
            F.first("rho").alias("rho"),
            *[F.sum(sc.C.logsumexp([F.col("class_weights")[c][i] + e[i] for i in range(3)])).alias(f"s{c}") for c in classes],
        )
        ll = sc.C.logsumexp([F.col("rho")[c] + F.col(f"s{c}") for c in classes])
        return sums.select(*keys, "fit_key", ll.alias("ll"), "n")
    log_w = F.col("condition_weights")[F.col("pi_")] if model == "prior_conditioned_iid" else F.col("weights")
    ll = sc.C.logsumexp([log_w[i] + e[i] for i in range(3)])
    return matched.groupBy(*keys, "fit_key").agg(F.sum(ll).alias("ll"), F.count(F.lit(1)).alias("n"))


def run_cv(
    df: DataFrame,
    models: list[str],
    init: Params,
    keys: list[dict],
    coh: list[float],
    prior: list[float],
    stop: em.Stop,
    fold: str = "fold",
    label: str = "fold",
    test_of=lambda k: k,
    seq: list[str] = SEQ,
    scalers: DataFrame | None = None,
    exact: bool = True,
    per_sequence: bool = False,
) -> DataFrame:
    """Fit every model on every key and score its held-out sequences: one row per model and key, or (`per_sequence`) one per
    model, key and sequence, which is what comparisons and bootstraps of fitted folds read.

    `df` holds the trials with their fold; each model is one keyed job per iteration, whatever the number
    of keys.
    """
    need_pack = [m for m in models if m in ("hmm", "covariate_hmm", "block_plus_markov")]
    arrays = X if "covariate_hmm" in models else ()
    packed = rec.pack(df, coh, prior, seq, (fold, *(["subject_id"] if "subject_id" not in seq else [])), arrays) if need_pack else None
    rows = None
    if len(need_pack) < len(models):
        rows = em.level_rows(df, coh, prior, fold, *[k for k in seq if k not in SEQ])
    out = []
    for m in models:
        start = start_model(m, init, keys, coh, prior, scalers, label)
        fits = fit(m, start, rows, packed, stop, fold, seq, exact)
        test = test_model(fits, start, label, test_of)
        each = held_out(m, test, rows, packed, fold, seq)
        if per_sequence:
            named = values_table(df.sparkSession, ["model", "fit_key", label], [(m, i, f.key[label]) for i, f in enumerate(fits)])
            ll = each.select(*seq, "fit_key", F.col("ll").alias("test_ll"), F.col("n").alias("n_test"))
            out.append(named.join(ll, "fit_key").drop("fit_key"))
            continue
        scored = each.groupBy("fit_key").agg(
            F.sum("ll").alias("test_ll"), F.sum("n").alias("n_test"), F.count(F.lit(1)).alias("n_test_sequences")
        )
        info = values_table(
            df.sparkSession,
            ["model", "fit_key", label, "subject_id", "n_train", "train_ll", "n_iter", "converged"],
            [
                (m, i, f.key[label], -1 if f.key.get("subject_id") is None else f.key["subject_id"], f.n_rows, f.train_ll, len(f.history), f.converged)
                for i, f in enumerate(fits)
            ],
        )
        out.append(info.join(scored, "fit_key").drop("fit_key"))
    result = out[0]
    for t in out[1:]:
        result = result.unionByName(t)
    return result.withColumn("test_ll_per_trial", F.col("test_ll") / F.col("n_test"))


def keyed_cv(
    packed: rec.Packed, models: list[str], inits: list[Params], keys: DataFrame, train: list[list[int]], labels: list[int], stop: em.Stop,
    fold: str = "fold", label: str = "fold", by: tuple | list = ("subject_id",), per_sequence: bool = False, exact: bool = True,
) -> DataFrame:
    """As `run_cv`, for fits keyed by a table: `keys` has a row for each `by` key, `labels` name the fold that each training set
    leaves out. Of several starting points the fit with the highest training likelihood is scored."""
    by, out = list(by), []
    for m in models:
        model = keyed.Model(m, packed.coh, packed.prior)
        fits = keyed.fit(packed, keyed.starts(keyed.fold_fits(keys, train, labels, label), model, inits), by, model, stop, fold, exact)
        best = stage(keyed.best_of(fits, [*by, label]).drop("seed"), "best-fits") if len(inits) > 1 else fits.filter(F.size("history") > 0)
        test = best.select(*by, label, F.array(F.col(label).cast("int")).alias("folds"), *model.shapes)
        each = keyed.score(packed, test, by, model, fold)
        if per_sequence:
            out.append(each.select(F.lit(m).alias("model"), label, *dict.fromkeys([*packed.keys, *by]), F.col("ll").alias("test_ll"), F.col("n").alias("n_test")))
            continue
        scored = each.groupBy(*by, label).agg(F.sum("ll").alias("test_ll"), F.sum("n").alias("n_test"), F.count(F.lit(1)).alias("n_test_sequences"))
        info = best.select(
            F.lit(m).alias("model"), *by, label, F.col("n_trials").alias("n_train"), F.element_at("history", -1).alias("train_ll"),
            F.size("history").cast("long").alias("n_iter"), "converged",
        )
        on = [info[c].eqNullSafe(scored[c]) for c in [*by, label]]
        out.append(info.join(scored, on).select(*[info[c] for c in info.columns], "test_ll", "n_test", "n_test_sequences"))
    result = out[0]
    for t in out[1:]:
        result = result.unionByName(t)
    return result.withColumn("test_ll_per_trial", F.col("test_ll") / F.col("n_test"))


SERIAL = ["independent_switching", "serial_stimulus", "serial_response", "serial_both"]


SERIAL_POINT = ["alpha_stim", "alpha_resp"]


def best_serial(sums: DataFrame, fold: str = "fold") -> DataFrame:
    """Point of the largest LL on the other folds, for each model and fold; LLs that agree to six digits go to the smaller coefficients."""
    total = sums.groupBy(*SERIAL_POINT).agg(F.sum("own").alias("total"))
    no_stim, no_resp = F.col("alpha_stim") == 0, F.col("alpha_resp") == 0
    allowed = F.array(F.when(no_stim & no_resp, SERIAL[0]), F.when(no_resp, SERIAL[1]), F.when(no_stim, SERIAL[2]), F.lit(SERIAL[3]))
    tried = sums.join(total, SERIAL_POINT).withColumn("model", F.explode(F.filter(allowed, lambda m: m.isNotNull())))
    order = F.struct(F.round(F.col("total") - F.col("own"), 6).alias("ll"), (-F.col("alpha_stim")).alias("a"), (-F.col("alpha_resp")).alias("b"))
    return tried.groupBy("model", fold).agg(*[F.max_by(c, order).alias(c) for c in SERIAL_POINT])


def points_around(model: str, stim: float, resp: float, step: float, low: float, high: float) -> set[tuple[float, float]]:
    """The grid of `step` that reaches four steps to each side of a model's point, within the bounds."""
    near = lambda x, free: {min(max(x + k * step, low), high) for k in range(-4, 5)} if free else {x}
    stims, resps = near(stim, model in (SERIAL[1], SERIAL[3])), near(resp, model in (SERIAL[2], SERIAL[3]))
    return {(a, b) for a in stims for b in resps}


def serial_cv(
    df: DataFrame, params: Params, grid: list[tuple[float, float]], fold: str = "fold", seq: list[str] = SEQ, tolerance: float = 0.005
) -> DataFrame:
    """Held-out LL of every sequence under the serial models, their coefficients chosen on the other folds.

    The even grid (of at least two values a side) is refined around the best point of each model and fold, four times as
    fine each time, until its step is within `tolerance`. A pass gives the LL of each fold at the new points; only the
    chosen points (four a fold) come to the driver. The model without serial terms is the point (0, 0).
    """
    terms = stage(sc.serial_terms(df, params, (fold, *seq)), "serial-terms")
    sides = sorted({a for a, _ in grid})
    step, low, high = sides[1] - sides[0], sides[0], sides[-1]
    sums, points = None, set(grid)
    tried: set[tuple[float, float]] = set()
    while True:
        if points:
            new = sc.terms_profile(terms, params, sorted(points), (fold,)).select(fold, *SERIAL_POINT, F.col("ll").alias("own"))
            new = stage(new, "serial-sums")
            sums = new if sums is None else sums.unionByName(new)
            tried |= points
        best = stage(best_serial(sums, fold), "serial-best")
        chosen = best.select("model", *SERIAL_POINT).distinct().collect()
        if step <= tolerance:
            break
        step /= 4
        points = {p for m, a, b in chosen for p in points_around(m, a, b, step, low, high)} - tried
    each = sc.terms_profile(terms, params, sorted({(a, b) for _, a, b in chosen}) or grid[:1], (fold, *seq))
    return each.join(best, [fold, *SERIAL_POINT]).select("model", fold, *seq, *SERIAL_POINT, F.col("n").alias("n_test"), F.col("ll").alias("test_ll"))
