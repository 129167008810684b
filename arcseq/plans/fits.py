"""Registered queries: keyed EM fits, held-out scoring and comparisons of fits and versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from arcseq.columns import CHUNK, SEQ, STATES, TRANSITIONS
from arcseq.operators import comparison as cmp
from arcseq.operators import cv, em, keyed
from arcseq.operators import recursions as rec
from arcseq.operators import resampling as rs
from arcseq.operators import scoring as sc
from arcseq.operators import splits as sp
from arcseq.operators import trial_table as tt
from arcseq.operators.params import Params, params_to_json, values_table
from arcseq.operators.quantiles import exact_quantiles
from arcseq.plans import fixed
from arcseq.plans.fixed import COH, MAIN, N_FOLDS, PRIOR, START
from arcseq.plans.models import SEG, X, chain, covariate_chain, segment_rows, with_folds
from arcseq.plans.tables import STRATA, matched
from arcseq.plans.workspace import features, folds, r, rr, segments
from arcseq.session import staged_once
from arcseq.sources.trials import union_shards

QUERIES = {}
ONCE = em.Stop(max_iter=1, tol=None)
#: Where models are compared, each fit goes on until an iteration gains less than this share of its likelihood.
UNTIL_FLAT = em.Stop(max_iter=40, tol=1e-3, min_iter=2)
KAPPAS = ["kappa_s_06", "kappa_s_12", "kappa_s_24", "kappa_p_10", "kappa_p_20", "kappa_p_40", "kappa_p_80"]
PIS = [f"pi_{s}" for s in STATES]
OTHERS, LABELS = cv.leave_one_out(N_FOLDS)


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def subjects(df):
    """The subjects, one row each: the keys of a job are a table."""
    return df.select("subject_id").distinct()


def subject_fits(packed, name, inits, stop, exact=True, smoothing=1e-6, fold=None, sets=None):
    """Fits of a model by subject (and training set)."""
    model = keyed.Model(name, COH, PRIOR)
    keys = keyed.fold_fits(subjects(packed.df), *sets) if sets else subjects(packed.df)
    return model, keyed.fit(packed, keyed.starts(keys, model, inits), ["subject_id"], model, stop, fold, exact, smoothing)


# ---- fits


@register
def e1_fit_mixture(spark, sf):
    df = with_folds(spark, sf)
    rows = em.level_rows(df, COH, PRIOR, "fold")
    model = em.model_from([MAIN] * N_FOLDS, cv.fold_keys(None, OTHERS, LABELS), COH, PRIOR, ["weights"])
    fits = em.fit_mixture(rows, model, em.Stop(max_iter=3, tol=None), "fold")
    out = em.fits_table(df, fits, ["fold"])
    return out.select("fold", "n_trials", r("train_ll", "train_ll", 4), *rr(*[f"weight_{s}" for s in STATES], places=5), *rr(*KAPPAS, places=4))


@register
def e2_fit_conditioned(spark, sf):
    df = features(spark, sf)
    rows = em.level_rows(df, COH, PRIOR)
    model = em.model_from([MAIN], [{"subject_id": None}], COH, PRIOR, ["condition_weights"])
    fits = em.fit_mixture(rows, model, em.Stop(max_iter=2, tol=None))
    table = em.fits_table(df, fits, []).select("n_trials", r("train_ll", "train_ll", 4), *rr(*KAPPAS, places=4), F.lit(1).alias("one"))
    weights = values_table(
        spark, ["prior_std", *[f"w_{s}" for s in STATES], "one"], [(w, *map(float, v), 1) for w, v in fits[0].params.condition_weights.items()]
    )
    return weights.join(table, "one").drop("one").withColumns({f"w_{s}": F.round(f"w_{s}", 5) for s in STATES})


def hmm_once(spark, sf):
    """One update of the chain model per subject and left-out fold."""
    df = with_folds(spark, sf)
    packed = rec.pack(df, COH, PRIOR, carry=("fold",))
    model, fitted = subject_fits(packed, "hmm", [START], ONCE, False, 1e-3, "fold", (OTHERS, LABELS))
    return keyed.table(fitted, model, ["subject_id", "fold"])


def fits(spark, sf):
    return staged_once(spark, ("fits", sf), lambda: hmm_once(spark, sf))


FIT_COLS = [*PIS, *TRANSITIONS]


@register
def e3_fit_hmm(spark, sf):
    out = hmm_once(spark, sf)
    return out.select("subject_id", "fold", "n_trials", r("train_ll", "train_ll", 4), *rr(*FIT_COLS, places=5), *rr(*KAPPAS, places=4))


@register
def e3_fit_hmm_exact(spark, sf):
    """Run to convergence per subject with exact concentrations."""
    packed = rec.pack(segment_rows(spark, sf), COH, PRIOR, keys=SEG)
    model, fitted = subject_fits(packed, "hmm", [START], em.Stop(40, 1e-3, rule="absolute"))
    return keyed.table(fitted, model, ["subject_id"])


@register
def e4_fit_covariate_hmm(spark, sf):
    df = tt.transition_covariates(features(spark, sf))
    row = sc.fit_scaler(df).first()
    packed = rec.pack(df, COH, PRIOR, arrays=X)
    model = em.model_from([MAIN], [{"subject_id": None}], COH, PRIOR, ["pi", "B"])
    model.extra["mean"] = sc.np.array([[row[f"mean_{c}"] for c in X]])
    model.extra["sd"] = sc.np.array([[row[f"sd_{c}"] for c in X]])
    fitted = em.fit_covariate_hmm(packed, model, em.Stop(max_iter=4, tol=None), X)
    p = fitted[0].params
    names = ["intercept", *tt.COVARIATES]
    rows = [
        (a, b, n, float(p.B[i][j][k]))
        for i, a in enumerate(STATES)
        for j, b in enumerate(STATES)
        for k, n in enumerate(names)
    ]
    return values_table(spark, ["previous_state", "next_state", "covariate", "coefficient"], rows).withColumn(
        "train_ll", F.lit(fitted[0].train_ll)
    )


@register
def e5_fit_block(spark, sf):
    packed = rec.pack(segments(spark, sf).withColumn("pos", F.col("seg_pos")), COH, PRIOR, keys=SEG)
    model, fitted = subject_fits(packed, "exchangeable_block_mixture", [START], ONCE, exact=False)
    shares = [*[f"rho_{c}" for c in range(3)], *[f"cw_{c}{s}" for c in range(3) for s in range(3)]]
    return keyed.table(fitted, model, ["subject_id"]).select("subject_id", "n_trials", r("train_ll", "train_ll", 4), *rr(*KAPPAS, places=4), *rr(*shares, places=5))


@register
def e6_fit_hybrid(spark, sf):
    packed = rec.pack(segment_rows(spark, sf), COH, PRIOR, keys=SEG)
    _, fitted = subject_fits(packed, "block_plus_markov", [START], em.Stop(max_iter=4, tol=None))
    return keyed.history(fitted, ["subject_id"])


#: Starting points of the restarts.
INITS = [Params(START.kappa_s, START.kappa_p, weights=w, pi=p, A=a) for w, p, a in zip(fixed.INIT_WEIGHTS, fixed.INIT_PI, fixed.INIT_A, strict=True)]


def mixture_restarts(spark, sf):
    """Three starting points of the mixture per subject; two updates, and a third where the second still gains 17 %."""
    packed = rec.pack(features(spark, sf), COH, PRIOR)
    model, fitted = subject_fits(packed, "subject_iid", INITS, em.Stop(max_iter=3, tol=0.17, min_iter=1), False, 1e-3)
    return keyed.table(fitted, model, ["subject_id", "seed"])


@register
def e7_restart_diagnostics(spark, sf):
    fitted = mixture_restarts(spark, sf).withColumn("train_ll", F.round("train_ll", 6))
    out = cmp.restart_diagnostics(fitted, ["subject_id"])
    return out.select("subject_id", "seed", "n_iter", "selected", *rr("train_ll", "delta_from_best", places=4))


@register
def t3_best_fit(spark, sf):
    out = cmp.best_fit(mixture_restarts(spark, sf).withColumn("train_ll", F.round("train_ll", 6)), ["subject_id"])
    return out.select("subject_id", "seed", r("train_ll", "train_ll", 4))


@register
def a15_restart_summary(spark, sf):
    fitted = mixture_restarts(spark, sf).withColumn("train_ll", F.round("train_ll", 6))
    out = cmp.restart_summary(fitted, ["subject_id"])
    return out.select(
        "subject_id", "n_restarts", "n_converged", "selected_seed", "selected_n_iter", *rr("best_train_ll", "worst_train_ll", "ll_range", places=4)
    )


def chain_restarts(spark, sf):
    packed = rec.pack(features(spark, sf), COH, PRIOR)
    model, fitted = subject_fits(packed, "hmm", INITS, ONCE, False, 1e-3)
    return keyed.table(fitted, model, ["subject_id", "seed"])


@register
def a30_init_sensitivity(spark, sf):
    out = cmp.init_sensitivity(chain_restarts(spark, sf), ["subject_id"])
    return out.select("subject_id", *rr("ll_range", "diag_range", "best_ll", places=5))


@register
def e8_run_cv(spark, sf):
    df = tt.transition_covariates(with_folds(spark, sf))
    return cv.run_cv(
        df, ["subject_iid", "hmm", "covariate_hmm"], MAIN, cv.fold_keys(None, OTHERS, LABELS), COH, PRIOR,
        em.Stop(max_iter=3, tol=None), scalers=sc.fold_scalers(df), exact=False,
    )


@register
def e8_cv_sequences(spark, sf):
    """Held-out LL of every sequence under the fit of the other folds."""
    return cv.run_cv(
        with_folds(spark, sf), ["subject_iid", "hmm"], MAIN, cv.fold_keys(None, OTHERS, LABELS), COH, PRIOR,
        em.Stop(max_iter=3, tol=None), exact=False, per_sequence=True,
    )


def serial_scores(spark, sf):
    df = tt.serial_previous(with_folds(spark, sf))
    return staged_once(spark, ("serial_scores", sf), lambda: cv.serial_cv(df, MAIN, fixed.GRID))


@register
def e8_serial_cv(spark, sf):
    return serial_scores(spark, sf).select("model", "fold", *SEQ, "n_test", *rr("alpha_stim", "alpha_resp", "test_ll"))


@register
def a10_serial_cv(spark, sf):
    out = cmp.summarise_cv(cmp.cv_results(serial_scores(spark, sf)))
    return out.select("model", "folds", *rr("mean_test_ll_per_trial", "se_test_ll_per_trial", "delta_from_best_per_trial"))


@register
def b1_serial_cv(spark, sf):
    """Bootstrap over held-out sequences of the gain that the serial terms bring."""
    out = rs.bootstrap_diff(serial_scores(spark, sf), cv.SERIAL[0], cv.SERIAL[1:], draws=200)
    return out.select("model", "baseline", "n_sequences", *rr("observed_delta_ll_per_trial", "ci_low", "ci_high"))


@register
def e8_run_cv_subjects(spark, sf):
    """Five models by subject and left-out fold, each fit run until it is flat."""
    packed = rec.pack(segment_rows(spark, sf), COH, PRIOR, keys=SEG, carry=("fold",))
    models = ["subject_iid", "prior_conditioned_iid", "exchangeable_block_mixture", "hmm", "block_plus_markov"]
    return cv.keyed_cv(packed, models, [START], subjects(packed.df), OTHERS, LABELS, UNTIL_FLAT)


@register
def e9_fit_subjects(spark, sf):
    packed = rec.pack(features(spark, sf), COH, PRIOR)
    model, fitted = subject_fits(packed, "hmm", [MAIN], ONCE, False, 1e-3)
    out = keyed.table(fitted, model, ["subject_id"])
    return sc.stationary(out).select("subject_id", "n_trials", r("train_ll", "train_ll", 4), *rr(*TRANSITIONS, *[f"stationary_{s}" for s in STATES], places=5))


@register
def e9_fit_final(spark, sf):
    packed = rec.pack(features(spark, sf), COH, PRIOR)
    model = em.model_from([MAIN], [{"subject_id": None}], COH, PRIOR, ["pi", "A"])
    out = em.fits_table(packed.df, em.fit_hmm(packed, model, ONCE), [])
    return out.select("n_trials", r("train_ll", "train_ll", 4), *rr(*TRANSITIONS, places=5), *rr(*KAPPAS, places=4))


@register
def e11_em_diagnostics(spark, sf):
    packed = rec.pack(segment_rows(spark, sf), COH, PRIOR, keys=SEG)
    keys = [{"subject_id": s} for s in sorted(x[0] for x in subjects(packed.df).collect())]
    model = em.model_from([START] * len(keys), keys, COH, PRIOR, ["pi", "A"])
    rows = em.em_diagnostics(packed, model, 3)
    names = [c for c in rows[0] if c != "fit_key"]
    return values_table(spark, ["subject_id", *names], [(keys[x["fit_key"]]["subject_id"], *[x[c] for c in names]) for x in rows])


# ---- held-out scoring


def fold_keyset():
    """One parameter set per fold, applied to the rows of that fold."""
    params = [Params(START.kappa_s, START.kappa_p, pi=START.pi, A=fixed.fold_matrix(f)) for f in range(N_FOLDS)]
    model = em.model_from(params, [{"subject_id": None, "folds": [f]} for f in range(N_FOLDS)], COH, PRIOR, ["pi", "A"])
    return model.keyset()


def held_out(spark, sf):
    packed = rec.pack(segment_rows(spark, sf), COH, PRIOR, keys=SEG, carry=("fold",))
    return rec.chain_scores(packed, fold_keyset(), fold="fold", named=True)


@register
def h7_score_held_out(spark, sf):
    return held_out(spark, sf).select("row_id", F.col("fit_key").alias("fold"), *rr(*rec.PRED, *rec.FILT, "trial_ll"))


@register
def h12_export_scores(spark, sf):
    """Every trial twice: under the all-data parameters and under those of the fold that left it out."""
    packed = rec.pack(segment_rows(spark, sf), COH, PRIOR, keys=SEG, carry=("fold",))
    cols = ["row_id", *rec.PRED, *rec.FILT, "trial_ll"]
    final = rec.chain_scores(packed, rec.one_key(START, COH, PRIOR)).select(*cols, F.lit("final").alias("fit_scope"))
    oof = rec.chain_scores(packed, fold_keyset(), fold="fold", named=True)
    oof = oof.select(*cols, F.lit("oof").alias("fit_scope"), F.col("fit_key").alias("fold"))
    return union_shards([final, oof]).select("row_id", "fit_scope", "fold", *rr(*rec.PRED, *rec.FILT, "trial_ll"))


MODELS = ["independent_switching", "serial_stimulus", "serial_response", "serial_both", "static_hmm", "covariate_hmm"]


def trial_scores(spark, sf):
    """Per trial and model: LL under fixed parameters."""

    def build():
        feat = tt.serial_previous(features(spark, sf))
        parts = [sc.score_mixture(feat, MAIN).select("row_id", *SEQ, "trial_ll", F.lit(MODELS[0]).alias("model"))]
        for mode in ("stimulus", "response", "both"):
            parts.append(sc.score_serial(feat, MAIN, mode).select("row_id", *SEQ, "trial_ll", F.lit(f"serial_{mode}").alias("model")))
        static = rec.chain_scores(*chain(spark, sf))
        parts.append(static.select("row_id", *SEQ, "trial_ll", F.lit("static_hmm").alias("model")))
        cov = rec.chain_scores(*covariate_chain(spark, sf), x_cols=X)
        parts.append(cov.select("row_id", *SEQ, "trial_ll", F.lit("covariate_hmm").alias("model")))
        return union_shards(parts)

    return staged_once(spark, ("trial_scores", sf), build)


def seq_scores(spark, sf):
    def build():
        scored = cmp.seq_scores(trial_scores(spark, sf), ["model", *SEQ])
        return scored.join(folds(spark, sf).select(*SEQ, "fold", "prior_std"), SEQ)

    return staged_once(spark, ("seq_scores", sf), build)


@register
def a12_seq_scores(spark, sf):
    out = seq_scores(spark, sf)
    return out.select("model", "fold", *SEQ, "n_test", r("prior_std"), *rr("test_ll", "test_ll_per_trial"))


@register
def a10_summarise_cv(spark, sf):
    out = cmp.summarise_cv(cmp.cv_results(seq_scores(spark, sf)))
    return out.select("model", "folds", *rr("mean_test_ll_per_trial", "se_test_ll_per_trial", "delta_from_best_per_trial"), r("mean_test_ll", "mean_test_ll", 4))


@register
def a11_heldout_summary(spark, sf):
    out = cmp.heldout_summary(seq_scores(spark, sf), ["model", "subject_id"])
    return out.select("model", "subject_id", "n_trials", r("total_ll", "total_ll", 4), *rr("ll_per_trial", "perplexity"))


def subject_criteria(spark, sf):
    scored = seq_scores(spark, sf).groupBy("model", "subject_id").agg(
        F.sum("n_test").alias("n_trials"), F.sum("test_ll").alias("log_likelihood")
    )
    return cmp.information_criteria(scored, len(COH), len(PRIOR))


@register
def a13_information_criteria(spark, sf):
    return subject_criteria(spark, sf).select("model", "subject_id", "n_trials", "n_parameters", *rr("log_likelihood", "aic", "bic", places=4))


@register
def a13_pooled_criteria(spark, sf):
    out = cmp.pooled_criteria(subject_criteria(spark, sf))
    ints = ["model", "n_subjects", "n_trials", "total_parameters"]
    return out.select(*ints, *rr(*[c for c in out.columns if c not in ints], places=4))


@register
def a14_group_summary(spark, sf):
    """Spread between the subjects' fits, for each fold."""
    parts = [cmp.group_summary(fits(spark, sf).filter(F.col("fold") == k), [*FIT_COLS, *KAPPAS]).withColumn("fold", F.lit(k)) for k in LABELS]
    return union_shards(parts).select("fold", "parameter", *rr("mean", "sd_between_subjects", "se", places=4))


@register
def a9_state_weights(spark, sf):
    packed = rec.pack(features(spark, sf), COH, PRIOR)
    post = rec.chain_scores(packed, rec.one_key(START, COH, PRIOR), smooth=True)
    out = cmp.state_weights(post, ["subject_id"], "smoothed_p_")
    return out.select("subject_id", *rr(*[f"{s}_weight" for s in STATES]))


@register
def p10_fit_qc(spark, sf):
    """Flags of fits; the last likelihood of every fourth subject is made infinite, which has to be told."""
    df = features(spark, sf)
    packed = rec.pack(df, COH, PRIOR)
    model, fitted = subject_fits(packed, "hmm", [START], em.Stop(max_iter=2, tol=None), False, 1e-3)
    post = rec.chain_scores(packed, rec.one_key(START, COH, PRIOR), smooth=True)
    table = keyed.table(fitted, model, ["subject_id"]).join(cmp.state_weights(post, ["subject_id"], "smoothed_p_"), "subject_id")
    spoilt = F.when((F.col("subject_id") % 4 == 3) & (F.col("iteration") == 2), F.lit(float("inf"))).otherwise(F.col("log_likelihood"))
    history = keyed.history(fitted, ["subject_id"]).withColumn("log_likelihood", spoilt)
    out = cmp.fit_qc(table, history, ["subject_id"])
    return out.select("subject_id", r("maximum_drop"), *[c for c in out.columns if c not in ("subject_id", "maximum_drop")])


@register
def m10_parameters_long(spark, sf):
    return sc.parameters_long(fits(spark, sf), ["subject_id", "fold"]).withColumn("value", F.round("value", 4) + 0.0)


@register
def m14_stationary(spark, sf):
    return sc.stationary(fits(spark, sf)).select("subject_id", "fold", *rr(*[f"stationary_{s}" for s in STATES], places=5))


@register
def m15_persistence_excess(spark, sf):
    out = sc.persistence_excess(sc.stationary(fits(spark, sf)), ["subject_id", "fold"])
    return out.select("subject_id", "fold", "state", *rr("self_transition", "stationary_probability", "persistence_excess", places=5))


@register
def f11_parameters_of_fits(spark, sf):
    f = fits(spark, sf)
    text = params_to_json({c: F.round(c, 3) for c in KAPPAS})
    back = F.from_json("text", "map<string,double>")
    return f.select("subject_id", "fold", text.alias("text")).select(
        "subject_id", "fold", *[F.try_element_at(back, F.lit(c)).alias(c) for c in KAPPAS]
    )


@register
def j11_verify_refit(spark, sf):
    """Fits against a reference table that keeps likelihoods as whole numbers."""
    reference = fits(spark, sf).withColumn("train_ll", F.round("train_ll", 0))
    out = cmp.verify_refit(hmm_once(spark, sf), reference, ["subject_id", "fold"], "train_ll", 0.25)
    return out.select("subject_id", "fold", *rr("train_ll", "reference_train_ll", "difference", places=4), "matches")


@register
def j5_reconcile(spark, sf):
    """Trial scores summed per sequence against a table of sequence likelihoods that disagrees with them on purpose."""
    out = cmp.reconcile(*two_tables(spark, sf), SEQ, "v")
    return out.select(*SEQ, "match", "duplicated", r("abs_difference"))


def two_tables(spark, sf):
    """Summed chain scores; and sequence likelihoods of the chain where the session is even, of the mixture where it is odd,
    under another run number in every tenth session and twice in every seventh."""
    scores = trial_scores(spark, sf)
    summed = scores.filter("model = 'static_hmm'").groupBy(*SEQ).agg(F.sum("trial_ll").alias("v"))
    even = rec.sequence_ll(*chain(spark, sf)).select(*SEQ, F.col("ll").alias("v")).filter("session_id % 2 = 0")
    odd = scores.filter("model = 'independent_switching' AND session_id % 2 = 1").groupBy(*SEQ).agg(F.sum("trial_ll").alias("v"))
    other = even.unionByName(odd)
    other = other.unionByName(other.filter("session_id % 7 = 0"))
    return summed, other.withColumn("run_id", F.when(F.col("session_id") % 10 == 0, F.col("run_id") + 1000).otherwise(F.col("run_id")))


@register
def j5_reconcile_summary(spark, sf):
    out = cmp.reconcile_summary(cmp.reconcile(*two_tables(spark, sf), SEQ, "v"))
    return out.select("n_keys", "n_both", "n_duplicated", r("max_abs_difference"))


@register
def j8_compare_models(spark, sf):
    base = features(spark, sf).select("row_id", "is_start")
    out = cmp.compare_models(base, trial_scores(spark, sf), MODELS, MODELS[0])
    return out.select("row_id", "is_start", *rr(*[f"{m}_ll" for m in MODELS], *[f"{m}_delta" for m in MODELS]))


@register
def w16_representative(spark, sf):
    out = cmp.representative(seq_scores(spark, sf), "static_hmm", "independent_switching")
    return out.select(*SEQ, *rr("delta", "median_delta"))


@register
def a32_score_checks(spark, sf):
    """Checks of scores in which some rows were spoilt: one kind of damage for each check."""
    scored = rec.chain_scores(*chain(spark, sf), smooth=True, pairs=True).withColumn("is_start", F.col("pos") == 1)
    hit = lambda k: F.col("row_id") % k == 0
    scored = scored.withColumns(
        {
            "trial_ll": F.when(~hit(97), F.col("trial_ll")),
            rec.PRED[0]: F.col(rec.PRED[0]) * F.when(hit(89), 1.5).otherwise(1.0),
            rec.FILT[1]: F.col(rec.FILT[1]) * F.when(hit(83), 1.5).otherwise(1.0),
            rec.SMOOTH[2]: F.col(rec.SMOOTH[2]) * F.when(hit(79), 1.5).otherwise(1.0),
            rec.XI[4]: F.col(rec.XI[4]) * F.when(hit(71), 1.5).otherwise(1.0),
            "xi_sensory_to_sensory": F.when(F.col("is_start") & hit(2), 0.0).otherwise(F.col("xi_sensory_to_sensory")),
        }
    )
    scored = scored.unionByName(scored.filter(hit(50)))
    out = cmp.score_checks(
        scored, {"predictive": rec.PRED, "filtered": rec.FILT, "smoothed": rec.SMOOTH, "pairwise": rec.XI}, ["xi_sensory_to_sensory"]
    )
    return out.select(*[r(c) if c.startswith("max_") else c for c in out.columns])


# ---- original against permuted order


BASELINES = ["subject_iid", "prior_conditioned_iid", "exchangeable_block_mixture"]


def version_scores(spark, sf):
    """LL of four models per segment in the original and in the permuted order."""

    def build():
        parts = []
        packed = rec.pack(segment_rows(spark, sf), COH, PRIOR, keys=SEG, carry=("fold",))
        for version in ("original", "shuffled"):
            own = packed if version == "original" else rec.permuted(packed, 7)
            mixed = sc.mixture_sums(rec.packed_rows(own, ("fold",)), START, [*SEG, "fold"])
            each = F.stack(F.lit(3), *[x for m in BASELINES for x in (F.lit(m), F.col(m))]).alias("model", "test_ll")
            parts.append(mixed.select(*SEG, "fold", "n_test", each, F.lit(version).alias("data_version")))
            hmm = rec.sequence_ll(own, rec.one_key(START, COH, PRIOR), carry=("fold",))
            hmm = hmm.select(*SEG, "fold", F.col("n").alias("n_test"), F.lit("hmm").alias("model"), F.col("ll").alias("test_ll"))
            parts.append(hmm.withColumn("data_version", F.lit(version)))
        return union_shards(parts)

    return staged_once(spark, ("version_scores", sf), build)


@register
def a11_versions(spark, sf):
    out = cmp.heldout_summary(version_scores(spark, sf), ["model", "data_version", "fold"])
    return out.select("model", "data_version", "fold", "n_trials", r("total_ll", "total_ll", 4), *rr("ll_per_trial", "perplexity"))


@register
def a26_gain_decomposition(spark, sf):
    out = cmp.gain_decomposition(cmp.heldout_summary(version_scores(spark, sf), ["model", "data_version"]))
    return out.select("baseline", *rr(*[c for c in out.columns if c != "baseline"]))


@register
def a27_order_invariance(spark, sf):
    scored = version_scores(spark, sf).withColumn("test_ll", F.round("test_ll", 7))
    out = cmp.order_invariance(scored, ["subject_id", "fold"])
    return out.select("model", *rr("max_abs_fold_total_ll_difference", "overall_total_ll_difference", places=4), "order_invariant_pass")


def deltas(spark, sf):
    subject = cmp.heldout_summary(version_scores(spark, sf), ["model", "data_version", "subject_id"])
    return cmp.subject_deltas(subject, "hmm", BASELINES)


@register
def a28_winner_counts(spark, sf):
    out = cmp.winner_counts(deltas(spark, sf))
    return out.select("data_version", "comparison", "subjects_better", "subjects_baseline_better", *rr("mean_subject_delta", "min_delta", "max_delta"))


def version_fits(spark, sf, version):
    packed = rec.pack(segment_rows(spark, sf), COH, PRIOR, keys=SEG)
    packed = packed if version == "original" else rec.permuted(packed, 7)
    model, fitted = subject_fits(packed, "hmm", [START], ONCE, False, 1e-3)
    return keyed.table(fitted, model, ["subject_id"])


@register
def j6_compare_versions(spark, sf):
    a, b = (version_fits(spark, sf, v) for v in ("original", "shuffled"))
    out = cmp.compare_versions(a, b, ["subject_id"], ["train_ll", "sensory_to_sensory", "prior_to_prior"])
    return out.select("subject_id", *rr(*[c for c in out.columns if c != "subject_id"], places=4))


@register
def a25_matrix_metrics(spark, sf):
    a, b = (version_fits(spark, sf, v) for v in ("original", "shuffled"))
    metrics = cmp.matrix_metrics(a).select("subject_id", "mean_diagonal_transition", "transition_entropy")
    out = metrics.join(cmp.frobenius(a, b, ["subject_id"]), "subject_id")
    return out.select("subject_id", *rr("mean_diagonal_transition", "transition_entropy", "frobenius_distance", places=5))


@register
def a24_dwell_switch(spark, sf):
    packed = rec.pack(segment_rows(spark, sf), COH, PRIOR, keys=SEG)
    paths = rec.viterbi(packed, rec.one_key(START, COH, PRIOR))
    runs = tt.run_lengths(paths, "viterbi_state", SEG, CHUNK, "pos")
    out = cmp.dwell_switch(paths, runs, "viterbi_state", seq=SEG)
    return out.select("subject_id", *rr(*[c for c in out.columns if c != "subject_id"]))


@register
def a29_between_block_variance(spark, sf):
    strata = ["subject_id", "fold", "prior_std"]
    original = cmp.between_block_variance(segments(spark, sf), strata).withColumn("data_version", F.lit("original"))
    moved = cmp.between_block_variance(matched(spark, sf), strata).withColumn("data_version", F.lit("matched"))
    return union_shards([original, moved]).select("data_version", "n_strata", r("between_block_variance"))


@register
def a31_refit_diagonal_summary(spark, sf):
    packed = rec.permuted(rec.pack(segment_rows(spark, sf), COH, PRIOR, keys=SEG), 100, 3)
    model, fitted = subject_fits(packed, "hmm", [START], ONCE, False, 1e-3, "simulation", ([[i] for i in range(3)], list(range(3))))
    refits = keyed.table(fitted, model, ["subject_id"])
    out = cmp.refit_diagonal_summary(refits, version_fits(spark, sf, "original"), ["subject_id"])
    return out.select("subject_id", *rr("sim_mean_diag", "sim_q025", "sim_q975", "observed_diag", "fraction_ge_observed", places=5))


# ---- resampling


@register
def b1_bootstrap_diff(spark, sf):
    out = rs.bootstrap_diff(seq_scores(spark, sf), MODELS[0], MODELS[1:], draws=200)
    cols = ["observed_delta_ll_per_trial", "ci_low", "ci_high", "bootstrap_mean", "bootstrap_sd", "p_delta_le_0"]
    return out.select("model", "baseline", "n_sequences", *rr(*cols))


@register
def b2_bootstrap_ll(spark, sf):
    out = rs.bootstrap_ll(seq_scores(spark, sf).filter("model = 'static_hmm'"), ["fold", *SEQ], draws=200)
    return out.select(*rr(*out.columns))


def subject_bootstrap(spark, sf):
    d = deltas(spark, sf).filter("data_version = 'original'")
    return rs.bootstrap_subjects(d, [f"hmm_minus_{b}" for b in BASELINES], draws=500)


@register
def b3_bootstrap_subjects(spark, sf):
    out = subject_bootstrap(spark, sf)
    return out.select("comparison", "subjects_positive", *rr("mean_subject_delta", "ci_low", "ci_high"))


@register
def p9_equivalence_flags(spark, sf):
    out = cmp.equivalence_flags(subject_bootstrap(spark, sf))
    return out.select("comparison", "equivalent", "clearly_positive", "clearly_negative")


@register
def b4_effect_intervals(spark, sf):
    packed, keyset = covariate_chain(spark, sf)
    return rs.effect_intervals(packed, keyset, X, draws=200).drop("fit_key")


@register
def b4_effect_intervals_folds(spark, sf):
    """Intervals of the covariate effects of every fit that leaves a fold out, each fit run until it is flat."""
    df = tt.transition_covariates(with_folds(spark, sf))
    packed = rec.pack(df, COH, PRIOR, carry=("fold",), arrays=X)
    start = cv.start_model("covariate_hmm", MAIN, cv.fold_keys(None, OTHERS, LABELS), COH, PRIOR, sc.fold_scalers(df))
    fits = em.fit_covariate_hmm(packed, start, UNTIL_FLAT, X, "fold")
    fitted = em.model_from([f.params for f in fits], start.keys, COH, PRIOR, ["pi", "B"])
    fitted.extra.update({k: start.extra[k] for k in ("mean", "sd")})
    out = rs.effect_intervals(packed, fitted.keyset(), X, draws=200, fold="fold")
    return out.withColumnRenamed("fit_key", "held_out_fold")


@register
def j10_attach_intervals(spark, sf):
    """Effects of each subject next to the interval of the same effect over subjects."""
    from arcseq.operators.checks import attach_intervals
    from arcseq.plans.models import subject_coefficients

    keys = ["covariate", "previous_state", "next_state"]
    point = sc.covariate_effects(subject_coefficients(spark, sf), ["subject_id"])
    ci = exact_quantiles(point, keys, F.col("delta_plus_minus"), {"ci_low": 0.025, "ci_high": 0.975}, 1e-4)
    out = attach_intervals(point, ci, keys)
    return out.select("subject_id", *keys, *rr("delta_plus_minus", "ci_low", "ci_high"))


@register
def b5_permutation_distribution(spark, sf):
    """Three matched permutations scored by the frozen parameters of each fold; the plan is the same for any number."""
    packed = rec.exchanged(segments(spark, sf), COH, PRIOR, STRATA, SEG, 500, 3)
    ll = union_shards([rec.sequence_ll(part, fold_keyset(), fold="fold", by=["simulation"]) for part in rec.in_parts(packed)])
    out = ll.groupBy("simulation").agg(F.sum("n").alias("n_trials"), F.sum("ll").alias("total_ll"))
    return out.select("simulation", "n_trials", r("total_ll", "total_ll", 4), r(F.col("total_ll") / F.col("n_trials"), "ll_per_trial"))


def version_packed(spark, sf):
    """Segments packed in their own order and in every permuted one, by `kind`."""
    pack = lambda rows: rec.pack(rows, COH, PRIOR, keys=SEG, carry=("fold",))
    content = ["error", "prior_error", "cos_s", "cos_p"]
    crossed = sp.permute_cross_subject(segments(spark, sf), ["fold", "prior_std", "motion_coherence", "motion_direction"], content)
    original = pack(segment_rows(spark, sf))
    kinds = {
        "original": original,
        "within": rec.permuted(original, 7),
        "matched": rec.exchanged(segments(spark, sf), COH, PRIOR, STRATA, SEG, 11),
        "cross_subject": pack(crossed.withColumn("pos", F.col("seg_pos"))),
    }
    named = [rec.Packed(p.df.withColumn("kind", F.lit(kind)), p.coh, p.prior, p.long, p.keys) for kind, p in kinds.items()]
    return rec.union(named, ["kind", *SEG], ("fold",))


@register
def b6_permutation_refit(spark, sf):
    """Held-out LL of the chain refitted on every kind of permuted data, each fit run until it is flat. The kind is part of the
    key: one job an iteration fits them all."""
    packed = version_packed(spark, sf)
    by = ["kind", "subject_id"]
    res = cv.keyed_cv(packed, ["hmm"], [START], packed.df.select(*by).distinct(), OTHERS, LABELS, UNTIL_FLAT, by=by)
    out = res.groupBy("kind").agg(F.sum("n_test").alias("n_trials"), F.sum("test_ll").alias("total_ll"), F.min("converged").alias("converged"))
    return out.withColumn("ll_per_trial", F.col("total_ll") / F.col("n_trials"))


@register
def b9_chronological_eval(spark, sf):
    """Earlier blocks predict later ones: four models, four expanding windows, each fit run until it is flat."""
    epochs = sp.block_epochs(tt.sequences(features(spark, sf)))
    df = sp.attach_folds(segment_rows(spark, sf).drop("fold"), epochs, ["epoch"])
    train = [[e for e in range(k)] for k in range(1, 5)]
    models = ["prior_conditioned_iid", "exchangeable_block_mixture", "hmm", "block_plus_markov"]
    packed = rec.pack(df, COH, PRIOR, keys=SEG, carry=("epoch",))
    res = cv.keyed_cv(packed, models, [START], subjects(packed.df), train, [1, 2, 3, 4], UNTIL_FLAT, fold="epoch", label="split_id")
    out = res.groupBy("model").agg(
        F.sum("n_test").alias("n"), F.sum("test_ll").alias("ll"), F.sum(F.col("converged").cast("long")).alias("converged")
    )
    return out.withColumn("ll_per_trial", F.col("ll") / F.col("n"))
