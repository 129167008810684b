"""Registered queries: model scores on trials, chain recursions and decoded states."""

from __future__ import annotations

from pyspark.sql import functions as F

from arcseq.columns import COVARIATES, SEQ, STATES, TRANSITIONS
from arcseq.functions import circular as C
from arcseq.operators import conditions as cond
from arcseq.operators import grids
from arcseq.operators import recursions as rec
from arcseq.operators import scoring as sc
from arcseq.operators import trial_table as tt
from arcseq.operators.params import attach_params
from arcseq.plans import fixed
from arcseq.plans.fixed import COH, MAIN, PRIOR, START
from arcseq.plans.workspace import features, folds, r, rr, segments
from arcseq.session import new_path
from arcseq.sources import trials as src

QUERIES = {}
X = tuple(tt.X_COLS)


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def with_folds(spark, sf):
    from arcseq.operators.splits import attach_folds

    return attach_folds(features(spark, sf), folds(spark, sf))


def chain(spark, sf, params=MAIN):
    packed = rec.pack(features(spark, sf), COH, PRIOR)
    return packed, rec.one_key(params, COH, PRIOR)


def scaler_of(df):
    row = sc.fit_scaler(df).first()
    return [(row[f"mean_{c}"], row[f"sd_{c}"]) for c in X]


def covariate_chain(spark, sf, df=None):
    feat = tt.transition_covariates(features(spark, sf)) if df is None else df
    packed = rec.pack(feat, COH, PRIOR, arrays=X)
    params = MAIN
    return packed, rec.one_key(params, COH, PRIOR, scaler_of(feat))


def segment_rows(spark, sf, shuffled=False):
    """Segments as sequences: `pos` is the position in the segment, in the original or permuted order."""
    from arcseq.operators.splits import permute_within

    keys = [*SEQ, "segment_number"]
    df = segments(spark, sf)
    if shuffled:
        df = permute_within(df, keys).withColumn("pos", F.col("shuffle_order"))
        return tt.chunked(df, "pos")
    return df.withColumn("pos", F.col("seg_pos"))


SEG = [*SEQ, "segment_number"]


@register
def j1_attach_params(spark, sf):
    return attach_params(features(spark, sf), MAIN).select("row_id", *rr("kappa_s", "kappa_p", "norm_s", "norm_p"))


@register
def f4_log_vonmises(spark, sf):
    df = sc.emissions(features(spark, sf), MAIN)
    return df.select("row_id", r(sc.LOG_B[0], "log_density"))


@register
def m1_emissions(spark, sf):
    return sc.emissions(features(spark, sf), MAIN).select("row_id", *rr(*sc.LOG_B))


FRAME = [
    *sc.LOG_B, *[f"emission_density_{s}" for s in STATES], *[f"state_log_contribution_{s}" for s in STATES], *sc.PRED, *sc.FILT,
    "trial_ll", "trial_density", "sequence_cumulative_ll", "sequence_ll", "predictive_circular_mean_deg",
    "predictive_resultant_length", "predictive_circular_sd_deg",
]


@register
def m2_score_mixture(spark, sf):
    out = sc.score_frame(sc.score_mixture(features(spark, sf), MAIN))
    return out.select("row_id", "state_map_filtered", *rr(*FRAME))


@register
def m3_score_serial_stimulus(spark, sf):
    df = sc.score_serial(tt.serial_previous(features(spark, sf)), MAIN, "stimulus")
    return df.select("row_id", r(F.degrees("serial_shift"), "shift_deg"), *rr(*sc.FILT, "trial_ll"))


@register
def m3_score_serial_response(spark, sf):
    df = sc.score_serial(tt.serial_previous(features(spark, sf)), MAIN, "response")
    return df.select("row_id", r(F.degrees("serial_shift"), "shift_deg"), *rr(*sc.FILT, "trial_ll"))


@register
def m3_score_serial_both(spark, sf):
    df = sc.score_serial(tt.serial_previous(features(spark, sf)), MAIN, "both")
    return df.select("row_id", r(F.degrees("serial_shift"), "shift_deg"), *rr(*sc.FILT, "trial_ll"))


@register
def m4_score_conditioned(spark, sf):
    return sc.score_conditioned(features(spark, sf), MAIN).select("row_id", *rr(*sc.PRED, *sc.FILT, "trial_ll"))


@register
def m5_predictive_moments(spark, sf):
    df = sc.predictive_moments(sc.score_serial(tt.serial_previous(features(spark, sf)), MAIN, "both"))
    return df.select("row_id", *rr("predictive_circular_mean_deg", "predictive_resultant_length", "predictive_circular_sd_deg"))


@register
def f7_softmax_logsumexp(spark, sf):
    df = sc.emissions(features(spark, sf), MAIN)
    cols = [F.col(c) for c in sc.LOG_B]
    return df.select("row_id", r(C.logsumexp(cols), "total"), *[r(p, f"p_{s}") for s, p in zip(STATES, C.softmax(cols))])


@register
def f8_ratios_and_run_lengths(spark, sf):
    a = sc.score_mixture(features(spark, sf), MAIN).groupBy("subject_id").agg(
        F.avg("trial_ll").alias("ll"), F.avg(F.col(sc.FILT[0])).alias("p")
    )
    return a.select(
        "subject_id",
        r(C.density_ratio(F.col("ll") + 1), "density_ratio"),
        r(C.perplexity(F.col("ll")), "perplexity"),
        r(C.geometric_run(F.col("p")), "run_length"),
        C.geometric_run(F.round(F.col("p"))).isin(float("inf")).alias("never_ends"),
    )


@register
def f13_argmax_state(spark, sf):
    return sc.state_map(sc.score_mixture(features(spark, sf), MAIN)).select("row_id", "state_map_filtered")


@register
def w6_cumulative_ll(spark, sf):
    out = sc.cumulative_ll(sc.score_mixture(features(spark, sf), MAIN))
    return out.select("row_id", *rr("sequence_cumulative_ll", "sequence_ll"))


def mapped(spark, sf):
    return sc.state_map(sc.score_mixture(features(spark, sf), MAIN), out="state")


@register
def w7_run_lengths(spark, sf):
    return tt.run_lengths(mapped(spark, sf), "state", SEQ)


@register
def w8_share_within(spark, sf):
    counts = mapped(spark, sf).groupBy("subject_id", "state").agg(F.count(F.lit(1)).alias("n"))
    return tt.share_within(counts, "n", ["subject_id"], "subject_n", "share").select("subject_id", "state", "n", "subject_n", r("share"))


@register
def p7_exclude_state(spark, sf):
    return mapped(spark, sf).filter(F.col("state") != "lapse").select("row_id", "state")


@register
def a7_occupancy(spark, sf):
    df = sc.score_mixture(features(spark, sf), MAIN).withColumnsRenamed({f"filtered_p_{s}": f"p_{s}" for s in STATES})
    out = cond.occupancy(df)
    return out.select(*rr("motion_coherence", "prior_std"), "conflict_bin", "n", *rr(*[f"p_{s}" for s in STATES], "mean_conflict_deg"))


@register
def a8_state_share(spark, sf):
    return cond.state_share(mapped(spark, sf)).select("subject_id", "state", "n_trials", "total_trials", r("proportion"))


@register
def m11_transition_probs(spark, sf):
    cov = tt.transition_covariates(features(spark, sf))
    out = sc.transition_probs(sc.apply_scaler(cov, sc.fit_scaler(cov)), MAIN.B)
    return out.select("row_id", *rr(*TRANSITIONS))


@register
def m12_average_transition(spark, sf):
    cov = tt.transition_covariates(features(spark, sf))
    out = sc.average_transition(sc.transition_probs(sc.apply_scaler(cov, sc.fit_scaler(cov)), MAIN.B))
    return out.select(*rr(*TRANSITIONS))


@register
def m13_fold_scaler(spark, sf):
    cov = tt.transition_covariates(with_folds(spark, sf))
    out = sc.apply_scaler(cov, sc.fold_scalers(cov), ["fold"])
    return out.select("row_id", "fold", *rr(*[f"z_{c}" for c in COVARIATES]))


def subject_coefficients(spark, sf):
    """Transition coefficients per subject: log mean transition as intercept, fixed slopes."""
    cov = tt.transition_covariates(features(spark, sf))
    avg = sc.average_transition(sc.transition_probs(sc.apply_scaler(cov, sc.fit_scaler(cov)), MAIN.B), ["subject_id"])
    parts = []
    for i, a in enumerate(STATES):
        for j, b in enumerate(STATES):
            parts += [F.lit(a), F.lit(b), F.lit("intercept"), F.log(f"{a}_to_{b}")]
            for p, name in enumerate(COVARIATES, 1):
                parts += [F.lit(a), F.lit(b), F.lit(name), F.lit(fixed.slope(i, j, p))]
    names = ("previous_state", "next_state", "covariate", "coefficient")
    return avg.select("subject_id", F.stack(F.lit(len(parts) // 4), *parts).alias(*names))


@register
def m9_covariate_effects(spark, sf):
    out = sc.covariate_effects(subject_coefficients(spark, sf), ["subject_id"])
    return out.select("subject_id", "covariate", "previous_state", "next_state", *rr("prob_at_minus_1sd", "prob_at_plus_1sd", "delta_plus_minus"))


@register
def t2_top_effects(spark, sf):
    from arcseq.operators.comparison import top_effects

    effects = sc.covariate_effects(subject_coefficients(spark, sf), ["subject_id"])
    out = top_effects(effects.withColumn("delta_plus_minus", F.round("delta_plus_minus", 9)), 6, ["subject_id"])
    return out.select("subject_id", "covariate", "previous_state", r("delta_plus_minus"))


@register
def h8_score_block(spark, sf):
    out = sc.score_block(segment_rows(spark, sf), START, SEG)
    return out.select("row_id", *rr("tau_0", "tau_1", "tau_2", *sc.PRED, *sc.FILT, "trial_ll"))


@register
def h9_block_posterior(spark, sf):
    out = sc.block_posterior(segment_rows(spark, sf), START, SEG)
    return out.select(*SEG, "n_trials", *rr("block_ll", "tau_0", "tau_1", "tau_2"))


@register
def h9_block_responsibilities(spark, sf):
    out = sc.block_responsibilities(segment_rows(spark, sf), START, SEG)
    return out.select("row_id", *rr(*[f"p_{s}" for s in STATES]))


@register
def h1_forward_filter(spark, sf):
    return rec.chain_scores(*chain(spark, sf)).select("row_id", *rr(*rec.PRED, *rec.FILT, "trial_ll"))


@register
def h2_sequence_ll(spark, sf):
    return rec.sequence_ll(*chain(spark, sf)).select(*SEQ, r("ll"), "n")


@register
def h3_smooth(spark, sf):
    out = sc.state_map(rec.chain_scores(*chain(spark, sf), smooth=True), rec.SMOOTH, "state_map_smoothed")
    return out.select("row_id", "state_map_smoothed", *rr(*rec.SMOOTH))


@register
def h4_pairwise(spark, sf):
    return rec.chain_scores(*chain(spark, sf), pairs=True).select("row_id", *rr(*rec.XI))


@register
def h5_covariate_filter(spark, sf):
    return rec.chain_scores(*covariate_chain(spark, sf), x_cols=X).select("row_id", *rr(*rec.PRED, *rec.FILT, "trial_ll"))


@register
def h5_covariate_smooth(spark, sf):
    out = rec.chain_scores(*covariate_chain(spark, sf), smooth=True, pairs=True, x_cols=X)
    return out.select("row_id", *rr(*rec.SMOOTH, *rec.XI))


@register
def h6_viterbi(spark, sf):
    return rec.viterbi(*chain(spark, sf)).select("row_id", "viterbi_state")


@register
def h10_score_hybrid(spark, sf):
    packed = rec.pack(segment_rows(spark, sf), COH, PRIOR, keys=SEG)
    out = rec.score_hybrid(packed, rec.one_key(START, COH, PRIOR))
    return out.select("row_id", *rr("tau_0", "tau_1", "tau_2", *rec.PRED, "trial_ll"))


def replicate_feature(spark, sf):
    """Responses mirrored at the prior mean: a replicate response column on the same trials."""
    feat = features(spark, sf)
    return feat.withColumn("replicate_deg", F.pmod(2 * F.col("prior_mean") - F.col("estimate_deg"), F.lit(360.0)))


@register
def h11_decode_static(spark, sf):
    from arcseq.operators.checks import with_response

    df = with_response(replicate_feature(spark, sf), "replicate_deg")
    packed = rec.pack(df, COH, PRIOR)
    out = sc.state_map(rec.chain_scores(packed, rec.one_key(MAIN, COH, PRIOR), smooth=True), rec.SMOOTH, "state_map")
    return out.select("row_id", "state_map", *rr(*rec.SMOOTH))


@register
def h11_decode_covariate(spark, sf):
    from arcseq.operators.checks import with_response

    scaler = scaler_of(tt.transition_covariates(features(spark, sf)))
    df = tt.transition_covariates(with_response(replicate_feature(spark, sf), "replicate_deg"))
    packed = rec.pack(df, COH, PRIOR, arrays=X)
    out = rec.chain_scores(packed, rec.one_key(MAIN, COH, PRIOR, scaler), smooth=True, x_cols=X)
    return out.select("row_id", *rr(*rec.SMOOTH))


@register
def e10_serial_profile(spark, sf):
    out = sc.serial_profile(tt.serial_previous(features(spark, sf)), MAIN, fixed.GRID)
    return out.select(*rr("alpha_stim", "alpha_resp"), r("ll", "ll", 4), "n")


@register
def e10_best_point(spark, sf):
    out = sc.best_point(sc.serial_profile(tt.serial_previous(features(spark, sf)), MAIN, fixed.GRID))
    return out.select(*rr("alpha_stim", "alpha_resp"), r("ll", "ll", 4))


@register
def s4_write_scores(spark, sf):
    feat = features(spark, sf)
    parts = [
        sc.score_mixture(feat, MAIN).select("row_id", "trial_ll", F.lit("independent_switching").alias("model_key")),
        sc.score_conditioned(feat, MAIN).select("row_id", "trial_ll", F.lit("prior_conditioned").alias("model_key")),
    ]
    scores = src.union_shards(parts).withColumn("fit_scope", F.lit("final"))
    path = new_path(spark, "scores")
    src.write_scores(scores, path)
    back = spark.read.parquet(path)
    return back.groupBy("fit_scope", "model_key").agg(F.count(F.lit(1)).alias("n"), F.sum("trial_ll").alias("ll")).select(
        "fit_scope", "model_key", "n", r("ll", "ll", 4)
    )


@register
def m6_bayes_grid_map(spark, sf):
    grid = grids.bayes_grid(cond.conditions(features(spark, sf)), fixed.OBSERVER, "map")
    return grid.select(*rr("motion_direction", "motion_coherence", "prior_std"), "g", r("p", "p", 9))


@register
def m6_bayes_grid_mean(spark, sf):
    grid = grids.bayes_grid(cond.conditions(features(spark, sf)), fixed.OBSERVER, "mean")
    return grid.select(*rr("motion_direction", "motion_coherence", "prior_std"), "g", r("p", "p", 9))


@register
def m6_bayes_grid_sample(spark, sf):
    grid = grids.bayes_grid(cond.conditions(features(spark, sf)), fixed.OBSERVER, "sample")
    return grid.select(*rr("motion_direction", "motion_coherence", "prior_std"), "g", r("p", "p", 9))


@register
def m7_switch_grid(spark, sf):
    grid = grids.switch_grid(cond.conditions(features(spark, sf)), fixed.OBSERVER)
    return grid.select(*rr("motion_direction", "motion_coherence", "prior_std"), "g", r("p", "p", 9))


@register
def m8_grid_loglik(spark, sf):
    feat = features(spark, sf)
    grid = grids.switch_grid(cond.conditions(feat), fixed.OBSERVER)
    return grids.grid_loglik(feat, grid).select("row_id", r("trial_ll"))


