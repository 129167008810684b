"""Summaries and joins over fits, scores and versions of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcseq.columns import SEQ, STATES, TRANSITIONS
from arcseq.functions import circular as C
from arcseq.operators.quantiles import exact_quantiles


def top_effects(effects: DataFrame, k: int = 6, keys: list[str] | None = None) -> DataFrame:
    """Largest covariate effects on staying in a state, by absolute size."""
    stay = effects.filter(F.col("previous_state") == F.col("next_state")).withColumn("abs_delta", F.abs("delta_plus_minus"))
    order = [F.desc("abs_delta"), F.asc("covariate"), F.asc("previous_state")]
    if not keys:
        return stay.orderBy(*order).limit(k)
    w = Window.partitionBy(*keys).orderBy(*order)
    return stay.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).drop("__r")


def seq_scores(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Total and per-trial LL of each sequence."""
    out = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_test"), F.sum("trial_ll").alias("test_ll"))
    return out.withColumn("test_ll_per_trial", F.col("test_ll") / F.col("n_test"))


def cv_results(scores: DataFrame) -> DataFrame:
    """One row per model and fold."""
    out = scores.groupBy("model", "fold").agg(F.sum("n_test").alias("n_test"), F.sum("test_ll").alias("test_ll"))
    return out.withColumn("test_ll_per_trial", F.col("test_ll") / F.col("n_test"))


def summarise_cv(cv: DataFrame) -> DataFrame:
    """Mean, standard error and distance from the best model over folds (a handful of rows per model)."""
    out = cv.groupBy("model").agg(
        F.countDistinct("fold").alias("folds"),
        F.avg("test_ll_per_trial").alias("mean_test_ll_per_trial"),
        (F.stddev_samp("test_ll_per_trial") / F.sqrt(F.count(F.lit(1)))).alias("se_test_ll_per_trial"),
        F.avg("test_ll").alias("mean_test_ll"),
    )
    best = F.max("mean_test_ll_per_trial").over(Window.partitionBy())
    return out.withColumn("delta_from_best_per_trial", F.col("mean_test_ll_per_trial") - best)


def heldout_summary(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Trial-weighted LL and perplexity by any grouping."""
    out = scores.groupBy(*keys).agg(F.sum("n_test").alias("n_trials"), F.sum("test_ll").alias("total_ll"))
    out = out.withColumn("ll_per_trial", F.col("total_ll") / F.col("n_trials"))
    return out.withColumn("perplexity", C.perplexity(F.col("ll_per_trial")))


# Free parameters beyond the emission concentrations, K = 3 states and 7 transition columns.
PARAMETERS = {
    "independent_switching": 2,
    "serial_stimulus": 3,
    "serial_response": 3,
    "serial_both": 4,
    "static_hmm": 8,
    "covariate_hmm": 44,
    "subject_iid": 2,
    "prior_conditioned_iid": 8,
    "exchangeable_block_mixture": 8,
    "hmm": 8,
    "block_plus_markov": 26,
}


def parameter_count(model: Column, n_coherence: int, n_prior: int) -> Column:
    base = F.lit(None).cast("long")
    for name, k in PARAMETERS.items():
        base = F.when(model == name, F.lit(k + n_coherence + n_prior).cast("long")).otherwise(base)
    return base


def information_criteria(fits: DataFrame, n_coherence: int, n_prior: int) -> DataFrame:
    """AIC and BIC per fit row (model, n_trials, log_likelihood)."""
    k, ll = F.col("n_parameters"), F.col("log_likelihood")
    return fits.withColumn("n_parameters", parameter_count(F.col("model"), n_coherence, n_prior)).withColumns(
        {"aic": 2 * k - 2 * ll, "bic": F.log(F.col("n_trials").cast("double")) * k - 2 * ll}
    )


def pooled_criteria(rows: DataFrame) -> DataFrame:
    """Sums over subjects, the pooled BIC and the distance of each from its best model."""
    out = rows.groupBy("model").agg(
        F.countDistinct("subject_id").alias("n_subjects"),
        F.sum("n_trials").alias("n_trials"),
        F.sum("log_likelihood").alias("total_log_likelihood"),
        F.sum("n_parameters").alias("total_parameters"),
        F.sum("aic").alias("aic_sum"),
        F.sum("bic").alias("bic_sum_subjectwise"),
    )
    out = out.withColumn(
        "bic_pooled",
        -2 * F.col("total_log_likelihood") + F.col("total_parameters") * F.log(F.col("n_trials").cast("double")),
    )
    every = Window.partitionBy()
    pairs = {"aic_delta_from_best": "aic_sum", "bic_subjectwise_delta_from_best": "bic_sum_subjectwise", "bic_pooled_delta_from_best": "bic_pooled"}
    return out.withColumns({n: F.col(c) - F.min(c).over(every) for n, c in pairs.items()})


def group_summary(fits: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, SD and SE of every parameter over fits, one row per parameter."""
    long = fits.unpivot([], columns, "parameter", "value")
    return long.groupBy("parameter").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd_between_subjects"),
        (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("se"),
    )


def state_weights(post: DataFrame, keys: list[str], prefix: str = "p_") -> DataFrame:
    return post.groupBy(*keys).agg(*[F.avg(f"{prefix}{s}").alias(f"{s}_weight") for s in STATES])


def best_fit(fits: DataFrame, keys: list[str], ll: str = "train_ll", seed: str = "seed") -> DataFrame:
    """Fit of the largest LL per group, ties to the smallest seed."""
    w = Window.partitionBy(*keys).orderBy(F.desc(ll), F.asc(seed))
    return fits.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") == 1).drop("__r")


def restart_diagnostics(fits: DataFrame, keys: list[str]) -> DataFrame:
    """Distance of every restart from the best of its group, and the selected one."""
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy(F.desc("train_ll"), F.asc("seed")))
    return fits.withColumns(
        {"delta_from_best": F.col("train_ll") - F.max("train_ll").over(w), "selected": rank == 1}
    )


def restart_summary(fits: DataFrame, keys: list[str]) -> DataFrame:
    order = F.struct("train_ll", (-F.col("seed")).alias("s"))
    out = fits.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_restarts"),
        F.sum(F.col("converged").cast("long")).alias("n_converged"),
        F.max("train_ll").alias("best_train_ll"),
        F.min("train_ll").alias("worst_train_ll"),
        F.max_by("seed", order).alias("selected_seed"),
        F.max_by("n_iter", order).alias("selected_n_iter"),
    )
    return out.withColumn("ll_range", F.col("best_train_ll") - F.col("worst_train_ll"))


def init_sensitivity(fits: DataFrame, keys: list[str]) -> DataFrame:
    """Range of LL per trial and mean self-transition over starting points."""
    diag = sum(F.col(f"{s}_to_{s}") for s in STATES) / 3
    rows = fits.withColumns({"__ll": F.col("train_ll") / F.col("n_trials"), "__d": diag})
    return rows.groupBy(*keys).agg(
        (F.max("__ll") - F.min("__ll")).alias("ll_range"),
        (F.max("__d") - F.min("__d")).alias("diag_range"),
        F.max("__ll").alias("best_ll"),
    )


def refit_diagonal_summary(refits: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Mean self-transition over refits of replicates against the observed one (few replicates per key)."""
    diag = sum(F.col(f"{s}_to_{s}") for s in STATES) / 3
    obs = observed.select(*keys, diag.alias("observed_diag"))
    rows = refits.select(*keys, diag.alias("d")).join(obs, keys)
    return rows.groupBy(*keys).agg(
        F.avg("d").alias("sim_mean_diag"),
        F.percentile("d", F.lit(0.025)).alias("sim_q025"),
        F.percentile("d", F.lit(0.975)).alias("sim_q975"),
        F.first("observed_diag").alias("observed_diag"),
        F.avg((F.col("d") >= F.col("observed_diag")).cast("double")).alias("fraction_ge_observed"),
    )


def matrix_metrics(fits: DataFrame) -> DataFrame:
    """Mean self-transition and mean row entropy of each transition matrix."""
    entropy = sum(-F.col(t) * F.log(F.greatest(F.col(t), C.dbl(1e-300))) for t in TRANSITIONS) / 3
    return fits.withColumns(
        {
            "mean_diagonal_transition": sum(F.col(f"{s}_to_{s}") for s in STATES) / 3,
            "transition_entropy": entropy,
        }
    )


def compare_versions(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], names=("original", "shuffled")) -> DataFrame:
    """Wide comparison of two versions with deltas (a - b)."""
    left = a.select(*keys, *[F.col(v).alias(f"{names[0]}_{v}") for v in values])
    right = b.select(*keys, *[F.col(v).alias(f"{names[1]}_{v}") for v in values])
    joined = left.join(right, keys)
    return joined.withColumns({f"delta_{v}": F.col(f"{names[0]}_{v}") - F.col(f"{names[1]}_{v}") for v in values})


def frobenius(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distance between the transition matrices of paired fits."""
    wide = compare_versions(a, b, keys, TRANSITIONS)
    total = sum(F.col(f"delta_{t}") * F.col(f"delta_{t}") for t in TRANSITIONS)
    return wide.select(*keys, F.sqrt(total).alias("frobenius_distance"))


def gain_decomposition(overall: DataFrame, target: str = "hmm") -> DataFrame:
    """Gain of the target over each baseline in both versions and their difference (few rows)."""
    wide = overall.groupBy("model").pivot("data_version", ["original", "shuffled"]).agg(F.first("ll_per_trial"))
    hit = wide.filter(F.col("model") == target).select(F.col("original").alias("to"), F.col("shuffled").alias("ts"), F.lit(1).alias("__one"))
    rest = wide.filter(F.col("model") != target).withColumn("__one", F.lit(1)).join(hit, "__one")
    return rest.select(
        F.col("model").alias("baseline"),
        F.col("original").alias("baseline_ll_per_trial"),
        (F.col("to") - F.col("original")).alias("hmm_original_gain"),
        (F.col("ts") - F.col("shuffled")).alias("hmm_shuffled_gain"),
        ((F.col("to") - F.col("original")) - (F.col("ts") - F.col("shuffled"))).alias("order_specific_difference_in_differences"),
    )


def order_invariance(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Largest fold difference between versions; models without order memory show none."""
    folds = scores.groupBy("model", *keys).pivot("data_version", ["original", "shuffled"]).agg(F.sum("test_ll"))
    d = F.col("original") - F.col("shuffled")
    return folds.groupBy("model").agg(
        F.max(F.abs(d)).alias("max_abs_fold_total_ll_difference"),
        F.sum(d).alias("overall_total_ll_difference"),
        (F.max(F.abs(d)) < 1e-7).alias("order_invariant_pass"),
    )


def subject_deltas(subject: DataFrame, target: str, baselines: list[str]) -> DataFrame:
    """Per subject and version: target minus every baseline, long."""
    wide = subject.groupBy("subject_id", "data_version").pivot("model", [target, *baselines]).agg(F.first("ll_per_trial"))
    parts = [x for b in baselines for x in (F.lit(f"{target}_minus_{b}"), F.col(target) - F.col(b))]
    return wide.select("subject_id", "data_version", F.stack(F.lit(len(baselines)), *parts).alias("comparison", "delta"))


def winner_counts(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("data_version", "comparison").agg(
        F.avg("delta").alias("mean_subject_delta"),
        F.sum((F.col("delta") > 0).cast("long")).alias("subjects_better"),
        F.sum((F.col("delta") < 0).cast("long")).alias("subjects_baseline_better"),
        F.min("delta").alias("min_delta"),
        F.max("delta").alias("max_delta"),
    )


def between_block_variance(rows: DataFrame, strata: list[str], block: str = "block_id") -> DataFrame:
    """Variance of the block means of cos(response error) - cos(prior error), averaged over strata."""
    means = rows.groupBy(*strata, block).agg(F.avg(F.col("cos_s") - F.col("cos_p")).alias("m"))
    var = means.groupBy(*strata).agg(F.var_samp("m").alias("v"))
    return var.agg(F.avg("v").alias("between_block_variance"), F.count("v").alias("n_strata"))


def dwell_switch(paths: DataFrame, runs: DataFrame, state: str, subject: str = "subject_id", seq: list[str] = SEQ) -> DataFrame:
    """Switch rate and mean dwell time per subject from the run lengths of its sequences."""
    per_seq = runs.groupBy(*seq).agg(F.count(F.lit(1)).alias("r"), F.sum("run_length").alias("n"))
    rates = per_seq.groupBy(subject).agg(F.try_divide(F.sum(F.col("r") - 1).cast("double"), F.sum(F.col("n") - 1)).alias("switch_rate"))
    dwell = runs.groupBy(subject).agg(
        F.avg("run_length").alias("mean_state_dwell_time"),
        *[F.avg(F.when(F.col(state) == s, F.col("run_length"))).alias(f"mean_{s}_dwell_time") for s in STATES],
    )
    return rates.join(dwell, subject)


def equivalence_flags(table: DataFrame, sesoi: float = 0.005) -> DataFrame:
    """Whether an interval lies inside, above or below the smallest effect of interest."""
    return table.withColumns(
        {
            "equivalent": (F.col("ci_low") > -sesoi) & (F.col("ci_high") < sesoi),
            "clearly_positive": F.col("ci_low") > sesoi,
            "clearly_negative": F.col("ci_high") < -sesoi,
        }
    )


def fit_qc(fits: DataFrame, history: DataFrame, keys: list[str], tolerance: float = 1e-8, floor: float = 1e-6) -> DataFrame:
    """Convergence and numeric flags per fit (one history row per iteration)."""
    w = Window.partitionBy(*keys).orderBy("iteration")
    steps = history.withColumn("__d", F.col("log_likelihood") - F.lag("log_likelihood").over(w))
    drops = steps.groupBy(*keys).agg(
        F.greatest(-F.min("__d"), C.dbl(0)).alias("maximum_drop"),
        F.max((F.isnan("log_likelihood") | F.abs("log_likelihood").isin(float("inf"))).cast("int")).alias("__bad"),
    )
    lowest = F.least(*[F.col(t) for t in TRANSITIONS])
    weights = [F.col(f"{s}_weight") for s in STATES]
    return fits.join(drops, keys).select(
        *keys,
        F.coalesce(F.col("maximum_drop"), C.dbl(0)).alias("maximum_drop"),
        (F.coalesce(F.col("maximum_drop"), C.dbl(0)) <= tolerance).alias("monotonic"),
        (F.col("__bad") == 1).alias("has_nan_or_inf"),
        (F.greatest(*weights) > 0.98).alias("state_collapse_flag"),
        (F.col("lapse_weight") < 0.005).alias("lapse_near_zero_flag"),
        (lowest <= floor).alias("transition_near_floor_flag"),
    )


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full-outer comparison of two tables that should match one to one."""
    left = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("na"), F.sum(value).alias("va"))
    right = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("nb"), F.sum(value).alias("vb"))
    joined = left.join(right, keys, "full")
    return joined.select(
        *keys,
        F.when(F.col("na").isNull(), "right_only").when(F.col("nb").isNull(), "left_only").otherwise("both").alias("match"),
        ((F.coalesce("na", F.lit(0)) > 1) | (F.coalesce("nb", F.lit(0)) > 1)).alias("duplicated"),
        F.abs(F.col("va") - F.col("vb")).alias("abs_difference"),
    )


def reconcile_summary(rec: DataFrame) -> DataFrame:
    return rec.agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.sum((F.col("match") == "both").cast("long")).alias("n_both"),
        F.sum(F.col("duplicated").cast("long")).alias("n_duplicated"),
        F.max("abs_difference").alias("max_abs_difference"),
    )


def verify_refit(new: DataFrame, old: DataFrame, keys: list[str], value: str, tolerance: float = 1e-8) -> DataFrame:
    """Refit values next to the stored ones with a match flag."""
    joined = new.select(*keys, value).join(old.select(*keys, F.col(value).alias(f"reference_{value}")), keys)
    diff = F.col(value) - F.col(f"reference_{value}")
    return joined.withColumns({"difference": diff, "matches": F.abs(diff) <= tolerance})


def compare_models(base: DataFrame, scores: DataFrame, models: list[str], baseline: str) -> DataFrame:
    """Row-wise LL of every model next to each other, with differences from the baseline."""
    wide = scores.groupBy("row_id").pivot("model", models).agg(F.first("trial_ll"))
    out = base.join(wide.withColumnsRenamed({m: f"{m}_ll" for m in models}), "row_id")
    return out.withColumns({f"{m}_delta": F.col(f"{m}_ll") - F.col(f"{baseline}_ll") for m in models})


def score_checks(scored: DataFrame, prefixes: dict[str, list[str]], start_null: list[str] | None = None) -> DataFrame:
    """Counts and largest deviations of a scored trial table: one row."""
    aggs = [
        F.count(F.lit(1)).alias("rows"),
        F.sum((F.isnan("trial_ll") | F.col("trial_ll").isNull() | F.abs("trial_ll").isin(float("inf"))).cast("long")).alias("not_finite"),
    ]
    for name, cols in prefixes.items():
        aggs.append(F.max(F.abs(sum(F.col(c) for c in cols) - 1)).alias(f"max_{name}_error"))
    for c in start_null or []:
        aggs.append(F.sum((F.col("is_start") & F.col(c).isNotNull()).cast("long")).alias(f"{c}_set_at_start"))
    # duplicates are found by grouping, not by one distinct set over all rows
    per_row = scored.groupBy("row_id").agg(F.count(F.lit(1)).alias("k"))
    once = per_row.agg(F.count(F.lit(1)).alias("unique_trials"), F.sum((F.col("k") > 1).cast("long")).alias("scored_more_than_once"))
    one = F.lit(1).alias("__one")
    return scored.agg(*aggs).select(one, "*").join(once.select(one, "*"), "__one").drop("__one")


def representative(scores: DataFrame, model: str, baseline: str) -> DataFrame:
    """Sequence whose model gain per trial is nearest to the median gain."""
    wide = scores.groupBy(*SEQ).pivot("model", [model, baseline]).agg(F.first("test_ll_per_trial"))
    wide = wide.withColumn("delta", F.col(model) - F.col(baseline))
    median = exact_quantiles(wide, [], F.col("delta"), {"median_delta": 0.5}, width=0.05)
    one = F.lit(1).alias("__one")
    rows = wide.select(one, *SEQ, "delta").join(F.broadcast(median.select(one, "*")), "__one").drop("__one")  # one row
    # one row survives map-side per task, so nothing is sorted
    key = F.struct(F.abs(F.col("delta") - F.col("median_delta")).alias("d"), *SEQ)
    return rows.agg(F.min_by(F.struct(*SEQ, "delta", "median_delta"), key).alias("r")).select("r.*")


