"""Set-based model scores: every trial is scored from its own row and, at most, its predecessor."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcseq.columns import CHUNK, COVARIATES, LOG_TWO_PI, PAIRS, SEQ, STATES, TRANSITIONS
from arcseq.functions import circular as C
from arcseq.operators.ordered import per_chunk, running, same_keys
from arcseq.operators.params import Params, attach_params, values_table
from arcseq.operators.trial_table import X_COLS

LOG_B = [f"emission_log_density_{s}" for s in STATES]
PRED = [f"predictive_p_{s}" for s in STATES]
FILT = [f"filtered_p_{s}" for s in STATES]


def add(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def emissions(df: DataFrame, params: Params, center: Column | None = None) -> DataFrame:
    """Log densities of the three components; `center` replaces the stimulus as sensory centre."""
    df = attach_params(df, params)
    cos_s = F.col("cos_s") if center is None else F.cos(C.circ_diff(F.col("y"), center))
    return df.withColumns(
        {
            LOG_B[0]: C.log_vonmises(cos_s, F.col("kappa_s"), F.col("norm_s")),
            LOG_B[1]: C.log_vonmises(F.col("cos_p"), F.col("kappa_p"), F.col("norm_p")),
            LOG_B[2]: C.dbl(-LOG_TWO_PI),
        }
    )


def _mix(df: DataFrame, weights: list[Column]) -> DataFrame:
    """Predictive weights, filtered probabilities and trial LL of a three-component mixture."""
    df = df.withColumns(dict(zip(PRED, weights)))
    joint = [F.log(F.greatest(F.col(p), C.dbl(1e-300))) + F.col(b) for p, b in zip(PRED, LOG_B)]
    return df.withColumns({**dict(zip(FILT, C.softmax(joint))), "trial_ll": C.logsumexp(joint)})


def score_mixture(df: DataFrame, params: Params) -> DataFrame:
    return _mix(emissions(df, params), [C.dbl(float(w)) for w in params.weights])


def score_serial(df: DataFrame, params: Params, mode: str = "both") -> DataFrame:
    """Sensory centre pulled by the previous stimulus and/or response (needs serial_theta, serial_y)."""
    a_stim = params.alpha_stim if mode in ("stimulus", "both") else 0.0
    a_resp = params.alpha_resp if mode in ("response", "both") else 0.0
    shift = C.dbl(a_stim) * C.circ_diff(F.col("serial_theta"), F.col("theta")) + C.dbl(a_resp) * C.circ_diff(
        F.col("serial_y"), F.col("theta")
    )
    df = df.withColumn("serial_shift", shift).withColumn("sensory_center", C.wrap_rad(F.col("theta") + F.col("serial_shift")))
    return _mix(emissions(df, params, F.col("sensory_center")), [C.dbl(float(w)) for w in params.weights])


def score_conditioned(df: DataFrame, params: Params) -> DataFrame:
    """Component weights looked up by prior width."""
    rows = [(float(k), *map(float, w)) for k, w in params.condition_weights.items()]
    table = values_table(df.sparkSession, ["prior_std", "__w0", "__w1", "__w2"], rows)
    df = emissions(df, params).join(F.broadcast(table), "prior_std")
    return _mix(df, [F.col(f"__w{i}") for i in range(3)]).drop("__w0", "__w1", "__w2")


def state_map(df: DataFrame, cols: list[str] = FILT, out: str = "state_map_filtered") -> DataFrame:
    return df.withColumn(out, C.argmax_state([F.col(c) for c in cols]))


def cumulative_ll(scores: DataFrame, keys: list[str] = SEQ, order: str = "pos") -> DataFrame:
    """Running LL within the sequence and the sequence total."""
    out = running(scores, keys, [CHUNK], [order], {"sequence_cumulative_ll": ("sum", F.col("trial_ll"))})
    totals = scores.groupBy(*keys).agg(F.sum("trial_ll").alias("sequence_ll"), F.collect_set(CHUNK).alias("chunks"))
    return same_keys(out, per_chunk(totals), [*keys, CHUNK])


def predictive_moments(df: DataFrame) -> DataFrame:
    """Circular mean, resultant length and SD of the predictive mixture."""
    center = F.col("sensory_center") if "sensory_center" in df.columns else F.col("theta")
    s, p = F.col(PRED[0]) * F.col("resultant_s"), F.col(PRED[1]) * F.col("resultant_p")
    x = s * F.cos(center) + p * F.cos("mu")
    y = s * F.sin(center) + p * F.sin("mu")
    df = df.withColumns({"__x": x, "__y": y})
    length = F.least(F.sqrt(F.col("__x") * F.col("__x") + F.col("__y") * F.col("__y")), C.dbl(1))
    df = df.withColumn("predictive_resultant_length", length)
    rl = F.col("predictive_resultant_length")
    return df.withColumns(
        {
            "predictive_circular_mean_deg": F.when(rl >= 1e-15, C.rad2deg(F.atan2("__y", "__x"))),
            "predictive_circular_sd_deg": F.degrees(F.sqrt(F.greatest(-2 * F.log(F.greatest(rl, C.dbl(1e-300))), C.dbl(0)))),
        }
    ).drop("__x", "__y")


def score_frame(scored: DataFrame) -> DataFrame:
    """The export columns that all model families share."""
    out = cumulative_ll(predictive_moments(state_map(scored)))
    more = {"trial_density": F.exp("trial_ll")}
    for s, b, p in zip(STATES, LOG_B, PRED):
        more[f"emission_density_{s}"] = F.exp(b)
        more[f"state_log_contribution_{s}"] = F.log(F.greatest(F.col(p), C.dbl(1e-300))) + F.col(b)
    return out.withColumns(more)


# ------------------------------------------------------------------------------------------------
# covariate transitions


def fit_scaler(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean and population SD of every covariate (SD below 1e-12 becomes 1)."""
    aggs = []
    for c in X_COLS:
        sd = F.stddev_pop(c)
        aggs += [F.avg(c).alias(f"mean_{c}"), F.when(sd < 1e-12, C.dbl(1)).otherwise(sd).alias(f"sd_{c}")]
    return df.groupBy(*(keys or [])).agg(*aggs)


def fold_scalers(df: DataFrame, folds: int = 4) -> DataFrame:
    """One scaler per fold from the sequences outside it, without reading the data once per fold."""
    sums = df.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m_{c}") for c in X_COLS],
        *[F.var_pop(c).alias(f"v_{c}") for c in X_COLS],
    )
    pairs = sums.withColumnRenamed("fold", "source").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    other = pairs.filter(F.col("source") != F.col("fold"))
    aggs = []
    for c in X_COLS:
        mean = F.sum(F.col("n") * F.col(f"m_{c}")) / F.sum("n")
        square = F.sum(F.col("n") * (F.col(f"v_{c}") + F.col(f"m_{c}") * F.col(f"m_{c}"))) / F.sum("n")
        sd = F.sqrt(F.greatest(square - mean * mean, C.dbl(0)))
        aggs += [mean.alias(f"mean_{c}"), F.when(sd < 1e-12, C.dbl(1)).otherwise(sd).alias(f"sd_{c}")]
    return other.groupBy("fold").agg(*aggs)


def apply_scaler(df: DataFrame, scaler: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Standardised columns z_*; the scaler has one row, or one per fold."""
    if on:
        df = df.join(F.broadcast(scaler), on)
    else:
        row = scaler.first()
        df = df.withColumns({c: C.dbl(float(row[c])) for c in scaler.columns})
    return df.withColumns(
        {f"z_{c}": (F.col(f"x_{c}") - F.col(f"mean_x_{c}")) / F.col(f"sd_x_{c}") for c in COVARIATES}
    ).drop(*[f"{k}_{c}" for k in ("mean", "sd") for c in X_COLS])


def transition_probs(df: DataFrame, B) -> DataFrame:
    """Nine transition probabilities into each trial from standardised covariates; null at starts."""
    B = np.asarray(B, dtype=float)
    z = [C.dbl(1)] + [F.col(f"z_{c}") for c in COVARIATES]
    out = {}
    for i, a in enumerate(STATES):
        logits = [add([C.dbl(float(v)) * x for v, x in zip(B[i, j], z)]) for j in range(3)]
        for t, p in zip(STATES, C.softmax(logits)):
            out[f"{a}_to_{t}"] = F.when(~F.col("is_start"), p)
    return df.withColumns(out)


def average_transition(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean transition matrix over all trials that are not starts."""
    return df.groupBy(*(keys or [])).agg(*[F.avg(t).alias(t) for t in TRANSITIONS])


def covariate_effects(coefficients: DataFrame, keys: list[str]) -> DataFrame:
    """Transition probability at +1 SD and -1 SD of each covariate.

    `coefficients` is long: keys, previous_state, next_state, covariate, coefficient.
    """
    base = coefficients.filter(F.col("covariate") == "intercept").select(
        *keys, "previous_state", "next_state", F.col("coefficient").alias("b0")
    )
    slopes = coefficients.filter(F.col("covariate") != "intercept")
    cells = slopes.join(base, [*keys, "previous_state", "next_state"])
    rows = cells.groupBy(*keys, "covariate", "previous_state").agg(
        *[
            F.max(F.when(F.col("next_state") == s, F.col("b0") + sign * F.col("coefficient"))).alias(f"{tag}_{s}")
            for s in STATES
            for tag, sign in (("lo", -1), ("hi", 1))
        ]
    )
    low = C.softmax([F.col(f"lo_{s}") for s in STATES])
    high = C.softmax([F.col(f"hi_{s}") for s in STATES])
    parts = [x for s, lo, hi in zip(STATES, low, high) for x in (F.lit(s), lo, hi)]
    out = rows.select(
        *keys,
        "covariate",
        "previous_state",
        F.stack(F.lit(3), *parts).alias("next_state", "prob_at_minus_1sd", "prob_at_plus_1sd"),
    )
    return out.withColumn("delta_plus_minus", F.col("prob_at_plus_1sd") - F.col("prob_at_minus_1sd"))


def stationary(df: DataFrame) -> DataFrame:
    """Stationary distribution of each row's transition matrix by the cofactors of I - A."""
    a = {t: F.col(t) for t in TRANSITIONS}

    def m(i: int, j: int) -> Column:
        return (1.0 if i == j else 0.0) - a[f"{STATES[i]}_to_{STATES[j]}"]

    minors = []
    for i in range(3):
        u, v = [k for k in range(3) if k != i]
        minors.append(m(u, u) * m(v, v) - m(u, v) * m(v, u))
    clipped = [F.greatest(x, C.dbl(0)) for x in minors]
    total = add(clipped)
    return df.withColumns({f"stationary_{s}": F.try_divide(x, total) for s, x in zip(STATES, clipped)})


def persistence_excess(df: DataFrame, keys: list[str]) -> DataFrame:
    """Self-transition minus stationary probability, long over the sensory and prior states."""
    parts = []
    for s in STATES[:2]:
        stay, base = F.col(f"{s}_to_{s}"), F.col(f"stationary_{s}")
        parts += [F.lit(s), stay, base, stay - base]
    return df.select(
        *keys, F.stack(F.lit(2), *parts).alias("state", "self_transition", "stationary_probability", "persistence_excess")
    )


def parameters_long(fits: DataFrame, keys: list[str]) -> DataFrame:
    """Wide fits to (parameter_group, parameter, level_1, level_2, value)."""
    items = []
    for c in fits.columns:
        if c.startswith("weight_"):
            items.append(("component_weights", "weight", c[7:], "", c))
        elif c.startswith("pi_"):
            items.append(("initial_probabilities", "pi", c[3:], "", c))
        elif c in TRANSITIONS:
            one, two = PAIRS[TRANSITIONS.index(c)]
            items.append(("transition_matrix", "A", one, two, c))
        elif c.startswith("kappa_s_"):
            items.append(("emission_concentrations", "sensory_kappa", f"coherence_{c[8:]}", "", c))
        elif c.startswith("kappa_p_"):
            items.append(("emission_concentrations", "prior_kappa", f"prior_std_{c[8:]}", "", c))
    parts = [x for g, p, one, two, c in items for x in (F.lit(g), F.lit(p), F.lit(one), F.lit(two), F.col(c))]
    names = ("parameter_group", "parameter", "level_1", "level_2", "value")
    return fits.select(*keys, F.stack(F.lit(len(items)), *parts).alias(*names))


# ------------------------------------------------------------------------------------------------
# block mixture


def _block_logs(df: DataFrame, params: Params) -> DataFrame:
    return _class_logs(emissions(df, params), params)


def _class_logs(df: DataFrame, params: Params) -> DataFrame:
    """Log density of a trial under each class, from its emissions."""
    out = {}
    for c, w in enumerate(params.class_weights):
        out[f"mix_{c}"] = C.logsumexp([C.dbl(float(np.log(x))) + F.col(b) for x, b in zip(w, LOG_B)])
    return df.withColumns(out)


def score_block(df: DataFrame, params: Params, keys: list[str], order: str = "pos") -> DataFrame:
    """Causal block-mixture scores: class weights use past trials only, so prefix sums replace recursion."""
    df = _block_logs(df, params)
    n = range(len(params.rho))
    df = running(df, keys, [CHUNK], [order], {f"past_{c}": ("sum", F.col(f"mix_{c}")) for c in n}, inclusive=False)
    logs = [C.dbl(float(np.log(params.rho[c]))) + F.coalesce(F.col(f"past_{c}"), C.dbl(0)) for c in n]
    df = df.withColumns({f"tau_{c}": t for c, t in enumerate(C.softmax(logs))})
    weights = [add([F.col(f"tau_{c}") * C.dbl(float(params.class_weights[c][s])) for c in n]) for s in range(3)]
    return _mix(df, weights)


def mixture_sums(df: DataFrame, params: Params, keys: list[str]) -> DataFrame:
    """LL of each block under the three mixtures, in one pass and one aggregate: n_test and a column for each model.

    The LLs of a block's trials under the causal block mixture telescope to that of the whole block (`block_posterior`).
    """
    df = _class_logs(score_conditioned(df, params).withColumnRenamed("trial_ll", "conditioned"), params)
    n = range(len(params.rho))
    alone = C.logsumexp([C.dbl(float(np.log(w))) + F.col(b) for w, b in zip(params.weights, LOG_B)])
    sums = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_test"), F.sum(alone).alias("subject_iid"), F.sum("conditioned").alias("prior_conditioned_iid"),
        *[F.sum(f"mix_{c}").alias(f"__s{c}") for c in n],
    )
    logs = [C.dbl(float(np.log(params.rho[c]))) + F.col(f"__s{c}") for c in n]
    return sums.select(*keys, "n_test", "subject_iid", "prior_conditioned_iid", C.logsumexp(logs).alias("exchangeable_block_mixture"))


def block_posterior(df: DataFrame, params: Params, keys: list[str]) -> DataFrame:
    """Class posterior of each block from all its trials."""
    n = range(len(params.rho))
    sums = _block_logs(df, params).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trials"), F.collect_set(CHUNK).alias("chunks"), *[F.sum(f"mix_{c}").alias(f"s_{c}") for c in n]
    )
    logs = [C.dbl(float(np.log(params.rho[c]))) + F.col(f"s_{c}") for c in n]
    return sums.select(
        *keys, "n_trials", "chunks", C.logsumexp(logs).alias("block_ll"), *[t.alias(f"tau_{c}") for c, t in enumerate(C.softmax(logs))]
    )


def block_responsibilities(df: DataFrame, params: Params, keys: list[str]) -> DataFrame:
    """Trial state posteriors averaged over the block's class posterior."""
    post = per_chunk(block_posterior(df, params, keys).drop("n_trials", "block_ll"))
    joined = same_keys(emissions(df, params), post, [*keys, CHUNK])
    parts = []
    for c, w in enumerate(params.class_weights):
        parts.append(C.softmax([C.dbl(float(np.log(x))) + F.col(b) for x, b in zip(w, LOG_B)]))
    return joined.withColumns(
        {f"p_{s}": add([F.col(f"tau_{c}") * p[i] for c, p in enumerate(parts)]) for i, s in enumerate(STATES)}
    )


def serial_terms(df: DataFrame, params: Params, by: tuple = ()) -> DataFrame:
    """What the serial likelihood needs of a trial at any coefficients."""
    return attach_params(df, params).select(
        *by, "y", "theta", "cos_p", "kappa_s", "norm_s", "kappa_p", "norm_p",
        C.circ_diff(F.col("serial_theta"), F.col("theta")).alias("ds"),
        C.circ_diff(F.col("serial_y"), F.col("theta")).alias("dr"),
    )


def terms_profile(terms: DataFrame, params: Params, grid: list[tuple[float, float]], by: tuple = ()) -> DataFrame:
    """Total LL of `serial_terms` (for each group of `by`) at every (alpha_stim, alpha_resp) of the grid."""
    points = F.array(*[F.struct(C.dbl(a).alias("alpha_stim"), C.dbl(b).alias("alpha_resp")) for a, b in grid])
    base = terms.withColumn("g", F.explode(points))
    center = F.col("theta") + F.col("g.alpha_stim") * F.col("ds") + F.col("g.alpha_resp") * F.col("dr")
    log_w = [float(np.log(w)) for w in params.weights]
    logs = [
        C.dbl(log_w[0]) + F.col("kappa_s") * F.cos(F.col("y") - center) - F.col("norm_s"),
        C.dbl(log_w[1]) + F.col("kappa_p") * F.col("cos_p") - F.col("norm_p"),
        C.dbl(log_w[2] - LOG_TWO_PI),
    ]
    return base.groupBy(*by, F.col("g.alpha_stim").alias("alpha_stim"), F.col("g.alpha_resp").alias("alpha_resp")).agg(
        F.sum(C.logsumexp(logs)).alias("ll"), F.count(F.lit(1)).alias("n")
    )


def serial_profile(df: DataFrame, params: Params, grid: list[tuple[float, float]], by: tuple = ()) -> DataFrame:
    """Total LL (for each group of `by`) at every (alpha_stim, alpha_resp) of the grid at fixed weights and concentrations.

    The grid is expanded inside each task and summed map-side; one row per group and grid point is shuffled.
    """
    return terms_profile(serial_terms(df, params, by), params, grid, by)


def best_point(profile: DataFrame) -> DataFrame:
    """Grid point of the largest LL (ties to the smaller coefficients)."""
    order = F.struct("ll", (-F.col("alpha_stim")).alias("a"), (-F.col("alpha_resp")).alias("b"))
    return profile.agg(
        F.max_by("alpha_stim", order).alias("alpha_stim"), F.max_by("alpha_resp", order).alias("alpha_resp"), F.max("ll").alias("ll")
    )
