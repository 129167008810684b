"""Bootstrap, permutation distributions and refits on permuted data."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcseq.columns import COVARIATES, SEQ, STATES
from arcseq.functions.hashing import as_int, digest
from arcseq.operators.em import centred_rows, curvature_sum, free_rows, logit_moments
from arcseq.operators.kernels import segment_sum, softmax_rows
from arcseq.operators.ordered import rank_in_group
from arcseq.operators.recursions import Batch, KeySet, Packed, entry_exit, read_borders, run_kernel
from arcseq.session import stage



def paired_differences(scores: DataFrame, baseline: str) -> DataFrame:
    """LL difference to the baseline and length, one row per (fold, sequence, model)."""
    base = scores.filter(F.col("model") == baseline).select("fold", *SEQ, F.col("test_ll").alias("b"))
    rest = scores.filter(F.col("model") != baseline)
    return rest.join(base, ["fold", *SEQ]).select("fold", *SEQ, "model", (F.col("test_ll") - F.col("b")).alias("x"), "n_test")


def _indexed_draws(units: DataFrame, order: list[str], values: list[str], n: int, draws: int, seed: int) -> DataFrame:
    """Sums of `values` per draw; unit k of draw b is md5(seed, b, k) mod n."""
    spark = units.sparkSession
    keyed = units.withColumns({"__all": F.lit(0), "__h": digest("unit", *[F.col(c) for c in order])})
    ranked = rank_in_group(keyed, ["__all"], ["__h"], F.substring("__h", 1, 3), "__r")
    ranked = ranked.select((F.col("__r") - 1).alias("i"), *values)
    picks = spark.range(n * draws).select(F.floor(F.col("id") / n).alias("draw"), (F.col("id") % n).alias("k"))
    picks = picks.select("draw", F.pmod(as_int(digest(seed, F.col("draw"), F.col("k"))), F.lit(n)).alias("i"))
    # equal picks are merged before the join
    counted = picks.groupBy("draw", "i").agg(F.count(F.lit(1)).alias("c"))
    return counted.join(ranked, "i").groupBy("draw").agg(*[F.sum(F.col("c") * F.col(v)).alias(v) for v in values])


def resample(units: DataFrame, order: list[str], values: list[str], draws: int, seed: int) -> DataFrame:
    """Sums of the values over n units drawn with replacement, one row per draw; one sampler for every size."""
    return _indexed_draws(units, order, values, units.count(), draws, seed)


def _interval(stat: str) -> list:
    return [
        F.percentile(stat, F.lit(0.025)).alias("ci_low"),
        F.percentile(stat, F.lit(0.975)).alias("ci_high"),
        F.avg(stat).alias("bootstrap_mean"),
        F.stddev_samp(stat).alias("bootstrap_sd"),
    ]


def bootstrap_diff(scores: DataFrame, baseline: str, models: list[str], draws: int, seed: int = 42) -> DataFrame:
    """Cluster bootstrap of the LL difference per trial; all models share the drawn sequences."""
    diffs = paired_differences(scores, baseline)
    wide = diffs.groupBy("fold", *SEQ).pivot("model", models).agg(F.first("x"))
    wide = wide.join(diffs.groupBy("fold", *SEQ).agg(F.first("n_test").alias("n_test")), ["fold", *SEQ])
    sums = resample(wide, ["fold", *SEQ], [*models, "n_test"], draws, seed)
    long = sums.unpivot(["draw", "n_test"], models, "model", "x").withColumn("stat", F.col("x") / F.col("n_test"))
    boot = long.groupBy("model").agg(*_interval("stat"), F.avg((F.col("stat") <= 0).cast("double")).alias("p_delta_le_0"))
    observed = diffs.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_sequences"), (F.sum("x") / F.sum("n_test")).alias("observed_delta_ll_per_trial")
    )
    return observed.join(boot, "model").withColumn("baseline", F.lit(baseline))


def bootstrap_ll(scores: DataFrame, keys: list[str], draws: int, seed: int = 43) -> DataFrame:
    """Cluster bootstrap of the absolute LL per trial."""
    sums = resample(scores, keys, ["test_ll", "n_test"], draws, seed)
    stat = sums.withColumn("stat", F.col("test_ll") / F.col("n_test"))
    return stat.agg(
        F.percentile("stat", F.lit(0.025)).alias("bootstrap_ci_low"),
        F.percentile("stat", F.lit(0.975)).alias("bootstrap_ci_high"),
        F.stddev_samp("stat").alias("bootstrap_standard_error"),
    )


def bootstrap_subjects(deltas: DataFrame, comparisons: list[str], draws: int, seed: int = 44) -> DataFrame:
    """Bootstrap over subjects of the mean delta of each named comparison."""
    wide = deltas.groupBy("subject_id").pivot("comparison", comparisons).agg(F.first("delta")).withColumn("one", F.lit(1.0))
    sums = resample(wide, ["subject_id"], [*comparisons, "one"], draws, seed)
    long = sums.unpivot(["draw", "one"], comparisons, "comparison", "x").withColumn("stat", F.col("x") / F.col("one"))
    boot = long.groupBy("comparison").agg(*_interval("stat")[:2])
    point = deltas.groupBy("comparison").agg(
        F.avg("delta").alias("mean_subject_delta"), F.sum((F.col("delta") > 0).cast("long")).alias("subjects_positive")
    )
    return point.join(boot, "comparison")


def normals(units: np.ndarray, draws: int) -> np.ndarray:
    """Standard normal numbers (draws, units) from the 64-bit hash of each unit: two mixed counters a draw, then Box-Muller."""
    counter = np.arange(1, 2 * draws + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    z = units.astype(np.int64).view(np.uint64)[None, :] + counter
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    u = (((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53
    return np.sqrt(-2 * np.log(u[:draws])) * np.cos(2 * math.pi * u[draws:])


def _lists(m: np.ndarray) -> pa.Array:
    m = np.ascontiguousarray(m.reshape(len(m), -1))
    return pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(pa.float64()))


def _matrix(column) -> np.ndarray:
    return np.asarray(column.values.to_numpy(zero_copy_only=False)).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _total(name: str, size: int) -> Column:
    return F.array(*[F.sum(F.get(name, F.lit(i))) for i in range(size)]).alias(name)


def transition_scores(packed: Packed, keyset: KeySet, x_cols: tuple, fold: str | None = None) -> DataFrame:
    """n and score (gradient of the transition logits) of every chunk under every fit it belongs to, and the curvature, which is
    only summed by fit, once for each fit and batch (null in the batch's other rows)."""
    v = free_rows(keyset.B)

    def fn(b: Batch):
        chain = b.chain()
        pi = keyset.pi[b.key]
        pre, suf, _ = read_borders(b)
        entry, leave = entry_exit(b, pi, pre, suf)
        _, filt, scale, _ = chain.forward(b.start(chain, pi, entry))
        xi = chain.xi(filt, chain.backward(scale, leave), entry, b.rg.starts[b.fresh])
        xi[b.rg.starts[b.fresh]] = 0.0
        x = b.design()
        size = v[0].size
        score, curvature = np.zeros((len(x), size)), [None] * len(b.piece)
        for key in np.unique(b.key):
            rows = np.flatnonzero(b.row_key == key)
            _, _, excess, covariance = logit_moments(x[rows], xi[rows], v[key])
            score[rows] = -(excess[..., None] * x[rows][:, None, None, :]).reshape(len(rows), -1)
            curvature[np.flatnonzero(b.key == key)[0]] = curvature_sum(x[rows], covariance).ravel()
        take = pa.array(b.piece)
        arrays = [*[b.column(k).take(take) for k in SEQ], pa.array(np.asarray(b.key, dtype=np.int64)), pa.array(b.rg.lens)]
        return [*SEQ, "fit_key", "n", "score", "curvature"], [*arrays, _lists(segment_sum(score, b.rg)), pa.array(curvature, pa.list_(pa.float64()))]

    schema = "subject_id bigint, session_id bigint, run_id bigint, fit_key bigint, n bigint, score array<double>, curvature array<double>"
    return run_kernel(packed, keyset, fn, schema, x_cols, fold)


def multiplied_scores(units: DataFrame, means: np.ndarray, draws: int) -> DataFrame:
    """(fit_key, draw, score): sums of multiplier x centred score. A task multiplies the matrix (draws, units of a batch)
    with its scores and hands on one row for each fit and draw; units need `unit` (a 64-bit hash), fit_key and score."""

    def run(batches):
        for batch in batches:
            key = batch.column("fit_key").to_numpy()
            unit, score = batch.column("unit").to_numpy(), _matrix(batch.column("score"))
            for k in np.unique(key):
                own = key == k
                sums = normals(unit[own], draws) @ (score[own] - means[k])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(draws, k)), pa.array(np.arange(draws)), _lists(sums)], ["fit_key", "draw", "score"])

    partial = units.select("unit", "fit_key", "score").mapInArrow(run, "fit_key bigint, draw bigint, score array<double>")
    return partial.groupBy("fit_key", "draw").agg(_total("score", means.shape[1]))


def effect_intervals(
    packed: Packed, keyset: KeySet, x_cols: tuple, draws: int = 200, seed: int = 42, l2: float = 1.0, fold: str | None = None
) -> DataFrame:
    """Multiplier bootstrap over sequences of the +-1 SD covariate effects of every fit, posteriors held fixed.

    A draw moves the transition coefficients of a fit by one Newton step of the score that its normal multipliers give.
    All fits share the multipliers of a sequence. Only one curvature and one mean score for each fit reach the driver.
    """
    v = free_rows(keyset.B)
    size, inner = v[0].size, v.shape[2]
    chunks = stage(transition_scores(packed, keyset, x_cols, fold), "transition-scores")
    curvature = np.zeros((len(v), v.shape[1], inner, inner))
    for r in chunks.groupBy("fit_key").agg(_total("curvature", size * inner)).collect():  # one row for each fit
        curvature[r["fit_key"]] = np.reshape(r["curvature"], curvature.shape[1:])
    units = chunks.groupBy(*SEQ, "fit_key").agg(F.sum("n").alias("n"), _total("score", size)).filter("n > 1")
    units = stage(units.withColumn("unit", F.xxhash64(F.lit(seed), *SEQ)), "transition-units")
    means, n_units = np.zeros((len(v), size)), np.zeros(len(v), dtype=int)
    for r in units.groupBy("fit_key").agg(F.count(F.lit(1)).alias("n"), _total("score", size)).collect():  # one row for each fit
        n_units[r["fit_key"]], means[r["fit_key"]] = r["n"], np.array(r["score"]) / r["n"]
    width = keyset.B[0].shape[-1]
    names = [(c, i, j) for c in range(len(COVARIATES)) for i in range(len(STATES)) for j in range(len(STATES))]

    def moved(batches):
        for batch in batches:
            key = batch.column("fit_key").to_numpy()
            pull = _matrix(batch.column("score")).reshape(len(key), *v.shape[1:])
            drawn = np.zeros((len(key), len(names)))
            for k in np.unique(key):
                own = key == k
                step = np.linalg.solve(curvature[k] + l2 * np.eye(inner), np.moveaxis(pull[own], 0, -1))
                effects = _effects(centred_rows(v[k] + np.moveaxis(step, -1, 0), width))
                drawn[own] = np.stack([effects[:, i, j, c] for c, i, j in names], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("fit_key"), _lists(drawn)], ["fit_key", "stats"])

    stats = multiplied_scores(units, means, draws).mapInArrow(moved, "fit_key bigint, stats array<double>")
    stats = stats.select("fit_key", F.posexplode("stats").alias("place", "stat"))
    boot = stats.groupBy("fit_key", "place").agg(*_interval("stat"), F.avg((F.col("stat") <= 0).cast("double")).alias("p_effect_le_0"))
    keys = ["fit_key", "place"]
    point = [_effects(b) for b in keyset.B]
    observed = [
        (f, k, COVARIATES[c], STATES[i], STATES[j], float(point[f][i, j, c]), int(n_units[f])) for f in range(len(v)) for k, (c, i, j) in enumerate(names)
    ]
    told = "fit_key bigint, place int, covariate string, previous_state string, next_state string, delta_plus_minus double, n_sequences bigint"
    two_sided = 2 * F.least(F.col("p_effect_le_0"), 1 - F.col("p_effect_le_0"))
    out = packed.df.sparkSession.createDataFrame(observed, told).join(boot, keys).withColumn("p_two_sided", two_sided)
    return out.orderBy(*keys).drop("place")


def _effects(B):
    """P(+1 SD) - P(-1 SD) per row of coefficients (..., 3, covariates) for each covariate."""
    base, slope = B[..., :1], B[..., 1:]
    high = softmax_rows(np.swapaxes(base + slope, -1, -2))
    low = softmax_rows(np.swapaxes(base - slope, -1, -2))
    return np.swapaxes(high - low, -1, -2)
