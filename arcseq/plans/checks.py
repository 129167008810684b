"""Registered queries: replicate checks with and without decoded-state filtering, set operations on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from arcseq.columns import CHUNK, SEQ
from arcseq.operators import checks as ck
from arcseq.operators import recursions as rec
from arcseq.operators import scoring as sc
from arcseq.operators import trial_table as tt
from arcseq.operators.conditions import CONDITION, METRICS, condition_metrics, metrics_of_many, response_histograms
from arcseq.plans.fixed import COH, MAIN, PRIOR
from arcseq.plans.workspace import features, r, rr
from arcseq.session import staged_once

QUERIES = {}
N_REP = 4
#: Replicates of `p8_covered`, as many as the reference draws: an interval of 95 % needs more than N_REP.
N_COVERED = 100
SIM_KEYS = ["simulation", *SEQ]
SUMMARY = [*ck.SOURCE, *CONDITION]


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


#: What is kept of a replicate's row; angles and agreements follow from it.
COLUMNS = ["row_id", *SEQ, "trial_index", CHUNK, "pos", "motion_direction", "motion_coherence", "prior_std", "prior_mean", "estimate_deg"]
#: Columns that travel with a decoded row.
CARRIED = ("trial_index", "motion_direction", "motion_coherence", "prior_std", "prior_mean", "estimate_deg")


def combined(spark, sf):
    """Observed rows and permuted replicates of all trials."""

    def build():
        feat = features(spark, sf).select(*COLUMNS)
        reps = ck.permuted_replicates(feat, N_REP)
        return ck.union_sources(feat, reps.select("simulation", *COLUMNS))

    return ck.responded(staged_once(spark, ("replicates", sf), build))


def covered_metrics(spark, sf):
    """Metrics of the observed rows and of N_COVERED replicates of all trials. Replicates are made from packed sequences where
    these lie, whenever they are read; none is written or shuffled."""

    def build():
        feat = features(spark, sf).select(*[c for c in COLUMNS if c not in ("trial_index", CHUNK)])
        # a named number, as adaptive plans would gather the small sequences in few tasks before they become many replicates
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        reps = ck.permuted_replicates(feat.repartition(tasks, *SEQ), N_COVERED)
        own = [*CONDITION, "error", "prior_error"]
        return metrics_of_many(ck.union_sources(ck.responded(feat).select(*own), reps.select("simulation", *own)), SUMMARY)

    return staged_once(spark, ("covered_metrics", sf), build)


def decoded(spark, sf):
    """Every data set decoded with smoothed marginals under the same chain."""

    def build():
        packed = rec.pack(combined(spark, sf), COH, PRIOR, keys=SIM_KEYS, arrays=CARRIED, keep=False)
        post = rec.chain_scores(packed, rec.one_key(MAIN, COH, PRIOR), smooth=True, carry=CARRIED)
        rows = sc.state_map(post, rec.SMOOTH, "decoded_state").withColumn("trial_index", F.col("trial_index").cast("long"))
        source = F.when(F.col("simulation") < 0, "observed").otherwise("simulated").alias("source")
        return rows.select(source, "simulation", *COLUMNS, "decoded_state")

    return ck.responded(staged_once(spark, ("decoded", sf), build))


def summary_rows(spark, sf, kind):
    return combined(spark, sf) if kind == "all" else decoded(spark, sf).filter(F.col("decoded_state") != "lapse")


def metrics_table(spark, sf, kind="all"):
    return staged_once(spark, (f"metrics_{kind}", sf), lambda: condition_metrics(summary_rows(spark, sf, kind), SUMMARY))


def histogram_table(spark, sf, kind="all"):
    return staged_once(spark, (f"hist_{kind}", sf), lambda: response_histograms(summary_rows(spark, sf, kind), SUMMARY))


@register
def u1_union_sources(spark, sf):
    feat = features(spark, sf)
    sim = feat.select("row_id", "estimate_deg", F.lit(0).alias("simulation"), F.lit("sensory").alias("state"))
    out = ck.union_sources(feat.select("row_id", "estimate_deg", "reaction_time"), sim)
    return out.select("source", "simulation", "row_id", "state", *rr("estimate_deg", "reaction_time"))


@register
def b7_metrics(spark, sf):
    out = metrics_table(spark, sf)
    return out.select("source", "simulation", *rr(*CONDITION), "n", *rr(*METRICS))


@register
def b7_histograms(spark, sf):
    out = histogram_table(spark, sf)
    return out.select("source", "simulation", *rr(*CONDITION), "reference", "bin_left_deg", "bin_right_deg", "count", r("proportion"))


@register
def j9_join_observed(spark, sf):
    out = ck.join_observed(metrics_table(spark, sf))
    return out.select("simulation", *rr(*CONDITION), *rr(*METRICS, *[f"observed_{m}" for m in METRICS]))


INTERVAL = ["observed", "simulated_mean", "simulated_ci_low", "simulated_ci_high"]


@register
def a19_metric_intervals(spark, sf):
    out = ck.metric_intervals(metrics_table(spark, sf))
    return out.select(*rr(*CONDITION), "condition", "metric", *rr(*INTERVAL, "observed_minus_simulated"))


@register
def a20_histogram_intervals(spark, sf):
    out = ck.histogram_intervals(histogram_table(spark, sf))
    return out.select(*rr(*CONDITION), "reference", *rr("bin_left_deg", "bin_right_deg", "bin_center_deg"), *rr(*INTERVAL))


def rounded_intervals(metrics):
    out = ck.metric_intervals(metrics)
    return out.withColumns({c: F.round(c, 9) for c in INTERVAL})


@register
def p8_covered(spark, sf):
    out = ck.covered(rounded_intervals(covered_metrics(spark, sf)))
    return out.select(*rr(*CONDITION), "metric", "covered")


@register
def a18_coverage(spark, sf):
    out = ck.coverage(rounded_intervals(metrics_table(spark, sf)), "static_hmm")
    return out.select("model", "metric", "cells", "covered", r("coverage_rate"))


@register
def a21_coverage_change(spark, sf):
    before, after = (ck.coverage(rounded_intervals(metrics_table(spark, sf, k)), "static_hmm") for k in ("all", "kept"))
    return ck.coverage_change(before, after)


@register
def b8_metrics(spark, sf):
    out = metrics_table(spark, sf, "kept")
    return out.select("source", "simulation", *rr(*CONDITION), "n", *rr(*METRICS))


@register
def b8_decoded_states(spark, sf):
    return decoded(spark, sf).select("source", "simulation", "row_id", "decoded_state")


@register
def a16_retention(spark, sf):
    out = ck.retention(decoded(spark, sf))
    return out.select("source", "simulation", *rr(*CONDITION), "decoded_state", "n", "condition_n", r("fraction_of_condition"), "retained")


@register
def a16_retention_summary(spark, sf):
    out = ck.retention_summary(ck.retention(decoded(spark, sf)))
    ints = ["observed_total_n", "observed_retained_n"]
    return out.select(*rr(*CONDITION), *ints, *rr(*[c for c in out.columns if c not in (*CONDITION, *ints)]))


@register
def a17_confusion(spark, sf):
    """State decoded from the observed response against the one decoded from each replicate."""
    d = decoded(spark, sf)
    given = d.filter("source = 'observed'").select("row_id", F.col("decoded_state").alias("generating_state"))
    pairs = d.filter("source = 'simulated'").join(given, "row_id")
    out = ck.confusion(pairs, ["simulation"])
    return out.select("simulation", "generating_state", "decoded_state", "n", "generating_state_n", r("fraction_within_generating_state"))


@register
def u2_missing_cells(spark, sf):
    """Cells of subject x direction x prior width without a row decoded as prior."""
    d = decoded(spark, sf)
    return ck.missing_cells(d, d.filter("decoded_state = 'prior' AND source = 'observed'"), ["subject_id", "motion_direction", "prior_std"])


def all_runs(spark, sf):
    runs = tt.run_lengths(decoded(spark, sf), "decoded_state", SIM_KEYS)
    return runs.withColumnRenamed("decoded_state", "state").withColumn(
        "source", F.when(F.col("simulation") < 0, "observed").otherwise("simulated")
    )


@register
def a22_run_length_summary(spark, sf):
    out = ck.run_length_summary(all_runs(spark, sf), ["source", "state"])
    return out.select("source", "state", "n_runs", *rr("mean_run_length", "median_run_length", "q90_run_length"))


@register
def a23_run_length_calibration(spark, sf):
    out = ck.run_length_calibration(all_runs(spark, sf))
    return out.select("state", "metric", *rr(*INTERVAL))


