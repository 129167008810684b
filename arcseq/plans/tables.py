"""Registered queries: scans, cleaning, windows, summaries and set operations on the trial table."""

from __future__ import annotations

from pyspark.sql import functions as F

from arcseq.columns import ORDER, SEQ
from arcseq.functions import circular as C
from arcseq.operators import conditions as cond
from arcseq.operators import splits as sp
from arcseq.operators import trial_table as tt
from arcseq.operators.ordered import previous
from arcseq.operators.params import params_from_json, params_to_json
from arcseq.plans.workspace import features, r, rr, segments, trials
from arcseq.session import new_path
from arcseq.sources import trials as src

QUERIES = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def s1_scan(spark, sf):
    ev = src.read_events(spark, sf)
    return ev.select(F.col("event_id").alias("row_id"), "user_id", "event_type", "value", F.dayofmonth("ts").alias("day"))


@register
def s1_row_numbers(spark, sf):
    ev = src.read_events(spark, sf).select("ts", "event_id", "value")
    return src.number_rows(ev, ["ts", "event_id"], F.date_format("ts", "yyyyMMddHHmm")).select("row_id", "event_id", r("value"))


@register
def s2_canonical_fields(spark, sf):
    aliased = trials(spark, sf).withColumnsRenamed(
        {"estimate_x": "resp_x", "estimate_y": "response_y", "motion_direction": "true_direction", "motion_coherence": "coherence",
         "prior_std": "prior_sd", "subject_id": "sub", "session_id": "sess", "run_id": "block", "trial_index": "trial"}
    )
    out = src.canonicalise(aliased)
    return out.select("row_id", *SEQ, ORDER, *rr("motion_direction", "motion_coherence", "prior_std", "prior_mean", "estimate_x", "estimate_y"))


@register
def s5_union_shards(spark, sf):
    t = trials(spark, sf)
    shards = [t.filter(F.col("run_id") == i).select("row_id", *SEQ, F.lit(i).cast("long").alias("shard")) for i in (1, 2)]
    rest = t.filter(F.col("run_id") > 2).select("row_id", *SEQ)
    return src.union_shards([*shards, rest])


@register
def s6_trials_from_events(spark, sf):
    t = src.trials_from_events(src.read_events(spark, sf))
    return t.select(
        "row_id", *SEQ, ORDER, "experiment_name", "experiment_id",
        *rr("trial_time", "response_arrow_start_angle", "motion_direction", "motion_coherence", "estimate_x", "estimate_y",
            "reaction_time", "raw_response_time", "prior_std", "prior_mean"),
    )


@register
def p1_usable_trials(spark, sf):
    return tt.usable_trials(trials(spark, sf)).select("row_id", *SEQ, ORDER)


@register
def p2_excluded_trials(spark, sf):
    return tt.excluded_trials(trials(spark, sf)).select("row_id", *SEQ, ORDER, "exclusion_reason")


@register
def p3_missing_report(spark, sf):
    return tt.missing_report(trials(spark, sf))


@register
def p4_trial_base(spark, sf):
    base = tt.trial_base(features(spark, sf))
    ints = ["raw_row_index", "analysis_row_index", "seq_id", *SEQ, "block_id", ORDER, "sequence_trial_index", "sequence_length",
            "experiment_id", "experiment_name", "is_sequence_start"]
    return base.select(*ints, *rr(*[c for c in base.columns if c not in ints]))


@register
def p5_prior_centred(spark, sf):
    return tt.prior_centred(tt.usable_trials(trials(spark, sf))).select("row_id", *rr("x_rad", "y_rad"))


@register
def p6_level_index(spark, sf):
    out = tt.level_index(features(spark, sf), ["motion_coherence", "prior_std", "subject_id"])
    return out.select("row_id", "motion_coherence_idx", "prior_std_idx", "subject_id_idx")


@register
def j2_attach_folds(spark, sf):
    folds = sp.stratified_folds(tt.sequences(features(spark, sf)))
    return sp.attach_folds(features(spark, sf), folds).select("row_id", "fold")


@register
def j3_attach_segments(spark, sf):
    t = trials(spark, sf)
    return sp.attach_segments(t.select("row_id", *SEQ, ORDER), tt.split_segments(t))


@register
def j4_rows_in_split(spark, sf):
    feat = features(spark, sf)
    splits = sp.chronological_splits(tt.sequences(feat))
    return sp.rows_in_split(feat, splits, 2, "test").select("row_id", *SEQ)


@register
def j7_complete_counts(spark, sf):
    feat = features(spark, sf).withColumn(
        "state", F.when(F.abs(F.col("error")) < 0.2, "sensory").when(F.abs(F.col("prior_error")) < 0.1, "prior").otherwise("lapse")
    )
    return cond.complete_counts(feat, {"motion_direction": None, "prior_std": None, "state": ["sensory", "prior", "lapse"]})


@register
def a1_sequences(spark, sf):
    return tt.sequences(features(spark, sf)).select(*SEQ, "n", r("prior_std"))


@register
def a2_dataset_summary(spark, sf):
    return cond.dataset_summary(trials(spark, sf), features(spark, sf))


@register
def a3_block_audit(spark, sf):
    return cond.block_audit(trials(spark, sf))


@register
def a3_block_table(spark, sf):
    return cond.block_table(trials(spark, sf))


@register
def a4_integrity_checks(spark, sf):
    # a second copy of some rows gives the duplicate check something to find
    t = trials(spark, sf)
    return cond.integrity_checks(t.unionByName(t.filter(F.col("row_id") % 50 == 0)))


@register
def a5_condition_metrics(spark, sf):
    out = cond.condition_metrics(features(spark, sf), cond.CONDITION)
    return out.select(*rr(*cond.CONDITION), "n", *rr("mean_signed_error_deg", *cond.METRICS))


@register
def a6_response_histograms(spark, sf):
    out = cond.response_histograms(features(spark, sf), cond.CONDITION)
    return out.select(*rr(*cond.CONDITION), "reference", *rr("bin_left_deg", "bin_right_deg", "bin_center_deg"), "count", r("proportion"))


@register
def w1_sequence_position(spark, sf):
    out = tt.sequence_position(tt.usable_trials(trials(spark, sf)))
    return out.select("row_id", "pos", "seq_len", "is_start")


@register
def w2_transition_covariates(spark, sf):
    return tt.transition_covariates(features(spark, sf)).select("row_id", *rr(*tt.X_COLS))


@register
def w3_serial_previous(spark, sf):
    return tt.serial_previous(features(spark, sf)).select("row_id", *rr("serial_theta", "serial_y"))


PREV = ["previous_motion_direction_deg", "previous_estimated_direction_deg", "previous_signed_stimulus_error_deg",
        "previous_absolute_stimulus_error_deg", "previous_stimulus_prior_conflict_deg", "previous_coherence"]


@register
def w4_previous_fields(spark, sf):
    return tt.previous_fields(features(spark, sf)).select("row_id", *rr(*PREV))


@register
def w5_split_segments(spark, sf):
    return tt.split_segments(trials(spark, sf)).select("row_id", "segment_number", "segment_id", "block_id")


@register
def w9_contiguity(spark, sf):
    return tt.contiguity(features(spark, sf)).select("row_id", "block_id", "global_trial", "is_block_start")


@register
def w9_non_contiguous_blocks(spark, sf):
    """Blocks that a subject enters more than once when its rows are taken in the order of the event log."""
    f = features(spark, sf).withColumns({"block_id": C.block_id(*[F.col(k) for k in SEQ]), "piece": F.floor(F.col("row_id") / 2048)})
    f = previous(f, ["subject_id"], ["piece"], ["row_id"], {"before": F.col("block_id")})
    f = f.withColumn("is_block_start", F.col("before").isNull() | (F.col("before") != F.col("block_id")))
    return tt.non_contiguous_blocks(f)


@register
def w10_stratified_folds(spark, sf):
    return sp.stratified_folds(tt.sequences(features(spark, sf))).select(*SEQ, "fold")


@register
def w11_subject_folds(spark, sf):
    return sp.group_folds(tt.sequences(features(spark, sf)), "subject_id").select(*SEQ, "fold")


@register
def w11_session_folds(spark, sf):
    return sp.group_folds(tt.sequences(features(spark, sf)), "session_id").select(*SEQ, "fold")


@register
def w11_prior_folds(spark, sf):
    return sp.group_folds(tt.sequences(features(spark, sf)), "prior_std").select(*SEQ, "fold")


@register
def w12_chronological_splits(spark, sf):
    return sp.chronological_splits(tt.sequences(features(spark, sf))).select(*SEQ, "split_id", "role")


def shuffled_segments(spark, sf):
    """Segments with agreements to both centres, and a permuted order inside each segment."""
    return sp.permute_within(segments(spark, sf), [*SEQ, "segment_number"])


@register
def w13_permute_within(spark, sf):
    return shuffled_segments(spark, sf).select("row_id", "segment_id", "seg_pos", "shuffle_order")


@register
def w13_shuffle_report(spark, sf):
    return sp.change_by_segment(shuffled_segments(spark, sf))


STRATA = ["subject_id", "fold", "prior_std"]


def exchanged(rows, strata, seed):
    slot = ["session_id", "run_id", "block_id", "segment_id", "segment_number", ORDER, "chunk", "seg_pos", "seg_len"]
    content = ["row_id", "motion_direction", "motion_coherence", "error", "prior_error", "cos_s", "cos_p"]
    return sp.permute_matched(rows, strata, slot, content, seed)


def matched(spark, sf, seed=11):
    return exchanged(segments(spark, sf), STRATA, seed)


@register
def w14_permute_matched(spark, sf):
    return matched(spark, sf).select("segment_id", ORDER, "row_id", "source_block_id", r("error"))


@register
def w14_changed_fraction(spark, sf):
    out = sp.changed_fraction(matched(spark, sf), STRATA)
    return out.select("subject_id", "fold", r("prior_std"), "n_trials", r("fraction_changed_block"))


CROSS = ["fold", "prior_std", "motion_coherence", "motion_direction"]


@register
def w15_permute_cross_subject(spark, sf):
    out = sp.permute_cross_subject(segments(spark, sf), CROSS, ["estimate_x", "estimate_y"])
    return out.select("row_id", "subject_id", "donor_subject_id", *rr("estimate_x", "estimate_y"))


@register
def t1_canonical_order(spark, sf):
    return trials(spark, sf).select("row_id", *SEQ, ORDER).orderBy(*SEQ, ORDER)


@register
def u3_same_membership(spark, sf):
    original = segments(spark, sf)
    return sp.same_membership(original, matched(spark, sf), ["row_id", "fold"])


@register
def u4_leakage(spark, sf):
    """Row-level folds leak whole blocks, sequence folds do not; both are counted."""
    feat = features(spark, sf)
    good = sp.stratified_folds(tt.sequences(feat)).select(*SEQ, "fold")
    by_row = feat.select(*SEQ, (F.col("row_id") % 4).cast("int").alias("fold")).distinct()
    parts = [
        sp.leakage(t).agg(F.count(F.lit(1)).alias("leaking_blocks")).select(F.lit(n).alias("folds"), "leaking_blocks")
        for n, t in (("sequence", good), ("row", by_row))
    ]
    overlap = sp.split_overlap(sp.chronological_splits(tt.sequences(feat))).agg(F.count(F.lit(1)).alias("leaking_blocks"))
    return src.union_shards([*parts, overlap.select(F.lit("chronological").alias("folds"), "leaking_blocks")])


@register
def u5_conditions(spark, sf):
    return cond.conditions(features(spark, sf)).select(*rr("motion_direction", "motion_coherence", "prior_std", "prior_mean"))


@register
def f1_degrees_and_radians(spark, sf):
    t = trials(spark, sf)
    shifted = F.col("motion_direction") * 3 - 500
    return t.select(
        "row_id",
        r(C.deg2rad(shifted), "rad"),
        r(C.rad2deg(F.col("motion_direction") / 7 - 20), "deg"),
        r(C.wrap_rad(F.col("raw_response_time") * 5 - 9), "wrapped"),
    )


@register
def f2_circular_difference(spark, sf):
    f = features(spark, sf)
    return f.select(
        "row_id",
        r(C.circ_diff(F.col("y"), F.col("theta")), "signed"),
        r(C.circ_absdiff(F.col("y"), F.col("mu")), "absolute"),
        r(C.wrap_pi(F.col("y") - F.col("theta")), "wrapped"),
    )


@register
def f3_response_angle(spark, sf):
    return trials(spark, sf).select("row_id", r(C.response_deg(F.col("estimate_x"), F.col("estimate_y")), "estimate_deg"))


@register
def f6_circular_moments(spark, sf):
    f = features(spark, sf).groupBy("subject_id").agg(
        F.avg(F.cos("error")).alias("c"), F.avg(F.sin("error")).alias("s")
    )
    c, s = F.col("c"), F.col("s")
    return f.select("subject_id", r(C.circ_sd_deg(c, s), "circular_sd_deg"), r(C.circ_mean_deg(c, s), "circular_mean_deg"))


@register
def f5_kappa_from_resultant(spark, sf):
    f = features(spark, sf).groupBy("subject_id", "motion_coherence").agg(F.avg("cos_s").alias("resultant"))
    return f.select("subject_id", r("motion_coherence"), r("resultant"), r(C.kappa_from_r(F.col("resultant")), "kappa"))


@register
def f9_kappa_to_sd(spark, sf):
    f = features(spark, sf).groupBy("prior_std").agg(F.avg("cos_p").alias("resultant"))
    kappa = C.kappa_from_r(F.col("resultant"))
    return f.select(r("prior_std"), r(kappa, "kappa"), r(C.kappa_sd_deg(kappa), "circular_sd_deg"), r(C.log_i0(kappa), "log_i0"))


@register
def f10_labels(spark, sf):
    f = features(spark, sf)
    label = C.condition_label(F.col("motion_coherence"), F.col("prior_std"))
    return f.select(
        "row_id",
        C.block_id(*[F.col(k) for k in SEQ]).alias("block_id"),
        label.alias("condition"),
        F.replace(F.concat(F.lit("coherence_"), label), F.lit("coherence_"), F.lit("Coherence ")).alias("condition_label"),
    )


@register
def f11_parameter_json(spark, sf):
    f = features(spark, sf).groupBy("subject_id").pivot("prior_std", [10.0, 20.0, 40.0, 80.0]).agg(F.round(F.avg("cos_p"), 6))
    names = ["10", "20", "40", "80"]
    f = f.select("subject_id", *[F.col(f"`{n}.0`").alias(n) for n in names])
    text = f.withColumn("parameter_json", params_to_json({n: F.col(f"`{n}`") for n in names}))
    back = params_from_json(F.col("parameter_json"), names)
    return text.select("subject_id", *[b.alias(f"kappa_p_{n}") for b, n in zip(back, names)], F.length("parameter_json").alias("n_chars"))


@register
def f12_bins(spark, sf):
    f = features(spark, sf)
    conflict = C.conflict_deg(F.col("motion_direction"), F.col("prior_mean"))
    return f.select(
        "row_id",
        r(conflict, "conflict_deg"),
        C.conflict_bin(conflict).alias("conflict_bin"),
        C.hist_bin(C.relative_deg(F.col("error"))).alias("hist_bin"),
    )


@register
def s2_csv_scan(spark, sf):
    """The trial table through text: written as CSV with a header, read with its declared schema."""
    path = new_path(spark, "trials-csv")
    trials(spark, sf).select(*[f.name for f in src.TRIAL_SCHEMA]).write.mode("overwrite").option("header", True).csv(path)
    back = src.read_trials(spark, path, "csv")
    return back.select("row_id", *SEQ, ORDER, "experiment_name", "experiment_id", *rr("trial_time", "motion_direction", "estimate_x", "estimate_y", "prior_std"))


@register
def s3_read_draws(spark, sf):
    f = features(spark, sf)
    draws = f.select("row_id", "motion_coherence", "prior_std", "estimate_deg", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("simulation"))
    path = new_path(spark, "draws")
    draws.write.mode("overwrite").partitionBy("simulation").parquet(path)
    read = src.read_draws(spark, path, ["row_id", "estimate_deg"], [1, 3])
    return read.select("simulation", "row_id", r("estimate_deg"))

