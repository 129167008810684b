"""Cleaning, per-sequence windows and derived columns of the trial table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcseq import columns
from arcseq.columns import CHUNK, COVARIATES, ORDER, REQUIRED, SEQ
from arcseq.functions import circular as C
from arcseq.operators.ordered import at_key, in_sequence, one_key, per_chunk, previous, rank_in_group, running, same_keys


def chunked(df: DataFrame, order: str = ORDER, rows: int | None = None) -> DataFrame:
    return df.withColumn(CHUNK, F.floor(F.col(order) / F.lit(rows or columns.CHUNK_ROWS)))


def any_missing(fields: list[str] = REQUIRED) -> Column:
    flag = F.col(fields[0]).isNull()
    for f in fields[1:]:
        flag = flag | F.col(f).isNull()
    return flag


def usable_trials(df: DataFrame) -> DataFrame:
    return df.dropna(subset=REQUIRED)


def excluded_trials(df: DataFrame) -> DataFrame:
    """Rows left out of the analysis with the missing fields joined by ';'."""
    reasons = [F.when(F.col(f).isNull(), F.lit(f"missing_{f}")) for f in REQUIRED]
    return df.filter(any_missing()).withColumn("exclusion_reason", F.concat_ws(";", *reasons))


def missing_report(df: DataFrame) -> DataFrame:
    """Missing responses with the valid trial before and after."""
    df = chunked(df)
    valid = F.when(~any_missing(["estimate_x", "estimate_y"]), F.col(ORDER))
    df = running(df, SEQ, [CHUNK], [ORDER], {"preceding_valid_trial_index": ("max", valid)})
    df = running(df, SEQ, [CHUNK], [ORDER], {"following_valid_trial_index": ("min", valid)}, backward=True)
    return df.filter(any_missing(["estimate_x", "estimate_y"])).select(
        "row_id",
        *SEQ,
        ORDER,
        C.block_id(*[F.col(k) for k in SEQ]).alias("block_id"),
        F.col("estimate_x").isNull().alias("estimate_x_missing"),
        F.col("estimate_y").isNull().alias("estimate_y_missing"),
        "preceding_valid_trial_index",
        "following_valid_trial_index",
    )


def angles(df: DataFrame) -> DataFrame:
    """Response, stimulus and prior angles (radians) and their cosine agreements."""
    df = df.withColumn("estimate_deg", C.response_deg(F.col("estimate_x"), F.col("estimate_y")))
    df = df.withColumns(
        {
            "y": C.deg2rad(F.col("estimate_deg")),
            "theta": C.deg2rad(F.col("motion_direction")),
            "mu": C.deg2rad(F.col("prior_mean")),
        }
    )
    return df.withColumns(
        {
            "error": C.circ_diff(F.col("y"), F.col("theta")),
            "prior_error": C.circ_diff(F.col("y"), F.col("mu")),
            "conflict": C.circ_diff(F.col("theta"), F.col("mu")),
            "cos_s": F.cos(C.circ_diff(F.col("y"), F.col("theta"))),
            "cos_p": F.cos(C.circ_diff(F.col("y"), F.col("mu"))),
        }
    )


def sequence_position(df: DataFrame) -> DataFrame:
    """1-based position, length and start flag within the sequence."""
    out = in_sequence(chunked(df), SEQ, CHUNK, ORDER)
    return out.withColumn("is_start", F.col("pos") == 1)


#: Fields of the preceding trial that a row needs; its angles follow from them.
PREVIOUS = ["estimate_x", "estimate_y", "motion_direction", "motion_coherence", "prior_mean"]


def features(trials: DataFrame) -> DataFrame:
    """Usable trials with angles, position, length and the raw fields of the preceding trial.

    One pass over the sequence order feeds every operator that looks one trial back.
    """
    base = chunked(usable_trials(trials))
    # angles are derived after the pass, so that only fields of the trial table are shuffled
    out = angles(in_sequence(base, SEQ, CHUNK, ORDER, {f"__p_{c}": F.col(c) for c in PREVIOUS}))
    deg = C.response_deg(F.col("__p_estimate_x"), F.col("__p_estimate_y"))
    y, theta, mu = (C.deg2rad(c) for c in (deg, F.col("__p_motion_direction"), F.col("__p_prior_mean")))
    before = {
        "prev_theta": theta,
        "prev_y": y,
        "prev_error": C.circ_diff(y, theta),
        "prev_conflict": C.circ_diff(theta, mu),
        "prev_motion_coherence": F.col("__p_motion_coherence"),
        "prev_motion_direction": F.col("__p_motion_direction"),
        "prev_estimate_deg": deg,
    }
    out = out.withColumns(before).drop(*[f"__p_{c}" for c in PREVIOUS])
    return out.withColumn("is_start", F.col("pos") == 1)


def transition_covariates(feat: DataFrame) -> DataFrame:
    """Covariates of the transition into each trial; starts get error 0, conflict 0, own coherence."""
    return feat.withColumns(
        {
            "x_coherence": F.col("motion_coherence"),
            "x_prior_precision": 1 / F.greatest(F.col("prior_std"), C.dbl(1e-6)),
            "x_conflict": F.abs(F.col("conflict")),
            "x_prev_error": F.coalesce(F.abs(F.col("prev_error")), C.dbl(0)),
            "x_prev_conflict": F.coalesce(F.abs(F.col("prev_conflict")), C.dbl(0)),
            "x_prev_coherence": F.coalesce(F.col("prev_motion_coherence"), F.col("motion_coherence")),
        }
    )


X_COLS = [f"x_{c}" for c in COVARIATES]


def serial_previous(feat: DataFrame) -> DataFrame:
    """Previous stimulus and response; a start uses the current trial."""
    return feat.withColumns(
        {
            "serial_theta": F.coalesce(F.col("prev_theta"), F.col("theta")),
            "serial_y": F.coalesce(F.col("prev_y"), F.col("y")),
        }
    )


def previous_fields(feat: DataFrame) -> DataFrame:
    """Previous-trial fields of the export table, null at starts."""
    return feat.withColumns(
        {
            "previous_motion_direction_deg": F.col("prev_motion_direction"),
            "previous_estimated_direction_deg": F.col("prev_estimate_deg"),
            "previous_signed_stimulus_error_deg": F.degrees("prev_error"),
            "previous_absolute_stimulus_error_deg": F.abs(F.degrees("prev_error")),
            "previous_stimulus_prior_conflict_deg": F.abs(F.degrees("prev_conflict")),
            "previous_coherence": F.col("prev_motion_coherence"),
        }
    )


def trial_base(feat: DataFrame) -> DataFrame:
    """Model-independent audit table: 30 derived and 6 previous-trial columns."""
    signed, prior, conflict = (F.degrees(c) for c in ("error", "prior_error", "conflict"))
    # the rows before a sequence are counted on the table of sequences, not on the trials
    lengths = (
        sequences(feat)
        .withColumn("__n", F.col("n").cast("long"))
        .withColumn("__all", F.lit(0))
        .select(*SEQ, "__n", "__all", "chunks")
    )
    starts = running(
        lengths,
        ["__all"],
        ["subject_id", "session_id"],
        ["run_id"],
        {"__rows": ("sum", F.col("__n")), "__seqs": ("sum", F.lit(1).cast("long"))},
    )
    starts = per_chunk(
        starts.select(
            *SEQ, "chunks", (F.col("__rows") - F.col("__n")).alias("__before"), (F.col("__seqs") - 1).alias("seq_id")
        )
    )
    return same_keys(previous_fields(feat), starts, SEQ + [CHUNK]).select(
        F.col("row_id").alias("raw_row_index"),
        (F.col("__before") + F.col("pos") - 1).alias("analysis_row_index"),
        "seq_id",
        *SEQ,
        F.col("run_id").alias("block_id"),
        ORDER,
        (F.col("pos") - 1).alias("sequence_trial_index"),
        F.col("seq_len").alias("sequence_length"),
        "trial_time",
        "experiment_name",
        "experiment_id",
        F.col("is_start").alias("is_sequence_start"),
        F.col("motion_direction").alias("motion_direction_deg"),
        "motion_coherence",
        F.col("prior_mean").alias("prior_mean_deg"),
        F.col("prior_std").alias("prior_std_deg"),
        F.col("response_arrow_start_angle").alias("response_arrow_start_angle_deg"),
        "estimate_x",
        "estimate_y",
        F.col("estimate_deg").alias("estimated_direction_deg"),
        "reaction_time",
        "raw_response_time",
        signed.alias("signed_stimulus_error_deg"),
        F.abs(signed).alias("absolute_stimulus_error_deg"),
        prior.alias("response_minus_prior_deg"),
        F.abs(prior).alias("absolute_prior_error_deg"),
        conflict.alias("signed_stimulus_prior_conflict_deg"),
        F.abs(conflict).alias("stimulus_prior_conflict_deg"),
        "previous_motion_direction_deg",
        "previous_estimated_direction_deg",
        "previous_signed_stimulus_error_deg",
        "previous_absolute_stimulus_error_deg",
        "previous_stimulus_prior_conflict_deg",
        "previous_coherence",
    )


def prior_centred(df: DataFrame) -> DataFrame:
    """Stimulus and response relative to the prior mean, in [-pi, pi)."""
    response = F.atan2(F.col("estimate_y"), F.col("estimate_x"))
    prior = F.radians("prior_mean")
    return df.withColumns(
        {
            "x_rad": C.wrap_pi(F.radians("motion_direction") - prior),
            "y_rad": C.wrap_pi(response - prior),
        }
    )


def level_table(df: DataFrame, col: str) -> DataFrame:
    """Distinct levels with dense indices from 0; one row per level."""
    levels = df.select(col).distinct().withColumn("__all", F.lit(0))
    # ranked per level table: a few rows for conditions, one per subject for subjects
    ranked = rank_in_group(levels, ["__all"], [col], F.round(C.dbl(F.col(col)), 0), "__r")
    return ranked.select(col, (F.col("__r") - 1).cast("long").alias(f"{col}_idx"))


def level_index(df: DataFrame, cols: list[str]) -> DataFrame:
    for c in cols:
        df = same_keys(df, level_table(df, c), [c])
    return df


def split_segments(df: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """Cut sequences at missing responses; leading gaps open no segment, missing rows are dropped.

    A valid trial opens a segment when it is the first of its sequence or follows a missing one. Inside a
    chunk this is a lag; whether the head of a chunk opens one is settled on the table of chunks.

    `own` has a row for each chunk that is kept; its columns meet the rows without another shuffle, and the rows get
    `chunk_pos`, their position among the rows of their segment in the chunk.
    """
    w = Window.partitionBy("__key").orderBy(ORDER)
    df = one_key(chunked(df).withColumn("__miss", any_missing(["estimate_x", "estimate_y"])), [*SEQ, CHUNK])
    local = df.withColumns({"__head": F.row_number().over(w) == 1, "__pmiss": F.lag("__miss").over(w)})
    local = local.withColumn("__open", ((~F.col("__miss")) & F.coalesce("__pmiss", F.lit(False))).cast("long"))
    local = local.withColumn("segment_number", F.sum("__open").over(w))
    if own is not None:
        # a segment that is not opened inside the chunk begins at its head
        at = F.row_number().over(w)
        opened = F.max(F.when(F.col("__open") == 1, F.col("__at"))).over(w)
        local = local.withColumn("__at", at).withColumn("chunk_pos", F.col("__at") - F.coalesce(opened, F.lit(1)) + 1).drop("__at")
    summary = local.groupBy(*SEQ, CHUNK).agg(
        F.sum("__open").alias("__n"),
        F.max(F.when(F.col("__head"), ~F.col("__miss"))).alias("__valid_head"),
        F.max_by("__miss", ORDER).alias("__last"),
    )
    wk = Window.partitionBy(*SEQ).orderBy(CHUNK)
    opens = F.col("__valid_head") & F.coalesce(F.lag("__last").over(wk), F.lit(True))
    summary = summary.withColumn("__opens", opens.cast("long"))
    before = F.sum(F.col("__n") + F.col("__opens")).over(wk) - F.col("__n")
    carry = summary.select(*SEQ, CHUNK, before.alias("__before"))
    carry = carry if own is None else same_keys(carry, own, SEQ + [CHUNK])
    df = at_key(local, carry, SEQ + [CHUNK]).filter(~F.col("__miss"))
    df = df.withColumn("segment_number", F.col("segment_number") + F.col("__before"))
    df = df.drop("__miss", "__head", "__pmiss", "__open", "__before")
    block = C.block_id(*[F.col(k) for k in SEQ])
    return df.withColumns(
        {
            "block_id": block,
            "segment_id": F.concat(block, F.format_string("_segment%02d", F.col("segment_number"))),
        }
    )


def contiguity(feat: DataFrame) -> DataFrame:
    """Trial number per subject over its ordered blocks, and the start flag of each block."""
    df = running(
        feat, ["subject_id"], ["session_id", "run_id", CHUNK], [ORDER], {"global_trial": ("sum", F.lit(1).cast("long"))}
    )
    df = df.withColumn("block_id", C.block_id(*[F.col(k) for k in SEQ]))
    df = previous(df, ["subject_id"], ["session_id", "run_id", CHUNK], [ORDER], {"__prev": F.col("block_id")})
    return df.withColumn(
        "is_block_start", F.col("__prev").isNull() | (F.col("__prev") != F.col("block_id"))
    ).drop("__prev")


def non_contiguous_blocks(contig: DataFrame) -> DataFrame:
    """Blocks that are entered more than once in the given order (empty when contiguous)."""
    return (
        contig.groupBy("subject_id", "block_id")
        .agg(F.sum(F.col("is_block_start").cast("int")).alias("n_starts"))
        .filter(F.col("n_starts") > 1)
    )


def sequences(df: DataFrame) -> DataFrame:
    """One row per sequence: length, prior width and the numbers of its chunks."""
    if CHUNK not in df.columns:
        df = chunked(df)
    return df.groupBy(*SEQ).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("prior_std").alias("prior_std"),
        F.collect_set(CHUNK).alias("chunks"),
    )


def run_lengths(df: DataFrame, state: str, keys: list[str], piece: str = CHUNK, by: str = ORDER) -> DataFrame:
    """Maximal stretches of one state within each group."""
    df = previous(df.select(*keys, piece, by, state), keys, [piece], [by], {"__prev": F.col(state)})
    change = F.when(F.col("__prev") == F.col(state), 0).otherwise(1).cast("long")
    df = running(df.withColumn("__new", change), keys, [piece], [by], {"run_no": ("sum", F.col("__new"))})
    return df.groupBy(*keys, "run_no", state).agg(F.count(F.lit(1)).alias("run_length"))


def share_within(df: DataFrame, count: str, keys: list[str], total: str, share: str) -> DataFrame:
    """Group total and share of a count table (one row per cell, so groups are small)."""
    w = Window.partitionBy(*keys)
    return df.withColumn(total, F.sum(count).over(w)).withColumn(
        share, F.try_divide(F.col(count).cast("double"), F.col(total))
    )
