"""Audits and behavioural summaries of the trial table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcseq.columns import CHUNK, ORDER, SEQ, STATES
from arcseq.functions import circular as C
from arcseq.operators.quantiles import exact_quantiles
from arcseq.operators.trial_table import chunked, sequences
from arcseq.session import stage

CONDITION = ["motion_coherence", "prior_std"]
METRICS = ["mean_abs_error_deg", "median_abs_error_deg", "mean_cos_error", "circular_std_error_deg", "prior_like_rate"]


def dataset_summary(raw: DataFrame, feat: DataFrame) -> DataFrame:
    """One row; distinct counts are taken on the table of sequences, not on the trials."""
    seqs = sequences(feat)
    raw_count = raw.agg(F.count(F.lit(1)).alias("raw_rows"))
    shape = seqs.agg(
        F.sum("n").alias("usable_trials"),
        F.countDistinct("subject_id").alias("subjects"),
        F.countDistinct("subject_id", "session_id").alias("sessions"),
        F.count(F.lit(1)).alias("sequences"),
    )
    levels = feat.groupBy(*CONDITION).count().agg(
        F.countDistinct("motion_coherence").alias("coherence_levels"),
        F.countDistinct("prior_std").alias("prior_width_levels"),
    )
    median = exact_quantiles(seqs, [], F.col("n"), {"median_trials_per_sequence": 0.5}, width=64)
    one = F.lit(1).alias("__one")
    out = raw_count.select(one, "*")
    for part in (shape, levels, median):
        out = out.join(part.select(one, "*"), "__one")
    return out.withColumn("dropped_rows", F.col("raw_rows") - F.col("usable_trials")).drop("__one")


def block_table(raw: DataFrame) -> DataFrame:
    """One row per block with the counts that must be constant inside it."""
    parts = chunked(raw).groupBy(*SEQ, CHUNK).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(ORDER).alias("lo"),
        F.max(ORDER).alias("hi"),
        F.collect_set("prior_std").alias("p"),
        F.collect_set("prior_mean").alias("m"),
        F.collect_set("experiment_id").alias("e"),
    )

    def distinct(c: str) -> Column:
        return F.size(F.array_distinct(F.flatten(F.collect_set(c)))).cast("long")

    return parts.groupBy(*SEQ).agg(
        F.sum("n").alias("n_trials"),
        distinct("p").alias("prior_std_unique_count"),
        distinct("m").alias("prior_mean_unique_count"),
        distinct("e").alias("experiment_id_unique_count"),
        F.min("lo").alias("trial_index_min"),
        F.max("hi").alias("trial_index_max"),
    )


def block_audit(raw: DataFrame) -> DataFrame:
    blocks = block_table(raw)
    median = exact_quantiles(blocks, [], F.col("n_trials"), {"block_length_median": 0.5}, width=64)
    out = blocks.agg(
        F.countDistinct("subject_id").alias("number_of_subjects"),
        F.countDistinct("subject_id", "session_id").alias("number_of_subject_session_pairs"),
        F.countDistinct("run_id").alias("number_of_run_id_values"),
        F.count(F.lit(1)).alias("number_of_model_blocks"),
        F.min("n_trials").alias("block_length_min"),
        F.max("n_trials").alias("block_length_max"),
        F.max("prior_std_unique_count").alias("max_prior_std_unique_within_block"),
        F.max("prior_mean_unique_count").alias("max_prior_mean_unique_within_block"),
        F.max("experiment_id_unique_count").alias("max_experiment_unique_within_block"),
        F.min((F.col("trial_index_min") == 1).cast("int")).alias("__ok"),
    )
    out = out.withColumn("trial_index_resets_to_one_in_all_blocks", F.col("__ok") == 1).drop("__ok")
    one = F.lit(1).alias("__one")
    return out.select(one, "*").join(median.select(one, "*"), "__one").drop("__one")


def integrity_checks(raw: DataFrame) -> DataFrame:
    """Violations per check: duplicate trial keys, blocks not starting at 1, blocks mixing conditions."""
    blocks = block_table(raw)
    per_block = blocks.agg(
        F.sum((F.col("trial_index_min") != 1).cast("long")).alias("blocks_not_starting_at_one"),
        F.sum(
            (
                (F.col("prior_std_unique_count") != 1)
                | (F.col("prior_mean_unique_count") != 1)
                | (F.col("experiment_id_unique_count") != 1)
            ).cast("long")
        ).alias("blocks_mixing_conditions"),
    )
    duplicates = (
        raw.groupBy(*SEQ, ORDER).count().filter(F.col("count") > 1).agg(F.count(F.lit(1)).alias("duplicate_trial_keys"))
    )
    one = F.lit(1).alias("__one")
    return per_block.select(one, "*").join(duplicates.select(one, "*"), "__one").drop("__one")


def condition_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Error metrics per group from the columns error, prior_error (radians)."""
    err, prior = F.col("error"), F.col("prior_error")
    means = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.degrees(F.abs(err))).alias("mean_abs_error_deg"),
        F.avg(F.cos(err)).alias("mean_cos_error"),
        F.avg(F.sin(err)).alias("__sin"),
        F.avg((F.abs(prior) < F.abs(err)).cast("double")).alias("prior_like_rate"),
    )
    medians = exact_quantiles(df, keys, F.degrees(F.abs(err)), {"median_abs_error_deg": 0.5}, width=0.05)
    return means.join(medians, keys).select(
        *keys,
        "n",
        C.circ_mean_deg(F.col("mean_cos_error"), F.col("__sin")).alias("mean_signed_error_deg"),
        "mean_abs_error_deg",
        "median_abs_error_deg",
        "mean_cos_error",
        C.circ_sd_deg(F.col("mean_cos_error"), F.col("__sin")).alias("circular_std_error_deg"),
        "prior_like_rate",
    )


def metrics_of_many(df: DataFrame, keys: list[str], width: float = 1.0) -> DataFrame:
    """`condition_metrics` of very many groups, whose rows (error, prior_error, never null) are made anew at each reading.

    They are read twice: sums by interval of `width` degrees give the means and tell which intervals hold a median, then the
    values of these intervals are ranked. The table of sums has at most 180 / width + 1 rows for each group.
    """
    err, prior = F.col("error"), F.col("prior_error")
    size = F.degrees(F.abs(err))
    parts = df.groupBy(*keys, F.round(size / F.lit(float(width)), 0).alias("__piece")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(size).alias("__size"),
        F.sum(F.cos(err)).alias("__cos"),
        F.sum(F.sin(err)).alias("__sin"),
        F.sum((F.abs(prior) < F.abs(err)).cast("long")).alias("__prior"),
    )
    parts = stage(parts, "metric-parts")
    sums = parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "__size", "__cos", "__sin", "__prior")])
    counts = parts.select(*keys, "__piece", F.col("n").alias("__in"))
    medians = exact_quantiles(df, keys, size, {"median_abs_error_deg": 0.5}, width, counts)
    mean = lambda c: F.col(c) / F.col("n")
    return sums.join(medians, keys).select(
        *keys,
        "n",
        C.circ_mean_deg(mean("__cos"), mean("__sin")).alias("mean_signed_error_deg"),
        mean("__size").alias("mean_abs_error_deg"),
        "median_abs_error_deg",
        mean("__cos").alias("mean_cos_error"),
        C.circ_sd_deg(mean("__cos"), mean("__sin")).alias("circular_std_error_deg"),
        mean("__prior").alias("prior_like_rate"),
    )


def response_histograms(df: DataFrame, keys: list[str], width: int = 15) -> DataFrame:
    """Counts of relative directions for both references, empty bins included."""
    rel = F.stack(F.lit(2), F.lit("stimulus"), C.relative_deg(F.col("error")), F.lit("prior"), C.relative_deg(F.col("prior_error")))
    long = df.select(*keys, rel.alias("reference", "rel")).withColumn("bin", C.hist_bin(F.col("rel"), width))
    counts = long.groupBy(*keys, "reference", "bin").agg(F.count(F.lit(1)).alias("count"))
    # one row per group holding its bins as a map, then one row per possible bin
    packed = counts.groupBy(*keys, "reference").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("m"), F.sum("count").alias("total")
    )
    full = packed.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(360 // width - 1))))
    left = C.dbl(F.col("bin") * width - 180)
    return full.withColumn("count", F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0).cast("long"))).select(
        *keys,
        "reference",
        left.alias("bin_left_deg"),
        (left + width).alias("bin_right_deg"),
        (left + width / 2).alias("bin_center_deg"),
        "count",
        (F.col("count") / F.col("total")).alias("proportion"),
    )


def occupancy(post: DataFrame) -> DataFrame:
    """Mean posterior state probabilities by condition and conflict bin."""
    conflict = C.conflict_deg(F.col("motion_direction"), F.col("prior_mean"))
    df = post.withColumn("conflict_deg", conflict).withColumn("conflict_bin", C.conflict_bin(F.col("conflict_deg")))
    return df.groupBy(*CONDITION, "conflict_bin").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f"p_{s}").alias(f"p_{s}") for s in STATES],
        F.avg("conflict_deg").alias("mean_conflict_deg"),
    )


def complete_counts(df: DataFrame, dims: dict[str, list | None], count: str = "n") -> DataFrame:
    """Cell counts over the full product of levels, 0 where a cell is absent.

    A dimension given as None takes its distinct levels from the data (few levels per dimension).
    """
    names = list(dims)
    counts = df.groupBy(*names).agg(F.count(F.lit(1)).alias(count))
    levels = counts.agg(
        *[
            (F.collect_set(n) if v is None else F.array(*[F.lit(x) for x in v])).alias(n)
            for n, v in dims.items()
        ]
    )
    domain = levels
    for n in names:
        domain = domain.withColumn(n, F.explode(n))
    return domain.join(counts, names, "left").withColumn(count, F.coalesce(F.col(count), F.lit(0).cast("long")))


def state_share(df: DataFrame, state: str = "state", group: str = "subject_id") -> DataFrame:
    """Counts and proportions of every state per group, states without rows included."""
    counts = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("total_trials"),
        *[F.sum((F.col(state) == s).cast("long")).alias(s) for s in STATES],
    )
    pairs = ", ".join(f"'{s}', {s}" for s in STATES)
    long = counts.selectExpr(group, "total_trials", f"stack(3, {pairs}) AS ({state}, n_trials)")
    return long.withColumn("proportion", F.col("n_trials") / F.col("total_trials"))


def conditions(df: DataFrame) -> DataFrame:
    return df.select("motion_direction", "motion_coherence", "prior_std", "prior_mean").distinct()
