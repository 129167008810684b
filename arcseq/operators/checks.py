"""Replicate checks: summaries of observed and replicate responses, intervals, coverage, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcseq.columns import CHUNK, ORDER, SEQ, STATES
from arcseq.functions import circular as C
from arcseq.functions.hashing import digest
from arcseq.operators.conditions import CONDITION, METRICS, condition_metrics, response_histograms
from arcseq.operators.ordered import previous, rank_in_group, same_keys
from arcseq.operators.quantiles import exact_quantiles

SOURCE = ["source", "simulation"]


def with_response(feat: DataFrame, response_deg: str, keys: list[str] = SEQ) -> DataFrame:
    """Replace the response of each trial and rebuild everything derived from it."""
    df = feat.withColumn("estimate_deg", F.col(response_deg)).withColumn("y", C.deg2rad(F.col("estimate_deg")))
    df = df.withColumns(
        {
            "error": C.circ_diff(F.col("y"), F.col("theta")),
            "prior_error": C.circ_diff(F.col("y"), F.col("mu")),
            "cos_s": F.cos(C.circ_diff(F.col("y"), F.col("theta"))),
            "cos_p": F.cos(C.circ_diff(F.col("y"), F.col("mu"))),
        }
    )
    return previous(df, keys, [CHUNK], [ORDER], {"prev_y": F.col("y"), "prev_error": F.col("error")})


def responded(df: DataFrame) -> DataFrame:
    """Response, differences and agreements of rows that hold a response, a direction and a prior mean in degrees."""
    y, theta, mu = (C.deg2rad(F.col(c)) for c in ("estimate_deg", "motion_direction", "prior_mean"))
    return df.withColumns(
        {
            "y": y,
            "error": C.circ_diff(y, theta),
            "prior_error": C.circ_diff(y, mu),
            "cos_s": F.cos(C.circ_diff(y, theta)),
            "cos_p": F.cos(C.circ_diff(y, mu)),
        }
    )


#: Sequences of at most so many trials are permuted as one array.
ARRAY_ROWS = 16_384


def _permuted_whole(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """Sequences as arrays: they are shuffled once, whatever the number of replicates."""
    fields = [c for c in rows.columns if c not in SEQ]
    slots = [c for c in fields if c != "estimate_deg"]
    packed = rows.groupBy(*SEQ).agg(F.collect_list(F.struct("pos", *[c for c in fields if c != "pos"])).alias("a"))
    sims = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("simulation")
    packed = packed.select(*SEQ, F.array_sort("a").alias("a"), sims)
    ranked = F.transform("a", lambda x: F.struct(digest(seed, F.col("simulation"), x["row_id"]).alias("h"), x["estimate_deg"].alias("d")))
    met = F.zip_with(
        F.col("a"), F.array_sort(ranked), lambda x, d: F.struct(*[x[c].alias(c) for c in slots], d["d"].alias("estimate_deg"))
    )
    return packed.select("simulation", *SEQ, F.inline(met))


def _permuted_pieces(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """Sequences of any length, ranked piece by piece."""
    sims = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("simulation")
    donors = rows.select(*SEQ, "estimate_deg", "row_id", sims)
    donors = donors.withColumn("__h", digest(seed, F.col("simulation"), F.col("row_id")))
    donors = rank_in_group(donors, ["simulation", *SEQ], ["__h"], F.substring("__h", 1, 3), "pos")
    return same_keys(rows.drop("estimate_deg").select("*", sims), donors.drop("__h", "row_id"), ["simulation", *SEQ, "pos"])


def permuted_replicates(feat: DataFrame, n: int, seed: int = 17) -> DataFrame:
    """Replicates that exchange the responses of each sequence among its trials.

    Slot k of a sequence (`pos`, from 1 without gaps) takes the response of the trial ranked k by digest.
    """
    rows = feat.drop("estimate_x", "estimate_y", "error", "prior_error", "y", "cos_s", "cos_p")
    sizes = feat.groupBy(*SEQ).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > ARRAY_ROWS)
    # at most rows / ARRAY_ROWS sequences are longer
    long = F.broadcast(sizes.select(*SEQ, F.lit(True).alias("__long")))
    told = same_keys(rows, long, SEQ, "left")
    whole = _permuted_whole(told.filter("__long IS NULL").drop("__long"), n, seed)
    pieces = _permuted_pieces(told.filter("__long").drop("__long"), n, seed)
    return responded(whole.unionByName(pieces))


def union_sources(observed: DataFrame, replicates: DataFrame) -> DataFrame:
    """Observed and replicate rows in one table; columns that one side lacks are null there."""
    obs = observed.withColumns({"source": F.lit("observed"), "simulation": F.lit(-1)})
    sim = replicates.withColumn("source", F.lit("simulated"))
    return obs.unionByName(sim, allowMissingColumns=True)


def summaries(combined: DataFrame) -> tuple[DataFrame, DataFrame]:
    keys = [*SOURCE, *CONDITION]
    return condition_metrics(combined, keys), response_histograms(combined, keys)


def rounded_keys(df: DataFrame, cols: list[str] = CONDITION) -> DataFrame:
    """Float keys to 12 decimals, so that equal levels of different sources meet."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), 12) for c in cols})


def _intervals(long: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Observed value against mean and 95 % interval of the replicates (one value per replicate)."""
    obs = long.filter(F.col("source") == "observed").groupBy(*keys).agg(F.first(value).alias("observed"))
    sim = long.filter(F.col("source") == "simulated").groupBy(*keys).agg(
        F.avg(value).alias("simulated_mean"),
        F.percentile(value, F.lit(0.025)).alias("simulated_ci_low"),
        F.percentile(value, F.lit(0.975)).alias("simulated_ci_high"),
    )
    return sim.join(obs, keys)


def join_observed(summary: DataFrame, keys: list[str] = CONDITION) -> DataFrame:
    """Every replicate row next to the observed row of its condition."""
    rows = rounded_keys(summary, keys)
    obs = rows.filter(F.col("source") == "observed").select(*keys, *[F.col(m).alias(f"observed_{m}") for m in METRICS])
    return rows.filter(F.col("source") == "simulated").join(obs, keys)


def metric_intervals(summary: DataFrame) -> DataFrame:
    long = rounded_keys(summary).unpivot([*SOURCE, *CONDITION], METRICS, "metric", "value")
    out = _intervals(long, [*CONDITION, "metric"], "value")
    return out.withColumns(
        {
            "condition": C.condition_label(F.col("motion_coherence"), F.col("prior_std")),
            "observed_minus_simulated": F.col("observed") - F.col("simulated_mean"),
        }
    )


def histogram_intervals(hist: DataFrame) -> DataFrame:
    keys = [*CONDITION, "reference", "bin_left_deg", "bin_right_deg"]
    rows = rounded_keys(hist, [*CONDITION, "bin_left_deg", "bin_right_deg"])
    out = _intervals(rows, keys, "proportion")
    return out.withColumn("bin_center_deg", (F.col("bin_left_deg") + F.col("bin_right_deg")) / 2)


def covered(intervals: DataFrame) -> DataFrame:
    return intervals.withColumn("covered", F.col("observed").between(F.col("simulated_ci_low"), F.col("simulated_ci_high")))


def coverage(intervals: DataFrame, model: str) -> DataFrame:
    out = covered(intervals).groupBy("metric").agg(
        F.count(F.lit(1)).alias("cells"), F.sum(F.col("covered").cast("long")).alias("covered")
    )
    return out.select(
        F.lit(model).alias("model"), "metric", "cells", "covered", (F.col("covered") / F.col("cells")).alias("coverage_rate")
    )


def coverage_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Covered cells per model in both scopes and the direction of the change."""

    def totals(t: DataFrame, tag: str) -> DataFrame:
        return t.groupBy("model").agg(F.sum("cells").alias(f"{tag}_cells"), F.sum("covered").alias(f"{tag}_covered"))

    joined = totals(after, "after").join(totals(before, "before"), "model", "left")
    joined = joined.fillna(0, ["before_cells", "before_covered"])
    direction = (
        F.when(F.col("after_covered") > F.col("before_covered"), "improved")
        .when(F.col("after_covered") < F.col("before_covered"), "deteriorated")
        .otherwise("did not change")
    )
    return joined.withColumn("direction", direction)


def attach_intervals(point: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    return point.join(intervals, keys, "left")


def missing_cells(every: DataFrame, kept: DataFrame, keys: list[str] = CONDITION) -> DataFrame:
    """Condition cells that a filter emptied."""
    return every.select(*keys).distinct().subtract(kept.select(*keys).distinct())


def retention(df: DataFrame, state: str = "decoded_state") -> DataFrame:
    """Count and share of each decoded state per source and condition, absent states as 0."""
    keys = [*SOURCE, *CONDITION]
    counts = df.groupBy(*keys).agg(*[F.sum((F.col(state) == s).cast("long")).alias(s) for s in STATES])
    parts = [x for s in STATES for x in (F.lit(s), F.col(s))]
    long = counts.select(*keys, sum(F.col(s) for s in STATES).alias("condition_n"), F.stack(F.lit(3), *parts).alias(state, "n"))
    return long.withColumns(
        {
            "fraction_of_condition": F.col("n") / F.col("condition_n"),
            "retained": F.col(state) != "lapse",
        }
    )


def retention_summary(table: DataFrame) -> DataFrame:
    """Observed retention against the replicates per condition."""
    keys = [*SOURCE, *CONDITION]
    totals = rounded_keys(table).groupBy(*keys).agg(
        F.sum("n").alias("total_n"), F.sum(F.when(F.col("retained"), F.col("n")).otherwise(0)).alias("retained_n")
    )
    totals = totals.withColumn("retained_rate", F.col("retained_n") / F.col("total_n"))
    obs = totals.filter(F.col("source") == "observed").select(
        *CONDITION, *[F.col(c).alias(f"observed_{c}") for c in ("total_n", "retained_n", "retained_rate")]
    )
    sim = totals.filter(F.col("source") == "simulated").groupBy(*CONDITION).agg(
        F.avg("retained_n").alias("simulated_retained_n_mean"),
        F.avg("retained_rate").alias("simulated_retained_rate_mean"),
        F.percentile("retained_rate", F.lit(0.025)).alias("simulated_retained_rate_ci_low"),
        F.percentile("retained_rate", F.lit(0.975)).alias("simulated_retained_rate_ci_high"),
    )
    return sim.join(obs, CONDITION)


def confusion(df: DataFrame, keys: list[str], given: str = "generating_state", decoded: str = "decoded_state") -> DataFrame:
    """Given against decoded state over all nine cells, with row fractions."""
    cells = {(a, b): F.sum(((F.col(given) == a) & (F.col(decoded) == b)).cast("long")) for a in STATES for b in STATES}
    wide = df.groupBy(*keys).agg(*[e.alias(f"{a}_{b}") for (a, b), e in cells.items()])
    parts = []
    for a in STATES:
        total = sum(F.col(f"{a}_{b}") for b in STATES)
        for b in STATES:
            parts += [F.lit(a), F.lit(b), F.col(f"{a}_{b}"), total]
    out = wide.select(*keys, F.stack(F.lit(9), *parts).alias(given, decoded, "n", f"{given}_n"))
    return out.withColumn(f"fraction_within_{given}", F.try_divide(F.col("n").cast("double"), F.col(f"{given}_n")))


def run_length_summary(runs: DataFrame, keys: list[str]) -> DataFrame:
    base = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_runs"), F.avg("run_length").alias("mean_run_length"))
    q = exact_quantiles(runs, keys, F.col("run_length"), {"median_run_length": 0.5, "q90_run_length": 0.9}, width=256)
    return base.join(q, keys)


def run_length_calibration(runs: DataFrame, state: str = "state") -> DataFrame:
    """Mean, median and 90 % quantile of run lengths: observed against one value per replicate."""
    per = run_length_summary(runs, ["source", "simulation", state])
    parts = [F.lit("mean"), F.col("mean_run_length"), F.lit("median"), F.col("median_run_length"), F.lit("q90"), F.col("q90_run_length")]
    long = per.select("source", "simulation", state, F.stack(F.lit(3), *parts).alias("metric", "value"))
    return _intervals(long, [state, "metric"], "value")
