"""Scans, sinks and the adapter that turns an event log into a trial table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcseq.columns import ALIASES
from arcseq.functions.circular import dbl
from arcseq.operators.ordered import rank_in_group

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

TRIAL_SCHEMA = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("subject_id", T.LongType()),
        T.StructField("session_id", T.LongType()),
        T.StructField("run_id", T.LongType()),
        T.StructField("trial_index", T.LongType()),
        T.StructField("trial_time", T.DoubleType()),
        T.StructField("response_arrow_start_angle", T.DoubleType()),
        T.StructField("motion_direction", T.DoubleType()),
        T.StructField("motion_coherence", T.DoubleType()),
        T.StructField("estimate_x", T.DoubleType()),
        T.StructField("estimate_y", T.DoubleType()),
        T.StructField("reaction_time", T.DoubleType()),
        T.StructField("raw_response_time", T.DoubleType()),
        T.StructField("prior_std", T.DoubleType()),
        T.StructField("prior_mean", T.DoubleType()),
        T.StructField("experiment_name", T.StringType()),
        T.StructField("experiment_id", T.LongType()),
    ]
)


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Scan with a declared schema (no inference pass)."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(path)


def read_trials(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Trial scan; `row_id` is the row number that the file carries."""
    return read_table(spark, path, TRIAL_SCHEMA, fmt)


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/events.parquet", EVENT_SCHEMA)


def number_rows(df: DataFrame, order: list[str], fine: Column, name: str = "row_id") -> DataFrame:
    """Row number over a declared total order, for files without one."""
    return rank_in_group(df.withColumn("__all", F.lit(0)), ["__all"], order, fine, name).drop("__all")


def canonicalise(df: DataFrame, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """Rename the first accepted name of each field; a field without any raises KeyError."""
    chosen = {}
    for field, names in aliases.items():
        found = next((n for n in names if n in df.columns), None)
        if found is None:
            raise KeyError(f"none of the columns {names} found")
        chosen[found] = field
    return df.select(*[F.col(c).alias(chosen.get(c, c)) for c in df.columns])


def run_of(ts: Column) -> Column:
    """Ten-day run number within a month."""
    return (F.floor((F.dayofmonth(ts) - 1) / 10) + 1).cast("long")


def respond(df: DataFrame) -> DataFrame:
    """Add condition columns and a response to rows with keys, event_id, value and trial_index."""
    eid, value = F.col("event_id"), F.col("value")
    coherence = F.when(eid % 3 == 0, dbl(0.06)).when(eid % 3 == 1, dbl(0.12)).otherwise(dbl(0.24))
    width_class = (F.col("session_id") + F.col("run_id")) % 4
    width = (
        F.when(width_class == 0, dbl(10)).when(width_class == 1, dbl(20)).when(width_class == 2, dbl(40)).otherwise(dbl(80))
    )
    direction = dbl((eid * 7 % 36) * 10 + 5)
    df = df.withColumns({"motion_coherence": coherence, "prior_std": width, "motion_direction": direction, "prior_mean": dbl(225)})
    by_sense = F.floor((F.col("trial_index") - 1) / 5) % 2 == 0
    angle = (
        F.when(eid % 13 == 0, dbl((eid * 37) % 360) + dbl(0.37))
        .when(by_sense, F.col("motion_direction") + F.sin(value) * dbl(3) / F.col("motion_coherence"))
        .otherwise(F.col("prior_mean") + F.sin(value * dbl(1.7)) * F.col("prior_std") * dbl(0.6))
    )
    missing = eid % 97 == 0
    return df.withColumns(
        {
            "estimate_x": F.when(~missing, F.cos(F.radians(angle))),
            "estimate_y": F.when(~missing, F.sin(F.radians(angle))),
        }
    )


def trials_from_events(events: DataFrame) -> DataFrame:
    """Trial table of an event log: users are sessions, ten-day spans are runs."""
    base = events.select(
        "event_id",
        "ts",
        "value",
        (F.col("user_id") % 12 + 1).cast("long").alias("subject_id"),
        F.col("user_id").alias("session_id"),
        run_of(F.col("ts")).alias("run_id"),
    )
    numbered = rank_in_group(
        base, ["subject_id", "session_id", "run_id"], ["ts", "event_id"], F.date_format("ts", "yyyyMMddHHmm"), "trial_index"
    )
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return respond(numbered).select(
        F.col("event_id").alias("row_id"),
        "subject_id",
        "session_id",
        "run_id",
        "trial_index",
        dbl(seconds).alias("trial_time"),
        dbl((F.col("event_id") * 11) % 360).alias("response_arrow_start_angle"),
        "motion_direction",
        "motion_coherence",
        "estimate_x",
        "estimate_y",
        (F.col("value") / 100).alias("reaction_time"),
        (F.col("value") / 50).alias("raw_response_time"),
        "prior_std",
        "prior_mean",
        F.lit("direction_estimation").alias("experiment_name"),
        F.lit(11).cast("long").alias("experiment_id"),
    )


def read_draws(spark: SparkSession, path: str, columns: list[str], simulations: list[int] | None = None) -> DataFrame:
    """Draw table partitioned by `simulation`: only the named columns and draws are read."""
    draws = spark.read.parquet(path)
    if simulations is not None:
        draws = draws.filter(F.col("simulation").isin(simulations))
    return draws.select("simulation", *columns)


#: A part of the score table; a rerun replaces whole parts.
SCORE_PARTS = ["fit_scope", "model_key", "cv_fold"]


def finished_parts(spark: SparkSession, path: str) -> DataFrame:
    """fit_scope, model_key, cv_fold, n_rows of the parts whose scores are written completely."""
    schema = "fit_scope string, model_key string, cv_fold int, n_rows bigint"
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_finished")
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    if not there:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/_finished").where("n_rows IS NOT NULL")


def write_scores(scores: DataFrame, path: str, resume: bool = False) -> None:
    """Trial scores, one folder per scope, model and fold (null outside cross-validation).

    Only the parts that `scores` holds are replaced, so that one fold can be run again; with `resume` the parts that are
    finished already are left as they are. A part is finished while the manifest `_finished` holds its number of rows: it is
    taken away before the part is replaced and counted from the files afterwards.
    """
    if "cv_fold" not in scores.columns:
        scores = scores.withColumn("cv_fold", F.lit(None).cast("int"))
    scores = scores.withColumn("cv_fold", F.col("cv_fold").cast("int"))
    spark = scores.sparkSession
    if resume:
        scores = _on_parts(scores, finished_parts(spark, path), "left_anti")
    parts = [tuple(r) for r in scores.select(*SCORE_PARTS).distinct().collect()]  # scopes x models x folds
    if not parts:
        return
    own = spark.createDataFrame(parts, "fit_scope string, model_key string, cv_fold int")

    def write(rows: DataFrame, folder: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*SCORE_PARTS).parquet(folder)

    write(own.withColumn("n_rows", F.lit(None).cast("bigint")).coalesce(1), f"{path}/_finished")
    write(scores, path)
    written = _on_parts(spark.read.schema(scores.schema).parquet(path), own, "left_semi")
    write(written.groupBy(*SCORE_PARTS).agg(F.count(F.lit(1)).alias("n_rows")).coalesce(1), f"{path}/_finished")


def _on_parts(rows: DataFrame, parts: DataFrame, how: str) -> DataFrame:
    own = parts.select(*[F.col(c).alias(f"__{c}") for c in SCORE_PARTS])
    return rows.join(own, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in SCORE_PARTS]), how)


def union_shards(shards: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards)
