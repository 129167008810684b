"""Tables that the registered queries share, staged once per session and data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcseq.operators import splits as sp
from arcseq.operators import trial_table as tt
from arcseq.session import staged_once
from arcseq.sources.trials import read_events, trials_from_events


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged_once(spark, ("trials", sf_dir), lambda: trials_from_events(read_events(spark, sf_dir)))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged_once(spark, ("features", sf_dir), lambda: tt.features(trials(spark, sf_dir)))


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged_once(spark, ("folds", sf_dir), lambda: sp.stratified_folds(tt.sequences(tt.usable_trials(trials(spark, sf_dir)))))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials cut at missing responses, with angles, position in the segment and fold."""

    return staged_once(spark, ("segments", sf_dir), lambda: tt.angles(sp.placed_segments(trials(spark, sf_dir), folds(spark, sf_dir))))


def r(col: Column | str, name: str | None = None, places: int = 6) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return (F.round(c.cast("double"), places) + F.lit(0.0)).alias(name or (col if isinstance(col, str) else "value"))


def rr(*cols: str, places: int = 6) -> list[Column]:
    return [r(c, c, places) for c in cols]


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))
