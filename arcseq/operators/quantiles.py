"""Exact linear-interpolation quantiles by selection: intervals are counted, and only those that hold a wanted rank are ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcseq import columns
from arcseq.operators.ordered import running, same_keys
from arcseq.session import stage

#: Parts of an interval that is too full for one window.
PARTS = 4096


def _positions(probs: dict[str, float]) -> list[Column]:
    return [(F.col("__n") - 1) * F.lit(float(p)) for p in probs.values()]


def wanted_values(
    df: DataFrame, keys: list[str], value: Column, probs: dict[str, float], width: float, counts: DataFrame | None = None
) -> DataFrame:
    """Distinct values (`__v`, with their number `__c`) of the intervals of `width` that hold a wanted rank of their group.

    One row per group and interval is counted map-side; at most two intervals for each probability are kept, with the number
    of values before them (`__before`), in them (`__in`) and in the group (`__n`). Who has the counts (keys, `__piece`, `__in`)
    hands them in, and `df` is read once less.
    """
    piece = F.round(F.col("__v") / F.lit(float(width)), 0)
    values = df.select(*keys, value.cast("double").alias("__v")).filter(F.col("__v").isNotNull()).withColumn("__piece", piece)
    counts = values.groupBy(*keys, "__piece").agg(F.count(F.lit(1)).alias("__in")) if counts is None else counts
    sizes = counts.groupBy(*keys).agg(F.sum("__in").alias("__n"))
    placed = counts.withColumn("__coarse", F.round(F.col("__piece") / PARTS, 0))
    placed = running(placed, keys, ["__coarse"], ["__piece"], {"__upto": ("sum", F.col("__in"))})
    placed = same_keys(placed, sizes, keys).withColumn("__before", F.col("__upto") - F.col("__in"))
    holds = F.lit(False)
    for at in _positions(probs):
        for rank in (F.floor(at), F.ceil(at)):
            holds = holds | ((rank >= F.col("__before")) & (rank < F.col("__upto")))
    own = [*keys, "__piece"]
    about = ["__before", "__in", "__n"]
    # written first, so that its size is known: where it is small, the values are not shuffled to meet it
    wanted = stage(placed.filter(holds).select(*own, *about), "quantile-intervals")
    held = same_keys(values, wanted, own)
    return held.groupBy(*own, *about, "__v").agg(F.count(F.lit(1)).alias("__c"))


def exact_quantiles(
    df: DataFrame, keys: list[str], value: Column, probs: dict[str, float], width: float, counts: DataFrame | None = None
) -> DataFrame:
    """One row per group with the requested quantiles.

    Only `wanted_values` are ranked, through cumulative counts, and the two neighbours of each quantile position are picked
    by rank. An interval with more than HOT_GROUP_ROWS values is ranked in PARTS parts, so no window grows with the group.
    NaN ranks above every number, in groups of any size.
    """
    if not keys:
        return exact_quantiles(df.withColumn("__all", F.lit(0)), ["__all"], value, probs, width, counts).drop("__all")
    part = F.when(F.col("__in") > columns.HOT_GROUP_ROWS, F.round(F.col("__v") / F.lit(width / PARTS), 0)).otherwise(0.0)
    wanted = wanted_values(df, keys, value, probs, width, counts).withColumn("__part", part)
    ranked = running(wanted, [*keys, "__piece"], ["__part"], ["__v"], {"__cum": ("sum", F.col("__c"))})
    upto = F.col("__before") + F.col("__cum")
    picks = []
    for i, at in enumerate(_positions(probs)):
        # the value at 0-based rank r is the smallest one whose cumulative count exceeds r
        picks += [
            F.min(F.when(upto > F.floor(at), F.col("__v"))).alias(f"__lo{i}"),
            F.min(F.when(upto > F.ceil(at), F.col("__v"))).alias(f"__hi{i}"),
            F.first(at - F.floor(at)).alias(f"__f{i}"),
        ]
    picked = ranked.groupBy(*keys).agg(*picks)
    return picked.select(
        *keys,
        *[
            (F.col(f"__lo{i}") + F.col(f"__f{i}") * (F.col(f"__hi{i}") - F.col(f"__lo{i}"))).alias(name)
            for i, name in enumerate(probs)
        ],
    )
