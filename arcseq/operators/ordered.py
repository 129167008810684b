"""Ordered operations on groups of any size.

A group that is ordered by `by` is cut into pieces whose order agrees with `by`. Windows run inside
(group, piece); a table with one row per piece carries running values and last values across borders.
The same step is applied to that table again while more than one piece column is left, so no task ever
sorts a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcseq import columns

_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _combine(kind: str, local: Column, carry: Column) -> Column:
    if kind == "sum":
        return F.coalesce(local, carry * 0) + F.coalesce(carry, local * 0)
    return F.greatest(local, carry) if kind == "max" else F.least(local, carry)


def _window(parts: list[str], by: list[str], backward: bool = False):
    return Window.partitionBy(*parts).orderBy(*[F.desc(c) if backward else F.asc(c) for c in by])


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where a null equals a null; the keys come from the left."""
    own = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    joined = left.join(own, met, how)
    return joined if how == "left_semi" else joined.drop(*[f"__r_{k}" for k in keys])


def one_key(df: DataFrame, parts: list[str]) -> DataFrame:
    """`parts` as one struct, which is never null and equal where a null meets a null: a window and a join on it need the same
    partitioning, so that rows ranked by piece are not shuffled again to meet what crosses the borders of their piece."""
    return df.withColumn("__key", F.struct(*parts))


def at_key(local: DataFrame, carry: DataFrame, parts: list[str]) -> DataFrame:
    own = carry.select(F.struct(*parts).alias("__r_key"), *[c for c in carry.columns if c not in parts])
    return local.join(own, F.col("__key") == F.col("__r_key")).drop("__key", "__r_key")


def running(
    df: DataFrame,
    keys: list[str],
    pieces: list[str],
    by: list[str],
    outs: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    backward: bool = False,
) -> DataFrame:
    """Running sum, max or min per group; `outs` maps a new column to (kind, expression)."""
    first = Window.unboundedPreceding
    w = _window(["__key"] if pieces else keys, by, backward).rowsBetween(first, 0 if inclusive else -1)
    local = one_key(df, keys + pieces) if pieces else df
    local = local.withColumns({n: _AGG[k](c).over(w) for n, (k, c) in outs.items()})
    if not pieces:
        return local
    totals = df.groupBy(*keys, *pieces).agg(*[_AGG[k](c).alias(n) for n, (k, c) in outs.items()])
    carry = running(
        totals,
        keys,
        pieces[:-1],
        [pieces[-1]],
        {f"__{n}": (k, F.col(n)) for n, (k, _) in outs.items()},
        inclusive=False,
        backward=backward,
    ).drop(*outs)
    joined = at_key(local, carry, keys + pieces)
    return joined.withColumns(
        {n: _combine(k, F.col(n), F.col(f"__{n}")) for n, (k, _) in outs.items()}
    ).drop(*[f"__{n}" for n in outs])


def previous(
    df: DataFrame, keys: list[str], pieces: list[str], by: list[str], outs: dict[str, Column]
) -> DataFrame:
    """Value of the preceding row of the group (null at its start)."""
    w = _window(["__key"] if pieces else keys, by)
    local = one_key(df, keys + pieces) if pieces else df
    local = local.withColumns({n: F.lag(c).over(w) for n, c in outs.items()})
    if not pieces:
        return local
    local = local.withColumn("__head", F.row_number().over(w) == 1)
    rank = F.col(by[0]) if len(by) == 1 else F.struct(*by)
    lasts = df.groupBy(*keys, *pieces).agg(*[F.max_by(c, rank).alias(n) for n, c in outs.items()])
    carry = previous(lasts, keys, pieces[:-1], [pieces[-1]], {f"__{n}": F.col(n) for n in outs}).drop(*outs)
    joined = at_key(local, carry, keys + pieces)
    return joined.withColumns(
        {n: F.when(F.col("__head"), F.col(f"__{n}")).otherwise(F.col(n)) for n in outs}
    ).drop("__head", *[f"__{n}" for n in outs])


def in_sequence(
    df: DataFrame,
    keys: list[str],
    piece: str,
    by: str,
    prev: dict[str, Column] | None = None,
    pos: str = "pos",
    length: str = "seq_len",
) -> DataFrame:
    """Position (1-based), group length and preceding values in a single pass over the pieces."""
    prev = prev or {}
    w = _window(["__key"], [by])
    local = one_key(df, keys + [piece]).withColumns({pos: F.row_number().over(w), **{n: F.lag(c).over(w) for n, c in prev.items()}})
    summary = df.groupBy(*keys, piece).agg(
        F.count(F.lit(1)).alias("__n"), *[F.max_by(c, by).alias(f"__{n}") for n, c in prev.items()]
    )
    wk = _window(keys, [piece])
    carry = summary.select(
        *keys,
        piece,
        F.coalesce(F.sum("__n").over(wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"),
        F.sum("__n").over(Window.partitionBy(*keys)).alias(length),
        *[F.lag(f"__{n}").over(wk).alias(f"__{n}") for n in prev],
    )
    joined = at_key(local, carry, keys + [piece])
    return joined.withColumns(
        {
            **{n: F.when(F.col(pos) == 1, F.col(f"__{n}")).otherwise(F.col(n)) for n in prev},
            pos: F.col(pos) + F.col("__offset"),
        }
    ).drop("__offset", *[f"__{n}" for n in prev])


def spread(df: DataFrame, keys: list[str], fine: Column, name: str, limit: int | None = None) -> DataFrame:
    """Add a piece column: `fine` for groups above `limit` rows, null (one piece) for all others.

    `fine` must never fall as the order in use rises; a null comes first, as it does in the order. There are at most
    rows/limit hot groups, so the joined table is broadcast and the rows are not shuffled to meet it.
    """
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > (limit or columns.HOT_GROUP_ROWS))
    hot = hot.select(*keys, F.lit(True).alias("__hot"))
    return same_keys(df, F.broadcast(hot), keys, "left").withColumn(name, F.when(F.col("__hot"), fine)).drop("__hot")


def rank_in_group(df: DataFrame, keys: list[str], by: list[str], fine: Column, name: str) -> DataFrame:
    """Row number per group for groups of any size; `fine` is a coarse key of the order."""
    cut = spread(df, keys, fine, "__piece")
    return running(cut, keys, ["__piece"], by, {name: ("sum", F.lit(1).cast("long"))}).drop("__piece")


def per_chunk(table: DataFrame, chunks: str = "chunks", chunk: str = "chunk") -> DataFrame:
    """Repeat one row per sequence for each chunk that the sequence has (the array `chunks`), so that joining it to rows
    on (sequence, chunk) does not gather a long sequence in one task."""
    return table.withColumn(chunk, F.explode(F.col(chunks))).drop(chunks)
