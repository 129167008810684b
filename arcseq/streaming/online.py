"""Causal scorers as stateful stream operators.

State per sequence is a few numbers. Rows of one sequence are processed in position order inside each
micro-batch (its size is bounded by the source's rate options); a row at or before the last position seen
is late: it is dropped and counted in the state, and the count travels on the sequence's next row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from arcseq.columns import STATES
from arcseq.operators.params import Params
from arcseq.operators.scoring import LOG_B, emissions
from arcseq.operators.trial_table import angles, usable_trials
from arcseq.session import new_path, ship
from arcseq.sources.trials import EVENT_SCHEMA, respond, run_of

KEYS = ["subject_id", "session_id", "run_id"]
VALUES = ["v0", "v1", "v2"]
KEY_SCHEMA = "subject_id bigint, session_id bigint, run_id bigint, row_id bigint, position bigint, n_late bigint, "


def event_trials(events: DataFrame) -> DataFrame:
    """Trials of an event stream. A stream cannot number its rows, so event time is the position, and the
    response rule alternates with the day instead of the trial number."""
    base = events.select(
        "event_id",
        "ts",
        "value",
        (F.col("user_id") % 12 + 1).cast("long").alias("subject_id"),
        F.col("user_id").alias("session_id"),
        run_of(F.col("ts")).alias("run_id"),
        F.dayofmonth("ts").cast("long").alias("trial_index"),
    )
    rows = angles(usable_trials(respond(base)))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return rows.withColumns({"row_id": F.col("event_id"), "position": micros, "event_time": F.col("ts").cast("timestamp")})


def read_event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        spark.readStream.schema(EVENT_SCHEMA)
        .option("pathGlobFilter", "events.parquet")
        .option("maxFilesPerTrigger", 1)
        .parquet(sf_dir)
    )


def _in_order(pdfs: Iterator[pd.DataFrame], last: tuple[int, int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Positions, row ids and values of the rows after the last (position, row id), in that order; number of late rows."""
    parts = list(pdfs)
    pos, rows = (np.concatenate([p[c].to_numpy() for p in parts]) for c in ("position", "row_id"))
    order = np.lexsort((rows, pos))
    if last is not None:
        order = order[(pos[order] > last[0]) | ((pos[order] == last[0]) & (rows[order] > last[1]))]
    values = np.concatenate([p[VALUES].to_numpy() for p in parts])[order]
    return pos[order], rows[order], values, len(pos) - len(order)


def _stateful(stream: DataFrame, values: list, fn, out: str, state: str, watermark: str | None) -> DataFrame:
    """Only keys, position, row id and three values go to the Python worker."""
    ship(stream.sparkSession)
    timeout = GroupStateTimeout.EventTimeTimeout if watermark else GroupStateTimeout.NoTimeout
    slim = stream.select(*KEYS, "event_time", "row_id", "position", *[c.alias(n) for c, n in zip(values, VALUES)])
    slim = slim.withWatermark("event_time", watermark) if watermark else slim.drop("event_time")
    return slim.groupBy(*KEYS).applyInPandasWithState(fn, KEY_SCHEMA + out, state, "append", timeout)


def _online(update, start: tuple, names: list[str], idle_ms: int | None):
    """Wrap `update(values, carried numbers, first) -> (columns, numbers)` with ordering, late rows and timeouts."""

    def fn(key, pdfs, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        carried = state.get if state.exists else (*start, None, None, 0)
        numbers, (at, row, late) = carried[:-3], carried[-3:]
        last = None if at is None else (at, row)
        pos, rows, values, dropped = _in_order(pdfs, last)
        late += dropped
        n = len(pos)
        if n:
            columns, numbers = update(values, numbers, last is None)
            last = (int(pos[-1]), int(rows[-1]))
        state.update((*map(float, numbers), *(last or (None, None)), late))
        if idle_ms is not None and n:
            state.setTimeoutTimestamp(max(last[0] // 1000, state.getCurrentWatermarkMs()) + idle_ms)
        if n:
            head = {k: np.full(n, v, dtype=np.int64) for k, v in zip(KEYS, key)}
            head |= {"row_id": rows, "position": pos, "n_late": np.full(n, late)}
            yield pd.DataFrame({**head, **dict(zip(names, columns.T))})

    return fn


def _state_schema(names: list[str]) -> str:
    return ", ".join(f"{n} double" for n in names) + ", last_position bigint, last_row bigint, n_late bigint"


FILTER_COLUMNS = [f"filtered_p_{s}" for s in STATES] + ["trial_ll"]


def stream_filter(stream: DataFrame, p: Params, watermark: str | None = None, idle_ms: int | None = None) -> DataFrame:
    """Online chain filter; state: filtered probabilities and last position."""
    pi, a = np.array(p.pi), np.array(p.A)

    def update(log_b, numbers, first):
        top = log_b.max(axis=1)
        b = np.exp(log_b - top[:, None])
        filt, scale = np.empty_like(b), np.empty(len(b))
        f = np.array(numbers)
        for t in range(len(b)):
            u = (pi if first and t == 0 else f @ a) * b[t]
            scale[t] = u.sum()
            f = filt[t] = u / scale[t]
        return np.column_stack([filt, np.log(scale) + top]), f

    names = ["f0", "f1", "f2"]
    fn = _online(update, (0.0, 0.0, 0.0), FILTER_COLUMNS, idle_ms)
    scored = emissions(stream, p)
    logs = [F.col(c) for c in LOG_B]
    return _stateful(scored, logs, fn, ", ".join(f"{c} double" for c in FILTER_COLUMNS), _state_schema(names), watermark)


def stream_block(stream: DataFrame, p: Params, watermark: str | None = None, idle_ms: int | None = None) -> DataFrame:
    """Online class posterior of the block mixture; state: accumulated log likelihood of each class."""
    log_w = np.log(np.array(p.class_weights))
    log_rho = np.log(np.array(p.rho))

    def update(log_b, numbers, first):
        joint = log_b[:, None, :] + log_w[None]
        mix = np.logaddexp.reduce(joint, axis=2)
        total = np.array(numbers) + np.cumsum(mix, axis=0)
        before = np.vstack([np.array(numbers)[None], total[:-1]])
        log_tau = log_rho + before
        log_tau -= np.logaddexp.reduce(log_tau, axis=1, keepdims=True)
        ll = np.logaddexp.reduce(log_tau + mix, axis=1)
        return np.column_stack([np.exp(log_tau), ll]), total[-1]

    names = ["s0", "s1", "s2"]
    cols = ["tau_0", "tau_1", "tau_2", "trial_ll"]
    fn = _online(update, (0.0, 0.0, 0.0), cols, idle_ms)
    logs = [F.col(c) for c in LOG_B]
    return _stateful(emissions(stream, p), logs, fn, ", ".join(f"{c} double" for c in cols), _state_schema(names), watermark)


def stream_covariates(stream: DataFrame, watermark: str | None = None, idle_ms: int | None = None) -> DataFrame:
    """Online previous-trial covariates; state: last error, conflict and coherence."""
    names = ["x_prev_error", "x_prev_conflict", "x_prev_coherence"]

    def update(own, numbers, first):
        start = np.array([0.0, 0.0, own[0, 2]]) if first else np.array(numbers)
        return np.vstack([start[None], own[:-1]]), own[-1]

    fn = _online(update, (0.0, 0.0, 0.0), names, idle_ms)
    own = [F.abs("error"), F.abs("conflict"), F.col("motion_coherence")]
    return _stateful(stream, own, fn, ", ".join(f"{c} double" for c in names), _state_schema(["e", "c", "h"]), watermark)


def run_to_table(stream: DataFrame) -> DataFrame:
    """Drain the stream into a parquet table of the shared folder and read it back."""
    spark = stream.sparkSession
    path, log = new_path(spark, "stream"), new_path(spark, "stream-log")
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start(path)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
