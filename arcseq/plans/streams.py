"""Registered queries: the online scorers drained over the event stream."""

from __future__ import annotations

from arcseq.columns import SEQ
from arcseq.plans.fixed import MAIN, START
from arcseq.plans.workspace import rr
from arcseq.streaming import online

QUERIES = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def source(spark, sf):
    return online.event_trials(online.read_event_stream(spark, sf))


@register
def st1_stream_filter(spark, sf):
    out = online.run_to_table(online.stream_filter(source(spark, sf), MAIN))
    return out.select("row_id", *SEQ, "n_late", *rr(*online.FILTER_COLUMNS))


@register
def st2_stream_block(spark, sf):
    out = online.run_to_table(online.stream_block(source(spark, sf), START))
    return out.select("row_id", *SEQ, "n_late", *rr("tau_0", "tau_1", "tau_2", "trial_ll"))


@register
def st3_stream_covariates(spark, sf):
    out = online.run_to_table(online.stream_covariates(source(spark, sf)))
    return out.select("row_id", *SEQ, "n_late", *rr("x_prev_error", "x_prev_conflict", "x_prev_coherence"))
