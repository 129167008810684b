"""All registered queries."""

from __future__ import annotations

from arcseq.operators import comparison as cmp
from arcseq.operators import scoring as sc
from arcseq.operators import trial_table as tt
from arcseq.plans import checks, fits, models, streams, tables
from arcseq.plans.fixed import MAIN
from arcseq.plans.workspace import rr
from arcseq.session import release, ship
from arcseq.sources.trials import read_events, trials_from_events


def flagship(spark, sf_dir):
    """LL per trial of the independent mixture by subject, straight from the event log."""
    feat = tt.features(trials_from_events(read_events(spark, sf_dir)))
    scored = cmp.seq_scores(sc.score_mixture(feat, MAIN), ["subject_id", "session_id", "run_id"])
    return cmp.heldout_summary(scored, ["subject_id"]).select("subject_id", "n_trials", *rr("total_ll", "ll_per_trial", "perplexity"))


def _fresh(fn):
    def run(spark, sf_dir):
        ship(spark)
        release()
        return fn(spark, sf_dir)

    run.__name__ = fn.__name__
    return run


_ALL = {
    "slice_ll_by_subject": flagship,
    **tables.QUERIES,
    **models.QUERIES,
    **fits.QUERIES,
    **checks.QUERIES,
    **streams.QUERIES,
}
QUERIES = {name: _fresh(fn) for name, fn in _ALL.items()}
