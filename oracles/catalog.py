"""SQL of every registered query that SQL can state."""

from __future__ import annotations

from oracles import checks, fits, models, streams, tables
from oracles.base import query, rr

ORACLES: dict[str, str] = {
    "slice_ll_by_subject": query(
        f"SELECT subject_id, count(*) AS n_trials, {rr('sum(ll) AS total_ll', 'avg(ll) AS ll_per_trial', 'exp(-avg(ll)) AS perplexity')} FROM mix GROUP BY subject_id"
    ),
    **tables.ORACLES,
    **models.ORACLES,
    **fits.ORACLES,
    **checks.ORACLES,
    **streams.ORACLES,
}
