"""SQL of the queries in arcseq/plans/streams.py: the same filters in batch form."""

from __future__ import annotations

from arcseq.plans import fixed
from oracles.base import K, circ, cte, pmod, query, r, rr
from oracles.models import FILT, chain_ctes, d, emission_cte

ORACLES: dict[str, str] = {}
cte(
    "so_angle",
    """SELECT *, CASE WHEN event_id % 13 = 0 THEN ((event_id * 37) % 360)::DOUBLE + 0.37::DOUBLE
WHEN ((day(ts) - 1) // 5) % 2 = 0 THEN motion_direction + sin(value) * 3.0::DOUBLE / motion_coherence
ELSE prior_mean + sin(value * 1.7::DOUBLE) * prior_std * 0.6::DOUBLE END AS angle FROM c_conditions WHERE event_id % 97 <> 0""",
)
cte(
    "so_rad",
    f"""SELECT event_id AS row_id, {K}, ts, motion_coherence, prior_std, radians({pmod(pmod('degrees(atan2(sin(radians(angle)), cos(radians(angle)))) + 360.0::DOUBLE', '360.0::DOUBLE'), '360.0::DOUBLE')}) AS y,
radians({pmod('motion_direction', '360.0::DOUBLE')}) AS theta, radians(225.0::DOUBLE) AS mu FROM so_angle""",
)
cte(
    "so_feat",
    f"""SELECT *, cos(error) AS cos_s, cos(prior_error) AS cos_p, row_number() OVER (PARTITION BY {K} ORDER BY ts, row_id) AS pos FROM (
SELECT *, {circ('y', 'theta')} AS error, {circ('y', 'mu')} AS prior_error, {circ('theta', 'mu')} AS conflict FROM so_rad)""",
)
emission_cte("so_e", "so_feat", "main")
chain_ctes("so", "so_e", K, [d(x) for x in fixed.PI], fixed.A, back=False)
ORACLES["st1_stream_filter"] = query(f"SELECT row_id, {K}, 0::BIGINT AS n_late, {rr(*FILT, 'll AS trial_ll')} FROM so_fwd")
emission_cte("so_se", "so_feat", "start")
cte(
    "so_mix",
    "SELECT *, " + ", ".join("ln(" + " + ".join(f"{d(w)}*exp(lb{i + 1})" for i, w in enumerate(row)) + f") AS mix{c}" for c, row in enumerate(fixed.CLASS_WEIGHTS)) + " FROM so_se",
)
cte(
    "so_past",
    "SELECT *, greatest(s0, s1, s2) AS sm FROM (SELECT *, "
    + ", ".join(f"coalesce(sum(mix{c}) OVER (PARTITION BY {K} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS s{c}" for c in range(3))
    + " FROM so_mix)",
)
cte("so_tau", "SELECT *, " + ", ".join(f"exp(s{c}-sm)/(exp(s0-sm)+exp(s1-sm)+exp(s2-sm)) AS tau_{c}" for c in range(3)) + " FROM so_past")
ORACLES["st2_stream_block"] = query(
    f"SELECT row_id, {K}, 0::BIGINT AS n_late, {rr('tau_0', 'tau_1', 'tau_2', 'ln(tau_0*exp(mix0) + tau_1*exp(mix1) + tau_2*exp(mix2)) AS trial_ll')} FROM so_tau"
)
WIN = f"(PARTITION BY {K} ORDER BY pos)"
ORACLES["st3_stream_covariates"] = query(
    f"""SELECT row_id, {K}, 0::BIGINT AS n_late, {r(f'coalesce(abs(lag(error) OVER {WIN}), 0.0)')} AS x_prev_error, {r(f'coalesce(abs(lag(conflict) OVER {WIN}), 0.0)')} AS x_prev_conflict,
{r(f'coalesce(lag(motion_coherence) OVER {WIN}, motion_coherence)')} AS x_prev_coherence FROM so_feat"""
)
