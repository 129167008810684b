"""SQL of the queries in arcseq/plans/checks.py."""

from __future__ import annotations

import re

from arcseq.plans import fixed
from arcseq.plans.checks import N_COVERED, N_REP
from oracles.base import CTES, K, circ, cte, query, r, relative, rr
from oracles.models import argmax, chain_ctes, d, emission_cte, runs_cte

ORACLES: dict[str, str] = {}


def add(name: str, sql: str) -> None:
    ORACLES[name] = query(sql)


KS = "simulation, " + K
cte("rep_sims", f"SELECT CAST(s AS INT) AS simulation FROM range({N_REP}) t(s)")
cte(
    "rep_donor",
    f"""SELECT simulation, {K}, estimate_deg, y, row_number() OVER (PARTITION BY {KS} ORDER BY md5(concat_ws('|', '17', simulation::VARCHAR, row_id::VARCHAR))) AS pos FROM feat CROSS JOIN rep_sims""",
)
BASE = "row_id, {k}, trial_index, pos, motion_direction, motion_coherence, prior_std, prior_mean"
cte(
    "rep_rows",
    f"""SELECT f.row_id, {', '.join('f.' + k for k in K.split(', '))}, f.trial_index, f.pos, f.motion_direction, f.motion_coherence, f.prior_std, f.prior_mean, f.theta, f.mu,
rd.simulation, rd.estimate_deg, rd.y FROM feat f JOIN rep_donor rd ON {' AND '.join(f'f.{k} = rd.{k}' for k in K.split(', '))} AND f.pos = rd.pos""",
)
cte(
    "comb",
    f"""SELECT 'observed' AS source, -1 AS simulation, {BASE.format(k=K)}, estimate_deg, y, error, prior_error, cos_s, cos_p FROM feat
UNION ALL SELECT 'simulated', simulation, {BASE.format(k=K)}, estimate_deg, y, {circ('y', 'theta')}, {circ('y', 'mu')}, cos({circ('y', 'theta')}), cos({circ('y', 'mu')}) FROM rep_rows""",
)
emission_cte("comb_e", "comb", "main")
chain_ctes("dec", "comb_e", KS, [d(x) for x in fixed.PI], fixed.A)
cte("decd", f"SELECT *, {argmax('g1', 'g2', 'g3')} AS decoded_state FROM dec_post")
cte("kept", "SELECT * FROM decd WHERE decoded_state <> 'lapse'")
M5 = ["mean_abs_error_deg", "median_abs_error_deg", "mean_cos_error", "circular_std_error_deg", "prior_like_rate"]
for tag, src in (("all", "comb"), ("kept", "kept")):
    cte(
        f"met_{tag}",
        f"""SELECT source, simulation, motion_coherence, prior_std, count(*) AS n, avg(degrees(abs(error))) AS mean_abs_error_deg, median(degrees(abs(error))) AS median_abs_error_deg,
avg(cos(error)) AS mean_cos_error, degrees(sqrt(-2 * ln(least(greatest(sqrt(avg(cos(error))^2 + avg(sin(error))^2), 1e-12), 1.0)))) AS circular_std_error_deg,
avg(CASE WHEN abs(prior_error) < abs(error) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS prior_like_rate FROM {src} GROUP BY source, simulation, motion_coherence, prior_std""",
    )
    cte(
        f"metl_{tag}",
        " UNION ALL ".join(f"SELECT source, simulation, motion_coherence, prior_std, '{m}' AS metric, {m} AS v FROM met_{tag}" for m in M5),
    )
    cte(
        f"met_iv_{tag}",
        f"""SELECT motion_coherence, prior_std, metric, max(CASE WHEN source = 'observed' THEN v END) AS observed, avg(CASE WHEN source = 'simulated' THEN v END) AS simulated_mean,
quantile_cont(v, 0.025) FILTER (source = 'simulated') AS simulated_ci_low, quantile_cont(v, 0.975) FILTER (source = 'simulated') AS simulated_ci_high
FROM metl_{tag} GROUP BY motion_coherence, prior_std, metric""",
    )
    cte(
        f"cov_{tag}",
        f"""SELECT 'static_hmm' AS model, metric, count(*) AS cells, CAST(count(*) FILTER (round(observed, 9) BETWEEN round(simulated_ci_low, 9) AND round(simulated_ci_high, 9)) AS BIGINT) AS covered FROM met_iv_{tag} GROUP BY metric""",
    )
COND = rr("motion_coherence", "prior_std")
IV = ["observed", "simulated_mean", "simulated_ci_low", "simulated_ci_high"]
add(
    "u1_union_sources",
    f"""SELECT 'observed' AS source, -1 AS simulation, row_id, NULL::VARCHAR AS state, {rr('estimate_deg', 'reaction_time')} FROM feat
UNION ALL SELECT 'simulated', 0, row_id, 'sensory', {r('estimate_deg')}, NULL FROM feat""",
)
add("b7_metrics", f"SELECT source, simulation, {COND}, n, {rr(*M5)} FROM met_all")
add("b8_metrics", f"SELECT source, simulation, {COND}, n, {rr(*M5)} FROM met_kept")
cte(
    "comb_bins",
    f"""SELECT source, simulation, motion_coherence, prior_std, reference, CAST(least(floor((rel + 180.0) / 15.0), 23) AS INT) AS bin FROM (
SELECT source, simulation, motion_coherence, prior_std, 'stimulus' AS reference, {relative('error')} AS rel FROM comb
UNION ALL SELECT source, simulation, motion_coherence, prior_std, 'prior', {relative('prior_error')} FROM comb)""",
)
CG = "source, simulation, motion_coherence, prior_std, reference"
cte(
    "comb_hist",
    f"""SELECT {', '.join('g.' + c for c in CG.split(', '))}, (b * 15 - 180)::DOUBLE AS bin_left_deg, (b * 15 - 165)::DOUBLE AS bin_right_deg, coalesce(h.n, 0) AS count, coalesce(h.n, 0)::DOUBLE / g.total AS proportion
FROM (SELECT {CG}, count(*) AS total FROM comb_bins GROUP BY {CG}) g CROSS JOIN range(24) t(b)
LEFT JOIN (SELECT {CG}, bin, count(*) AS n FROM comb_bins GROUP BY {CG}, bin) h ON {' AND '.join(f'h.{c} = g.{c}' for c in CG.split(', '))} AND h.bin = b""",
)
add("b7_histograms", f"SELECT source, simulation, {COND}, reference, bin_left_deg, bin_right_deg, count, {r('proportion')} AS proportion FROM comb_hist")
add(
    "j9_join_observed",
    f"""SELECT s.simulation, {rr('s.motion_coherence AS motion_coherence', 's.prior_std AS prior_std', *[f's.{m} AS {m}' for m in M5], *[f'o.{m} AS observed_{m}' for m in M5])}
FROM met_all s JOIN met_all o ON o.source = 'observed' AND s.source = 'simulated' AND o.motion_coherence = s.motion_coherence AND o.prior_std = s.prior_std""",
)
add(
    "a19_metric_intervals",
    f"""SELECT {COND}, motion_coherence::VARCHAR || '/' || prior_std::INT::VARCHAR AS condition, metric, {rr(*IV, 'observed - simulated_mean AS observed_minus_simulated')} FROM met_iv_all""",
)
add(
    "a20_histogram_intervals",
    f"""SELECT {COND}, reference, {rr('bin_left_deg', 'bin_right_deg', '(bin_left_deg + bin_right_deg) / 2 AS bin_center_deg', *IV)} FROM (
SELECT motion_coherence, prior_std, reference, bin_left_deg, bin_right_deg, max(CASE WHEN source = 'observed' THEN proportion END) AS observed, avg(CASE WHEN source = 'simulated' THEN proportion END) AS simulated_mean,
quantile_cont(proportion, 0.025) FILTER (source = 'simulated') AS simulated_ci_low, quantile_cont(proportion, 0.975) FILTER (source = 'simulated') AS simulated_ci_high
FROM comb_hist GROUP BY motion_coherence, prior_std, reference, bin_left_deg, bin_right_deg)""",
)
# the same tables over N_COVERED replicates
MANY = ["rep_sims", "rep_donor", "rep_rows", "comb", "met_all", "metl_all", "met_iv_all"]
for table in MANY:
    cte(f"{table}_many", re.sub(rf"\b({'|'.join(MANY)})\b", r"\1_many", CTES[table]))
cte("rep_sims_many", f"SELECT CAST(s AS INT) AS simulation FROM range({N_COVERED}) t(s)")
add("p8_covered", f"SELECT {COND}, metric, round(observed, 9) BETWEEN round(simulated_ci_low, 9) AND round(simulated_ci_high, 9) AS covered FROM met_iv_all_many")
add("a18_coverage", f"SELECT model, metric, cells, covered, {r('covered::DOUBLE / cells')} AS coverage_rate FROM cov_all")
add(
    "a21_coverage_change",
    """SELECT model, after_cells, after_covered, before_cells, before_covered, CASE WHEN after_covered > before_covered THEN 'improved' WHEN after_covered < before_covered THEN 'deteriorated' ELSE 'did not change' END AS direction
FROM (SELECT model, CAST(sum(cells) AS BIGINT) AS after_cells, CAST(sum(covered) AS BIGINT) AS after_covered FROM cov_kept GROUP BY model)
JOIN (SELECT model, CAST(sum(cells) AS BIGINT) AS before_cells, CAST(sum(covered) AS BIGINT) AS before_covered FROM cov_all GROUP BY model) USING (model)""",
)
add("b8_decoded_states", "SELECT source, simulation, row_id, decoded_state FROM decd")
cte(
    "ret",
    """SELECT source, simulation, motion_coherence, prior_std, s AS decoded_state, CAST(count(*) FILTER (decoded_state = s) AS BIGINT) AS n, count(*) AS condition_n
FROM decd CROSS JOIN (VALUES ('sensory'), ('prior'), ('lapse')) t(s) GROUP BY source, simulation, motion_coherence, prior_std, s""",
)
add(
    "a16_retention",
    f"SELECT source, simulation, {COND}, decoded_state, n, condition_n, {r('n::DOUBLE / condition_n')} AS fraction_of_condition, decoded_state <> 'lapse' AS retained FROM ret",
)
cte(
    "ret_tot",
    """SELECT source, simulation, motion_coherence, prior_std, CAST(sum(n) AS BIGINT) AS total_n, CAST(sum(CASE WHEN decoded_state <> 'lapse' THEN n ELSE 0 END) AS BIGINT) AS retained_n FROM ret GROUP BY ALL""",
)
add(
    "a16_retention_summary",
    f"""SELECT {COND}, max(CASE WHEN source = 'observed' THEN total_n END) AS observed_total_n, max(CASE WHEN source = 'observed' THEN retained_n END) AS observed_retained_n,
{r("max(CASE WHEN source = 'observed' THEN rate END)")} AS observed_retained_rate, {r("avg(retained_n) FILTER (source = 'simulated')")} AS simulated_retained_n_mean,
{r("avg(rate) FILTER (source = 'simulated')")} AS simulated_retained_rate_mean, {r("quantile_cont(rate, 0.025) FILTER (source = 'simulated')")} AS simulated_retained_rate_ci_low,
{r("quantile_cont(rate, 0.975) FILTER (source = 'simulated')")} AS simulated_retained_rate_ci_high FROM (SELECT *, retained_n::DOUBLE / total_n AS rate FROM ret_tot) z GROUP BY z.motion_coherence, z.prior_std""",
)
add(
    "a17_confusion",
    f"""SELECT simulation, a AS generating_state, b AS decoded_state, n, CAST(sum(n) OVER (PARTITION BY simulation, a) AS BIGINT) AS generating_state_n, {r('n::DOUBLE / sum(n) OVER (PARTITION BY simulation, a)')} AS fraction_within_generating_state
FROM (SELECT sm.simulation, a, b, CAST(count(*) FILTER (ob.decoded_state = a AND sm.decoded_state = b) AS BIGINT) AS n FROM decd sm JOIN decd ob ON ob.row_id = sm.row_id AND ob.source = 'observed' AND sm.source = 'simulated'
CROSS JOIN (VALUES ('sensory'), ('prior'), ('lapse')) ta(a) CROSS JOIN (VALUES ('sensory'), ('prior'), ('lapse')) tb(b) GROUP BY sm.simulation, a, b)""",
)
add(
    "u2_missing_cells",
    "SELECT DISTINCT subject_id, motion_direction, prior_std FROM decd EXCEPT SELECT subject_id, motion_direction, prior_std FROM decd WHERE decoded_state = 'prior' AND source = 'observed'",
)
runs_cte("dec_runs", "decd", KS, "trial_index", "decoded_state")
cte("dec_runs_s", "SELECT *, CASE WHEN simulation < 0 THEN 'observed' ELSE 'simulated' END AS source FROM dec_runs")
add(
    "a22_run_length_summary",
    f"""SELECT source, decoded_state AS state, count(*) AS n_runs, {rr('avg(run_length) AS mean_run_length', 'median(run_length) AS median_run_length', 'quantile_cont(run_length, 0.9) AS q90_run_length')} FROM dec_runs_s GROUP BY source, decoded_state""",
)
cte(
    "run_stats",
    """SELECT source, simulation, decoded_state AS state, avg(run_length) AS m, median(run_length)::DOUBLE AS md, quantile_cont(run_length, 0.9)::DOUBLE AS q FROM dec_runs_s GROUP BY source, simulation, decoded_state""",
)
add(
    "a23_run_length_calibration",
    " UNION ALL ".join(
        f"""SELECT state, '{n}' AS metric, {rr(f"max({c}) FILTER (source = 'observed') AS observed", f"avg({c}) FILTER (source = 'simulated') AS simulated_mean", f"quantile_cont({c}, 0.025) FILTER (source = 'simulated') AS simulated_ci_low", f"quantile_cont({c}, 0.975) FILTER (source = 'simulated') AS simulated_ci_high")} FROM run_stats GROUP BY state"""
        for n, c in (("mean", "m"), ("median", "md"), ("q90", "q"))
    ),
)
