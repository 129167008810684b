"""SQL of the queries in arcseq/plans/tables.py."""

from __future__ import annotations

from oracles.base import K, TWO_PI, W, circ, cte, md5_int, pmod, query, r, relative, rr

ORACLES: dict[str, str] = {}


def add(name: str, sql: str) -> None:
    ORACLES[name] = query(sql)


add("s1_scan", "SELECT event_id AS row_id, user_id, event_type, value, CAST(day(ts) AS INT) AS day FROM events")
add("s1_row_numbers", f"SELECT CAST(row_number() OVER (ORDER BY ts, event_id) AS BIGINT) AS row_id, event_id, {rr('value')} FROM events")
add(
    "s2_canonical_fields",
    f"SELECT row_id, {K}, trial_index, {rr('motion_direction', 'motion_coherence', 'prior_std', 'prior_mean', 'estimate_x', 'estimate_y')} FROM c_trials",
)
add(
    "s5_union_shards",
    f"SELECT row_id, {K}, CASE WHEN run_id <= 2 THEN run_id END AS shard FROM c_trials",
)
add(
    "s6_trials_from_events",
    f"""SELECT row_id, {K}, trial_index, experiment_name, experiment_id,
{rr('trial_time', 'response_arrow_start_angle', 'motion_direction', 'motion_coherence', 'estimate_x', 'estimate_y', 'reaction_time', 'raw_response_time', 'prior_std', 'prior_mean')}
FROM c_trials""",
)
add("p1_usable_trials", f"SELECT row_id, {K}, trial_index FROM c_usable")
add(
    "p2_excluded_trials",
    f"""SELECT row_id, {K}, trial_index, concat_ws(';', CASE WHEN estimate_x IS NULL THEN 'missing_estimate_x' END,
CASE WHEN estimate_y IS NULL THEN 'missing_estimate_y' END, CASE WHEN motion_direction IS NULL THEN 'missing_motion_direction' END,
CASE WHEN motion_coherence IS NULL THEN 'missing_motion_coherence' END, CASE WHEN prior_std IS NULL THEN 'missing_prior_std' END,
CASE WHEN prior_mean IS NULL THEN 'missing_prior_mean' END) AS exclusion_reason
FROM c_trials WHERE estimate_x IS NULL OR estimate_y IS NULL OR motion_direction IS NULL OR motion_coherence IS NULL
OR prior_std IS NULL OR prior_mean IS NULL""",
)
add(
    "p3_missing_report",
    f"""SELECT row_id, {K}, trial_index, printf('s%02d_session%03d_run%03d', {K}) AS block_id,
estimate_x IS NULL AS estimate_x_missing, estimate_y IS NULL AS estimate_y_missing, preceding_valid_trial_index, following_valid_trial_index
FROM (SELECT *, max(CASE WHEN estimate_x IS NOT NULL AND estimate_y IS NOT NULL THEN trial_index END) OVER {W} AS preceding_valid_trial_index,
 min(CASE WHEN estimate_x IS NOT NULL AND estimate_y IS NOT NULL THEN trial_index END) OVER
   (PARTITION BY {K} ORDER BY trial_index DESC) AS following_valid_trial_index FROM c_trials)
WHERE estimate_x IS NULL OR estimate_y IS NULL""",
)
BASE = [
    "trial_time", "motion_direction AS motion_direction_deg", "motion_coherence", "prior_mean AS prior_mean_deg",
    "prior_std AS prior_std_deg", "response_arrow_start_angle AS response_arrow_start_angle_deg", "estimate_x", "estimate_y",
    "estimate_deg AS estimated_direction_deg", "reaction_time", "raw_response_time",
    "degrees(error) AS signed_stimulus_error_deg", "abs(degrees(error)) AS absolute_stimulus_error_deg",
    "degrees(prior_error) AS response_minus_prior_deg", "abs(degrees(prior_error)) AS absolute_prior_error_deg",
    "degrees(conflict) AS signed_stimulus_prior_conflict_deg", "abs(degrees(conflict)) AS stimulus_prior_conflict_deg",
]
PREV = [
    "prev_motion_direction AS previous_motion_direction_deg", "prev_estimate_deg AS previous_estimated_direction_deg",
    "degrees(prev_error) AS previous_signed_stimulus_error_deg", "abs(degrees(prev_error)) AS previous_absolute_stimulus_error_deg",
    "abs(degrees(prev_conflict)) AS previous_stimulus_prior_conflict_deg", "prev_motion_coherence AS previous_coherence",
]
add(
    "p4_trial_base",
    f"""SELECT row_id AS raw_row_index, CAST(row_number() OVER (ORDER BY {K}, trial_index) - 1 AS BIGINT) AS analysis_row_index,
CAST(dense_rank() OVER (ORDER BY {K}) - 1 AS BIGINT) AS seq_id, {K}, run_id AS block_id, trial_index, pos - 1 AS sequence_trial_index,
seq_len AS sequence_length, experiment_name, experiment_id, is_start AS is_sequence_start, {rr(*BASE, *PREV)} FROM feat""",
)
wrap = lambda x: f"({pmod(f'({x}) + 3.141592653589793::DOUBLE', TWO_PI + '::DOUBLE')} - 3.141592653589793::DOUBLE)"
add(
    "p5_prior_centred",
    f"""SELECT row_id, {r(wrap('radians(motion_direction) - radians(prior_mean)'))} AS x_rad,
{r(wrap('atan2(estimate_y, estimate_x) - radians(prior_mean)'))} AS y_rad FROM c_usable""",
)
add(
    "p6_level_index",
    """SELECT row_id, CAST(dense_rank() OVER (ORDER BY motion_coherence) - 1 AS BIGINT) AS motion_coherence_idx,
CAST(dense_rank() OVER (ORDER BY prior_std) - 1 AS BIGINT) AS prior_std_idx,
CAST(dense_rank() OVER (ORDER BY subject_id) - 1 AS BIGINT) AS subject_id_idx FROM feat""",
)
cte(
    "folds",
    f"""SELECT *, CAST((rk - 1 + {md5_int("concat_ws('|', '42', subject_id::VARCHAR, prior_std::BIGINT::VARCHAR)")}) % 4 AS INT) AS fold
FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, prior_std ORDER BY md5(concat_ws('|', '42', subject_id::VARCHAR, session_id::VARCHAR, run_id::VARCHAR))) AS rk
FROM seqs)""",
)
cte(
    "block_cuts",
    f"""SELECT {K}, n, (CASE WHEN br > floor(0.40::DOUBLE * nb) THEN 1 ELSE 0 END) + (CASE WHEN br > floor(0.55::DOUBLE * nb) THEN 1 ELSE 0 END)
+ (CASE WHEN br > floor(0.70::DOUBLE * nb) THEN 1 ELSE 0 END) + (CASE WHEN br > floor(0.85::DOUBLE * nb) THEN 1 ELSE 0 END) AS epoch
FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY session_id, run_id) AS br, count(*) OVER (PARTITION BY subject_id) AS nb FROM seqs)""",
)
cte(
    "chrono",
    f"""SELECT {K}, n, CAST(split_id AS INT) AS split_id, CASE WHEN split_id = epoch THEN 'test' ELSE 'train' END AS role
FROM block_cuts, range(1, 5) t(split_id) WHERE split_id >= epoch""",
)
add("j2_attach_folds", f"SELECT row_id, fold FROM feat JOIN folds USING ({K})")
add("j3_attach_segments", f"SELECT t.row_id, {', '.join('t.' + k for k in (K + ', trial_index').split(', '))}, segment_id, segment_number FROM c_trials t JOIN segs USING (row_id)")
add("j4_rows_in_split", f"SELECT row_id, {K} FROM feat SEMI JOIN (SELECT * FROM chrono WHERE split_id = 2 AND role = 'test') USING ({K})")
add(
    "j7_complete_counts",
    """SELECT d.motion_direction, p.prior_std, s.state, count(f.row_id) AS n
FROM (SELECT DISTINCT motion_direction FROM feat) d CROSS JOIN (SELECT DISTINCT prior_std FROM feat) p
CROSS JOIN (VALUES ('sensory'), ('prior'), ('lapse')) s(state)
LEFT JOIN (SELECT *, CASE WHEN abs(error) < 0.2::DOUBLE THEN 'sensory' WHEN abs(prior_error) < 0.1::DOUBLE THEN 'prior' ELSE 'lapse' END AS state FROM feat) f
ON f.motion_direction = d.motion_direction AND f.prior_std = p.prior_std AND f.state = s.state GROUP BY ALL""",
)
add("a1_sequences", f"SELECT {K}, n, {rr('prior_std')} FROM seqs")
add(
    "a2_dataset_summary",
    f"""SELECT (SELECT count(*) FROM c_trials) AS raw_rows, count(*) AS usable_trials, count(DISTINCT subject_id) AS subjects,
count(DISTINCT (subject_id, session_id)) AS sessions, count(DISTINCT ({K})) AS sequences, count(DISTINCT motion_coherence) AS coherence_levels,
count(DISTINCT prior_std) AS prior_width_levels, (SELECT median(n)::DOUBLE FROM seqs) AS median_trials_per_sequence,
(SELECT count(*) FROM c_trials) - count(*) AS dropped_rows FROM feat""",
)
cte(
    "blocks",
    f"""SELECT {K}, count(*) AS n_trials, count(DISTINCT prior_std) AS prior_std_unique_count, count(DISTINCT prior_mean) AS prior_mean_unique_count,
count(DISTINCT experiment_id) AS experiment_id_unique_count, min(trial_index) AS trial_index_min, max(trial_index) AS trial_index_max
FROM c_trials GROUP BY {K}""",
)
add("a3_block_table", "SELECT * FROM blocks")
add(
    "a3_block_audit",
    """SELECT count(DISTINCT subject_id) AS number_of_subjects, count(DISTINCT (subject_id, session_id)) AS number_of_subject_session_pairs,
count(DISTINCT run_id) AS number_of_run_id_values, count(*) AS number_of_model_blocks, min(n_trials) AS block_length_min,
median(n_trials)::DOUBLE AS block_length_median, max(n_trials) AS block_length_max,
max(prior_std_unique_count) AS max_prior_std_unique_within_block, max(prior_mean_unique_count) AS max_prior_mean_unique_within_block,
max(experiment_id_unique_count) AS max_experiment_unique_within_block, bool_and(trial_index_min = 1) AS trial_index_resets_to_one_in_all_blocks FROM blocks""",
)
add(
    "a4_integrity_checks",
    f"""SELECT (SELECT count(*) FROM blocks WHERE trial_index_min <> 1) AS blocks_not_starting_at_one,
(SELECT count(*) FROM blocks WHERE prior_std_unique_count <> 1 OR prior_mean_unique_count <> 1 OR experiment_id_unique_count <> 1) AS blocks_mixing_conditions,
(SELECT count(*) FROM (SELECT {K}, trial_index FROM (SELECT * FROM c_trials UNION ALL SELECT * FROM c_trials WHERE row_id % 50 = 0)
 GROUP BY {K}, trial_index HAVING count(*) > 1)) AS duplicate_trial_keys""",
)
METRICS = f"""count(*) AS n, {r('degrees(atan2(avg(sin(error)), avg(cos(error))))')} AS mean_signed_error_deg,
{r('avg(degrees(abs(error)))')} AS mean_abs_error_deg, {r('median(degrees(abs(error)))')} AS median_abs_error_deg,
{r('avg(cos(error))')} AS mean_cos_error,
{r('degrees(sqrt(-2 * ln(least(greatest(sqrt(avg(cos(error))^2 + avg(sin(error))^2), 1e-12), 1.0))))')} AS circular_std_error_deg,
{r('avg(CASE WHEN abs(prior_error) < abs(error) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS prior_like_rate"""
add(
    "a5_condition_metrics",
    f"""SELECT {rr('motion_coherence', 'prior_std')}, n, mean_signed_error_deg, mean_abs_error_deg, median_abs_error_deg, mean_cos_error,
circular_std_error_deg, prior_like_rate FROM (SELECT motion_coherence, prior_std, {METRICS} FROM feat GROUP BY ALL)""",
)
cte(
    "rel_bins",
    f"""SELECT motion_coherence, prior_std, reference, least(floor((rel + 180.0) / 15.0), 23) AS bin FROM (
SELECT motion_coherence, prior_std, 'stimulus' AS reference, {relative('error')} AS rel FROM feat
UNION ALL SELECT motion_coherence, prior_std, 'prior', {relative('prior_error')} FROM feat)""",
)
add(
    "a6_response_histograms",
    f"""SELECT {rr('c.motion_coherence AS motion_coherence', 'c.prior_std AS prior_std')}, c.reference, (b * 15 - 180)::DOUBLE AS bin_left_deg,
(b * 15 - 165)::DOUBLE AS bin_right_deg, (b * 15 - 172.5)::DOUBLE AS bin_center_deg, count(rel_bins.bin) AS count,
{r('count(rel_bins.bin)::DOUBLE / c.total')} AS proportion
FROM (SELECT motion_coherence, prior_std, reference, count(*) AS total FROM rel_bins GROUP BY ALL) c CROSS JOIN range(24) t(b)
LEFT JOIN rel_bins ON rel_bins.motion_coherence = c.motion_coherence AND rel_bins.prior_std = c.prior_std AND rel_bins.reference = c.reference AND rel_bins.bin = b
GROUP BY c.motion_coherence, c.prior_std, c.reference, c.total, b""",
)
add("w1_sequence_position", "SELECT row_id, pos, seq_len, is_start FROM feat")
XS = ["x_coherence", "x_prior_precision", "x_conflict", "x_prev_error", "x_prev_conflict", "x_prev_coherence"]
add("w2_transition_covariates", f"SELECT row_id, {rr(*XS)} FROM covs")
add("w3_serial_previous", f"SELECT row_id, {rr('coalesce(prev_theta, theta) AS serial_theta', 'coalesce(prev_y, y) AS serial_y')} FROM feat")
add("w4_previous_fields", f"SELECT row_id, {rr(*PREV)} FROM feat")
add("w5_split_segments", "SELECT row_id, segment_number, segment_id, block_id FROM segs")
add(
    "w9_contiguity",
    f"""SELECT row_id, printf('s%02d_session%03d_run%03d', {K}) AS block_id,
CAST(row_number() OVER (PARTITION BY subject_id ORDER BY session_id, run_id, trial_index) AS BIGINT) AS global_trial, pos = 1 AS is_block_start FROM feat""",
)
add(
    "w9_non_contiguous_blocks",
    f"""SELECT subject_id, block_id, sum(CASE WHEN before IS NULL OR before <> block_id THEN 1 ELSE 0 END)::BIGINT AS n_starts FROM (
SELECT subject_id, block_id, lag(block_id) OVER (PARTITION BY subject_id ORDER BY row_id) AS before
FROM (SELECT *, printf('s%02d_session%03d_run%03d', {K}) AS block_id FROM feat)) GROUP BY subject_id, block_id HAVING n_starts > 1""",
)
add(
    "s2_csv_scan",
    f"SELECT row_id, {K}, trial_index, experiment_name, experiment_id, {rr('trial_time', 'motion_direction', 'estimate_x', 'estimate_y', 'prior_std')} FROM c_trials",
)
add("w10_stratified_folds", f"SELECT {K}, fold FROM folds")
for name, by in (("w11_subject_folds", "subject_id"), ("w11_session_folds", "session_id"), ("w11_prior_folds", "prior_std")):
    add(
        name,
        f"""SELECT {', '.join('s.' + k for k in K.split(', '))}, CAST((g.rk - 1) % 4 AS INT) AS fold FROM seqs s JOIN (SELECT {by}, row_number() OVER (ORDER BY sum(n) DESC, {by}) AS rk FROM seqs GROUP BY {by}) g USING ({by})""",
    )
add("w12_chronological_splits", f"SELECT {K}, split_id, role FROM chrono")
SW = f"PARTITION BY {K}, segment_number"
cte(
    "seg_shuffled",
    f"""SELECT *, CAST(row_number() OVER ({SW} ORDER BY trial_index) AS BIGINT) AS seg_pos,
CAST(row_number() OVER ({SW} ORDER BY md5(concat_ws('|', '7', row_id::VARCHAR))) AS BIGINT) AS shuffle_order, count(*) OVER ({SW}) AS seg_len,
radians({pmod(pmod('degrees(atan2(estimate_y, estimate_x)) + 360.0::DOUBLE', '360.0::DOUBLE'), '360.0::DOUBLE')}) AS y,
radians({pmod('motion_direction', '360.0::DOUBLE')}) AS theta, radians({pmod('prior_mean', '360.0::DOUBLE')}) AS mu FROM segs""",
)
cte(
    "seg_feat",
    f"""SELECT s.*, {circ('y', 'theta')} AS error, {circ('y', 'mu')} AS prior_error, cos({circ('y', 'theta')}) AS cos_s,
cos({circ('y', 'mu')}) AS cos_p, f.fold FROM seg_shuffled s JOIN folds f USING ({K})""",
)
add("w13_permute_within", "SELECT row_id, segment_id, seg_pos, shuffle_order FROM seg_shuffled")
add(
    "w13_shuffle_report",
    "SELECT segment_id, count(*) AS n_trials, bool_or(shuffle_order <> seg_pos) AS order_changed FROM seg_shuffled GROUP BY segment_id",
)


def matched_cte(name: str, seed: str) -> str:
    return cte(
        name,
        f"""SELECT s.subject_id, s.session_id, s.run_id, s.fold, s.prior_std, s.block_id, s.segment_id, s.segment_number, s.trial_index, s.seg_pos, s.seg_len,
d.row_id, d.motion_direction, d.motion_coherence, d.error, d.prior_error, d.cos_s, d.cos_p, d.block_id AS source_block_id
FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, fold, prior_std ORDER BY segment_id, trial_index) AS rk FROM seg_feat) s
JOIN (SELECT *, row_number() OVER (PARTITION BY subject_id, fold, prior_std ORDER BY md5(concat_ws('|', '{seed}', row_id::VARCHAR))) AS rk FROM seg_feat) d
ON s.subject_id = d.subject_id AND s.fold = d.fold AND s.prior_std = d.prior_std AND s.rk = d.rk""",
    )


matched_cte("seg_matched", "11")
add("w14_permute_matched", f"SELECT segment_id, trial_index, row_id, source_block_id, {rr('error')} FROM seg_matched")
add(
    "w14_changed_fraction",
    f"""SELECT subject_id, fold, {r('prior_std')} AS prior_std, count(*) AS n_trials,
{r('avg(CASE WHEN source_block_id <> block_id THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS fraction_changed_block
FROM seg_matched GROUP BY subject_id, fold, seg_matched.prior_std""",
)
CR = "fold, prior_std, motion_coherence, motion_direction"
cte(
    "cross_ranked",
    f"""SELECT *, row_number() OVER (PARTITION BY {CR} ORDER BY subject_id, md5(concat_ws('|', '13', row_id::VARCHAR))) AS rk,
count(*) OVER (PARTITION BY {CR}) AS gn FROM seg_feat""",
)
cte("cross_shape", f"SELECT {CR}, max(m) AS mx FROM (SELECT {CR}, subject_id, count(*) AS m FROM seg_feat GROUP BY ALL) GROUP BY {CR}")
cte(
    "seg_cross",
    f"""SELECT s.* EXCLUDE (estimate_x, estimate_y, error, prior_error, cos_s, cos_p, y, rk, gn), d.subject_id AS donor_subject_id, d.estimate_x, d.estimate_y, d.y
FROM cross_ranked s JOIN cross_shape h USING ({CR}) JOIN cross_ranked d
ON s.fold = d.fold AND s.prior_std = d.prior_std AND s.motion_coherence = d.motion_coherence AND s.motion_direction = d.motion_direction
AND s.rk = (d.rk - 1 + h.mx) % d.gn + 1""",
)
add("w15_permute_cross_subject", f"SELECT row_id, subject_id, donor_subject_id, {rr('estimate_x', 'estimate_y')} FROM seg_cross")
add("t1_canonical_order", f"SELECT row_id, {K}, trial_index FROM c_trials ORDER BY {K}, trial_index")
add(
    "u3_same_membership",
    """SELECT (SELECT count(*) FROM seg_feat) AS rows_a, (SELECT count(*) FROM seg_matched) AS rows_b,
(SELECT count(*) FROM (SELECT row_id, fold FROM seg_feat EXCEPT ALL SELECT row_id, fold FROM seg_matched)) AS only_a,
(SELECT count(*) FROM (SELECT row_id, fold FROM seg_matched EXCEPT ALL SELECT row_id, fold FROM seg_feat)) AS only_b,
NOT EXISTS (SELECT row_id, fold FROM seg_feat EXCEPT ALL SELECT row_id, fold FROM seg_matched) AS same""",
)
add(
    "u4_leakage",
    f"""SELECT 'sequence' AS folds, count(*) AS leaking_blocks FROM (SELECT {K} FROM folds GROUP BY {K} HAVING count(DISTINCT fold) > 1)
UNION ALL SELECT 'row', count(*) FROM (SELECT {K} FROM feat GROUP BY {K} HAVING count(DISTINCT row_id % 4) > 1)
UNION ALL SELECT 'chronological', count(*) FROM (SELECT split_id, {K} FROM chrono WHERE role = 'train' INTERSECT SELECT split_id, {K} FROM chrono WHERE role = 'test')""",
)
add("u5_conditions", f"SELECT DISTINCT {rr('motion_direction', 'motion_coherence', 'prior_std', 'prior_mean')} FROM feat")
add(
    "f1_degrees_and_radians",
    f"""SELECT row_id, {r('radians(' + pmod('motion_direction * 3 - 500', '360.0::DOUBLE') + ')')} AS rad,
{r(pmod('degrees(motion_direction / 7 - 20)', '360.0::DOUBLE'))} AS deg, {r(pmod('raw_response_time * 5 - 9', TWO_PI + '::DOUBLE'))} AS wrapped FROM c_trials""",
)
add(
    "f2_circular_difference",
    f"SELECT row_id, {r('error')} AS signed, {r('abs(prior_error)')} AS absolute, {r(wrap('y - theta'))} AS wrapped FROM feat",
)
add(
    "f3_response_angle",
    f"SELECT row_id, {r(pmod('degrees(atan2(estimate_y, estimate_x)) + 360.0::DOUBLE', '360.0::DOUBLE'))} AS estimate_deg FROM c_trials",
)
add(
    "f6_circular_moments",
    f"""SELECT subject_id, {r('degrees(sqrt(-2 * ln(sqrt(avg(cos(error))^2 + avg(sin(error))^2))))')} AS circular_sd_deg,
{r('degrees(atan2(avg(sin(error)), avg(cos(error))))')} AS circular_mean_deg FROM feat GROUP BY subject_id""",
)


def kappa_sql(x: str) -> str:
    """Piecewise concentration estimate of a resultant expression."""
    v = f"least(greatest(({x})::DOUBLE, 0.0), 0.999999999)"
    return f"""(CASE WHEN {v} < 1e-8 THEN 1e-8 WHEN {v} < 0.53 THEN greatest(2*{v} + pow({v},3) + 5*pow({v},5)/6, 1e-8)
WHEN {v} < 0.85 THEN -0.4 + 1.39*{v} + 0.43/(1-{v}) ELSE least(1.0/greatest(pow({v},3) - 4*pow({v},2) + 3*{v}, 1e-12), 5000.0) END)::DOUBLE"""


def log_i0_sql(x: str) -> str:
    series = f"list_reduce(list_transform(range(60, 0, -1), lambda z: z::DOUBLE), lambda hh, kk: 1.0::DOUBLE + ({x})*({x})/4 / (kk*kk) * hh, 1.0::DOUBLE)"
    tail = f"list_reduce(list_transform(range(25, 0, -1), lambda z: z::DOUBLE), lambda hh, kk: 1.0::DOUBLE + (2*kk-1)*(2*kk-1) / (8.0::DOUBLE*kk*greatest(({x}), 20.0::DOUBLE)) * hh, 1.0::DOUBLE)"
    return f"(CASE WHEN ({x}) < 20 THEN ln({series}) ELSE ({x}) - ln({TWO_PI}::DOUBLE * ({x}))/2 + ln({tail}) END)"


def i1_over_i0_sql(x: str) -> str:
    return f"list_reduce(list_transform(range(500, 0, -1), lambda z: z::DOUBLE), lambda hh, kk: 1.0::DOUBLE / (2.0::DOUBLE*kk/({x}) + hh), 0.0::DOUBLE)"


add(
    "f5_kappa_from_resultant",
    f"""SELECT subject_id, {r('motion_coherence')} AS motion_coherence, {r('res')} AS resultant, {r(kappa_sql('res'))} AS kappa
FROM (SELECT subject_id, motion_coherence, avg(cos_s) AS res FROM feat GROUP BY ALL)""",
)
add(
    "f9_kappa_to_sd",
    f"""SELECT {r('prior_std')} AS prior_std, {r('k')} AS kappa, {r('degrees(sqrt(-2*ln(' + i1_over_i0_sql('k') + ')))')} AS circular_sd_deg, {r(log_i0_sql('k'))} AS log_i0
FROM (SELECT prior_std, {kappa_sql('res')} AS k FROM (SELECT prior_std, avg(cos_p) AS res FROM feat GROUP BY ALL))""",
)
add(
    "f10_labels",
    f"""SELECT row_id, printf('s%02d_session%03d_run%03d', {K}) AS block_id,
motion_coherence::VARCHAR || '/' || prior_std::INT::VARCHAR AS condition,
'Coherence ' || motion_coherence::VARCHAR || '/' || prior_std::INT::VARCHAR AS condition_label FROM feat""",
)
add(
    "f11_parameter_json",
    f"""SELECT subject_id, {', '.join(f"p{w} AS kappa_p_{w}" for w in (10, 20, 40, 80))},
CAST(2 + length(concat_ws(',', '"10":' || p10, '"20":' || p20, '"40":' || p40, '"80":' || p80)) AS INT) AS n_chars
FROM (SELECT subject_id, {', '.join(f"round(avg(cos_p) FILTER (prior_std = {w}), 6) AS p{w}" for w in (10, 20, 40, 80))} FROM feat GROUP BY subject_id)""",
)
add(
    "f12_bins",
    f"""SELECT row_id, {r('conflict_deg')} AS conflict_deg, CASE WHEN conflict_deg < 30 THEN 'near (<30 deg)' WHEN conflict_deg < 60 THEN 'medium (30-60 deg)' ELSE 'far (>=60 deg)' END AS conflict_bin,
CAST(least(floor(({relative('error')} + 180.0) / 15.0), 23) AS INT) AS hist_bin
FROM (SELECT *, abs({pmod('motion_direction - prior_mean + 180.0', '360.0::DOUBLE')} - 180.0) AS conflict_deg FROM feat)""",
)
add("s3_read_draws", f"SELECT CAST(s AS INT) AS simulation, row_id, {rr('estimate_deg')} FROM feat, (VALUES (1), (3)) t(s)")
