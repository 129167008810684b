"""SQL of the queries in arcseq/plans/models.py."""

from __future__ import annotations

from arcseq.columns import COVARIATES, STATES
from arcseq.plans import fixed
from oracles.base import K, LOG_TWO_PI, TWO_PI, circ, cte, pmod, query, r, rr
from oracles.tables import i1_over_i0_sql, log_i0_sql

ORACLES: dict[str, str] = {}
TR = [f"{a}_to_{b}" for a in STATES for b in STATES]


def add(name: str, sql: str, extra: dict[str, str] | None = None) -> None:
    ORACLES[name] = query(sql, extra)


def d(v: float) -> str:
    return f"{float(v)!r}::DOUBLE"


def level_cte(name: str, kappas: dict[float, float]) -> str:
    rows = ", ".join(f"({d(k)}, {d(v)})" for k, v in kappas.items())
    return cte(
        name,
        f"SELECT lv, kappa, {LOG_TWO_PI}::DOUBLE + {log_i0_sql('kappa')} AS norm, {i1_over_i0_sql('kappa')} AS res FROM (VALUES {rows}) t(lv, kappa)",
    )


level_cte("ks_main", fixed.KAPPA_S)
level_cte("kp_main", fixed.KAPPA_P)
level_cte("ks_start", fixed.START_KAPPA_S)
level_cte("kp_start", fixed.START_KAPPA_P)


def emission_cte(name: str, src: str, tag: str, cos_s: str = "cos_s") -> str:
    """Rows of src with log densities lb1..lb3 and level parameters."""
    return cte(
        name,
        f"""SELECT z.*, ks_{tag}.kappa AS kappa_s, kp_{tag}.kappa AS kappa_p, ks_{tag}.norm AS norm_s, kp_{tag}.norm AS norm_p, ks_{tag}.res AS res_s, kp_{tag}.res AS res_p,
ks_{tag}.kappa * {cos_s} - ks_{tag}.norm AS lb1, kp_{tag}.kappa * cos_p - kp_{tag}.norm AS lb2, -{LOG_TWO_PI}::DOUBLE AS lb3
FROM {src} z JOIN ks_{tag} ON ks_{tag}.lv = motion_coherence JOIN kp_{tag} ON kp_{tag}.lv = prior_std""",
    )


def mix_cte(name: str, src: str, w: list[str], center: str = "theta") -> str:
    """Mixture score columns: q1..q3 predictive, f1..f3 filtered, ll."""
    return cte(
        name,
        f"""SELECT *, {center} AS center_s, e1/(e1+e2+e3) AS f1, e2/(e1+e2+e3) AS f2, e3/(e1+e2+e3) AS f3, ln(e1+e2+e3) AS ll
FROM (SELECT *, q1*exp(lb1) AS e1, q2*exp(lb2) AS e2, q3*exp(lb3) AS e3 FROM (SELECT *, {w[0]} AS q1, {w[1]} AS q2, {w[2]} AS q3 FROM {src}))""",
    )


emission_cte("emis", "feat", "main")
mix_cte("mix", "emis", [d(w) for w in fixed.WEIGHTS])
add(
    "j1_attach_params",
    f"SELECT row_id, {rr('kappa_s', 'kappa_p', 'norm_s', 'norm_p')} FROM emis",
)
add("f4_log_vonmises", f"SELECT row_id, {rr('lb1 AS log_density')} FROM emis")
LB = [f"lb{i + 1} AS emission_log_density_{s}" for i, s in enumerate(STATES)]
PRED = [f"q{i + 1} AS predictive_p_{s}" for i, s in enumerate(STATES)]
FILT = [f"f{i + 1} AS filtered_p_{s}" for i, s in enumerate(STATES)]
add("m1_emissions", f"SELECT row_id, {rr(*LB)} FROM emis")


def argmax(a: str, b: str, c: str) -> str:
    return f"CASE WHEN {a} >= {b} AND {a} >= {c} THEN 'sensory' WHEN {b} >= {c} THEN 'prior' ELSE 'lapse' END"


MOMENTS = """(SELECT *, least(sqrt(vx*vx + vy*vy), 1.0::DOUBLE) AS rl FROM (SELECT *, q1*res_s*cos(center_s) + q2*res_p*cos(mu) AS vx,
q1*res_s*sin(center_s) + q2*res_p*sin(mu) AS vy FROM {src}))"""
MCOLS = [
    f"{pmod('degrees(atan2(vy, vx))', '360.0::DOUBLE')} AS predictive_circular_mean_deg",
    "rl AS predictive_resultant_length",
    "degrees(sqrt(greatest(-2*ln(rl), 0.0))) AS predictive_circular_sd_deg",
]
add(
    "m2_score_mixture",
    f"""SELECT row_id, {argmax('f1', 'f2', 'f3')} AS state_map_filtered, {rr(*LB, *PRED, *FILT, *MCOLS)},
{rr(*[f'exp(lb{i + 1}) AS emission_density_{s}' for i, s in enumerate(STATES)], *[f'ln(q{i + 1}) + lb{i + 1} AS state_log_contribution_{s}' for i, s in enumerate(STATES)])},
{rr('ll AS trial_ll', 'exp(ll) AS trial_density')}, {r(f'sum(ll) OVER (PARTITION BY {K} ORDER BY trial_index)')} AS sequence_cumulative_ll,
{r(f'sum(ll) OVER (PARTITION BY {K})')} AS sequence_ll FROM {MOMENTS.format(src='mix')}""",
)
for mode, a_s, a_r in (("stimulus", fixed.ALPHA_STIM, 0.0), ("response", 0.0, fixed.ALPHA_RESP), ("both", fixed.ALPHA_STIM, fixed.ALPHA_RESP)):
    cte(
        f"serial_{mode}_src",
        f"""SELECT *, cos({circ('y', 'center')}) AS cos_c FROM (SELECT *, {pmod('theta + shift', TWO_PI + '::DOUBLE')} AS center FROM (
SELECT *, {d(a_s)} * {circ('coalesce(prev_theta, theta)', 'theta')} + {d(a_r)} * {circ('coalesce(prev_y, y)', 'theta')} AS shift FROM feat))""",
    )
    emission_cte(f"serial_{mode}_e", f"serial_{mode}_src", "main", "cos_c")
    mix_cte(f"serial_{mode}_m", f"serial_{mode}_e", [d(w) for w in fixed.WEIGHTS], "center")
    add(f"m3_score_serial_{mode}", f"SELECT row_id, {rr('degrees(shift) AS shift_deg', *FILT, 'll AS trial_ll')} FROM serial_{mode}_m")
add("m5_predictive_moments", f"SELECT row_id, {rr(*MCOLS)} FROM {MOMENTS.format(src='serial_both_m')}")
COND_W = [
    "CASE prior_std " + " ".join(f"WHEN {d(k)} THEN {d(v[i])}" for k, v in fixed.CONDITION_WEIGHTS.items()) + " END"
    for i in range(3)
]
mix_cte("condmix", "emis", COND_W)
add("m4_score_conditioned", f"SELECT row_id, {rr(*PRED, *FILT, 'll AS trial_ll')} FROM condmix")
add(
    "f7_softmax_logsumexp",
    f"""SELECT row_id, {rr('ln(exp(lb1)+exp(lb2)+exp(lb3)) AS total', *[f'exp(lb{i + 1})/(exp(lb1)+exp(lb2)+exp(lb3)) AS p_{s}' for i, s in enumerate(STATES)])} FROM emis""",
)
add(
    "f8_ratios_and_run_lengths",
    f"""SELECT subject_id, {rr('exp(m + 1) AS density_ratio', 'exp(-m) AS perplexity', '1.0/(1.0-p) AS run_length')}, round(p) = 1 AS never_ends
FROM (SELECT subject_id, avg(ll) AS m, avg(f1) AS p FROM mix GROUP BY subject_id)""",
)
add("f13_argmax_state", f"SELECT row_id, {argmax('f1', 'f2', 'f3')} AS state_map_filtered FROM mix")
add(
    "w6_cumulative_ll",
    f"""SELECT row_id, {r(f'sum(ll) OVER (PARTITION BY {K} ORDER BY trial_index)')} AS sequence_cumulative_ll,
{r(f'sum(ll) OVER (PARTITION BY {K})')} AS sequence_ll FROM mix""",
)
cte("mapped", f"SELECT *, {argmax('f1', 'f2', 'f3')} AS state FROM mix")


def runs_cte(name: str, src: str, keys: str, order: str, state: str = "state") -> str:
    return cte(
        name,
        f"""SELECT {keys}, CAST(rn AS BIGINT) AS run_no, {state}, count(*) AS run_length FROM (
SELECT *, sum(chg) OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM (
SELECT *, CASE WHEN lag({state}) OVER (PARTITION BY {keys} ORDER BY {order}) = {state} THEN 0 ELSE 1 END AS chg FROM {src})) GROUP BY {keys}, rn, {state}""",
    )


runs_cte("mapped_runs", "mapped", K, "trial_index")
add("w7_run_lengths", f"SELECT {K}, run_no, state, run_length FROM mapped_runs")
add(
    "w8_share_within",
    f"""SELECT subject_id, state, n, CAST(sum(n) OVER (PARTITION BY subject_id) AS BIGINT) AS subject_n, {r('n::DOUBLE / sum(n) OVER (PARTITION BY subject_id)')} AS share
FROM (SELECT subject_id, state, count(*) AS n FROM mapped GROUP BY ALL)""",
)
add("p7_exclude_state", "SELECT row_id, state FROM mapped WHERE state <> 'lapse'")
add(
    "a7_occupancy",
    f"""SELECT {rr('motion_coherence', 'prior_std')}, conflict_bin, n, {rr('p_sensory', 'p_prior', 'p_lapse', 'mean_conflict_deg')} FROM (
SELECT motion_coherence, prior_std, CASE WHEN conflict_deg < 30 THEN 'near (<30 deg)' WHEN conflict_deg < 60 THEN 'medium (30-60 deg)' ELSE 'far (>=60 deg)' END AS conflict_bin,
count(*) AS n, avg(f1) AS p_sensory, avg(f2) AS p_prior, avg(f3) AS p_lapse, avg(conflict_deg) AS mean_conflict_deg
FROM (SELECT *, abs({pmod('motion_direction - prior_mean + 180.0', '360.0::DOUBLE')} - 180.0) AS conflict_deg FROM mix) GROUP BY ALL)""",
)
add(
    "a8_state_share",
    f"""SELECT s.subject_id, t.state, count(m.row_id) AS n_trials, s.total AS total_trials, {r('count(m.row_id)::DOUBLE / s.total')} AS proportion
FROM (SELECT subject_id, count(*) AS total FROM mapped GROUP BY subject_id) s CROSS JOIN (VALUES ('sensory'), ('prior'), ('lapse')) t(state)
LEFT JOIN mapped m ON m.subject_id = s.subject_id AND m.state = t.state GROUP BY s.subject_id, t.state, s.total""",
)

# ---- covariate transitions
XS = [f"x_{c}" for c in COVARIATES]


def scaler_cte(name: str, src: str, where: str = "", group: str = "") -> str:
    cols = ", ".join(
        f"avg({x}) AS m_{x}, CASE WHEN stddev_pop({x}) < 1e-12 THEN 1.0::DOUBLE ELSE stddev_pop({x}) END AS s_{x}" for x in XS
    )
    return cte(name, f"SELECT {group + ', ' if group else ''}{cols} FROM {src} {where} {'GROUP BY ' + group if group else ''}")


def trans_cte(name: str, src: str, scaler: str) -> str:
    """Row-wise transition probabilities a11..a33."""
    z = ["1.0::DOUBLE"] + [f"(({x} - m_{x}) / s_{x})" for x in XS]
    logits = []
    for i in range(3):
        for j in range(3):
            logits.append(" + ".join(f"({d(b)}) * {x}" for b, x in zip(fixed.B[i][j], z)) + f" AS g{i + 1}{j + 1}")
    probs = [f"exp(g{i}{j}) / (exp(g{i}1) + exp(g{i}2) + exp(g{i}3)) AS a{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]
    return cte(name, f"SELECT *, {', '.join(probs)} FROM (SELECT c.*, {', '.join(logits)} FROM {src} c CROSS JOIN {scaler})")


scaler_cte("scaler_all", "covs")
trans_cte("trans", "covs", "scaler_all")
AIJ = [f"CASE WHEN pos > 1 THEN a{i + 1}{j + 1} END AS {a}_to_{b}" for i, a in enumerate(STATES) for j, b in enumerate(STATES)]
add("m11_transition_probs", f"SELECT row_id, {rr(*AIJ)} FROM trans")
AVG = [f"avg(a{i + 1}{j + 1}) AS {a}_to_{b}" for i, a in enumerate(STATES) for j, b in enumerate(STATES)]
add("m12_average_transition", f"SELECT {rr(*AVG)} FROM trans WHERE pos > 1")
cte("cov_folds", f"SELECT c.*, f.fold FROM covs c JOIN folds f USING ({K})")
cte("fold_list", "SELECT DISTINCT fold AS test_fold FROM folds")
scaler_cte("scaler_fold", "fold_list JOIN cov_folds ON cov_folds.fold <> test_fold", group="test_fold")
add(
    "m13_fold_scaler",
    f"SELECT row_id, fold, {rr(*[f'(x_{c} - m_x_{c}) / s_x_{c} AS z_{c}' for c in COVARIATES])} FROM cov_folds JOIN scaler_fold ON fold = test_fold",
)
cte("subject_trans", f"SELECT subject_id, {', '.join(AVG)} FROM trans WHERE pos > 1 GROUP BY subject_id")


def effect_rows() -> str:
    parts = []
    for p, cov in enumerate(COVARIATES, 1):
        for i, a in enumerate(STATES):
            lo = [f"exp(ln({a}_to_{b}) - ({d(fixed.slope(i, j, p))}))" for j, b in enumerate(STATES)]
            hi = [f"exp(ln({a}_to_{b}) + ({d(fixed.slope(i, j, p))}))" for j, b in enumerate(STATES)]
            for j, b in enumerate(STATES):
                parts.append(
                    f"SELECT subject_id, '{cov}' AS covariate, '{a}' AS previous_state, '{b}' AS next_state, {lo[j]}/({'+'.join(lo)}) AS lo, {hi[j]}/({'+'.join(hi)}) AS hi FROM subject_trans"
                )
    return " UNION ALL ".join(parts)


cte("cov_effects", effect_rows())
add(
    "m9_covariate_effects",
    f"SELECT subject_id, covariate, previous_state, next_state, {rr('lo AS prob_at_minus_1sd', 'hi AS prob_at_plus_1sd', 'hi - lo AS delta_plus_minus')} FROM cov_effects",
)
add(
    "t2_top_effects",
    f"""SELECT subject_id, covariate, previous_state, {r('dd')} AS delta_plus_minus FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY abs(dd) DESC, covariate, previous_state) AS rk
FROM (SELECT *, round(hi - lo, 9) AS dd FROM cov_effects WHERE previous_state = next_state)) WHERE rk <= 6""",
)

# ---- chains


def chain_ctes(prefix: str, src: str, keys: str, pi: list[str], A=None, back: bool = True) -> None:
    """Forward (and backward) recursion over src(keys, pos, lb1..lb3[, a11..a33]); densities are used unscaled."""
    ks = keys.split(", ")
    on = " AND ".join(f"s.{k} = f.{k}" for k in ks)
    sk = ", ".join(f"s.{k}" for k in ks)
    a = (lambda i, j: f"s.a{i + 1}{j + 1}") if A is None else (lambda i, j: d(A[i][j]))
    q = [" + ".join(f"f.f{i + 1} * {a(i, j)}" for i in range(3)) for j in range(3)]
    cols = "q1, q2, q3, u1/(u1+u2+u3), u2/(u1+u2+u3), u3/(u1+u2+u3), u1+u2+u3"
    cte(
        f"{prefix}_f",
        f"""SELECT {keys}, pos, q1, q2, q3, u1/(u1+u2+u3) AS f1, u2/(u1+u2+u3) AS f2, u3/(u1+u2+u3) AS f3, u1+u2+u3 AS c
FROM (SELECT {keys}, pos, {pi[0]} AS q1, {pi[1]} AS q2, {pi[2]} AS q3, {pi[0]}*exp(lb1) AS u1, {pi[1]}*exp(lb2) AS u2, {pi[2]}*exp(lb3) AS u3 FROM {src} WHERE pos = 1)
UNION ALL
SELECT {keys}, pos, {cols} FROM (SELECT {keys}, pos, q1, q2, q3, q1*exp(lb1) AS u1, q2*exp(lb2) AS u2, q3*exp(lb3) AS u3 FROM (
SELECT {sk}, s.pos, s.lb1, s.lb2, s.lb3, {q[0]} AS q1, {q[1]} AS q2, {q[2]} AS q3 FROM {prefix}_f f JOIN {src} s ON {on} AND s.pos = f.pos + 1))""",
    )
    fj = " AND ".join(f"g.{k} = s.{k}" for k in ks)
    cte(f"{prefix}_fwd", f"SELECT s.*, g.q1, g.q2, g.q3, g.f1, g.f2, g.f3, g.c, ln(g.c) AS ll FROM {src} s JOIN {prefix}_f g ON {fj} AND g.pos = s.pos")
    if not back:
        return
    lead = "" if A is not None else ", " + ", ".join(f"lead(a{i}{j}) OVER w AS n{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3))
    cte(
        f"{prefix}_n",
        f"""SELECT {keys}, pos, lead(exp(lb1)) OVER w AS nb1, lead(exp(lb2)) OVER w AS nb2, lead(exp(lb3)) OVER w AS nb3, lead(c) OVER w AS nc{lead}
FROM {prefix}_fwd WINDOW w AS (PARTITION BY {keys} ORDER BY pos)""",
    )
    na = (lambda i, j: f"s.n{i + 1}{j + 1}") if A is None else (lambda i, j: d(A[i][j]))
    b = [" + ".join(f"{na(i, j)} * s.nb{j + 1} * f.b{j + 1}" for j in range(3)) for i in range(3)]
    cte(
        f"{prefix}_b",
        f"""SELECT {keys}, pos, 1.0::DOUBLE AS b1, 1.0::DOUBLE AS b2, 1.0::DOUBLE AS b3 FROM {prefix}_n WHERE nc IS NULL
UNION ALL SELECT {sk}, s.pos, ({b[0]})/s.nc, ({b[1]})/s.nc, ({b[2]})/s.nc FROM {prefix}_b f JOIN {prefix}_n s ON {on} AND s.pos = f.pos - 1""",
    )
    g = [f"f{i}*b{i}/(f1*b1+f2*b2+f3*b3) AS g{i}" for i in (1, 2, 3)]
    ra = (lambda i, j: f"a{i + 1}{j + 1}") if A is None else (lambda i, j: d(A[i][j]))
    joint = [f"pf{i + 1} * {ra(i, j)} * exp(lb{j + 1}) * b{j + 1}" for i in range(3) for j in range(3)]
    xi = [f"({x}) / ({' + '.join(joint)}) AS xi{k}" for k, x in enumerate(joint)]
    cte(
        f"{prefix}_post",
        f"""SELECT *, {', '.join(g)}, {', '.join(xi)} FROM (SELECT s.*, g.b1, g.b2, g.b3, lag(f1) OVER w AS pf1, lag(f2) OVER w AS pf2, lag(f3) OVER w AS pf3
FROM {prefix}_fwd s JOIN {prefix}_b g ON {fj} AND g.pos = s.pos WINDOW w AS (PARTITION BY {', '.join('s.' + k for k in ks)} ORDER BY s.pos))""",
    )


PI_MAIN = [d(x) for x in fixed.PI]
chain_ctes("hmm", "emis", K, PI_MAIN, fixed.A)
emission_cte("trans_emis", "trans", "main")
chain_ctes("chmm", "trans_emis", K, PI_MAIN)
SM = [f"g{i + 1} AS smoothed_p_{s}" for i, s in enumerate(STATES)]
XI = [f"xi{k} AS xi_{t}" for k, t in enumerate(TR)]
add("h1_forward_filter", f"SELECT row_id, {rr(*PRED, *FILT, 'll AS trial_ll')} FROM hmm_fwd")
add("h2_sequence_ll", f"SELECT {K}, {r('sum(ll)')} AS ll, count(*) AS n FROM hmm_fwd GROUP BY {K}")
add("h3_smooth", f"SELECT row_id, {argmax('g1', 'g2', 'g3')} AS state_map_smoothed, {rr(*SM)} FROM hmm_post")
add("h4_pairwise", f"SELECT row_id, {rr(*XI)} FROM hmm_post")
add("h5_covariate_filter", f"SELECT row_id, {rr(*PRED, *FILT, 'll AS trial_ll')} FROM chmm_fwd")
add("h5_covariate_smooth", f"SELECT row_id, {rr(*SM, *XI)} FROM chmm_post")


def viterbi_ctes(prefix: str, src: str, keys: str, pi: list[str], A) -> None:
    ks = keys.split(", ")
    on = " AND ".join(f"s.{k} = f.{k}" for k in ks)
    sk = ", ".join(f"s.{k}" for k in ks)
    cand = [[f"(f.d{i + 1} + ln({d(A[i][j])}))" for i in range(3)] for j in range(3)]
    best = [f"greatest({', '.join(c)}) + s.lb{j + 1} AS d{j + 1}" for j, c in enumerate(cand)]
    back = [
        f"CASE WHEN {c[0]} >= {c[1]} AND {c[0]} >= {c[2]} THEN 1 WHEN {c[1]} >= {c[2]} THEN 2 ELSE 3 END AS k{j + 1}" for j, c in enumerate(cand)
    ]
    cte(
        f"{prefix}_d",
        f"""SELECT {keys}, pos, ln({pi[0]}) + lb1 AS d1, ln({pi[1]}) + lb2 AS d2, ln({pi[2]}) + lb3 AS d3, 0 AS k1, 0 AS k2, 0 AS k3 FROM {src} WHERE pos = 1
UNION ALL SELECT {sk}, s.pos, {', '.join(best)}, {', '.join(back)} FROM {prefix}_d f JOIN {src} s ON {on} AND s.pos = f.pos + 1""",
    )
    cte(
        f"{prefix}_s",
        f"""SELECT {keys}, pos, CASE WHEN d1 >= d2 AND d1 >= d3 THEN 1 WHEN d2 >= d3 THEN 2 ELSE 3 END AS z, k1, k2, k3
FROM (SELECT *, max(pos) OVER (PARTITION BY {keys}) AS mp FROM {prefix}_d) WHERE pos = mp
UNION ALL SELECT {sk}, s.pos, CASE f.z WHEN 1 THEN f.k1 WHEN 2 THEN f.k2 ELSE f.k3 END, s.k1, s.k2, s.k3 FROM {prefix}_s f JOIN {prefix}_d s ON {on} AND s.pos = f.pos - 1""",
    )
    cte(
        f"{prefix}_path",
        f"SELECT e.*, CASE z WHEN 1 THEN 'sensory' WHEN 2 THEN 'prior' ELSE 'lapse' END AS viterbi_state FROM {src} e JOIN {prefix}_s v ON {' AND '.join(f'e.{k} = v.{k}' for k in ks)} AND e.pos = v.pos",
    )


viterbi_ctes("vit", "emis", K, PI_MAIN, fixed.A)
add("h6_viterbi", "SELECT row_id, viterbi_state FROM vit_path")

# ---- segments: block mixture and block chains
SEG = K + ", segment_number"
cte("seg_orig", "SELECT *, seg_pos AS pos FROM seg_feat")
cte("seg_perm", "SELECT *, shuffle_order AS pos FROM seg_feat")


def block_cte(prefix: str, src: str) -> None:
    emission_cte(f"{prefix}_e", src, "start")
    mixes = [
        "ln(" + " + ".join(f"{d(w)}*exp(lb{i + 1})" for i, w in enumerate(row)) + f") AS mix{c}" for c, row in enumerate(fixed.CLASS_WEIGHTS)
    ]
    cte(f"{prefix}_mixes", f"SELECT *, {', '.join(mixes)} FROM {prefix}_e")
    past = [
        f"coalesce(sum(mix{c}) OVER (PARTITION BY {SEG} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS s{c}" for c in range(3)
    ]
    tau = [f"exp(s{c} - sm) / (exp(s0 - sm) + exp(s1 - sm) + exp(s2 - sm)) AS tau_{c}" for c in range(3)]
    cte(f"{prefix}_tau", f"SELECT *, {', '.join(tau)} FROM (SELECT *, greatest(s0, s1, s2) AS sm FROM (SELECT *, {', '.join(past)} FROM {prefix}_mixes))")
    w = [" + ".join(f"tau_{c} * {d(fixed.CLASS_WEIGHTS[c][s])}" for c in range(3)) for s in range(3)]
    mix_cte(f"{prefix}_score", f"{prefix}_tau", w)


block_cte("blk", "seg_orig")
add("h8_score_block", f"SELECT row_id, {rr('tau_0', 'tau_1', 'tau_2', *PRED, *FILT, 'll AS trial_ll')} FROM blk_score")
cte(
    "blk_post",
    f"""SELECT *, exp(s0-sm)/(exp(s0-sm)+exp(s1-sm)+exp(s2-sm)) AS tau_0, exp(s1-sm)/(exp(s0-sm)+exp(s1-sm)+exp(s2-sm)) AS tau_1,
exp(s2-sm)/(exp(s0-sm)+exp(s1-sm)+exp(s2-sm)) AS tau_2, sm + ln(exp(s0-sm)+exp(s1-sm)+exp(s2-sm)) - ln(3.0::DOUBLE) AS block_ll
FROM (SELECT *, greatest(s0, s1, s2) AS sm FROM (SELECT {SEG}, count(*) AS n_trials, sum(mix0) AS s0, sum(mix1) AS s1, sum(mix2) AS s2 FROM blk_mixes GROUP BY {SEG}))""",
)
add("h9_block_posterior", f"SELECT {SEG}, n_trials, {rr('block_ll', 'tau_0', 'tau_1', 'tau_2')} FROM blk_post")
RESP = [
    " + ".join(
        f"tau_{c} * {d(fixed.CLASS_WEIGHTS[c][s])} * exp(lb{s + 1}) / exp(mix{c})" for c in range(3)
    )
    + f" AS p_{STATES[s]}"
    for s in range(3)
]
add("h9_block_responsibilities", f"SELECT row_id, {rr(*RESP)} FROM blk_mixes JOIN blk_post USING ({SEG})")
for c in range(3):
    chain_ctes(f"cls{c}", "blk_e", SEG, [d(x) for x in fixed.CLASS_PI[c]], fixed.CLASS_A[c], back=False)
cte(
    "hyb_join",
    f"""SELECT a.row_id, {', '.join('a.' + k for k in SEG.split(', '))}, a.pos, {', '.join(f'{t}.ll AS ll{c}, {t}.q1 AS q{c}1, {t}.q2 AS q{c}2, {t}.q3 AS q{c}3' for c, t in enumerate('abe'))}
FROM cls0_fwd a JOIN cls1_fwd b ON a.row_id = b.row_id JOIN cls2_fwd e ON a.row_id = e.row_id""",
)
cte(
    "hyb_past",
    f"""SELECT *, greatest(s0, s1, s2) AS sm FROM (SELECT *, {', '.join(f'coalesce(sum(ll{c}) OVER (PARTITION BY {SEG} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS s{c}' for c in range(3))} FROM hyb_join)""",
)
cte(
    "hyb",
    f"SELECT *, {', '.join(f'exp(s{c}-sm)/(exp(s0-sm)+exp(s1-sm)+exp(s2-sm)) AS tau_{c}' for c in range(3))} FROM hyb_past",
)
HQ = [" + ".join(f"tau_{c}*q{c}{s + 1}" for c in range(3)) + f" AS predictive_p_{STATES[s]}" for s in range(3)]
add(
    "h10_score_hybrid",
    f"SELECT row_id, {rr('tau_0', 'tau_1', 'tau_2', *HQ, 'ln(tau_0*exp(ll0) + tau_1*exp(ll1) + tau_2*exp(ll2)) AS trial_ll')} FROM hyb",
)

# ---- decoding replicate responses
cte(
    "rep_rad",
    f"SELECT * EXCLUDE (y, error, prior_error, cos_s, cos_p, prev_y, prev_error), radians({pmod('2.0::DOUBLE * prior_mean - estimate_deg', '360.0::DOUBLE')}) AS y FROM feat",
)
cte("rep_err", f"SELECT *, {circ('y', 'theta')} AS error, {circ('y', 'mu')} AS prior_error FROM rep_rad")
cte(
    "rep_covs",
    f"""SELECT *, cos(error) AS cos_s, cos(prior_error) AS cos_p, motion_coherence AS x_coherence, 1.0::DOUBLE / prior_std AS x_prior_precision, abs(conflict) AS x_conflict,
coalesce(abs(lag(error) OVER (PARTITION BY {K} ORDER BY trial_index)), 0.0::DOUBLE) AS x_prev_error, coalesce(abs(prev_conflict), 0.0::DOUBLE) AS x_prev_conflict,
coalesce(prev_motion_coherence, motion_coherence) AS x_prev_coherence FROM rep_err""",
)
trans_cte("rep_trans", "rep_covs", "scaler_all")
emission_cte("rep_emis", "rep_trans", "main")
cte("rep_static", "SELECT * EXCLUDE (a11, a12, a13, a21, a22, a23, a31, a32, a33) FROM rep_emis")
chain_ctes("rdec", "rep_static", K, PI_MAIN, fixed.A)
chain_ctes("rcdec", "rep_emis", K, PI_MAIN)
add("h11_decode_static", f"SELECT row_id, {argmax('g1', 'g2', 'g3')} AS state_map, {rr(*SM)} FROM rdec_post")
add("h11_decode_covariate", f"SELECT row_id, {rr(*SM)} FROM rcdec_post")

# ---- serial profile
GRID = ", ".join(f"({d(a)}, {d(b)})" for a, b in fixed.GRID)
W1, W2, W3 = (d(w) for w in fixed.WEIGHTS)
cte(
    "profile",
    f"""SELECT alpha_stim, alpha_resp, sum(ln({W1}*exp(kappa_s*cos(y - (theta + alpha_stim*ds + alpha_resp*dr)) - norm_s) + {W2}*exp(lb2) + {W3}*exp(lb3))) AS ll, count(*) AS n
FROM (SELECT *, {circ('coalesce(prev_theta, theta)', 'theta')} AS ds, {circ('coalesce(prev_y, y)', 'theta')} AS dr FROM emis) CROSS JOIN (VALUES {GRID}) g(alpha_stim, alpha_resp) GROUP BY ALL""",
)
add("e10_serial_profile", f"SELECT {rr('alpha_stim', 'alpha_resp')}, {r('ll', 4)} AS ll, n FROM profile")
add(
    "e10_best_point",
    f"SELECT {rr('alpha_stim', 'alpha_resp')}, {r('ll', 4)} AS ll FROM (SELECT alpha_stim, alpha_resp, profile.ll FROM profile ORDER BY profile.ll DESC, alpha_stim, alpha_resp LIMIT 1)",
)
add(
    "s4_write_scores",
    f"""SELECT 'final' AS fit_scope, 'independent_switching' AS model_key, count(*) AS n, {r('sum(ll)', 4)} AS ll FROM mix
UNION ALL SELECT 'final', 'prior_conditioned', count(*), {r('sum(ll)', 4)} FROM condmix""",
)

# ---- grid observers
KE = "CASE motion_coherence " + " ".join(f"WHEN {d(k)} THEN {d(v)}" for k, v in fixed.KAPPA_S.items()) + " END"
KP = "CASE prior_std " + " ".join(f"WHEN {d(k)} THEN {d(v)}" for k, v in fixed.KAPPA_P.items()) + " END"
KM = d(fixed.OBSERVER["kappa_m"])
LAPSE = d(fixed.OBSERVER["lapse"])
CK = "motion_direction, motion_coherence, prior_std, prior_mean"
CB = "motion_coherence, prior_std, prior_mean, e"
cte("g_cond", f"SELECT DISTINCT {CK} FROM feat")
cte("g_deg", "SELECT CAST(g AS INT) AS g FROM range(360) t(g)")
cte(
    "g_ev",
    f"""SELECT * FROM (SELECT *, v / sum(v) OVER (PARTITION BY {CK}) AS pe FROM (
SELECT {CK}, g_deg.g AS e, exp({KE} * (cos(radians(g_deg.g - motion_direction)) - 1)) AS v FROM g_cond CROSS JOIN g_deg)) WHERE pe >= 1e-12""",
)
cte(
    "g_post",
    f"""SELECT motion_coherence, prior_std, prior_mean, e.g AS e, h.g AS h, {KE} * (cos(radians(h.g - e.g)) - 1) + {KP} * (cos(radians(h.g - prior_mean)) - 1) AS lu
FROM (SELECT DISTINCT motion_coherence, prior_std, prior_mean FROM g_cond) CROSS JOIN g_deg e CROSS JOIN g_deg h""",
)
cte(
    "g_map",
    f"""SELECT {CB}, h AS m FROM (SELECT *, row_number() OVER (PARTITION BY {CB} ORDER BY round(lu, 9) DESC, h) AS rk FROM g_post) WHERE rk = 1""",
)
cte(
    "g_motor",
    f"SELECT off, v / sum(v) OVER () AS v FROM (SELECT g AS off, exp({KM} * (cos(radians(g)) - 1)) AS v FROM g_deg)",
)


def spread(name: str, weights: str) -> str:
    """Blur weights(CK, m, w) by the motor kernel, add lapses, normalise."""
    cte(
        f"{name}_raw",
        f"""SELECT {CK}, g_deg.g AS g, sum(w * g_motor.v) AS p FROM {weights} CROSS JOIN g_deg JOIN g_motor ON g_motor.off = ((g_deg.g - m) % 360 + 360) % 360 GROUP BY {CK}, g_deg.g""",
    )
    return finish(name, f"{name}_raw")


def finish(name: str, raw: str) -> str:
    return cte(
        name,
        f"SELECT {CK}, g, p / sum(p) OVER (PARTITION BY {CK}) AS p FROM (SELECT {CK}, g, p * (1 - {LAPSE}) + {LAPSE} / 360 AS p FROM {raw})",
    )


cte("g_wmap", f"SELECT {CK}, m, sum(pe) AS w FROM g_ev JOIN g_map USING ({CB}) GROUP BY {CK}, m")
spread("grid_map", "g_wmap")
cte(
    "g_mean",
    f"SELECT {CB}, {pmod('degrees(atan2(sum(exp(lu)*sin(radians(h))), sum(exp(lu)*cos(radians(h)))))', '360.0::DOUBLE')} AS ctr FROM g_post GROUP BY {CB}",
)
cte(
    "g_meanmotor",
    f"SELECT {CB}, g, v / sum(v) OVER (PARTITION BY {CB}) AS v FROM (SELECT {CB}, g, exp({KM} * (cos(radians(g - ctr)) - 1)) AS v FROM g_mean CROSS JOIN g_deg)",
)
cte("grid_mean_raw", f"SELECT {CK}, g, sum(pe * g_meanmotor.v) AS p FROM g_ev JOIN g_meanmotor USING ({CB}) GROUP BY {CK}, g")
finish("grid_mean", "grid_mean_raw")
cte("g_share", f"SELECT * FROM (SELECT {CB}, h, exp(lu) / sum(exp(lu)) OVER (PARTITION BY {CB}) AS pp FROM g_post) WHERE pp > 1e-8")
cte("g_wsample", f"SELECT {CK}, h AS m, sum(pe * pp) AS w FROM g_ev JOIN g_share USING ({CB}) GROUP BY {CK}, h")
spread("grid_sample", "g_wsample")
cte("g_wswitch", f"SELECT {CK}, e AS m, pe AS w FROM g_ev")
cte(
    "grid_sense",
    f"SELECT {CK}, g_deg.g AS g, sum(w * g_motor.v) AS p FROM g_wswitch CROSS JOIN g_deg JOIN g_motor ON g_motor.off = ((g_deg.g - m) % 360 + 360) % 360 GROUP BY {CK}, g_deg.g",
)
cte(
    "grid_switch_raw",
    f"""SELECT {CK}, g, (1 - pw) * p + pw * v / sum(v) OVER (PARTITION BY {CK}) AS p FROM (SELECT *, {KP} / ({KP} + {KE}) AS pw, exp({KM} * (cos(radians(g - prior_mean)) - 1)) AS v FROM grid_sense)""",
)
finish("grid_switch", "grid_switch_raw")
GK = rr("motion_direction", "motion_coherence", "prior_std")
for q, t in (("m6_bayes_grid_map", "grid_map"), ("m6_bayes_grid_mean", "grid_mean"), ("m6_bayes_grid_sample", "grid_sample"), ("m7_switch_grid", "grid_switch")):
    add(q, f"SELECT {GK}, g, {r('p', 9)} AS p FROM {t}")
cte(
    "grid_pairs",
    f"SELECT *, coalesce(lead(p) OVER w, first_value(p) OVER w) AS p_next FROM grid_switch WINDOW w AS (PARTITION BY {CK} ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
)
add(
    "m8_grid_loglik",
    f"""SELECT f.row_id, {r('ln(greatest((1 - (dg - floor(dg))) * a.p + (dg - floor(dg)) * a.p_next, 1e-300))')} AS trial_ll
FROM (SELECT *, {pmod('degrees(y)', '360.0::DOUBLE')} AS dg FROM feat) f
JOIN grid_pairs a ON a.motion_direction = f.motion_direction AND a.motion_coherence = f.motion_coherence AND a.prior_std = f.prior_std AND a.prior_mean = f.prior_mean AND a.g = CAST(floor(dg) AS INT) % 360""",
)
