"""SQL of the queries in arcseq/plans/fits.py."""

from __future__ import annotations

from arcseq.columns import STATES
from arcseq.plans import fixed
from oracles.base import K, LOG_TWO_PI, circ, cte, query, r, rr
from oracles.models import (
    COND_W, FILT, PRED, SEG, TR, block_cte, chain_ctes, d, emission_cte, mix_cte, runs_cte, viterbi_ctes,
)
from oracles.tables import kappa_sql, log_i0_sql, matched_cte

ORACLES: dict[str, str] = {}
KAPPAS = ["kappa_s_06", "kappa_s_12", "kappa_s_24", "kappa_p_10", "kappa_p_20", "kappa_p_40", "kappa_p_80"]
KCASE = [f"motion_coherence = {d(c)}" for c in fixed.COH] + [f"prior_std = {d(w)}" for w in fixed.PRIOR]


def add(name: str, sql: str, extra: dict[str, str] | None = None) -> None:
    ORACLES[name] = query(sql, extra)


def kappa_sums(g1: str, g2: str) -> str:
    """Resultants per level as r0..r6."""
    out = []
    for i, cond in enumerate(KCASE):
        g, c = (g1, "cos_s") if i < 3 else (g2, "cos_p")
        out.append(f"sum(CASE WHEN {cond} THEN ({g})*{c} END) / greatest(sum(CASE WHEN {cond} THEN {g} END), 1e-300) AS r{i}")
    return ", ".join(out)


KAPPA_OUT = ", ".join(f"{kappa_sql(f'r{i}')} AS {k}" for i, k in enumerate(KAPPAS))


# ---- mixtures: parameters live in a table keyed by `kk`


def mixture_steps(prefix: str, src: str, n: int, conditioned: bool = False) -> None:
    """n EM updates. src has kk, conditions and cosines; `{prefix}_p0` has kk, weights and the seven kappas."""
    weights = [f"w{i}_{j}" for i in range(4) for j in range(3)] if conditioned else ["w0", "w1", "w2"]
    for t in range(n):
        norms = ", ".join(f"{LOG_TWO_PI}::DOUBLE + {log_i0_sql(k)} AS n_{k}" for k in KAPPAS)
        cte(f"{prefix}_q{t}", f"SELECT *, {norms} FROM {prefix}_p{t}")
        pick = lambda pre, lo, hi: "CASE " + " ".join(f"WHEN {KCASE[i]} THEN {pre}{KAPPAS[i]}" for i in range(lo, hi)) + " END"
        if conditioned:
            w = ["CASE " + " ".join(f"WHEN {KCASE[3 + i]} THEN w{i}_{j}" for i in range(4)) + " END" for j in range(3)]
        else:
            w = weights
        cte(
            f"{prefix}_g{t}",
            f"""SELECT *, e1/(e1+e2+e3) AS g1, e2/(e1+e2+e3) AS g2, e3/(e1+e2+e3) AS g3, ln(e1+e2+e3) AS ll FROM (
SELECT s.*, {w[0]} * exp({pick('', 0, 3)}*cos_s - {pick('n_', 0, 3)}) AS e1, {w[1]} * exp({pick('', 3, 7)}*cos_p - {pick('n_', 3, 7)}) AS e2, {w[2]} * exp(-{LOG_TWO_PI}::DOUBLE) AS e3
FROM {src} s JOIN {prefix}_q{t} p ON p.kk = s.kk)""",
        )
        if conditioned:
            new_w = ", ".join(
                f"(sum(CASE WHEN {KCASE[3 + i]} THEN g{j + 1} END) + 1e-3) / (sum(CASE WHEN {KCASE[3 + i]} THEN g1+g2+g3 END) + 3e-3) AS w{i}_{j}"
                for i in range(4)
                for j in range(3)
            )
        else:
            new_w = ", ".join(f"(sum(g{j + 1}) + 1e-3) / (sum(g1+g2+g3) + 3e-3) AS w{j}" for j in range(3))
        cte(
            f"{prefix}_p{t + 1}",
            f"SELECT kk, {', '.join(weights)}, {KAPPA_OUT}, n_trials, train_ll FROM (SELECT kk, {new_w}, {kappa_sums('g1', 'g2')}, count(*) AS n_trials, sum(ll) AS train_ll FROM {prefix}_g{t} GROUP BY kk)",
        )


def init_row(kk: str, weights: list[float], ks: dict, kp: dict, names: list[str]) -> str:
    vals = ", ".join(f"{d(w)} AS {n}" for w, n in zip(weights, names))
    kap = ", ".join(f"{d(v)} AS {k}" for v, k in zip([*ks.values(), *[kp[w] for w in fixed.PRIOR]], KAPPAS))
    return f"SELECT {kk} AS kk, {vals}, {kap}"


cte("feat_folds", f"SELECT feat.*, folds.fold FROM feat JOIN folds USING ({K})")
cte("e1_src", "SELECT c.*, test_fold AS kk FROM feat_folds c JOIN fold_list ON c.fold <> test_fold")
cte("e1_p0", " UNION ALL ".join(init_row(str(f), fixed.WEIGHTS, fixed.KAPPA_S, fixed.KAPPA_P, ["w0", "w1", "w2"]) for f in range(4)))
mixture_steps("e1", "e1_src", 3)
W_OUT = rr(*[f"w{i} AS weight_{s}" for i, s in enumerate(STATES)], places=5)
add(
    "e1_fit_mixture",
    f"SELECT CAST(kk AS BIGINT) AS fold, n_trials, {r('train_ll', 4)} AS train_ll, {W_OUT}, {rr(*KAPPAS, places=4)} FROM e1_p3",
)
cte("e2_src", "SELECT *, 0 AS kk FROM feat")
cte(
    "e2_p0",
    init_row(
        "0", [v for w in fixed.PRIOR for v in fixed.CONDITION_WEIGHTS[w]], fixed.KAPPA_S, fixed.KAPPA_P, [f"w{i}_{j}" for i in range(4) for j in range(3)]
    ),
)
mixture_steps("e2", "e2_src", 2, conditioned=True)
add(
    "e2_fit_conditioned",
    " UNION ALL ".join(
        f"SELECT {d(w)} AS prior_std, {', '.join(f'round(w{i}_{j}, 5) AS w_{s}' for j, s in enumerate(STATES))}, n_trials, {r('train_ll', 4)} AS train_ll, {rr(*KAPPAS, places=4)} FROM e2_p2"
        for i, w in enumerate(fixed.PRIOR)
    ),
)
cte("e7_src", "SELECT feat.*, subject_id * 10 + s AS kk FROM feat CROSS JOIN range(3) t(s)")
cte(
    "e7_p0",
    " UNION ALL ".join(
        init_row("subject_id * 10 + " + str(i), fixed.INIT_WEIGHTS[i], fixed.START_KAPPA_S, fixed.START_KAPPA_P, ["w0", "w1", "w2"])
        + " FROM (SELECT DISTINCT subject_id FROM feat)"
        for i in range(3)
    ),
)
mixture_steps("e7", "e7_src", 3)
# the second update is the last one where it gained less than the tolerance over the first, else a third follows
E7_TOL = 0.17
cte(
    "e7_fits",
    f"""SELECT CAST(kk // 10 AS BIGINT) AS subject_id, CAST(kk % 10 AS BIGINT) AS seed, flat OR flat_3 AS converged, CASE WHEN flat THEN 2 ELSE 3 END::BIGINT AS n_iter,
round(CASE WHEN flat THEN l2 ELSE l3 END, 6) AS train_ll FROM (SELECT b.kk, b.train_ll AS l2, c.train_ll AS l3,
b.train_ll - a.train_ll >= -1e-5 AND (b.train_ll - a.train_ll) / greatest(1.0, abs(a.train_ll)) < {E7_TOL} AS flat,
c.train_ll - b.train_ll >= -1e-5 AND (c.train_ll - b.train_ll) / greatest(1.0, abs(b.train_ll)) < {E7_TOL} AS flat_3
FROM e7_p1 a JOIN e7_p2 b USING (kk) JOIN e7_p3 c USING (kk))""",
)
cte("e7_ranked", "SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY train_ll DESC, seed) AS rk FROM e7_fits")
add(
    "e7_restart_diagnostics",
    f"""SELECT subject_id, seed, n_iter, rk = 1 AS selected, {r('train_ll', 4)} AS train_ll,
{r('train_ll - max(train_ll) OVER (PARTITION BY subject_id)', 4)} AS delta_from_best FROM e7_ranked""",
)
add("t3_best_fit", f"SELECT subject_id, seed, {r('train_ll', 4)} AS train_ll FROM e7_ranked WHERE rk = 1")
add(
    "a15_restart_summary",
    f"""SELECT subject_id, count(*) AS n_restarts, CAST(count(*) FILTER (converged) AS BIGINT) AS n_converged, max(CASE WHEN rk = 1 THEN seed END) AS selected_seed, max(CASE WHEN rk = 1 THEN n_iter END) AS selected_n_iter,
{r('max(train_ll)', 4)} AS best_train_ll, {r('min(train_ll)', 4)} AS worst_train_ll, {r('max(train_ll) - min(train_ll)', 4)} AS ll_range FROM e7_ranked GROUP BY subject_id""",
)

# ---- chains: one update


def chain_fit(name: str, post: str, keys: str, smoothing: str = "1e-3") -> None:
    """pi, transition matrix, concentrations, n_trials and train_ll per key from posteriors."""
    pi = ", ".join(
        f"(sum(CASE WHEN pos = 1 THEN g{i + 1} END) + {smoothing}) / (sum(CASE WHEN pos = 1 THEN g1+g2+g3 END) + 3*{smoothing}) AS pi_{s}" for i, s in enumerate(STATES)
    )
    rows = []
    for i in range(3):
        den = "+".join(f"sum(CASE WHEN pos > 1 THEN xi{3 * i + j} ELSE 0 END)" for j in range(3))
        rows += [f"(sum(CASE WHEN pos > 1 THEN xi{3 * i + j} ELSE 0 END) + {smoothing}) / ({den} + 3*{smoothing}) AS {TR[3 * i + j]}" for j in range(3)]
    cte(
        name,
        f"""SELECT *, {KAPPA_OUT} FROM (SELECT {keys}, count(*) AS n_trials, sum(ll) AS train_ll, {pi}, {', '.join(rows)}, {kappa_sums('g1', 'g2')}
FROM {post} GROUP BY {keys})""",
    )


START_PI = [d(x) for x in fixed.START_PI]
emission_cte("emis_start", "feat", "start")
chain_ctes("st", "emis_start", K, START_PI, fixed.START_A)
cte("st_folds", f"SELECT p.*, test_fold FROM st_post p JOIN folds USING ({K}) JOIN fold_list ON folds.fold <> test_fold")
chain_fit("fits3", "st_folds", "subject_id, test_fold")
PIS = [f"pi_{s}" for s in STATES]
FIT = [*PIS, *TR]
FK = "subject_id, CAST(test_fold AS BIGINT) AS fold"
add("e3_fit_hmm", f"SELECT {FK}, n_trials, {r('train_ll', 4)} AS train_ll, {rr(*FIT, places=5)}, {rr(*KAPPAS, places=4)} FROM fits3")
chain_fit("fits_main", "hmm_post", "subject_id")
chain_fit("fits_final", "hmm_post_all", "one")
cte("hmm_post_all", "SELECT *, 1 AS one FROM hmm_post")


def minors() -> list[str]:
    def m(i, j):
        return f"({1.0 if i == j else 0.0} - {STATES[i]}_to_{STATES[j]})"

    out = []
    for i in range(3):
        u, v = [k for k in range(3) if k != i]
        out.append(f"({m(u, u)} * {m(v, v)} - {m(u, v)} * {m(v, u)})")
    return out


STAT = [f"{x} / ({' + '.join(minors())}) AS stationary_{s}" for x, s in zip(minors(), STATES)]
add(
    "e9_fit_subjects",
    f"SELECT subject_id, n_trials, {r('train_ll', 4)} AS train_ll, {rr(*TR, *STAT, places=5)} FROM fits_main",
)
add("e9_fit_final", f"SELECT n_trials, {r('train_ll', 4)} AS train_ll, {rr(*TR, places=5)}, {rr(*KAPPAS, places=4)} FROM fits_final")
add("m14_stationary", f"SELECT {FK}, {rr(*STAT, places=5)} FROM fits3")
cte("fits_stat", f"SELECT *, {', '.join(STAT)} FROM fits3")
add(
    "m15_persistence_excess",
    " UNION ALL ".join(
        f"""SELECT {FK}, '{s}' AS state, {rr(f'{s}_to_{s} AS self_transition', f'stationary_{s} AS stationary_probability', f'{s}_to_{s} - stationary_{s} AS persistence_excess', places=5)} FROM fits_stat"""
        for s in STATES[:2]
    ),
)
LONG = (
    [("initial_probabilities", "pi", s, "", f"pi_{s}") for s in STATES]
    + [("transition_matrix", "A", a, b, f"{a}_to_{b}") for a in STATES for b in STATES]
    + [("emission_concentrations", "sensory_kappa", f"coherence_{k[8:]}", "", k) for k in KAPPAS[:3]]
    + [("emission_concentrations", "prior_kappa", f"prior_std_{k[8:]}", "", k) for k in KAPPAS[3:]]
)
add(
    "m10_parameters_long",
    " UNION ALL ".join(
        f"SELECT {FK}, '{g}' AS parameter_group, '{p}' AS parameter, '{a}' AS level_1, '{b}' AS level_2, {r(c, 4)} AS value FROM fits3" for g, p, a, b, c in LONG
    ),
)
add("f11_parameters_of_fits", f"SELECT {FK}, {', '.join(f'round({k}, 3) AS {k}' for k in KAPPAS)} FROM fits3")
add(
    "a14_group_summary",
    " UNION ALL ".join(
        f"SELECT CAST(test_fold AS INT) AS fold, '{c}' AS parameter, {rr(f'avg({c}) AS mean', f'stddev_samp({c}) AS sd_between_subjects', f'stddev_samp({c}) / sqrt(count(*)) AS se', places=4)} FROM fits3 GROUP BY test_fold"
        for c in [*FIT, *KAPPAS]
    ),
)
add(
    "j11_verify_refit",
    f"SELECT {FK}, {r('train_ll', 4)} AS train_ll, {r('round(train_ll, 0)', 4)} AS reference_train_ll, {r('train_ll - round(train_ll, 0)', 4)} AS difference, abs(train_ll - round(train_ll, 0)) <= 0.25 AS matches FROM fits3",
)
add(
    "a9_state_weights",
    f"SELECT subject_id, {rr(*[f'avg(g{i + 1}) AS {s}_weight' for i, s in enumerate(STATES)])} FROM st_post GROUP BY subject_id",
)
# two updates: the second pass uses the parameters of the first
chain_fit("fit1", "st_post", "subject_id")
AIJ = [f"p.{TR[3 * i + j]} AS a{i + 1}{j + 1}" for i in range(3) for j in range(3)]
pick = lambda pre, lo, hi: "CASE " + " ".join(f"WHEN {KCASE[i]} THEN {pre}{KAPPAS[i]}" for i in range(lo, hi)) + " END"
cte("fit1_q", f"SELECT *, {', '.join(f'{LOG_TWO_PI}::DOUBLE + {log_i0_sql(k)} AS n_{k}' for k in KAPPAS)} FROM fit1")
cte(
    "it2_src",
    f"""SELECT f.*, {', '.join(AIJ)}, {', '.join(f'p.{x}' for x in PIS)}, {pick('p.', 0, 3)} * cos_s - {pick('p.n_', 0, 3)} AS lb1, {pick('p.', 3, 7)} * cos_p - {pick('p.n_', 3, 7)} AS lb2,
-{LOG_TWO_PI}::DOUBLE AS lb3 FROM feat f JOIN fit1_q p USING (subject_id)""",
)
chain_ctes("it2", "it2_src", K, PIS)
chain_fit("fit2", "it2_post", "subject_id")
cte("fit2_told", "SELECT *, CASE WHEN subject_id % 4 = 3 THEN 'infinity'::DOUBLE ELSE train_ll END AS told_ll FROM fit2")
add(
    "p10_fit_qc",
    f"""SELECT f.subject_id, {r('greatest(fit1.train_ll - f.told_ll, 0.0)')} AS maximum_drop, greatest(fit1.train_ll - f.told_ll, 0.0) <= 1e-8 AS monotonic, NOT (isfinite(fit1.train_ll) AND isfinite(f.told_ll)) AS has_nan_or_inf,
greatest(w1, w2, w3) > 0.98 AS state_collapse_flag, w3 < 0.005 AS lapse_near_zero_flag, least({', '.join('f.' + t for t in TR)}) <= 1e-6 AS transition_near_floor_flag
FROM fit2_told f JOIN fit1 USING (subject_id) JOIN (SELECT subject_id, avg(g1) AS w1, avg(g2) AS w2, avg(g3) AS w3 FROM st_post GROUP BY subject_id) w USING (subject_id)""",
)
# other starting points
for i in range(1, 3):
    chain_ctes(f"st{i}", "emis_start", K, [d(x) for x in fixed.INIT_PI[i]], fixed.INIT_A[i])
    chain_fit(f"fit_init{i}", f"st{i}_post", "subject_id")
DIAG = "(sensory_to_sensory + prior_to_prior + lapse_to_lapse) / 3"
cte(
    "inits",
    " UNION ALL ".join(f"SELECT subject_id, train_ll / n_trials AS l, {DIAG} AS dg FROM {t}" for t in ("fit1", "fit_init1", "fit_init2")),
)
add(
    "a30_init_sensitivity",
    f"SELECT subject_id, {rr('max(l) - min(l) AS ll_range', 'max(dg) - min(dg) AS diag_range', 'max(l) AS best_ll', places=5)} FROM inits GROUP BY subject_id",
)

# ---- block mixture: one update
cte(
    "blk_resp",
    "SELECT b.*, p.tau_0, p.tau_1, p.tau_2, p.block_ll, "
    + ", ".join(f"{d(fixed.CLASS_WEIGHTS[c][s])} * exp(lb{s + 1}) / exp(mix{c}) AS r{c}{s}" for c in range(3) for s in range(3))
    + f" FROM blk_mixes b JOIN blk_post p USING ({SEG})",
)
GB = [" + ".join(f"tau_{c}*r{c}{s}" for c in range(3)) for s in range(2)]
CW = []
for c in range(3):
    den = "+".join(f"sum(tau_{c}*r{c}{s})" for s in range(3))
    CW += [f"(sum(tau_{c}*r{c}{s}) + 1e-6) / ({den} + 3e-6) AS cw_{c}{s}" for s in range(3)]
add(
    "e5_fit_block",
    f"""SELECT subject_id, n_trials, {r('train_ll', 4)} AS train_ll, {rr(*KAPPAS, places=4)}, {rr('rho_0', 'rho_1', 'rho_2', *[f'cw_{c}{s}' for c in range(3) for s in range(3)], places=5)}
FROM (SELECT *, {KAPPA_OUT} FROM (SELECT subject_id, count(*) AS n_trials, {kappa_sums(*GB)}, {', '.join(CW)} FROM blk_resp GROUP BY subject_id))
JOIN (SELECT subject_id, sum(block_ll) AS train_ll, {', '.join(f'(sum(tau_{c}) + 1e-6) / (count(*) + 3e-6) AS rho_{c}' for c in range(3))} FROM blk_post GROUP BY subject_id) USING (subject_id)""",
)

# ---- held-out scoring with parameters per fold
FOLD_A = [
    "CASE fold " + " ".join(f"WHEN {f} THEN {d(fixed.fold_matrix(f)[i][j])}" for f in range(4)) + f" END AS a{i + 1}{j + 1}" for i in range(3) for j in range(3)
]
cte("oof_src", f"SELECT *, {', '.join(FOLD_A)} FROM blk_e")
chain_ctes("oof", "oof_src", SEG, START_PI, back=False)
add("h7_score_held_out", f"SELECT row_id, CAST(fold AS BIGINT) AS fold, {rr(*PRED, *FILT, 'll AS trial_ll')} FROM oof_fwd")
chain_ctes("seg", "blk_e", SEG, START_PI, fixed.START_A)
add(
    "h12_export_scores",
    f"""SELECT row_id, 'final' AS fit_scope, CAST(NULL AS BIGINT) AS fold, {rr(*PRED, *FILT, 'll AS trial_ll')} FROM seg_fwd
UNION ALL SELECT row_id, 'oof', CAST(fold AS BIGINT), {rr(*PRED, *FILT, 'll AS trial_ll')} FROM oof_fwd""",
)

# ---- model comparison under fixed parameters
MODELS = ["independent_switching", "serial_stimulus", "serial_response", "serial_both", "static_hmm", "covariate_hmm"]
SRC = ["mix", "serial_stimulus_m", "serial_response_m", "serial_both_m", "hmm_fwd", "chmm_fwd"]
cte("trial_lls", " UNION ALL ".join(f"SELECT row_id, {K}, ll, '{m}' AS model FROM {t}" for m, t in zip(MODELS, SRC)))
cte(
    "seq_lls",
    f"""SELECT *, test_ll / n_test AS test_ll_per_trial FROM (SELECT model, {K}, count(*) AS n_test, sum(ll) AS test_ll FROM trial_lls GROUP BY model, {K}) JOIN (SELECT {K}, fold, prior_std FROM folds) USING ({K})""",
)
add("a12_seq_scores", f"SELECT model, fold, {K}, n_test, {rr('prior_std', 'test_ll', 'test_ll_per_trial')} FROM seq_lls")
GRID_POINTS = ", ".join(f"({float(a)}::DOUBLE, {float(b)}::DOUBLE)" for a, b in fixed.GRID)
SW = [f"{float(w)!r}::DOUBLE" for w in fixed.WEIGHTS]
SERIAL_LL = f"sum(ln({SW[0]}*exp(kappa_s*cos(y - (theta + alpha_stim*ds + alpha_resp*dr)) - norm_s) + {SW[1]}*exp(lb2) + {SW[2]}*exp(lb3)))"
cte(
    "sercv_terms",
    f"""SELECT fold, {K}, y, theta, kappa_s, norm_s, lb2, lb3, {circ('coalesce(prev_theta, theta)', 'theta')} AS ds, {circ('coalesce(prev_y, y)', 'theta')} AS dr
FROM emis JOIN (SELECT {K}, fold FROM folds) USING ({K})""",
)
SERIAL_FREE = "(VALUES ('independent_switching', 0, 0), ('serial_stimulus', 1, 0), ('serial_response', 0, 1), ('serial_both', 1, 1)) m(model, fs, fr)"
cte("sercv_p0", f"SELECT * FROM (VALUES {GRID_POINTS}) g(alpha_stim, alpha_resp)")
for i, step in enumerate([0.25, 0.0625, 0.015625, 0.00390625]):
    if i:
        near = lambda c, free: f"least(greatest({c} + {free} * k{c[6]}.k * {step!r}::DOUBLE, -0.75::DOUBLE), 0.75::DOUBLE)"  # noqa: B023, E731
        cte(
            f"sercv_p{i}",
            f"""SELECT DISTINCT {near('alpha_stim', 'fs')} AS alpha_stim, {near('alpha_resp', 'fr')} AS alpha_resp
FROM sercv_b{i - 1} JOIN {SERIAL_FREE} USING (model) CROSS JOIN range(-4, 5) ks(k) CROSS JOIN range(-4, 5) kr(k)"""
            + "".join(f" EXCEPT SELECT alpha_stim, alpha_resp FROM sercv_p{j}" for j in range(i)),
        )
    more = f" UNION ALL SELECT fold, alpha_stim, alpha_resp, own FROM sercv_f{i - 1}" if i else ""
    cte(f"sercv_f{i}", f"SELECT fold, alpha_stim, alpha_resp, {SERIAL_LL} AS own FROM sercv_terms CROSS JOIN sercv_p{i} GROUP BY ALL{more}")
    cte(
        f"sercv_b{i}",
        f"""SELECT model, fold, alpha_stim, alpha_resp FROM (SELECT *, row_number() OVER (PARTITION BY model, fold ORDER BY round(train, 6) DESC, alpha_stim, alpha_resp) AS rk FROM (
SELECT fold, alpha_stim, alpha_resp, sum(own) OVER (PARTITION BY alpha_stim, alpha_resp) - own AS train FROM sercv_f{i}) JOIN {SERIAL_FREE}
ON (alpha_stim = 0 OR fs = 1) AND (alpha_resp = 0 OR fr = 1)) WHERE rk = 1""",
    )
cte(
    "sercv",
    f"SELECT model, fold, {K}, alpha_stim, alpha_resp, count(*) AS n_test, {SERIAL_LL} AS test_ll FROM sercv_terms JOIN sercv_b3 USING (fold) GROUP BY ALL",
)
add("e8_serial_cv", f"SELECT model, fold, {K}, n_test, {rr('alpha_stim', 'alpha_resp', 'test_ll')} FROM sercv")
add(
    "a10_serial_cv",
    f"""SELECT model, count(DISTINCT fold) AS folds, {rr('avg(l) AS mean_test_ll_per_trial', 'stddev_samp(l) / sqrt(count(*)) AS se_test_ll_per_trial', 'avg(l) - max(avg(l)) OVER () AS delta_from_best_per_trial')}
FROM (SELECT model, fold, sum(test_ll) / sum(n_test) AS l FROM sercv GROUP BY model, fold) GROUP BY model""",
)
cte("cv_rows", "SELECT model, fold, sum(test_ll) AS test_ll, sum(test_ll) / sum(n_test) AS l FROM seq_lls GROUP BY model, fold")
add(
    "a10_summarise_cv",
    f"""SELECT model, folds, {rr('m AS mean_test_ll_per_trial', 'se AS se_test_ll_per_trial', 'm - max(m) OVER () AS delta_from_best_per_trial')}, {r('ml', 4)} AS mean_test_ll
FROM (SELECT model, count(*) AS folds, avg(l) AS m, stddev_samp(l) / sqrt(count(*)) AS se, avg(test_ll) AS ml FROM cv_rows GROUP BY model)""",
)
add(
    "a11_heldout_summary",
    f"""SELECT model, subject_id, CAST(sum(n_test) AS BIGINT) AS n_trials, {r('sum(test_ll)', 4)} AS total_ll, {rr('sum(test_ll) / sum(n_test) AS ll_per_trial', 'exp(-sum(test_ll) / sum(n_test)) AS perplexity')}
FROM seq_lls GROUP BY model, subject_id""",
)
NPAR = {"independent_switching": 9, "serial_stimulus": 10, "serial_response": 10, "serial_both": 11, "static_hmm": 15, "covariate_hmm": 51}
cte(
    "criteria",
    f"""SELECT *, 2*k - 2*ll AS aic, ln(n_trials::DOUBLE)*k - 2*ll AS bic FROM (SELECT model, subject_id, CAST(sum(n_test) AS BIGINT) AS n_trials, sum(test_ll) AS ll,
CASE model {' '.join(f"WHEN '{m}' THEN {k}" for m, k in NPAR.items())} END::BIGINT AS k FROM seq_lls GROUP BY model, subject_id)""",
)
add("a13_information_criteria", f"SELECT model, subject_id, n_trials, k AS n_parameters, {rr('ll AS log_likelihood', 'aic', 'bic', places=4)} FROM criteria")
add(
    "a13_pooled_criteria",
    f"""SELECT model, n_subjects, n_trials, total_parameters, {rr('ll AS total_log_likelihood', 'a AS aic_sum', 'b AS bic_sum_subjectwise', 'bp AS bic_pooled', 'a - min(a) OVER () AS aic_delta_from_best', 'b - min(b) OVER () AS bic_subjectwise_delta_from_best', 'bp - min(bp) OVER () AS bic_pooled_delta_from_best', places=4)}
FROM (SELECT *, -2*ll + total_parameters * ln(n_trials::DOUBLE) AS bp FROM (SELECT model, count(*) AS n_subjects, CAST(sum(n_trials) AS BIGINT) AS n_trials, CAST(sum(k) AS BIGINT) AS total_parameters, sum(ll) AS ll, sum(aic) AS a, sum(bic) AS b FROM criteria GROUP BY model))""",
)
cte("j5_left", f"SELECT {K}, test_ll AS va FROM seq_lls WHERE model = 'static_hmm'")
cte(
    "j5_right",
    f"""SELECT subject_id, session_id, CASE WHEN session_id % 10 = 0 THEN run_id + 1000 ELSE run_id END AS run_id,
CASE WHEN session_id % 7 = 0 THEN 2 ELSE 1 END AS nb, test_ll * CASE WHEN session_id % 7 = 0 THEN 2 ELSE 1 END AS vb
FROM seq_lls WHERE model = CASE WHEN session_id % 2 = 0 THEN 'static_hmm' ELSE 'independent_switching' END""",
)
cte(
    "j5_met",
    f"""SELECT {K}, CASE WHEN va IS NULL THEN 'right_only' WHEN vb IS NULL THEN 'left_only' ELSE 'both' END AS match,
coalesce(nb, 0) > 1 AS duplicated, abs(va - vb) AS gap FROM j5_left FULL JOIN j5_right USING ({K})""",
)
add(
    "j5_reconcile",
    f"SELECT {K}, match, duplicated, {r('gap')} AS abs_difference FROM j5_met",
)
add("j5_reconcile_summary", f"SELECT count(*) AS n_keys, count(*) FILTER (match = 'both') AS n_both, count(*) FILTER (duplicated) AS n_duplicated, {r('max(gap)')} AS max_abs_difference FROM j5_met")
add(
    "j8_compare_models",
    f"""SELECT row_id, is_start, {rr(*[f'm{i} AS {m}_ll' for i, m in enumerate(MODELS)], *[f'm{i} - m0 AS {m}_delta' for i, m in enumerate(MODELS)])}
FROM feat JOIN (SELECT row_id, {', '.join(f"max(CASE WHEN model = '{m}' THEN ll END) AS m{i}" for i, m in enumerate(MODELS))} FROM trial_lls GROUP BY row_id) USING (row_id)""",
)
add(
    "w16_representative",
    f"""SELECT {K}, {rr('dl AS delta', 'md AS median_delta')} FROM (SELECT {K}, dl, median(dl) OVER () AS md FROM (
SELECT {K}, max(CASE WHEN model = 'static_hmm' THEN test_ll_per_trial END) - max(CASE WHEN model = 'independent_switching' THEN test_ll_per_trial END) AS dl FROM seq_lls GROUP BY {K}))
ORDER BY abs(dl - md), {K} LIMIT 1""",
)
add(
    "a32_score_checks",
    f"""SELECT count(*) AS rows, count(*) FILTER (row_id % 97 = 0) AS not_finite,
{r('max(abs(q1 * CASE WHEN row_id % 89 = 0 THEN 1.5 ELSE 1 END + q2 + q3 - 1))')} AS max_predictive_error,
{r('max(abs(f1 + f2 * CASE WHEN row_id % 83 = 0 THEN 1.5 ELSE 1 END + f3 - 1))')} AS max_filtered_error,
{r('max(abs(g1 + g2 + g3 * CASE WHEN row_id % 79 = 0 THEN 1.5 ELSE 1 END - 1))')} AS max_smoothed_error,
{r('max(abs(xi0 + xi1 + xi2 + xi3 + xi4 * CASE WHEN row_id % 71 = 0 THEN 1.5 ELSE 1 END + xi5 + xi6 + xi7 + xi8 - 1))')} AS max_pairwise_error,
count(*) FILTER (pos = 1 AND row_id % 2 = 0) AS xi_sensory_to_sensory_set_at_start, count(DISTINCT row_id) AS unique_trials,
count(*) - count(DISTINCT row_id) AS scored_more_than_once FROM (SELECT * FROM hmm_post UNION ALL SELECT * FROM hmm_post WHERE row_id % 50 = 0)""",
)

# ---- original against permuted order
block_cte("blks", "seg_perm")
mix_cte("iid_original", "blk_e", START_PI)
mix_cte("iid_shuffled", "blks_e", START_PI)
mix_cte("con_original", "blk_e", COND_W)
mix_cte("con_shuffled", "blks_e", COND_W)
chain_ctes("segp", "blks_e", SEG, START_PI, fixed.START_A)
VERS = [
    ("subject_iid", "iid_original", "iid_shuffled"), ("prior_conditioned_iid", "con_original", "con_shuffled"),
    ("exchangeable_block_mixture", "blk_score", "blks_score"), ("hmm", "seg_fwd", "segp_fwd"),
]
cte(
    "vers",
    " UNION ALL ".join(
        f"SELECT '{m}' AS model, '{v}' AS data_version, subject_id, fold, ll FROM {t}" for m, a, b in VERS for v, t in (("original", a), ("shuffled", b))
    ),
)
add(
    "a11_versions",
    f"""SELECT model, data_version, fold, count(*) AS n_trials, {r('sum(ll)', 4)} AS total_ll, {rr('avg(ll) AS ll_per_trial', 'exp(-avg(ll)) AS perplexity')} FROM vers GROUP BY model, data_version, fold""",
)
cte("vers_all", "SELECT model, avg(CASE WHEN data_version = 'original' THEN ll END) AS o, avg(CASE WHEN data_version = 'shuffled' THEN ll END) AS s FROM vers GROUP BY model")
add(
    "a26_gain_decomposition",
    f"""SELECT b.model AS baseline, {rr('b.o AS baseline_ll_per_trial', 'h.o - b.o AS hmm_original_gain', 'h.s - b.s AS hmm_shuffled_gain', '(h.o - b.o) - (h.s - b.s) AS order_specific_difference_in_differences')}
FROM vers_all b JOIN vers_all h ON h.model = 'hmm' AND b.model <> 'hmm'""",
)
cte(
    "vers_fold",
    "SELECT model, subject_id, fold, sum(CASE WHEN data_version = 'original' THEN ll END) - sum(CASE WHEN data_version = 'shuffled' THEN ll END) AS df FROM vers GROUP BY ALL",
)
add(
    "a27_order_invariance",
    f"""SELECT model, {rr('max(abs(df)) AS max_abs_fold_total_ll_difference', 'sum(df) AS overall_total_ll_difference', places=4)}, max(abs(df)) < 1e-7 AS order_invariant_pass FROM vers_fold GROUP BY model""",
)
cte(
    "vers_subject",
    "SELECT data_version, subject_id, " + ", ".join(f"avg(CASE WHEN model = '{m}' THEN ll END) AS {m}" for m, _, _ in VERS) + " FROM vers GROUP BY data_version, subject_id",
)
BASES = ["subject_iid", "prior_conditioned_iid", "exchangeable_block_mixture"]
cte("vdelta", " UNION ALL ".join(f"SELECT data_version, subject_id, 'hmm_minus_{b}' AS comparison, hmm - {b} AS dl FROM vers_subject" for b in BASES))
add(
    "a28_winner_counts",
    f"""SELECT data_version, comparison, CAST(count(*) FILTER (dl > 0) AS BIGINT) AS subjects_better, CAST(count(*) FILTER (dl < 0) AS BIGINT) AS subjects_baseline_better,
{rr('avg(dl) AS mean_subject_delta', 'min(dl) AS min_delta', 'max(dl) AS max_delta')} FROM vdelta GROUP BY data_version, comparison""",
)
chain_fit("vfit_o", "seg_post", "subject_id")
chain_fit("vfit_s", "segp_post", "subject_id")
VCOLS = ["train_ll", "sensory_to_sensory", "prior_to_prior"]
add(
    "j6_compare_versions",
    f"SELECT subject_id, {rr(*[f'o.{c} AS original_{c}' for c in VCOLS], *[f's.{c} AS shuffled_{c}' for c in VCOLS], *[f'o.{c} - s.{c} AS delta_{c}' for c in VCOLS], places=4)} FROM vfit_o o JOIN vfit_s s USING (subject_id)",
)
ENT = " + ".join(f"-o.{t} * ln(o.{t})" for t in TR)
FROB = " + ".join(f"(o.{t} - s.{t}) * (o.{t} - s.{t})" for t in TR)
add(
    "a25_matrix_metrics",
    f"SELECT subject_id, {rr('(o.sensory_to_sensory + o.prior_to_prior + o.lapse_to_lapse) / 3 AS mean_diagonal_transition', f'({ENT}) / 3 AS transition_entropy', f'sqrt({FROB}) AS frobenius_distance', places=5)} FROM vfit_o o JOIN vfit_s s USING (subject_id)",
)
viterbi_ctes("svit", "blk_e", SEG, START_PI, fixed.START_A)
runs_cte("svit_runs", "svit_path", SEG, "pos", "viterbi_state")
add(
    "a24_dwell_switch",
    f"""SELECT subject_id, {r('sw')} AS switch_rate, {r('dw')} AS mean_state_dwell_time, {rr('d_sensory AS mean_sensory_dwell_time', 'd_prior AS mean_prior_dwell_time', 'd_lapse AS mean_lapse_dwell_time')}
FROM (SELECT subject_id, sum(nr - 1)::DOUBLE / sum(nt - 1) AS sw FROM (SELECT {SEG}, count(*) AS nr, sum(run_length) AS nt FROM svit_runs GROUP BY {SEG}) GROUP BY subject_id)
JOIN (SELECT subject_id, avg(run_length) AS dw, {', '.join(f"avg(run_length) FILTER (viterbi_state = '{s}') AS d_{s}" for s in STATES)} FROM svit_runs GROUP BY subject_id) USING (subject_id)""",
)


def bbv(src: str, version: str) -> str:
    return f"""SELECT '{version}' AS data_version, count(v) AS n_strata, {r('avg(v)')} AS between_block_variance FROM (SELECT subject_id, fold, prior_std, var_samp(m) AS v FROM (
SELECT subject_id, fold, prior_std, block_id, avg(cos_s - cos_p) AS m FROM {src} GROUP BY ALL) GROUP BY ALL)"""


add("a29_between_block_variance", bbv("seg_feat", "original") + " UNION ALL " + bbv("seg_matched", "matched"))
cte(
    "rseg",
    f"""SELECT s.*, sim AS simulation, row_number() OVER (PARTITION BY sim, {SEG} ORDER BY md5(concat_ws('|', '100', sim::VARCHAR, row_id::VARCHAR))) AS pos FROM seg_feat s CROSS JOIN range(3) t(sim)""",
)
emission_cte("rseg_e", "rseg", "start")
chain_ctes("rs", "rseg_e", "simulation, " + SEG, START_PI, fixed.START_A)
chain_fit("rfit", "rs_post", "subject_id, simulation")
add(
    "a31_refit_diagonal_summary",
    f"""SELECT subject_id, {rr('avg(dg) AS sim_mean_diag', 'quantile_cont(dg, 0.025) AS sim_q025', 'quantile_cont(dg, 0.975) AS sim_q975', 'max(og) AS observed_diag', 'avg(CASE WHEN dg >= og THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS fraction_ge_observed', places=5)}
FROM (SELECT subject_id, {DIAG} AS dg FROM rfit) JOIN (SELECT subject_id, {DIAG} AS og FROM vfit_o) USING (subject_id) GROUP BY subject_id""",
)

# ---- resampling


def draws(name: str, units: str, order: str, values: list[str], n_draws: int, seed: int) -> None:
    """Sums of the values over n picks per draw; pick k of draw b is md5(seed, b, k) mod n."""
    cols = ", ".join(f"{c}::VARCHAR" for c in order.split(", "))
    cte(f"{name}_i", f"SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', 'unit', {cols}))) - 1 AS i, count(*) OVER () AS nu FROM {units}")
    cte(
        name,
        f"""SELECT draw, {', '.join(f'sum({v}) AS {v}' for v in values)} FROM (
SELECT draw, ('0x' || substr(md5(concat_ws('|', '{seed}', draw::VARCHAR, k::VARCHAR)), 1, 8))::BIGINT % nu AS i
FROM range({n_draws}) a(draw), (SELECT row_number() OVER () - 1 AS k, nu FROM {name}_i)) JOIN {name}_i USING (i) GROUP BY draw""",
    )


SERIAL = ["serial_stimulus", "serial_response", "serial_both"]
cte(
    "b1s_units",
    f"""SELECT fold, {K}, n_test, {', '.join(f'{m} - independent_switching AS d_{m}' for m in SERIAL)} FROM (
SELECT fold, {K}, max(n_test) AS n_test, {', '.join(f"max(CASE WHEN model = '{m}' THEN test_ll END) AS {m}" for m in ['independent_switching', *SERIAL])} FROM sercv GROUP BY fold, {K})""",
)
draws("b1s_draws", "b1s_units", "fold, " + K, ["n_test", *[f"d_{m}" for m in SERIAL]], 200, 42)
add(
    "b1_serial_cv",
    " UNION ALL ".join(
        f"""SELECT '{m}' AS model, 'independent_switching' AS baseline, (SELECT count(*) FROM b1s_units) AS n_sequences, {r(f'(SELECT sum(d_{m}) / sum(n_test) FROM b1s_units)')} AS observed_delta_ll_per_trial,
{rr('quantile_cont(x, 0.025) AS ci_low', 'quantile_cont(x, 0.975) AS ci_high')} FROM (SELECT d_{m} / n_test AS x FROM b1s_draws)"""
        for m in SERIAL
    ),
)
B1 = MODELS[1:]
cte(
    "b1_units",
    f"""SELECT fold, {K}, n_test, {', '.join(f'{m} - independent_switching AS d_{m}' for m in B1)} FROM (
SELECT fold, {K}, max(n_test) AS n_test, {', '.join(f"max(CASE WHEN model = '{m}' THEN test_ll END) AS {m}" for m in MODELS)} FROM seq_lls GROUP BY fold, {K})""",
)
draws("b1_draws", "b1_units", "fold, " + K, ["n_test", *[f"d_{m}" for m in B1]], 200, 42)
add(
    "b1_bootstrap_diff",
    " UNION ALL ".join(
        f"""SELECT '{m}' AS model, 'independent_switching' AS baseline, (SELECT count(*) FROM b1_units) AS n_sequences, {r(f'(SELECT sum(d_{m}) / sum(n_test) FROM b1_units)')} AS observed_delta_ll_per_trial,
{rr('quantile_cont(x, 0.025) AS ci_low', 'quantile_cont(x, 0.975) AS ci_high', 'avg(x) AS bootstrap_mean', 'stddev_samp(x) AS bootstrap_sd', 'avg(CASE WHEN x <= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p_delta_le_0')} FROM (SELECT d_{m} / n_test AS x FROM b1_draws)"""
        for m in B1
    ),
)
cte("b2_units", f"SELECT fold, {K}, n_test, test_ll FROM seq_lls WHERE model = 'static_hmm'")
draws("b2_draws", "b2_units", "fold, " + K, ["n_test", "test_ll"], 200, 43)
add(
    "b2_bootstrap_ll",
    f"""SELECT {rr('quantile_cont(x, 0.025) AS bootstrap_ci_low', 'quantile_cont(x, 0.975) AS bootstrap_ci_high', 'stddev_samp(x) AS bootstrap_standard_error')} FROM (SELECT test_ll / n_test AS x FROM b2_draws)""",
)
cte("b3_units", "SELECT subject_id, 1.0::DOUBLE AS one, " + ", ".join(f"hmm - {b} AS d_{b}" for b in BASES) + " FROM vers_subject WHERE data_version = 'original'")
draws("b3_draws", "b3_units", "subject_id", ["one", *[f"d_{b}" for b in BASES]], 500, 44)
cte(
    "b3",
    " UNION ALL ".join(
        f"""SELECT 'hmm_minus_{b}' AS comparison, (SELECT CAST(count(*) FILTER (d_{b} > 0) AS BIGINT) FROM b3_units) AS subjects_positive, (SELECT avg(d_{b}) FROM b3_units) AS m,
quantile_cont(d_{b} / one, 0.025) AS lo, quantile_cont(d_{b} / one, 0.975) AS hi FROM b3_draws"""
        for b in BASES
    ),
)
add("b3_bootstrap_subjects", f"SELECT comparison, subjects_positive, {rr('m AS mean_subject_delta', 'lo AS ci_low', 'hi AS ci_high')} FROM b3")
add("p9_equivalence_flags", "SELECT comparison, lo > -0.005 AND hi < 0.005 AS equivalent, lo > 0.005 AS clearly_positive, hi < -0.005 AS clearly_negative FROM b3")
add(
    "j10_attach_intervals",
    f"""SELECT e.subject_id, e.covariate, e.previous_state, e.next_state, {rr('hi - lo AS delta_plus_minus', 'c_lo AS ci_low', 'c_hi AS ci_high')} FROM cov_effects e LEFT JOIN (
SELECT covariate, previous_state, next_state, quantile_cont(hi - lo, 0.025) AS c_lo, quantile_cont(hi - lo, 0.975) AS c_hi FROM cov_effects GROUP BY ALL) c
ON c.covariate = e.covariate AND c.previous_state = e.previous_state AND c.next_state = e.next_state""",
)
for i in range(3):
    matched_cte(f"seg_matched{i}", str(500 + i))
cte("b5_rows", " UNION ALL ".join(f"SELECT *, {i} AS simulation, seg_pos AS pos FROM seg_matched{i}" for i in range(3)))
emission_cte("b5_e", "b5_rows", "start")
cte("b5_src", f"SELECT *, {', '.join(FOLD_A)} FROM b5_e")
chain_ctes("b5c", "b5_src", "simulation, " + SEG, START_PI, back=False)
add("b5_permutation_distribution", f"SELECT simulation, count(*) AS n_trials, {r('sum(ll)', 4)} AS total_ll, {r('avg(ll)')} AS ll_per_trial FROM b5c_fwd GROUP BY simulation")
