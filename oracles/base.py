"""Shared SQL fragments. `query(final, *names)` prepends the named CTEs and what they depend on."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def r(expr: str, places: int = 6) -> str:
    return f"(round(({expr})::DOUBLE, {places}) + 0.0)"


def rr(*cols: str, places: int = 6) -> str:
    """Rounded columns; 'name' or 'expr AS name'."""
    out = []
    for c in cols:
        expr, _, name = c.rpartition(" AS ")
        out.append(f"{r(expr or name, places)} AS {name}")
    return ", ".join(out)


def cte(name: str, sql: str) -> str:
    CTES[name] = sql.strip()
    return name


def query(final: str, extra: dict[str, str] | None = None) -> str:
    """WITH clause holding every CTE that the text mentions, in dependency order."""
    known = {**CTES, **(extra or {})}
    order: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for word in re.findall(r"[a-z_][a-z0-9_]*", text):
            if word in known and word not in seen:
                seen.add(word)
                visit(known[word])
                order.append(word)  # a recursive table names itself, which `seen` already covers

    visit(final)
    if not order:
        return final.strip()
    body = ",\n".join(f"{n} AS ({known[n]})" for n in order)
    return f"WITH RECURSIVE {body}\n{final.strip()}"


def circ(a: str, b: str) -> str:
    return f"atan2(sin({a}-({b})), cos({a}-({b})))"


def relative(rad: str) -> str:
    """Degrees in (-180, 180] to nine decimals: the rule of the histograms."""
    deg = f"round(degrees({rad}), 9)"
    return f"(CASE WHEN {deg} = -180.0 THEN 180.0::DOUBLE ELSE {deg} END)"


def pmod(x: str, m: str) -> str:
    return f"(((({x}) % {m}) + {m}) % {m})"


K = "subject_id, session_id, run_id"
W = f"(PARTITION BY {K} ORDER BY trial_index)"
TWO_PI = "6.283185307179586"
PI = "3.141592653589793"
LOG_TWO_PI = "1.8378770664093453"

cte(
    "c_numbered",
    """
SELECT event_id, ts, value, CAST(user_id % 12 + 1 AS BIGINT) AS subject_id, user_id AS session_id,
  CAST(floor((day(ts) - 1) / 10) + 1 AS BIGINT) AS run_id,
  CAST(row_number() OVER (PARTITION BY user_id, floor((day(ts) - 1) / 10) ORDER BY ts, event_id) AS BIGINT) AS trial_index
FROM events
""",
)
cte(
    "c_conditions",
    """
SELECT *,
  CASE event_id % 3 WHEN 0 THEN 0.06::DOUBLE WHEN 1 THEN 0.12::DOUBLE ELSE 0.24::DOUBLE END AS motion_coherence,
  CASE (session_id + run_id) % 4 WHEN 0 THEN 10.0::DOUBLE WHEN 1 THEN 20.0::DOUBLE WHEN 2 THEN 40.0::DOUBLE
    ELSE 80.0::DOUBLE END AS prior_std,
  ((event_id * 7 % 36) * 10 + 5)::DOUBLE AS motion_direction, 225.0::DOUBLE AS prior_mean
FROM c_numbered
""",
)
cte(
    "c_angle",
    """
SELECT *, CASE WHEN event_id % 13 = 0 THEN ((event_id * 37) % 360)::DOUBLE + 0.37::DOUBLE
  WHEN ((trial_index - 1) // 5) % 2 = 0 THEN motion_direction + sin(value) * 3.0::DOUBLE / motion_coherence
  ELSE prior_mean + sin(value * 1.7::DOUBLE) * prior_std * 0.6::DOUBLE END AS angle
FROM c_conditions
""",
)
cte(
    "c_trials",
    """
SELECT event_id AS row_id, subject_id, session_id, run_id, trial_index,
  (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::DOUBLE AS trial_time,
  ((event_id * 11) % 360)::DOUBLE AS response_arrow_start_angle, motion_direction, motion_coherence,
  CASE WHEN event_id % 97 <> 0 THEN cos(radians(angle)) END AS estimate_x,
  CASE WHEN event_id % 97 <> 0 THEN sin(radians(angle)) END AS estimate_y,
  value / 100.0::DOUBLE AS reaction_time, value / 50.0::DOUBLE AS raw_response_time, prior_std, prior_mean,
  'direction_estimation' AS experiment_name, 11::BIGINT AS experiment_id
FROM c_angle
""",
)
cte(
    "c_usable",
    f"""
SELECT *, {pmod('degrees(atan2(estimate_y, estimate_x)) + 360.0::DOUBLE', '360.0::DOUBLE')} AS estimate_deg
FROM c_trials WHERE estimate_x IS NOT NULL AND estimate_y IS NOT NULL AND motion_direction IS NOT NULL
  AND motion_coherence IS NOT NULL AND prior_std IS NOT NULL AND prior_mean IS NOT NULL
""",
)
cte(
    "c_rad",
    f"""
SELECT *, radians({pmod('estimate_deg', '360.0::DOUBLE')}) AS y, radians({pmod('motion_direction', '360.0::DOUBLE')}) AS theta,
  radians({pmod('prior_mean', '360.0::DOUBLE')}) AS mu FROM c_usable
""",
)
cte(
    "c_diff",
    f"""
SELECT *, {circ('y', 'theta')} AS error, {circ('y', 'mu')} AS prior_error, {circ('theta', 'mu')} AS conflict FROM c_rad
""",
)
cte(
    "feat",
    f"""
SELECT *, cos(error) AS cos_s, cos(prior_error) AS cos_p,
  CAST(row_number() OVER {W} AS BIGINT) AS pos,
  CAST(count(*) OVER (PARTITION BY {K}) AS BIGINT) AS seq_len,
  row_number() OVER {W} = 1 AS is_start,
  lag(theta) OVER {W} AS prev_theta, lag(y) OVER {W} AS prev_y, lag(error) OVER {W} AS prev_error,
  lag(conflict) OVER {W} AS prev_conflict, lag(motion_coherence) OVER {W} AS prev_motion_coherence,
  lag(motion_direction) OVER {W} AS prev_motion_direction, lag(estimate_deg) OVER {W} AS prev_estimate_deg
FROM c_diff
""",
)
cte(
    "covs",
    """
SELECT *, motion_coherence AS x_coherence, 1.0::DOUBLE / greatest(prior_std, 1e-6::DOUBLE) AS x_prior_precision,
  abs(conflict) AS x_conflict, coalesce(abs(prev_error), 0.0::DOUBLE) AS x_prev_error,
  coalesce(abs(prev_conflict), 0.0::DOUBLE) AS x_prev_conflict,
  coalesce(prev_motion_coherence, motion_coherence) AS x_prev_coherence
FROM feat
""",
)
cte(
    "seg_flags",
    f"""
SELECT *, (estimate_x IS NULL OR estimate_y IS NULL) AS miss,
  lag(estimate_x IS NULL OR estimate_y IS NULL) OVER {W} AS pmiss FROM c_trials
""",
)
cte(
    "segs",
    f"""
SELECT * EXCLUDE (miss, pmiss, n_open), n_open AS segment_number,
  printf('s%02d_session%03d_run%03d', subject_id, session_id, run_id) AS block_id,
  printf('s%02d_session%03d_run%03d_segment%02d', subject_id, session_id, run_id, n_open) AS segment_id
FROM (SELECT *, CAST(sum(CASE WHEN NOT miss AND coalesce(pmiss, true) THEN 1 ELSE 0 END) OVER {W} AS BIGINT) AS n_open
  FROM seg_flags) WHERE NOT miss
""",
)
cte("seqs", f"SELECT {K}, count(*) AS n, min(prior_std) AS prior_std FROM feat GROUP BY {K}")


def md5_int(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 8))::BIGINT"
