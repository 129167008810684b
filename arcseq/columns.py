"""Column names and constants shared by all operators."""

import math

SEQ = ["subject_id", "session_id", "run_id"]
ORDER = "trial_index"
CHUNK = "chunk"

# Rows of one sequence are cut by `trial_index div CHUNK_ROWS`. Every per-row window is partitioned by
# (sequence, chunk), so a sequence of any length spreads over many tasks; what crosses a chunk border
# is carried by a table with one row per chunk.
CHUNK_ROWS = 2048

# Groups above this size are additionally cut by a fine bucket of their sort key (see `ordered.spread`).
HOT_GROUP_ROWS = 200_000

STATES = ["sensory", "prior", "lapse"]
PAIRS = [(a, b) for a in STATES for b in STATES]
TRANSITIONS = [f"{a}_to_{b}" for a, b in PAIRS]
COVARIATES = ["coherence", "prior_precision", "conflict", "prev_error", "prev_conflict", "prev_coherence"]

TWO_PI = 2.0 * math.pi
LOG_TWO_PI = math.log(TWO_PI)

REQUIRED = ["estimate_x", "estimate_y", "motion_direction", "motion_coherence", "prior_std", "prior_mean"]

# Accepted names of each canonical trial field.
ALIASES = {
    "estimate_x": ["estimate_x", "resp_x", "response_x"],
    "estimate_y": ["estimate_y", "resp_y", "response_y"],
    "motion_direction": ["motion_direction", "direction", "stim_direction", "true_direction"],
    "motion_coherence": ["motion_coherence", "coherence"],
    "prior_std": ["prior_std", "prior_sd", "std_prior"],
    "prior_mean": ["prior_mean", "prior_mu", "mean_prior"],
    "subject_id": ["subject_id", "subject", "sub"],
    "session_id": ["session_id", "session", "sess"],
    "run_id": ["run_id", "run", "block", "block_id"],
    "trial_index": ["trial_index", "trial", "trial_id"],
}
