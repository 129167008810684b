"""Fixed parameter sets that the registered scoring queries use."""

from __future__ import annotations

from math import log

from arcseq.operators.params import Params

COH = [0.06, 0.12, 0.24]
PRIOR = [10.0, 20.0, 40.0, 80.0]

# Concentrations, mixture weights, serial coefficients and chain parameters.
KAPPA_S = {0.06: 2.0, 0.12: 5.0, 0.24: 12.0}
KAPPA_P = {10.0: 18.0, 20.0: 8.0, 40.0: 4.0, 80.0: 3.0}
WEIGHTS = (0.55, 0.35, 0.10)
ALPHA_STIM, ALPHA_RESP = 0.08, -0.05
PI = (0.6, 0.3, 0.1)
A = ((0.8, 0.15, 0.05), (0.12, 0.82, 0.06), (0.4, 0.2, 0.4))

# Starting point of the subject-level fits.
START_PI = (0.60, 0.35, 0.05)
START_A = ((0.80, 0.15, 0.05), (0.15, 0.80, 0.05), (0.40, 0.40, 0.20))
START_KAPPA_S = {0.06: 1.5, 0.12: 4.5, 0.24: 20.0}
START_KAPPA_P = {10.0: 30.0, 20.0: 6.0, 40.0: 1.0, 80.0: 0.5}

# Block classes and their chains.
RHO = (1 / 3, 1 / 3, 1 / 3)
CLASS_WEIGHTS = ((0.88, 0.10, 0.02), (0.10, 0.88, 0.02), (0.47, 0.43, 0.10))
CLASS_PI = ((0.85, 0.13, 0.02), (0.13, 0.85, 0.02), (0.45, 0.35, 0.20))
CLASS_A = (
    ((0.92, 0.07, 0.01), (0.30, 0.68, 0.02), (0.55, 0.25, 0.20)),
    ((0.68, 0.30, 0.02), (0.07, 0.92, 0.01), (0.25, 0.55, 0.20)),
    ((0.70, 0.20, 0.10), (0.20, 0.70, 0.10), (0.25, 0.25, 0.50)),
)

CONDITION_WEIGHTS = {w: (0.3 + 0.004 * w, 0.6 - 0.004 * w, 0.1) for w in PRIOR}


def slope(i: int, j: int, p: int) -> float:
    """Covariate coefficient p (1..6) of the transition i -> j."""
    return 0.1 * ((i + 2 * j + p) % 5 - 2)


B = tuple(tuple(tuple([log(A[i][j])] + [slope(i, j, p) for p in range(1, 7)]) for j in range(3)) for i in range(3))

MAIN = Params(
    KAPPA_S, KAPPA_P, weights=WEIGHTS, pi=PI, A=A, alpha_stim=ALPHA_STIM, alpha_resp=ALPHA_RESP, B=B,
    rho=RHO, class_weights=CLASS_WEIGHTS, class_pi=CLASS_PI, class_A=CLASS_A, condition_weights=CONDITION_WEIGHTS,
)
START = Params(
    START_KAPPA_S, START_KAPPA_P, weights=START_PI, pi=START_PI, A=START_A, rho=RHO, class_weights=CLASS_WEIGHTS,
    class_pi=CLASS_PI, class_A=CLASS_A, condition_weights=CONDITION_WEIGHTS, B=B,
)
GRID = [(a / 4, b / 4) for a in range(-3, 4) for b in range(-3, 4)]  # [-0.75, 0.75] in steps of 0.25

# Grid observers (evidence, prior and motor concentrations, lapse rate).
OBSERVER = {"kappa_e": KAPPA_S, "kappa_p": KAPPA_P, "kappa_m": 25.0, "lapse": 0.02}

N_FOLDS = 4


def fold_matrix(fold: int) -> tuple:
    """Transition matrix used for held-out scoring of a fold: less sticky for later folds."""
    mix = 0.05 * fold
    return tuple(tuple((1 - mix) * a + mix / 3 for a in row) for row in START_A)


# Starting matrices of the restarts.
INIT_A = [START_A, (START_PI, START_PI, START_PI), ((1 / 3,) * 3,) * 3]
INIT_PI = [START_PI, START_PI, (1 / 3,) * 3]
INIT_WEIGHTS = [(0.65, 0.30, 0.05), (0.40, 0.40, 0.20), (1 / 3, 1 / 3, 1 / 3)]
