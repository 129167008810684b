"""Angle arithmetic and small probability helpers as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from arcseq.columns import STATES, TWO_PI


def dbl(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def deg2rad(deg: Column) -> Column:
    return F.radians(F.pmod(deg, dbl(360)))


def rad2deg(rad: Column) -> Column:
    return F.pmod(F.degrees(rad), dbl(360))


def wrap_rad(rad: Column) -> Column:
    return F.pmod(rad, dbl(TWO_PI))


def wrap_pi(rad: Column) -> Column:
    """Wrap into [-pi, pi)."""
    return F.pmod(rad + dbl(TWO_PI / 2), dbl(TWO_PI)) - dbl(TWO_PI / 2)


def circ_diff(a: Column, b: Column) -> Column:
    """Signed difference a-b in [-pi, pi]."""
    return F.atan2(F.sin(a - b), F.cos(a - b))


def circ_absdiff(a: Column, b: Column) -> Column:
    return F.abs(circ_diff(a, b))


def response_deg(x: Column, y: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(y, x)) + dbl(360), dbl(360))


def conflict_deg(direction: Column, prior_mean: Column) -> Column:
    return F.abs(F.pmod(direction - prior_mean + dbl(180), dbl(360)) - dbl(180))


def conflict_bin(conflict: Column) -> Column:
    return (
        F.when(conflict < 30, "near (<30 deg)")
        .when(conflict < 60, "medium (30-60 deg)")
        .otherwise("far (>=60 deg)")
    )


def relative_deg(rad: Column) -> Column:
    """A signed difference in degrees for binning, in (-180, 180], to nine decimals: a response on an edge is on it whatever the
    last bits of sine and cosine are, and the opposite direction is 180."""
    deg = F.round(F.degrees(rad), 9)
    return F.when(deg == dbl(-180), dbl(180)).otherwise(deg)


def hist_bin(relative_deg: Column, width: int = 15) -> Column:
    """Index of the bin on [-180, 180]; the last bin is closed on the right."""
    last = 360 // width - 1
    return F.least(F.floor((relative_deg + dbl(180)) / dbl(width)), F.lit(last)).cast("int")


def log_vonmises(cos_delta: Column, kappa: Column, log_norm: Column) -> Column:
    """`log_norm` is log(2 pi I0(kappa)), looked up per level and never evaluated per row."""
    return kappa * cos_delta - log_norm


def kappa_from_r(r: Column) -> Column:
    """Piecewise concentration estimate, clipped to [1e-8, 5000]."""
    r = F.least(F.greatest(dbl(r), dbl(0)), dbl(0.999999999))
    r3 = r * r * r
    low = 2 * r + r3 + 5 * r3 * r * r / 6
    mid = dbl(-0.4) + dbl(1.39) * r + dbl(0.43) / (1 - r)
    high = 1 / F.greatest(r3 - 4 * r * r + 3 * r, dbl(1e-12))
    value = F.when(r < dbl(1e-8), dbl(1e-8)).when(r < dbl(0.53), low).when(r < dbl(0.85), mid).otherwise(high)
    return F.least(F.greatest(value, dbl(1e-8)), dbl(5000))


def circ_sd_deg(mean_cos: Column, mean_sin: Column) -> Column:
    r = F.least(F.greatest(F.sqrt(mean_cos * mean_cos + mean_sin * mean_sin), dbl(1e-12)), dbl(1))
    return F.degrees(F.sqrt(F.greatest(-2 * F.log(r), dbl(0))))


def circ_mean_deg(mean_cos: Column, mean_sin: Column) -> Column:
    return F.degrees(F.atan2(mean_sin, mean_cos))


def logsumexp(cols: list[Column]) -> Column:
    top = F.greatest(*cols)
    return top + F.log(reduce(lambda a, b: a + b, [F.exp(c - top) for c in cols]))


def softmax(cols: list[Column]) -> list[Column]:
    top = F.greatest(*cols)
    parts = [F.exp(c - top) for c in cols]
    total = reduce(lambda a, b: a + b, parts)
    return [p / total for p in parts]


def density_ratio(delta_ll: Column) -> Column:
    return F.exp(delta_ll)


def perplexity(ll_per_trial: Column) -> Column:
    return F.exp(-ll_per_trial)


def geometric_run(stay: Column) -> Column:
    """Expected run length 1/(1-p); infinite at p = 1, NaN outside [0, 1]."""
    return (
        F.when(stay == 1, dbl(float("inf")))
        .when((stay >= 0) & (stay < 1), F.try_divide(dbl(1), 1 - stay))
        .otherwise(dbl(float("nan")))
    )


def argmax_state(p: list[Column]) -> Column:
    """Label of the largest probability; ties go to the earlier state."""
    s, q, l = p
    return F.when((s >= q) & (s >= l), STATES[0]).when(q >= l, STATES[1]).otherwise(STATES[2])


def block_id(subject: Column, session: Column, run: Column) -> Column:
    return F.format_string("s%02d_session%03d_run%03d", subject, session, run)


def condition_label(coherence: Column, prior_std: Column) -> Column:
    """Level pair such as 0.06/10, without trailing zeros."""

    def plain(c: Column) -> Column:
        return F.regexp_replace(F.format_string("%.12f", dbl(c)), r"\.?0+$", "")

    return F.concat_ws("/", plain(coherence), plain(prior_std))


def i1_over_i0(kappa: Column, depth: int = 500) -> Column:
    """Bessel ratio by its continued fraction; meant for parameter tables, one row per level."""
    steps = F.sequence(F.lit(depth), F.lit(1), F.lit(-1))
    return F.aggregate(steps, dbl(0), lambda r, n: 1 / (2 * n / kappa + r))


def kappa_sd_deg(kappa: Column) -> Column:
    r = F.least(F.greatest(i1_over_i0(kappa), dbl(1e-300)), dbl(1))
    return F.when(kappa <= 0, dbl(float("inf"))).otherwise(F.degrees(F.sqrt(-2 * F.log(r))))


def log_i0(kappa: Column) -> Column:
    """log I0; power series below 20, asymptotic series above. For parameter tables."""
    z = kappa * kappa / 4
    series = F.aggregate(
        F.sequence(F.lit(60), F.lit(1), F.lit(-1)), dbl(1), lambda h, k: 1 + z / (k.cast("double") * k) * h
    )
    tail = F.aggregate(
        F.sequence(F.lit(25), F.lit(1), F.lit(-1)),
        dbl(1),
        lambda h, k: 1 + (2 * k - 1) * (2 * k - 1) / (8 * k.cast("double") * F.greatest(kappa, dbl(20))) * h,
    )
    big = kappa - F.log(dbl(TWO_PI) * F.greatest(kappa, dbl(20))) / 2 + F.log(tail)
    return F.when(kappa < 20, F.log(series)).otherwise(big)
