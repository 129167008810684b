"""Response distributions of grid observers, per condition, on a one-degree grid.

The work grows with the number of distinct conditions (a product of level counts), never with the trials. A condition is
one row: its evidence, percepts and response probabilities are arrays over the 360 degrees, convolved on the circle inside
an expression. Only the finished distribution is exploded, into 360 rows. What the true direction plays no part in (the
percept of each evidence degree) is worked out once per coherence and prior and joined to the conditions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcseq.functions import circular as C
from arcseq.operators.params import values_table

KEYS = ["motion_direction", "motion_coherence", "prior_std", "prior_mean"]
COMBO = ["motion_coherence", "prior_std", "prior_mean"]
#: Evidence less likely than this, and sampled percepts less likely than this given the evidence, are left out.
LEAST_EVIDENCE = 1e-12
LEAST_SHARE = 1e-8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value worked out once, also where the body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def degrees() -> Column:
    return F.sequence(F.lit(0), F.lit(359))


def on_grid(value: Callable[[Column], Column]) -> Column:
    return F.transform(degrees(), value)


def sum_of(terms: Callable[[Column], Column]) -> Column:
    """Sum of `terms(m)` over the degrees."""
    return F.aggregate(degrees(), C.dbl(0.0), lambda s, m: s + terms(m))


def normal(values: Column) -> Column:
    return let(values, lambda v: let(sum_of(lambda m: v[m]), lambda t: F.transform(v, lambda x: x / t)))


def offset(a: Column, b: Column) -> Column:
    return F.pmod(a - b, F.lit(360))


def spread(weights: Column, kernel: Column) -> Column:
    """Circular convolution of two arrays over the degrees."""
    return let(weights, lambda w: let(kernel, lambda k: on_grid(lambda g: sum_of(lambda m: w[m] * k[offset(g, m)]))))


def log_vm(center_deg: Column, grid: Column, kappa: Column) -> Column:
    """Log weight of a degree around a centre that need not lie on the grid, without its constant."""
    return kappa * (F.cos(F.radians(grid - center_deg)) - 1)


def kernel(kappa: Column) -> Column:
    """von Mises weights at offsets 0..359 degrees, normalised on the grid."""
    return normal(on_grid(lambda o: F.exp(log_vm(C.dbl(0.0), o, kappa))))


def evidence() -> Column:
    """Probability of each evidence degree of a condition (negligible ones set to zero)."""
    own = normal(on_grid(lambda e: F.exp(log_vm(F.col("motion_direction"), e, F.col("ke")))))
    return F.transform(own, lambda x: F.when(x >= LEAST_EVIDENCE, x).otherwise(C.dbl(0.0)))


def prior_weights() -> Column:
    return on_grid(lambda h: F.exp(log_vm(F.col("prior_mean"), h, F.col("kp"))))


def _levels(spark, kappas: dict[float, float], level: str, name: str) -> DataFrame:
    return F.broadcast(values_table(spark, [level, name], [(float(k), float(v)) for k, v in kappas.items()]))


def _with_levels(rows: DataFrame, observer: dict) -> DataFrame:
    """Rows with the concentrations of their coherence (`ke`) and prior (`kp`), dealt over the tasks: a row is much work."""
    spark = rows.sparkSession
    ke = _levels(spark, observer["kappa_e"], "motion_coherence", "ke")
    kp = _levels(spark, observer["kappa_p"], "prior_std", "kp")
    return rows.repartition(spark.sparkContext.defaultParallelism, *rows.columns).join(ke, "motion_coherence").join(kp, "prior_std")


def _finish(rows: DataFrame, p: Column, lapse: float) -> DataFrame:
    """Mix with the uniform and renormalise; one row per condition and grid degree."""
    mixed = normal(F.transform(p, lambda x: x * (1 - lapse) + F.lit(lapse / 360)))
    return rows.select(*KEYS, F.posexplode(mixed).alias("g", "p"))


def map_percepts() -> Column:
    """The likeliest percept of each evidence degree.

    Ties go to the smallest degree, as an arg-max over the grid does; the rounding keeps both neighbours of an exact tie
    equal whatever the order of addition.
    """
    around = on_grid(lambda o: log_vm(C.dbl(0.0), o, F.col("ke")))
    prior = on_grid(lambda h: log_vm(F.col("prior_mean"), h, F.col("kp")))

    def best(k: Column, q: Column) -> Column:
        return on_grid(lambda e: -F.array_max(on_grid(lambda h: F.struct(F.round(k[offset(h, e)] + q[h], 9), (-h).alias("n"))))["n"])

    return let(around, lambda k: let(prior, lambda q: best(k, q)))


def mean_percepts(km: Column) -> Column:
    """(c: circular posterior mean, t: weights of the motor noise around it summed over the grid) of each evidence degree."""

    def centres(k: Column, q: Column) -> Column:
        x = spread(F.transform(q, lambda v, h: v * F.cos(F.radians(h))), k)
        y = spread(F.transform(q, lambda v, h: v * F.sin(F.radians(h))), k)
        return F.zip_with(x, y, lambda a, b: C.rad2deg(F.atan2(b, a)))

    means = let(kernel(F.col("ke")), lambda k: let(prior_weights(), lambda q: centres(k, q)))
    return F.transform(means, lambda c: F.struct(c.alias("c"), sum_of(lambda g: F.exp(log_vm(c, g, km))).alias("t")))


def sampled_percepts() -> Column:
    """Probability of each percept of a condition when it is drawn from the posterior."""

    def drawn(pe: Column, k: Column, q: Column, t: Column) -> Column:
        def share(h: Column, e: Column) -> Column:
            return let(k[offset(h, e)] * q[h] / t[e], lambda x: F.when(x > LEAST_SHARE, pe[e] * x).otherwise(C.dbl(0.0)))

        return on_grid(lambda h: sum_of(lambda e: share(h, e)))

    inner = lambda pe, k, q: let(spread(q, k), lambda t: drawn(pe, k, q, t))
    return let(evidence(), lambda pe: let(kernel(F.col("ke")), lambda k: let(prior_weights(), lambda q: inner(pe, k, q))))


def bayes_grid(conditions: DataFrame, observer: dict, readout: str = "map") -> DataFrame:
    """Bayesian observer: percept from the posterior (map, mean or sample), then motor noise and lapses."""
    km = C.dbl(float(observer["kappa_m"]))
    if readout == "sample":
        return _finish(_with_levels(conditions.select(*KEYS), observer), spread(sampled_percepts(), kernel(km)), observer["lapse"])
    percepts = _with_levels(conditions.select(*COMBO).distinct(), observer)
    percepts = percepts.select(*COMBO, (map_percepts() if readout == "map" else mean_percepts(km)).alias("percepts"))
    rows = _with_levels(conditions.select(*KEYS), observer).join(percepts, COMBO)
    if readout == "map":
        p = lambda pe, of, k: on_grid(lambda g: sum_of(lambda e: pe[e] * k[offset(g, of[e])]))
    else:
        p = lambda pe, of, k: on_grid(lambda g: sum_of(lambda e: pe[e] * F.exp(log_vm(of[e]["c"], g, km)) / of[e]["t"]))
    dist = let(evidence(), lambda pe: let(F.col("percepts"), lambda of: let(kernel(km), lambda k: p(pe, of, k))))
    return _finish(rows, dist, observer["lapse"])


def switch_grid(conditions: DataFrame, observer: dict) -> DataFrame:
    """Switching observer: prior or evidence with odds kappa_p : kappa_e, each with motor noise."""
    km = C.dbl(float(observer["kappa_m"]))
    rows = _with_levels(conditions.select(*KEYS), observer)
    prior = normal(on_grid(lambda g: F.exp(log_vm(F.col("prior_mean"), g, km))))
    share = F.col("kp") / F.greatest(F.col("kp") + F.col("ke"), C.dbl(1e-12))
    return _finish(rows, F.zip_with(spread(evidence(), kernel(km)), prior, lambda a, b: (1 - share) * a + share * b), observer["lapse"])


def grid_loglik(trials: DataFrame, grid: DataFrame) -> DataFrame:
    """Log density of each response by linear interpolation between neighbouring degrees.

    The two grid values are looked up by equality on (condition, degree); the grid holds 360 rows per
    condition and pairs each degree with its successor before the join.
    """
    follower = grid.withColumn("g", F.pmod(F.col("g") - 1, F.lit(360)).cast("int")).withColumnRenamed("p", "p_next")
    pairs = grid.join(follower, [*KEYS, "g"])
    deg = F.pmod(F.degrees("y"), C.dbl(360))
    rows = trials.withColumn("__deg", deg).withColumn("g", (F.floor("__deg") % 360).cast("int"))
    frac = F.col("__deg") - F.floor("__deg")
    density = (1 - frac) * F.col("p") + frac * F.col("p_next")
    return rows.join(pairs, [*KEYS, "g"]).withColumn("trial_ll", F.log(F.greatest(density, C.dbl(1e-300)))).drop(
        "__deg", "g", "p", "p_next"
    )
