"""Small parameter objects and the tables that carry them into Spark."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcseq.functions.bessel import i1_over_i0, log_norm


@dataclass
class Params:
    kappa_s: dict[float, float]
    kappa_p: dict[float, float]
    weights: tuple = ()
    pi: tuple = ()
    A: tuple = ()
    alpha_stim: float = 0.0
    alpha_resp: float = 0.0
    B: tuple = ()  # previous state x next state x (intercept + covariates)
    rho: tuple = ()
    class_weights: tuple = ()
    class_pi: tuple = ()
    class_A: tuple = ()
    condition_weights: dict = field(default_factory=dict)


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, (bool, np.bool_)):
        return "true" if v else "false"
    if isinstance(v, (int, np.integer)):
        return f"{int(v)}L"
    if isinstance(v, (float, np.floating)):
        v = float(v)
        return f"{v!r}D" if np.isfinite(v) else f"double('{v}')"
    return "'" + str(v).replace("'", "''") + "'"


def values_table(spark: SparkSession, cols: list[str], rows: list[tuple]) -> DataFrame:
    """A few rows as a local relation (no job, no Python worker)."""
    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(cols)})")


def level_params(spark: SparkSession, kappas: dict[float, float], level: str, tag: str) -> DataFrame:
    norms = log_norm(np.array(list(kappas.values())))
    rows = [
        (float(k), float(v), float(n), float(a))
        for (k, v), n, a in zip(kappas.items(), norms, i1_over_i0(np.array(list(kappas.values()))))
    ]
    return values_table(spark, [level, f"kappa_{tag}", f"norm_{tag}", f"resultant_{tag}"], rows)


def attach_params(df: DataFrame, params: Params) -> DataFrame:
    """kappa and log normaliser of the trial's coherence and prior width (one row per level is broadcast)."""
    spark = df.sparkSession
    ks = level_params(spark, params.kappa_s, "motion_coherence", "s")
    kp = level_params(spark, params.kappa_p, "prior_std", "p")
    wide = df.join(F.broadcast(ks), "motion_coherence", "left").join(F.broadcast(kp), "prior_std", "left")
    return wide.withColumns({"kappa_s": known("kappa_s", "motion_coherence"), "kappa_p": known("kappa_p", "prior_std")})


def known(value: str, level: str) -> Column:
    """The value looked up for a level; a level without one is an error, not a lost row."""
    told = F.concat(F.lit(f"no parameters for {level} "), F.coalesce(F.col(level).cast("string"), F.lit("NULL")))
    return F.when(F.col(value).isNull(), F.raise_error(told).cast("double")).otherwise(F.col(value))


def params_to_json(cols: dict[str, Column]) -> Column:
    """JSON text of a map name -> value, keys in the order given."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in cols.items()]))


def params_from_json(text: Column, names: list[str]) -> list[Column]:
    parsed = F.from_json(text, "map<string,double>")
    return [F.try_element_at(parsed, F.lit(n)).alias(n) for n in names]
