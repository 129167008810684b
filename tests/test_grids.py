import numpy as np
import pytest

from arcseq.operators import grids
from arcseq.plans import fixed

DEG = np.arange(360)
SPEC = fixed.OBSERVER


def vm(center, x, kappa):
    return np.exp(kappa * (np.cos(np.deg2rad(x - center)) - 1))


def unit(v):
    return v / v.sum()


def brute(direction, coherence, width, mean, readout):
    """The response distribution of one condition by loops over whole 360 x 360 grids."""
    ke, kp, km = SPEC["kappa_e"][coherence], SPEC["kappa_p"][width], SPEC["kappa_m"]
    pe = unit(vm(direction, DEG, ke))
    pe[pe < 1e-12] = 0
    out = np.zeros(360)
    for e in DEG:
        if readout == "switch":
            out += pe[e] * unit(vm(e, DEG, km))
            continue
        log_u = ke * (np.cos(np.deg2rad(DEG - e)) - 1) + kp * (np.cos(np.deg2rad(DEG - mean)) - 1)
        u = unit(np.exp(log_u))
        if readout == "map":
            out += pe[e] * unit(vm(int(np.argmax(np.round(log_u, 9))), DEG, km))
        elif readout == "mean":
            c = np.rad2deg(np.arctan2((u * np.sin(np.deg2rad(DEG))).sum(), (u * np.cos(np.deg2rad(DEG))).sum()))
            out += pe[e] * unit(vm(c, DEG, km))
        else:
            out += pe[e] * sum(u[h] * unit(vm(h, DEG, km)) for h in DEG if u[h] > 1e-8)
    if readout == "switch":
        w = kp / (kp + ke)
        out = (1 - w) * out + w * unit(vm(mean, DEG, km))
    return unit(out * (1 - SPEC["lapse"]) + SPEC["lapse"] / 360)


def conditions(spark):
    coherence, width = sorted(SPEC["kappa_e"]), sorted(SPEC["kappa_p"])
    # a direction between two degrees, one opposite the prior (its best percepts are tied), a negative one
    rows = [(17.25, coherence[0], width[0], 225.0), (45.0, coherence[0], width[-1], 225.0), (-5.0, coherence[-1], width[1], 225.0)]
    return spark.createDataFrame(rows, "motion_direction double, motion_coherence double, prior_std double, prior_mean double")


@pytest.mark.parametrize("readout", ["map", "mean", "sample", "switch"])
def test_distributions_against_loops(spark, readout):
    rows = conditions(spark)
    grid = grids.switch_grid(rows, SPEC) if readout == "switch" else grids.bayes_grid(rows, SPEC, readout)
    got = grid.toPandas()
    assert len(got) == 3 * 360
    for r in rows.collect():
        own = got[got.motion_direction == r["motion_direction"]].sort_values("g")
        assert own.g.tolist() == DEG.tolist()
        np.testing.assert_allclose(own.p.to_numpy(), brute(*r, readout), atol=1e-12)


@pytest.mark.parametrize("readout", ["map", "mean", "sample"])
def test_only_the_finished_distribution_is_exploded(spark, readout):
    plan = grids.bayes_grid(conditions(spark), SPEC, readout)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") == 1 and "Aggregate [motion_direction" not in plan


def test_no_conditions(spark):
    assert grids.bayes_grid(conditions(spark).limit(0), SPEC, "sample").count() == 0
