"""Fits keyed by a table: against the list-keyed fits, at borders, and with many keys."""

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcseq.columns import SEQ
from arcseq.operators import em, keyed
from arcseq.operators import recursions as rec
from arcseq.operators import trial_table as tt
from arcseq.plans.fixed import COH, INIT_A, INIT_PI, INIT_WEIGHTS, PRIOR, START
from arcseq.operators.params import Params
from arcseq.session import release, stage

TRAIN, LABELS = [[1], [0]], [0, 1]


@pytest.fixture(scope="module")
def folded(trials):
    return stage(tt.features(trials).withColumn("fold", (F.col("run_id") % 2).cast("int")), "folded")


def listed(folded, name, keys, stop, exact, smoothing):
    parts = keyed.PARTS[name]
    model = em.model_from([START] * len(keys), keys, COH, PRIOR, parts)
    packed = rec.pack(folded, COH, PRIOR, carry=("fold",))
    rows = em.level_rows(folded, COH, PRIOR, "fold")
    if name in ("subject_iid", "prior_conditioned_iid"):
        return em.fit_mixture(rows, model, stop, "fold", exact, smoothing)
    if name == "exchangeable_block_mixture":
        return em.fit_block(rows, model, stop, "fold", exact=exact)
    if name == "hmm":
        return em.fit_hmm(packed, model, stop, "fold", exact, smoothing)
    return em.fit_hybrid(packed, model, stop, "fold", exact)


def run(folded, name, stop, exact=True, smoothing=1e-6, by=("subject_id",)):
    model = keyed.Model(name, COH, PRIOR)
    subjects = folded.select(*by).distinct() if by else folded.sparkSession.range(1).select()
    fits = keyed.starts(keyed.fold_fits(subjects, TRAIN, LABELS), model, [START])
    packed = rec.pack(folded, COH, PRIOR, carry=("fold",))
    return model, packed, keyed.fit(packed, fits, list(by), model, stop, "fold", exact, smoothing)


@pytest.mark.parametrize("name", list(keyed.PARTS))
def test_equals_the_list_keyed_fit(folded, name):
    stop = em.Stop(3, 1e-9, rule="absolute")
    model, _, got = run(folded, name, stop)
    got = {(r["subject_id"], r["fold"]): r for r in got.collect()}
    some = sorted({k for k, _ in got})[:3]
    keys = [{"subject_id": s, "folds": train, "fold": k} for s in some for train, k in zip(TRAIN, LABELS)]
    for want in listed(folded, name, keys, stop, True, 1e-6):
        r = got[want.key["subject_id"], want.key["fold"]]
        assert r["history"] == pytest.approx(want.history, rel=1e-10) and r["n_trials"] == want.n_rows and r["converged"] == want.converged
        for n, v in model.values(want.params).items():
            np.testing.assert_allclose(r[n], v.ravel(), rtol=1e-8, atol=1e-12)
    release()


@pytest.mark.parametrize("name", ["hmm", "exchangeable_block_mixture", "block_plus_markov"])
def test_cut_sequences_give_the_same_fits(folded, small_chunks, name):
    stop = em.Stop(2, None)
    _, packed, got = run(folded, name, stop)
    assert not packed.long
    from arcseq.operators.trial_table import chunked

    model = keyed.Model(name, COH, PRIOR)
    chunks = rec.pack(chunked(folded, "pos"), COH, PRIOR, carry=("fold",))
    assert chunks.long
    fits = keyed.starts(keyed.fold_fits(folded.select("subject_id").distinct(), TRAIN, LABELS), model, [START])
    again = keyed.fit(chunks, fits, ["subject_id"], model, stop, "fold")
    a, b = ({(r["subject_id"], r["fold"]): r for r in x.collect()} for x in (got, again))
    assert a.keys() == b.keys()
    for k in a:
        for n in [*model.shapes, "history"]:
            np.testing.assert_allclose(a[k][n], b[k][n], rtol=1e-7, atol=1e-10)
    release()


def test_each_fit_stops_by_itself_and_restarts_compete(folded):
    model = keyed.Model("hmm", COH, PRIOR)
    inits = [Params(START.kappa_s, START.kappa_p, weights=INIT_WEIGHTS[i], pi=INIT_PI[i], A=INIT_A[i]) for i in range(3)]
    fits = keyed.starts(folded.select("subject_id").distinct(), model, inits)
    packed = rec.pack(folded, COH, PRIOR)
    got = keyed.fit(packed, fits, ["subject_id"], model, em.Stop(60, 0.05, rule="absolute"))
    rows = got.collect()
    assert all(r["converged"] for r in rows) and len({len(r["history"]) for r in rows}) > 1
    assert all(abs(r["history"][-1] - r["history"][-2]) < 0.05 for r in rows)
    best = {r["subject_id"]: r for r in keyed.best_of(got, ["subject_id"]).collect()}
    for s in best:
        assert best[s]["history"][-1] == max(r["history"][-1] for r in rows if r["subject_id"] == s)
    release()


def test_held_out_scores(folded):
    model, packed, got = run(folded, "hmm", em.Stop(2, None))
    test = got.withColumn("folds", F.array(F.col("fold").cast("int")))
    scored = keyed.score(packed, test, ["subject_id"], model, "fold").collect()
    lengths = {tuple(r[k] for k in SEQ): r["count"] for r in folded.groupBy(*SEQ).count().collect()}
    assert {tuple(r[k] for k in SEQ): r["n"] for r in scored} == lengths
    fits = {(r["subject_id"], r["fold"]): r for r in got.collect()}
    r = scored[0]
    f = fits[r["subject_id"], r["fold"]]
    p = Params(dict(zip(COH, f["kappa_s"])), dict(zip(PRIOR, f["kappa_p"])), pi=f["pi"], A=np.reshape(f["A"], (3, 3)).tolist())
    own = folded.filter(" AND ".join(f"{k} = {r[k]}" for k in SEQ))
    assert rec.sequence_ll(rec.pack(own, COH, PRIOR), rec.one_key(p, COH, PRIOR)).first()["ll"] == pytest.approx(r["ll"], rel=1e-10)
    release()


def test_all_subjects_together_and_fits_without_rows(folded):
    model, packed, got = run(folded, "subject_iid", em.Stop(2, None), by=())
    assert {r["fold"]: r["n_trials"] for r in got.collect()} == {k: folded.filter(F.col("fold") != k).count() for k in LABELS}
    lone = folded.sparkSession.createDataFrame([(10_000,), (None,)], "subject_id long")
    fits = keyed.starts(lone, model, [START])
    out = keyed.fit(packed, fits, ["subject_id"], model, em.Stop(2, None)).collect()
    assert len(out) == 2 and all(r["history"] == [] and r["n_trials"] == 0 and r["converged"] for r in out)
    assert all(r["kappa_s"] == [START.kappa_s[c] for c in COH] for r in out)
    release()


def test_twenty_thousand_subjects_in_one_pass(spark, monkeypatch):
    """No key reaches the driver: rows collected stay a handful whatever the number of subjects."""
    k = F.col("id")
    rows = spark.range(100_000).select(
        (k % 20_000).alias("subject_id"), F.lit(1).cast("long").alias("session_id"), F.lit(1).cast("long").alias("run_id"), (F.floor(k / 20_000) + 1).alias("pos"),
        k.alias("row_id"), F.lit(0).cast("long").alias("chunk"), F.cos(k * 0.7).alias("cos_s"), F.cos(k * 1.3).alias("cos_p"),
        F.element_at(F.array(*map(F.lit, COH)), (k % 3 + 1).cast("int")).alias("motion_coherence"), F.element_at(F.array(*map(F.lit, PRIOR)), (k % 4 + 1).cast("int")).alias("prior_std"),
    )
    rows = rows.withColumnRenamed("chunk", rec.CHUNK)
    seen, whole = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: seen.append(len(out := whole(self))) or out)
    model = keyed.Model("hmm", COH, PRIOR)
    packed = rec.pack(rows, COH, PRIOR)
    got = keyed.fit(packed, keyed.starts(rows.select("subject_id").distinct(), model, [START]), ["subject_id"], model, em.Stop(2, None))
    assert max(seen, default=0) <= 1
    told = got.agg(F.count("*"), F.sum("n_trials"), F.min(F.size("history")), F.sum((F.element_at("history", 2) >= F.element_at("history", 1)).cast("long"))).first()
    assert tuple(told)[:3] == (20_000, 100_000, 2) and told[3] > 19_000
    release()


@pytest.mark.parametrize("name", ["hmm", "block_plus_markov"])
def test_tasks_add_their_pieces_by_fit(folded, name):
    """A task hands on one row for each fit, not one for each piece and fit."""
    model = keyed.Model(name, COH, PRIOR)
    fits = keyed.starts(keyed.fold_fits(folded.select("subject_id").distinct(), TRAIN, LABELS), model, [START])
    packed = rec.pack(folded, COH, PRIOR, carry=("fold",))
    one = rec.Packed(packed.df.coalesce(1), COH, PRIOR, False, packed.keys)
    got = keyed.e_step(one, fits, ["subject_id"], model, "fold", 2, small=True).collect()
    keys = [(r["subject_id"], r["fold"]) for r in got]
    assert len(keys) == len(set(keys)) < packed.df.count()
    release()
