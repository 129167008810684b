"""Results must not depend on where sequences are cut: small chunks, hot groups and several scan levels
against the uncut computation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arcseq import columns
from arcseq.columns import CHUNK, SEQ
from arcseq.operators import checks as ck
from arcseq.operators import conditions as cond
from arcseq.operators import em
from arcseq.operators import recursions as rec
from arcseq.operators import scoring as sc
from arcseq.operators import splits as sp
from arcseq.operators import trial_table as tt
from arcseq.operators.quantiles import exact_quantiles
from arcseq.plans.fixed import COH, MAIN, PRIOR, START
from arcseq.session import release, stage
from arcseq.sources import trials as src

X = tuple(tt.X_COLS)


@pytest.fixture(scope="module")
def feat(trials):
    return stage(tt.features(trials), "feat")


@pytest.fixture(scope="module")
def scaler(feat):
    row = sc.fit_scaler(tt.transition_covariates(feat)).first()
    return [(row[f"mean_{c}"], row[f"sd_{c}"]) for c in X]


def model(parts, params=START):
    return em.model_from([params], [{"subject_id": None}], COH, PRIOR, parts)


def frame(df, keys, values):
    pdf = df.select(*keys, *values).toPandas().sort_values(keys).reset_index(drop=True)
    return pdf


def same(a, b, keys):
    assert len(a) == len(b) and len(a) > 0
    for c in a.columns:
        if c in keys or a[c].dtype == object or a[c].dtype == bool:
            assert (a[c].fillna("-") == b[c].fillna("-")).all(), c
        else:
            np.testing.assert_allclose(b[c].to_numpy(float), a[c].to_numpy(float), rtol=1e-9, atol=1e-9, equal_nan=True)


def queries(trials, feat, scaler):
    """name -> (frame builder, key columns, value columns)"""
    f = lambda: tt.features(trials)
    seg = lambda: sp.segment_position(tt.angles(tt.split_segments(trials)))
    row = ["row_id"]
    out = {
        "features": (f, row, ["pos", "seq_len", "is_start", "prev_error", "prev_theta", "prev_motion_coherence"]),
        "missing": (lambda: tt.missing_report(trials), row, ["preceding_valid_trial_index", "following_valid_trial_index"]),
        "segments": (seg, row, ["segment_number", "seg_pos", "seg_len"]),
        "base": (lambda: tt.trial_base(f()), ["raw_row_index"], ["analysis_row_index", "seq_id", "sequence_trial_index"]),
        "contiguity": (lambda: tt.contiguity(f()), row, ["global_trial", "is_block_start"]),
        "folds": (lambda: sp.stratified_folds(tt.sequences(f())), SEQ, ["fold"]),
        "group_folds": (lambda: sp.group_folds(tt.sequences(f()), "session_id"), SEQ, ["fold"]),
        "attach": (lambda: sp.attach_folds(f(), sp.stratified_folds(tt.sequences(f()))), row, ["fold"]),
        "within": (lambda: sp.permute_within(seg(), [*SEQ, "segment_number"]), row, ["shuffle_order"]),
        "matched": (
            lambda: sp.permute_matched(seg(), ["subject_id", "prior_std"], ["segment_id", "trial_index", "block_id"], ["row_id"]),
            ["segment_id", "trial_index"],
            ["row_id"],
        ),
        "cross": (
            lambda: sp.permute_cross_subject(seg(), ["prior_std", "motion_coherence"], ["y"]), row, ["donor_subject_id", "y"]
        ),
        "runs": (
            lambda: tt.run_lengths(f().withColumn("s", F.col("error") > 0), "s", SEQ), [*SEQ, "run_no"], ["run_length"]
        ),
        "cumulative": (lambda: sc.cumulative_ll(sc.score_mixture(f(), MAIN)), row, ["sequence_cumulative_ll", "sequence_ll"]),
        "replicates": (lambda: ck.permuted_replicates(f(), 2), ["simulation", "row_id"], ["estimate_deg", "error"]),
        "response": (
            lambda: ck.with_response(f().withColumn("x", (F.col("estimate_deg") * 3) % 360), "x"), row, ["prev_error", "cos_s"]
        ),
        "metrics": (lambda: cond.condition_metrics(f(), cond.CONDITION), cond.CONDITION, cond.METRICS),
        "block_table": (lambda: cond.block_table(trials), SEQ, ["n_trials", "prior_std_unique_count", "trial_index_max"]),
        "block_score": (lambda: sc.score_block(f(), START, SEQ), row, ["tau_0", "tau_1", "trial_ll"]),
        "block_resp": (lambda: sc.block_responsibilities(f(), START, SEQ), row, ["p_sensory", "p_prior", "p_lapse"]),
    }
    packed = lambda **k: rec.pack(tt.transition_covariates(f()), COH, PRIOR, **k)
    out |= {
        "chain": (
            lambda: rec.chain_scores(packed(), rec.one_key(MAIN, COH, PRIOR), smooth=True, pairs=True),
            row,
            [*rec.PRED, *rec.FILT, "trial_ll", *rec.SMOOTH, *rec.XI],
        ),
        "covariate_chain": (
            lambda: rec.chain_scores(packed(arrays=X), rec.one_key(MAIN, COH, PRIOR, scaler), smooth=True, pairs=True, x_cols=X),
            row,
            [*rec.PRED, *rec.FILT, "trial_ll", *rec.SMOOTH, *rec.XI],
        ),
        "sequence_ll": (lambda: rec.sequence_ll(packed(), rec.one_key(MAIN, COH, PRIOR)), SEQ, ["ll", "n"]),
        "viterbi": (lambda: rec.viterbi(packed(), rec.one_key(MAIN, COH, PRIOR)), row, ["viterbi_state"]),
        "viterbi_covariate": (
            lambda: rec.viterbi(packed(arrays=X), rec.one_key(MAIN, COH, PRIOR, scaler), x_cols=X), row, ["viterbi_state"]
        ),
        "hybrid": (
            lambda: rec.score_hybrid(packed(), rec.one_key(START, COH, PRIOR)), row, ["tau_0", "tau_1", "tau_2", *rec.PRED, "trial_ll"]
        ),
    }
    return out


NAMES = list(queries(None, None, None))


@pytest.mark.parametrize("name", NAMES)
def test_cut_equals_whole(name, trials, feat, scaler, monkeypatch):
    build, keys, values = queries(trials, feat, scaler)[name]
    whole = frame(build(), keys, values)
    release()
    monkeypatch.setattr(columns, "CHUNK_ROWS", 8)
    monkeypatch.setattr(columns, "HOT_GROUP_ROWS", 5)
    monkeypatch.setattr(rec, "FAN", 2)
    cut = frame(build(), keys, values)
    release()
    same(whole, cut, keys)


def fold_rows(trials):
    f = tt.transition_covariates(tt.features(trials))
    return f.withColumn("fold", (F.col("session_id") % 3).cast("int"))


def em_sums(trials, scaler, kind):
    df = fold_rows(trials)
    keys = [{"subject_id": s, "folds": [0, 2]} for s in (1, 2, 3)] + [{"subject_id": s, "folds": [1]} for s in (1, 4)]
    if kind == "chain":
        m = em.model_from([START] * len(keys), keys, COH, PRIOR, ["pi", "A"])
        return em.chain_step(rec.pack(df, COH, PRIOR, carry=("fold",)), m, "fold")
    if kind == "covariate":
        m = em.model_from([MAIN] * 2, [{"subject_id": None, "folds": [0]}, {"subject_id": None, "folds": [0, 1]}], COH, PRIOR, ["pi", "B"])
        m.extra["mean"] = np.array([[a for a, _ in scaler]] * 2)
        m.extra["sd"] = np.array([[b for _, b in scaler]] * 2)
        posteriors = em.chain_posteriors(rec.pack(df, COH, PRIOR, carry=("fold",), arrays=X), m, X, "fold")
        found = em.logit_pass(posteriors, em.free_rows(m.extra["B"]), [0, 1])
        return em.summed_posteriors(posteriors, m) | dict(zip(("q", "grad", "hess"), found, strict=True))
    if kind == "hybrid":
        m = em.model_from([START] * len(keys), keys, COH, PRIOR, ["rho", "class_pi", "class_A"])
        return em.hybrid_step(rec.pack(df, COH, PRIOR, carry=("fold",)), m, "fold")
    m = em.model_from([START] * len(keys), keys, COH, PRIOR, ["rho", "class_weights"])
    return em.block_step(em.level_rows(df, COH, PRIOR, "fold"), m, "fold", SEQ)


@pytest.mark.parametrize("kind", ["chain", "covariate", "hybrid", "block"])
def test_em_sums_do_not_depend_on_cuts(kind, trials, scaler, small_chunks, monkeypatch):
    cut = em_sums(trials, scaler, kind)
    release()
    monkeypatch.setattr(columns, "CHUNK_ROWS", 2048)
    whole = em_sums(trials, scaler, kind)
    release()
    for name, values in whole.items():
        np.testing.assert_allclose(cut[name], values, rtol=1e-8, atol=1e-8, err_msg=name)


def test_quantiles_match_numpy(feat):
    got = {
        r["subject_id"]: (r["a"], r["b"], r["c"])
        for r in exact_quantiles(feat, ["subject_id"], F.abs("error"), {"a": 0.025, "b": 0.5, "c": 0.9}, 0.01).collect()
    }
    pdf = feat.select("subject_id", F.abs("error").alias("v")).toPandas()
    for s, g in pdf.groupby("subject_id"):
        np.testing.assert_allclose(got[s], np.quantile(g["v"], [0.025, 0.5, 0.9]), rtol=1e-12)


def test_one_long_sequence_spreads_over_chunks(trials, small_chunks):
    """All trials as a single sequence: every window piece stays small."""
    one = trials.withColumns({k: F.lit(1).cast("long") for k in SEQ}).drop("trial_index")
    one = one.withColumn("trial_index", F.col("row_id") + 1)
    feat = tt.features(one)
    sizes = feat.groupBy(*SEQ, CHUNK).count().agg(F.max("count")).first()[0]
    assert sizes <= 8
    pdf = feat.select("pos", "seq_len", "trial_index").orderBy("trial_index").toPandas()
    assert pdf["pos"].tolist() == list(range(1, len(pdf) + 1)) and set(pdf["seq_len"]) == {len(pdf)}


# ---- rows that are easily lost: negative positions, null keys, ties, levels that nobody has seen


def shaken(trials):
    """Trials with negative positions and subjects, and a fifth of the subjects unknown."""
    subject = F.when(F.col("subject_id") % 5 == 0, F.lit(None)).otherwise(F.col("subject_id") - 6)
    return trials.withColumns({"trial_index": F.col("trial_index") - 10, "subject_id": subject.cast("long")})


def lossless(trials):
    """name -> rows that must neither be lost nor change with the cuts."""
    feat = tt.features(shaken(trials))
    seqs = tt.sequences(feat)
    folds = sp.stratified_folds(seqs)
    splits = sp.chronological_splits(seqs)
    by_subject = sp.group_folds(seqs, "subject_id")
    return {
        "features": feat.select("row_id", "pos", "seq_len", "prev_theta"),
        "levels": tt.level_table(feat, "subject_id").selectExpr("coalesce(subject_id, -999) AS row_id", "subject_id_idx"),
        "folds": sp.attach_folds(feat, folds).select("row_id", "fold"),
        "subject_folds": sp.attach_folds(feat, by_subject).select("row_id", "fold"),
        "split": sp.rows_in_split(feat, splits, 1, "test").select("row_id", "pos"),
        "base": tt.trial_base(feat).select(F.col("raw_row_index").alias("row_id"), "analysis_row_index", "seq_id"),
        "running": sc.cumulative_ll(feat.withColumn("trial_ll", F.col("error"))).select("row_id", "sequence_cumulative_ll", "sequence_ll"),
        "within": sp.permute_within(feat, ["subject_id"]).select("row_id", "shuffle_order"),
        "across": sp.permute_cross_subject(feat.drop("chunk"), ["prior_std"], ["y"]).select("row_id", "donor_subject_id", "y"),
        "numbered": src.number_rows(
            feat.select(F.when(F.col("row_id") % 10 > 0, F.col("theta")).alias("t"), F.col("row_id").alias("id")), ["t", "id"], F.col("t"), "n"
        ).select(F.col("id").alias("row_id"), "n"),
    }


def test_no_rows_are_lost_or_change_with_the_cuts(trials, monkeypatch):
    def read():
        out = {k: d.toPandas().sort_values("row_id").reset_index(drop=True) for k, d in lossless(trials).items()}
        release()
        return out

    whole = read()
    usable = tt.usable_trials(trials).count()
    assert all(len(d) == usable for k, d in whole.items() if k not in ("levels", "split")) and len(whole["split"])
    assert whole["levels"]["subject_id_idx"].tolist() == list(range(len(whole["levels"])))
    monkeypatch.setattr(columns, "CHUNK_ROWS", 8)
    monkeypatch.setattr(columns, "HOT_GROUP_ROWS", 5)
    cut = read()
    for k, d in whole.items():
        pd.testing.assert_frame_equal(d, cut[k], check_dtype=False, rtol=1e-9, obj=k)


def test_quantiles_with_nan_do_not_depend_on_the_limit(feat, monkeypatch):
    v = F.when(F.col("row_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("error"))

    def read():
        return sorted(tuple(str(x) for x in r) for r in exact_quantiles(feat, ["prior_std"], v, {"a": 0.1, "b": 0.5, "c": 0.99}, 0.01).collect())

    whole = read()
    monkeypatch.setattr(columns, "HOT_GROUP_ROWS", 5)
    assert read() == whole


def test_levels_without_parameters_are_an_error(feat):
    odd = feat.withColumn("motion_coherence", F.when(F.col("row_id") % 50 == 0, 0.5).otherwise(F.col("motion_coherence")))
    with pytest.raises(Exception, match="no parameters for motion_coherence 0.5"):
        sc.score_mixture(odd, MAIN).count()
        sc.score_mixture(odd, MAIN).agg(F.sum("trial_ll")).collect()
    with pytest.raises(Exception, match="no parameters for motion_coherence 0.5"):
        rec.pack(odd, COH, PRIOR).df.collect()
    release()


def test_quantiles_rank_only_what_holds_a_wanted_rank(spark):
    """Of 60,000 values in 1,000 intervals, those of at most six intervals a group are ranked; results equal NumPy's."""
    from arcseq.operators.quantiles import wanted_values

    df = spark.range(60_000).selectExpr("id % 2 AS k", "(xxhash64(id) % 1000003) / 1000.0 AS x").withColumn("x", F.col("x").cast("double"))
    df = stage(df, "quantile-test")
    probs, width = {"a": 0.025, "b": 0.5, "c": 0.9}, 2.0
    wanted = wanted_values(df, ["k"], F.col("x"), probs, width)
    assert wanted.agg(F.sum("__c")).first()[0] <= 2 * 6 * 90
    rows = df.toPandas()
    for r in exact_quantiles(df, ["k"], F.col("x"), probs, width).collect():
        want = np.quantile(rows[rows.k == r["k"]].x, list(probs.values()))
        np.testing.assert_allclose([r["a"], r["b"], r["c"]], want, rtol=1e-12)


def rows_by_digest(feat, n, seed=17):
    """The rule of the replicates by sorting: slot k takes the response of the trial ranked k by digest."""
    import hashlib

    out = {}
    for _, own in feat.select(*SEQ, "pos", "row_id", "estimate_deg").toPandas().groupby(SEQ):
        slots = own.sort_values("pos")["row_id"].tolist()
        for s in range(n):
            h = [hashlib.md5(f"{seed}|{s}|{i}".encode()).hexdigest() for i in own["row_id"]]
            for slot, (_, deg) in zip(slots, sorted(zip(h, own["estimate_deg"])), strict=True):
                out[s, slot] = deg
    return out


@pytest.mark.parametrize("most", [0, 20, 10**6])
def test_replicates_of_whole_and_of_cut_sequences_follow_one_rule(feat, most, monkeypatch):
    monkeypatch.setattr(ck, "ARRAY_ROWS", most)
    got = ck.permuted_replicates(feat, 3).select("simulation", "row_id", "estimate_deg").collect()
    assert {(r[0], r[1]): r[2] for r in got} == rows_by_digest(feat, 3) and len(got) == 3 * feat.count()


def test_rows_ranked_by_piece_are_shuffled_once_to_meet_their_borders(trials, spark):
    """The table of pieces is summed, carried on and joined (at most four shuffles of it); the rows are shuffled once."""
    from arcseq.operators.ordered import in_sequence

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = tt.chunked(tt.usable_trials(trials))
        plan = in_sequence(rows, SEQ, CHUNK, "trial_index", {"p": F.col("prior_mean")})._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    keyed = [x for x in plan.splitlines() if "Exchange hashpartitioning(__key" in x]
    assert len(keyed) == 1 and "isnull(" not in "".join(x for x in plan.splitlines() if "Exchange" in x)


@pytest.mark.parametrize("simulations", [None, 2])
def test_permuted_in_place(trials, monkeypatch, simulations):
    """Sequences sorted where they lie hold the same rows at the same places as sequences ranked row by row."""
    keys = [*SEQ, "segment_number"]
    segs = stage(sp.segment_position(tt.angles(tt.split_segments(trials))), "seg").withColumn("pos", F.col("seg_pos"))
    for rows in (2048, 7):
        monkeypatch.setattr(columns, "CHUNK_ROWS", rows)
        cut = tt.chunked(segs)
        packed = rec.pack(cut, COH, PRIOR, keys=keys)
        got = rec.permuted(packed, 7, simulations)
        copies, sims = cut, []
        if simulations:
            sims = ["simulation"]
            copies = cut.withColumn("simulation", F.explode(F.sequence(F.lit(0), F.lit(simulations - 1))))
        want = sp.permute_within(copies, [*sims, *keys], 7).withColumn("pos", F.col("shuffle_order").cast("long"))
        want = tt.chunked(want, "pos").select(*sims, *keys, CHUNK, "pos", "row_id", "motion_coherence", "prior_std", "cos_s", "cos_p")
        by = [*sims, "row_id"]
        mine = rec.packed_rows(got).select(*want.columns)
        same(frame(want, by, [c for c in want.columns if c not in by]), frame(mine, by, [c for c in want.columns if c not in by]), by)
        assert got.long == (rows == 7) and got.df.where("size(pos) <> size(row_id) OR first_pos <> pos[0]").count() == 0


def test_placed_segments_shuffle_rows_once(trials, monkeypatch):
    """Position, length and fold of segments over chunk borders, as computed step by step; one shuffle of whole rows."""
    for rows in (2048, 5):
        monkeypatch.setattr(columns, "CHUNK_ROWS", rows)
        folds = stage(sp.stratified_folds(tt.sequences(tt.usable_trials(trials))), "folds")
        got = sp.placed_segments(trials, folds)
        want = sp.attach_folds(sp.segment_position(tt.split_segments(trials)), folds)
        cols = ["segment_id", "segment_number", "seg_pos", "seg_len", "fold", CHUNK, "trial_index"]
        same(frame(want, ["row_id"], cols), frame(got, ["row_id"], cols), ["row_id"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    wide = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "raw_response_time" in x]
    assert "raw_response_time" in plan and len(wide) <= 1


def test_mixture_sums_of_blocks(feat):
    """LLs of blocks in one aggregate against sums of the causal trial LLs."""
    got = frame(sc.mixture_sums(feat, START, SEQ), SEQ, ["n_test", "subject_iid", "prior_conditioned_iid", "exchangeable_block_mixture"])
    for name, scored in {"subject_iid": sc.score_mixture(feat, START), "prior_conditioned_iid": sc.score_conditioned(feat, START), "exchangeable_block_mixture": sc.score_block(feat, START, SEQ)}.items():
        want = frame(scored.groupBy(*SEQ).agg(F.sum("trial_ll").alias(name)), SEQ, [name])
        same(want, got[[*SEQ, name]], SEQ)


@pytest.mark.parametrize("simulations", [None, 2])
def test_exchanged_without_shuffling_slots(trials, monkeypatch, simulations):
    """Packed exchange against the row-wise one, with strata of one piece and of many."""
    folds = sp.stratified_folds(tt.sequences(tt.usable_trials(trials)))
    segments = stage(tt.angles(sp.placed_segments(trials, folds)), "exchanged-segments")
    strata, seg = ["subject_id", "fold", "prior_std"], [*SEQ, "segment_number"]
    sims = [] if simulations is None else ["simulation"]
    rows, seed = segments, 11
    if sims:
        rows = segments.withColumn("simulation", F.explode(F.sequence(F.lit(0), F.lit(1))))
        seed = F.lit(11) + F.col("simulation")
    want = sp.permute_matched(rows, [*sims, *strata], [*seg[1:], "segment_id", "trial_index", "block_id", "seg_pos"], ["row_id", "cos_s"], seed)
    want = sorted(map(tuple, want.select(*sims, *seg, "seg_pos", "row_id", "cos_s").collect()))
    for piece in (5, 16_384):
        monkeypatch.setattr(rec, "PIECE", piece)
        got = rec.exchanged(segments, COH, PRIOR, strata, seg, 11, simulations)
        assert got.long == (piece == 5)
        flat = got.df.select(*sims, *seg, F.inline(F.arrays_zip("pos", "row_id", "cos_s")))
        assert sorted(map(tuple, flat.collect())) == want
        ll = [rec.sequence_ll(p, rec.one_key(START, COH, PRIOR)) for p in rec.in_parts(got)]
        total = sum(r["ll"] for p in ll for r in p.collect())
        if piece == 5:
            first = total
    assert total == pytest.approx(first, rel=1e-10)
