import math

import pytest
from pyspark.sql import functions as F

from arcseq.columns import SEQ
from arcseq.operators import splits as sp
from arcseq.operators import trial_table as tt
from arcseq.sources import trials as src

NAMES = [f.name for f in src.TRIAL_SCHEMA]


def make(spark, rows):
    """rows of (subject, session, run, trial, direction, response or None, coherence, prior_std)"""
    out = []
    for i, (s, se, r, t, d, resp, c, p) in enumerate(rows):
        x, y = (None, None) if resp is None else (math.cos(math.radians(resp)), math.sin(math.radians(resp)))
        v = dict(row_id=i, subject_id=s, session_id=se, run_id=r, trial_index=t, trial_time=float(i), response_arrow_start_angle=0.0,
                 motion_direction=float(d), motion_coherence=c, estimate_x=x, estimate_y=y, reaction_time=0.5, raw_response_time=0.6,
                 prior_std=float(p), prior_mean=225.0, experiment_name="e", experiment_id=1)
        out.append(tuple(v[n] for n in NAMES))
    return spark.createDataFrame(out, src.TRIAL_SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    """2 subjects x 2 runs x 6 trials, the fourth row without a response."""
    rows = []
    for s in (1, 2):
        for r in (1, 2):
            for t in range(1, 7):
                d = 225 if t % 2 else 235
                missing = s == 1 and r == 1 and t == 4
                rows.append((s, 1, r, t, d, None if missing else (d if t <= 3 else 225), [0.06, 0.12, 0.24][t % 3], 10 if r == 1 else 20))
    return make(spark, rows)


def test_usable_rows_and_sequences(small):
    feat = tt.features(small)
    assert feat.count() == 23 and tt.sequences(feat).count() == 4
    starts = feat.filter("is_start")
    assert starts.count() == 4 and starts.filter("prev_error IS NOT NULL").count() == 0
    assert [c for c in tt.transition_covariates(feat).columns if c.startswith("x_")] == tt.X_COLS


def test_excluded_reason(small):
    rows = tt.excluded_trials(small).collect()
    assert [r["exclusion_reason"] for r in rows] == ["missing_estimate_x;missing_estimate_y"]


def test_start_rules_differ(small):
    x = tt.serial_previous(tt.transition_covariates(tt.features(small))).filter("is_start").collect()
    for r in x:
        assert r["x_prev_error"] == 0 and r["x_prev_conflict"] == 0 and r["x_prev_coherence"] == r["motion_coherence"]
        assert r["serial_theta"] == r["theta"] and r["serial_y"] == r["y"]


def test_lag_jumps_over_a_missing_trial(small):
    r = tt.features(small).filter("subject_id = 1 AND run_id = 1 AND trial_index = 5").first()
    assert r["pos"] == 4 and r["prev_motion_direction"] == 225


@pytest.mark.parametrize(
    "missing, segments",
    [({6}, [1, 1, 1, 1, 1]), ({3}, [1, 1, 2, 2, 2]), ({1}, [1] * 5), ({1, 2, 4}, [1, 2, 2]), (set(range(1, 7)), [])],
)
def test_segments(spark, missing, segments):
    rows = [(1, 1, 1, t, 225, None if t in missing else 230, 0.06, 10) for t in range(1, 7)]
    out = tt.split_segments(make(spark, rows)).orderBy("trial_index")
    assert [r["segment_number"] for r in out.collect()] == segments


def test_aliases(small):
    renamed = small.withColumnsRenamed({"estimate_x": "response_x", "subject_id": "sub"})
    assert src.canonicalise(renamed).columns == small.columns
    with pytest.raises(KeyError):
        src.canonicalise(small.drop("prior_std"))


def test_csv_and_parquet_scans_agree(spark, small, tmp_path):
    small.write.option("header", True).csv(str(tmp_path / "csv"))
    small.write.parquet(str(tmp_path / "pq"))
    a = src.read_trials(spark, str(tmp_path / "csv"), "csv")
    b = src.read_trials(spark, str(tmp_path / "pq"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_folds_are_whole_balanced_and_repeatable(spark, trials):
    seqs = tt.sequences(tt.features(trials))
    folds = sp.stratified_folds(seqs, 4, 42)
    again = sp.stratified_folds(seqs.repartition(5), 4, 42)
    assert folds.select(*SEQ, "fold").exceptAll(again.select(*SEQ, "fold")).count() == 0
    assert sp.leakage(folds).count() == 0
    sizes = folds.groupBy("subject_id", "prior_std", "fold").count().groupBy("subject_id", "prior_std")
    assert sizes.agg(F.max("count") - F.min("count")).agg(F.max("(max(count) - min(count))")).first()[0] <= 1


def test_pruned_scan(spark, trials):
    plan = trials.filter("subject_id = 3").select("row_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(subject_id), EqualTo(subject_id,3)]" in plan
    assert "ReadSchema: struct<row_id:bigint,subject_id:bigint>" in plan


def test_a_rerun_replaces_only_its_own_parts(spark, tmp_path):
    from pathlib import Path

    from arcseq.sources.trials import finished_parts, write_scores

    path = str(tmp_path / "scores")
    kinds = "row_id long, trial_ll double, fit_scope string, model_key string, cv_fold int"
    rows = [(i, -1.0, "cv", m, i % 3) for i in range(30) for m in ("a", "b")] + [(i, -2.0, "final", "a", None) for i in range(5)]
    write_scores(spark.createDataFrame(rows, kinds), path)

    def files():
        return {str(f) for f in Path(path).rglob("*.parquet") if "_finished" not in str(f)}

    def parts():
        return {(r["fit_scope"], r["model_key"], r["cv_fold"]): r["n_rows"] for r in finished_parts(spark, path).collect()}

    before = files()
    assert parts() == {("final", "a", None): 5} | {("cv", m, k): 10 for m in "ab" for k in range(3)}
    again = spark.createDataFrame([(i, -9.0, "cv", "b", 1) for i in range(4)], kinds)
    write_scores(again, path, resume=True)
    assert files() == before
    write_scores(again, path)
    gone, new = before - files(), files() - before
    assert gone and new and all("model_key=b/cv_fold=1" in f for f in gone | new)
    back = spark.read.parquet(path)
    assert back.count() == 59 and back.where("trial_ll = -9.0").count() == 4
    assert parts()[("cv", "b", 1)] == 4 and len(parts()) == 7
    write_scores(again.limit(0), path)
    write_scores(again.drop("cv_fold"), path)
    assert spark.read.parquet(path).count() == 63 and parts()[("cv", "b", None)] == 4
