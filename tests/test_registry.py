import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry
from check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SOME = [
    "slice_ll_by_subject", "s6_trials_from_events", "p3_missing_report", "w5_split_segments", "a5_condition_metrics", "h3_smooth",
    "h5_covariate_smooth", "h6_viterbi", "h10_score_hybrid", "e1_fit_mixture", "e3_fit_hmm", "e5_fit_block", "b1_bootstrap_diff",
    "a16_retention_summary", "a23_run_length_calibration", "st1_stream_filter", "s2_csv_scan", "w9_non_contiguous_blocks", "j5_reconcile",
    "j11_verify_refit", "a32_score_checks", "a14_group_summary", "m8_grid_loglik", "b5_permutation_distribution", "b3_bootstrap_subjects",
    "e8_serial_cv", "a10_serial_cv", "w11_subject_folds", "w15_permute_cross_subject", "p6_level_index", "st2_stream_block",
]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "ll_per_trial" in df.columns


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(name, spark):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(rel.columns, rel.fetchall())
