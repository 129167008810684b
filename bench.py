"""Time the headline queries: BENCH_SF_DIR (default sf0.1) on local[BENCH_CPUS]; prints one JSON line.

Shared tables (trials, features, segments, folds) are staged first and timed as their own entries, as a
cluster would write them once; every query is then run to completion with a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from arcseq.operators import cv, em  # noqa: E402
from arcseq.operators import recursions as rec  # noqa: E402
from arcseq.plans import fits as fit_plans  # noqa: E402
from arcseq.plans import workspace  # noqa: E402
from arcseq.plans.catalog import QUERIES  # noqa: E402
from arcseq.plans.fixed import COH, PRIOR, START  # noqa: E402
from arcseq.session import local_session, release  # noqa: E402

HEADLINE = [
    "slice_ll_by_subject", "a2_dataset_summary", "a5_condition_metrics", "a6_response_histograms", "p3_missing_report",
    "p4_trial_base", "w5_split_segments", "w7_run_lengths", "w10_stratified_folds", "w13_permute_within", "w14_permute_matched",
    "m2_score_mixture", "m3_score_serial_both", "m8_grid_loglik", "m13_fold_scaler", "h1_forward_filter", "h3_smooth", "h4_pairwise",
    "h5_covariate_smooth", "h6_viterbi", "h8_score_block", "h10_score_hybrid", "e1_fit_mixture", "e3_fit_hmm", "e5_fit_block",
    "e6_fit_hybrid", "a12_seq_scores", "a10_summarise_cv", "b1_bootstrap_diff", "b5_permutation_distribution", "b7_metrics",
    "a16_retention", "st1_stream_filter", "e4_fit_covariate_hmm", "e8_run_cv", "e8_serial_cv", "e9_fit_subjects", "e11_em_diagnostics",
    "b4_effect_intervals", "b6_permutation_refit", "b9_chronological_eval", "m6_bayes_grid_map",
]


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def fit_48(spark, sf, iterations: int) -> dict:
    """Chain fits per subject x fold with exact concentrations, a fixed number of iterations."""
    df = fit_plans.segment_rows(spark, sf)
    packed = rec.pack(df, COH, PRIOR, keys=fit_plans.SEG, carry=("fold",))
    keys = cv.fold_keys(fit_plans.subjects(df), fit_plans.OTHERS, fit_plans.LABELS)
    model = em.model_from([START] * len(keys), keys, COH, PRIOR, ["pi", "A"])
    started = time.perf_counter()
    em.fit_hmm(packed, model, em.Stop(iterations, 1e-6, rule="absolute"), "fold", exact=True, smoothing=1e-6)
    seconds = time.perf_counter() - started
    return {"fits": len(keys), "iterations": iterations, "seconds": round(seconds, 3), "seconds_per_iteration": round(seconds / iterations, 4)}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    drain(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count())  # start the executor threads
    times: dict[str, float] = {}

    def timed(name, fn):
        started = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - started, 3)

    for name in ("trials", "features", "folds", "segments"):
        timed(f"stage_{name}", lambda name=name: drain(getattr(workspace, name)(spark, sf)))
    only = sys.argv[1:]
    for name in HEADLINE:
        if not only or name in only:
            timed(name, lambda name=name: drain(QUERIES[name](spark, sf)))
    release()
    detail = {}
    if not only:
        timed("fit_48_chains_20_iterations", lambda: detail.update(fit_48(spark, sf, 20)))
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")),
                "cpus": cpus,
                "fit": detail,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
