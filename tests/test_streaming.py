import pytest
from pyspark.sql import functions as F

from arcseq.columns import SEQ
from arcseq.operators import recursions as rec
from arcseq.operators import scoring as sc
from arcseq.operators import trial_table as tt
from arcseq.plans.fixed import COH, MAIN, PRIOR, START
from arcseq.session import new_path, release
from arcseq.sources.trials import read_events
from arcseq.streaming import online

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def files(spark):
    """The event log as three files in time order, then one file with rows that come too late."""
    path = new_path(spark, "events")
    ev = read_events(spark, SF)
    for lo, hi in ((1, 9), (9, 20), (20, 32)):
        part = ev.filter((F.dayofmonth("ts") >= lo) & (F.dayofmonth("ts") < hi))
        part.coalesce(1).write.mode("append").parquet(path)
    late = ev.filter("event_id % 50 = 7").withColumn("event_id", F.col("event_id") + 100_000_000)
    late = late.withColumn("ts", F.col("ts") - F.expr("INTERVAL 1 SECOND"))
    late.coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path):
    return online.event_trials(
        spark.readStream.schema(read_events(spark, SF).schema).option("maxFilesPerTrigger", 1).parquet(path)
    )


def batch(spark):
    rows = online.event_trials(read_events(spark, SF)).withColumn("trial_index", F.col("position"))
    from arcseq.operators.ordered import in_sequence

    rows = rows.withColumn("chunk", F.lit(0).cast("long"))
    return in_sequence(rows, SEQ, "chunk", "trial_index", {f"prev_{c}": F.col(c) for c in ("error", "conflict", "motion_coherence")})


def compare(got, want, cols):
    got = got.filter("row_id < 100000000")
    assert got.count() == want.count() > 0
    joined = got.join(want.select("row_id", *[F.col(c).alias(f"w_{c}") for c in cols]), "row_id")
    worst = joined.agg(*[F.max(F.abs(F.col(c) - F.col(f"w_{c}"))).alias(c) for c in cols]).first()
    assert joined.count() == want.count() and all(worst[c] < 1e-9 for c in cols), worst


def test_filter_over_micro_batches_equals_batch(spark, files):
    got = online.run_to_table(online.stream_filter(stream(spark, files), MAIN))
    want = rec.chain_scores(rec.pack(batch(spark), COH, PRIOR), rec.one_key(MAIN, COH, PRIOR))
    compare(got, want, online.FILTER_COLUMNS)
    release()


def test_block_over_micro_batches_equals_batch(spark, files):
    got = online.run_to_table(online.stream_block(stream(spark, files), START))
    compare(got, sc.score_block(batch(spark), START, SEQ), ["tau_0", "tau_1", "tau_2", "trial_ll"])


def test_covariates_over_micro_batches_equal_batch(spark, files):
    got = online.run_to_table(online.stream_covariates(stream(spark, files), watermark="10 days", idle_ms=3_600_000))
    compare(got, tt.transition_covariates(batch(spark)), ["x_prev_error", "x_prev_conflict", "x_prev_coherence"])


def test_late_rows_are_dropped(spark, files):
    got = online.run_to_table(online.stream_filter(stream(spark, files), MAIN))
    assert got.groupBy("row_id").count().filter("count > 1").count() == 0
    late = got.filter("row_id >= 100000000")
    # a late copy survives only where its sequence had no later row before it
    assert late.count() < read_events(spark, SF).filter("event_id % 50 = 7").count()
