import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from arcseq.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def trials(spark):
    from arcseq.session import stage
    from arcseq.sources.trials import read_events, trials_from_events

    return stage(trials_from_events(read_events(spark, SF)), "test-trials")


@pytest.fixture
def small_chunks(monkeypatch):
    """Cut sequences every 8 trials, treat groups above 5 rows as hot, combine 2 chunks per task."""
    from arcseq import columns
    from arcseq.operators import recursions

    monkeypatch.setattr(columns, "CHUNK_ROWS", 8)
    monkeypatch.setattr(columns, "HOT_GROUP_ROWS", 5)
    monkeypatch.setattr(recursions, "FAN", 2)
