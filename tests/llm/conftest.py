import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from arcseq.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "llm-tests")
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    yield session


DOCS = "doc_id long, text string, lang string, source string, n_chars long"

PROSE = (
    "the quick brown fox jumps over a lazy dog while seven other animals look on from behind the old stone wall\n"
    "nobody in the village could say where they had come from or why they stayed so long that year\n"
    "in the evening the farmer counted them again and found that one of the hens was missing after all\n"
)


def prose(k: int) -> str:
    """Some lines that differ from document to document."""
    return "\n".join(" ".join(f"{w}{k}" if i % 3 == k % 3 else w for i, w in enumerate(line.split())) for line in PROSE.strip().split("\n"))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, copies, and columns with names that operators use."""
    rows = [(i, prose(i), "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(100, None, None, None, None), (None, prose(3), "en", "s0", 1), (None, None, None, None, None), (101, "", "en", "s1", 0)]
    rows += [(102, " \t\n\x0b \r\n", "en", "s1", 0), (103, "w " * 40_000, "en", "s2", 1), (104, "x" * 100_000, "en", "s2", 1)]
    rows += [(5, prose(5), "en", "s2", 1)] * 2 + [(200 + i, prose(7), "en", "s1", 1) for i in range(5)]
    rows += [(300, "straße ÉCOLE naïve\n日本語 テスト\n😀 <|endoftext|> it's", "xx", "sé", 1)]
    df = spark.createDataFrame(rows, DOCS)
    clash = ["row", "x", "n", "h", "fp", "host", "size", "skey", "score", "kept", "lines", "rank", "piece", "root", "label", "source_size", "tree", "k"]
    for c in clash:
        from pyspark.sql import functions as F

        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, int(i % 4 > 0), int(i % 5 == 0)) for i in range(40)] + [(1, 1, 1), (None, 1, 0), (7, None, None), (999, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
