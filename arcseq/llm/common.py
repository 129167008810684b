"""Column helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
#: What separates words: ASCII white space.
WORD_BREAK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def hex_number(digest: Column, start: int, digits: int) -> Column:
    """`digits` hexadecimal digits of a digest from `start` (1-based) as a long."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def marked(docs: DataFrame) -> DataFrame:
    """Every row whole (`row`), beside doc_id, source, text and a key of these three (equal for repeated rows, never null):
    whatever other columns the table has, and however they are called, they travel in `row`."""
    t = text_of()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    own = [F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64(t), F.length(t)]
    source = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    return docs.select(row.alias("row"), "doc_id", "source", "text", F.concat_ws("|", *own, source).alias("key"))


def share_of(n: int, most: int) -> float:
    """The share of `n` rows that leaves about `most` of them."""
    return min(1.0, most / max(n, 1))


def sampled(hashed: Column, share: float) -> Column:
    """Rows whose 64-bit hash lies in the lowest `share` of its range, in steps of 2 ** -63: a sample of a large table is as
    large as that of a small one. A share of 1 takes all rows."""
    return F.lit(True) if share >= 1 else F.shiftrightunsigned(hashed, 1) < F.lit(int(share * 2.0**63))
