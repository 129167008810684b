"""Labelled rows that a model may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcseq.llm.common import sampled, share_of

FOLDS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels no model may see; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS == 0


def thinned(rows: DataFrame, n: int, most: int, seed: int = 42) -> DataFrame:
    """About `most` of `n` rows (all, where there are no more), chosen by a hash of the doc_id: each with the same chance."""
    return rows.where(sampled(F.xxhash64(F.lit(seed), "doc_id"), share_of(n, most)))


def learnable(docs: DataFrame, max_chars: int) -> DataFrame:
    """doc_id and text of rows that are not held out and no longer than `max_chars`."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.where(F.col("doc_id").isNotNull() & ~held_out() & (F.length("text") <= max_chars))


def sample_of(docs: DataFrame, labels: DataFrame, label: str, value: int, most: int, max_chars: int) -> DataFrame:
    """About `most` rows (doc_id, text) labelled `value`, from rows that are not held out."""
    ids = labels.where((F.col(label) == value) & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long")).distinct()
    return learnable(docs, max_chars).join(thinned(ids, ids.count(), most), "doc_id", "left_semi")
