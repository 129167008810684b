"""Importance resampling towards a target, ranked by a distributed radix sort.

Weights: words and word pairs are hashed into buckets; an array of gains (log ratio of the target's and the corpus' bucket
frequencies) scores every document by the mean gain of its features, in two passes over the texts (counts, weights). A
document's score is its weight plus Gumbel noise from a hash of its doc_id, so the highest scores are a sample without
replacement, with chances in proportion to the exponentials of the weights.

Ranks: rows get dense positions, then are sorted by least significant digits first. The composite key is (score descending,
null doc_ids last, doc_id ascending) in digits of `DIGIT_BITS`. A pass is a stable counting sort: rows of a block of `BLOCK`
consecutive positions count their digits, prefix sums over (digit, block) give each block's first destination of each
digit, and within the block a row's destination is that plus the number of earlier rows of the same digit. Every pass is
written to the shared folder, so a lost executor repeats one pass at most. A task holds one block, whatever the keys.

Nulls: a null text has no words; a null doc_id is hashed as an empty string and comes after all others of its score.
Repeated rows are documents of their own; those with equal scores and doc_ids rank in the order of their positions. An empty
corpus gives an empty result; an empty target has only the counts that smoothing adds. Other columns are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcseq.llm.common import hex_number
from arcseq.session import stage

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
CHUNK_BYTES = 8 << 20
DIGIT_BITS = 9
#: Positions of a block of the sort.
BLOCK = 16_384
#: Bytes of words as they are, capitals as small letters, all others as spaces.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def _zero_byte() -> np.ndarray:
    """What a further zero byte does to the remainder, by byte of the remainder (4 x 256)."""
    own = np.arange(256, dtype=np.uint32)
    low = own.copy()
    for _ in range(8):
        low = np.where(low & 1, np.uint32(0xEDB88320) ^ (low >> np.uint32(1)), low >> np.uint32(1))
    return np.stack([low, own, own << np.uint32(8), own << np.uint32(16)])


def _shifted(v: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = table[0][v & np.uint32(255)]
    for k in (1, 2, 3):
        out = out ^ table[k][(v >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of A + B from those of A and B and the length of B: the remainder of A moves on by the bits of the length."""
    out, table = first.copy(), _zero_byte()
    for bit in range(int(length.max(initial=0)).bit_length()):
        own = np.flatnonzero((length >> bit) & 1)
        out[own] = _shifted(out[own], table)
        table = np.stack([_shifted(row, table) for row in table])
    return out ^ second


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(words of each text, number of each word, different words) of a chunk of texts."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2][int(ends[0]) : int(ends[-1])].to_pybytes().translate(BYTES) if texts.buffers()[2] else b""
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).tobytes()), pa.py_buffer(raw))
    split = pc.ascii_split_whitespace(plain)
    found = split.flatten().dictionary_encode()
    words = [w.encode() for w in found.dictionary.to_pylist()]
    at = found.indices.to_numpy()
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
    if b"" in words:  # beside spaces at either end of a text
        some = at != words.index(b"")
        at, owner = at[some], owner[some]
    return np.bincount(owner, minlength=len(texts)), at, words


def feature_buckets(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, the bucket of each word, and the bucket of each pair of neighbours at its first word (-1 at the
    last word of a text)."""
    counts, at, words = words_of(texts)
    crc = np.array([zlib.crc32(w) for w in words], np.uint32)
    after = np.array([zlib.crc32(b" " + w) for w in words], np.uint32)
    length = np.array([len(w) + 1 for w in words], np.int64)
    single = crc[at] if len(at) else np.zeros(0, np.uint32)
    pair = np.full(len(at), -1, np.int64)
    first = np.ones(len(at), bool)
    first[np.cumsum(counts)[counts > 0] - 1] = False
    own = np.flatnonzero(first)
    if len(own):
        pair[own] = joined_crc(single[own], after[at[own + 1]], length[at[own + 1]]) % np.uint32(buckets)
    return counts, (single % np.uint32(buckets)).astype(np.int64), pair


def chunks(texts: pa.Array):
    """(first row, texts) of at most CHUNK_BYTES together, or of one text; a null is an empty text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    total, a = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())]), 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(total, total[a] + CHUNK_BYTES, "right")) - 1)
        yield a, texts.slice(a, b - a)
        a = b


def bucket_counts(table: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket, over all texts."""

    def count(batches):
        out = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in chunks(batch.column(0)):
                _, single, pair = feature_buckets(texts, buckets)
                out += np.bincount(single, minlength=buckets) + np.bincount(pair[pair >= 0], minlength=buckets)
        own = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(out[own])], names=["bucket", "n"])

    found = table.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row for each bucket
        out[r["bucket"]] = r["n"]
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    s, t, n = corpus.astype(float), target.astype(float), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, min_words: int) -> DataFrame:
    """doc_id, n_features and weight of every document; part and k number those of `min_words` words or more."""

    def weigh(batches):
        part, eligible = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, texts in chunks(batch.column(1)):
                counts, single, pair = feature_buckets(texts, len(gains))
                gain = gains[single] + np.where(pair >= 0, gains[pair], 0)
                total = np.concatenate([[0], np.cumsum(gain)])
                ends = np.cumsum(counts)
                n = np.maximum(2 * counts - 1, 0)
                enough = counts >= min_words
                k = eligible + np.cumsum(enough) - 1
                eligible += int(enough.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(texts)), pa.array(n), pa.array((total[ends] - total[ends - counts]) // np.maximum(n, 1)),
                     pa.array(np.full(len(n), part)), pa.array(k, mask=~enough)],
                    names=["doc_id", "n_features", "weight", "part", "k"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(weigh, "doc_id long, n_features long, weight long, part long, k long")


def noise(seed: int) -> Column:
    h = hex_number(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def prefix(counts: DataFrame, group: str, order: str) -> DataFrame:
    """`counts` with `first`: the sum of n over all rows before it by (group, order)."""
    running = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)  # one row for each group
    base = counts.groupBy(group).agg(F.sum("n").alias("total")).select(group, F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inner = counts.withColumn("inner", F.coalesce(F.sum("n").over(running), F.lit(0)))
    return inner.join(base, group).withColumn("first", F.col("inner") + F.col("base")).drop("inner", "base")


def counting_pass(rows: DataFrame, digit: Column, base: int, block: int) -> DataFrame:
    """`rows` (with `at`, dense positions from 0) at their positions after a stable sort by `digit` (0 .. base - 1)."""
    keyed = rows.withColumn("block", F.floor(F.col("at") / block)).withColumn("digit", digit.cast("int"))
    counts = stage(keyed.groupBy("block", "digit").agg(F.count("*").alias("n")), "digit-counts")
    firsts = prefix(counts, "digit", "block").select(F.col("block").alias("owner"), F.col("digit").alias("value"), "first")
    columns = rows.columns

    def place(own: pa.Table, firsts: pa.Table) -> pa.Table:
        at = own["at"].to_numpy()
        order = np.empty(len(at), np.int64)
        order[at % block] = np.arange(len(at))  # a block's positions are dense
        digits = own["digit"].to_numpy()[order]
        counts = np.bincount(digits, minlength=base)
        first = np.zeros(base, np.int64)
        first[firsts["value"].to_numpy()] = firsts["first"].to_numpy()
        stable = np.argsort(digits.astype(np.uint16), kind="stable")
        to = np.arange(len(at)) + (first - (np.cumsum(counts) - counts))[digits[stable]]
        out = own.select(columns).take(pa.array(order[stable]))
        return out.set_column(columns.index("at"), "at", pa.array(to))

    return keyed.groupBy("block").cogroup(firsts.groupBy("owner")).applyInArrow(place, rows.schema)


def radix_sorted(rows: DataFrame, keys: list[tuple[Column, int]], digit_bits: int = DIGIT_BITS, block: int = BLOCK) -> DataFrame:
    """`rows` (with `at`, dense positions from 0) at their positions by `keys`, most significant first: (non-negative long,
    its bits; higher bits of it are equal in all rows). Rows with equal keys stay in their order."""
    for key, bits in reversed(keys):
        for low in range(0, bits, digit_bits):
            digit = F.shiftrightunsigned(key, low).bitwiseAND((1 << min(digit_bits, bits - low)) - 1)
            rows = stage(counting_pass(rows, digit, 1 << digit_bits, block), "radix-pass")
    return rows


def ranked(scored: DataFrame, digit_bits: int = DIGIT_BITS, block: int = BLOCK) -> tuple[DataFrame, int]:
    """Rows of `scored` (doc_id, n_features, weight, score, part, k) that have a number, with `at` (place from 0 by score descending,
    then doc_id), and their count."""
    some = scored.where(F.col("k").isNotNull())
    sign = F.lit(-(1 << 63))
    raw = F.col("doc_id").bitwiseXOR(sign)  # as an unsigned number this ascends with doc_id
    seen = some.agg(F.count("*").alias("n"), F.max("score").alias("top"), F.min("score").alias("low"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    if not seen["n"]:
        return some.select("doc_id", "n_features", "weight", "score", F.lit(0).cast("long").alias("at")), 0
    parts = some.groupBy("part").agg(F.count("*").alias("n")).withColumn("group", F.floor(F.col("part") / 1024))
    rows = some.join(prefix(parts, "group", "part").select("part", "first"), "part")
    rows = stage(rows.select("doc_id", "n_features", "weight", "score", (F.col("first") + F.col("k")).cast("long").alias("at")), "radix-input")
    of_id = 0 if seen["a"] is None else (seen["a"] ^ seen["b"]) & ((1 << 64) - 1)
    falling = (F.lit(seen["top"]) - F.col("score")) * 2 + F.col("doc_id").isNull().cast("long")
    keys = [(falling, (2 * (seen["top"] - seen["low"]) + 1).bit_length()), (F.coalesce(raw, F.lit(0).cast("long")), of_id.bit_length())]
    return radix_sorted(rows, keys, digit_bits, block), seen["n"]


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score of every document, and the rank of each drawn one: `percent` % of the documents of
    `min_words` words or more, by the highest scores towards the texts of `target`."""
    gains = gains_of(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = stage(weighed(docs, gains, min_words).withColumn("score", F.col("weight") + noise(seed)), "importance-scores")
    placed, n = ranked(scored)
    out = ["doc_id", "n_features", "weight", "score"]
    rank = F.when(F.col("at") < percent * n // 100, F.col("at") + 1)
    rest = scored.where(F.col("k").isNull()).select(*out, F.lit(None).cast("long").alias("rank"))
    return placed.select(*out, rank.alias("rank")).unionByName(rest)
