"""Best-fit packing of documents into sequences by exact-complement hashing.

Each document is its token ids and an end id. A document longer than a sequence is cut into whole sequences and a rest;
every other document stays whole. What packing has to know of the corpus is how many pieces there are of each length, at
most 2,048 numbers. Over these counts the plan takes the longest piece left and looks for one, two or three lengths that
fill its gap exactly, in an index of the lengths still available and of the sums of two and three, and uses the combination
as often as all its lengths allow. Where no combination fits exactly, the longest piece that fits goes in (best fit) and
the search goes on for the rest of the gap. Each step uses up a length, so the plan is short however large the corpus is.

Pieces then find their place: they are ranked within their length, bucket by bucket, and the plan says which ranks go to
which sequences and offsets.

Nulls: a null text is an empty document, that is the end id alone; a null doc_id stays null. Repeated rows are documents
of their own. An empty table gives no sequences. Other columns of the input are left out.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcseq.llm.word_ids import encoder, vocabulary
from arcseq.session import stage

ROOM = 2048
END = 0
#: Rows of one length are ranked in so many buckets.
BUCKETS = 1024


def pieces(docs: DataFrame, path: str, room: int = ROOM, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row."""

    def cut(batches):
        enc = encoder(path)
        for batch in batches:
            at = 0
            for ids, lengths in enc.encode(batch.column(1), end):
                n = -(-lengths // room)
                row = np.repeat(np.arange(len(lengths)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * room
                length = np.minimum(lengths[row] - start, room)
                first = (np.cumsum(lengths) - lengths)[row] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(first.tolist(), length.tolist(), strict=True)]
                own = batch.column(0).take(pa.array(row + at))
                at += len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Shelf:
    """Pieces left of each length, with the sums of two and of three available lengths."""

    def __init__(self, counts: dict[int, int], room: int):
        self.room = room
        self.left = np.zeros(room + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self._index()

    def _index(self) -> None:
        self.there = self.left > 0
        self.there[0] = False
        self.there[self.room] = False
        f = np.fft.rfft(self.there.astype(float), 4 * (self.room + 1))
        self.sums, self.sums3 = (np.rint(np.fft.irfft(x))[: self.room + 1] > 0 for x in (f * f, f * f * f))

    def spare(self, held: list[int]) -> np.ndarray:
        """Pieces left of each length beside those held."""
        left = self.left.copy()
        for k in held:
            left[k] -= 1
        return left

    def pair(self, gap: int, spare: np.ndarray) -> list[int] | None:
        if gap < 2 or not self.sums[gap]:
            return None
        a = np.arange(gap - 1, (gap - 1) // 2, -1)
        b = gap - a
        fits = a[self.there[a] & self.there[b] & (spare[a] > (a == b)) & (spare[b] > 0)]
        return [int(fits[0]), gap - int(fits[0])] if len(fits) else None

    def exact(self, gap: int, held: list[int]) -> list[int] | None:
        """One, two or three available lengths that add up to `gap`, beside those already `held`; all are tried."""
        spare = self.spare(held)
        if self.there[gap] and spare[gap] > 0:
            return [gap]
        if two := self.pair(gap, spare):
            return two
        if gap < 3 or not self.sums3[gap]:
            return None
        a = np.arange(gap - 2, 0, -1)
        for x in a[self.there[a] & self.sums[gap - a] & (spare[a] > 0)].tolist():
            spare[x] -= 1
            two = self.pair(gap - x, spare)
            spare[x] += 1
            if two:
                return [x, *two]
        return None

    def longest(self, gap: int, held: list[int]) -> int | None:
        fits = np.flatnonzero(self.there[: gap + 1])[::-1]
        for n, x in enumerate(fits.tolist()):
            if self.left[x] > (held.count(x) if n < len(held) + 1 else 0):
                return x
        return None

    def take(self, lengths: list[int]) -> int:
        """Use the combination as often as its lengths allow."""
        need = Counter(lengths)
        times = int(min(self.left[k] // n for k, n in need.items()))
        for k, n in need.items():
            self.left[k] -= n * times
        if any(self.left[k] == 0 for k in need):
            self._index()
        return times


def plan(counts: dict[int, int], room: int = ROOM) -> list[tuple[int, int, int, int]]:
    """(length, first rank, first sequence, offset) of every run of ranks; runs of a length are in order of rank.

    The piece of a length with rank r in a run goes to sequence `first sequence + r - first rank`.
    """
    shelf = Shelf(counts, room)
    used: Counter = Counter()
    runs, sequence = [], 0

    def place(lengths: list[int], times: int) -> None:
        nonlocal sequence
        offset = 0
        for k in lengths:
            runs.append((k, used[k], sequence, offset))
            used[k] += times
            offset += k
        sequence += times

    if shelf.left[room]:
        place([room], int(shelf.left[room]))
        shelf.left[room] = 0
    for length in range(room - 1, 0, -1):
        while shelf.left[length]:
            held, gap = [length], room - length
            while gap:
                if fill := shelf.exact(gap, held):
                    held += fill
                    break
                if (x := shelf.longest(gap, held)) is None:
                    break
                held.append(x)
                gap -= x
            place(held, shelf.take(held))
    return sorted(runs)


def ranked(rows: DataFrame) -> DataFrame:
    """`rank` (from 0) of every piece within its length; no more than a bucket of a length is ranked together."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(BUCKETS)).cast("int"))
    place = ["length", "bucket"]
    counts = rows.groupBy(*place).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    own = F.row_number().over(Window.partitionBy(*place).orderBy("doc_id", "piece"))
    joined = rows.withColumn("own", own).join(counts.select(*place, before.alias("before")), place)
    return joined.withColumn("rank", F.col("before") + F.col("own") - 1).drop("bucket", "own", "before")


def placed(rows: DataFrame, runs: list[tuple[int, int, int, int]]) -> DataFrame:
    """`rows` with sequence_id and offset by the runs of the plan."""
    table = np.array(runs, np.int64).reshape(-1, 4)
    length, first, sequence, offset = table.T
    starts = np.searchsorted(length, np.arange(ROOM + 2))

    def assign(batches):
        for b in batches:
            k, r = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.zeros(len(k), np.int64)
            order = np.lexsort((r, k))
            for x in np.unique(k):
                own = order[np.searchsorted(k[order], x) : np.searchsorted(k[order], x, "right")]
                lo, hi = starts[x], starts[x + 1]
                at[own] = lo + np.searchsorted(first[lo:hi], r[own], "right") - 1
            new = [pa.array(sequence[at] + r - first[at], pa.int64()), pa.array(offset[at], pa.int64())]
            kept = [c for c in b.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in kept] + new, names=[*kept, "sequence_id", "offset"])

    return rows.mapInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digest of every piece: where it lies in its document and in its sequence."""
    cut = stage(pieces(docs, path or vocabulary()), "pack-pieces")
    counts = {int(r["length"]): int(r["count"]) for r in cut.groupBy("length").count().collect()}  # at most 2,048 rows
    order = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
    return placed(ranked(cut).select(*order), plan(counts))
