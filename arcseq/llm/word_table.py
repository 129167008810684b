"""Encoding and decoding through a table of distinct words.

The vocabulary's pre-tokenizer never joins characters across ASCII white space, so the ids of a text are the ids of its
words in order, and the library decodes by putting one space between the pieces of all ids. The steps:

1. tasks split whole texts into words and number the different words of each block of documents (`BLOCK_BYTES` of text, one
   document at least), frequent ones first; a document becomes the list of its words' numbers, in a byte or two each;
2. the words of all blocks meet in buckets by a hash of the word, and the library encodes each distinct word once;
3. the ids go back to their blocks, and there by position to each place of each document;
4. decoding joins each row to the vocabulary's table of pieces, and takes each id's piece.

Only the words that differ within a block are shuffled by word: a word that holds a third of all places takes part once per
block, and a bucket is a stream of rows of which a task keeps the distinct words alone. A block's documents and its part of
the table meet in one task, and a block has a bounded size. The piece table is one row of as many pieces as the vocabulary
has, whatever the corpus; it is broadcast.

Nulls: a null text is an empty one and has no ids; a null doc_id stays null. Repeated rows are documents of their own. A
word without ids (white space beyond ASCII) adds nothing. An empty table gives an empty result. Other columns of the
input are left out. An id without a piece is an error.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcseq.llm.word_ids import ragged, vocabulary
from arcseq.session import new_path

BLOCK_BYTES = 16 << 20
#: Words of blocks that meet in a bucket, about.
BUCKET_WORDS = 1 << 17
#: Numbers that are packed at a time, and bytes of positions that are replaced at a time.
SLICE = 1 << 18


def slices(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive ranges of rows of at most `most` bytes together, or of one row."""
    total, out, a = np.concatenate([[0], np.cumsum(sizes)]), [], 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(total, total[a] + most, "right")) - 1)
        out.append((a, b))
        a = b
    return out


def packed(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the numbers, seven bits to a byte, the last byte of each below 128; and where each number ends."""
    sizes = np.ones(len(numbers), np.int8)
    for k in range(1, 5):
        sizes += numbers >= 1 << 7 * k
    ends = np.cumsum(sizes, dtype=np.int64)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for a in range(0, len(numbers), SLICE):  # some at a time, so that few work arrays are held
        n, size, starts = (x[a : a + SLICE] for x in (numbers, sizes, ends - sizes))
        for k in range(int(size.max())):
            own = np.flatnonzero(size > k)
            out[starts[own] + k] = (n[own] >> 7 * k) & 127 | np.where(size[own] > k + 1, 128, 0)
    return out, ends


def unpacked(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, and where each ends."""
    ends = np.flatnonzero(raw < 128) + 1
    starts = np.concatenate([[0], ends])[:-1]
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(ends, prepend=0))
    parts = (raw & 127).astype(np.int64) << 7 * place
    return np.add.reduceat(parts, starts) if len(ends) else np.zeros(0, np.int64), ends


def blocks_of(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per document: block, doc_id, at (numbers of its words in the block); in the row of a block's first document also
    words (the block's different words in the order of their numbers, blanks between them) and n_words (their number)."""

    def split(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            for a, b in slices(pc.binary_length(texts).to_numpy(), block_bytes):
                words = pc.ascii_split_whitespace(texts.slice(a, b - a))
                found = words.flatten().dictionary_encode()
                at = found.indices.to_numpy()
                order = np.argsort(-np.bincount(at, minlength=len(found.dictionary)), kind="stable")
                number = np.empty(len(order), np.int32)
                number[order] = np.arange(len(order))
                raw, ends = packed(number[at])
                bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy())])].tolist()
                raw = memoryview(raw.tobytes())
                rows = [
                    pa.array(np.full(b - a, block)), batch.column(0).slice(a, b - a),
                    pa.array([raw[x:y] for x, y in zip(bounds, bounds[1:], strict=False)], pa.binary()),
                    pa.array([" ".join(found.dictionary.take(pa.array(order)).to_pylist()), *[None] * (b - a - 1)], pa.string()),
                    pa.array([len(order), *[None] * (b - a - 1)], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(rows, names=["block", "doc_id", "at", "words", "n_words"])
                block += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(split, "block long, doc_id long, at binary, words string, n_words long")


def by_block(rows: DataFrame) -> DataFrame:
    """`rows` written once and read back, dealt by block, so that what meets them by block need not shuffle them again. The
    catalog forgets the table at once; its files stay in the shared folder."""
    spark = rows.sparkSession
    name = f"word_blocks_{uuid.uuid4().hex}"
    files = rows.write.option("compression", "zstd").option("path", new_path(spark, name))
    files.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def bucketed(rows: DataFrame, bucket_words: int) -> DataFrame:
    """bucket, owner, k, words: the words of each block (the owner) by bucket; k are the steps between their numbers, packed."""
    buckets = max(1, -(-(rows.agg(F.sum("n_words")).first()[0] or 0) // bucket_words))

    def deal(batches):
        for batch in batches:
            for owner, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = np.array(words.split(" "), object)
                of = np.array([zlib.crc32(w.encode()) % buckets for w in words])
                order = np.argsort(of, kind="stable")
                parts = np.split(order, np.flatnonzero(np.diff(of[order])) + 1)
                cells = [[of[p[0]] for p in parts], [owner] * len(parts), [packed(np.diff(p, prepend=0))[0].tobytes() for p in parts], [" ".join(words[p]) for p in parts]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=["bucket", "owner", "k", "words"])

    return rows.where(F.col("n_words").isNotNull()).select("block", "words").mapInArrow(deal, "bucket long, owner long, k binary, words string")


def encode_words(cells: DataFrame, path: str) -> DataFrame:
    """owner, k, sizes (packed) and ids (two bytes each, or four) of the words of each row (bucket, owner, k, words). The library encodes a word once: the
    rows of its bucket are read one after the other, and its ids are kept until the bucket ends."""

    def encode(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        wide = max(tokenizer.get_vocab().values()) >= 1 << 16
        bucket, known = None, {}
        for batch in batches:
            of = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if of[a] != bucket:
                    bucket, known = of[a], {}
                rows = [w.split(" ") for w in batch.column(3).slice(a, b - a).to_pylist()]
                new = list({w: None for row in rows for w in row if w not in known})
                known.update(zip(new, (e.ids for e in tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))
                sizes, ids = [], []
                for row in rows:
                    own = [known[w] for w in row]
                    sizes.append(packed(np.array([len(x) for x in own]))[0].tobytes())
                    ids.append(np.array([i for x in own for i in x], "<u4" if wide else "<u2").tobytes())
                cells = [*(batch.column(k).slice(a, b - a) for k in (1, 2)), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(cells, names=["owner", "k", "sizes", "ids"])

    met = cells.repartition("bucket").sortWithinPartitions("bucket")
    return met.mapInArrow(encode, "owner long, k binary, sizes binary, ids binary")


def encode(docs: DataFrame, path: str | None = None, block_bytes: int = BLOCK_BYTES, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """doc_id and ids of every document."""
    path = path or vocabulary()
    rows = by_block(blocks_of(docs, block_bytes))
    table = encode_words(bucketed(rows, bucket_words), path)

    def read(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all rows, and how many each row has."""
        numbers, ends = unpacked(np.frombuffer(b"".join(column.to_pylist()), np.uint8))
        return numbers, np.diff(np.searchsorted(ends, np.cumsum(pc.binary_length(column).to_numpy()), "right"), prepend=0)

    def place(own: pa.Table, found: pa.Table) -> pa.Table:
        start, size, ids = (np.zeros(0, np.int64) for _ in range(3))
        if len(found):
            found = found.combine_chunks()
            steps, n = read(found["k"].chunk(0))
            total = np.cumsum(steps)
            k = total - np.repeat(np.concatenate([[0], total])[np.cumsum(n) - n], n)
            sizes = read(found["sizes"].chunk(0))[0]
            flat = b"".join(found["ids"].to_pylist())
            ids = np.frombuffer(flat, "<u2" if len(flat) == 2 * sizes.sum() else "<u4").astype(np.int32)
            start, size = np.empty(len(k), np.int64), np.empty(len(k), np.int64)
            size[k], start[k] = sizes, np.cumsum(sizes) - sizes
        own = own.combine_chunks()
        at, out = own["at"].chunk(0), []
        for a, b in slices(pc.binary_length(at).to_numpy(), SLICE):
            words, counts = read(at.slice(a, b - a))
            taken = ids[ragged(start[words], size[words])] if len(words) else ids[:0]
            offsets = np.concatenate([[0], np.cumsum(size[words])])[np.concatenate([[0], np.cumsum(counts)])] if len(words) else np.zeros(b - a + 1)
            out.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(taken.astype(np.int32))))
        return pa.table({"doc_id": own["doc_id"], "ids": pa.chunked_array(out, pa.list_(pa.int32()))})

    left = rows.select("block", "doc_id", "at").groupBy("block")
    return left.cogroup(table.groupBy("owner")).applyInArrow(place, "doc_id long, ids array<int>")


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """One row: the vocabulary's pieces by id (null where it has none)."""
    from tokenizers import Tokenizer

    found = {i: piece for piece, i in Tokenizer.from_file(path).get_vocab(with_added_tokens=True).items()}
    return spark.createDataFrame([(1, [found.get(i) for i in range(max(found) + 1)])], "vocabulary int, pieces array<string>")


def decode(sequences: DataFrame, path: str | None = None) -> DataFrame:
    """`sequences` (with ids) and the text of each: the pieces of its ids with a space between them; null ids have an empty
    text."""
    path = path or vocabulary()
    known = F.broadcast(pieces(sequences.sparkSession, path))
    missing = F.raise_error(F.lit("an id without a piece")).cast("string")
    joined = sequences.withColumn("vocabulary", F.when(F.col("ids").isNotNull(), 1)).join(known, "vocabulary", "left")
    spelt = F.transform("ids", lambda i: F.coalesce(F.get("pieces", i), missing))
    return joined.withColumn("text", F.coalesce(F.array_join(spelt, " "), F.lit(""))).drop("vocabulary", "pieces")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Token count and digests of the ids and of the decoded text, of every document."""
    spelt = F.array_join(F.col("ids").cast("array<string>"), " ")
    hashes = [F.sha2(x.cast("binary"), 256).alias(name) for x, name in ((spelt, "ids_sha256"), (F.col("text"), "decoded_sha256"))]
    return decode(encode(docs, path), path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), *hashes)
