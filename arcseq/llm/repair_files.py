"""Token-id shards under Re-Pair grammar compression.

Documents are put into ascending order of doc_id by a range shuffle, encoded, and cut into shards. Within a shard the
most frequent pairs of symbols are replaced by nonterminals, many pairs to a round, until no pair repeats often enough or
the 16-bit symbol space is full. A pair never reaches over the end of a document, so a document is a run of symbols of its
own and is decoded alone.

File format (little endian): the magic `RPR1`; five 8-byte counts: terminals, rules, documents, symbols, tokens; then
`rules` pairs of 2-byte symbols (rule k is symbol terminals + k, its parts are smaller symbols), the 8-byte number of
tokens that each rule expands to, the first symbol of each document and the first token of each document (8 bytes each,
with one more at the end), and the symbols (2 bytes each).

Nulls: a null text is an empty document (the end id alone); documents with a null doc_id come first. Repeated rows are
documents of their own. An empty table gives no shard. Other columns of the input are left out.

Recovery: a shard is written under a draft name and moved to a name made of its partition and number, so a task that runs
again replaces its own files; only files named in the manifest are read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcseq.llm import files
from arcseq.llm.word_ids import encoder, ragged, vocabulary
from arcseq.session import stage

MAGIC = b"RPR1"
END = 1
TERMINALS = 49_408
SYMBOLS = 1 << 16
#: Tokens after which a shard is closed.
SHARD_TOKENS = 2_000_000
ROUNDS = 6
#: A pair must repeat so often in its shard to become a rule.
MIN_REPEATS = 16
TABLE_BITS = 22


def frequent_pairs(keys: np.ndarray, most: int, least: int) -> np.ndarray:
    """Up to `most` pair keys that occur `least` times or more, most frequent first (ties: smaller key)."""
    found = np.sort(keys)
    edges = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1], [True]]))
    counts = np.diff(edges)
    often = np.flatnonzero(counts >= least)
    order = np.lexsort((found[edges[often]], -counts[often]))[:most]
    return found[edges[often[order]]]


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint32(2654435761)) >> np.uint32(32 - TABLE_BITS)


def replaced(symbols: np.ndarray, last: np.ndarray, pairs: np.ndarray, first_new: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols with occurrences of `pairs` replaced, the ends of documents among them, and the pairs used.

    Where occurrences overlap, the more frequent pair wins, and the earlier one between equal pairs.
    """
    none = len(pairs)
    table = np.full(1 << TABLE_BITS, none, np.int32)
    slots = _slot(pairs)
    table[slots[::-1]] = np.arange(none - 1, -1, -1, dtype=np.int32)
    keys = (symbols[:-1].astype(np.uint32) << np.uint32(16)) | symbols[1:]
    rank = table[_slot(keys)]
    rank[np.concatenate([pairs, [0]]).astype(np.uint32)[rank] != keys] = none
    rank[last[:-1]] = none
    wins = rank < none
    wins[1:] &= rank[1:] < rank[:-1]
    wins[:-1] &= rank[:-1] <= rank[1:]
    at = np.flatnonzero(wins)
    used, number = np.unique(rank[at], return_inverse=True)
    out = symbols.copy()
    out[at] = (first_new + number).astype(np.uint16)
    ends = last.copy()
    ends[at] = last[at + 1]
    keep = np.ones(len(out), bool)
    keep[at + 1] = False
    return out[keep], ends[keep], pairs[used]


def compress(ids: np.ndarray, lengths: np.ndarray, terminals: int = TERMINALS, rounds: int = ROUNDS, least: int = MIN_REPEATS):
    """(rules, symbols, symbols of each document) of the ids of a shard."""
    symbols = ids.astype(np.uint16)
    last = np.zeros(len(ids), bool)
    last[np.cumsum(lengths) - 1] = True
    rules: list[np.ndarray] = []
    size = terminals
    for k in range(rounds):
        room = -(-(SYMBOLS - size) // (rounds - k))
        if len(symbols) < 2 or room <= 0:
            break
        keys = ((symbols[:-1].astype(np.uint32) << np.uint32(16)) | symbols[1:])[~last[:-1]]
        pairs = frequent_pairs(keys, room, least)
        if not len(pairs):
            break
        symbols, last, used = replaced(symbols, last, pairs, size)
        if not len(used):
            break
        rules.append(used)
        size += len(used)
    flat = np.concatenate(rules) if rules else np.zeros(0, np.uint32)
    parts = np.stack([flat >> 16, flat & 0xFFFF], axis=1).astype(np.uint16)
    ends = np.flatnonzero(last) + 1
    return parts, symbols, np.diff(np.concatenate([[0], ends]))


def expansion_sizes(rules: np.ndarray, terminals: int) -> np.ndarray:
    """Tokens that each rule stands for; the parts of a rule come before it."""
    size = np.ones(terminals + len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        size[terminals + k] = size[a] + size[b]
    return size[terminals:]


def shard_bytes(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    rules, symbols, per_doc = compress(ids, lengths)
    firsts = [np.concatenate([[0], np.cumsum(x)]).astype("<i8").tobytes() for x in (per_doc, lengths)]
    head = MAGIC + struct.pack("<5q", TERMINALS, len(rules), len(lengths), len(symbols), len(ids))
    sizes = expansion_sizes(rules, TERMINALS).astype("<i8").tobytes()
    return b"".join([head, rules.astype("<u2").tobytes(), sizes, *firsts, symbols.astype("<u2").tobytes()])


class Shard:
    """A shard file, decoded by document or as a whole."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a shard file")
        self.terminals, n_rules, self.docs, n_symbols, self.tokens = struct.unpack_from("<5q", raw, 4)
        at = 44

        def part(kind: str, n: int) -> np.ndarray:
            nonlocal at
            a = np.frombuffer(raw, kind, n, at)
            at += a.nbytes
            return a

        self.rules = part("<u2", 2 * n_rules).reshape(-1, 2)
        self.sizes = np.concatenate([np.ones(self.terminals, np.int64), part("<i8", n_rules)])
        self.first_symbol, self.first_token = part("<i8", self.docs + 1), part("<i8", self.docs + 1)
        self.symbols = part("<u2", n_symbols)
        self._spell()

    def _spell(self) -> None:
        """All expansions end to end: a rule's is its parts' one after the other."""
        self.at = np.cumsum(self.sizes) - self.sizes
        self.spelt = np.zeros(int(self.sizes.sum()), np.uint16)
        self.spelt[: self.terminals] = np.arange(self.terminals)
        at, sizes, spelt = self.at.tolist(), self.sizes.tolist(), self.spelt
        for k, (a, b) in enumerate(self.rules.tolist(), self.terminals):
            x = at[k]
            spelt[x : x + sizes[a]] = spelt[at[a] : at[a] + sizes[a]]
            spelt[x + sizes[a] : x + sizes[k]] = spelt[at[b] : at[b] + sizes[b]]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return self.spelt[ragged(self.at[symbols], self.sizes[symbols])]

    def document(self, k: int) -> np.ndarray:
        """Ids of document `k` alone."""
        return self.expand(self.symbols[self.first_symbol[k] : self.first_symbol[k + 1]])

    def all(self) -> np.ndarray:
        return self.expand(self.symbols)


def write_shards(docs: DataFrame, folder: str, path: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the shards of all documents; one row per shard: its place, file, doc_ids and tokens."""

    def write(batches):
        enc = encoder(path)
        partition = TaskContext.get().partitionId()
        number, held, owners, total = 0, [], [], 0

        def close():
            nonlocal number, held, owners, total
            ids, lengths = (np.concatenate(x) for x in zip(*held, strict=True))
            name = f"{folder}/shard-{partition:06d}-{number:06d}.rpr"
            files.put(name, [shard_bytes(ids, lengths)])
            row = pa.RecordBatch.from_arrays(
                [pa.array([partition]), pa.array([number]), pa.array([name]), pa.array([owners], pa.list_(pa.int64())), pa.array([total])],
                names=["partition", "number", "file", "doc_ids", "tokens"],
            )
            number, held, owners, total = number + 1, [], [], 0
            return row

        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            at = 0
            for ids, lengths in enc.encode(batch.column(1), END):
                cuts = np.flatnonzero(np.diff((np.cumsum(lengths) + total) // shard_tokens, append=-1)) + 1
                a = 0
                for b in cuts.tolist():
                    n = int(lengths[a:b].sum())
                    t = int(lengths[:a].sum())
                    held.append((ids[t : t + n], lengths[a:b]))
                    owners += ids_of[at + a : at + b]
                    total += n
                    a = b
                    if total >= shard_tokens:
                        yield close()
                at += len(lengths)
        if held:
            yield close()

    parts = max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spread = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return spread.mapInArrow(write, "partition long, number long, file string, doc_ids array<long>, tokens long")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, place in its shard, token count and crc32 of the ids of every document in the files of `manifest`."""

    def read(batches):
        for b in batches:
            for name, first, owners in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                shard = Shard(files.get(name))
                starts = shard.first_token.tolist()
                crc = []
                for lo in range(0, shard.docs, 64):  # some documents at a time, so that a shard is never whole in memory
                    hi = min(lo + 64, shard.docs)
                    ids = shard.expand(shard.symbols[shard.first_symbol[lo] : shard.first_symbol[hi]])
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crc += [zlib.crc32(raw[4 * (starts[k] - starts[lo]) : 4 * (starts[k + 1] - starts[lo])]) for k in range(lo, hi)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(owners, pa.int64()), pa.array(shard.first_token[:-1] + first), pa.array(np.diff(shard.first_token)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    spread = manifest.select("file", "first", "doc_ids").repartition(4 * manifest.sparkSession.sparkContext.defaultParallelism, "file")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digest of every document, from the files."""
    folder = files.shared_folder(docs.sparkSession, "token-shards")
    manifest = stage(write_shards(docs, folder, path or vocabulary()), "token-manifest")
    order = Window.orderBy("partition", "number")  # one row for each shard
    first = F.sum("tokens").over(order) - F.col("tokens")
    starts = manifest.select("file", "partition", "number", "tokens").withColumn("first", first).select("file", "first")
    return read_shards(manifest.select("file", "doc_ids").join(starts, "file"))
