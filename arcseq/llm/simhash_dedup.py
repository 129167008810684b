"""SimHash near-duplicates by vantage-point trees.

A fingerprint holds a bit for each of the 64 bit positions of the shingle hashes, set where over half of them have it.
Copies fall together first: everything after works on distinct fingerprints.

Two fingerprints that differ in at most 3 bits differ in at most one bit of their upper or of their lower half. For each
half a vantage-point tree partitions the fingerprints by the Hamming distance of that half to a vantage point: left up to
the median, right beyond. A fingerprint goes to one home leaf and, as a query of radius 1, to every leaf that the triangle
inequality does not rule out; of two leaves that share a pair only the later one is asked. Every pair found in a leaf is
then checked on all 64 bits. A tree's shape is fitted on a bounded sample of fingerprints (`SAMPLE`); all fingerprints are
routed, and the shape changes no result. A leaf that holds many fingerprints is dealt out in blocks, each pair of blocks
to a task of its own.

A task does not emit its pairs but, for each fingerprint, one link to the first of its group in that leaf, which keeps
what is connected connected. Components come from alternating large-star and small-star rounds over these links, each
round written to the shared folder.

Nulls: a null text has no words and fingerprint zero; null doc_ids take no part in the smallest doc_id, and a component
that has none other gets null. Repeated rows share everything. An empty table gives an empty result. Other columns of the
input are left out of the digest; `keep_one` keeps them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcseq.llm.common import marked, sampled, share_of
from arcseq.session import stage

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Fingerprints a tree's shape is fitted on, at most, and at most this share of them.
SAMPLE = 65_536
SAMPLE_SHARE = 0.125
#: Fingerprints a leaf should hold, and from how many on it is dealt out in blocks of this size.
LEAF = 1024
BLOCK = 8192
CANDIDATES = 8
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes | None) -> int:
    import xxhash

    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(SHINGLE, len(words))
    last, first = ends[k - 1 :].tolist(), starts[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)], "<u8")
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * count > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and the columns named, of every row."""

    def read(batches):
        for b in batches:
            texts = b.column(0).cast(pa.binary())
            fps = [fingerprint(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fps, pa.int64())], names=[*b.schema.names[1:], "fp"])

    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *carry)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields[1:]}
    return rows.mapInArrow(read, ", ".join(f"`{k}` {v}" for k, v in kinds.items()) + ", fp long")


def half(fps: np.ndarray, tree: int) -> np.ndarray:
    """Upper (tree 0) or lower (tree 1) 32 bits of fingerprints."""
    u = fps.view(np.uint64) if fps.dtype == np.int64 else fps.astype(np.uint64)
    return ((u >> np.uint64(32)) if tree == 0 else (u & np.uint64(0xFFFFFFFF))).astype(np.uint32)


class VantageTree:
    """Shape of a tree over 32-bit halves: inner nodes with vantage point, radius and two children; leaves are numbered.

    A child `c` is the inner node c where c >= 0 and else the leaf -1 - c.
    """

    def __init__(self, sample: np.ndarray, leaves: int, seed: int):
        self.point, self.radius, self.child = [], [], []
        self.leaves = 0
        rng = np.random.default_rng(seed)
        self.root = self._grow(sample, leaves, rng)
        self.point, self.radius = np.array(self.point, np.uint32), np.array(self.radius, np.int64)
        self.child = np.array(self.child, np.int64).reshape(-1, 2)

    def _grow(self, own: np.ndarray, leaves: int, rng) -> int:
        best = None
        if leaves > 1 and len(own) >= 4:
            for p in rng.choice(own, min(CANDIDATES, len(own)), replace=False):
                d = np.bitwise_count(own ^ p)
                r = int(np.median(d))
                if 0 < (inside := int((d <= r).sum())) < len(own):
                    cost = abs(2 * inside - len(own)) + int(((d == r) | (d == r + 1)).sum())
                    if best is None or cost < best[0]:
                        best = (cost, p, r, d)
        if best is None:
            self.leaves += 1
            return -self.leaves
        _, p, r, d = best
        node = len(self.point)
        self.point.append(p)
        self.radius.append(r)
        self.child.append([0, 0])
        self.child[node] = [self._grow(own[d <= r], leaves // 2, rng), self._grow(own[d > r], leaves - leaves // 2, rng)]
        return node

    def route(self, halves: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that may hold something within `reach` of a row's half; reach 0 with one leaf each: home."""
        row, node = np.arange(len(halves)), np.full(len(halves), self.root)
        rows, leaves = [], []
        while len(row):
            done = node < 0
            rows.append(row[done])
            leaves.append(-1 - node[done])
            row, node = row[~done], node[~done]
            d = np.bitwise_count(halves[row] ^ self.point[node]).astype(np.int64)
            left, right = d - reach <= self.radius[node], d + reach > self.radius[node]
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([self.child[node[left], 0], self.child[node[right], 1]])
        return np.concatenate(rows), np.concatenate(leaves)

    def home(self, halves: np.ndarray) -> np.ndarray:
        row, leaf = self.route(halves, 0)
        out = np.empty(len(halves), np.int64)
        out[row] = leaf
        return out


def grow_trees(distinct: DataFrame, n: int) -> list[VantageTree]:
    """Both trees from a bounded sample, chosen by a hash of the fingerprint."""
    share = min(SAMPLE_SHARE, share_of(n, SAMPLE))
    picked = distinct.where(sampled(F.xxhash64(F.lit(SEED), "fp"), share)).select("fp").limit(2 * SAMPLE)
    sample = np.sort(np.array([r[0] for r in picked.collect()], np.int64))
    leaves = 1 << max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))
    return [VantageTree(half(sample, t), leaves, SEED + t) for t in (0, 1)]


def homes(distinct: DataFrame, trees: list[VantageTree]) -> DataFrame:
    def read(batches):
        for b in batches:
            fps = b.column(0).to_numpy()
            for t, tree in enumerate(trees):
                leaf, count = np.unique(tree.home(half(fps, t)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), t, np.int32)), pa.array(leaf), pa.array(count)], names=["tree", "leaf", "n"])

    return distinct.select("fp").mapInArrow(read, "tree int, leaf long, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n"))


def routed(distinct: DataFrame, trees: list[VantageTree], blocks: dict[tuple[int, int], int]) -> DataFrame:
    """(tree, leaf, a, b, block, home, fp): every fingerprint in its home leaf and in later leaves that it has to ask.

    In a leaf dealt out in k blocks, the task (a, b) compares block a with block b, so a row goes to k tasks.
    """

    def read(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for t, tree in enumerate(trees):
                halves = half(fps, t)
                home = tree.home(halves)
                row, leaf = tree.route(halves, 1)
                ask = leaf > home[row]
                row = np.concatenate([np.arange(len(fps)), row[ask]])
                leaf = np.concatenate([home, leaf[ask]])
                is_home = np.arange(len(row)) < len(fps)
                k = np.ones(len(row), np.int64)
                for (tt, full), n in blocks.items():
                    if tt == t:
                        k[leaf == full] = n
                block = ((fps[row].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % k
                again = np.repeat(np.arange(len(row)), k)
                other = np.arange(len(again)) - np.repeat(np.cumsum(k) - k, k)
                mine = block[again]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(again), t, np.int32)), pa.array(leaf[again]), pa.array(np.minimum(mine, other)),
                        pa.array(np.maximum(mine, other)), pa.array(mine), pa.array(is_home[again]), pa.array(fps[row][again]),
                    ],
                    names=["tree", "leaf", "a", "b", "block", "home", "fp"],
                )

    return distinct.select("fp").mapInArrow(read, "tree int, leaf long, a long, b long, block long, home boolean, fp long")


def leaf_links(table: pa.Table) -> pa.Table:
    """One link from each fingerprint of a task to the first of its group, over all pairs within MAX_BITS."""
    fps = table["fp"].to_numpy()
    order = np.argsort(fps, kind="stable")
    fps = fps[order]
    home, block = table["home"].to_numpy()[order], table["block"].to_numpy()[order]
    split = table["a"][0].as_py() != table["b"][0].as_py()
    u = fps.view(np.uint64)
    label = np.arange(len(fps))
    asked = np.flatnonzero(home)
    step = max(1, (1 << 22) // max(len(fps), 1))
    for at in range(0, len(asked), step):
        mine = asked[at : at + step]
        near = np.bitwise_count(u[mine][:, None] ^ u[None, :]) <= MAX_BITS
        if split:
            near &= block[mine][:, None] != block[None, :]
        i, j = np.nonzero(near)
        a, b = mine[i], j
        while True:
            low = np.minimum(label[a], label[b])
            if (label[a] == low).all() and (label[b] == low).all():
                break
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
    while (label[label] != label).any():
        label = label[label]
    linked = label != np.arange(len(fps))
    return pa.table({"u": pa.array(fps[linked]), "v": pa.array(fps[label[linked]])})


def links(distinct: DataFrame) -> DataFrame:
    """(u, v): links that connect just the fingerprints within MAX_BITS of one another."""
    n = distinct.count()
    trees = grow_trees(distinct, n)
    full = homes(distinct, trees).where(F.col("n") > BLOCK).collect()  # leaves of both trees at most
    blocks = {(r["tree"], r["leaf"]): int(-(-r["n"] // BLOCK)) for r in full}
    parts = routed(distinct, trees, blocks)
    return parts.groupBy("tree", "leaf", "a", "b").applyInArrow(leaf_links, "u long, v long").where("u != v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def stars(edges: DataFrame) -> DataFrame:
    """(u, v) with v the smallest node that u is connected to, for every u but these smallest nodes."""
    edges = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = _mark(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "links-least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = stage(large, "links-large")
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")), "links-least")
        met = large.join(least, "u")
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(met.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = stage(small, "links-small")
        after = _mark(edges)
        if after == before:
            break
        before = after
    return edges


def components(rows: DataFrame) -> DataFrame:
    """fp -> root and component_id (smallest doc_id) of the fingerprints in `rows` (a written table of `fingerprints`)."""
    distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints-distinct")
    roots = stars(links(distinct)).select(F.col("u").alias("fp"), F.col("v").alias("v"))
    rooted = distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("v", "fp").alias("root"))
    rooted = stage(rooted, "fingerprints-rooted")
    smallest = stage(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "components")
    return stage(rooted.join(smallest, "root").select("fp", "root", "component_id"), "fingerprints-components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    rows = stage(fingerprints(docs), "fingerprints")
    joined = rows.join(components(rows), "fp")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, that with the smallest doc_id (nulls last), with all its columns."""
    tagged = marked(docs)
    rows = stage(fingerprints(tagged, "key"), "fingerprints")
    joined = rows.join(components(rows).select("fp", "root"), "fp")
    first = joined.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("k"))
    first = stage(first.select("k.key"), "components-first")
    once = F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0)))  # of repeated rows one
    return tagged.join(first, "key", "left_semi").withColumn("k", once).where("k = 1").select("row.*")
