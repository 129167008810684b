"""Nearest neighbours by inner product through a hierarchical k-means tree.

The tree's shape (centres, spreads) is fitted in numpy on a bounded sample (`SAMPLE` vectors); every vector is then put
into its leaf. A query walks the tree best bin first: a priority queue holds the nodes met so far by the inner product
that their best vector is expected to reach, the best is opened, and the walk ends after a number of leaves. That number
is calibrated: for some queries (`CALIBRATE`) the true neighbours are found by brute force over all vectors, and leaf
visits are widened until the mean recall of these queries reaches `RECALL`.

Leaves are gathered into shards of like size (a leaf with many vectors is dealt to several), and each query goes to the
shards of the leaves it visits. A shard that more than `QUERY_BLOCK` queries visit is searched in blocks of them, and only its
vectors are copied, once for each block.

Equal vectors are searched as one. It stands for its k + 1 smallest vec_ids, which are all that a list of k neighbours can
hold of them, as ties go to the smaller vec_id; so a group of copies of any size costs as much as one vector.

Left out, as queries and as candidates: rows whose vector is null, empty, all zero, holds a null or a value that is not
finite, or has another length than most vectors of the table, and rows with a null vec_id. Repeated rows count once. An
empty table gives an empty result. Other columns of the input take no part.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcseq.llm.common import sampled, share_of
from arcseq.llm.word_ids import ragged
from arcseq.session import stage

K = 20
EVERY = 20
#: Vectors that the tree's shape is fitted on, and bytes of them, at most.
SAMPLE = 65_536
SAMPLE_BYTES = 64 << 20
BRANCHES = 8
#: Vectors that a leaf should hold; beyond MOST_LEAVES leaves they hold more.
LEAF = 256
MOST_LEAVES = 4096
RECALL = 0.96
CALIBRATE = 256
SHARD_ROWS = 100_000
QUERY_BLOCK = 20_000
ROUNDS = 8


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


class Tree:
    """Nodes with centre, spread (root mean square distance) and size in the sample; a leaf has a number, others children."""

    def __init__(self, sample: np.ndarray, leaf_rows: float, seed: int = 42):
        self.rng = np.random.default_rng(seed)
        self.leaf_rows = max(leaf_rows, 1.0)
        self.centre, self.spread, self.size, self.children, self.leaf = [], [], [], [], []
        self.leaves = 0
        self._grow(sample)
        self.centre, self.spread, self.size = np.array(self.centre), np.array(self.spread), np.array(self.size)
        self.reach = self.spread * np.sqrt(2 * np.log(np.maximum(self.size, 2)) / self.centre.shape[1])
        self.leaf_node = np.array([k for k, x in enumerate(self.leaf) if x >= 0])

    def _grow(self, own: np.ndarray) -> int:
        node = len(self.centre)
        centre = own.mean(axis=0)
        self.centre.append(centre)
        self.spread.append(float(np.sqrt(((own - centre) ** 2).sum(axis=1).mean())))
        self.size.append(len(own))
        self.children.append([])
        self.leaf.append(-1)
        if len(own) > self.leaf_rows and self.spread[node] > 0:
            mine = self._means(own, min(BRANCHES, max(2, int(np.ceil(len(own) / self.leaf_rows)))))
            parts = [own[mine == k] for k in np.unique(mine)]
            if len(parts) > 1:
                self.children[node] = [self._grow(p) for p in parts]
                return node
        self.leaf[node] = self.leaves
        self.leaves += 1
        return node

    def _means(self, own: np.ndarray, k: int) -> np.ndarray:
        centres = own[self.rng.choice(len(own), k, replace=False)].copy()
        for _ in range(ROUNDS):
            mine = np.argmax(own @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)
            n = np.bincount(mine, minlength=k)
            sums = np.zeros_like(centres)
            np.add.at(sums, mine, own)
            centres[n > 0] = sums[n > 0] / n[n > 0, None]
        return mine

    def leaf_of(self, v: np.ndarray) -> np.ndarray:
        """The leaf that each vector falls to: at every node the nearest child."""
        out = np.zeros(len(v), np.int64)
        todo = [(0, np.arange(len(v)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            c = self.centre[self.children[node]]
            nearest = np.argmax(v[rows] @ c.T - (c**2).sum(axis=1) / 2, axis=1)
            todo += [(child, rows[nearest == k]) for k, child in enumerate(self.children[node]) if (nearest == k).any()]
        return out

    def walk(self, q: np.ndarray, visits: int) -> list[int]:
        """The first leaves of a best-bin-first traversal."""
        norm = float(np.sqrt(q @ q))
        promise = (self.centre @ q + norm * self.reach).tolist()
        queue, found = [(-promise[0], 0)], []
        while queue and len(found) < visits:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                found.append(self.leaf[node])
            for child in self.children[node]:
                heapq.heappush(queue, (-promise[child], child))
        return found


def vectors(table: DataFrame) -> DataFrame:
    """vec_id and v (array of doubles) of the rows that take part, without repeats."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull())
    rows = rows.where(F.coalesce(fine & some, F.lit(False)))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("v") == (length["d"] if length else 0))
    return rows.withColumn("h", F.xxhash64("v"))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """gid (smallest vec_id), h, v, ids (the k + 1 smallest vec_ids) of each different vector."""
    place = F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))
    first = rows.dropDuplicates(["vec_id", "h", "v"]).withColumn("place", place).where(F.col("place") <= k + 1)
    return first.groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("gid"), "h", "v", "ids")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest scores of each row, largest first, ties to the smaller id; `ids` ascend."""
    n = scores.shape[1]
    if n > k:
        floor = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        scores = np.where(scores >= floor, scores, -np.inf)
    return np.argsort(-scores, axis=1, kind="stable")[:, : min(k, n)]


def calibrated_visits(items: DataFrame, asked: DataFrame, tree: Tree, k: int) -> int:
    """Leaf visits that reach RECALL on a bounded sample of queries, measured against brute force over all vectors."""
    n = asked.count()
    picked = asked.where(sampled(F.xxhash64(F.lit(7), "gid"), share_of(n, CALIBRATE))).select("gid", "v").orderBy("gid").limit(2 * CALIBRATE).collect()
    if not picked or tree.leaves == 1:
        return tree.leaves
    q, own = np.array([r["v"] for r in picked]), np.array([r["gid"] for r in picked])

    def brute(batches):
        for b in batches:
            order = np.argsort(b.column(0).to_numpy())
            ids, v = b.column(0).to_numpy()[order], matrix(b.column(1))[order]
            leaf = tree.leaf_of(v)
            s = q @ v.T
            s[own[:, None] == ids[None, :]] = -np.inf
            at = best(s, ids, k)
            row = np.repeat(np.arange(len(q)), at.shape[1])
            at = at.ravel()
            kept = np.isfinite(s[row, at])
            yield pa.RecordBatch.from_arrays([pa.array(row[kept]), pa.array(ids[at][kept]), pa.array(leaf[at][kept]), pa.array(s[row, at][kept])], names=["q", "gid", "leaf", "score"])

    near = items.select("gid", "v").mapInArrow(brute, "q long, gid long, leaf long, score double")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "gid"))
    true = near.withColumn("place", place).where(F.col("place") <= k).select("q", "leaf").collect()  # k rows for each query of the sample
    if not true:
        return tree.leaves
    turn = np.full((len(q), tree.leaves), tree.leaves)
    for i, x in enumerate(q):
        walked = tree.walk(x, tree.leaves)
        turn[i, walked] = np.arange(len(walked))
    need = np.sort([turn[r["q"], r["leaf"]] for r in true])
    return min(tree.leaves, int(need[int(np.ceil(RECALL * len(need))) - 1]) + 1)


def shards_of(counts: dict[int, int], leaves: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(first shard, shards) of each leaf: leaves in order share a shard up to `rows` vectors, a larger one has several."""
    first, parts = np.zeros(leaves, np.int64), np.ones(leaves, np.int64)
    shard, held = 0, 0
    for leaf in range(leaves):
        n = counts.get(leaf, 0)
        if n > rows:
            shard += held > 0
            parts[leaf] = -(-n // rows)
            first[leaf] = shard
            shard, held = shard + parts[leaf], 0
            continue
        if held + n > rows:
            shard, held = shard + 1, 0
        first[leaf] = shard
        held += n
    return first, parts


def search_shard(queries: pa.Table, items: pa.Table, k: int) -> pa.Table:
    """The k best vectors of a shard for each of its queries, over the leaves that the query visits."""
    kinds = pa.schema([("gid", pa.int64()), ("near", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])
    if not len(queries) or not len(items):
        return kinds.empty_table()
    order = np.lexsort((items["gid"].to_numpy(), items["leaf"].to_numpy()))
    leaf, ids = items["leaf"].to_numpy()[order], items["gid"].to_numpy()[order]
    v = matrix(items["v"].combine_chunks())[order]
    q = matrix(queries["v"].combine_chunks())
    lists = queries["leaves"].combine_chunks()
    of_query = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())
    visited = lists.flatten().to_numpy()
    by_leaf = np.argsort(visited, kind="stable")
    top_s, top_i = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
    for x in np.unique(leaf):
        lo, hi = np.searchsorted(leaf, x), np.searchsorted(leaf, x, "right")
        rows = of_query[by_leaf[np.searchsorted(visited[by_leaf], x) : np.searchsorted(visited[by_leaf], x, "right")]]
        for a in range(0, len(rows), 512):
            own = rows[a : a + 512]
            for c in range(lo, hi, 8192):
                d = min(hi, c + 8192)
                s = q[own] @ v[c:d].T
                at = best(s, ids[c:d], k)
                near = (q[own][:, None, :] * v[c:d][at]).sum(axis=2)
                both_s = np.concatenate([top_s[own], near], axis=1)
                both_i = np.concatenate([top_i[own], ids[c:d][at]], axis=1)
                pick = np.lexsort((both_i, -both_s), axis=1)[:, :k]
                top_s[own], top_i[own] = np.take_along_axis(both_s, pick, 1), np.take_along_axis(both_i, pick, 1)
    found = np.isfinite(top_s)
    ends = pa.array(np.concatenate([[0], np.cumsum(found.sum(axis=1))]), pa.int32())
    return pa.Table.from_arrays(
        [queries["gid"].combine_chunks(), pa.ListArray.from_arrays(ends, pa.array(top_i[found])), pa.ListArray.from_arrays(ends, pa.array(top_s[found]))], schema=kinds
    )


def search(table: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for every row whose vec_id is divisible by `every`."""
    spark = table.sparkSession
    rows = stage(vectors(table), "search-vectors")
    items = stage(distinct_vectors(rows, k), "search-items")
    same = F.expr("r.h = i.h AND r.v = i.v")
    asking = rows.where(F.col("vec_id") % every == 0).alias("r").join(items.alias("i"), same).select(F.col("r.vec_id").alias("query_id"), F.col("i.gid").alias("gid")).distinct()
    asking = stage(asking, "search-asking")
    asked = stage(items.join(asking.select("gid").distinct(), "gid", "left_semi").select("gid", "v"), "search-asked")
    n, n_asked = items.count(), asked.count()
    if not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    most = min(SAMPLE, max(1, SAMPLE_BYTES // (8 * len(items.select("v").first()[0]))))
    picked = items.where(sampled(F.xxhash64(F.lit(1), "gid"), share_of(n, most))).select("gid", "v").limit(2 * most)
    batches = picked.toArrow().sort_by("gid")
    sample = matrix(batches["v"].combine_chunks()) if len(batches) else matrix(items.limit(1).toArrow()["v"].combine_chunks())
    leaves = min(MOST_LEAVES, max(1, n // LEAF))
    tree = Tree(sample, len(sample) / leaves)
    visits = calibrated_visits(items, asked, tree, k + 1)

    def leaf_counts(batches):
        for b in batches:
            leaf, count = np.unique(tree.leaf_of(matrix(b.column(0))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(count)], names=["leaf", "n"])

    counted = items.select("v").mapInArrow(leaf_counts, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n"))
    counts = {r["leaf"]: r["n"] for r in counted.collect()}  # at most one row for each leaf
    tasks = 2 * spark.sparkContext.defaultParallelism
    first, parts = shards_of(counts, tree.leaves, int(min(SHARD_ROWS, max(1, -(-n // tasks)))))

    def place_queries(batches):
        for b in batches:
            v = matrix(b.column(1))
            row, shards, lists = [], [], []
            for i, x in enumerate(v):
                to: dict[int, list[int]] = {}
                for leaf in tree.walk(x, visits):
                    for s in range(int(first[leaf]), int(first[leaf] + parts[leaf])):
                        to.setdefault(s, []).append(leaf)
                row += [i] * len(to)
                shards += to.keys()
                lists += to.values()
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(shards, pa.int64()), b.column(0).take(at), b.column(1).take(at), pa.array(lists, pa.list_(pa.int64()))],
                names=["shard", "gid", "v", "leaves"],
            )

    placed = asked.repartition(tasks, "gid").mapInArrow(place_queries, "shard long, gid long, v array<double>, leaves array<long>")
    placed = stage(placed, "search-placed")
    full = placed.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > QUERY_BLOCK).collect()  # one row for each crowded shard
    blocks = np.ones(int((first + parts).max()), np.int64)
    for r in full:
        blocks[r["shard"]] = -(-r["n"] // QUERY_BLOCK)

    def place_items(batches):
        """A vector goes to its shard, once for each block of queries there: one unless more than QUERY_BLOCK visit it."""
        for b in batches:
            gid, v = b.column(0).to_numpy(), matrix(b.column(1))
            leaf = tree.leaf_of(v)
            shard = first[leaf] + gid % parts[leaf]
            again = np.repeat(np.arange(len(gid)), blocks[shard])
            block = ragged(np.zeros(len(gid), np.int64), blocks[shard])
            yield pa.RecordBatch.from_arrays([pa.array(shard[again]), pa.array(block), *(c.take(pa.array(again)) for c in (b.column(0), b.column(1))), pa.array(leaf[again])], names=["shard", "block", "gid", "v", "leaf"])

    def deal_queries(batches):
        for b in batches:
            shard, gid = b.column(0).to_numpy(), b.column(1).to_numpy()
            mixed = (gid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(mixed.astype(np.int64) % blocks[shard]), *b.columns[1:]], names=["shard", "block", "gid", "v", "leaves"])

    right = items.select("gid", "v").mapInArrow(place_items, "shard long, block long, gid long, v array<double>, leaf long")
    left = placed.mapInArrow(deal_queries, "shard long, block long, gid long, v array<double>, leaves array<long>")
    pairs = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block"))
    near = pairs.applyInArrow(lambda q, i: search_shard(q, i, k + 1), "gid long, near array<long>, scores array<double>")
    each = near.select("gid", F.explode(F.arrays_zip("near", "scores")).alias("x")).select("gid", F.col("x.near").alias("near"), F.col("x.scores").alias("score"))
    order = Window.partitionBy("gid").orderBy(F.desc("score"), "near")
    groups = each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).drop("place")
    ids = items.select(F.col("gid").alias("near"), "ids")
    listed = groups.join(ids, "near").select("gid", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("gid").orderBy(F.desc("score"), "vec_id")
    listed = stage(listed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1), "search-listed")
    answers = asking.join(listed, "gid").where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
