import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from arcseq.llm import simhash_dedup as sd

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="aAbÉß \t\n", max_size=40))
def test_fingerprint_of_any_text(text):
    assert sd.fingerprint(text.encode()) & (2**64 - 1) == plain_fingerprint(text)


def brute(rows):
    """rows of (doc_id, fingerprint) -> smallest doc_id reachable by links of at most 3 bits, by row."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= 3:
                parent[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(rows))]


def test_odd_documents_match_brute_force(odd_docs):
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in odd_docs.collect()]
    want = Counter((d, f"{f:016x}", c) for (d, f), c in zip(rows, brute(rows), strict=True))
    assert Counter(tuple(r) for r in sd.near_duplicates(odd_docs).collect()) == want


def table_of(spark, fps):
    return spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)], "doc_id long, fp long")


@pytest.mark.parametrize("leaf,block", [(1024, 8192), (8, 8192), (8, 4), (1 << 30, 16)])
def test_components_do_not_depend_on_the_trees(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(sd, "LEAF", leaf)
    monkeypatch.setattr(sd, "BLOCK", block)
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**64, 150, dtype=np.uint64).tolist()
    for start in fps[:12]:  # chains of links, and dense clusters
        x = start
        for _ in range(15):
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(b)
            fps.append(x)
    fps += [fps[0] ^ (1 << b) for b in range(40)]
    want = brute(list(enumerate(fps)))
    df = table_of(spark, fps)
    got = {r["doc_id"]: r["component_id"] for r in df.join(sd.components(df), "fp").collect()}
    assert [got[i] for i in range(len(fps))] == want


def test_long_chain_of_links(spark):
    edges = spark.range(301).selectExpr("id * 8 % 301 AS a").selectExpr("a AS u", "a + 1 AS v")
    assert {(r["u"], r["v"]) for r in sd.stars(edges).collect()} == {(k, 0) for k in range(1, 302)}


def test_keep_one_of_each_component(odd_docs):
    found = sd.near_duplicates(odd_docs).collect()
    kept = sd.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids == Counter({r["component_id"] for r in found})


def test_empty_table(no_docs):
    assert sd.near_duplicates(no_docs).count() == 0 and sd.keep_one(no_docs).count() == 0
