import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arcseq.llm import importance_sort

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def buckets(text):
    words = WORD.findall((text or "").translate(SMALL))
    return len(words), [zlib.crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]]


def plain(docs, target, percent=25):
    own, s, t = [(i, *buckets(x)) for i, x in docs], Counter(), Counter()
    for _, _, b in own:
        s.update(b)
    for x in target:
        t.update(buckets(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (total_s + 10_000) / ((s[k] + 1) * (total_t + 10_000)))) for k in range(10_000)]
    rows = []
    for i, n, b in own:
        w = sum(gain[k] for k in b) // len(b) if b else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(b), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    enough = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = [*range(1, percent * len(enough) // 100 + 1)]
    ranks += [None] * (len(enough) - len(ranks))
    return Counter([(*r[:4], k) for r, k in zip(enough, ranks, strict=True)] + [(*r[:4], None) for r in rows if r[4] < 20])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=40), st.binary(max_size=300)), min_size=1, max_size=20))
def test_joined_crc(pairs):
    a, b = (np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1))
    got = importance_sort.joined_crc(a, b, np.array([len(p[1]) for p in pairs]))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in pairs]


def test_equals_brute_force_on_odd_rows(spark, odd_docs):
    target = spark.createDataFrame([(1, "The hens were MISSING after all"), (2, None), (3, "")], "item_id long, text string")
    docs = odd_docs.repartition(7)
    for percent in (25, 100):
        got = Counter(map(tuple, importance_sort.resample(docs, target, percent).collect()))
        want = plain([tuple(r) for r in docs.select("doc_id", "text").collect()], ["The hens were MISSING after all"], percent)
        assert got == want
    assert importance_sort.resample(docs, target).columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_empty_tables(spark, odd_docs, no_docs):
    assert importance_sort.resample(no_docs, no_docs).collect() == []
    assert importance_sort.resample(odd_docs, no_docs).count() == odd_docs.count()
    short = spark.createDataFrame([(1, "few words"), (2, None)], "doc_id long, text string")
    assert [r["rank"] for r in importance_sort.resample(short, short).collect()] == [None, None]


@pytest.mark.parametrize(("bits", "block"), [(3, 8), (9, 64), (4, 1000)])
def test_radix_sort_is_stable_and_exact(spark, bits, block):
    rng = random.Random(bits)
    wide = [(rng.choice([-5, 0, 3, -(1 << 63), (1 << 63) - 1, None, *range(30)]), k, 0, rng.choice([7, 7, 7, rng.randrange(-900, 900)])) for k in range(500)]
    narrow = [(None if d is None else d % 1000, n, w, s) for d, n, w, s in wide]
    for rows in (wide, narrow) if bits == 9 else (narrow,):
        df = spark.createDataFrame([(*r, 0, k) for k, r in enumerate(rows)], "doc_id long, n_features long, weight long, score long, part long, k long")
        placed, n = importance_sort.ranked(df, bits, block)
        got = [tuple(r)[:4] for r in placed.orderBy("at").collect()]
        assert n == 500 and got == sorted(rows, key=lambda r: (-r[3], r[0] is None, r[0] or 0))
        assert [r["at"] for r in placed.select("at").orderBy("at").collect()] == list(range(500))


def test_prefix_sums(spark):
    rows = [(g, o, (g * 7 + o) % 5) for g in range(4) for o in range(6)]
    got = {(r["g"], r["o"]): r["first"] for r in importance_sort.prefix(spark.createDataFrame(rows, "g int, o int, n long"), "g", "o").collect()}
    total = 0
    for g, o, n in rows:
        assert got[g, o] == total
        total += n


def test_a_hot_digit_is_split_by_blocks(spark):
    rows = spark.range(4000).select(F.col("id").alias("at"), (F.col("id") % 3).alias("v"))
    sizes = rows.groupBy(F.floor(F.col("at") / 256)).count().agg(F.max("count")).first()[0]
    out = importance_sort.counting_pass(rows, F.lit(0), 512, 256)
    assert sizes == 256 and out.where(F.col("at") % 3 != F.col("v")).count() == 0 and out.count() == 4000
