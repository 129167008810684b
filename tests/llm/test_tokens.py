import zlib
from collections import Counter
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from arcseq.llm import files, packing, repair_files
from arcseq.llm.word_ids import encoder, vocabulary


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(vocabulary())


def ids_of(plain, text, end):
    return [*plain.encode(text or "", add_special_tokens=False).ids, end]


ODD = [
    "", None, "  ", "a<|endoftext|>b <|startoftext|>", "don't I'LL 'S x's", "é ́x Å", "x y z \x1c q\x85r", "日本語 テスト１２ 3.14",
    "İstanbul ΣΑΣ ΟΔΥΣΣΕΥΣ", "\tlead\r\n\x0btrail \x0c", "😀👍🏽 a😀b", "Straße ÀÉÎ×÷ —“quoted”…", "x" * 70_000, "ab" * 30_000 + " c",
]


def test_word_cache_equals_the_library(plain):
    enc = encoder(vocabulary())
    for _ in range(2):
        got = list(enc.encode(pa.array(ODD), 1))
        ids, lengths = (np.concatenate(x) for x in zip(*got, strict=True))
        ends = np.cumsum(lengths)
        assert [ids[e - n : e].tolist() for e, n in zip(ends, lengths, strict=True)] == [ids_of(plain, t, 1) for t in ODD]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_any_text_encodes_as_a_whole(texts):
    plain = Tokenizer.from_file(vocabulary())
    got = list(encoder(vocabulary()).encode(pa.array(texts, pa.string()), 1))
    ids = np.concatenate([x[0] for x in got]).tolist() if got else []
    assert ids == [i for t in texts for i in ids_of(plain, t, 1)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(2, 6), max_size=60), min_size=1, max_size=6))
def test_grammar_round_trip(docs):
    lengths = np.array([len(d) + 1 for d in docs])
    ids = np.array([i for d in docs for i in [*d, 1]], np.uint16)
    rules, symbols, per_doc = repair_files.compress(ids, lengths, least=2)
    shard = repair_files.Shard.__new__(repair_files.Shard)
    shard.terminals, shard.rules = repair_files.TERMINALS, rules
    shard.sizes = np.concatenate([np.ones(repair_files.TERMINALS, np.int64), repair_files.expansion_sizes(rules, repair_files.TERMINALS)])
    shard._spell()
    assert shard.expand(symbols).tolist() == ids.tolist() and len(symbols) <= len(ids)
    assert shard.sizes[symbols].sum() == len(ids) and per_doc.sum() == len(symbols)


def test_files_decode_by_document(odd_docs, spark, plain, monkeypatch):
    folder = files.shared_folder(spark, "test-shards")
    manifest = repair_files.write_shards(odd_docs, folder, vocabulary(), shard_tokens=3000).collect()
    assert len(manifest) > 3
    seen = Counter()
    for m in manifest:
        shard = repair_files.Shard(files.get(m["file"]))
        whole = shard.all().tolist()
        assert shard.tokens == m["tokens"] == len(whole)
        parts = [shard.document(k).tolist() for k in range(shard.docs)]
        assert sum(parts, []) == whole
        seen.update((d, zlib.crc32(np.array(p, "<u4").tobytes())) for d, p in zip(m["doc_ids"], parts, strict=True))
    rows = odd_docs.select("doc_id", "text").collect()
    assert seen == Counter((r[0], zlib.crc32(np.array(ids_of(plain, r[1], 1), "<u4").tobytes())) for r in rows)


def test_starts_follow_doc_id_order(odd_docs, plain):
    got = repair_files.write_and_read(odd_docs).collect()
    order = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in order] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in order])[:-1]]).tolist()
    ids = [r["doc_id"] for r in order if r["doc_id"] is not None]
    assert ids == sorted(ids) and len(got) == odd_docs.count()


def test_packing_of_odd_rows(odd_docs, plain):
    got = packing.pack(odd_docs).toPandas()
    want = Counter()
    for r in odd_docs.select("doc_id", "text").collect():
        ids = ids_of(plain, r[1], 0)
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[(r[0], k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = [tuple(None if x != x else int(x) for x in r) for r in got[cols].itertuples(index=False)]
    assert Counter(rows) == want
    total = got["length"].sum()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["length"].sum() <= 2048 and (g["offset"] == g["length"].cumsum() - g["length"]).all()
    assert got["sequence_id"].nunique() <= -(-total // 2048) + 1


def fill(counts, room=2048):
    runs = packing.plan(counts, room)
    bins: dict = {}
    seen = Counter()
    by_length: dict = {}
    for length, first, seq, offset in runs:
        by_length.setdefault(length, []).append((first, seq, offset))
    for length, own in by_length.items():
        own.sort()
        for k, (first, seq, offset) in enumerate(own):
            last = own[k + 1][0] if k + 1 < len(own) else counts[length]
            for r in range(first, last):
                bins.setdefault(seq + r - first, []).append((offset, length))
                seen[length] += 1
    assert seen == Counter({k: v for k, v in counts.items() if v})
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= room
    return len(bins)


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(0, 30), max_size=12))
def test_plan_places_every_piece_once(counts):
    bins = fill(counts, 60)
    assert bins >= -(-sum(k * n for k, n in counts.items()) // 60)


def test_plan_fills_exact_complements():
    assert fill({1000: 5, 1048: 5}) == 5
    assert fill({2000: 7, 30: 7, 18: 7}) == 7
    assert fill({2000: 4, 20: 4, 16: 4, 12: 4}) == 4


def test_every_candidate_of_a_gap_is_tried():
    # single pieces of many lengths; the pairs and triples of the first gaps use up most of what later gaps would take first
    shelf = packing.Shelf({k: 1 for k in range(1, 41)} | {60: 1}, 100)
    spare = shelf.spare(list(range(20, 40)))  # all of the long ones are held: 40 + 0 is no pair, so the gap needs three
    assert shelf.pair(40, spare) is None
    assert sorted(shelf.exact(57, list(range(20, 40)))) == [17, 40] and sum(shelf.exact(40, list(range(19, 41)))) == 40
    assert packing.Shelf({5: 2}, 20).exact(15, []) is None and packing.Shelf({5: 3}, 20).exact(15, []) == [5, 5, 5]
    for gap in range(3, 60):  # found exactly where a search over all triples finds one
        counts = {k: 1 + k % 2 for k in (3, 7, 8, 15, 21)}
        some = packing.Shelf(counts, 60).exact(gap, [])
        ways = [w for n in (1, 2, 3) for w in combinations_with_replacement(counts, n) if sum(w) == gap and all(w.count(k) <= counts[k] for k in w)]
        assert (some is not None) == bool(ways) and (some is None or tuple(sorted(some)) in ways)


def test_empty_tables(no_docs):
    assert repair_files.write_and_read(no_docs).count() == 0 and packing.pack(no_docs).count() == 0
