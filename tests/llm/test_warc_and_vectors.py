import math

import numpy as np
import pytest

from arcseq.llm import files, vector_search, warc_salvage as ws


def archive(n=6, gz=True):
    records = [ws.record(i, f"http://example.org/{i}", b"page %d " % i * 40) for i in range(n)]
    return [ws.member(r) for r in records] if gz else records


def read(raw):
    s = ws.Salvage(bytes(raw))
    return [int(r.head["page-id"]) for r in s], [(g.start, g.end) for g in s.gaps]


@pytest.mark.parametrize("gz", [True, False])
def test_damaged_record_is_quarantined_and_later_ones_recovered(gz):
    parts = archive(gz=gz)
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).tolist()
    whole = b"".join(parts)
    assert read(whole) == (list(range(6)), [])
    for at in (starts[2] + len(parts[2]) // 2, starts[2] + 1, starts[3] - 8):
        raw = bytearray(whole)
        raw[at] ^= 0xFF
        assert read(raw) == ([0, 1, 3, 4, 5], [(starts[2], starts[3])])
    cut = whole[: starts[2] + 60] + whole[starts[3] :]
    assert read(cut) == ([0, 1, 3, 4, 5], [(starts[2], starts[2] + 60)])
    assert read(whole[:-5])[0] == [0, 1, 2, 3, 4]
    assert read(b"noise" + whole) == (list(range(6)), [(0, 5)])
    assert read(b"") == ([], []) and read(b"noise") == ([], [(0, 5)])


def test_every_single_byte_change_costs_one_record():
    parts = archive(3)
    whole = b"".join(parts)
    for at in range(len(parts[0]), len(parts[0]) + len(parts[1])):
        raw = bytearray(whole)
        raw[at] ^= 0x55
        found, gaps = read(raw)
        assert {0, 2} <= set(found) and (len(gaps) == 1 or 1 in found)


def test_false_starts_inside_a_gap_are_passed_over():
    parts = archive(3)
    raw = parts[0] + b"xx" + ws.GZIP + b"no member" + ws.VERSION + b"1\r\nno: record\r\n\r\n" + parts[1]
    found, gaps = read(raw)
    assert found == [0, 1] and gaps == [(len(parts[0]), len(raw) - len(parts[1]))]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (9, "http://a/9", "<p>one</p>"), (3, None, None), (4, "http://a/4", "")]
    rows += [(5, "http://a/\r\n5", "é" * 50_000), (6, "http://a/6", "<p>\r\n\r\nWARC/1.1\r\n</p>"), (9, "http://a/9", "<p>one</p>"), (None, None, "<i>x</i>"), (None, None, "<i>x</i>")]
    rows += [(20 + i, f"http://b/{i}", "many copies") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.selectExpr("*", "'clash' AS sha", "'clash' AS first", "'clash' AS file")


def test_round_trip(pages):
    got = ws.round_trip(pages).collect()
    rows = pages.collect()
    assert len(got) == len(rows)
    largest: dict = {}
    for r in rows:
        k = r["html"] or ""
        largest[k] = max(largest.get(k, -1), -1 if r["page_id"] is None else r["page_id"])

    def want(r):
        raw = (r["html"] or "").encode()
        top = largest[r["html"] or ""]
        again = top >= 0 and r["page_id"] != top
        return (str(r["page_id"]), len(raw), ws.digest(raw), "revisit" if again else "response", str(top if again else None))

    assert sorted((str(r[0]), r[1], r[2], r[3], str(r[4])) for r in got) == sorted(want(r) for r in rows)


def test_gaps_of_archives_are_listed(spark, pages):
    folder = files.shared_folder(spark, "test-warc")
    manifest = ws.write_archives(ws.marked(pages), folder, archive_bytes=4000).cache()
    names = [r["file"] for r in manifest.collect()]
    raw = bytearray(files.get(names[0]))
    raw[20] ^= 0xFF
    files.put(names[0], [bytes(raw)])
    records, gaps = ws.read_archives(manifest)
    assert gaps.count() == 1 and records.count() == pages.count() - 1


def test_no_pages(spark):
    assert ws.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def neighbours(rows, k, every):
    fine = [(i, v) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    fine = list({(i, tuple(v)) for i, v in fine})
    out = {}
    for i, v in fine:
        if i % every == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in fine if j != i)
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def test_search_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-3, 4, 8).astype(float).tolist()) for i in range(400)]
    rows += [(1000 + i, [1.0, 2.0, 0.0, 1.0, 0.0, 0.0, -1.0, 3.0]) for i in range(120)]  # many copies
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [1.0, None, *[0.0] * 6]), (2060, [float("nan"), *[1.0] * 7]), (2080, [float("inf"), *[1.0] * 7])]
    rows += [(2100, [1.0] * 3), (None, [1.0] * 8), (20, rows[20][1]), (2120, []), (2140, [1e3] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'clash' AS gid", "'clash' AS h", "'clash' AS v")
    got: dict = {}
    for r in sorted(vector_search.search(df, k=10, every=20).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = neighbours(rows, 10, 20)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hits = [len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / 10 for q in want]
    assert np.mean(hits) >= 0.9
    for q in want:
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))


def test_search_with_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert vector_search.search(spark.createDataFrame([], schema)).count() == 0
    assert vector_search.search(spark.createDataFrame([(20, [1.0, 2.0])], schema)).count() == 0
    got = vector_search.search(spark.createDataFrame([(20, [1.0, 2.0]), (21, [1.0, 0.0]), (40, [0.0, 1.0])], schema)).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == {(20, 1, 40, 2.0), (20, 2, 21, 1.0), (40, 1, 20, 2.0), (40, 2, 21, 0.0)}


def test_leaves_share_shards_and_large_ones_are_dealt_out():
    first, parts = vector_search.shards_of({0: 5, 1: 4, 2: 30, 3: 2, 4: 9}, 5, 10)
    assert first.tolist() == [0, 0, 1, 4, 5] and parts.tolist() == [1, 1, 3, 1, 1]


def gaps_of(raw):
    s = ws.Salvage(bytes(raw))
    return [int(r.head["page-id"]) for r in s], s.gaps


def test_records_around_a_damaged_one_in_the_same_member():
    parts = archive(5, gz=False)
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).tolist()
    inside = bytearray(b"".join(parts))
    inside[starts[3] - 20] ^= 0xFF
    before, after = ws.member(ws.record(90, None, b"before")), ws.member(ws.record(91, None, b"after"))
    found, gaps = gaps_of(before + ws.member(bytes(inside)) + after)
    assert found == [90, 0, 1, 3, 4, 91]
    assert [(g.start, g.end, g.member) for g in gaps] == [(starts[2], starts[3], len(before))]


@pytest.mark.parametrize("level", [0, 6])
def test_records_before_the_place_where_a_member_breaks(level):
    rng = np.random.default_rng(3)
    parts = [ws.record(i, None, rng.bytes(3000)) for i in range(5)]
    whole, after = ws.member(b"".join(parts), level), ws.member(ws.record(91, None, b"after"))
    cut = whole[: int(len(whole) * 0.7)]
    found, gaps = gaps_of(cut)
    assert found == [0, 1, 2] and len(gaps) == 1 and gaps[0].member is None
    assert 3 * 2900 < gaps[0].start < gaps[0].end == len(cut)
    found, gaps = gaps_of(cut + after)
    assert found == [0, 1, 2, 91] and [g.end for g in gaps] == [len(cut)]
    # a bad checksum of the member: all but its last record, once each, also where the bytes are stored as they are
    bad = bytearray(whole)
    bad[-8] ^= 0xFF
    found, gaps = gaps_of(bytes(bad) + after)
    assert found[:4] == [0, 1, 2, 3] and found[-1] == 91 and len(found) == len(set(found))
    assert gaps_of(ws.member(b"".join(parts), level) + after) == ([0, 1, 2, 3, 4, 91], [])


def test_any_byte_of_a_member_of_five_costs_no_earlier_record():
    rng = np.random.default_rng(4)
    parts = [ws.record(i, None, rng.bytes(150)) for i in range(5)]
    whole, after = ws.member(b"".join(parts)), ws.member(ws.record(91, None, b"after"))
    for at in range(0, len(whole), 7):
        raw = bytearray(whole + after)
        raw[at] ^= 0x41
        found, gaps = gaps_of(raw)
        assert 91 in found and found == sorted(set(found))
        assert gaps or found == [0, 1, 2, 3, 4, 91]


def test_a_shortfall_raises(spark, pages, monkeypatch):
    put = files.put

    def damaged(name, parts):
        raw = bytearray(b"".join(parts))
        raw[len(raw) // 2] ^= 0xFF
        put(name, [bytes(raw)])

    folder = files.shared_folder(spark, "warc")
    manifest = ws.write_archives(ws.marked(pages), folder).collect()
    damaged(manifest[0]["file"], [files.get(manifest[0]["file"])])
    table = spark.createDataFrame(manifest)
    short = ws.lost(table, *ws.read_archives(table)).collect()
    assert [r["file"] for r in short] == [manifest[0]["file"]] and short[0]["gaps"] >= 1
    monkeypatch.setattr(ws, "lost", lambda *a: spark.createDataFrame([("f", 2, 1, 1)], "file string, written long, read long, gaps long"))
    with pytest.raises(RuntimeError, match="give back"):
        ws.round_trip(pages)
