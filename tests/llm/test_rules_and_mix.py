import re
from collections import Counter

import duckdb

import pytest

from arcseq.llm import mixing, quality_rules
from arcseq.llm.common import text_of  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    counts = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
    return (*counts, len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_base_counts_match_plain_python(odd_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    want = Counter((r[0], *base(r[1])) for r in rows)
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert Counter(tuple(r) for r in quality_rules.quality_rules(odd_docs).select(*cols).collect()) == want


def test_repeated_windows_overlap(spark):
    texts = ["a a a a", "a b c a b c", "a b a b a b", "a b c d", "", "a b", "x y z q x y z x y z"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.quality_rules(df).collect()}
    assert got == {i: base(t)[4] for i, t in enumerate(texts)}


def letters(k):
    return "".join(chr(97 + int(d)) for d in str(k))


def long_line(k):
    return " ".join(f"word{letters(k)}x{letters(i)}" for i in range(40))


def test_boilerplate_is_removed_and_depleted_documents_go(spark):
    banner = " ".join(f"cookie{letters(i)}" for i in range(60))
    rows = [(i, f"{banner}\n{long_line(i)}\n{long_line(i + 1000)}\n{long_line(i + 2000)}", "h") for i in range(30)]
    rows += [(100 + i, f"{banner}\nword{letters(i)} tail", "h") for i in range(5)]  # little besides the banner
    rows += [(200 + i, f"{banner}\nword{letters(i)} tail", "other") for i in range(5)]  # too few on their host
    rows += [(300 + i, f"{long_line(7)}\n{long_line(8)}", "h") for i in range(40)]  # copies of one document
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(df).collect()}
    assert all(got[i]["kept"] for i in range(30)) and all(got[i]["removed_chars"] == len(banner) for i in range(30))
    assert not any(got[100 + i]["kept"] for i in range(5)) and all(got[100 + i]["depleted"] for i in range(5))
    assert all(got[200 + i]["kept"] for i in range(5)) and all(got[300 + i]["kept"] for i in range(40))
    cleaned = {r["doc_id"]: r["text"] for r in quality_rules.remove_lines(df).collect()}
    assert cleaned[3] == f"{long_line(3)}\n{long_line(1003)}\n{long_line(2003)}" and cleaned[200].startswith("cookiea")


def test_lines_of_a_template_are_counted_in_every_document(spark):
    template = [long_line(5000 + k) for k in range(20)]
    rows = [(i, "\n".join([*template, long_line(i), long_line(i + 2000)]), "h") for i in range(60)]
    rows += [(100 + i, "\n".join(long_line(i + 4000 + 200 * k) for k in range(3)), "h") for i in range(140)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(df).collect()}
    chars = sum(map(len, template))
    assert all(got[i]["removed_chars"] == chars and not got[i]["kept"] for i in range(60))
    assert all(got[100 + i]["removed_chars"] == 0 and got[100 + i]["kept"] for i in range(140))


def test_documents_of_template_lines_only(spark):
    template = [long_line(5000 + k) for k in range(20)]
    rows = [(i, "\n".join(template[:i] + template[i + 1 :]), "h") for i in range(20)]  # each without one of the lines
    rows += [(100 + i, "\n".join(long_line(i + 4000 + 200 * k) for k in range(3)), "h") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(df).collect()}
    assert all(got[i]["removed_chars"] == got[i]["line_chars"] > 0 and not got[i]["kept"] for i in range(20))
    assert all(got[100 + i]["kept"] for i in range(80))


def test_the_limit_stops_growing_with_the_host(spark):
    banner = "a line that many documents of a large host hold"
    rows = [(i, f"{banner}\n{long_line(i)}" if i < 1001 else long_line(i), "h") for i in range(24_000)]
    rows += [(30_000 + i, f"{banner}\n{long_line(i)}" if i < 1000 else long_line(i), "other") for i in range(24_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["removed_chars"] for r in quality_rules.quality_rules(df).select("doc_id", "removed_chars").collect()}
    assert len(got) == 48_000 and all(n == (len(banner) if i < 1001 else 0) for i, n in got.items())


def test_sql_states_the_same_rule(spark):
    """Templates of many lines, documents of template lines only, copies, and a line that only MAX_DOCS rules out."""
    template = [long_line(5000 + k) for k in range(20)]
    rows = [(i, "\n".join([*template, long_line(i), long_line(i + 2000)]), "h") for i in range(60)]
    rows += [(100 + i, "\n".join(template[:i] + template[i + 1 :]), "h") for i in range(20)]
    rows += [(200 + i, "\n".join(long_line(i + 4000 + 200 * k) for k in range(3)), "h") for i in range(140)]
    rows += [(400 + i, "\n".join(long_line(9000 + k) for k in range(3)), "h") for i in range(30)] + [(450, None, "h"), (451, "", None), (None, long_line(1), None)]
    banner = "a line that many documents of a large host hold"
    rows += [(1000 + i, f"{banner}\n{long_line(i)}" if i < 1001 else long_line(i), "large") for i in range(24_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = quality_rules.quality_rules(df)
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({quality_rules.ORACLE})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want) and any(r["removed_chars"] == len(banner) for r in got.collect())


def test_keep_documents_returns_the_rows_as_they_were(odd_docs):
    verdict = Counter((r["doc_id"], r["n_words"]) for r in quality_rules.quality_rules(odd_docs).where("kept").collect())
    kept = quality_rules.keep_documents(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter((r["doc_id"], len(WORD.findall(r["text"]))) for r in kept.collect()) == verdict


def targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; what exceeds a cap is shared again until nothing does."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        rest, weight = total - sum(fixed.values()), sum(w[s] for s in free)
        over = [s for s in free if rest * w[s] / weight > most * sizes[s]]
        if not over:
            return fixed | {s: rest * w[s] / weight for s in free}
        fixed |= {s: float(most * sizes[s]) for s in over}


def test_targets_stop_at_three_times_the_source(spark):
    sizes = {"a": 10, "b": 900, "c": 40, "d": 3, "e": 500, None: 70}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "s string, source_size long").selectExpr("coalesce('s' || s, 'n') AS skey", "source_size")
    got = {r["skey"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx({("n" if s is None else f"s{s}"): t for s, t in targets(sizes).items()})


def test_mix_takes_near_its_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + (i * 7919) % 90)), f"s{i % 5}" if i % 11 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = mixing.mix(df).collect()
    assert len(got) == 4000 and all(r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"] for r in got)
    taken, target = Counter(), {}
    for r in got:
        taken[r["source_size"]] += r["taken"]
        target[r["source_size"]] = r["target"]
    assert all(abs(taken[s] - t) <= 0.01 * t + 90 for s, t in target.items())
    again = {tuple(r) for r in mixing.mix(df.repartition(3)).collect()}
    assert again == {tuple(r) for r in got}
    emitted = Counter(r["doc_id"] for r in mixing.emit(df).collect())
    assert emitted == Counter({r["doc_id"]: r["taken"] // r["size"] for r in got if r["taken"]})


def test_mix_of_odd_rows(odd_docs):
    got = mixing.mix(odd_docs)
    assert got.count() == odd_docs.count()
    out = mixing.emit(odd_docs)
    assert out.columns == odd_docs.columns
    words = sum(len(WORD.findall(r["text"] or "")) for r in out.select("text").collect())
    assert words == got.groupBy().sum("taken").first()[0]


def test_empty_tables(no_docs):
    assert quality_rules.quality_rules(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0
    assert quality_rules.keep_documents(no_docs).columns == no_docs.columns and mixing.emit(no_docs).count() == 0


def test_repeated_rows_share_their_copies(spark):
    """5,000 rows of one id and text that differ in another column, at a rate between two integers, some of them null."""
    rows = [(1, "same words here again", "en", "a", i) for i in range(5000)] + [(i, "w " * (i % 7 + 1), "en", "b", i) for i in range(2, 900)]
    rows += [(None, None, None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7).cache()
    got = mixing.mix(df).where("doc_id = 1").agg({"taken": "sum"}).first()[0] // 4
    times = Counter(r["n_chars"] for r in mixing.emit(df).where("doc_id = 1").collect())
    assert sum(times.values()) == got > 0 and len(times) <= 5000
    assert 0 < got % 5000 and max(times.values()) - min(times.values() if len(times) == 5000 else [0]) <= 1
