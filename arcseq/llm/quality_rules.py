"""Quality rules with cross-document line frequency, in DataFrame operations only.

Every line is normalised (lower case, digit runs to 0, white space runs to one blank, trimmed) and hashed. For each host
(the `source` column) and line, distinct documents are counted. A line is above the limits when more than `min_docs`
documents hold it, and either more than `max_share` of the host's documents or more than `max_docs` documents; the limit
so stops growing with the host. Occurrences of lines above the limits are removed. A document that loses more than
`max_removed` of its line characters is depleted and rejected, as is one that fails the base rules.

Copies of one document are not boilerplate: documents of a host whose whole sets of line hashes are equal count once, in
the line's count and in the host's. Without that a group of copies that fills a share of a host would reject itself, and
deduplication would find nothing to keep. Documents that differ in any line count each, however many lines they share.

Documents meet the lines above the limits line by line, and their verdict by the hash of host and line set; no list of a
host's lines is gathered.

Nulls: a null text has no words and fails the base rules; a null source is a host of its own; a null doc_id stays as it
is. Repeated rows are judged alike and all returned. An empty table gives an empty result. Other columns are left out of
the digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcseq.llm.common import SPACES, hex_number, marked, text_of
from arcseq.session import stage

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SYMBOLS = r"[#*$%&|<>]"
MIN_DOCS = 10
MAX_SHARE = 0.05
#: A line in more documents of a host than this is above the limits whatever its share.
MAX_DOCS = 1000
MAX_REMOVED = 0.5


def bound(value: Column, use) -> Column:
    """`use(value)` with `value` evaluated once, inside an expression."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(text, r"[\x09-\x0D]+", " "), " "), "")


def window_hashes(w: str) -> Column:
    """Hash of each window of three words, by its first word."""
    starts = F.slice(F.col(w), F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))
    return F.transform(starts, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))


def repeated_words(hashes: str) -> Column:
    """Words that lie in a window found twice or more: equal windows are neighbours once sorted."""
    placed = F.sort_array(F.transform(F.col(hashes), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def again(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: (x.h == F.get(s, j - 1).h) | (x.h == F.get(s, j + 1).h))
        return F.sort_array(F.transform(twice, lambda x: x.i))

    covered = F.aggregate(
        bound(placed, again),
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a.n + F.least(F.lit(3), i - a.last)).alias("n"), i.alias("last")),
    ).n
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(covered).cast("long")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "0"), r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " ")


def line_hashes(text: Column) -> Column:
    """(h, chars) of every line with a word."""
    lines = F.filter(F.transform(F.split(normalised(text), "\n"), lambda x: F.btrim(x)), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(hex_number(F.md5(x), 1, 15).alias("h"), F.length(x).cast("long").alias("chars")))


def base_rules(docs: DataFrame, host: str = "source", *carry: str) -> DataFrame:
    """Base counts, verdict and line hashes of every row."""
    t = text_of()
    with_word = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    parsed = docs.select(
        "doc_id", F.col(host).cast("string").alias("host"), *carry, t.alias("_t"), words(t).alias("_w"), with_word.alias("_l")
    )
    hashed = parsed.select("*", window_hashes("_w").alias("_h"))
    base = hashed.select(
        "doc_id", "host", *carry,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeated_words("_h").alias("n_repeat_words"),
        line_hashes(F.col("_t")).alias("lines"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return base.withColumn("base_failed", failed)


def line_set() -> Column:
    """One hash over host and the sorted different line hashes: equal for copies."""
    return F.xxhash64("host", F.array_sort(F.array_distinct(F.col("lines.h"))))


def counted_lines(base: DataFrame) -> DataFrame:
    """(host, h, n_docs): for every line of a host, the documents that hold it, copies once."""
    distinct = base.select("host", line_set().alias("set"), F.explode(F.array_distinct(F.col("lines.h"))).alias("h")).distinct()
    return distinct.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n_docs"))


def frequent_lines(base: DataFrame, min_docs: int, max_share: float, max_docs: int) -> DataFrame:
    """(host, h) of every line above the limits."""
    hosts = base.select("host", line_set().alias("set")).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    lines = counted_lines(base).where(F.col("n_docs") > min_docs).alias("l")
    above = lines.join(hosts.alias("s"), F.expr(f"l.host <=> s.host AND l.n_docs > least({max_share} * s.docs, {max_docs})"))
    return above.select("l.host", "l.h")


def removed_lines(base: DataFrame, min_docs: int, max_share: float, max_docs: int) -> DataFrame:
    """(set, removed): the hashes above the limits in every line set that has any."""
    above = stage(frequent_lines(base, min_docs, max_share, max_docs), "quality-above").alias("f")
    each = base.select("host", line_set().alias("set"), F.explode(F.array_distinct(F.col("lines.h"))).alias("h")).alias("e")
    met = each.join(above, F.expr("e.h = f.h AND e.host <=> f.host")).select("e.set", "e.h").distinct()
    return met.groupBy("set").agg(F.sort_array(F.collect_list("h")).alias("removed"))


def judged(
    base: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_removed: float = MAX_REMOVED, max_docs: int = MAX_DOCS
) -> DataFrame:
    """`base` (a written table) with removed (line hashes, null for none), line_chars, removed_chars, depleted and kept."""
    removed = stage(removed_lines(base, min_docs, max_share, max_docs), "quality-removed")
    joined = base.withColumn("set", line_set()).join(removed, "set", "left").drop("set")
    chars = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + x.chars)
    gone = F.when(F.col("removed").isNull(), 0).otherwise(chars(F.filter("lines", lambda x: F.array_contains("removed", x.h))))
    out = joined.withColumn("line_chars", chars(F.col("lines"))).withColumn("removed_chars", gone.cast("long"))
    out = out.withColumn("depleted", F.col("removed_chars") > max_removed * F.col("line_chars"))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def quality_rules(docs: DataFrame, **limits) -> DataFrame:
    """Digest of every document: base counts, base_failed, kept, and the characters that line removal takes."""
    base = stage(base_rules(docs), "quality-base")
    return judged(base, **limits).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_chars", "removed_chars", "depleted"
    )


def cleaned_text(text: Column, removed: Column) -> Column:
    """The text without the lines whose hashes are in `removed`; lines without a word stay."""
    key = lambda x: hex_number(F.md5(F.btrim(normalised(x))), 1, 15)
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: (F.btrim(x, F.lit(SPACES)) == "") | ~F.array_contains(removed, key(x))), "\n")


def remove_lines(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_docs: int = MAX_DOCS) -> DataFrame:
    """The documents with lines above the limits taken out of their texts; all columns stay."""
    host = F.col("source").cast("string").alias("host")
    base = stage(docs.select("doc_id", host, line_hashes(text_of()).alias("lines")), "quality-lines")
    removed = stage(removed_lines(base, min_docs, max_share, max_docs), "quality-removed")
    tagged = marked(docs).select("row", host, line_hashes(text_of()).alias("lines")).withColumn("set", line_set()).join(removed, "set", "left")
    clean = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(cleaned_text(F.col("row.text"), F.col("removed")))
    return tagged.select(F.col("row").withField("text", clean).alias("row")).select("row.*")


def keep_documents(docs: DataFrame, **limits) -> DataFrame:
    """The rows that the rules keep, with their own columns."""
    tagged = marked(docs)
    base = stage(base_rules(tagged, "source", "key"), "quality-base")
    good = stage(judged(base, **limits).where("kept").select("key").distinct(), "quality-kept")
    return tagged.join(good, "key", "left_semi").select("row.*")


def clean_documents(docs: DataFrame, **limits) -> DataFrame:
    """The rows that the rules keep, lines above the limits taken out of their texts; the other columns stay as they are."""
    tagged = marked(docs)
    base = stage(base_rules(tagged, "source", "key"), "quality-base")
    good = stage(judged(base, **limits).where("kept").select("key", "removed").distinct(), "quality-kept")
    text = F.col("row.text")
    clean = F.when(F.col("removed").isNull(), text).otherwise(cleaned_text(text, F.col("removed")))
    return tagged.join(good, "key").select(F.col("row").withField("text", clean).alias("row")).select("row.*")


ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
lines AS (
  SELECT rid, x AS line, trim(regexp_replace(regexp_replace(lower(x), '[0-9]+', '0', 'g'), '[\x20\x09\x0B-\x0D]+', ' ', 'g')) AS norm
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines, sum(length(norm)) AS line_chars FROM lines GROUP BY rid),
win AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n
  FROM (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3))),
rep AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM win WHERE n > 1) GROUP BY rid),
own AS (SELECT DISTINCT d.rid, d.host, norm, CAST(('0x' || substr(md5(norm), 1, 15)) AS BIGINT) AS h FROM lines JOIN d USING (rid)),
sets AS (
  SELECT d.rid, d.host, md5(coalesce(string_agg(CAST(h AS VARCHAR), ',' ORDER BY h), '')) AS line_set
  FROM d LEFT JOIN (SELECT DISTINCT rid, h FROM own) o ON o.rid = d.rid GROUP BY d.rid, d.host),
freq AS (SELECT own.host, h, count(DISTINCT line_set) AS n_docs FROM own JOIN sets USING (rid) GROUP BY own.host, h),
hosts AS (SELECT host, count(DISTINCT line_set) AS docs FROM sets GROUP BY host),
above AS (
  SELECT freq.host, h FROM freq JOIN hosts ON freq.host IS NOT DISTINCT FROM hosts.host
  WHERE n_docs > {MIN_DOCS} AND n_docs > least({MAX_SHARE}::DOUBLE * docs, {MAX_DOCS})),
gone AS (
  SELECT l.rid, sum(length(l.norm)) AS removed_chars
  FROM lines l JOIN d USING (rid) JOIN above a
    ON a.host IS NOT DISTINCT FROM d.host AND a.h = CAST(('0x' || substr(md5(l.norm), 1, 15)) AS BIGINT)
  GROUP BY l.rid),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(line_chars, 0)::BIGINT AS line_chars, coalesce(removed_chars, 0)::BIGINT AS removed_chars
  FROM d LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid)),
verdict AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed,
         removed_chars > {MAX_REMOVED}::DOUBLE * line_chars AS depleted
  FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT depleted AS kept, line_chars, removed_chars, depleted
FROM verdict
"""
