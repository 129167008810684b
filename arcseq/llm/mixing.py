"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source has the same expected number of copies (target / size of the source). The documents of a
source stand in one total order; the running sum of expected copies plus one random offset crosses an integer as often as
the document is emitted. The order runs through size classes, so that each stretch of the running sum holds documents of
like size and the words taken come close to the target. Of a few random offsets the one that comes nearest is used.

Ranks need no window over a whole source: documents are counted by (source, size class, hash bucket), the counts are
accumulated over classes and buckets, and only the rows of one bucket are ranked together. The number of counts has a
fixed bound for each source, whatever the number of documents.

Nulls: a null text has size 0, a null source is a source of its own and comes last, a null doc_id is ordered by its text.
Repeated rows are documents of their own. An empty table gives an empty mix. Other columns of the input are left out of
the digest; `emit` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcseq.llm.common import hex_number, marked, text_of, word_count
from arcseq.session import stage

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = 42
#: Bits of the order hash that name a bucket within a size class.
BUCKET_BITS = 12
#: Random offsets tried for a source; the one whose take is nearest to the target stays.
OFFSETS = 32


def size_class(size: str) -> Column:
    """Sizes that agree in bit length and leading three bits; grows with the size."""
    return F.expr(f"cast(length(bin({size})) * 8 + shiftright({size}, greatest(length(bin({size})) - 3, 0)) AS int)")


def source_key() -> Column:
    """The source behind an s, n for a null source."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))


def sized(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, source key, size, size class, order hash and bucket of every row."""
    t = text_of()
    tie = hex_number(F.md5(F.coalesce(F.col("doc_id").cast("string"), t)), 1, 8)
    out = docs.select("doc_id", *carry, source_key().alias("skey"), word_count(t).alias("size"), tie.alias("tie"))
    return out.withColumn("cls", size_class("size")).withColumn("bucket", F.shiftright("tie", 32 - BUCKET_BITS))


def source_targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """skey, source_size -> target: weights in order of the source, filled up to `most` times the size of each.

    Targets that stop at a cap leave `level * weight` to the others, where the level is the same for all of them: with
    sources in ascending order of cap / weight, the first whose cap exceeds the level that is left for it sets it.
    """
    turn = F.row_number().over(Window.orderBy(F.col("skey") == "n", "skey"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((turn - 1) % len(weights) + 1).cast("int"))
    w = sources.withColumn("w", weight.cast("double")).withColumn("cap", (most * F.col("source_size")).cast("double"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("w"), "skey")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything).cast("double")
    w = w.withColumn("own_level", (total - before) / rest)
    w = w.withColumn("capped", F.col("cap") / F.col("w") <= F.col("own_level"))
    level = F.max(F.when(~F.col("capped"), F.col("own_level"))).over(everything)
    return w.select("skey", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * level).alias("target"))


def offset(seed: int, j: int) -> Column:
    """Offset `j` of a source, a multiple of 2 ** -16, so that rank * 3 + offset stays exact."""
    return hex_number(F.md5(F.concat(F.lit(f"{seed}|{j}|"), F.col("skey"))), 1, 4) / F.lit(65536.0)


def crossings(k: Column, u: Column, most: int) -> Column:
    """Integers that the running sum of expected copies crosses at rank `k`."""
    at = lambda x: F.floor(x * F.col("rate") + u)
    return F.least(at(k) - at(k - 1), F.lit(most)).cast("long")


def copies(rows: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """`rows` (a written table of `sized`) with source_size, target and copies."""
    place = ["skey", "cls", "bucket"]
    counts = rows.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    counts = stage(counts, "mix-counts")
    classes = counts.groupBy("skey", "cls").agg(F.sum("n").alias("n"))
    up_to = lambda *by: F.sum("n").over(Window.partitionBy(*by[:-1]).orderBy(by[-1])) - F.col("n")
    classes = classes.select("skey", "cls", up_to("skey", "cls").alias("before_class"))
    sources = source_targets(counts.groupBy("skey").agg(F.sum("words").alias("source_size")), weights, most)
    sources = stage(sources, "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    starts = counts.select(*place, up_to("skey", "cls", "bucket").alias("before_bucket"))
    starts = starts.join(classes.join(sources, "skey"), ["skey", "cls"])
    starts = starts.select(*place, (F.col("before_class") + F.col("before_bucket")).alias("start"), "source_size", "target", rate.alias("rate"))
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy(*place).orderBy("tie", "doc_id", "size")))
    ranked = ranked.join(starts, place).withColumn("k", F.col("start") + F.col("k")).drop("cls", "bucket", "tie", "start")
    ranked = stage(ranked, "mix-ranked")
    takes = [F.sum(F.col("size") * crossings(F.col("k"), offset(seed, j), most)).alias(f"t{j}") for j in range(OFFSETS)]
    tried = ranked.groupBy("skey", "target").agg(*takes)
    ways = F.array(*[F.struct(F.abs(F.col(f"t{j}") - F.col("target")).alias("miss"), F.lit(j).alias("j"), offset(seed, j).alias("u")) for j in range(OFFSETS)])
    chosen = stage(tried.select("skey", F.array_min(ways).u.alias("u")), "mix-offsets")
    return ranked.join(chosen, "skey").withColumn("copies", crossings(F.col("k"), F.col("u"), most))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """Digest of every document: size, size and target of its source, words taken."""
    rows = stage(sized(docs), "mix-sizes")
    return copies(rows, weights, most, seed).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """The mix itself: every row of `docs` as often as it is taken, with all its columns.

    Copy counts meet their rows by a key of id, source and text. Of a key, only the number of rows and how many of them are
    taken at least once, twice, ... is carried, so a row that is alone, or whose repeats all have one count, needs no rank.
    Where the counts of repeated rows differ, the rows are written with their places and ranked in blocks of 1,024.
    """
    tagged = marked(docs)
    rows = stage(sized(tagged, "key"), "mix-sizes")
    held = F.array(*[F.count_if(F.col("copies") >= j) for j in range(1, most + 1)])
    taken = copies(rows, weights, most, seed).groupBy("key").agg(F.count(F.lit(1)).alias("n"), held.alias("held"))
    unlike = F.exists("held", lambda h: (h > 0) & (h < F.col("n")))
    taken = stage(taken.where(F.col("held")[0] > 0).withColumn("unlike", unlike), "mix-copies", "unlike")
    own = tagged.select("row", "key")
    alike = own.join(taken.where("NOT unlike"), "key").select("row", F.lit(1).cast("long").alias("rank"), "held")
    ranked = repeats_in_order(own.join(taken.where("unlike"), "key"))
    times = F.size(F.filter("held", lambda h: F.col("rank") <= h))
    met = alike.unionByName(ranked).withColumn("times", times).where("times > 0")
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def repeats_in_order(rows: DataFrame) -> DataFrame:
    """row, held and the rank of every row within its key, counted block by block of the written table."""
    at = rows.select("row", "key", "held", F.monotonically_increasing_id().alias("at"))
    at = stage(at.withColumn("block", F.shiftright("at", 10)), "mix-repeats")
    block = ["key", "block"]
    before = F.sum("n").over(Window.partitionBy("key").orderBy("block")) - F.col("n")
    starts = at.groupBy(*block).agg(F.count(F.lit(1)).alias("n")).select(*block, before.alias("start"))
    turn = F.row_number().over(Window.partitionBy(*block).orderBy("at"))
    return at.withColumn("turn", turn).join(starts, block).select("row", (F.col("start") + F.col("turn")).alias("rank"), "held")


def oracle(weights=WEIGHTS, most: int = MOST_REPEATS, seed: int = SEED) -> str:
    down = 1 << (32 - BUCKET_BITS)
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS skey, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         CAST(('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 8)) AS BIGINT) AS tie
  FROM documents),
k AS (
  SELECT *, row_number() OVER (PARTITION BY skey ORDER BY length(bin(size)) * 8 + (size >> greatest(length(bin(size)) - 3, 0)), tie // {down}, tie, doc_id, size) AS k
  FROM d),
s AS (SELECT skey, sum(size)::BIGINT AS source_size FROM d GROUP BY skey),
w AS (
  SELECT skey, source_size, [{", ".join(f"{x}.0::DOUBLE" for x in weights)}][(row_number() OVER (ORDER BY skey = 'n', skey) - 1) % {len(weights)} + 1] AS w,
         ({most} * source_size)::DOUBLE AS cap
  FROM s),
l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_level
  FROM w WINDOW o AS (ORDER BY cap / w, skey)),
t AS (
  SELECT skey, source_size, CASE WHEN cap / w <= own_level THEN cap
         ELSE w * max(CASE WHEN NOT cap / w <= own_level THEN own_level END) OVER () END AS target
  FROM l),
r AS (
  SELECT doc_id, size, skey, source_size, target, k, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate
  FROM k JOIN t USING (skey)),
u AS (
  SELECT skey, j, CAST(('0x' || substr(md5('{seed}|' || j || '|' || skey), 1, 4)) AS BIGINT) / 65536.0::DOUBLE AS u
  FROM t, range({OFFSETS}) AS o(j)),
m AS (
  SELECT skey, j, u.u, abs(sum(size * least(floor(k * rate + u.u) - floor((k - 1) * rate + u.u), {most})::BIGINT) - any_value(target)) AS miss
  FROM r JOIN u USING (skey) GROUP BY skey, j, u.u),
c AS (SELECT skey, u FROM m QUALIFY row_number() OVER (PARTITION BY skey ORDER BY miss, j) = 1)
SELECT doc_id, size, source_size, target,
       (least(floor(k * rate + u) - floor((k - 1) * rate + u), {most})::BIGINT * size)::BIGINT AS taken
FROM r JOIN c USING (skey)
"""
