"""Licence families of paragraphs by a trained sparse n-gram classifier, in DataFrame operations only.

A paragraph begins at every line that holds a letter. It is first judged as this line alone, equal lines once. Where the line
is no confirmed notice but holds `BEGUN` of a template's trigrams, a notice may be wrapped: then the line with those after it
is judged, up to `WINDOW` lines or the next blank one (`lines` of the result; such spans may overlap). A paragraph's features
are which word unigrams and bigrams of the templates it holds. A multinomial logistic regression tells the licence families
and an unknown class apart; it is trained on the templates (whole, in parts, and beside paragraphs of the corpus), on
sentences that use the same words otherwise, and on every different paragraph of the corpus without an anchor term (words
without which no whole notice of the templates goes), paragraphs of the same features as one row. Together these weigh as much
as `UNKNOWN` examples at most, so that the classes keep their shares in a corpus of any size. Anchor terms only choose these
training rows: paragraphs are judged with or without one.

A trigram of a template cannot stand in a line without the two bigrams in it. So only lines that hold both of some trigram are
compared with the templates word by word; all others share no trigram with any, and their features are enough to judge them.

The unknown class is calibrated: of the corpus paragraphs half (by hash) stay out of training, and a family has to be likelier
than it is for all but `FALSE_ALARMS` of all of these (and than 0.5), else the paragraph is unknown. A prediction is confirmed where
the word trigrams of a template of its family are found in the paragraph by at least `SIMILARITY`.

The vocabulary and the weights are as large as the templates make them, whatever the corpus.

Nulls: a null text has no paragraphs; a null doc_id is returned as it is. Repeated rows are all returned. An empty table,
or one without a letter, gives an empty result. Of families equally likely the last by name is taken. Other columns of
the input are left out.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcseq.llm.common import text_of
from arcseq.llm.license_templates import OTHER, TEMPLATES
from arcseq.session import stage

ANCHOR = r"(?i)licen[cs]|copyright|rights\s+reserved|warrant|permission|permitted|public\s+domain|public\s+license|creative\s+commons|spdx|\bgpl\b|redistribut|\bcc[ -]by\b|\bcc0\b"
#: A line without one is blank.
LETTER = r"\p{L}"
#: Weight in examples of all paragraphs of the unknown class that are trained on.
UNKNOWN = 1000
FALSE_ALARMS = 0.001
#: Paragraphs of the corpus that templates are set beside in training.
CONTEXTS = 64
#: Intervals into which probabilities are counted at once.
BINS = 4096
SIMILARITY = 0.6
#: A wrapped notice takes at most so many lines: the longest template in lines of five words.
WINDOW = 6
#: Share of a template's trigrams by which a line may begin a wrapped notice.
BEGUN = 0.1
RIDGE = 0.002
STEPS = 60
NO_FAMILY = "unknown"
#: Weights of all classes by gram, classes, intercepts, least probability of a family.
Model = tuple[DataFrame, list[str], list[float], float]


def tokens(text: Column) -> Column:
    """Lower-case words, numbers with their points, and parts of hyphenated names."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}]+|[0-9]+(?:\.[0-9]+)*"), F.lit(0))


def grams(words: str, n: int) -> Column:
    at = F.slice(F.col(words), F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))
    return F.array_distinct(F.transform(at, lambda x, i: F.concat_ws(" ", x, *[F.get(words, i + k) for k in range(1, n)])))


def features(words: str) -> Column:
    return F.array_union(F.array_distinct(words), grams(words, 2))


def templates(spark: SparkSession) -> DataFrame:
    """template, family, words of every notice."""
    rows = [(i, family, text) for i, (family, text) in enumerate((f, t) for f, own in TEMPLATES.items() for t in own)]
    return spark.createDataFrame(rows, "template int, family string, text string").select("template", "family", tokens(F.col("text")).alias("words"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (from 0), text of every line."""
    return docs.select("doc_id", F.posexplode(F.split(text_of(), "\n")).alias("paragraph", "text"))


def wrapped(some: Column) -> Column:
    """The first of some lines with those after it, up to the next one without a letter."""
    blank = F.array_position(F.transform(some, lambda x: x.rlike(LETTER)), False).cast("int")
    return F.concat_ws("\n", F.slice(some, F.lit(1), F.when(blank > 1, blank - 1).otherwise(F.lit(WINDOW))))


def candidates(docs: DataFrame, begun: DataFrame) -> DataFrame:
    """doc_id, paragraph (its first line, from 0), h (of that line) of every line with a letter; `window` (the lines a wrapped
    notice may take) where the line is one of `begun` (h)."""

    def each(lines: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(lines) - 1)
        return F.transform(at, lambda i: F.struct(i.alias("paragraph"), lines[i].alias("text"), F.slice(lines, i + 1, F.lit(WINDOW)).alias("some")))

    # the lines are bound by a one-element array, so that the text is split once and not once a line
    found = docs.select("doc_id", F.explode(F.transform(F.array(F.split(text_of(), "\n")), each)[0]).alias("c")).select("doc_id", "c.*")
    found = found.where(F.col("text").rlike(LETTER)).withColumn("h", F.xxhash64("text"))
    found = found.join(begun.select("h", F.lit(True).alias("begun")), "h", "left")
    return found.select("doc_id", "paragraph", "h", F.when(F.col("begun"), wrapped(F.col("some"))).alias("window"))


def may_hold_trigram(vocabulary: list[str], notices: DataFrame) -> Column:
    """Whether `features` hold both bigrams of a trigram of the templates."""
    at = {g: i for i, g in enumerate(vocabulary)}
    thirds = {tuple(r["words"][i : i + 3]) for r in notices.collect() for i in range(len(r["words"]) - 2)}  # as many as the templates have
    both = sorted({(at[f"{a} {b}"], at[f"{b} {c}"]) for a, b, c in thirds})
    pairs = F.array(*[F.array(F.lit(i), F.lit(j)) for i, j in both])
    # the vector is bound by a one-element array, so that it is made an array once and not once a pair
    told = F.array(vector_to_array("features", "float32"))
    return F.transform(told, lambda v: F.exists(pairs, lambda x: (F.get(v, x[0]) > 0) & (F.get(v, x[1]) > 0)))[0]


def distinct_lines(docs: DataFrame, counter: CountVectorizerModel, near: Column | None = None) -> DataFrame:
    """h, anchored, features of the different lines of the corpus that are not empty; `text` of those that are `near`."""
    lines = paragraphs(docs).where(F.length("text") > 0)
    words = lines.select(F.xxhash64("text").alias("h"), F.col("text").rlike(ANCHOR).alias("anchored"), "text", tokens(F.col("text")).alias("words"))
    pairs = NGram(n=2, inputCol="words", outputCol="pairs").transform(words)
    told = counter.transform(pairs.select("h", "anchored", "text", F.concat("words", "pairs").alias("grams")))
    text = F.lit(None).cast("string") if near is None else F.when(near, F.col("text"))
    return told.select("h", "anchored", "features", text.alias("text")).distinct()


def unknown_rows(docs: DataFrame, counter: CountVectorizerModel) -> DataFrame:
    """features, kept_out, n of the different paragraphs of the corpus without an anchor term: `n` of them have these features."""
    return unanchored(distinct_lines(docs, counter))


def unanchored(lines: DataFrame) -> DataFrame:
    each = lines.where(~F.col("anchored"))
    return each.groupBy("features", (F.pmod("h", F.lit(2)) == 1).alias("kept_out")).agg(F.count(F.lit(1)).alias("n"))


def contexts(unknown: DataFrame, vocabulary: list[str]) -> DataFrame:
    """noise (from 0 to CONTEXTS - 1), around (grams): of each hash class the paragraph that comes first by another hash."""
    h = F.xxhash64("features")
    some = unknown.where("NOT kept_out").groupBy(F.pmod(h, F.lit(CONTEXTS)).cast("int").alias("noise"))
    found = some.agg(F.min_by("features", F.xxhash64(F.lit(3), "features")).alias("features")).collect()  # at most CONTEXTS
    rows = [(r["noise"], [vocabulary[int(i)] for i in r["features"].indices]) for r in found]
    return unknown.sparkSession.createDataFrame(rows, "noise int, around array<string>")


def training_rows(notices: DataFrame, around: DataFrame) -> DataFrame:
    """family, grams of every example that does not come from the corpus."""
    spark = notices.sparkSession
    n = F.size("words")
    cut = lambda a, b: F.slice("words", a, b)
    most = F.greatest(F.ceil(n * 0.7).cast("int"), F.least(n, F.lit(3)))
    parts = notices.select("template", "family", F.explode(F.array("words", "words", "words", cut(F.lit(1), most), cut(n - most + 1, most))).alias("words"))
    noisy = notices.withColumn("noise", F.explode(F.sequence("template", F.col("template") + 5))).withColumn("noise", F.col("noise") % CONTEXTS)
    noisy = noisy.join(around, "noise").select("family", F.array_union(features("words"), "around").alias("grams"))
    other = spark.createDataFrame([(t,) for t in OTHER], "text string").select(F.lit(NO_FAMILY).alias("family"), tokens(F.col("text")).alias("words"))
    blank = spark.createDataFrame([(NO_FAMILY, [])], "family string, words array<string>")
    plain = parts.select("family", "words").union(other).union(other).union(blank)
    return plain.select("family", features("words").alias("grams")).union(noisy)


def value_exceeded(rows: DataFrame, most: int, low: float, high: float) -> float:
    """The smallest `p` of the rows (p in [low, high], n) that at most `most` of them (by `n`) exceed, exactly; `low` without any.

    Counted in BINS intervals, then within the one that holds it, until that holds one value.
    """
    while True:
        bins = F.least(F.floor((F.col("p") - low) / ((high - low) / BINS)), F.lit(BINS - 1)) if high > low else F.lit(0)
        counts = rows.where(F.col("p").between(low, high)).groupBy(bins.alias("bin")).agg(F.sum("n").alias("n"), F.min("p").alias("low"), F.max("p").alias("high"))
        for r in sorted(counts.collect(), key=lambda r: -r["bin"]):  # at most BINS
            if most < r["n"]:
                break
            most -= r["n"]
        else:
            return low
        low, high = r["low"], r["high"]
        if low == high:
            return low


def train(lines: DataFrame, counter: CountVectorizerModel, notices: DataFrame) -> tuple[LogisticRegressionModel, Model]:
    """The classifier, and (gram -> weights of all classes, classes, intercepts, least probability of a family)."""
    spark, vocabulary = lines.sparkSession, counter.vocabulary
    unknown = stage(unanchored(lines), "license-unknown")
    sizes = {r["kept_out"]: r["n"] for r in unknown.groupBy("kept_out").agg(F.sum("n").alias("n")).collect()}
    names = [*sorted(TEMPLATES), NO_FAMILY]
    number = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("family")) - 1
    rows = training_rows(notices, contexts(unknown, vocabulary)).select(number.cast("double").alias("label"), "grams")
    rows = counter.transform(rows).select("label", "features", F.lit(1.0).alias("weight"))
    share = min(1.0, UNKNOWN / max(sizes.get(False, 0), 1))
    own = unknown.where("NOT kept_out").select(F.lit(float(len(names) - 1)).alias("label"), "features", (F.col("n") * share).alias("weight"))
    rows = stage(rows.union(own), "license-training")
    regression = LogisticRegression(maxIter=STEPS, regParam=RIDGE, family="multinomial", standardization=False, weightCol="weight")
    fitted = regression.fit(rows)
    matrix = fitted.coefficientMatrix.toArray().T.tolist()
    weights = spark.createDataFrame(list(zip(vocabulary, matrix, strict=True)), "gram string, w array<double>")
    weights = stage(weights, "license-weights")
    intercepts = [float(x) for x in fitted.interceptVector]
    told = F.array_max(F.slice(vector_to_array("probability"), 1, len(names) - 1))
    quiet = stage(fitted.transform(unknown.where("kept_out")).select(told.alias("p"), "n").where("p > 0.5"), "license-quiet")
    allowed = math.floor(FALSE_ALARMS * sizes.get(True, 0))
    return fitted, (weights, names, intercepts, value_exceeded(quiet, allowed, 0.5, 1.0))


def probabilities(rows: DataFrame, weights: DataFrame, names: list[str], intercepts: list[float]) -> DataFrame:
    """h -> best (p, family) among the licence families; rows without a gram of the vocabulary have the intercepts' odds."""
    each = rows.select("h", F.explode_outer(features("words")).alias("gram"))
    sums = [F.coalesce(F.sum(F.col("w")[k]), F.lit(0.0)).alias(f"z{k}") for k in range(len(names))]
    logits = each.join(weights, "gram", "left").groupBy("h").agg(*sums)
    z = [F.col(f"z{k}") + F.lit(intercepts[k]) for k in range(len(names))]
    top = F.greatest(*z)
    odds = F.array(*[F.exp(x - top) for x in z])
    total = F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)
    scored = logits.select("h", odds.alias("odds"), total.alias("total"))
    ways = F.array(*[F.struct((F.get("odds", F.lit(k)) / F.col("total")).alias("p"), F.lit(x).alias("family")) for k, x in enumerate(names) if x != NO_FAMILY])
    return scored.select("h", F.array_max(ways).alias("best"))


def similarities(rows: DataFrame, notices: DataFrame) -> DataFrame:
    """h, family -> largest share of a template's trigrams that the paragraph holds."""
    own = notices.select("template", "family", F.explode(grams("words", 3)).alias("gram"), F.size(grams("words", 3)).alias("n"))
    met = rows.select("h", F.explode(grams("words", 3)).alias("gram")).join(own, "gram")
    each = met.groupBy("h", "template", "family").agg((F.count(F.lit(1)) / F.first("n")).alias("share"))
    return each.groupBy("h", "family").agg(F.max("share").alias("similarity"))


def judge(texts: DataFrame, model: Model) -> DataFrame:
    """h, family, probability, similarity (to that family), confirmed, begun (largest similarity to any) of every h, text."""
    weights, names, intercepts, least = model
    words = stage(texts.groupBy("h").agg(F.min("text").alias("text")).select("h", tokens(F.col("text")).alias("words")), "license-texts")
    best = probabilities(words, weights, names, intercepts)
    like = similarities(words, templates(texts.sparkSession)).groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("family", "similarity"))).alias("like"))
    sure = F.col("best.p") >= F.lit(least)
    similarity = F.coalesce(F.element_at("like", F.col("best.family")), F.lit(0.0))
    judged = best.join(like, "h", "left").select(
        "h",
        F.when(sure, F.col("best.family")).otherwise(NO_FAMILY).alias("family"),
        F.col("best.p").alias("probability"),
        similarity.alias("similarity"),
        (sure & (similarity >= SIMILARITY)).alias("confirmed"),
        F.coalesce(F.array_max(F.map_values("like")), F.lit(0.0)).alias("begun"),
    )
    return stage(judged, "license-judged")


def judge_by_features(lines: DataFrame, fitted: LogisticRegressionModel, model: Model) -> DataFrame:
    """What `judge` tells of lines (h, features) without a trigram of the templates."""
    _, names, _, least = model
    p = vector_to_array("probability")
    ways = F.array(*[F.struct(F.get(p, F.lit(k)).alias("p"), F.lit(x).alias("family")) for k, x in enumerate(names) if x != NO_FAMILY])
    best = fitted.transform(lines.select("h", "features")).select("h", F.array_max(ways).alias("best"))
    family = F.when(F.col("best.p") >= F.lit(least), F.col("best.family")).otherwise(NO_FAMILY)
    none = F.lit(0.0)
    return best.select("h", family.alias("family"), F.col("best.p").alias("probability"), none.alias("similarity"), F.lit(False).alias("confirmed"), none.alias("begun"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph, lines, family, probability, similarity, confirmed of every paragraph."""
    notices = templates(docs.sparkSession)
    vocabulary = sorted(r[0] for r in notices.select(F.explode(features("words"))).distinct().collect())  # as many as the templates have
    counter = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features")
    counter.setBinary(True).setMinTF(1.0)
    lines = stage(distinct_lines(docs, counter, may_hold_trigram(vocabulary, notices)), "license-lines")
    fitted, model = train(lines, counter, notices)
    near = judge(lines.where("text IS NOT NULL").select("h", "text"), model)
    line = near.unionByName(judge_by_features(lines.where("text IS NULL"), fitted, model))
    begun = stage(near.where(~F.col("confirmed") & (F.col("begun") >= BEGUN)).select("h"), "license-begun")
    found = stage(candidates(docs, begun), "license-candidates").withColumn("wh", F.xxhash64("window"))
    spans = found.where("window IS NOT NULL AND wh <> h").select(F.col("wh").alias("h"), F.col("window").alias("text"))
    span = judge(spans, model).where("confirmed")
    verdict = ["family", "probability", "similarity", "confirmed"]
    own = F.struct(F.lit(1).alias("lines"), *verdict).alias("own")
    rows = found.select("doc_id", "paragraph", "h", F.when(F.col("window").isNotNull(), F.col("wh")).alias("wh"), (F.regexp_count("window", F.lit("\n")) + 1).alias("lines"))
    rows = rows.join(line.select("h", own), "h")
    wide = span.select(F.col("h").alias("wh"), F.struct(*verdict).alias("wide"))
    rows = rows.join(wide, "wh", "left")
    # only lines that may begin a wrapped notice have a window
    both = F.when(F.col("wide").isNotNull(), F.struct("lines", "wide.*")).otherwise(F.col("own"))
    return rows.select("doc_id", "paragraph", both.alias("v")).select("doc_id", "paragraph", "v.*")
