"""Folds, chronological splits, permutations and the joins that use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcseq.columns import CHUNK, ORDER, SEQ
from arcseq.functions.hashing import as_int, digest
from arcseq.operators.ordered import in_sequence, per_chunk, rank_in_group, running, same_keys
from arcseq.operators.trial_table import split_segments

HEX_DIGITS = 3  # a hot group is ranked in up to 16**3 intervals of its digest


def stratified_folds(seqs: DataFrame, n: int = 4, seed: int = 42) -> DataFrame:
    """Whole sequences to folds, balanced within subject x prior width."""
    keyed = seqs.withColumn("__h", digest(seed, *[F.col(k) for k in SEQ]))
    ranked = rank_in_group(
        keyed, ["subject_id", "prior_std"], ["__h"], F.substring("__h", 1, HEX_DIGITS), "__rank"
    )
    # a digest of the stratum shifts its first fold, so small strata do not all start at fold 0
    shift = as_int(digest(seed, F.col("subject_id"), F.col("prior_std").cast("long")))
    return ranked.withColumn("fold", F.pmod(F.col("__rank") - 1 + shift, F.lit(n)).cast("int")).drop("__h", "__rank")


def group_folds(seqs: DataFrame, by: str, n: int = 4) -> DataFrame:
    """Whole groups (subject, session or prior width) to folds, largest groups first."""
    sizes = seqs.groupBy(by).agg(F.sum("n").alias("__size"))
    sizes = sizes.withColumns({"__all": F.lit(0), "__neg": -F.col("__size")})
    # equal sizes are common, so the order is cut by size and then by intervals of the group id
    cut = sizes.withColumn("__ids", F.floor(F.col(by) / 4096))
    ranked = running(cut, ["__all"], ["__neg", "__ids"], [by], {"__r": ("sum", F.lit(1).cast("long"))})
    return same_keys(seqs, ranked.select(by, ((F.col("__r") - 1) % n).cast("int").alias("fold")), [by])


CUTS = [0.40, 0.55, 0.70, 0.85, 1.0]  # fixed values: share of ordered blocks before each cut


def block_epochs(seqs: DataFrame) -> DataFrame:
    """Interval (0..4) of each block in its subject's block order; epoch k is tested by split k."""
    ranked = running(
        seqs, ["subject_id"], ["session_id"], ["run_id"], {"block_rank": ("sum", F.lit(1).cast("long"))}
    )
    totals = seqs.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_blocks"))
    ranked = same_keys(ranked, totals, ["subject_id"])
    epoch = F.lit(0)
    for cut in CUTS[:-1]:
        epoch = epoch + (F.col("block_rank") > F.floor(F.lit(cut) * F.col("n_blocks"))).cast("int")
    return ranked.withColumn("epoch", epoch)


def chronological_splits(seqs: DataFrame) -> DataFrame:
    """Expanding windows: split k trains on all epochs before k and tests on epoch k."""
    epochs = block_epochs(seqs)
    splits = epochs.withColumn("split_id", F.explode(F.sequence(F.greatest(F.col("epoch"), F.lit(1)), F.lit(4))))
    return splits.withColumn("role", F.when(F.col("split_id") == F.col("epoch"), "test").otherwise("train"))


def attach_folds(trials: DataFrame, folds: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Sequence-level columns onto trials; long sequences are matched chunk by chunk."""
    return same_keys(trials, per_chunk(folds.select(*SEQ, "chunks", *(cols or ["fold"]))), SEQ + [CHUNK])


def attach_segments(raw: DataFrame, segment_map: DataFrame) -> DataFrame:
    return raw.join(segment_map.select("row_id", "segment_id", "segment_number"), "row_id")


def rows_in_split(trials: DataFrame, splits: DataFrame, split_id: int, role: str) -> DataFrame:
    """Trials whose block has the given role in the split."""
    ids = splits.filter((F.col("split_id") == split_id) & (F.col("role") == role))
    return same_keys(trials, per_chunk(ids.select(*SEQ, "chunks")), SEQ + [CHUNK], "left_semi")


def rank_by_digest(keyed: DataFrame, keys: list[str], first: list[str], out: str) -> DataFrame:
    """Row number per group in the order of `first` and the digest `__h`, which travels as 16 bytes and is dropped."""
    keyed = keyed.withColumn("__h", F.unhex("__h"))
    part = F.substring(F.hex("__h"), 1, HEX_DIGITS)
    fine = F.struct(*first, part.alias("part")) if first else part
    return rank_in_group(keyed, keys, [*first, "__h"], fine, out).drop("__h")


def permute_within(df: DataFrame, keys: list[str], seed: int | None = 7, out: str = "shuffle_order") -> DataFrame:
    """New 1-based order of the rows inside each group (rows stay, order changes)."""
    parts = [seed] if seed is not None else []
    keyed = df.withColumn("__h", digest(*parts, *[F.col(k) for k in keys if k == "simulation"], F.col("row_id")))
    return rank_by_digest(keyed, keys, [], out)


def change_by_segment(shuffled: DataFrame) -> DataFrame:
    """Row count per segment and whether the permutation moved any row."""
    return shuffled.groupBy("segment_id").agg(
        F.count(F.lit(1)).alias("n_trials"),
        (F.sum((F.col("shuffle_order") != F.col("seg_pos")).cast("long")) > 0).alias("order_changed"),
    )


def permute_matched(
    df: DataFrame, strata: list[str], slot: list[str], content: list[str], seed: int | Column = 11
) -> DataFrame:
    """Exchange rows across blocks inside each stratum: slots keep their ids, contents move. A column as seed, with a
    stratum for each of its values, makes many permutations in one plan.

    Slots are numbered in order, donors by digest; the two numberings are joined rank by rank.
    """
    order = ["segment_id", ORDER]
    fine_order = F.struct("segment_id", F.floor(F.col(ORDER) / 1000).alias("part"))
    slots = rank_in_group(df.select(*strata, *slot), strata, order, fine_order, "__rank")
    donors = df.select(*strata, *[F.col(c).alias(f"__d_{c}") for c in content], F.col("block_id").alias("source_block_id"),
                       digest(seed, F.col("row_id")).alias("__h"))
    donors = rank_by_digest(donors, strata, [], "__rank")
    joined = same_keys(slots, donors, [*strata, "__rank"]).drop("__rank")
    return joined.withColumnsRenamed({f"__d_{c}": c for c in content})


def changed_fraction(permuted: DataFrame, strata: list[str]) -> DataFrame:
    return permuted.groupBy(*strata).agg(
        F.count(F.lit(1)).alias("n_trials"),
        F.avg((F.col("source_block_id") != F.col("block_id")).cast("double")).alias("fraction_changed_block"),
    )


def permute_cross_subject(df: DataFrame, strata: list[str], content: list[str], seed: int = 13) -> DataFrame:
    """Give every trial the response of another subject inside its stratum where possible.

    Rows are ranked by (subject, digest) and the contents are moved on by the size of the largest subject,
    so no subject meets itself as long as it holds at most half of the stratum.
    """
    keyed = df.withColumn("__h", digest(seed, F.col("row_id")))
    by_subject = keyed.groupBy(*strata, "subject_id").agg(F.count(F.lit(1)).alias("__m"))
    shape = by_subject.groupBy(*strata).agg(F.max("__m").alias("__shift"), F.sum("__m").alias("__n"))
    ranked = rank_by_digest(keyed, strata, ["subject_id"], "__rank")
    donors = same_keys(ranked, shape, strata).select(
        *strata,
        (F.pmod(F.col("__rank") - 1 + F.col("__shift"), F.col("__n")) + 1).alias("__rank"),
        F.col("subject_id").alias("donor_subject_id"),
        *[F.col(c).alias(f"__d_{c}") for c in content],
    )
    joined = same_keys(ranked.drop(*content), donors, [*strata, "__rank"]).drop("__rank")
    return joined.withColumnsRenamed({f"__d_{c}": c for c in content})


def leakage(folds: DataFrame, keys: list[str] = SEQ) -> DataFrame:
    """Blocks that sit in more than one fold (empty when folds do not leak)."""
    return folds.groupBy(*keys).agg(F.countDistinct("fold").alias("n_folds")).filter(F.col("n_folds") > 1)


def split_overlap(splits: DataFrame) -> DataFrame:
    """Blocks in both roles of one split."""
    keys = ["split_id", *SEQ]
    train = splits.filter(F.col("role") == "train").select(*keys)
    return train.intersect(splits.filter(F.col("role") == "test").select(*keys))


def same_membership(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """Row counts of both versions and of the rows found in only one of them."""
    tagged = a.select(*cols, F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionByName(
        b.select(*cols, F.lit(0).alias("__a"), F.lit(1).alias("__b"))
    )
    per_row = tagged.groupBy(*cols).agg(F.sum("__a").alias("na"), F.sum("__b").alias("nb"))
    return per_row.agg(
        F.sum("na").alias("rows_a"),
        F.sum("nb").alias("rows_b"),
        F.sum(F.greatest(F.col("na") - F.col("nb"), F.lit(0))).alias("only_a"),
        F.sum(F.greatest(F.col("nb") - F.col("na"), F.lit(0))).alias("only_b"),
    ).withColumn("same", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def segment_position(segs: DataFrame) -> DataFrame:
    """1-based position and length inside each segment."""
    keys = [*SEQ, "segment_number"]
    return in_sequence(segs, keys, CHUNK, ORDER, pos="seg_pos", length="seg_len")


def placed_segments(trials: DataFrame, folds: DataFrame) -> DataFrame:
    """Segments of trials with position, length and fold, as `segment_position` and `attach_folds` give them.

    Whole rows are shuffled once, by (sequence, chunk). The lengths of segments are counted in a pass over keys alone, and a
    chunk learns what its segments hold before it and in all from one row.
    """
    cut = split_segments(trials.select(*SEQ, ORDER, "estimate_x", "estimate_y"))
    counts = cut.groupBy(*SEQ, "segment_number", CHUNK).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*SEQ, "segment_number")
    before = F.sum("__n").over(w.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1))
    held = F.struct(F.coalesce(before, F.lit(0)).alias("before"), F.sum("__n").over(w).alias("length"))
    held = counts.select(*SEQ, CHUNK, "segment_number", held.alias("held"))
    own = held.groupBy(*SEQ, CHUNK).agg(F.map_from_entries(F.collect_list(F.struct("segment_number", "held"))).alias("__held"))
    own = attach_folds(own, folds)
    rows = split_segments(trials, own)
    mine = F.element_at("__held", F.col("segment_number"))
    return rows.withColumns({"seg_pos": F.col("chunk_pos") + mine["before"], "seg_len": mine["length"]}).drop("chunk_pos", "__held")
