"""Registered queries of this subpackage, each over its whole table, and the SQL of those that SQL can state."""

from __future__ import annotations

from arcseq.llm import (
    feast_whitening, importance_sort, license_scan, line_crf, mixing, packing, quality_rules, repair_files, simhash_dedup, toxicity_pu, vector_search,
    warc_salvage, word_table,
)
from arcseq.llm.common import table
from arcseq.session import ship


def op1_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark, sf_dir):
    return line_crf.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_repair_token_files(spark, sf_dir):
    return repair_files.write_and_read(table(spark, sf_dir, "documents"))


def op5_simhash_near_duplicates(spark, sf_dir):
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    return toxicity_pu.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc_salvage(spark, sf_dir):
    return warc_salvage.round_trip(table(spark, sf_dir, "pages"))


def op8_pack_sequences(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_vector_search(spark, sf_dir):
    return vector_search.search(table(spark, sf_dir, "embeddings"))


def op10_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op11_bpe_word_table(spark, sf_dir):
    return word_table.digests(table(spark, sf_dir, "documents"))


def op12_whiten_embeddings(spark, sf_dir):
    return feast_whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_importance_resampling(spark, sf_dir):
    return importance_sort.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _shipped(fn):
    def run(spark, sf_dir):
        ship(spark)
        return fn(spark, sf_dir)

    run.__name__ = fn.__name__
    return run


_ALL = (
    op1_quality_rules, op2_mix_sources, op3_quality_classifier, op4_repair_token_files, op5_simhash_near_duplicates, op6_toxicity,
    op7_warc_salvage, op8_pack_sequences, op9_vector_search, op10_license_scan, op11_bpe_word_table, op12_whiten_embeddings,
    op13_importance_resampling,
)
QUERIES = {f.__name__: _shipped(f) for f in _ALL}
ORACLES = {"op1_quality_rules": quality_rules.ORACLE, "op2_mix_sources": mixing.oracle(), "op7_warc_salvage": warc_salvage.ORACLE}
