from collections import Counter

import __spark_entry__ as entry
import corpus_pipeline
from arcseq.llm import line_crf, mixing, packing, quality_rules, simhash_dedup
from arcseq.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_follow_one_another(spark):
    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "quality classifier", "near duplicates", "mix", "pack"]
    before = docs
    for k, (name, fn) in enumerate(corpus_pipeline.STAGES):
        after = fn(spark, before, SF)
        got = Counter(r["doc_id"] for r in after.select("doc_id").collect())
        if name == "quality rules":
            want = Counter(r["doc_id"] for r in quality_rules.quality_rules(before).where("kept").collect())
        elif name == "quality classifier":
            want = Counter(r["doc_id"] for r in line_crf.classify(before, labels).where("predicted = 1").collect())
        elif name == "near duplicates":
            want = Counter({r["component_id"] for r in simhash_dedup.near_duplicates(before).collect()})
        elif name == "mix":
            want = Counter({r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(before).collect() if r["taken"]})
        else:
            want = Counter(r["doc_id"] for r in packing.pack(before).collect())
        assert got == want, name
        if k < 4:
            assert after.columns == columns
            path = f"{spark.conf.get('spark.checkpoint.dir', '/tmp')}/stage-{k}"
            after.write.mode("overwrite").parquet(path)
            before = spark.read.parquet(path)
    assert corpus_pipeline.run(spark, SF).count() == after.count()


def test_first_stage_takes_frequent_lines_out(spark):
    banner = "accept the cookies of this host"
    own = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)) for i in range(40)]
    rows = [(i, f"{banner}\n{t}" if i < 30 else t, "h", i) for i, t in enumerate(own)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, source string, removed long")
    after = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert after.columns == docs.columns
    want = Counter((i, t, "h", i) for i, t in enumerate([*own])) + Counter([(0, own[0], "h", 0)])
    assert Counter(map(tuple, after.collect())) == want


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
