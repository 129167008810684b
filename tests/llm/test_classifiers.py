import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcseq.llm import license_scan, line_crf, toxicity_pu
from arcseq.llm.common import table
from arcseq.llm.labelled import held_out

SF = "/root/testdata/sf0.01"


def brute_chain(good, trans):
    """Marginals of good, expected transitions and log normaliser of one chain, over all labellings."""
    n = len(good)
    weight = {}
    for ys in itertools.product((0, 1), repeat=n):
        weight[ys] = np.exp(sum(g for g, y in zip(good, ys, strict=True) if y) + sum(trans[a, b] for a, b in zip(ys, ys[1:], strict=False)))
    z = sum(weight.values())
    p = [sum(w for ys, w in weight.items() if ys[t]) / z for t in range(n)]
    pairs = np.zeros((2, 2))
    for ys, w in weight.items():
        for a, b in zip(ys, ys[1:], strict=False):
            pairs[a, b] += w / z
    return p, pairs, np.log(z)


def test_forward_backward_matches_all_labellings():
    rng = np.random.default_rng(0)
    per_doc = np.array([1, 4, 2, 5, 1])
    good, trans = rng.normal(0, 2, per_doc.sum()), rng.normal(0, 1, (2, 2))
    p, pairs, log_z = line_crf.Chains(per_doc).walk(good, trans)
    want = [brute_chain(good[e - k : e], trans) for e, k in zip(np.cumsum(per_doc), per_doc, strict=True)]
    np.testing.assert_allclose(p, np.concatenate([w[0] for w in want]), rtol=1e-9)
    np.testing.assert_allclose(pairs, sum(w[1] for w in want), rtol=1e-9)
    assert log_z == pytest.approx(sum(w[2] for w in want))


def test_line_measures():
    bins, sizes, per_doc = line_bins = line_crf.line_bins([b"", b"a a a\nB! B!", b"\n\n", "é É ***".encode()])
    assert len(line_bins) == 3 and per_doc.tolist() == [1, 2, 3, 1] and sizes.tolist() == [0, 5, 5, 0, 0, 0, 9]
    assert bins[1, 8] > 0 and bins[2, 4 - 1] == bins[2, 3] and (bins < line_crf.BINS).all()


def accuracy(rows, label):
    own = [(r["score"], r[label]) for r in rows if r["held_out"] and r[label] is not None]
    return own


def test_quality_on_held_out_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = line_crf.classify(docs, labels)
    assert got.count() == docs.count()
    rows = got.where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    assert np.mean([r["predicted"] for r in rows if r["quality"] == 1]) > 0.98


def test_toxicity_on_held_out_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = toxicity_pu.classify(docs, labels)
    assert got.count() == docs.count()
    rows = got.where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.9


def test_labels_of_held_out_rows_are_not_read(spark, odd_docs, labels):
    from pyspark.sql import functions as F

    turned = labels.withColumns({c: F.when(held_out(), 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    for model in (line_crf, toxicity_pu):
        a = sorted((str(r["doc_id"]), r["score"]) for r in model.classify(odd_docs, labels).collect())
        b = sorted((str(r["doc_id"]), r["score"]) for r in model.classify(odd_docs, turned).collect())
        assert a == b and len(a) == odd_docs.count() and all(0 <= s <= 1 for _, s in a)


def test_without_labels_or_documents(odd_docs, no_docs, labels, no_labels):
    assert {r["score"] for r in line_crf.classify(odd_docs, no_labels).collect()} == {0.5}
    assert {r["score"] for r in toxicity_pu.classify(odd_docs, no_labels).collect()} == {0.0}
    assert line_crf.classify(no_docs, labels).count() == 0 and toxicity_pu.classify(no_docs, labels).count() == 0
    kept = line_crf.keep_documents(odd_docs, no_labels)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def test_non_negative_risk_does_not_overfit_unlabelled_positives():
    rng = np.random.default_rng(1)

    def evidence(toxic):
        doc, feature = np.nonzero(rng.random((len(toxic), 6)) < np.where(toxic[:, None], [[0.8, 0.7, 0.3, 0.3, 0.3, 0.3]], 0.05))
        return toxicity_pu.Evidence(doc, feature, np.ones(len(doc), int), np.full(len(toxic), 100), 6)

    truth = rng.random(4000) < 0.2
    unlabelled, positive = evidence(truth), evidence(np.ones(300, bool))
    w = toxicity_pu.fit(positive, unlabelled, 0.2)
    said = toxicity_pu.sigmoid(unlabelled.logit(w)) >= 0.5
    assert (said == truth).mean() > 0.93


NOTICES = {
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the MIT License. And then some prose follows that has nothing to do with it at all, as far as one can see.": "MIT",
    "This work is licensed under the GNU General Public License, version 3.": "GPL",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA",
    "All rights reserved.": "Proprietary",
    "SPDX-License-Identifier: MPL-2.0": "MPL-2.0",
}
NO_NOTICE = ["A hunting license is needed here.", "The warranty of the car ran out.", "They had no permission to enter the public domain of the castle."]


def test_licence_families(spark):
    rows = [(i, f"some prose here\n{t}\nand more prose", "s") for i, t in enumerate([*NOTICES, *NO_NOTICE])]
    rows += [(100 + i, " ".join(f"word{(i * 31 + k * 7) % 97} the of and" for k in range(12)), "s") for i in range(60)]
    rows += [(0, rows[0][1], "s"), (None, "All rights reserved.", None), (500, None, None), (501, "", "s"), (502, "license " * 20_000, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in ("h", "family", "words", "paragraph", "w"):
        df = df.selectExpr("*", f"'clash' AS {c}")
    got = license_scan.scan(df).collect()
    sure = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["paragraph"], r["family"]) for r in got if r["confirmed"])
    want = [(i, 1, f) for i, f in enumerate(NOTICES.values())] + [(0, 1, "Apache-2.0"), (-1, 0, "Proprietary")]
    assert sure == sorted(want)
    assert all(r["family"] == license_scan.NO_FAMILY or r["similarity"] < license_scan.SIMILARITY for r in got if not r["confirmed"])


def test_licences_of_empty_tables(no_docs):
    assert license_scan.scan(no_docs).count() == 0


# The first lines of public licence headers, wrapped as they stand in source files.
WRAPPED = {
    "BSD": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are\nmet:",
    "GPL": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "LGPL": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal",
}


def test_wrapped_notices(spark):
    rows = [(i, f"prose before\n\n{t}\n\nprose after") for i, t in enumerate(WRAPPED.values())]
    rows += [(10 + i, "x\n" + "\n".join(f" * {x}" for x in t.split("\n")) + "\n *\n * and more") for i, t in enumerate(WRAPPED.values())]
    # a notice that breaks off at a blank line, and prose around a notice of one line
    rows += [(30, "Redistribution and use in source and binary\n\nforms, with or without modification, are permitted provided"), (31, "She asked for permission to leave.\nLicensed under CC BY 4.0")]
    rows += [(100 + i, " ".join(f"word{(i * 31 + k * 7) % 97} the of and" for k in range(12))) for i in range(60)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("confirmed").collect()
    sure = {(r["doc_id"], r["family"]) for r in got}
    assert sure == {(i + k, f) for k in (0, 10) for i, f in enumerate(WRAPPED)} | {(31, "CC-BY")}
    assert {r["lines"] for r in got if r["doc_id"] == 31} == {1} and max(r["lines"] for r in got) <= license_scan.WINDOW


def test_paragraphs_without_an_anchor_term(spark):
    """Every line with a letter is judged and returned; notices are found that no anchor term leads to."""
    wrapped = "Use of this source code\nis governed by a BSD-style\nlicense"
    cut = "No part of this publication may be reproduced or transmitted in any form without"
    rows = [(0, f"prose before\n\n{wrapped}\n\nprose after\n 12.5 -\n"), (1, f"{cut}\n\nand so on"), (2, "part of this publication is here")]
    rows += [(100 + i, " ".join(f"word{(i * 31 + k * 7) % 97} the of and" for k in range(12))) for i in range(60)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["paragraph"], r["lines"], r["family"]) for r in got if r["confirmed"]} == {(0, 2, 3, "BSD"), (1, 0, 1, "Proprietary")}
    letters = [(i, k) for i, t in rows for k, x in enumerate(t.split("\n")) if any(c.isalpha() for c in x)]
    assert sorted((r["doc_id"], r["paragraph"]) for r in got) == letters and all(r["probability"] > 0 for r in got)


def test_lines_judged_by_features_alone(spark):
    """A line without both bigrams of a template's trigram is judged as `judge` judges it; no line with a trigram is among them."""
    texts = ["of the software", "the general public license version", "work has been seen", "this work is has been dedicated", "nothing at all", "", "use of this source", "version of a car", "in source form"]
    docs = spark.createDataFrame([(1, "\n".join(texts))], "doc_id long, text string")
    notices = license_scan.templates(spark)
    vocabulary = sorted(r[0] for r in notices.select(F.explode(license_scan.features("words"))).distinct().collect())
    counter = license_scan.CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features").setBinary(True)
    lines = license_scan.distinct_lines(docs, counter, license_scan.may_hold_trigram(vocabulary, notices)).cache()
    fitted, model = license_scan.train(lines, counter, notices)
    own = spark.createDataFrame([(t,) for t in texts if t], "text string").select(F.xxhash64("text").alias("h"), "text")
    whole = {r["h"]: r for r in license_scan.judge(own, model).collect()}
    plain = license_scan.judge_by_features(lines.where("text IS NULL"), fitted, model).collect()
    near = {r["h"] for r in lines.where("text IS NOT NULL").collect()}
    assert near | {r["h"] for r in plain} == set(whole) and {h for h, r in whole.items() if r["begun"] > 0} <= near and len(plain) >= 3
    for r in plain:
        assert r["probability"] == pytest.approx(whole[r["h"]]["probability"], rel=1e-9)
        assert all(r[c] == whole[r["h"]][c] for c in ("family", "similarity", "confirmed", "begun"))


def test_probabilities_against_numpy(spark):
    texts = ["Licensed under the MIT license", "nothing of the kind", "", "general public license of the gnu"]
    names, intercepts = ["A", "B", license_scan.NO_FAMILY], [0.1, -0.2, 0.3]
    grams = {"mit": [1.0, 0.0, -1.0], "the mit": [0.5, 0.25, 0.0], "public license": [-1.0, 2.0, 0.0], "gnu": [0.0, 1.5, 0.0]}
    weights = spark.createDataFrame(list(grams.items()), "gram string, w array<double>")
    df = spark.createDataFrame(list(enumerate(texts)), "h long, text string").select("h", license_scan.tokens(F.col("text")).alias("words"))
    for r in license_scan.probabilities(df, weights, names, intercepts).collect():
        words = texts[r["h"]].lower().split()
        own = set(words) | {" ".join(p) for p in zip(words, words[1:])}
        z = np.array(intercepts) + sum((np.array(grams[g]) for g in own if g in grams), np.zeros(3))
        p = np.exp(z) / np.exp(z).sum()
        assert abs(r["best"]["p"] - p[:2].max()) < 1e-12 and r["best"]["family"] == names[int(p[:2].argmax())]


def test_unknown_class_of_every_paragraph(spark):
    """Far more paragraphs than the weight of the class: each is counted once, whatever document holds it."""
    # every third paragraph is repeated by another document, every 100th holds an anchor term
    texts = [f"paragraph {i} of the software" + (" with a warranty" if i % 100 == 0 else "") for i in range(9000)]
    rows = [(i // 3, "\n".join([*texts[i : i + 3], texts[i]])) for i in range(0, 9000, 3)] + [(10_000 + i, texts[i]) for i in range(0, 9000, 3)]
    counter = license_scan.CountVectorizerModel.from_vocabulary(["of the", "software", "the"], "grams", "features")
    got = license_scan.unknown_rows(spark.createDataFrame(rows, "doc_id long, text string"), counter.setBinary(True)).collect()
    assert sum(r["n"] for r in got) == 9000 - 90 and {r["kept_out"] for r in got} == {True, False}
    assert len(got) == 2 and all(list(r["features"].indices) == [0, 1, 2] for r in got)


def test_threshold_counts_every_paragraph(spark):
    rng = np.random.default_rng(3)
    p = np.concatenate([0.5 + rng.random(3000) / 2, np.full(500, 0.75), 0.9 + rng.random(500) * 1e-9])
    n = rng.integers(1, 50, len(p))
    rows = spark.createDataFrame(list(zip(p.tolist(), n.tolist(), strict=True)), "p double, n long")
    for most in (0, 1, 700, 12_345, 40_000, int(n.sum()) - 1):
        got = license_scan.value_exceeded(rows, most, 0.5, 1.0)
        assert got in p and n[p > got].sum() <= most < n[p >= got].sum()
    assert license_scan.value_exceeded(rows, int(n.sum()), 0.5, 1.0) == 0.5
