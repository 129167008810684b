import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from tokenizers import Tokenizer

from arcseq.llm import word_table
from arcseq.llm.word_ids import vocabulary

ODD = [" ", "a b   c", "<|endoftext|> x<|startoftext|>y", "é ́x \x00 z", "don't I'LL </w> a</w>b", "\x1c q\x85r", "x" * 70_000, "the " * 30_000]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    plain = Tokenizer.from_file(vocabulary())
    out = Counter()
    for doc_id, text in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids
        out[doc_id, len(ids), sha(" ".join(map(str, ids))), sha(plain.decode(ids, skip_special_tokens=False))] += 1
    return out


@pytest.mark.parametrize("block_bytes", [200, 8 << 20])
def test_round_trip_equals_the_library(spark, odd_docs, block_bytes):
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    docs = odd_docs.unionByName(more, allowMissingColumns=True)
    got = word_table.decode(word_table.encode(docs, block_bytes=block_bytes, bucket_words=50)).select("doc_id", "ids", "text").collect()
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert Counter((r[0], len(r[1]), sha(" ".join(map(str, r[1]))), sha(r[2])) for r in got) == expected(rows)
    digests = word_table.digests(docs).collect()
    assert Counter(map(tuple, digests)) == expected(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 35) - 1), max_size=40))
def test_packed_numbers(numbers):
    raw, ends = word_table.packed(np.array(numbers, np.int64))
    back, again = word_table.unpacked(raw)
    assert back.tolist() == numbers and again.tolist() == ends.tolist()


def test_many_words_in_a_block(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(70_000))), (2, "w69999 w0")], "doc_id long, text string")
    assert Counter(map(tuple, word_table.digests(docs.coalesce(1)).collect())) == expected([tuple(r) for r in docs.collect()])


def test_each_distinct_word_is_encoded_once(spark):
    docs = spark.createDataFrame([(i, "same words in every document " + str(i % 3)) for i in range(50)], "doc_id long, text string").repartition(5)
    rows = word_table.blocks_of(docs).where("words is not null").collect()
    assert all(len(set(r["words"].split(" "))) == r["n_words"] for r in rows)
    cells = word_table.bucketed(word_table.blocks_of(docs), 2)
    homes = {}
    for r in cells.collect():
        for w in r["words"].split(" "):
            homes.setdefault(w, set()).add(r["bucket"])
    assert all(len(x) == 1 for x in homes.values()) and len(set.union(*homes.values())) > 1


def test_decode_of_stored_ids(spark):
    plain = Tokenizer.from_file(vocabulary())
    sequences = [(1, [49407, 343, 343]), (2, []), (3, None), (4, list(range(0, 49408, 97))), (4, [1])]
    df = spark.createDataFrame(sequences, "key long, ids array<int>")
    got = Counter(map(tuple, word_table.decode(df).select("key", "text").collect()))
    assert got == Counter((k, plain.decode(ids or [], skip_special_tokens=False)) for k, ids in sequences)
    for bad in ([60_000], [-1], [None]):
        with pytest.raises(PySparkException):
            word_table.decode(spark.createDataFrame([(1, bad)], "key long, ids array<int>")).collect()


def test_empty_table(spark, no_docs):
    assert word_table.digests(no_docs).collect() == []
