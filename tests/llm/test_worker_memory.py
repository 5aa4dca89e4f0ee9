"""What a Python worker holds of its texts: small batches, small arrays, and words in arrays."""

import os
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from statloom.llm import jaccard_join, packing, quality_rules, suffix_dedup, tokens
from statloom.llm._stage import BATCH_BYTES, written
from tests.llm import texts as X

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def _batch(n: int = 2_000) -> pa.RecordBatch:
    base = X.prose(700, 1)
    texts = [f"{base[k:]} {k}" for k in range(n)]
    return pa.RecordBatch.from_arrays([pa.array([b"%d" % k for k in range(n)]), pa.array(range(n)), pa.array(texts)], ["k", "id", "text"])


@pytest.mark.parametrize("step", ["quality", "sets", "anchors"])
def test_arrays_of_a_step_stay_small(step):
    batch = _batch()
    assert batch.column("text").nbytes > 6 << 20
    model = quality_rules.QualityModel(np.ones(3 * (1 << quality_rules.BITS) + 1), 1.0, 0.0)
    run = {"quality": quality_rules._score_rows(model, 0.5), "sets": jaccard_join._rows(5, 80, "meta"), "anchors": suffix_dedup._anchor_rows(270, 270)}[step]
    rows = sum(out.num_rows for out in run([batch]))  # tables of powers are made once
    assert rows == batch.num_rows
    tracemalloc.start()
    for _ in run([batch]):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20


def test_encoder_keeps_words_in_arrays(monkeypatch):
    e = tokens.Encoder(tokens.vocabulary("word_bpe_49k.json"))
    words = [f"{X.prose(1, k)}{chr(97 + k % 26)}{X.prose(2, -k, '')}" for k in range(60_000)]
    column = pa.array([" ".join(words[k : k + 100]) for k in range(0, len(words), 100)])
    list(e.encode_rows(pa.array(["one"])))  # tables of powers are made once
    tracemalloc.start()
    for _ in e.encode_rows(column):
        pass
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert e.words > 40_000
    assert kept < 100 * e.words
    want = {i: ids.tolist() for i, ids in e.encode_rows(column)}
    monkeypatch.setattr(tokens, "CACHE_WORDS", 1_000)  # starts afresh on the way
    assert {i: ids.tolist() for i, ids in e.encode_rows(column)} == want
    assert want[5] == e.whole.encode(column[5].as_py(), add_special_tokens=False).ids


@pytest.mark.parametrize("step", ["quality", "copies", "passages", "packing"])
def test_operators_hold_arrow_batches_small(spark, step):
    docs = X.frame(spark, [(k, X.prose(30, k)) for k in range(4)])
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    spark.conf.unset(KEY)
    {
        "quality": lambda: quality_rules.quality_filter(docs, labels),
        "copies": lambda: jaccard_join.near_copy_groups(docs),
        "passages": lambda: suffix_dedup.remove_repeats(docs),
        "packing": lambda: packing.best_fit_pack(docs, tokens.vocabulary("word_bpe_49k.json")),
    }[step]()
    large = spark.range(0, 1_500, 1, 1).selectExpr("repeat('abcdefghij', 1000) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["size", "n"])

    seen = large.mapInArrow(sizes, "size long, n long").collect()
    assert sum(r["n"] for r in seen) == 1_500
    assert max(r["size"] for r in seen) <= BATCH_BYTES + 20_000
    spark.conf.set(KEY, "1000000")  # a limit that is set stays
    quality_rules.fit_quality(docs, labels)
    assert spark.conf.get(KEY) == "1000000"
    spark.conf.unset(KEY)


def test_written_tables_have_few_files(spark):
    many = spark.range(0, 5_000, 1, 40)
    wide, small = written(many, "wide"), written(many, "small", 5_000)
    files = [os.listdir(t._written_at.removeprefix("file:")) for t in (wide, small)]
    assert not [f for names in files for f in names if f.endswith(".crc")]
    parts = [sum(f.startswith("part-") for f in names) for names in files]
    assert parts == [40, 2 * spark.sparkContext.defaultParallelism]
    assert small.agg({"id": "sum"}).first()[0] == wide.agg({"id": "sum"}).first()[0] == 12_497_500
