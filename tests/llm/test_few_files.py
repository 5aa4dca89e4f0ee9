"""Narrow tables and results have few files, however many partitions the input and the shuffles have."""

import os
from contextlib import contextmanager

from statloom.llm import merkle, packing, tokens
from statloom.llm._stage import shared_dir
from tests.llm import texts as X

PARTS = 48


@contextmanager
def many_partitions(spark):
    """Shuffles of many partitions, which stay apart as on the check tool's input with hot groups."""
    conf = {"spark.sql.shuffle.partitions": str(PARTS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def few(spark):
    return 2 * spark.sparkContext.defaultParallelism


def part_files(df, path):
    df.write.parquet(path)
    return [f for f in os.listdir(path) if f.startswith("part-")]


def test_packing_has_few_files(spark, tmp_path):
    docs = X.frame(spark, [(k, X.prose(20 + k, k)) for k in range(480)]).repartition(PARTS)
    with many_partitions(spark):
        out = packing.best_fit_pack(docs, tokens.vocabulary("word_bpe_49k.json"), capacity=64)
        assert len(out.inputFiles()) <= few(spark)  # the written pieces
        assert len(part_files(out, str(tmp_path / "out"))) <= few(spark)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r["doc_id"] for r in rows} == set(range(480))
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 64


def test_manifest_has_few_files(spark, tmp_path):
    rows = [(k, f"s{k % 5}", "en", k, X.prose(9, k) + "\n") for k in range(960)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(PARTS)
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    with many_partitions(spark):
        out = merkle.document_manifest(docs)
        tables = [t for t in os.listdir(shared_dir(spark).removeprefix("file:")) if t not in before]
        assert {t.split("-")[0] for t in tables} >= {"leaves", "within", "cells", "peaks", "ups"}
        for t in tables:
            files = os.listdir(os.path.join(shared_dir(spark).removeprefix("file:"), t))
            assert sum(f.startswith("part-") for f in files) <= few(spark), t
        assert len(part_files(out, str(tmp_path / "out"))) <= few(spark)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 960
