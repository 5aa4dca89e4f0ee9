"""The corpus pipeline: quality, near copies, repeated passages, leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  Between two
stages the rows are written as Parquet and read again, so a stage never repeats
the work of those before it.  All stages but the last keep the columns of
documents.  A document is a row: ids may be null, repeat or stand for several
texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import decontaminate, jaccard_join, packing, quality_rules, suffix_dedup, tokens
from statloom.llm._stage import written

#: Keys of near copies are broadcast up to this many rows (some 80 MB), else joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Repeated strings of so many bytes go: nearly any passage of over 50 words is as long.
PASSAGE_BYTES = suffix_dedup.PASSAGE


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rules or the quality classifier reject."""
    return quality_rules.quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: the smallest id, null last, then the smallest digest.

    Of rows with equal id and text any one stays.  Texts without words have no copies.
    """
    rows = jaccard_join.near_copy_groups(docs).groupBy("group", "id", "k").agg(F.count(F.lit(1)).alias("n"))
    rows = written(rows, "near-copy-rows")
    key = F.struct(F.col("id").isNull().alias("lost"), "id", "k")
    best = rows.groupBy("group").agg(F.min(key).alias("best"), F.sum("n").alias("size")).where("size > 1")
    marked = rows.join(best.hint("shuffle_merge"), "group").select("id", "k", "n", (key == F.col("best")).alias("stays"))
    marked = written(marked.where("not stays or n > 1"), "near-copies")
    gone, twice = (marked.where(c).select(F.col("id").alias("__id"), F.col("k").alias("__key")) for c in ("not stays", "stays"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__k") == F.col("__key"))
    left = docs.withColumn("__k", F.unhex(F.md5(F.col("text").cast("string").cast("binary"))))
    left = left.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, same, "left_anti")
    if not twice.isEmpty():
        twice = F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice
        left = left.join(twice, same, "left_anti").unionByName(left.join(twice, same, "left_semi").dropDuplicates(["doc_id", "__k"]))
    return left.drop("__k")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of PASSAGE_BYTES bytes that occur elsewhere; n_chars follows the text."""
    left = suffix_dedup.remove_repeats(docs, length=PASSAGE_BYTES)
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark items."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens."""
    return packing.best_fit_pack(docs, tokens.vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_copies),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", leaks),
    ("best_fit_packing", packed),
]

#: Classifier, shingle components and tokens are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
