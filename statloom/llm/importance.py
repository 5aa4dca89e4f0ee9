"""Importance resampling with hashed n-gram models.

Two generative models are counted over hashed words and word pairs: one of the
target texts, one of all raw texts.  A text's log importance weight is the sum
of its n-grams' log probability ratios.  Adding standard Gumbel noise to the
log weights and taking the top k draws k texts without replacement with
probabilities in proportion to their weights.

Counts cover all texts and are summed in ``BUCKETS`` cells.  The noise is a
function of the id, the text and the seed, so a lost executor repeats it
exactly.  The k-th largest key is found by counting: in each round the keys'
64-bit order codes are counted by their next bits, and the driver sees 65,536
counts at most, so no task or driver ever holds the keys.  Rows tied with the
k-th key (rows that repeat, but for chance) are all in the sample.

A null text counts as empty and has log weight 0; a null id takes part like any
other row, and so do rows that repeat.  Without target texts all log weights are
0 and the sample is uniform.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._stage import written

#: Hashed n-grams that are told apart.
BUCKETS = 1 << 14
#: N-grams that the prior of the target's model counts for.
PRIOR = 1000.0
#: Ids of target texts are broadcast up to this many rows (8 MB), else joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _gram_numbers(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, n-gram) of the words and word pairs of each text."""
    starts, ends, first = T.word_spans(data, off)
    words = T.mix(T.span_hash(T.prefix_hash(data, lower=True), starts, ends))
    owner = np.repeat(np.arange(len(off) - 1), np.diff(first))
    if len(words) < 2:
        pairs, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    else:
        inside = owner[1:] == owner[:-1]
        pairs, own = T.windows(words, 2)[inside], owner[1:][inside]
    grams = np.concatenate([words, pairs]) % np.uint64(BUCKETS)
    return np.concatenate([owner, own]), grams.astype(np.int64)


def _parts(column: pa.Array):
    data, off = T.string_buffers(column)
    for i, j in T.slices(off):
        yield i, j, _gram_numbers(data[off[i] : off[j]], off[i : j + 1] - off[i])


def _count_rows(batches):
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        good = batch.column("target").to_numpy(zero_copy_only=False).astype(bool)
        for i, j, (owner, gram) in _parts(batch.column("text")):
            raw += np.bincount(gram, minlength=BUCKETS)
            target += np.bincount(gram[good[i:j][owner]], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["gram", "raw", "target"])


def log_ratios(docs: DataFrame) -> np.ndarray:
    """log p_target / p_raw of each n-gram, from a table with columns text and target."""
    counts = docs.select("text", "target").mapInArrow(_count_rows, "gram long, raw long, target long")
    found = counts.groupBy("gram").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = found["gram"].to_numpy()
    raw[at], target[at] = found["raw"].to_numpy(), found["target"].to_numpy()
    if not target.sum():
        return np.zeros(BUCKETS)
    base = (raw + 1) / (raw.sum() + BUCKETS)  # also the prior of the target's model
    return np.log((target / base + PRIOR) / (target.sum() + PRIOR))


def _weight_rows(ratios: np.ndarray):
    def run(batches):
        for batch in batches:
            names = [c for c in batch.schema.names if c != "text"]
            out = np.zeros(batch.num_rows)
            for i, j, (owner, gram) in _parts(batch.column("text")):
                out[i:j] = np.bincount(owner, weights=ratios[gram], minlength=j - i)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out)], [*names, "log_weight"])

    return run


def order_code(values: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of doubles, from 0 up."""
    bits = values.astype(np.float64).view(np.uint64)
    sign = np.uint64(1 << 63)
    return np.where(bits & sign, ~bits, bits | sign)


def _key_rows(batches):
    """Adds the Gumbel key and its order code, split into 16-bit parts from the top."""
    for batch in batches:
        h = batch.column("noise").to_numpy().view(np.uint64)
        u = ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
        key = batch.column("log_weight").to_numpy() - np.log(-np.log(u))
        code = order_code(key)
        parts = [pa.array((code >> np.uint64(s) & np.uint64(0xFFFF)).astype(np.int32)) for s in (48, 32, 16, 0)]
        names = batch.schema.names
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key), *parts], [*names, "key", "c0", "c1", "c2", "c3"])


def kth_largest(rows: DataFrame, k: int, parts: list[str]) -> list[int]:
    """The parts of the k-th largest code (1 <= k <= rows), found by counting one part after the other."""
    bound: list[int] = []
    for part in parts:
        counts = {r[part]: r["count"] for r in rows.groupBy(part).count().collect()}  # 65,536 at most
        for value in sorted(counts, reverse=True):
            if counts[value] >= k:
                break
            k -= counts[value]
        bound.append(value)
        rows = rows.where(F.col(part) == value)
    return bound


def importance_sample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float = 0.5, seed: int = 0) -> DataFrame:
    """Per document: id, log_weight, key and whether the sample of ``fraction`` of all rows has it (selected).

    ``target`` has the ids of target texts in a column of the same name.
    """
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must be between 0 and 1")
    good = target.select(F.col(id_col).cast("long").alias("good")).where("good is not null").distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    good = F.broadcast(good) if good.count() <= BROADCAST_ROWS else good
    marked = rows.join(good, F.col("id") == F.col("good"), "left").select("text", F.col("good").isNotNull().alias("target"))
    ratios = log_ratios(marked)
    noise = F.xxhash64(F.coalesce("id", F.lit(-1)), F.xxhash64("text"), F.lit(seed))
    rows = rows.select("id", noise.alias("noise"), "text").mapInArrow(_weight_rows(ratios), "id long, noise long, log_weight double")
    parts = ["c0", "c1", "c2", "c3"]
    rows = written(rows.mapInArrow(_key_rows, "id long, noise long, log_weight double, key double, c0 int, c1 int, c2 int, c3 int"), "keys")
    total = rows.count()
    k = round(fraction * total)
    if k == 0 or k == total:
        return rows.select(F.col("id").alias(id_col), "log_weight", "key", F.lit(k > 0).alias("selected"))
    limit = F.struct(*[F.lit(b) for b in kth_largest(rows, k, parts)])
    return rows.select(F.col("id").alias(id_col), "log_weight", "key", (F.struct(*parts) >= limit).alias("selected"))
