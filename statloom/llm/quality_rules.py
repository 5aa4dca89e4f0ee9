"""Quality rules and a hashed n-gram classifier, scored in Arrow batches.

Base counts of a whole text decide first: too few words, or too many words in
8-word windows that recur.  The other texts get a calibrated probability of
being good from a logistic regression on hashed word and character n-grams, and
are kept from a fixed threshold on.

The model is fitted on a bounded sample of labelled rows: ``rows`` of each
label, the first ones in the order of a hash of the id, half of them for the
calibration if there are enough.  An id that repeats gives the sample the text
with the smallest digest.  Counting and scoring cover every text whole.

Features are relative frequencies of hashed words, word pairs and four-byte
strings, so a text's length does not matter, and long texts need no more room
than their bytes.  A null text counts as empty and fails the base rule; labels
that are null, or belong to no text, are left out; if one of the labels has no
rows, every text that passes the base rule is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._stage import small_batches

#: Hashed features of each kind: words, word pairs, four-byte strings.
BITS = 14
_D = 1 << BITS
_KINDS = 3
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
MIN_WORDS = 20
REPEAT_PERCENT = 30
REPEAT_WINDOW = 8


@dataclass(frozen=True)
class QualityModel:
    """Weights of the hashed features and the calibration of their sum."""

    weights: np.ndarray
    scale: float
    shift: float


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values, dtype=np.int64 if values.dtype.kind in "bi" else np.float64))
    return total[off[1:]] - total[off[:-1]]


def _owner(first: np.ndarray) -> np.ndarray:
    """The text of each item, from each text's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key occurs twice or more, and whether it occurred before."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = np.append(False, s[1:] == s[:-1]) if len(s) else np.zeros(0, bool)
    twice = same | (np.append(same[1:], False) if len(s) else same)
    a, b = np.empty(len(keys), bool), np.empty(len(keys), bool)
    a[order], b[order] = twice, same
    return a, b


class _Part:
    """Words and hashes of a slice of a column."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off
        self.starts, self.ends, self.first = T.word_spans(data, off)
        self.sums = T.prefix_hash(data)
        self.words = T.mix(T.span_hash(self.sums, self.starts, self.ends))

    def counts(self) -> dict[str, np.ndarray]:
        data, off, first = self.data, self.off, self.first
        n_words = np.diff(first)
        own = _owner(first).astype(np.uint64)
        salt = T.mix(own + np.uint64(1))
        # 8-word windows that recur within their text
        w = REPEAT_WINDOW
        covered = np.zeros(len(self.words) + 1, np.int32)
        if len(self.words) >= w:
            inside = own[: len(own) - w + 1] == own[w - 1 :]
            keys = T.windows(self.words, w) + salt[: len(own) - w + 1]
            at = np.flatnonzero(inside)
            twice = at[_repeats(keys[at])[0]]
            np.add.at(covered, twice, 1)
            np.add.at(covered, twice + w, -1)
        covered = np.cumsum(covered[:-1]) > 0
        # lines: each text ends its last one
        breaks = np.flatnonzero(data == 0x0A)
        lo = np.sort(np.concatenate([off[:-1], breaks + 1]))
        line_first = np.searchsorted(breaks, off) + np.arange(len(off))
        hi = np.sort(np.concatenate([breaks, off[1:]]))
        worded = np.searchsorted(self.starts, hi) > np.searchsorted(self.starts, lo)
        line_own = _owner(line_first).astype(np.uint64)
        keys = T.mix(T.span_hash(self.sums, lo, hi)) + T.mix(line_own + np.uint64(1))
        again = np.zeros(len(lo), bool)
        again[worded] = _repeats(keys[worded])[1]
        return {
            "n_words": n_words,
            "word_chars": _sums(~T._SEP[data] & ((data & 0xC0) != 0x80), off),
            "n_symbols": _sums(_SYMBOL[data], off),
            "n_dup_lines": _sums(again, line_first),
            "n_repeat_words": _sums(covered, first),
        }

    def grams(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(feature numbers, each text's first) of words, word pairs and four-byte strings."""
        one = (self.words >> np.uint64(64 - BITS)).astype(np.int64)
        pair, pair_first = np.zeros(0, np.int64), np.zeros_like(self.first)
        if len(self.words) > 1:
            inside = _owner(self.first)
            same = inside[1:] == inside[:-1]
            pair = (T.windows(self.words, 2)[same] >> np.uint64(64 - BITS)).astype(np.int64)
            pair_first = self.first - np.append(0, np.cumsum(np.diff(self.first) > 0))
        d = self.data.astype(np.uint32)
        four, four_first = np.zeros(0, np.int64), self.off.copy()
        if len(d) > 3:
            x = d[:-3] | d[1:-2] << np.uint32(8) | d[2:-1] << np.uint32(16) | d[3:] << np.uint32(24)
            x = (x * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
            size = np.maximum(np.diff(self.off) - 3, 0)
            at = np.arange(len(x))
            text = np.searchsorted(self.off, at, side="right") - 1
            keep = at < self.off[1:][text] - 3
            four, four_first = x[keep].astype(np.int64), np.append(0, np.cumsum(size))
        else:
            four_first = np.zeros_like(self.off)
        return [(one, self.first), (pair + _D, pair_first), (four + 2 * _D, four_first)]

    def logits(self, weights: np.ndarray) -> np.ndarray:
        total = np.full(len(self.off) - 1, weights[-1])
        for ids, first in self.grams():
            total += _sums(weights[ids], first) / np.maximum(np.diff(first), 1)
        return total


def _parts(column: pa.Array):
    data, off = T.string_buffers(column)
    for i, j in T.slices(off):
        yield i, j, _Part(data[off[i] : off[j]], off[i : j + 1] - off[i])


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _score_rows(model: QualityModel | None, threshold: float):
    def run(batches):
        for batch in batches:
            for i, j, part in _parts(batch.column("text")):
                n = part.counts()
                failed = (n["n_words"] < MIN_WORDS) | (100 * n["n_repeat_words"] > REPEAT_PERCENT * n["n_words"])
                if model is None:
                    p = np.ones(j - i)
                else:
                    p = 1 / (1 + np.exp(-np.clip(model.scale * part.logits(model.weights) + model.shift, -50, 50)))
                rest = batch.slice(i, j - i)
                cols = [c for k, c in zip(batch.schema.names, rest.columns, strict=True) if k != "text"]
                names = [k for k in batch.schema.names if k != "text"]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(n[c].astype(np.int64)) for c in _COUNTS), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))], [*names, *_COUNTS, "base_failed", "quality", "kept"])

    return run


def _feature_rows(batches):
    """The features of a text with their relative frequencies, as bytes."""
    for batch in batches:
        labels, ids = batch.column("y").to_pylist(), batch.column("id").to_pylist()
        for i, j, part in _parts(batch.column("text")):
            rows = []
            grams = part.grams()
            for k in range(j - i):
                where, value = [], []
                for nums, first in grams:
                    u, c = np.unique(nums[first[k] : first[k + 1]], return_counts=True)
                    where.append(u.astype(np.int32))
                    value.append((c / max(1, first[k + 1] - first[k])).astype(np.float32))
                rows.append((ids[i + k], labels[i + k], np.concatenate(where).tobytes(), np.concatenate(value).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), pa.binary(), pa.binary()], strict=True)], ["id", "y", "where", "value"])


def _fit(where: list[np.ndarray], value: list[np.ndarray], y: np.ndarray, weight: np.ndarray, l2: float, steps: int) -> np.ndarray:
    """Weights of a logistic regression, by accelerated gradient steps."""
    n, size = len(y), np.array([len(w) for w in where])
    cols, vals = np.concatenate(where).astype(np.int64), np.concatenate(value).astype(np.float64)
    rows = np.repeat(np.arange(n), size)
    norm = np.bincount(cols, weights=vals * vals, minlength=_KINDS * _D) / n
    unit = np.append(1 / np.sqrt(norm + 1e-4 * norm.max() + 1e-12), 1.0)  # features of like size
    vals = vals * unit[cols]
    w = v = np.zeros(_KINDS * _D + 1)
    sq = np.bincount(rows, weights=vals * vals, minlength=n) + 1
    rate = 4 / (np.sum(weight * sq) / np.sum(weight) + l2)
    for step in range(steps):
        z = np.bincount(rows, weights=vals * v[cols], minlength=n) + v[-1]
        err = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / np.sum(weight)
        grad = np.bincount(cols, weights=vals * err[rows], minlength=_KINDS * _D + 1)
        grad[-1] = err.sum()
        new = v - rate * (grad + l2 * np.append(v[:-1], 0.0))
        v = new + step / (step + 3) * (new - w)
        w = new
    return w * unit


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logit, by Newton steps on smoothed targets."""
    good, bad = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        e, s = p - t, p * (1 - p) + 1e-9
        g = np.array([np.sum(e * z), np.sum(e)])
        h = np.array([[np.sum(s * z * z), np.sum(s * z)], [np.sum(s * z), np.sum(s)]]) + 1e-3 * np.eye(2)
        d = np.linalg.solve(h, g)
        size = np.abs(d).max()
        d = d / max(1.0, size / 2)
        a, b = a - d[0], b - d[1]
        if size < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = 1500, l2: float = 1e-3, steps: int = 150) -> QualityModel | None:
    """A model from at most ``rows`` labelled texts of each label (1 is good); None without both labels."""
    small_batches(docs.sparkSession)
    y = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    y = y.groupBy("id").agg(F.max("y").alias("y"))
    parts = [y.where(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(rows) for k in (0, 1)]
    few = parts[0].unionByName(parts[1])  # at most 2 * rows rows
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    one = F.min_by("text", F.md5(F.coalesce("text", F.lit("")).cast("binary")))  # an id may repeat: one text stands for it
    found = texts.join(F.broadcast(few), "id").groupBy("id", "y").agg(one.alias("text")).mapInArrow(_feature_rows, "id long, y int, where binary, value binary").collect()
    found.sort(key=lambda r: (r["id"], bytes(r["where"])))
    target = np.array([r["y"] for r in found], np.float64)
    if len(set(target)) < 2:
        return None
    where = [np.frombuffer(r["where"], np.int32) for r in found]
    value = [np.frombuffer(r["value"], np.float32) for r in found]
    order = np.argsort([r["id"] * 2654435761 % 2**32 for r in found], kind="stable")
    half = order[::2] if min((target == k).sum() for k in (0, 1)) >= 50 else order
    rest = np.setdiff1d(order, half) if len(half) < len(order) else order

    def learn(at: np.ndarray) -> np.ndarray:
        t = target[at]
        weight = np.where(t > 0, 1 / max(1, t.sum()), 1 / max(1, (1 - t).sum()))
        return _fit([where[k] for k in at], [value[k] for k in at], t, weight, l2, steps)

    first = learn(half)
    z = np.array([first[where[k]] @ value[k] + first[-1] for k in rest])
    scale, shift = _calibrate(z, target[rest])
    return QualityModel(first, scale, shift)


def quality_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.5, rows: int = 1500) -> DataFrame:
    """Per document: id, the base counts, base_failed, quality (a probability), kept."""
    model = fit_quality(docs, labels, id_col, text_col, label_col, rows)
    small = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = small.mapInArrow(_score_rows(model, threshold), "id long, " + "".join(f"{c} long, " for c in _COUNTS) + "base_failed boolean, quality double, kept boolean")
    return out.withColumnRenamed("id", id_col)


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.5, rows: int = 1500) -> DataFrame:
    """The rows of documents that the rules keep, with all their columns."""
    model = fit_quality(docs, labels, id_col, text_col, label_col, rows)
    keep = _score_rows(model, threshold)
    names = list(docs.columns)
    plainly = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names with dots don't reach Arrow functions
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            plain = pa.RecordBatch.from_arrays([batch.column(at)], ["text"])
            kept = [out.column(out.schema.names.index("kept")) for out in keep([plain])]
            if kept:
                yield batch.filter(pa.concat_arrays(kept))

    return plainly.mapInArrow(run, plainly.schema).toDF(*names)
