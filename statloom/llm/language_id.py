"""Multilingual language identification by mixture inference.

Training counts hashed n-grams of one to four characters, of every labelled
text, for each language.  Prediction treats a text as a mixture: its n-grams are
drawn from languages in unknown proportions, which expectation-maximisation
estimates from the n-gram likelihoods.  The set of languages starts with all and
loses the weakest one as long as that costs less likelihood than the penalty of
``penalty * log(n)`` for each language of the set.  The language with the
largest proportion is the prediction, the proportion its score.

Each batch is solved at once with numpy: a row for each different n-gram of a
text, so the room needed follows the bytes of a batch.  The model has
``BUCKETS`` counts for each language, whatever the corpus.

A text that is null or has no letter is ``und`` with score 0, and so is every
text if nothing was learned.  Labels that are null teach nothing.  Rows that
repeat keep their own results; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

#: Hashed n-grams that are told apart.
BUCKETS = 1 << 14
SIZES = (1, 2, 3, 4)
#: Bytes of text that are solved at once.
SOLVE_BYTES = 1 << 20
UNDETERMINED = "und"
#: Share of a language's penalty to which likelihoods are exact, and the rounds by which they are that at the latest.
TOLERANCE, ROUNDS = 0.01, 2000

_letters: np.ndarray | None = None


def _is_letter(codes: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _letters[codes]


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram) of all n-grams with a letter, and whether each text has a letter.

    White space and signs become one space, letters are lower-cased.
    """
    lowered = [t.lower() for t in texts]
    sizes = np.array([len(t) for t in lowered], np.int64)
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    letter = _is_letter(code)
    has = np.zeros(len(texts), bool)
    has[text[letter]] = True
    keep = letter | np.append(True, letter[:-1])  # one space for each run of other signs
    sign = np.where(letter, code, 32)[keep].astype(np.uint64)
    text, letter = text[keep], letter[keep]
    owners, grams = [], []
    for n in SIZES:
        if len(sign) < n:
            break
        end = len(sign) - n + 1
        whole = text[:end] == text[n - 1 :]
        some = np.zeros(end, bool)
        h = np.full(end, n, np.uint64)
        for k in range(n):
            some |= letter[k : end + k]
            h = h * T._BASE + sign[k : end + k]
        at = whole & some
        owners.append(text[:end][at])
        grams.append((T.mix(h[at]) % np.uint64(BUCKETS)).astype(np.int64))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has
    return np.concatenate(owners), np.concatenate(grams), has


@dataclass(frozen=True)
class LanguageModel:
    """The languages, and the probability of each n-gram in each (rows: n-grams)."""

    languages: tuple[str, ...]
    likelihood: np.ndarray


def _count_rows(batches):
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text")
        _, off = T.string_buffers(texts)
        for i, j in T.slices(off, SOLVE_BYTES):
            owner, gram, _ = _grams([t or "" for t in texts.slice(i, j - i).to_pylist()])
            names, number = np.unique(np.array(langs[i:j], object).astype(str), return_inverse=True)
            flat = np.bincount(number[owner] * BUCKETS + gram, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
            for name, row in zip(names.tolist(), flat, strict=True):
                total[name] = total.get(name, 0) + row
    for name, row in total.items():
        at = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(row[at])], ["lang", "gram", "n"])


def fit_languages(labelled: DataFrame) -> LanguageModel | None:
    """A model from all rows of a table with columns lang and text; None if there are none.

    The driver gets BUCKETS counts for each language.
    """
    rows = labelled.where("lang is not null and text is not null").select("lang", "text")
    counts = rows.mapInArrow(_count_rows, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = counts.toArrow()
    if not table.num_rows:
        return None
    names, number = np.unique(table["lang"].to_numpy().astype(str), return_inverse=True)
    n = np.zeros((BUCKETS, len(names)))
    n[table["gram"].to_numpy(), number] = table["n"].to_numpy()
    n += 0.5
    return LanguageModel(tuple(names.tolist()), n / n.sum(axis=0))


def mixtures(likelihood: np.ndarray, owner: np.ndarray, gram: np.ndarray, texts: int, penalty: float, rounds: int = ROUNDS) -> np.ndarray:
    """The proportions of the languages (columns) in each text (rows); zeros for languages not in its set.

    Each round of expectation-maximisation also bounds how much likelihood is
    still to be won: with ``g`` the mean ratio of a language's likelihood to the
    mixture's, at most ``n * (max(g) - 1)``.  A text is solved until that is
    under TOLERANCE of the penalty, or until the bound decides its set.
    """
    k = likelihood.shape[1]
    flat = owner * BUCKETS + gram
    key = np.sort(flat.astype(np.int32) if texts * BUCKETS < 2**31 else flat).astype(np.int64)  # short keys sort faster
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    key, count = key[first], np.diff(np.append(first, len(key)))
    who, p, count = key // BUCKETS, likelihood[key % BUCKETS], count.astype(float)
    first = np.searchsorted(who, np.arange(texts + 1))
    total = np.bincount(who, weights=count, minlength=texts)
    used = np.flatnonzero(np.diff(first))  # reduceat needs segments with rows
    cost = penalty * np.log(np.maximum(total, 2))

    def solve(start: np.ndarray, some: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and log-likelihood of the texts in ``some``, from a start whose zeros stay.

        A text is done early when its likelihood passes ``target`` or can no longer reach it; nan is no target.
        """
        mix, fit, inside = start.copy(), np.zeros(texts), start > 0
        rows = some[who]
        w, q, c = who[rows], p[rows], count[rows]
        for done in range(1, rounds + 1):
            if not len(w):
                break
            starts = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            ids = w[starts]
            s = np.maximum(np.einsum("ij,ij->i", mix[w], q), 1e-300)
            g = np.add.reduceat(q * (c / s)[:, None], starts, axis=0) / total[ids, None]
            left = total[ids] * (np.where(inside[ids], g, 0).max(axis=1) - 1)
            if done % 2 == 1 or done == rounds:
                fit[ids] = np.add.reduceat(c * np.log(s), starts)
                over = (left <= TOLERANCE * cost[ids]) | (fit[ids] > target[ids]) | (fit[ids] + left <= target[ids])
                if over.any():
                    stays = np.zeros(texts, bool)
                    stays[ids[~over]] = True
                    kept = stays[w]
                    w, q, c = w[kept], q[kept], c[kept]
                    ids, g = ids[~over], g[~over]
            mix[ids] *= g
        return mix, fit

    alone = np.zeros((texts, k))
    if len(used):
        alone[used] = np.add.reduceat(count[:, None] * np.log(p), first[used], axis=0)
    best = np.zeros((texts, k))
    best[np.arange(texts), alone.argmax(axis=1)] = 1
    single = alone.max(axis=1)
    open_ = np.zeros(texts, bool)
    open_[used] = True
    # most texts have one language: more pay only if all together win more than one penalty
    mix, fit = solve(0.97 * best + 0.03 / k, open_, single + cost)
    open_ &= fit > single + cost
    mix[~open_], fit[~open_] = best[~open_], single[~open_]
    mix[open_], fit[open_] = (x[open_] for x in solve(mix, open_, np.full(texts, np.nan))) if open_.any() else (mix[open_], fit[open_])
    for _ in range(k - 1):  # drop the weakest language while that pays
        inside = mix > 0
        open_ &= inside.sum(axis=1) > 1
        if not open_.any():
            break
        fewer = np.where(inside, np.maximum(mix, 1e-3), 0)
        fewer[np.flatnonzero(open_), np.where(inside, mix, np.inf).argmin(axis=1)[open_]] = 0
        fewer /= np.maximum(fewer.sum(axis=1, keepdims=True), 1e-300)
        new, lower = solve(fewer, open_, np.full(texts, np.nan))
        better = open_ & (lower + cost >= fit)
        mix[better], fit[better] = new[better], lower[better]
        open_ = better
    mix[np.diff(first) == 0] = 0
    return mix


def _predict_rows(model: LanguageModel | None, penalty: float, rounds: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            names = [c for c in batch.schema.names if c != "text"]
            _, off = T.string_buffers(texts)
            for i, j in T.slices(off, SOLVE_BYTES):
                said, score = np.full(j - i, UNDETERMINED, object), np.zeros(j - i)
                if model is not None:
                    owner, gram, has = _grams([t or "" for t in texts.slice(i, j - i).to_pylist()])
                    mix = mixtures(model.likelihood, owner, gram, j - i, penalty, rounds)
                    top = mix.argmax(axis=1)
                    said[has] = np.array(model.languages, object)[top[has]]
                    score[has] = np.clip(mix[np.arange(j - i), top][has], 0, 1)
                rest = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(rest.column(c) for c in names), pa.array(said, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    return run


def identify_languages(docs: DataFrame, model: LanguageModel | None, text_col: str = "text", keep: tuple[str, ...] = (), penalty: float = 2.0, rounds: int = ROUNDS) -> DataFrame:
    """The columns ``keep`` of each row, lang_pred and score."""
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("text"))
    kinds = dict(rows.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in keep) + "lang_pred string, score double"
    return rows.mapInArrow(_predict_rows(model, penalty, rounds), schema)


def held_out(id_col: str, folds: int = 5):
    """Whether a row belongs to the fold that teaches nothing."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def language_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document: id, held_out, lang_pred, score; learned from the rows that aren't held out."""
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("out"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"))
    model = fit_languages(rows.where("not out and id is not null"))
    out = identify_languages(rows, model, keep=("id", "out"))
    return out.select(F.col("id").alias(id_col), F.col("out").alias("held_out"), "lang_pred", "score")
