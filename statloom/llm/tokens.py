"""Token ids of Arrow text columns.

The tokenizer splits texts into pre-tokens (letters, digits, other signs) and
merges bytes within each.  Natural text repeats its words, so a column is split
with numpy, each different word is merged once, and the ids are gathered.  This
covers texts of Latin letters and common signs; the others, and texts with the
strings of special tokens, go through the tokenizer itself.  Both give the ids
that ``tokenizers`` gives.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from . import _text as T

#: Different words that a worker keeps (some 20 MB, in arrays); beyond, it starts afresh.
CACHE_WORDS = 400_000
#: The pre-token pattern that the fast path stands for.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SIZE = 0x2028


@lru_cache
def _classes() -> np.ndarray:
    """0 white space, 1 letter, 2 digit, 3 other sign, 9 not on the fast path, by code point."""
    import regex

    out = np.full(0x10000, 9, np.uint8)
    for c in [*range(0x300), *range(0x2010, _SIZE)]:
        s = chr(c)
        out[c] = 0 if regex.match(r"\s", s) else 1 if regex.match(r"\p{L}", s) else 2 if regex.match(r"\p{N}", s) else 3
    return out


def _byte_signs() -> list[str]:
    """The sign that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Encoder:
    """A tokenizer with a cache of words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        import json

        # the parts' own settings: those of the whole have the vocabulary in them
        split, normal = (json.loads(x.__getstate__()) if x else {} for x in (self.whole.pre_tokenizer, self.whole.normalizer))
        steps = split.get("pretokenizers", [{}])
        kinds = [n["type"] for n in normal.get("normalizers", [])]
        self.fast = steps[0].get("pattern") == {"Regex": SPLIT} and [s["type"] for s in steps] == ["Split", "ByteLevel"] and kinds == ["NFC", "Replace", "Lowercase"]
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.signs = _byte_signs()
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # of all words, ascending
        self.numbers = np.zeros(0, np.int32)  # of the words of these keys
        self.flat = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)  # ends[i + 1]: where word i ends
        self.words = self.used = 0

    def _add(self, word: str) -> int:
        signs = self.signs
        ids = [t.id for t in self.whole.model.tokenize("".join([signs[b] for b in word.encode()]))]
        n = self.words
        end = self.used + len(ids)
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        if n + 2 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(len(self.ends), np.int64)])
        self.flat[self.used : end] = ids
        self.ends[n + 1] = self.used = end
        self.words = n + 1
        return n

    def _numbers(self, keys: np.ndarray, first: np.ndarray, word) -> np.ndarray:
        """The numbers of words by their keys, which ascend; ``word(f)`` is a word that begins at ``f``."""
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        out = np.empty(len(keys), np.int64)
        out[known] = self.numbers[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = [self._add(word(f)) for f in first[new].tolist()]
            self.keys = np.insert(self.keys, at[new], keys[new])
            self.numbers = np.insert(self.numbers, at[new], out[new])
        return out

    def encode_rows(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of each text, nulls as empty texts, in any order."""
        _, off = T.string_buffers(column)
        for i, j in T.slices(off):
            texts = [t or "" for t in column.slice(i, j - i).to_pylist()]
            simple, hard = [], []
            for k, t in enumerate(texts):
                # characters beyond the table, or that change their number when lowered, are hard
                if self.fast and not any(s in t for s in self.special) and len(low := t.lower()) == len(t):
                    simple.append((i + k, low))
                else:
                    hard.append((i + k, t))
            yield from self._fast_rows(simple, hard, {i + k: t for k, t in enumerate(texts)})
            for k, t in hard:
                yield k, np.array(self.whole.encode(t, add_special_tokens=False).ids, np.uint32)

    def _fast_rows(self, rows: list[tuple[int, str]], hard: list, texts: dict[int, str]):
        if not rows:
            return
        # one white space after each text keeps pre-tokens within it
        joined = "\n".join(t for _, t in rows) + "\n"
        code = np.frombuffer(joined.encode("utf-16-le", "surrogatepass"), np.uint16)
        if len(code) != len(joined) or (_classes()[code] == 9).any():
            ok = []
            for k, t in rows:
                c = np.frombuffer(t.encode("utf-16-le", "surrogatepass"), np.uint16)
                (hard if len(c) != len(t) or (_classes()[c] == 9).any() else ok).append((k, t))
            hard[:] = [(k, texts[k]) for k, _ in hard]
            if len(ok) < len(rows):
                yield from self._fast_rows(ok, hard, texts)
                return
        kind = _classes()[code]
        fresh = np.empty(len(code), bool)
        fresh[0] = True
        np.not_equal(kind[1:], kind[:-1], out=fresh[1:])
        fresh |= kind == 2
        sign = np.flatnonzero((code == 0x27) & fresh)
        if len(sign):
            sign = sign[kind[sign + 1] == 1]  # the last sign of all is white space
            one, two = code[sign + 1], code[np.minimum(sign + 2, len(code) - 1)]
            n = np.isin(one, [ord(c) for c in "stmd"]).astype(np.int64)
            for a, b in ("re", "ve", "ll"):
                n[(one == ord(a)) & (two == ord(b))] = 2
            sign, n = sign[n > 0], n[n > 0]
            fresh[sign + 1] = False
            after = sign + 1 + n
            fresh[after[kind[after] == 1]] = True
        starts = np.flatnonzero(fresh)
        ends = np.append(starts[1:], len(code))
        word = kind[starts] != 0
        starts, ends = starts[word], ends[word]
        up, _ = T._power_tables(len(code) + 1)
        sums = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(T.mix(np.arange(0x10000, dtype=np.uint64) + np.uint64(1))[code] * up[: len(code)], out=sums[1:])
        keys, first, inverse = np.unique(T.mix(T.span_hash(sums, starts, ends)), return_index=True, return_inverse=True)
        if self.words > CACHE_WORDS:
            self.clear()
        index = self._numbers(keys, first, lambda f: joined[starts[f] : ends[f]])[inverse]
        begin, size = self.ends[index], self.ends[index + 1] - self.ends[index]
        total = np.cumsum(size)
        where = np.repeat(begin - total + size, size) + np.arange(total[-1] if len(total) else 0)
        ids = self.flat[where]
        bounds = np.cumsum([len(t) + 1 for _, t in rows])
        last = np.searchsorted(starts, bounds)
        stops = np.append(0, total)[last]
        a = 0
        for (k, _), b in zip(rows, stops.tolist(), strict=True):
            yield k, ids[a:b]
            a = b


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, kept by the worker."""
    return Encoder(path)


def vocabulary(name: str, folder: str | None = None) -> str:
    """The path of a public tokenizer's file; ``folder`` overrides where they lie."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
