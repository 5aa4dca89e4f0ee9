"""Texts and brute-force versions that the operators are held against."""

import random
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def prose(n: int, seed: int, sep: str = " ") -> str:
    r = random.Random(seed)
    return sep.join("".join(r.choice(("ba", "ce", "di", "fo", "gu", "ñé", "ly")) for _ in range(r.randint(1, 4))) for _ in range(n))


def mutated(text: str, rate: float, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(f"x{r.randint(0, 10**6)}" if r.random() < rate else w for w in text.split(" "))


def corpus() -> list[tuple]:
    """(doc_id, text): nulls, empty and long texts, copies, near copies, shared passages, repeats."""
    base, passage = prose(150, 1), prose(90, 2)
    rows = [(0, None), (1, ""), (2, " \t\n\x0b\x0c\r"), (3, "one two"), (4, "ONE two"), (5, "a b c d e"), (6, "a b c d e"), (7, "!"), (None, base), (8, prose(30_000, 3))]
    rows += [(10 + i, base) for i in range(5)]
    rows += [(20 + i, mutated(base, (i % 6) / 60, i)) for i in range(40)]
    rows += [(100 + i, f"{prose(60 + i, 100 + i)} {passage} {prose(40, 200 + i)}") for i in range(12)]
    rows += [(200, "a " * 900), (201, "x " + "a " * 700 + "y"), (202, (prose(12, 5) + "\n") * 30), (203, prose(80, 6).replace(" ", "\n"))]
    rows += [(300, prose(120, 7)), (300, prose(120, 7)), (300, prose(120, 8)), (-5, prose(25, 9)), (2**40, prose(25, 9) + " end")]
    return rows


def frame(spark, rows=None):
    """The corpus with further columns whose names the operators use inside."""
    rows = corpus() if rows is None else rows
    schema = "doc_id long, text string, id string, k int, a double, h string, node string, length int, `od.d` string, rank int, listed int"
    return spark.createDataFrame([(i, t, "x", 1, 2.0, None, "n", 3, "dot", 4, 5) for i, t in rows], schema).repartition(3)


def shingles(text, n=5):
    w = WORD.findall((text or "").translate(_LOWER))
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def jaccard_components(rows, percent=80):
    """{(id, text): (set size, component)} of rows with ids; rows of one id count as one node."""
    ids = [(i, t) for i, t in rows if i is not None]
    sets = {x: shingles(x[1]) for x in ids}
    up = {x: x for x in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    inverted = defaultdict(set)
    for x, s in sets.items():
        for g in s:
            inverted[g].add(x)
    seen = set()
    for group in inverted.values():
        for x in group:
            for y in group:
                if (x[0], x[1] or "") < (y[0], y[1] or "") and (x, y) not in seen:
                    seen.add((x, y))
                    i = len(sets[x] & sets[y])
                    if 100 * i >= percent * (len(sets[x]) + len(sets[y]) - i):
                        a, b = sorted((find(x), find(y)), key=lambda z: (z[0], z[1] or ""))
                        up[b] = a
    low = defaultdict(lambda: 2**62)
    for x in ids:
        low[find(x)] = min(low[find(x)], x[0])
    return {x: (len(sets[x]), low[find(x)] if sets[x] else x[0]) for x in ids}


def cut_repeats(texts, length=400):
    """Per text: (removed, runs, bytes kept)."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((sum(gone), runs, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def pieces(tokenizer, rows, capacity=4096):
    import numpy as np

    out = []
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for p, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s : s + capacity]
            out.append((i, p, s, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=str)
