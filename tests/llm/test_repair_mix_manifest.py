"""Conversation repair, source mixing and dataset manifests against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from statloom.llm import merkle, mixing, repair

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


# conversation repair


def repaired(rows):
    """{conversation: expected rows}, by a forward table over all edits."""
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, [])
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if k:
            x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
            by[c] += [(t, "user" if k == 4 else r, x)] * (1 + (k == 3))
    out = []
    for c, turns in by.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, r, x in turns:
            s = x.rstrip(" \t\n\x0b\x0c\r")
            faults.append("b" if not s else "d" if (r, x) in seen else "t" if s[-1] not in ".!?" else "")
            seen.add((r, x))

        def spread(best):
            for _ in range(3):
                for q, (cost, audit, said) in list(best.items()):
                    n = "a" if q == "u" else "u"
                    way = (cost + 3, audit + "I", said + [("user" if n == "u" else "assistant", "")])
                    if n not in best or way[:2] < best[n][:2]:
                        best[n] = way
            return best

        best = spread({"": (0, "", [])})
        for (_, r, x), f in zip(turns, faults, strict=True):
            ways = []
            for q, (cost, audit, said) in best.items():
                n = "a" if q == "u" else "u"
                ways.append((q, (cost + 4, audit + "D", said)))
                if f in ("", "t"):
                    more = cost + 3 * (f == "t")
                    if r[:1] == n or (r[:1] == "s" and not q):
                        ways.append((r[0], (more, audit + "K", [*said, (r, x)])))
                    ways.append((n, (more + 3, audit + "R", [*said, ("user" if n == "u" else "assistant", x)])))
            best = {}
            for q, way in ways:
                if q not in best or way[:2] < best[q][:2]:
                    best[q] = way
            best = spread(best)
        cost, audit, said = min((best[q] for q in ("", "a") if q in best), key=lambda w: w[:2])
        known = {t for t, _, _ in turns if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out.append((c, max(known) - min(known) + 1 - len(known) if known else 0, *map(faults.count, "bdt"), illegal, cost, audit, H("\n".join(f"{r}:{x}" for r, x in said))))
    return Counter(out)


def talks():
    r = random.Random(5)
    rows = [(None, 0, "user", "a?"), (None, 1, "assistant", "b."), (7, None, "user", "x"), (7, None, None, None), (7, 3, "assistant", "y. "), (8, 2, "", ""), (9, 0, "tool", "t.")]
    for c in range(10, 60):
        rows += [(c, r.choice((None, *range(9))), r.choice(("system", "user", "assistant", "user", "assistant", "tool", None)), r.choice(("ok.", "why?", "cut", " ", "", "\t.\n", None, "yes!", "é.", "so"))) for _ in range(r.randint(1, 12))]
    rows += [(100, i, r.choice(("user", "assistant")), r.choice(("ok.", "cut", "", f"n{i}.", f"n{i}"))) for i in range(400)]
    rows += [(101, 5, "user", "same.")] * 70 + [(102, i, "user", f"{i}. " + "long " * 20_000) for i in range(3)]
    return rows


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, g string, kind int").repartition(5)


@pytest.mark.parametrize("piece", [1024, 7, 1])
def test_repair_equals_brute_force(spark, piece):
    got = repair.repair_report(turns(spark, talks()), piece)
    assert Counter(map(tuple, got.collect())) == repaired(talks())


def test_repair_of_nothing(spark):
    assert repair.repair_report(turns(spark, [])).collect() == []
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert [tuple(r) for r in repair.repair_report(turns(spark, [(dropped, 0, "user", "gone.")])).collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "", H(""))]


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "assistant", "a."), (2, 0, "user", "q?"), (2, 1, "user", "r?"), (2, 2, "assistant", "z.")]
    got = [tuple(r) for r in repair.repaired_turns(turns(spark, rows)).orderBy("conv_id", "position").collect()]
    assert got == [(1, 0, "system", "s."), (1, 1, "user", ""), (1, 2, "assistant", "a."), (2, 0, "user", "q?"), (2, 1, "assistant", ""), (2, 2, "user", "r?"), (2, 3, "assistant", "z.")]


# mixing


def targets(sizes, weights=(5, 2, 1), limit=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, held = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in held]
        level = (total - sum(limit * sizes[s] for s in held)) / sum(w[s] for s in free) if free else 0
        above = {s for s in free if w[s] * level >= limit * sizes[s]}
        if not above:
            return {s: float(limit * sizes[s]) if s in held else w[s] * level for s in names}
        held |= above


def mixed_docs():
    r = random.Random(3)
    rows = [(None, "one two", "a"), (1, None, "a"), (2, "", None), (3, "x " * 30_000, "a"), (4, " \t", "empty")]
    rows += [(10 + i, "w " * r.randint(0, 60), r.choice(("a", "a", "b", "c", "ö", None))) for i in range(900)]
    return rows + [(5000, "tie tie", "b")] * 200


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "n", 2.0) for r in rows], "doc_id long, text string, source string, size int, pos string, target double").repartition(4)


@pytest.mark.parametrize("block, merge", [(4096, 2048), (50, 3)])
def test_mix(spark, monkeypatch, block, merge):
    monkeypatch.setattr(mixing, "BLOCK", block)
    monkeypatch.setattr(mixing, "MERGE", merge)
    rows = mixed_docs()
    got = mixing.mix_sources(docs(spark, rows)).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = targets(sizes)
    assert Counter((r[0], r["size"], r["source_size"], round(r["target"], 6)) for r in got) == Counter((i, len(WORD.findall(t or "")), sizes[s], round(want[s], 6)) for i, t, s in rows)
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    assert all(r["taken"] % r["size"] == 0 and r["taken"] <= 3 * r["size"] if r["size"] else r["taken"] == 0 for r in got)
    by = Counter()
    for r in got:
        by[r["source_size"]] += r["taken"]
    for s, t in want.items():
        assert abs(by[sizes[s]] - t) <= (30_000 if s == "a" else 60), s
    again = mixing.mix_sources(docs(spark, rows).repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mix_of_nothing(spark):
    assert mixing.mix_sources(docs(spark, [])).collect() == []
    assert [tuple(r) for r in mixing.mix_sources(docs(spark, [(1, None, None)])).collect()] == [(1, 0, 0, 0.0, 0)]


def test_flight_keeps_sums_and_probabilities():
    r, size = random.Random(1), np.array([900.0, 40, 40, 7, 3, 3, 2, 1, 0, 0])
    p, hits = np.array([0.3, 0.5, 0.2, 0.9, 0.4, 0.7, 0.1, 0.5, 0.6, 0.8]), np.zeros(10)
    for _ in range(3000):
        q = mixing.flight(p, size, r)
        assert ((q > 0) & (q < 1)).sum() <= 2
        assert abs(q.sum() - p.sum()) < 1e-6 and abs(q @ size - p @ size) < 1e-6
        hits += q
    assert np.abs(hits / 3000 - p).max() < 0.04
    kept = np.zeros(2)
    for _ in range(4000):
        units = [[0.3, 5, 0], [0.8, 9, 1]]
        mixing.land(units, r)
        kept += [u[0] for u in units]
    assert np.abs(kept / 4000 - [0.3, 0.8]).max() < 0.04


# manifests


def manifest(rows):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r):
        return H("".join(map(field, r)))

    def tree(level):
        out = [level]
        while len(out[-1]) > 1:
            out.append([H("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
        return out

    def path(levels, i):
        for level in levels[:-1]:
            a = i - i % 3
            yield "".join(level[a:i]), "".join(level[i + 1 : a + 3])
            i //= 3

    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    for v in by.values():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([leaf(r) for r in by[s]]) for s in names]
    top = tree([t[-1][0] for t in trees])
    out = Counter()
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            steps, at = [*path(trees[k], i), *path(top, k)], leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                at = leaf((*r[:4], r[4].replace("\n", "")))
            for x, y in steps:
                at = H(x + at + y)
            out[(r[0], leaf(r), trees[k][-1][0], top[-1][0], H("".join(x + y for x, y in steps)), at, at == top[-1][0])] += 1
    return out


def records(sizes):
    r, rows = random.Random(8), []
    for s, n in sizes.items():
        rows += [(r.randint(-99, 10**6), s, r.choice(("en", None)), r.choice((None, 5)), r.choice(("a\nb", "é", "", None, "line\n" * 3))) for _ in range(n)]
    return rows


def listed(spark, rows):
    return spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, key string, i int").repartition(6)


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 1, "b": 3}, {None: 4, "": 9, "z": 10, "é": 28, "hot": 700}, {f"s{k}": 1 + k % 5 for k in range(40)}], ids=str)
@pytest.mark.parametrize("peaks, band", [(4096, 7), (1, 2)])
def test_manifest_equals_brute_force(spark, monkeypatch, sizes, peaks, band):
    monkeypatch.setattr(merkle, "PEAKS", peaks)
    monkeypatch.setattr(merkle, "BAND", band)
    rows = records(sizes)
    rows += [rows[0]] * 2 + [(None, next(iter(sizes)), None, None, "t\n" * 50_000)]
    assert Counter(map(tuple, merkle.document_manifest(listed(spark, rows)).collect())) == manifest(rows)


def test_manifest_of_nothing(spark):
    assert merkle.document_manifest(listed(spark, [])).collect() == []


def test_stack_at_any_cut():
    r = random.Random(2)
    for size in (1, 2, 3, 4, 9, 10, 27, 82, 200):
        leaves = [("k", size, 0, i, H(str(i))) for i in range(size)]
        want = {x[2:] for _, x in merkle.stacked(iter(leaves))}
        cuts = sorted({0, size, *(r.randint(0, size) for _ in range(4))})
        made, peaks = set(), []
        for a, b in zip(cuts, cuts[1:]):
            for is_open, node in merkle.stacked(iter(leaves[a:b])):
                (peaks.append if is_open else made.add)(node if is_open else node[2:])
        for is_open, node in merkle.stacked(iter(peaks)):
            made.add(node[2:])
            assert not is_open or merkle._count(size, node[2]) == 1
        assert made == want


def test_manifest_of_bytes_that_are_no_utf8(spark):
    docs = spark.range(12).selectExpr("id AS doc_id", "'a' AS source", "'en' AS lang", "1L AS n_chars", "CAST(IF(id < 6, X'61FF62', X'61FF0A62') AS STRING) AS text")
    rows = merkle.document_manifest(docs).collect()
    # line breaks go, all other bytes stay: only rows that have some can be told from what was listed
    assert {r["doc_id"] for r in rows if not r["verified"]} == {k for k in range(6, 12) if zlib.crc32(str(k).encode()) % 2 == 0}
    field = lambda v: b"%d:%b" % (len(v), v)
    assert rows[0]["leaf"] == hashlib.sha256(field(b"0") + field(b"a") + field(b"en") + field(b"1") + field(b"a\xffb")).hexdigest()
