"""Maximal repeats with all their occurrences against every pair of places."""

import hashlib
import random
from collections import defaultdict

import pytest

from statloom.llm import suffix_dedup

from . import texts as X


def maximal(texts, length):
    """{string: its places} of all strings of ``length`` or more that two places share and can't be longer for."""
    at = defaultdict(list)
    for n, b in enumerate(texts):
        for i in range(len(b) - length + 1):
            at[b[i : i + length]].append((n, i))
    found = set()
    for places in at.values():
        for x, (n, i) in enumerate(places):
            for m, j in places[:x]:
                if i and j and texts[n][i - 1] == texts[m][j - 1]:
                    continue
                e = length
                while i + e < len(texts[n]) and j + e < len(texts[m]) and texts[n][i + e] == texts[m][j + e]:
                    e += 1
                found.add(texts[n][i : i + e])
    out = {}
    for s in found:
        out[s] = {(n, i) for n, b in enumerate(texts) for i in range(len(b) - len(s) + 1) if b[i : i + len(s)] == s}
    return out


def groups(spark, texts, length, **options):
    """({string: places} of repeats at several places, {text: copies} of whole copies)."""
    rows = suffix_dedup.repeat_groups(X.frame(spark, list(enumerate(texts))), length=length, **options).collect()
    one = sorted(set(t for t in texts if t))
    place = {hashlib.md5(t.encode()).digest(): n for n, t in enumerate(one)}
    found, whole = defaultdict(set), {}
    for r in rows:
        n = place[bytes(r["k"])]
        assert r["copies"] == texts.count(one[n])
        if r["n"] == 1:
            whole[one[n]] = r["copies"]
        else:
            found[r["h"], r["repeat"], r["n"], r["length"]].add((n, r["start"]))
    out = {}
    for (_, _, n, size), places in found.items():
        strings = {one[k].encode()[i : i + size] for k, i in places}
        assert len(strings) == 1 and len(places) == n
        (s,) = strings
        assert s not in out
        out[s] = places
    return out, whole, [t.encode() for t in one]


def fill(r, n):
    return "".join(r.choices("abcdefgh ", k=n))


@pytest.mark.parametrize("limit", [suffix_dedup.GROUP_LIMIT, 2])
def test_a_shared_passage(spark, limit):
    r = random.Random(8)
    both = fill(r, 500)
    texts = [fill(r, 300) + both + fill(r, 200), fill(r, 50) + both + fill(r, 90), "q" + both[:430] + "q" + fill(r, 20), "short", None, ""]
    got, whole, raw = groups(spark, texts, 400, group_limit=limit)
    assert got == maximal(raw, 400) and whole == {} and sorted(len(p) for p in got.values()) == [2, 3]


@pytest.mark.parametrize("limit", [suffix_dedup.GROUP_LIMIT, 2])
def test_long_repeats_and_copies(spark, limit):
    r = random.Random(9)
    long, copied = fill(r, 2600), fill(r, 3000)
    texts = [fill(r, 100) + long + fill(r, 50), "x" + long + fill(r, 700), fill(r, 30) + long[900:1350] + fill(r, 10), copied, copied, fill(r, 200) + copied[1000:2500], long[:1700] + "é" * 40]
    got, whole, raw = groups(spark, texts, 400, group_limit=limit)
    assert got == maximal(raw, 400) and whole == {copied: 2}
    assert max(map(len, got)) == 2600 and {len(p) for p in got.values()} == {2, 3, 4}


def test_repeats_inside_a_text(spark):
    r = random.Random(10)
    a, b = fill(r, 150), fill(r, 260)
    texts = [a + b + fill(r, 20) + a + b + "z" + a[20:] + b, fill(r, 10) + b + a + b, fill(r, 500)]
    got, whole, raw = groups(spark, texts, 100)
    assert got == maximal(raw, 100) and whole == {}


def test_many_random_texts(spark):
    r = random.Random(11)
    parts = [fill(r, r.randint(30, 400)) for _ in range(7)]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 6))) for _ in range(25)]
    got, whole, raw = groups(spark, texts, 120)
    want = maximal(raw, 120)
    # every group is a maximal repeat with all its occurrences, all short ones are there, and all bytes of the others lie in some
    assert all(want[s] == p for s, p in got.items()) and len(got) > 15
    assert {s for s in want if len(s) <= 120} <= set(got)
    cover = lambda g: {(k, i + j) for s, p in g.items() for k, i in p for j in range(len(s))}
    assert cover(got) == cover(want)
    assert whole == {t: texts.count(t) for t in texts if texts.count(t) > 1 and len(t) >= 120}


def test_groups_of_nothing(spark):
    assert groups(spark, [None, "", "few words"], 400) == ({}, {}, [b"few words"])
    assert suffix_dedup.repeat_groups(X.frame(spark, [])).collect() == []
