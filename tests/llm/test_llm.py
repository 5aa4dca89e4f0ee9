import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from statloom.llm import chat_format, decontaminate, importance, jaccard_join, language_id, license_scan, packing, quality_rules, suffix_dedup, tokens, url_filter
from statloom.llm import registry as llm_registry

from . import texts as X


@pytest.fixture(scope="module")
def docs(spark):
    return X.frame(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return X.frame(spark, [])


# 1. n-gram Jaccard join


def test_jaccard_join_equals_brute_force(spark, docs):
    rows = X.corpus()
    want = Counter((i, *v) for i, t in rows if i is not None for v in [X.jaccard_components([r for r in rows])[(i, t)]])
    got = Counter(map(tuple, jaccard_join.ngram_jaccard_join(docs).collect()))
    assert got.pop((None, len(X.shingles(X.prose(150, 1))), None)) == 1
    assert got == want
    assert len({c for _, _, c in got if c != -5}) < len(rows) - 15


def test_jaccard_join_of_nothing(empty):
    assert jaccard_join.ngram_jaccard_join(empty).collect() == []


def test_jaccard_join_other_parameters(spark):
    rows = [(i, X.mutated(X.prose(40, i % 3), 0.02 * (i % 5), i)) for i in range(30)]
    got = {r[0]: r[1] for r in jaccard_join.ngram_jaccard_join(X.frame(spark, rows), n=2, percent=60).select("doc_id", "component_id").collect()}
    sets = {i: {tuple(w) for w in zip(t.split(), t.split()[1:])} for i, t in rows}
    for i, _ in rows:
        for j, _ in rows:
            both = len(sets[i] & sets[j])
            if 100 * both >= 60 * (len(sets[i]) + len(sets[j]) - both):
                assert got[i] == got[j]
    with pytest.raises(ValueError):
        jaccard_join.ngram_jaccard_join(X.frame(spark, rows), percent=0)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(7, 7), (None, 3)] + [(i, i + 1) for i in range(100, 130)]
    up = {x: x for e in edges if None not in e for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    got = dict(map(tuple, jaccard_join.components(spark.createDataFrame(edges, "u int, v int")).collect()))
    assert got == {x: find(x) for x in linked}


# 2. best-fit packing


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    path = tokens.vocabulary("word_bpe_49k.json")
    got = packing.best_fit_pack(docs, path, capacity=512).collect()
    want = X.pieces(Tokenizer.from_file(path), X.corpus(), 512)
    assert sorted((tuple(r)[:5] for r in got), key=str) == want
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert len(held) <= math.ceil(sum(r["length"] for r in got) / 512) * 1.05 + 1


def test_packing_of_nothing(empty):
    assert packing.best_fit_pack(empty, tokens.vocabulary("word_bpe_49k.json")).collect() == []


def test_plan_equals_best_fit_on_single_items():
    r = random.Random(4)
    for _ in range(30):
        cap = r.choice([10, 37, 100])
        counts = Counter(r.randint(1, cap) for _ in range(r.randint(0, 80)))
        plan = packing.best_fit_plan(counts, cap)
        rooms: list[int] = []
        for length in sorted(counts.elements(), reverse=True):
            fit = [x for x in rooms if x >= length]
            room = min(fit) if fit else cap
            if fit:
                rooms.remove(room)
            rooms.append(room - length)
        assert sum(p[2] for p in plan.tolist()) == sum(counts.values())
        assert len({s[4] + i // s[3] for s in plan.tolist() for i in range(s[2])}) == len(rooms)
    with pytest.raises(ValueError):
        packing.best_fit_plan({11: 1}, 10)


def test_encoder_equals_tokenizer():
    import pyarrow as pa

    e = tokens.Encoder(tokens.vocabulary("word_bpe_49k.json"))
    odd = ["it's don't 'scum I'LL 're're ''s", None, "", "İstanbul ΣΑΣ — “q”", "a<|endoftext|>b", "12 ½ x² a1b2", "日本 🙂", "ß ŉ ǅ", "\x00 a\tb\n\n c\u0085d", "'", "é", X.prose(300, 1)]
    got = dict(e.encode_rows(pa.array(odd)))
    for i, t in enumerate(odd):
        assert got[i].tolist() == e.whole.encode(t or "", add_special_tokens=False).ids


# 3. language identification


def test_language_id(spark, docs, empty):
    said = {"en": "the cat and the dog were in the house with other friends", "de": "der hund und die katze waren in dem schönen haus mit freunden", "fr": "le chien et le chat étaient dans la maison avec des amis"}
    rows = [(i, " ".join(random.Random(i).sample(said[k].split(), 9)), k) for i, k in enumerate(list(said) * 40)]
    rows += [(900, None, "en"), (901, "", None), (902, "12 34 !", "de"), (903, said["de"], None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = {r["doc_id"]: r for r in language_id.language_report(frame).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["lang_pred"] == k for i, _, k in rows[:120])
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert got[903]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in language_id.language_report(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.language_report(empty.withColumn("lang", F.lit("x"))).collect() == []


def test_language_mixtures():
    rng = np.random.default_rng(1)
    likelihood = rng.dirichlet(np.full(language_id.BUCKETS, 0.02), size=3).T + 1e-9
    likelihood /= likelihood.sum(axis=0)
    gram = np.concatenate([rng.choice(language_id.BUCKETS, 600, p=likelihood[:, 0]), rng.choice(language_id.BUCKETS, 400, p=likelihood[:, 2] / likelihood[:, 2].sum()), rng.choice(language_id.BUCKETS, 300, p=likelihood[:, 1] / likelihood[:, 1].sum())])
    owner = np.repeat([0, 0, 2], [600, 400, 300])  # text 1 has no n-gram
    mix = language_id.mixtures(likelihood, owner, gram, 3, 2.0, 20)
    assert abs(mix[0, 0] - 0.6) < 0.05 and mix[0, 1] == 0 and abs(mix[0, 2] - 0.4) < 0.05
    assert mix[1].tolist() == [0, 0, 0] and mix[2].tolist() == [0, 1, 0]


def test_language_mixtures_equal_brute_force():
    rng = np.random.default_rng(9)
    like = rng.dirichlet(np.full(language_id.BUCKETS, 0.01), size=4).T + 1e-7
    like /= like.sum(axis=0)
    shares = [(1, 0, 0, 0), (0.7, 0.3, 0, 0), (0.5, 0.2, 0.3, 0), (0.9, 0.1, 0, 0), (0.25, 0.25, 0.25, 0.25), (0.97, 0, 0, 0.03)]
    grams = [rng.choice(language_id.BUCKETS, n, p=like @ np.array(s)) for s in shares for n in (40, 300, 1500)]
    mix = language_id.mixtures(like, np.repeat(np.arange(len(grams)), [len(g) for g in grams]), np.concatenate(grams), len(grams), 2.0)
    for i, g in enumerate(grams):  # all sets of languages, solved to the end

        def fit(names):
            q, m = like[np.ix_(g, names)], np.full(len(names), 1 / len(names))
            for _ in range(5000):
                m = m * (q / (q @ m)[:, None]).mean(axis=0)
            return np.log(q @ m).sum(), m

        cost, names = 2.0 * np.log(len(g)), [0, 1, 2, 3]
        best = fit(names)
        while len(names) > 1:
            fewer = [x for x, _ in sorted(zip(names, best[1], strict=True), key=lambda y: -y[1])][:-1]
            lower = fit(fewer)
            if lower[0] + cost < best[0]:
                break
            names, best = fewer, lower
        want = np.zeros(4)
        want[names] = best[1]
        assert np.abs(mix[i] - want).max() < 0.03


def test_language_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = language_id.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 20 and right > 0.97


# 4. chat formatting


def test_chat_formatting(spark):
    rows = [
        (0, 0, "system", "s"), (0, 1, "user", "q"), (0, 2, "assistant", "good"), (0, 3, "user", None),
        (1, 0, "system", "s"), (1, 1, "user", "q"), (1, 1, "user", "q"), (1, 2, "assistant", "bad"),
        (2, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, None, "alone"), (None, 0, "user", "lost"), (6, None, "user", "lost"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1))
    out = chat_format.segments(turns, chat_format.neighbour_pairs(turns))
    got = sorted((r["pair_id"], r["part"], r["turn"], r["loss"]) for r in out.collect())
    assert got == [(0, "chosen", 2, 1), (0, "chosen", 3, 0), (0, "prompt", 0, 0), (0, "prompt", 1, 0), (0, "rejected", 2, 1), (2, "prompt", 0, 0), (4, "chosen", 0, 0)]
    one = chat_format.records(out).where("pair_id = 0").first()
    assert one["prompt"] == "<|system|>\ns<|end|>\n<|user|>\nq<|end|>\n"
    assert one["chosen"] == "<|assistant|>\ngood<|end|>\n<|user|>\n<|end|>\n"
    s, e = one["chosen_loss"][0]
    assert one["chosen"][s:e] == "<|assistant|>\ngood<|end|>\n" and len(one["rejected_loss"]) == 1
    assert chat_format.segments(turns.limit(0), chat_format.neighbour_pairs(turns.limit(0))).collect() == []


def test_preference_records_of_swapped_answers(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 1, "assistant", "a"), (0, 2, "user", "more"), (0, 3, "assistant", "good"), (0, 4, "user", None)]
    rows += [(1, 0, "user", "other"), (1, 1, "assistant", "bad"), (2, 0, "user", "no mate"), (2, 1, "assistant", "x"), (4, 0, "user", "same"), (4, 1, "assistant", "y"), (5, 7, "assistant", "y"), (6, 0, "user", "mute"), (7, 0, "assistant", "z"), (None, 1, "user", "lost")]
    rows += [(8, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(200)] + [(9, 0, "assistant", "w")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("c", F.lit(1))
    got = {(r[0], r[1]): tuple(r)[2:] for r in chat_format.preference_records(turns).collect()}
    say = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    prompt = say("user", "q") + say("assistant", "a") + say("user", "more")
    n, m = len(say("assistant", "good")), len(say("assistant", "bad"))
    assert got[0, 0] == (prompt, say("assistant", "good") + say("user", ""), say("assistant", "bad") + say("user", ""), f"0-{n}", f"0-{m}")
    assert got[1, 0] == (say("user", "other"), say("assistant", "bad"), say("assistant", "good"), f"0-{m}", f"0-{n}")
    assert got[2, 0] == (say("user", "no mate") + say("assistant", "x"), "", "", "", "")
    assert got[4, 0] == (say("user", "same") + say("assistant", "y"), "", "", "", "")  # equal answers
    assert got[6, 0] == (say("user", "mute"), "", "", "", "")
    assert [k for p, k in sorted(got) if p == 8] == [0, 1, 2, 3] and got[8, 3][1] == say("assistant", "t199") and got[8, 0][1] == ""
    assert chat_format.preference_records(turns.limit(0)).collect() == []
    c = duckdb.connect()
    c.register("conversations", pa.Table.from_pylist([dict(zip(("conv_id", "turn", "role", "text"), r, strict=True)) for r in rows]))
    assert {(r[0], r[1]): r[2:] for r in c.execute(chat_format.SQL).fetchall()} == got


# 5. repeated passages


@pytest.mark.parametrize("limit", [suffix_dedup.GROUP_LIMIT, 3])
def test_suffix_dedup_equals_brute_force(spark, docs, limit):
    rows = X.corpus()
    want = Counter((i, len((t or "").encode()), n, runs, hashlib.sha256(kept).hexdigest()) for (i, t), (n, runs, kept) in zip(rows, X.cut_repeats([t for _, t in rows]), strict=True))
    assert Counter(map(tuple, suffix_dedup.repeat_report(docs, group_limit=limit).collect())) == want


@pytest.mark.parametrize("limit", [suffix_dedup.GROUP_LIMIT, 3])
def test_suffix_dedup_of_two_lengths_at_once(spark, docs, limit):
    rows = X.corpus()
    long, short = (X.cut_repeats([t for _, t in rows], n) for n in (400, suffix_dedup.PASSAGE))
    want = Counter(
        (i, len((t or "").encode()), a[0], a[1], hashlib.sha256(a[2]).hexdigest(), b[1], None if t is None else b[2].decode("utf-8", "ignore")) for (i, t), a, b in zip(rows, long, short, strict=True)
    )
    assert Counter(map(tuple, suffix_dedup.repeat_report(docs, passage=suffix_dedup.PASSAGE, group_limit=limit).collect())) == want


@pytest.mark.parametrize("limit", [500, 4])
def test_hot_anchors_are_split_and_keep_all_repeats(spark, limit):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 8)))
    core = " ".join(word() for _ in range(200))
    rows = []
    for i in range(40):  # one passage in many texts: whole, cut short on either side, or with a word changed
        a, b = rng.randint(0, 300), rng.randint(700, len(core))
        middle = core[a:b] if i % 3 else core[: 100 + 20 * i] + word() + core[100 + 20 * i :]
        rows.append((i, " ".join(word() for _ in range(40)) + " " + middle + " " + " ".join(word() for _ in range(40))))
    got = {x[0]: tuple(x[2:]) for x in suffix_dedup.repeat_report(X.frame(spark, rows), passage=suffix_dedup.PASSAGE, group_limit=limit).collect()}
    long, short = (X.cut_repeats([t for _, t in rows], n) for n in (400, suffix_dedup.PASSAGE))
    assert got == {i: (a[0], a[1], hashlib.sha256(a[2]).hexdigest(), b[1], b[2].decode()) for (i, _), a, b in zip(rows, long, short, strict=True)}
    assert sum(x[0] > 0 for x in got.values()) > 15


def test_suffix_dedup_of_a_very_long_text(spark):
    rng = random.Random(6)
    text = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(300_000))  # 2 MB
    rows = [(1, text), (2, "x " + text[1_000_000:1_000_900] + " y"), (3, None)]
    got = {x[0]: tuple(x[1:4]) for x in suffix_dedup.repeat_report(X.frame(spark, rows)).collect()}
    assert got == {1: (len(text), 900, 1), 2: (904, 900, 1), 3: (0, 0, 0)} or got == {1: (len(text), 902, 1), 2: (904, 902, 1), 3: (0, 0, 0)}


def test_repeat_groups_have_all_occurrences(spark):
    rng = random.Random(7)
    fill = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    both = fill(500)
    texts = [fill(300) + both + fill(200), fill(50) + both + fill(90), "q" + both[:430] + "q" + fill(20)]
    rows = suffix_dedup.repeat_groups(X.frame(spark, list(enumerate(texts))), length=400).collect()
    place = {hashlib.md5(t.encode()).digest(): t for t in texts}
    groups: dict = {}
    for r in rows:
        groups.setdefault((r.h, r.repeat), []).append((place[bytes(r.k)][r.start : r.start + r.length]))
    assert groups and all(len(set(g)) == 1 and len(g) > 1 for g in groups.values())
    assert {len(g) for g in groups.values()} >= {2, 3}


def test_suffix_dedup_of_random_repetitive_texts(spark):
    r = random.Random(5)
    parts = [X.prose(r.randint(5, 60), k) for k in range(9)] + ["ab" * 150, "a" * 420]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(1, 7)))) for i in range(60)]
    want = {i: (n, runs, hashlib.sha256(kept).hexdigest()) for (i, _), (n, runs, kept) in zip(rows, X.cut_repeats([t for _, t in rows]), strict=True)}
    got = {x[0]: tuple(x[2:]) for x in suffix_dedup.repeat_report(X.frame(spark, rows)).collect()}
    assert got == want


def test_maximal_repeats_have_all_occurrences():
    rng = random.Random(3)
    gram = "G" * suffix_dedup.GRAM
    lefts, rights = [], []
    for _ in range(25):
        lefts.append("".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode())
        rights.append((gram + "".join(rng.choice("ab") for _ in range(rng.randint(0, 12)))).encode())
    got = {(l, r, tuple(sorted(m))) for l, r, m in suffix_dedup.maximal_repeats(lefts, rights, 70)}
    want = set()
    for i in range(25):
        for j in range(i):
            l, r = suffix_dedup._common(lefts[i], lefts[j]), suffix_dedup._common(rights[i], rights[j])
            if l + r >= 70:
                want.add((l, r, tuple(k for k in range(25) if lefts[k][:l] == lefts[i][:l] and rights[k][:r] == rights[i][:r])))
    assert got == want


def test_remove_repeats_keeps_columns(spark, docs, empty):
    out = suffix_dedup.remove_repeats(docs)
    assert out.schema == docs.schema
    want = Counter((i, None if t is None else kept.decode("utf-8", "ignore")) for (i, t), (_, _, kept) in zip(X.corpus(), X.cut_repeats([t for _, t in X.corpus()]), strict=True))
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == want
    assert suffix_dedup.remove_repeats(empty).collect() == [] and suffix_dedup.repeat_report(empty).collect() == []


# 6. importance resampling


def test_importance_sample(spark, docs, empty):
    good = [(i, "alpha beta gamma " * 5) for i in range(30)]
    bad = [(100 + i, "noise junk spam " * 5) for i in range(30)]
    rows = [*good, *bad, (None, None), (500, ""), (501, "alpha beta"), (501, "alpha beta")]
    frame, target = X.frame(spark, rows), spark.createDataFrame([(i,) for i in range(10)] + [(None,)], "doc_id long")
    out = importance.importance_sample(frame, target, fraction=0.5).collect()
    assert len(out) == len(rows) and abs(sum(r["selected"] for r in out) - 32) <= 1
    weight = {r["doc_id"]: r["log_weight"] for r in out}
    assert min(weight[i] for i in range(30)) > 0 > max(weight[100 + i] for i in range(30)) and weight[500] == 0
    bar = sorted((r["key"] for r in out), reverse=True)[31]
    assert all(r["selected"] == (r["key"] >= bar) for r in out)
    same = importance.importance_sample(frame, target, fraction=0.5).collect()
    assert Counter(map(tuple, same)) == Counter(map(tuple, out))
    assert {r["log_weight"] for r in importance.importance_sample(frame, target.limit(0)).collect()} == {0.0}
    assert not any(r["selected"] for r in importance.importance_sample(frame, target, fraction=0).collect())
    assert importance.importance_sample(empty, target).collect() == []


def test_order_code_follows_doubles():
    x = np.array([-math.inf, -1e300, -1.5, -0.0, 0.0, 1e-300, 2.0, math.inf])
    code = importance.order_code(x)
    assert (code[1:] >= code[:-1]).all() and (code[1:] > code[:-1]).sum() >= 6


# 7. quality rules


def test_quality_base_counts(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    got = Counter(tuple(r)[:7] for r in quality_rules.quality_report(docs, labels).collect())
    want = Counter((i, *c, c[0] < 20 or 100 * c[4] > 30 * c[0]) for i, t in X.corpus() for c in [X.base_counts(t)])
    assert got == want
    assert quality_rules.quality_report(empty, labels).collect() == []


def test_quality_model(spark):
    rows = [(i, X.prose(60, i)) for i in range(120)] + [(1000 + i, X.prose(60, i).upper().replace(" ", "!! ")) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in rows if i % 2] + [(None, 1), (3, None), (77777, 0)], "doc_id long, quality int").withColumn("text", F.lit(1))
    frame = X.frame(spark, rows)
    out = {r["doc_id"]: r for r in quality_rules.quality_report(frame, labels).collect()}
    assert all(r["kept"] == (i < 1000) and 0 <= r["quality"] <= 1 for i, r in out.items())
    kept = quality_rules.quality_filter(frame, labels)
    assert kept.schema == frame.schema and {r["doc_id"] for r in kept.collect()} == set(range(120))


# 8. licence scans


def test_license_scan(spark, empty):
    mit = dict((n, t) for n, t in license_scan.KNOWN[:1])["MIT"]
    rows = [(1, f"Copyright (c) 2020 A. Person\n\n{mit.upper()}"), (2, f"  (C) 1999 x\n{mit.replace(',', ' ;')} "), (3, "text\nReleased under the MIT Licence!\nmore\nSPDX-License-Identifier:  Apache-2.0\nreleased under the mit license"), (4, None), (5, ""), (3, "other"), (6, mit[:-20])]
    got = Counter((r[0], r[2], r[3], r[4]) for r in license_scan.scan(X.frame(spark, rows), license_scan.known_licenses(spark)).collect())
    assert got == Counter([(1, "MIT", 0, None), (2, "MIT", 0, None), (3, None, 3, "Apache-2.0,MIT"), (4, None, 0, None), (5, None, 0, None), (3, None, 0, None), (6, None, 0, None)])
    assert license_scan.scan(empty, license_scan.known_licenses(spark)).collect() == []
    twice = license_scan.scan(X.frame(spark, [rows[2], rows[2]]), license_scan.known_licenses(spark)).collect()
    assert [r["n_notices"] for r in twice] == [3, 3]


# 9. benchmark decontamination


def test_decontamination(spark, empty):
    item = "If Anna buys 12 kg of fresh apples and gives Bob 5 kg how many apples does Anna still have at home"
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "two words"), (5, "what colour is the sky")], "item_id long, text string").withColumn("k", F.lit(0))
    swapped = item.replace("Anna", "Clara").replace("12", "340").replace("Bob", "Emil").replace("5 kg", "9 kg")
    mixed = item.replace("Anna buys", "Clara buys").replace("12", "340")
    rows = [(1, f"{X.prose(30, 1)} {item}, {X.prose(30, 2)}"), (2, X.prose(9, 3) + " " + swapped), (3, mixed), (4, None), (5, ""), (6, X.prose(200, 4)), (7, "So: what colour is the sky?"), (8, "two words"), (1, item)]
    got = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["changed"]) for r in decontaminate.benchmark_matches(X.frame(spark, rows), items).collect()}
    n = len(item.split())
    assert got[(2, 1)][1] is True and got[(1, 1)] == (n - 9, False) and (3, 1) not in got and got[(7, 5)] == (1, False)
    assert {i for i, _ in got} == {1, 2, 7}
    left = decontaminate.drop_contaminated(X.frame(spark, rows), items)
    assert sorted((r["doc_id"] for r in left.collect())) == [3, 4, 5, 6, 8] and left.schema == X.frame(spark, rows).schema
    assert decontaminate.benchmark_matches(empty, items).collect() == []
    assert decontaminate.benchmark_matches(X.frame(spark, rows), items.limit(0)).collect() == []


def test_decontamination_in_any_case(spark):
    item = "If Anna Berg buys 12 kg of fresh apples from Carl and gives Bob 5 kg then how many apples does Anna still have"
    names = "Anna Bea Carl Dora met Emil Fred Gina Hugo near Ines Jan Kurt Lena"
    items = spark.createDataFrame([(1, item), (2, "What colour is the Sky"), (3, names), (4, X.prose(40, 70))], "item_id long, text string")
    rows = []
    for k, case in enumerate((str.lower, str.upper, str.title, str)):
        rows += [(10 * k + 1, f"{X.prose(30, k)} {case(item)} {X.prose(30, 9 + k)}"), (10 * k + 2, case("What colour is the Sky")), (10 * k + 3, case(names)), (10 * k + 4, case(X.prose(40, 70)))]
    rows += [(50, item.upper().replace("12", "340").replace("5", "9")), (51, X.prose(200, 71))]
    found = decontaminate.benchmark_matches(X.frame(spark, rows), items).collect()
    got = {(r["doc_id"], r["item_id"]): r["changed"] for r in found}
    assert got == {**{(10 * k + i, i): False for k in range(4) for i in (1, 2, 3, 4)}, (50, 1): True}
    assert len(found) == len(got)
    left = decontaminate.drop_contaminated(X.frame(spark, rows), items)
    assert [r["doc_id"] for r in left.collect()] == [51]


def test_decontamination_by_parts_and_item_texts(spark):
    head, tail = X.prose(25, 80), X.prose(25, 81)
    item = f"{head} Anna {tail} Anna bakes"
    middle = f"{X.prose(14, 82)} Karl {X.prose(3, 83)} Karl {X.prose(14, 84)}"
    other = f"{X.prose(14, 82)} Karl {X.prose(3, 85)} Lena {X.prose(14, 84)}"
    items = spark.createDataFrame([(1, item), (None, X.prose(30, 86)), (None, X.prose(30, 87)), (5, middle), (5, X.prose(20, 88)), (5, X.prose(20, 88))], "item_id long, text string")
    rows = [(1, item.replace("Anna bakes", "Clara bakes")), (2, item), (3, X.prose(30, 86) + " " + X.prose(30, 87)), (4, other.replace("Karl", "Otto")), (5, X.prose(20, 88)), (6, X.prose(90, 89))]
    got = Counter((r["doc_id"], r["item_id"], r["n_windows"]) for r in decontaminate.benchmark_matches(X.frame(spark, rows), items).collect())
    assert got == Counter({(1, 1, 42): 1, (2, 1, 44): 1, (3, None, 21): 2, (4, 5, 12): 1, (5, 5, 11): 1})
    left = decontaminate.drop_contaminated(X.frame(spark, rows), items)
    assert [r["doc_id"] for r in left.collect()] == [6]


def test_decontamination_makes_words_once_for_all_widths(spark, monkeypatch):
    plans = {}

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return stage(df, name)

    stage = decontaminate.written
    monkeypatch.setattr(decontaminate, "written", noted)
    texts = {n: X.prose(n, 90 + n) for n in (5, 6, 8, 9, 10, 11, 14)}
    items = spark.createDataFrame([*texts.items(), (15, "!? - ...")], "item_id long, text string")
    rows = [(n, f"{X.prose(12, n)} {t.upper() if n % 2 else t}: {X.prose(7, 3 * n)}") for n, t in texts.items()]
    rows += [(20, "; ".join(texts.values())), (21, X.prose(300, 190)), (22, " .,! "), (23, ""), (24, None), (25, " ".join(texts[8].split()[:7])), (26, texts[8])]
    found = decontaminate.benchmark_matches(X.frame(spark, rows), items).collect()
    got = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["changed"]) for r in found}
    n_windows = {n: (max(1, n - 9), False) for n in texts}
    assert got == {**{(n, n): n_windows[n] for n in texts}, **{(20, n): n_windows[n] for n in texts}, (26, 8): n_windows[8]}
    assert len(found) == len(got)
    # the job over all documents: one scan, punctuation goes once, no filter repeats the work
    assert plans["runs"].count("regexp_replace(") == 1


# 10. url filters


def test_url_verdicts(spark):
    urls = [None, "", "no scheme/x", "http://A.Example.ORG/es/1?q", "https://example.org/en/15", "https://example.org/en/2", "ftp://x.com/fr/a#b", "http://x.com/de/", "http://notcom/de/", "http://com/de/a", "http://bad.net", "http://bad.net/fr/", "http://ok.net?x=/://y", "http://bad.com/fr/1", "://weird", "http://org"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit(1), "level": F.lit("x")})
    listed = spark.createDataFrame([("bad.net",), ("bad.com",), ("elsewhere.io",), (None,)], "host string")
    want = {0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("a.example.org", "/es/1", "example.org/es/", "block"), 4: ("example.org", "/en/15", "example.org/en/1", "block"), 5: ("example.org", "/en/2", "org/", "allow"), 6: ("x.com", "/fr/a", "com/fr/", "allow"), 7: ("x.com", "/de/", "com/de/", "block"), 8: ("notcom", "/de/", None, "allow"), 9: ("com", "/de/a", "com/de/", "block"), 10: ("bad.net", "", None, "block"), 11: ("bad.net", "/fr/", None, "block"), 12: ("ok.net", "", None, "allow"), 13: ("bad.com", "/fr/1", "com/fr/", "allow"), 14: ("weird", "", None, "allow"), 15: ("org", "", None, "allow")}
    below = spark.createDataFrame([(1, "http://a.b.bad.net/x"), (2, "http://notbad.net"), (3, "http://bad.net."), (4, "http://x..bad.net")], "page_id long, url string")
    assert {r[0]: r["verdict"] for r in url_filter.url_verdicts(below, llm_registry.URL_RULES, listed).collect()} == {1: "block", 2: "allow", 3: "allow", 4: "block"}
    for limit in (url_filter.BROADCAST_BYTES, 0):
        got = {r[0]: tuple(r)[1:] for r in url_filter.url_verdicts(pages, llm_registry.URL_RULES, listed, broadcast_bytes=limit).collect()}
        assert got == want
    assert url_filter.url_verdicts(pages.limit(0), llm_registry.URL_RULES, listed.limit(0)).collect() == []


@pytest.mark.parametrize("sizes", [(0, 10), (10, 0), (300, 40_000), (5000, 5000)])
def test_cascade_is_exact(sizes):
    rng = np.random.default_rng(sizes[0])
    h = rng.integers(0, 2**63, size=(2, sum(sizes)), dtype=np.uint64)
    inside, outside = tuple(h[:, : sizes[0]]), tuple(h[:, sizes[0] :])
    levels = [(m, k, np.frombuffer(b, np.uint8)) for m, k, b in url_filter.build_cascade(inside, outside)]
    assert url_filter.in_cascade(levels, *inside).all() and not url_filter.in_cascade(levels, *outside).any()


# the pipeline


def test_pipeline_stages(spark, sf, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "best_fit_packing"]
    before = docs
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, before, sf)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        new = {r["doc_id"]: r["text"] for r in after.collect()}
        if name == "quality_rules":
            keep = {r["doc_id"] for r in quality_rules.quality_report(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("kept").collect()}
            assert new == {i: rows[i] for i in keep}
        elif name == "ngram_jaccard_join":
            comp = X.jaccard_components(list(rows.items()))
            assert new == {i: t for i, t in rows.items() if comp[(i, t)][1] == i}
        elif name == "suffix_array_dedup":
            ids = sorted(rows)
            assert new == {i: kept.decode("utf-8", "ignore") for i, (_, _, kept) in zip(ids, X.cut_repeats([rows[i] for i in ids], corpus_pipeline.PASSAGE_BYTES), strict=True)}
        else:
            assert set(new) <= set(rows) and len(new) > 0.9 * len(rows)
        before, rows = after, new
    packed = corpus_pipeline.STAGES[-1][1](spark, before, sf)
    assert {r["doc_id"] for r in packed.collect()} == set(rows)


def test_near_copies_keep_one_row_of_each_group(spark):
    import corpus_pipeline

    a, b, c, d, e = (X.prose(120, 900 + i) for i in range(5))
    near = a + " end"
    rows = [(1, a), (1, a), (2, a), (1, b), (7, near), (7, c), (None, d), (None, d), (None, b), (None, None), (8, ""), (None, e), (9, e), (9, e), (3, X.prose(110, 910))]
    frame = X.frame(spark, rows)
    out = corpus_pipeline.near_copies(spark, frame, "")
    assert out.schema == frame.schema
    want = Counter([(1, a), (1, b), (7, c), (None, d), (None, None), (8, ""), (9, e), (3, X.prose(110, 910))])
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == want
    left = corpus_pipeline.repeated_passages(spark, out, "")
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == want
