"""Removal of repeated passages with a sparse enhanced suffix array.

A byte goes when some string of ``length`` (400) bytes that covers it starts
anywhere else too, in the same text or another one.  Several lengths can be
judged at once.  The plan, where the shortest length sets the anchors and the
longest the contexts:

1.  Anchors.  Of each window of the shortest length, the 64-byte string with
    the least hash is its anchor.  Equal windows have equal anchors at equal
    places, so a repeat is seen at its anchors.
2.  Copies.  Whole copies are one class; a text that occurs twice goes whole,
    and only one of a class takes part in the rest.
3.  Anchors found once are dropped.  The context of the others reaches as far
    as a repeat of the longest length can.  Equal contexts, known by a 128-bit
    hash, are repeats from end to end; only one of each goes on, and none if
    there is no other.
4.  Interval tree.  The contexts of one anchor string are the suffixes of a
    sparse suffix array: they are sorted by right context, and a stack scan of
    the common-prefix lengths of neighbours yields the intervals.  In each
    interval the left contexts are sorted and scanned likewise, and a run of
    them is a maximal repeat if its extensions differ on both sides: it has
    *all* occurrences of that string (``maximal_repeats``).  A repeat of ``l``
    bytes to the left and ``r`` to the right covers its occurrences if
    ``l + r >= length``.  ``repeat_groups`` returns the groups themselves.
5.  An anchor string with more than ``GROUP_LIMIT`` contexts is split by longer
    context: the windows that start ``a`` to ``b`` bytes before the anchor share
    ``a`` bytes to the left and ``length - b`` to the right.  The groups of these
    longer strings go to the tree; one that is still too large is followed to the
    leaves of its tree at once, which are its windows, counted by hash over all
    tasks.  Nothing is left out.
6.  The covered ranges of a text are merged and cut out.

Matches never cross texts.  The tree sees repeats up to the context's bounds,
longer ones as overlapping chains, which makes no difference to coverage;
``repeat_groups`` joins the chains.
Nulls count as empty texts; a null or repeated id keeps its rows, because texts
are followed by their digest and never by id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._stage import discard, small_batches, written

#: Bytes of an anchor string.
GRAM = 64
#: Bytes that nearly any passage of over 50 words has.
PASSAGE = 270
#: Different contexts of one anchor string that go to one task together (16 MB, 4 s); larger groups are split.
GROUP_LIMIT = 20_000
#: Parts into which the windows of a larger group are split.
FAN = 4
#: Digests of texts with shared anchors are broadcast up to this many rows (20 MB).
BROADCAST_ROWS = 400_000


def anchors(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``data`` and hashes of the anchors of all windows inside each text."""
    n, w = len(data), length - GRAM + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = T.prefix_hash(data)
    at = np.arange(n - GRAM + 1)
    h = T.mix(T.span_hash(sums, at, at + GRAM))
    key = (h >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)  # least hash, then leftmost
    blocks = -(-len(key) // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - length + 1
    least = np.minimum(behind[:count], ahead[w - 1 : w - 1 + count])
    lo, hi = off[:-1], off[1:] - length + 1  # windows within one text
    some = hi > lo
    step = np.zeros(count + 1, np.int32)
    np.add.at(step, lo[some], 1)
    np.add.at(step, hi[some], -1)
    inside = np.cumsum(step[:-1]) > 0
    pos = (least[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if len(pos):  # a text's windows choose positions in order, so equal ones are neighbours
        pos = pos[np.append(True, pos[1:] != pos[:-1])]
    return pos, h[pos]


_ANCHOR = "k binary, h array<long>, c array<long>, d array<long>, pos array<int>, lo array<int>, hi array<int>, s array<int>, e array<int>"


def _anchor_rows(shortest: int, longest: int, every: bool = False):
    """Each text's anchors with a hash of their context, and ranges that repeat within the text.

    Of a text's equal contexts the first stands for all, unless ``every`` one is asked for.
    """

    def lists(ends: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(v)) for v in values]

    def run(batches):
        for batch in batches:
            key = batch.column("k")
            data, off = T.string_buffers(batch.column("text"))
            for i, j in T.slices(off):
                o = off[i : j + 1] - off[i]
                part = data[off[i] : off[j]]
                pos, h = anchors(part, o, shortest)
                text = np.searchsorted(o, pos, side="right") - 1
                lo = np.minimum(pos - o[text], longest - GRAM)
                hi = np.minimum(o[text + 1] - pos, longest)
                bounds = (lo * 4 * longest + hi).astype(np.uint64)
                c = T.mix(T.span_hash(T.prefix_hash(part), pos - lo, pos + hi) + bounds)
                d = T.mix(T.span_hash(T.prefix_hash(part, second=True), pos - lo, pos + hi) + bounds)
                _, first, inverse, count = np.unique(T.mix(c ^ h) + text.astype(np.uint64) * T._BASE, return_index=True, return_inverse=True, return_counts=True)
                twice = np.flatnonzero((count[inverse] > 1) & (lo + hi >= shortest))
                one = np.arange(len(h)) if every else np.sort(first)
                place = pos - o[text]
                kept = lists(np.searchsorted(text[one], np.arange(j - i + 1)), *(x[one].view(np.int64) for x in (h, c, d)), *(x[one].astype(np.int32) for x in (place, lo, hi)))
                own = lists(np.searchsorted(text[twice], np.arange(j - i + 1)), (place - lo)[twice].astype(np.int32), (place + hi)[twice].astype(np.int32))
                yield pa.RecordBatch.from_arrays([key.slice(i, j - i), *kept, *own], ["k", "h", "c", "d", "pos", "lo", "hi", "s", "e"])

    return run


def _context_rows(longest: int):
    """For each shared anchor of a text: the bytes before it, reversed, and from it on."""
    left, right = longest - GRAM, longest

    def run(batches):
        for batch in batches:
            keys, texts, spots = (batch.column(c) for c in ("k", "text", "spots"))
            out: list[tuple] = []
            held = 0
            for i in range(len(keys)):
                raw = texts[i].as_py().encode()
                back = raw[::-1]
                n, k = len(raw), keys[i].as_py()
                for s in spots[i].as_py():
                    p = s["pos"]
                    out.append((s["h"], s["m"], k, p, back[n - p : n - p + left], raw[p : p + right]))
                    held += left + right
                if held > 4 << 20:
                    yield _context_batch(out)
                    out, held = [], 0
            if out:
                yield _context_batch(out)

    return run


_CONTEXT = [("h", pa.int64()), ("m", pa.int64()), ("k", pa.binary()), ("pos", pa.int32()), ("l", pa.binary()), ("r", pa.binary())]


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _CONTEXT, strict=True)], [n for n, _ in _CONTEXT])


def _common(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] is common, a[:hi] isn't
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _sorted_with_prefixes(values: list[bytes]) -> tuple[list[int], np.ndarray]:
    """The sorted order of values, and the common prefix of each with the one before (first: 0)."""
    order = sorted(range(len(values)), key=values.__getitem__)
    return order, np.array([0, *(_common(values[a], values[b]) for a, b in zip(order, order[1:], strict=False))])


def _intervals(prefixes: np.ndarray, floor: int):
    """Stack scan of common prefixes: (prefix, first, end) of every interval, inner before outer."""
    stack: list[tuple[int, int]] = []  # (common prefix, first row)
    for i, c in enumerate([*prefixes[1:].tolist(), -1], 1):
        first = i - 1
        while stack and stack[-1][0] > c:
            depth, first = stack.pop()
            if depth >= floor:
                yield depth, first, i
        if c >= 0 and (not stack or stack[-1][0] < c):
            stack.append((c, first))


class _LeftOrder:
    """The left contexts in order, with range minima of their common prefixes."""

    def __init__(self, lefts: list[bytes]):
        order, prefixes = _sorted_with_prefixes(lefts)
        n = len(lefts)
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)
        self.order = np.array(order)
        self.table = np.zeros((n.bit_length(), n), np.int64)
        self.table[0] = prefixes
        for k in range(1, len(self.table)):
            step, end = 1 << (k - 1), n - (1 << k) + 1
            self.table[k, :end] = np.minimum(self.table[k - 1, :end], self.table[k - 1, step : step + end])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The common prefixes of the contexts at ranks a and b, a under b."""
        level = np.frexp(b - a)[1] - 1
        return np.minimum(self.table[level, a + 1], self.table[level, b - (1 << level) + 1])

    def prefixes(self, ranks: np.ndarray) -> np.ndarray:
        """The common prefix of each of some sorted ranks with the one before (first: 0)."""
        return np.append(0, self.common(ranks[:-1], ranks[1:]))


def interval_tree(left: _LeftOrder, rights: list[bytes]):
    """(r, ranks, child) of each interval of the suffixes ``rights``, inner before outer.

    The members share ``r`` bytes to the right; ``ranks`` are their places in
    the order of left contexts, ascending, and ``child`` numbers the intervals
    below this one that they are in.
    """
    order, prefixes = _sorted_with_prefixes(rights)
    order = np.array(order)
    for r, first, end in _intervals(prefixes, GRAM):
        ranks = left.rank[order[first:end]]
        by_left = np.argsort(ranks)
        yield r, ranks[by_left], np.append(0, np.cumsum(prefixes[first + 1 : end] == r))[by_left]


def maximal_repeats(lefts: list[bytes], rights: list[bytes], length: int):
    """(l, r, members) of each maximal repeat of ``length`` bytes at least: all its occurrences.

    A run of left contexts has different bytes before its ``l`` common ones.  It
    is maximal if its members come from more than one interval below too, so
    that the bytes after the ``r`` common ones differ as well.
    """
    left = _LeftOrder(lefts)
    for r, ranks, child in interval_tree(left, rights):
        differs = np.append(0, np.cumsum(child[1:] != child[:-1]))
        for l, first, end in _intervals(left.prefixes(ranks), max(0, length - r)):
            if differs[end - 1] > differs[first]:
                yield l, r, left.order[ranks[first:end]]


def covered(lefts: list[bytes], rights: list[bytes], lengths: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length, how far to the left and right of each anchor its maximal repeats reach; -1 for none.

    The maximal repeat with the most bytes to the left of a member of an
    interval has it and the nearest left context from another interval below.
    All repeats through an anchor hold it, so together they cover one range.
    """
    out = [(np.full(len(lefts), -1), np.full(len(lefts), -1)) for _ in lengths]
    if len(lefts) == 2:  # the tree of two suffixes is one interval
        l, r = _common(*lefts), _common(*rights)
        for length, (to_left, to_right) in zip(lengths, out, strict=True):
            if l + r >= length:
                to_left[:], to_right[:] = l, r
        return out
    left, least = _LeftOrder(lefts), min(lengths)
    for r, ranks, child in interval_tree(left, rights):
        n = len(ranks)
        edge = np.append(True, child[1:] != child[:-1])
        first = np.flatnonzero(edge)
        run = np.cumsum(edge) - 1
        before, after = first[run] - 1, np.append(first[1:], n)[run]  # nearest of another interval below
        l = np.full(n, -1)
        some = np.flatnonzero(before >= 0)
        l[some] = left.common(ranks[before[some]], ranks[some])
        some = np.flatnonzero(after < n)
        l[some] = np.maximum(l[some], left.common(ranks[some], ranks[after[some]]))
        if l.max() + r < least:
            continue
        members = left.order[ranks]
        for length, (to_left, to_right) in zip(lengths, out, strict=True):
            far = l + r >= length
            who = members[far]
            to_left[who] = np.maximum(to_left[who], l[far])
            to_right[who] = np.maximum(to_right[who], r)
    return out


def _ranges(lengths: tuple[int, ...]):
    """Solver of ``_tree_rows``: the covered ranges (k, s, e) and the length w that their repeats reach."""

    def solve(groups):
        ks, ss, es, ws = [], [], [], []
        for _, keys, pos, lefts, rights in groups:
            for length, (to_left, to_right) in zip(lengths, covered(lefts, rights, lengths), strict=True):
                for x in np.flatnonzero(to_left >= 0).tolist():
                    ks.append(keys[x])
                    ss.append(pos[x] - int(to_left[x]))
                    es.append(pos[x] + int(to_right[x]))
                    ws.append(length)
        return pa.RecordBatch.from_arrays([pa.array(ks, pa.binary()), pa.array(ss, pa.int32()), pa.array(es, pa.int32()), pa.array(ws, pa.int32())], ["k", "s", "e", "w"])

    return solve


def _groups(length: int):
    """Solver of ``_tree_rows``: one row for each maximal repeat of a group and each of its members."""

    def solve(groups):
        out: list[tuple] = []
        for h, keys, pos, lefts, rights in groups:
            for n, (l, r, members) in enumerate(maximal_repeats(lefts, rights, length)):
                out.extend((h, n, l + r, keys[x], pos[x], pos[x] - l) for x in members.tolist())
        kinds = [("h", pa.int64()), ("repeat", pa.int32()), ("length", pa.int32()), ("k", pa.binary()), ("pos", pa.int32()), ("start", pa.int32())]
        cols = list(zip(*out, strict=True)) if out else [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kinds, strict=True)], [n for n, _ in kinds])

    return solve


def _tree_rows(solver):
    """What the solver makes of each group of contexts, which come sorted by anchor string."""

    def solve(rows: pa.Table):
        h = rows["h"].to_numpy()
        cut = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        keys, pos = rows["k"].to_pylist(), rows["pos"].to_pylist()
        lefts, rights = rows["l"].to_pylist(), rows["r"].to_pylist()
        pairs = zip(cut.tolist(), [*cut[1:].tolist(), len(h)], strict=True)
        return solver((int(h[a]), keys[a:b], pos[a:b], lefts[a:b], rights[a:b]) for a, b in pairs if b - a > 1)

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column("h").to_numpy()
            if held and size >= 2000 and h[0] != held[-1].column("h")[-1].as_py():
                yield solve(pa.Table.from_batches(held))
                held, size = [], 0
            last = int(np.searchsorted(h, h[-1]))  # the last group may go on in the next batch
            if size + last >= 2000 and last:
                held.append(batch.slice(0, last))
                yield solve(pa.Table.from_batches(held))
                held, size = [batch.slice(last)], batch.num_rows - last
            else:
                held.append(batch)
                size += batch.num_rows
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def _window_rows(length: int):
    """128-bit hashes of the windows that start a to b bytes before an anchor."""

    def run(batches):
        for batch in batches:
            h1, h2, keys, starts, pos = [], [], [], [], []
            for x in batch.to_pylist():
                data = np.frombuffer(x["l"][::-1] + x["r"], np.uint8)
                first = max(0, len(x["l"]) - x["b"])
                at = np.arange(first, min(len(x["l"]) - x["a"], len(data) - length) + 1)
                for out, second in ((h1, False), (h2, True)):
                    out.append(T.mix(T.span_hash(T.prefix_hash(data, second=second), at, at + length)).view(np.int64))
                keys += [x["k"]] * len(at)
                pos.append(np.full(len(at), x["pos"]))
                starts.append(x["pos"] - len(x["l"]) + at)
            if keys:
                columns = [pa.array(np.concatenate(c)) for c in (h1, h2)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(keys, pa.binary()), *(pa.array(np.concatenate(c).astype(np.int32)) for c in (starts, pos))], ["w1", "w2", "k", "s", "pos"])

    return run


def _split(contexts: DataFrame, length: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Groups too large for one task, split by longer context: (groups for the tree, windows that larger ones share).

    The windows that start ``a`` to ``b`` bytes before an anchor have ``a`` bytes
    to the left and ``length - b`` to the right in common, so the contexts that
    share one of them agree on these.  Where more than ``limit`` agree, the tree
    is followed to its leaves at once: the windows themselves, counted by hash.
    """
    step = -(-(length - GRAM + 1) // FAN)
    spans = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(min(a + step - 1, length - GRAM)).alias("b")) for a in range(0, length - GRAM + 1, step)])
    rows = contexts.select("*", F.inline(spans))
    rows = rows.where((F.octet_length("l") >= F.col("a")) & (F.octet_length("r") >= length - F.col("b")))
    place = F.encode(F.concat_ws(",", F.col("h").cast("string"), F.col("a").cast("string")), "UTF-8")
    key = F.md5(F.concat(place, F.lit(b"\x00"), F.expr("substring(l, 1, a)"), F.lit(b"\x00"), F.substring("r", F.lit(1), length - F.col("b"))))
    rows = written(rows.withColumn("g", key), "split")
    sizes = written(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "split-sizes")
    rows = rows.join(sizes, "g")
    small = rows.where(F.col("n") <= limit).select(F.xxhash64("g").alias("h"), "k", "pos", "l", "r")
    windows = written(rows.where(F.col("n") > limit).select("k", "pos", "l", "r", "a", "b").mapInArrow(_window_rows(length), "w1 long, w2 long, k binary, s int, pos int"), "windows")
    start = F.struct("k", "s")  # neighbouring anchors show one window twice
    again = windows.groupBy("w1", "w2").agg(F.min(start).alias("x"), F.max(start).alias("y")).where("x != y").select("w1", "w2")
    return small, windows.join(again, ["w1", "w2"]).select("k", "s", (F.col("s") + length).alias("e"), F.lit(length).alias("w"), "w1", "w2", "pos")


def _cut_rows(lengths: tuple[int, ...]):
    """Cuts the covered ranges out of each text, once for each length."""

    def cut(raw: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
        kept, removed, runs, end = [], 0, 0, 0
        for s, e in sorted(spans):
            if runs and s <= end:
                if e > end:
                    removed, end = removed + e - end, e
                continue
            kept.append(raw[end:s])
            removed, runs, end = removed + e - s, runs + 1, e
        kept.append(raw[end:])
        return removed, runs, b"".join(kept)

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            keys, texts, spans = (batch.column(c) for c in ("k", "text", "spans"))
            for i in range(len(keys)):
                raw, found = texts[i].as_py().encode(), spans[i].as_py()
                cuts = [cut(raw, [(x["s"], x["e"]) for x in found if x["w"] >= length]) for length in lengths]
                removed, runs, rest = zip(*cuts, strict=True)
                out.append((keys[i].as_py(), removed, runs, [hashlib.sha256(x).hexdigest() for x in rest], [x.decode("utf-8", "ignore") for x in rest]))
            kinds = [("k", pa.binary()), ("n_removed", pa.list_(pa.int64())), ("n_spans", pa.list_(pa.int64())), ("sha", pa.list_(pa.string())), ("kept", pa.list_(pa.string()))]
            cols = list(zip(*out, strict=True)) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kinds, strict=True)], [n for n, _ in kinds])

    return run


def digest(text: str | Column) -> Column:
    """The 16 bytes that stand for a whole text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _shared_contexts(docs: DataFrame, lengths: tuple[int, ...]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(anchor rows by text, ranges of equal contexts, texts concerned, contexts of anchors that others share)."""
    shortest, longest = min(lengths), max(lengths)
    if shortest <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    small_batches(docs.sparkSession)
    texts = docs.select(digest("text").alias("k"), "text").where(F.octet_length("text") >= shortest)
    found = texts.mapInArrow(_anchor_rows(shortest, longest), _ANCHOR).groupBy("k").agg(
        F.count(F.lit(1)).alias("copies"), F.any_value(F.arrays_zip("h", "c", "d", "pos", "lo", "hi")).alias("at"), F.any_value(F.arrays_zip("s", "e")).alias("own")
    )
    one = written(found, "anchors")
    # anchor strings that occur with another context, or in another text
    spots = one.select("k", F.inline("at"))
    shared = spots.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    spots = written(spots.join(shared, "h"), "spots")
    same = spots.groupBy("h", "c", "d").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "pos")).alias("rep"))
    same = written(same, "contexts")
    ranges = one.select("k", F.inline("own"))
    twice = same.where("n > 1").select("h", "c", "d")
    ranges = ranges.unionByName(spots.join(twice, ["h", "c", "d"]).where(F.col("lo") + F.col("hi") >= shortest).select("k", (F.col("pos") - F.col("lo")).alias("s"), (F.col("pos") + F.col("hi")).alias("e")))
    groups = same.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    reps = same.join(groups, "h").select("h", "m", "rep.k", "rep.pos").groupBy("k").agg(F.collect_list(F.struct("h", "pos", "m")).alias("spots"))
    reps = written(reps, "representatives")
    ranges = written(ranges.withColumn("w", F.col("e") - F.col("s")), "ranges")
    ids = written(reps.select("k").unionByName(ranges.select("k")).distinct(), "affected")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    some = written(texts.join(ids, "k", "left_semi").groupBy("k").agg(F.any_value("text").alias("text")), "affected-texts")
    discard(spots, same)
    contexts = some.join(reps, "k").mapInArrow(_context_rows(longest), "h long, m long, k binary, pos int, l binary, r binary")
    return one, ranges, some, contexts


def _solved(contexts: DataFrame, solver, schema: str) -> DataFrame:
    """Groups of contexts, each together in one task."""
    return contexts.repartition("h").sortWithinPartitions("h").mapInArrow(_tree_rows(solver), schema)


def repeat_cuts(docs: DataFrame, lengths: tuple[int, ...] = (400,), group_limit: int = GROUP_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(copies, cuts): the digests of texts that occur more than once, and what is cut from others.

    ``docs`` needs a column text.  Rows of cuts: k (digest), and lists with one
    entry for each of ``lengths``: n_removed, n_spans, sha (of the bytes left),
    kept (the characters that are left whole).  Texts that keep all are absent.
    """
    one, ranges, some, contexts = _shared_contexts(docs, lengths)
    schema = "k binary, s int, e int, w int"
    ranges = ranges.unionByName(_solved(contexts.where(F.col("m") <= group_limit).drop("m"), _ranges(lengths), schema))
    hot = written(contexts.where(F.col("m") > group_limit).drop("m"), "hot-contexts")
    if not hot.isEmpty():
        for length in lengths:
            small, shared = _split(hot, length, group_limit)
            ranges = ranges.unionByName(_solved(small, _ranges((length,)), schema)).unionByName(shared.drop("w1", "w2", "pos"))
    spans = written(ranges.groupBy("k").agg(F.collect_list(F.struct("s", "e", "w")).alias("spans")), "spans")
    cuts = some.join(spans, "k").mapInArrow(_cut_rows(lengths), "k binary, n_removed array<long>, n_spans array<long>, sha array<string>, kept array<string>")
    return one.where("copies > 1").select("k"), written(cuts, "cuts")


#: Bytes that are compared on both sides of a repeat at first.
REACH = 1024


def _reach_rows(reach: int):
    """For each occurrence (g, start, end) of a text: the bytes before it, reversed, and those after it."""

    def run(batches):
        for batch in batches:
            texts, spots = (batch.column(c) for c in ("text", "spots"))
            gs, lefts, rights, held = [], [], [], 0
            for i in range(len(texts)):
                raw = texts[i].as_py().encode()
                for x in spots[i].as_py():
                    gs.append(x["g"])
                    lefts.append(raw[max(0, x["start"] - reach) : x["start"]][::-1])
                    rights.append(raw[x["end"] : x["end"] + reach])
                    held += len(lefts[-1]) + len(rights[-1])
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(gs, pa.int64()), pa.array(lefts, pa.binary()), pa.array(rights, pa.binary())], ["g", "l", "r"])
                    gs, lefts, rights, held = [], [], [], 0
            if gs:
                yield pa.RecordBatch.from_arrays([pa.array(gs, pa.int64()), pa.array(lefts, pa.binary()), pa.array(rights, pa.binary())], ["g", "l", "r"])

    return run


def _common_rows(batches):
    """What the least and the greatest of a group's contexts share, all of them share."""
    for batch in batches:
        sides = [[_common(a, b) for a, b in zip(batch.column(f"{c}0").to_pylist(), batch.column(f"{c}1").to_pylist(), strict=True)] for c in "lr"]
        yield pa.RecordBatch.from_arrays([batch.column("g"), *(pa.array(s, pa.int32()) for s in sides)], ["g", "left", "right"])


def _occurrences(texts: DataFrame, length: int, group_limit: int) -> tuple[DataFrame, list[DataFrame]]:
    """Rows (group, k, s, e): every occurrence of repeats as far as their anchors' contexts show them, and the tables below."""
    found = texts.mapInArrow(_anchor_rows(length, length, True), _ANCHOR).select("k", F.inline(F.arrays_zip("h", "c", "d", "pos", "lo", "hi")))
    found = written(found, "every-anchor")
    same = written(found.groupBy("h", "c", "d").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "pos")).alias("rep")).select("*", F.col("rep.k").alias("rk"), F.col("rep.pos").alias("rp")), "classes")
    spots = written(found.join(same.drop("rep"), ["h", "c", "d"]), "members")
    # a class of equal contexts is a repeat itself
    whole = spots.where((F.col("n") > 1) & (F.col("lo") + F.col("hi") >= length))
    whole = whole.select(F.xxhash64(F.lit(0), "h", "c", "d").alias("group"), "k", (F.col("pos") - F.col("lo")).alias("s"), (F.col("pos") + F.col("hi")).alias("e"))
    groups = same.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    reps = same.join(groups, "h").groupBy(F.col("rk").alias("k")).agg(F.collect_list(F.struct("h", F.col("rp").alias("pos"), "m")).alias("spots"))
    contexts = written(texts.join(reps, "k").mapInArrow(_context_rows(length), "h long, m long, k binary, pos int, l binary, r binary"), "all-contexts")
    schema = "h long, repeat int, length int, k binary, pos int, start int"
    parts = [_solved(contexts.where(F.col("m") <= group_limit).drop("m"), _groups(length), schema)]
    hot = contexts.where(F.col("m") > group_limit).drop("m")
    windows = None
    if not hot.isEmpty():
        small, windows = _split(hot, length, group_limit)
        parts.append(_solved(small, _groups(length), schema))
    rows = None
    for n, part in enumerate(parts):
        part = part.select(F.xxhash64(F.lit(n + 1), "h", "repeat").alias("group"), "k", "pos", F.col("start").alias("s"), (F.col("start") + F.col("length")).alias("e"))
        rows = part if rows is None else rows.unionByName(part)
    if windows is not None:
        rows = rows.unionByName(windows.select(F.xxhash64(F.lit(9), "w1", "w2").alias("group"), "k", "pos", "s", "e"))
    # what holds for a context holds for all that equal it
    rows = rows.withColumnsRenamed({"k": "rk", "pos": "rp"}).join(spots.select("rk", "rp", "k", "pos"), ["rk", "rp"])
    moved = F.col("pos") - F.col("rp")
    return rows.select("group", "k", (F.col("s") + moved).alias("s"), (F.col("e") + moved).alias("e")).unionByName(whole).distinct(), [found, same, spots, contexts]


def repeat_groups(docs: DataFrame, text_col: str = "text", length: int = 400, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """The maximal repeats of ``length`` bytes or more, with all their occurrences, however long they are.

    One row for each occurrence: h and repeat (numbers of the set of places and of
    the repeat), length (bytes), n (occurrences), k (digest of the text), start
    (byte offset), copies (documents with that text).  A text that occurs more than once is a repeat from end to
    end, with one row.  Repeats show at each of their anchors as far as a context
    goes; those with the same occurrences, some bytes further on, are one, and
    grow on both sides while all their occurrences agree, which the least and the
    greatest of the neighbouring bytes tell.  Of an anchor string with over
    ``group_limit`` contexts that ``_split`` can't part, repeats are taken from
    the windows that have the same occurrences.  A repeat longer than a context
    is listed by itself if one of its contexts has its occurrences and no others;
    one that is all made of more frequent pieces shows as these.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") >= length)
    texts = written(docs.groupBy(digest("text").alias("k")).agg(F.any_value("text").alias("text"), F.count(F.lit(1)).alias("copies")), "texts")
    found, held = _occurrences(texts.select("k", "text"), length, group_limit)
    found = written(found, "occurrences")
    discard(*held)
    # occurrences relative to the first one, as a digest: equal for one set of occurrences wherever it is seen
    first = found.groupBy("group").agg(F.min(F.struct("k", "s", "e")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select("group", "n", F.col("f.k").alias("fk"), F.col("f.s").alias("fs"), F.col("f.e").alias("fe"))
    apart = found.join(first, "group").withColumn("d", F.col("s") - F.col("fs"))
    sets = written(apart.groupBy("group", "n", "fk", "fs", "fe").agg(*[F.bit_xor(F.xxhash64(F.lit(seed), "k", "d")).alias(f"x{seed}") for seed in (1, 2)]), "sets")
    own = ["x1", "x2", "n", "fk"]
    before = Window.partitionBy(*own).orderBy("fs", "fe").rowsBetween(Window.unboundedPreceding, -1)
    runs = sets.withColumn("new", (F.coalesce(F.max("fe").over(before), F.lit(-1)) < F.col("fs")).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(Window.partitionBy(*own).orderBy("fs", "fe").rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(*own, "run").agg(F.min(F.struct("fs", "group")).alias("f"), F.max("fe").alias("fe"))
    runs = written(runs.select(F.xxhash64(*own, "run").alias("g"), *own, F.col("f.group").alias("group"), F.col("f.fs").alias("fs"), "fe"), "runs")
    spans = written(runs.join(found, "group").select("g", "k", "s", (F.col("s") + F.col("fe") - F.col("fs")).alias("e")), "spans")
    grown = written(runs.select("g", F.lit(0).alias("left"), F.lit(0).alias("right")), "grown")
    open_, reach = grown, REACH
    while True:
        at = spans.join(open_, "g").groupBy("k").agg(F.collect_list(F.struct("g", (F.col("s") - F.col("left")).alias("start"), (F.col("e") + F.col("right")).alias("end"))).alias("spots"))
        sides = at.join(texts, "k").mapInArrow(_reach_rows(reach), "g long, l binary, r binary")
        ends = sides.groupBy("g").agg(*[f(c).alias(f"{c}{i}") for c in "lr" for i, f in enumerate((F.min, F.max))])
        step = written(ends.mapInArrow(_common_rows, "g long, left int, right int"), "step")
        more = step.withColumnsRenamed({"left": "l", "right": "r"})
        grown = written(grown.join(more, "g", "left").select("g", (F.col("left") + F.coalesce("l", F.lit(0))).alias("left"), (F.col("right") + F.coalesce("r", F.lit(0))).alias("right")), "grown")
        open_ = grown.join(step.where((F.col("left") == reach) | (F.col("right") == reach)).select("g"), "g", "left_semi")
        if open_.isEmpty():
            break
        reach *= 2
    # a run that grew over another one with the same occurrences is the same repeat
    final = runs.join(grown, "g").select("g", *own, (F.col("fs") - F.col("left")).alias("fs"), (F.col("fe") + F.col("right")).alias("fe"))
    one = final.groupBy(*own, "fs", "fe").agg(F.min("g").alias("g"))
    # contexts that end with their texts may be found apart from longer ones that hold them: the largest set has all occurrences
    string = F.md5(F.substring(F.encode("text", "UTF-8"), F.col("fs") + 1, F.col("fe") - F.col("fs")))
    one = one.join(texts.select(F.col("k").alias("fk"), "text"), "fk").select("g", "n", "x1", string.alias("string"))
    one = one.groupBy("string").agg(F.max(F.struct("n", "g", "x1")).alias("b")).select("b.*")
    out = spans.join(one.select("g", "n", "x1").join(grown, "g"), "g").join(texts.select("k", "copies"), "k")
    start, size = F.col("s") - F.col("left"), F.col("e") - F.col("s") + F.col("left") + F.col("right")
    out = out.select(F.col("x1").alias("h"), F.col("g").alias("repeat"), size.cast("int").alias("length"), F.col("n").cast("long").alias("n"), "k", start.cast("int").alias("start"), "copies")
    copied = texts.where("copies > 1").select(F.xxhash64("k").alias("h"), F.xxhash64("k").alias("repeat"), F.octet_length("text").alias("length"), F.lit(1).cast("long").alias("n"), "k", F.lit(0).alias("start"), "copies")
    return out.unionByName(copied)


def repeat_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, passage: int | None = None, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that stay).

    With ``passage``, a shorter length, two columns more: n_passages, the runs
    covered by repeated strings of that length, and text, what is left without
    them (a null text stays null).
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    lengths = (length, passage) if passage else (length,)
    copies, cuts = repeat_cuts(docs, lengths, group_limit)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("id", digest("text").alias("k"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"), *(["text"] if passage else []))
    twice = copies.select("k", F.lit(True).alias("twice"))
    rows = rows.join(twice, "k", "left").join(cuts if passage else cuts.drop("kept"), "k", "left")
    gone = F.coalesce("twice", F.lit(False)) & (F.col("n_bytes") >= length)
    out = [
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce(F.col("n_removed")[0], F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce(F.col("n_spans")[0], F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce(F.col("sha")[0], "whole")).alias("kept_sha256"),
    ]
    if passage:
        gone = F.coalesce("twice", F.lit(False))  # copies are of the shorter length at least
        out += [
            F.when(gone, F.lit(1)).otherwise(F.coalesce(F.col("n_spans")[1], F.lit(0))).cast("long").alias("n_passages"),
            F.when(gone, F.lit("")).otherwise(F.coalesce(F.col("kept")[1], "text")).alias("text"),
        ]
    return rows.select(*out)


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = 400, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """The same rows and columns with repeated passages cut from the text.

    Characters of which a cut leaves only some bytes are dropped; a null text stays null.
    """
    plain = docs.select(F.col(text_col).cast("string").alias("text"))
    copies, cuts = repeat_cuts(plain, (length,), group_limit)
    key, twice, kept = "__digest", "__twice", "__kept"
    rows = docs.withColumn(key, digest(F.col(text_col).cast("string")))
    rows = rows.join(copies.select(F.col("k").alias(key), F.lit(True).alias(twice)), key, "left")
    rows = rows.join(cuts.select(F.col("k").alias(key), F.col("kept")[0].alias(kept)), key, "left")
    text = F.when(F.col(twice), F.lit("")).otherwise(F.coalesce(F.col(kept), F.col(text_col)))
    return rows.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
