"""N-gram Jaccard join by grouped prefixes, and the components of its links.

Two texts link when the Jaccard similarity of their sets of word n-grams is at
least ``percent`` / 100.  The join is exact and never compares all pairs:

1.  Copies.  Texts with the same set are one class; only one row of a class
    goes on, and every text of the class gets its result at the end.
2.  Extended prefix.  In hash order, the first ``a - need(a) + a // 10`` n-grams
    of two similar sets share at least a tenth of the smaller size.  Only these
    are counted over the corpus; a text without enough shared ones has no link.
3.  Prefix.  For the texts that are left, whole sets are counted.  N-grams are
    ordered from rare to frequent; those found once need no index entry, but
    fill up the prefix, so passages that many texts share are hardly indexed.
4.  Groups.  Texts with identical prefix and size form one group.  Group pairs
    that meet in a prefix are filtered by size, by the number of shared n-grams
    and by the Hamming distance of parity bitmaps, then expanded to members.
5.  Links.  Each index entry first links its members to the member that has
    most n-grams in common with the rest (a linear number of pairs).  Then all
    pairs whose members are not yet connected are verified too, so no link
    between different components is lost, and no group is expanded to pairs of
    members that are connected already.

Counting uses partial aggregation and joins that Spark can split, so no key
needs its rows in one task.  The links' components come from alternating
large-star and small-star steps on the edge table.

Nulls: a null or wordless text has an empty set and is linked with nothing; a
null id stays a row of its own whose component is null.  An id that occurs with
several texts takes part once for each text and gets one row for each.
Columns other than the two that are named are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._stage import small_batches, written

#: Ids of candidate texts are broadcast up to this many rows (16 MB), else joined by a shuffle.
BROADCAST_ROWS = 1_000_000
BITMAP_BITS = 512
_WORDS = BITMAP_BITS // 64


def _need(a, percent: int):
    """The least overlap that a set of ``a`` n-grams has with any similar set."""
    return -(-percent * a // 100)


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """The row number and the sorted distinct n-gram hashes of each text of a batch."""
    data, off = T.string_buffers(batch.column("text"))
    for i, j in T.slices(off):
        part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        starts, ends, first = T.word_spans(part, o)
        words = T.mix(T.span_hash(T.prefix_hash(part, lower=True), starts, ends))
        grams = T.windows(words, n)
        for k in range(j - i):
            a, b = first[k], first[k + 1]
            if b - a >= n:
                h = np.sort(grams[a : b - n + 1])
                keep = np.empty(len(h), bool)
                keep[0] = True
                np.not_equal(h[1:], h[:-1], out=keep[1:])
                yield i + k, h[keep]
            elif b > a:  # fewer words than n: the whole sequence, told apart by its length
                yield i + k, T.windows(np.append(words[a:b], np.uint64(b - a)), b - a + 1)
            else:
                yield i + k, np.zeros(0, np.uint64)


def _signature(h: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a whole set."""
    if not len(h):
        return 0, 0
    with np.errstate(over="ignore"):
        one = np.add.reduce(T.mix(h ^ np.uint64(0x5851F42D4C957F2D)))
        two = np.add.reduce(T.mix(h + np.uint64(0x14057B7EF767814F)) * np.uint64(0x2545F4914F6CDD1D))
    return int(one.view(np.int64)), int(two.view(np.int64))


def _list_column(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _rows(n: int, percent: int, what: str):
    """A mapInArrow function; ``what``: 'meta', 'prefix' (meta and extended prefix) or 'set'."""

    def emit(ids, sizes, sig, lists) -> pa.RecordBatch:
        s = np.array(sig, np.int64).reshape(-1, 2)
        cols = {"id": pa.array(ids, pa.int64()), "a": pa.array(sizes, pa.int64()), "s1": pa.array(s[:, 0]), "s2": pa.array(s[:, 1])}
        if what != "meta":
            cols["grams"] = _list_column(lists)
        return pa.RecordBatch.from_pydict(cols)

    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_pylist()
            out: tuple[list, list, list, list] = ([], [], [], [])
            held = 0
            for k, h in _sets(batch, n):
                a = len(h)
                part = h[: a - _need(a, percent) + max(1, a // 10)] if what == "prefix" else h
                for x, v in zip(out, (ids[k], a, _signature(h), part), strict=True):
                    x.append(v)
                held += len(part) if what != "meta" else 4
                if held > 500_000:
                    yield emit(*out)
                    out, held = ([], [], [], []), 0
            if out[0]:
                yield emit(*out)

    return run


def _signed(n: int):
    """A mapInArrow function: all columns but the text, then the size and the signature of each row's set."""

    def run(batches):
        for batch in batches:
            found = np.zeros((batch.num_rows, 3), np.int64)
            for k, h in _sets(batch, n):
                found[k] = (len(h), *_signature(h))
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(found[:, k].copy()) for k in range(3))], [*names, "a", "s1", "s2"])

    return run


def _hash_sets(docs: DataFrame, n: int, percent: int, what: str) -> DataFrame:
    schema = "id long, a long, s1 long, s2 long" + ("" if what == "meta" else ", grams array<long>")
    return docs.mapInArrow(_rows(n, percent, what), schema)


def _similar_size(a: str, b: str, percent: int) -> Column:
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (F.lit(100 + percent) * F.least(f"{a}c", f"{b}c") >= F.lit(percent) * (F.col(a) + F.col(b)))


def _hamming(a: str, b: str) -> Column:
    total = F.lit(0)
    for k in range(_WORDS):
        total = total + F.bit_count(F.col(a)[f"b{k}"].bitwiseXOR(F.col(b)[f"b{k}"]))
    return total


def _bitmaps(batches):
    """Adds the parity bitmap of a set: bit i is the parity of the n-grams whose hash ends in i."""
    for batch in batches:
        rows = batch.column("grams")
        ends = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1]
        flat = rows.values.to_numpy(zero_copy_only=False).view(np.uint64)
        bits = np.zeros((len(rows), BITMAP_BITS), np.uint8)
        for k in range(len(rows)):
            low = (T.mix(flat[ends[k] : ends[k + 1]]) & np.uint64(BITMAP_BITS - 1)).astype(np.int64)
            bits[k] = np.bincount(low, minlength=BITMAP_BITS) & 1
        packed = np.packbits(bits, axis=1).view(np.int64)
        fields = [pa.array(np.ascontiguousarray(packed[:, k])) for k in range(_WORDS)]
        bitmap = pa.StructArray.from_arrays(fields, [f"b{k}" for k in range(_WORDS)])
        yield pa.RecordBatch.from_arrays([*batch.columns, bitmap], [*batch.schema.names, "bm"])


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Connected components of an edge table: rows (node, component), the component its least node.

    Alternates large-star and small-star steps.  Minima are partial aggregates
    joined back to the edges, so a node with very many edges needs no single task.
    Nodes may be of any orderable type; an edge with a null end is left out.
    """
    now = written(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null and u != v").distinct(), "edges")
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    sides = [("u", "v"), ("v", "u")]

    def both(e: DataFrame) -> DataFrame:
        x, y = (e.select(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in sides)
        return x.unionByName(y)

    def check(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    seen = check(now)
    while True:
        two = both(now)
        low = two.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = two.join(low, F.col("u") == F.col("k")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = written(large, "large-star", 2 * seen[0])
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        kept = down.join(low.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(low.select("u", F.col("m").alias("v")).unionByName(kept).where("u != v").distinct(), "small-star", 2 * seen[0])
        was, seen = seen, check(now)
        if was == seen:
            break
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(out.select(F.col("component").alias("node"), "component").distinct())


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of nodes (u, v) whose whole sets are similar."""
    a = sets.select(F.col("node").alias("u"), F.col("grams").alias("gu"))
    b = sets.select(F.col("node").alias("v"), F.col("grams").alias("gv"))
    both = F.size(F.array_intersect("gu", "gv"))
    return pairs.join(a, "u").join(b, "v").where(both * (100 + percent) >= (F.size("gu") + F.size("gv")) * percent).select("u", "v")


def jaccard_links(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The classes of equal sets (rep, a, s1, s2) and links between them that connect all that are similar.

    ``docs`` has columns id and text.  Links are rows (u, v) of structs (rep, s).
    Inside a component they are a connecting subset, not all similar pairs: pairs
    that are connected already are not verified, so no number of links is given.
    """
    small_batches(docs.sparkSession)
    classes = (
        _hash_sets(docs, n, percent, "prefix")
        .where("a > 0 and id is not null")
        .groupBy("a", "s1", "s2")
        .agg(F.min("id").alias("rep"), F.any_value("grams").alias("grams"))
    )
    entries = classes.select("rep", "a", F.explode("grams").alias("h"))
    shared = entries.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("h")
    floor = F.greatest(F.lit(1), F.floor(F.ceil(F.col("a") * percent / 100) / 10))
    near = entries.join(shared, "h").groupBy("rep", "a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= floor)
    near = written(near.select(F.col("rep").alias("id")).distinct(), "near")
    ids = F.broadcast(near) if near.count() <= BROADCAST_ROWS else near
    few = docs.join(ids, "id", "left_semi")
    sets = _hash_sets(few, n, percent, "set").where("a > 0")
    sets = sets.groupBy("a", "s1", "s2").agg(F.min("id").alias("rep"), F.any_value("grams").alias("grams"))
    sets = sets.select("rep", "a", "s1", "s2", "grams").mapInArrow(_bitmaps, "rep long, a long, s1 long, s2 long, grams array<long>, bm struct<" + ",".join(f"b{k}:long" for k in range(_WORDS)) + ">")
    sets = written(sets.withColumn("node", F.struct("rep", F.col("s1").alias("s"))), "sets")

    grams = sets.select("node", "a", F.explode("grams").alias("h"))
    counts = grams.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    need = F.ceil(F.col("a") * percent / 100).cast("int")
    prefixes = (
        grams.join(counts, "h")
        .groupBy("node", "a")
        .agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("x"))
        .withColumn("c", F.size("x").cast("long"))
        .where(F.col("c") >= need)
        .select("node", "a", "c", F.slice("x", 1, F.col("c").cast("int") - need + 1)["h"].alias("prefix"))
    )
    members = prefixes.join(sets.select("node", "bm"), "node").withColumn("key", F.struct("a", F.xxhash64("prefix"), F.hash("prefix")))
    members = written(members, "members")
    best = F.struct("c", F.negate(F.col("node.rep")), F.negate(F.col("node.s")))
    groups = members.groupBy("key").agg(F.first("a").alias("a"), F.max("c").alias("c"), F.max_by("node", best).alias("centre"), F.max_by("bm", best).alias("bm"), F.any_value("prefix").alias("prefix"))
    wide = members.select("key", F.col("bm").alias("mb")).join(groups.select("key", "bm"), "key").groupBy("key").agg(F.max(_hamming("mb", "bm")).alias("radius"))
    groups = written(groups.join(wide, "key"), "groups")

    def side(df: DataFrame, x: str, *more: str) -> DataFrame:
        cols = {"a": x, "c": f"{x}c", "bm": f"{x}b", "radius": f"{x}r", "centre": f"{x}m", "key": f"{x}k", "node": f"{x}n"}
        return df.select(*[F.col(k).alias(v) for k, v in cols.items() if k in df.columns], *more)

    def near_groups() -> Column:
        apart = _hamming("xb", "yb") - F.col("xr") - F.col("yr")
        return _similar_size("x", "y", percent) & (apart * (100 + percent) <= (F.col("x") + F.col("y")) * (100 - percent))

    def near_members() -> Column:
        return _similar_size("x", "y", percent) & (_hamming("xb", "yb") * (100 + percent) <= (F.col("x") + F.col("y")) * (100 - percent))

    def ordered(x: str, y: str) -> list[Column]:
        return [F.least(x, y).alias("u"), F.greatest(x, y).alias("v")]

    # links of each entry's members, and of each group's, to the one that shares most
    posts = groups.select("key", "a", "c", "bm", "radius", "centre", F.explode("prefix").alias("h"))
    top = F.struct(F.col("c") / F.col("a"), F.negate(F.col("centre.rep")), F.negate(F.col("centre.s")))
    hubs = posts.groupBy("h").agg(F.max_by(F.struct("centre", "a", "c", "bm"), top).alias("hub"), F.count(F.lit(1)).alias("k")).where("k > 1")
    hubs = hubs.select("h", F.col("hub.centre").alias("xn"), F.col("hub.a").alias("x"), F.col("hub.c").alias("xc"), F.col("hub.bm").alias("xb"), F.lit(0).alias("xr"))
    star = side(posts, "y", "h").join(hubs, "h").where(near_groups()).select("xn", "x", "xc", "xb", "yk").distinct()
    own = groups.select(F.col("centre").alias("xn"), F.col("a").alias("x"), F.col("c").alias("xc"), F.col("bm").alias("xb"), F.col("key").alias("yk"))
    star = star.unionByName(own).join(side(members, "y"), "yk").where(near_members() & (F.col("xn") != F.col("yn")))
    links = written(_verified(star.select(*ordered("xn", "yn")).distinct(), sets, percent), "links")

    # what is not connected yet
    comp = components(links)
    placed = members.join(comp.withColumnRenamed("node", "cn"), F.col("node") == F.col("cn"), "left")
    members = written(placed.withColumn("comp", F.coalesce("component", "node")).drop("cn", "component"), "placed")
    range_ = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    posts = posts.join(range_, "key")
    left = side(posts, "x", "h", F.col("lo").alias("xlo"), F.col("hi").alias("xhi"))
    right = side(posts, "y", "h", F.col("lo").alias("ylo"), F.col("hi").alias("yhi"))
    apart = (F.col("xlo") != F.col("yhi")) | (F.col("ylo") != F.col("xhi"))
    pairs = left.join(right, (left["h"] == right["h"]) & (F.col("xk") < F.col("yk")) & apart & near_groups()).select("xk", "yk").distinct()
    pairs = pairs.unionByName(range_.where("lo != hi").select(F.col("key").alias("xk"), F.col("key").alias("yk")))
    one, two = side(members, "x", F.col("comp").alias("xp")), side(members, "y", F.col("comp").alias("yp"))
    cross = pairs.join(one, "xk").join(two, "yk").where(near_members() & (F.col("xp") != F.col("yp"))).select(*ordered("xn", "yn")).distinct()
    more = written(_verified(cross, sets, percent), "more-links")
    return classes, links.unionByName(more)


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles (set size), component_id.

    component_id is the smallest id that links reach, the document itself
    included.  See the module's text for the method and for odd inputs.
    """
    if n < 1 or not 0 < percent <= 100:
        raise ValueError("n must be positive and percent between 1 and 100")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    _, links = jaccard_links(docs, n, percent)
    comp = written(components(links).select(F.col("node.rep").alias("rep"), F.col("node.s").alias("s"), F.col("component.rep").alias("component")), "components")
    meta = written(_hash_sets(docs, n, percent, "meta"), "meta")
    reps = meta.where("a > 0 and id is not null").groupBy("a", "s1", "s2").agg(F.min("id").alias("rep"))
    reps = reps.join(comp, (reps["rep"] == comp["rep"]) & (reps["s1"] == comp["s"]), "left").select("a", "s1", "s2", F.coalesce("component", reps["rep"]).alias("component"))
    out = meta.join(reps.hint("shuffle_merge"), ["a", "s1", "s2"], "left")
    comp_id = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("a").alias("n_shingles"), comp_id.cast("long").alias("component_id"))


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` whose text has words: id, k (digest of the text), group.

    A group is a component of the links, whatever the ids: rows without an id
    take part, and the texts of one id are in one group only if links say so.
    """
    one = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    one = one.select(F.coalesce("id", F.xxhash64("text")).alias("id"), F.col("id").isNull().alias("lost"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("k"), "text")
    _, links = jaccard_links(one.select("id", "text"), n, percent)
    comp = written(components(links).select(F.col("node.rep").alias("cr"), F.col("node.s").alias("cs"), "component"), "components")
    meta = written(one.mapInArrow(_signed(n), "id long, lost boolean, k binary, a long, s1 long, s2 long").where("a > 0"), "meta")
    reps = meta.groupBy("a", "s1", "s2").agg(F.min("id").alias("rep"))
    node = F.struct("rep", F.col("s1").alias("s"))
    reps = reps.join(comp, (F.col("rep") == F.col("cr")) & (F.col("s1") == F.col("cs")), "left").select("a", "s1", "s2", F.coalesce("component", node).alias("group"))
    out = meta.join(reps.hint("shuffle_merge"), ["a", "s1", "s2"])
    return out.select(F.when(~F.col("lost"), F.col("id")).alias("id"), "k", "group")
