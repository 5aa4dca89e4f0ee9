"""Merkle manifest of a dataset: a tree of digests for each source, one over the sources, and a proof for each row.

1.  Each row becomes a leaf: the digest of its fields, taken in the JVM.  From
    here on texts are gone; a row is two short digests.
2.  Leaves are sorted by range of (source, id) and numbered within their source,
    so that a source of any size lies in many partitions.
3.  A partition runs a mountain-range stack over its leaves: a node is pushed,
    and when it is the last of its run, the run's nodes are popped and their
    parent is pushed instead, like a carry in base ``FANOUT``.  Finished nodes
    are emitted as records.  Runs that a partition's edge cuts stay as open
    peaks, a few for each level.
4.  Open peaks of neighbouring partitions meet in one task, about ``PEAKS`` at a
    time, and go through the same stack, and so on until one task holds a
    source's last peaks.  A short last run is hashed as it is, without padding,
    which a task can tell from the source's number of leaves.
5.  The subroots are the leaves of one more tree, built in the same way.
6.  Proofs are passed down: a band of ``BAND`` levels at a time, each block of
    ``FANOUT ** BAND`` nodes gets the path above it and adds its own siblings.

Rows with a null id come first in their source and are never tampered with;
equal rows are leaves of their own.  A null source is a source.  An empty table
gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._order import batches_of, groups_of, indexed_within, rows_of
from ._stage import discard, in_few, written

FANOUT = 3
#: Open peaks that meet in one task, on average.
PEAKS = 4096
#: Levels of which a task knows the siblings at once: blocks of 3**7 = 2187 nodes.
BAND = 7

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field_text(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    v = value.cast("string")
    return F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))


def leaf_digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(field_text, fields)), 256)


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _count(size: int, level: int) -> int:
    """Nodes of a level over ``size`` leaves."""
    return -(-size // FANOUT**level)


def stacked(nodes: Iterator[tuple]) -> Iterator[tuple[bool, tuple]]:
    """(open, node) for sorted nodes (key, size, level, i, digest): parents as they are made, and the peaks left open.

    A break in the positions leaves what is on the stack open and starts anew.
    """
    stack: list[tuple] = []
    key, after = None, -1
    for node in nodes:
        k, size, level, i, _ = node
        if stack and (k != key or i * FANOUT**level != after):
            yield from ((True, x) for x in stack)
            stack = []
        key, after = k, min((i + 1) * FANOUT**level, size)
        stack.append(node)
        while True:
            _, size, level, i, _ = stack[-1]
            n, run = _count(size, level), i % FANOUT + 1
            if n == 1 or (run < FANOUT and i < n - 1) or len(stack) < run or stack[-run][2:4] != (level, i - run + 1):
                break
            parent = (k, size, level + 1, i // FANOUT, _h("".join(x[4] for x in stack[-run:])))
            stack[-run:] = [parent]
            yield False, parent
    yield from ((True, x) for x in stack)


_STACKED = pa.schema([("open", pa.bool_()), ("key", pa.string()), ("size", pa.int64()), ("level", pa.int32()), ("i", pa.int64()), ("digest", pa.string())])
_STACKED_DDL = "open boolean, key string, size long, level int, i long, digest string"


def _stack_rows(batches):
    yield from batches_of(((o, *n) for o, n in stacked(rows_of(batches))), _STACKED)


def tree_nodes(leaves: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Records above the leaves, each tree's top, and the written tables that both read.

    ``leaves``: key, size (leaves of the tree), i and digest.
    """
    nodes = leaves.select("key", "size", F.lit(0).alias("level"), "i", "digest").sortWithinPartitions("key", "i")
    total = leaves.count()
    made = [written(nodes.mapInArrow(_stack_rows, _STACKED_DDL), "peaks", total)]
    most = leaves.agg(F.max("size")).first()[0] or 0
    met = made[0].where("open").count()
    span = max(FANOUT**BAND, total * PEAKS // max(1, met))
    start = F.col("i") * F.pow(F.lit(float(FANOUT)), F.col("level")).cast("long")
    while True:
        peaks = made[-1].where("open").withColumn("__at", start).withColumn("__g", F.floor(F.col("__at") / span))
        peaks = peaks.repartition("key", "__g").sortWithinPartitions("key", "__g", "__at").select("key", "size", "level", "i", "digest")
        made.append(written(peaks.mapInArrow(_stack_rows, _STACKED_DDL), "peaks", met))
        if span >= most:
            break
        span *= 64
    parents = made[0].where("NOT open")
    for t in made[1:]:
        parents = parents.unionByName(t.where("NOT open"))
    return parents.drop("open"), made[-1].where("open").select("key", "size", "digest"), made


_PATH = [("key", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())]
_PATH_DDL = "key string, block long, size long, left array<string>, right array<string>, subroot string, root string"
_LEAF = [*_PATH, ("tag", pa.string()), ("digest", pa.string()), ("other", pa.string())]
_LEAF_DDL = f"{_PATH_DDL}, tag string, digest string, other string"
_PROOF = [(c, pa.string()) for c in ("tag", "digest", "subroot", "root", "proof", "folded")]
_PROOF_DDL = "tag string, digest string, subroot string, root string, proof string, folded string"


def _block_paths(rows: Iterator[tuple], low: int) -> Iterator[tuple]:
    """(node row, its siblings level by level within the band, the path row above the block)."""
    up = next(rows)  # the path sorts first
    size, high = up[6], low + BAND
    levels: dict[int, list[tuple]] = {}
    for r in rows:
        levels.setdefault(r[3], []).append(r)
    above: dict[int, tuple] = {}
    for level in sorted(levels, reverse=True):
        here: dict[int, tuple] = {}
        digests = {r[4]: r[7] for r in levels[level]}
        n = _count(size, level)
        for i in digests:
            if n == 1:
                here[i] = ()
                continue
            first = i - i % FANOUT
            left = "".join(digests[j] for j in range(first, i))
            right = "".join(digests[j] for j in range(i + 1, min(first + FANOUT, n)))
            here[i] = ((left, right), above[i // FANOUT] if level + 1 < high and above else ())
        above = here
    for r in levels.get(low, ()):
        cells, at = [], above[r[4]]
        while at:
            cells.append(at[0])
            at = at[1]
        yield r, cells, up


def _band_rows(low: int, last: str):
    """The mapper of one band: paths of its lowest nodes, or at level 0 what ``last`` names."""

    def paths(batches):
        for _, rows in groups_of(batches, 2):
            for r, cells, up in _block_paths(rows, low):
                path = (r[0], r[4], up[6], [x for x, _ in cells] + up[8], [y for _, y in cells] + up[9], up[10], up[11])
                yield path if last == "path" else (*path, r[12], r[7], r[13])

    def proofs(batches):
        for _, rows in groups_of(batches, 2):
            for r, cells, up in _block_paths(rows, low):
                proof, folded = hashlib.sha256(), r[13] or r[7]
                for pair in (cells, zip(up[8], up[9], strict=True)):
                    for left, right in pair:
                        proof.update((left + right).encode())
                        folded = _h(left + folded + right)
                yield r[12], r[7], up[10], up[11], proof.hexdigest(), folded

    rows, fields = (proofs, _PROOF) if last == "proof" else (paths, _PATH if last == "path" else _LEAF)
    return lambda batches: batches_of(rows(batches), pa.schema(fields))


def _levels(size: Column) -> Column:
    return sum((F.when(size > FANOUT**k, 1).otherwise(0) for k in range(40)), F.lit(0))


def tree_paths(leaves: DataFrame, parents: DataFrame, ups: DataFrame, last: str, rows: int) -> tuple[DataFrame, list[DataFrame]]:
    """What ``last`` names ("leaf": the siblings left and right of each level; "proof": their digest and the folded root) for each leaf.

    ``leaves``: key, size, i, digest, tag, other; ``rows``: their number.
    ``ups``: key, size, the path above each tree (left, right), subroot, root.
    """
    deepest = ups.agg(F.max(_levels(F.col("size")))).first()[0] or 0
    nodes = leaves.select("key", F.lit(0).alias("level"), "i", "size", "digest", "tag", "other")
    nodes = nodes.unionByName(parents.select("key", "level", "i", "size", "digest"), allowMissingColumns=True)
    enters = F.floor(F.greatest(_levels(F.col("size")) - 1, F.lit(0)) / BAND)
    empty = F.lit(None)
    above, made = None, []
    for band in range(max(0, deepest - 1) // BAND, -1, -1):
        low = band * BAND
        path = ups.where(enters == band).withColumn("block", F.lit(0).cast("long"))
        if above is not None:
            path = path.unionByName(above)
        path = path.select("key", "block", F.lit(0).alias("kind"), F.lit(-1).alias("level"), F.lit(-1).cast("long").alias("i"), F.lit(0).alias("x"), "size", empty.cast("string").alias("digest"), "left", "right", "subroot", "root", empty.cast("string").alias("tag"), empty.cast("string").alias("other"))
        block = F.floor(F.col("i") / F.pow(F.lit(float(FANOUT)), F.lit(low + BAND) - F.col("level")).cast("long"))
        none = empty.cast("array<string>")
        own = nodes.where((F.col("level") >= low) & (F.col("level") < low + BAND)).select("key", block.alias("block"), F.lit(1).alias("kind"), "level", "i", F.lit(0).alias("x"), "size", "digest", none.alias("left"), none.alias("right"), empty.cast("string").alias("subroot"), empty.cast("string").alias("root"), "tag", "other")
        both = path.unionByName(own).repartition("key", "block").sortWithinPartitions("key", "block", "kind", "level", "i")
        how = last if not band else "path"
        out = in_few(both.mapInArrow(_band_rows(low, how), {"path": _PATH_DDL, "leaf": _LEAF_DDL, "proof": _PROOF_DDL}[how]), rows)
        if band:
            above = written(out, "paths")
            made.append(above)
    return out, made


def merkle_manifest(docs: DataFrame, leaf: Column, tampered: Column, group: Column, ident: Column) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root and verified of each row.

    ``leaf`` and ``tampered`` are digests of a row as listed and as met again;
    null stands for a row that nobody tampered with.
    """
    kind = docs.select(ident.alias("v")).schema[0].dataType
    rows = docs.select(group.cast("string").alias("key"), ident.alias("id"), leaf.alias("digest"), tampered.alias("met"))  # each digest is taken once
    rows = written(rows.select("key", "id", "digest", F.when(F.col("met") != F.col("digest"), F.col("met")).alias("other")), "leaves", narrow=True)
    total = rows.count()
    # one source after another, ids ascending, nulls first; ties by digest
    leaves = indexed_within(rows, "key", [F.col("id").asc(), F.col("digest").asc()], rows=total)
    leaves = written(leaves.select("key", "size", F.col("pos").alias("i"), "digest", F.col("id").cast("string").alias("tag"), "other"), "leaves", total)
    parents, tops, held = tree_nodes(leaves)

    trees = tops.count()
    sources = indexed_within(tops.select(F.lit(None).cast("string").alias("one"), "key", F.col("size").alias("n"), "digest"), "one", [F.col("key").asc()], rows=trees)
    sources = written(sources.select(F.col("one").alias("key"), "size", F.col("pos").alias("i"), "digest", F.col("key").alias("tag"), F.col("n").cast("string").alias("other")), "sources", trees)
    over, root, held2 = tree_nodes(sources)
    none = F.array().cast("array<string>")
    top = root.select("key", "size", none.alias("left"), none.alias("right"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    found, held3 = tree_paths(sources, over, top, "leaf", trees)
    ups = written(found.select(F.col("tag").alias("key"), F.col("other").cast("long").alias("size"), "left", "right", F.col("digest").alias("subroot"), "root"), "ups")
    discard(rows, sources, *held2, *held3)
    out, _ = tree_paths(leaves, parents, ups, "proof", total)
    return out.select(
        F.col("tag").cast(kind).alias("id"), F.col("digest").alias("leaf"), "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified")
    )


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of a documents table, held against rows where every second id has lost the line breaks of its text."""
    met = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    # by bytes, so that a text which is no UTF-8 loses nothing else; a column of its own, so that it is made once
    docs = docs.select(*FIELDS, F.when(met, F.replace("text", F.lit("\n"), F.lit(""))).alias("__less"))
    as_met = F.when(met, leaf_digest(*map(F.col, FIELDS[:-1]), F.col("__less")))
    return merkle_manifest(docs, leaf_digest(*map(F.col, FIELDS)), as_met, F.col("source"), F.col("doc_id")).withColumnRenamed("id", "doc_id")


def _tree_sql(name: str, leaves: str) -> str:
    """Nodes (key, level, i, n, d) over leaves (key, i, n, d), with each node's siblings to the left and right."""
    run = f"PARTITION BY key, level, i // {FANOUT} ORDER BY i ROWS BETWEEN"
    return f"""{name}_nodes AS (SELECT key, 0 AS level, i, n, d FROM {leaves}
      UNION ALL SELECT key, level + 1, i // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(d, '' ORDER BY i))
      FROM {name}_nodes WHERE n > 1 GROUP BY key, level, i // {FANOUT}, n),
    {name} AS (SELECT *, coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
      coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}_nodes)"""


def _walk_sql(name: str, tree: str, start: str) -> str:
    """Rows (row, key, i, proof, folded) carried up a tree."""
    return f"""{name} AS (SELECT id, key, 0 AS level, i, proof, folded FROM {start}
      UNION ALL SELECT w.id, w.key, w.level + 1, w.i // {FANOUT}, w.proof || t.l || t.r, sha256(t.l || w.folded || t.r)
      FROM {name} AS w JOIN {tree} AS t ON t.key IS NOT DISTINCT FROM w.key AND t.level = w.level AND t.i = w.i AND t.n > 1),
    {name}_end AS (SELECT id, arg_max(proof, level) AS proof, arg_max(folded, level) AS folded FROM {name} GROUP BY id)"""


def _manifest_sql() -> str:
    from ._sql import crc32

    def fields(text: str) -> str:
        return " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {v}::VARCHAR END".replace(f"strlen({c}", f"strlen({v}") for c, v in zip(FIELDS, (*FIELDS[:-1], text), strict=True))

    less = "replace(text, chr(10), '')"
    return f"""WITH RECURSIVE leaf AS (SELECT doc_id, source AS key, sha256({fields("text")}) AS d,
      CASE WHEN {crc32("doc_id::VARCHAR")} % 2 = 0 THEN sha256({fields(less)}) END AS other FROM documents),
    leaves AS (SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, d) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM leaf),
    {_tree_sql("tree", "leaves")},
    tops AS (SELECT 0 AS key, key AS source, d, row_number() OVER (ORDER BY key NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
    {_tree_sql("over_all", "tops")},
    starts AS (SELECT id, key, i, '' AS proof, coalesce(other, d) AS folded FROM leaves),
    {_walk_sql("up", "tree", "starts")},
    starts2 AS (SELECT u.id, 0 AS key, t.i, u.proof, u.folded FROM up_end AS u JOIN leaves AS f ON f.id = u.id JOIN tops AS t ON t.source IS NOT DISTINCT FROM f.key),
    {_walk_sql("up2", "over_all", "starts2")}
    SELECT f.doc_id, f.d AS leaf, t.d AS subroot, o.d AS root, sha256(u.proof) AS proof_sha256, u.folded AS folded_root, u.folded = o.d AS verified
    FROM leaves AS f JOIN up2_end AS u ON u.id = f.id JOIN tops AS t ON t.source IS NOT DISTINCT FROM f.key JOIN over_all AS o ON o.n = 1"""


SQL = _manifest_sql()
