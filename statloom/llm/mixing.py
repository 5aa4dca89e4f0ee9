"""Mixing sources to target weights by balanced sampling with the cube method.

1.  A document's size is its number of words.  Sources, in the order of their
    names with null last, take the weights in turn.  They share the total size
    by weight; a source stops at ``limit`` times its own size and what it leaves
    is shared by the others.  That is one aggregate over sources a round.
2.  A document is taken floor(m) times for certain, m being its source's target
    over its size, and once more with the probability that is left.
3.  Documents are sorted by range of (source, size from large to small) and dealt
    in turn to blocks, which thus hold all sizes.  A block's flight moves the probabilities along directions that
    keep both their sum and their sum of words, until they are 0 or 1: every
    block keeps its expected number of documents and words, but for two
    documents that stay open at the most.
4.  The open documents of ``MERGE`` blocks meet and fly again, until a source has
    one block.  Its last two documents, among the smallest, land: of the two
    extreme joint designs with the right probabilities, the one with the smaller
    expected error in words.

A null text has size 0.  Null, repeated and tied ids are rows of their own.  A
source without words has target 0.  Draws are seeded by source, block and
round, so reruns agree.  An empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._order import batches_of, groups_of, indexed, indexed_within
from ._stage import discard, written

#: Documents of a block at first.
BLOCK = 4096
#: Blocks whose open documents, two at most of each, meet in the next round.
MERGE = 2048
_EPS = 1e-9


def word_count(text: Column) -> Column:
    """The number of runs ``[^\\x20\\x09-\\x0D]+``; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weighted_targets(sources: DataFrame, group: str, weights: Sequence[float], limit: float) -> DataFrame:
    """Adds ``target`` to rows (group, source_size): shares by weight of all sizes, none above ``limit`` times its own."""
    rows = indexed(sources, [F.col(group).asc_nulls_last()], "__i")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("__i") % len(weights) + 1).cast("int"))
    rows = written(rows.withColumn("__w", weight), "sources")
    cap, total = F.col("source_size") * limit, rows.agg(F.sum("source_size")).first()[0] or 0
    level, held = 0.0, -1
    while True:  # the level rises until no further source is held at its cap
        full = F.lit(True) if level is None else cap <= F.col("__w") * level
        r = rows.agg(F.sum(F.when(full, 1).otherwise(0)).alias("n"), F.sum(F.when(full, cap)).alias("caps"), F.sum(F.when(~full, F.col("__w"))).alias("w")).first()
        if r["n"] == held or r["n"] is None:
            break
        held, level = r["n"], (total - (r["caps"] or 0.0)) / r["w"] if r["w"] else None
    share = cap if level is None else F.least(cap, F.col("__w") * level)
    return rows.withColumn("target", share.cast("double")).drop("__i", "__w")


def flight(p: np.ndarray, size: np.ndarray, draw: random.Random) -> np.ndarray:
    """Probabilities moved to 0 or 1, but for two at the most, so that their sum and the sum of ``p * size`` stay.

    Each step takes the largest open unit and moves along its unit vector's
    projection on the null space of (1, size): all others give way a little, so
    that large units are settled early and the smallest stay open.
    """
    p = np.where(p < _EPS, 0.0, np.where(p > 1 - _EPS, 1.0, p))
    left = np.argsort(-size, kind="stable")
    left = left[(p[left] > 0) & (p[left] < 1)]
    while len(left) > 2 or (len(left) == 2 and size[left[0]] == size[left[1]]):
        x, q = size[left] - size[left].mean(), p[left]
        norm = x @ x
        for k in range(len(left)):
            way = np.full(len(left), -1.0 / len(left))
            if norm > 0:
                way -= x[k] / norm * x
            way[k] += 1
            if abs(way[k]) > 1e-9:
                break
        way[np.abs(way) < 1e-12] = 0
        up, down = way > 0, way < 0
        ahead = min(((1 - q[up]) / way[up]).min(), (q[down] / -way[down]).min())
        back = min((q[up] / way[up]).min(), ((1 - q[down]) / -way[down]).min())
        q += way * (ahead if draw.random() * (ahead + back) < back else -back)
        q[q < _EPS], q[q > 1 - _EPS] = 0, 1
        p[left] = q
        left = left[(q > 0) & (q < 1)]
    return p


def land(units: list[list], draw: random.Random) -> None:
    """Round one or two open units, their probabilities kept."""
    if len(units) == 1:
        units[0][0] = int(draw.random() < units[0][0])
    elif units:
        (p, a), (q, b) = (u[:2] for u in units)
        mean = p * a + q * b
        designs = []
        for both in (max(0.0, p + q - 1), min(p, q)):
            parts = ((1, 1, both), (1, 0, p - both), (0, 1, q - both), (0, 0, 1 - p - q + both))
            designs.append((sum(w * abs(x * a + y * b - mean) for x, y, w in parts), parts))
        at = draw.random()
        for x, y, w in min(designs)[1]:
            at -= w
            if at < 0:
                break
        units[0][0], units[1][0] = x, y


_UNIT = pa.schema([("source", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("blocks", pa.int64()), ("p", pa.float64()), ("row", pa.int64())])
_UNIT_DDL = "source string, block long, size long, blocks long, p double, row long"


def _flight_rows(seed: int, turn: int):
    """Rows of _UNIT, sorted by source, block and size from large to small; landed where a source has one block."""

    def flown(batches):
        for (source, block), rows in groups_of(batches, 2):
            draw = random.Random(f"{seed}/{source!r}/{turn}/{block}")
            _, _, sizes, blocks, p, places = zip(*rows, strict=True)
            p = flight(np.array(p), np.array(sizes, np.float64), draw)
            if blocks[0] == 1:
                last = [[p[i], sizes[i], i] for i in np.flatnonzero((p > 0) & (p < 1))]
                land(last, draw)
                for x, _, i in last:
                    p[i] = x
            yield from ((source, block, n, blocks[0], x, row) for n, x, row in zip(sizes, p.tolist(), places, strict=True))

    return lambda batches: batches_of(flown(batches), _UNIT)


def cube_sample(rows: DataFrame, group: str, size: str, p: Column, order: list[Column], about: DataFrame | None = None, seed: int = 17) -> DataFrame:
    """Adds ``chosen`` (0 or 1): a balanced sample with inclusion probabilities ``p``, for each group.

    Each group's sum of ``p`` is kept to two rows, its sum of ``p * size`` to
    about the size of its smallest rows.  ``order`` makes rows of equal size
    tell apart; ``about`` has further columns of each group, which ``p`` may use.
    """
    placed = written(indexed_within(rows, group, [F.col(size).desc(), *order], about, count="__n"), "units")
    blocks = F.ceil(F.col("__n") / BLOCK)
    first = [F.col(group).alias("source"), (F.col("pos") % blocks).alias("block"), F.col(size).alias("size"), blocks.alias("blocks")]
    units = placed.select(*first, p.cast("double").alias("p"), F.col("pos").alias("row"))
    most = units.agg(F.max("blocks")).first()[0] or 1
    done, turn = [], 0
    while True:
        flown = units.repartition("source", "block").sortWithinPartitions("source", "block", F.col("size").desc(), "row").mapInArrow(_flight_rows(seed, turn), _UNIT_DDL)
        flown = written(flown, "flown")
        done.append(flown.where("p IN (0, 1)"))
        if most == 1:
            break
        units = flown.where("p NOT IN (0, 1)").withColumns({"block": F.floor(F.col("block") / MERGE), "blocks": F.ceil(F.col("blocks") / MERGE)})
        most, turn = -(-most // MERGE), turn + 1
    chosen = done[0]
    for t in done[1:]:
        chosen = chosen.unionByName(t)
    chosen = chosen.select(F.col("source").alias("__s"), F.col("row").alias("__r"), F.col("p").cast("int").alias("chosen"))
    return placed.join(chosen, F.col(group).eqNullSafe(F.col("__s")) & (F.col("pos") == F.col("__r"))).drop("__s", "__r", "pos", "__n")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), limit: float = 3, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17) -> DataFrame:
    """id, size, source_size, target (the source's) and taken (words that the mix takes of the document, repeats counted)."""
    rows = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("words")), "sizes")
    sources = rows.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = written(weighted_targets(sources, "source", weights, limit), "targets")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    certain = F.floor(times + _EPS)
    out = cube_sample(rows, "source", "words", F.greatest(times - certain, F.lit(0.0)), [F.col("id").asc()], targets, seed)
    discard(targets)
    return out.select(F.col("id").alias(id_col), F.col("words").alias("size"), "source_size", "target", (F.col("words") * (certain + F.col("chosen"))).cast("long").alias("taken"))
