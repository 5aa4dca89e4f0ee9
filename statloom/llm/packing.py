"""Best-fit packing of token sequences, planned on a histogram of lengths.

1.  Each text is tokenized once, in Arrow batches; an end token follows, and a
    sequence over ``capacity`` tokens is cut into pieces.  Only lengths and
    checksums are written, in few files of the folder that executors share.
2.  The number of pieces of each length (at most ``capacity`` rows) goes to the
    driver.  Best fit decreasing runs over these *counts*: a step puts as many
    pieces of one length as fit into all sequences with the least sufficient
    room at once.  The plan is a list of slots: a length, a range of ranks, and
    the sequences and offsets that they get.  Its size depends on the capacity,
    not on the corpus.
3.  Pieces are ranked within their length in two levels, so that no length
    needs its rows in one task, and look their slot up by (length, rank).

A null text counts as empty and becomes a sequence of just the end token; a
null or repeated id keeps one set of pieces for each row.  Other columns are
ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._stage import in_few, small_batches, written
from .tokens import encoder


def best_fit_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Slots (length, first rank, pieces, pieces a sequence, first sequence, offset).

    The piece of rank ``first rank + i`` goes to sequence ``first sequence + i //
    per`` at ``offset + i % per * length``.
    """
    rooms: list[int] = []  # the different rooms left, sorted
    groups: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, number of sequences)
    slots: list[tuple[int, int, int, int, int, int]] = []
    opened = 0

    def leave(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in groups:
                insort(rooms, room)
                groups[room] = []
            groups[room].append((first, n))

    def put(length: int, rank: int, count: int, room: int, first: int, n: int) -> int:
        per = room // length
        full = min(n, count // per)
        offset = capacity - room
        if full:
            slots.append((length, rank, full * per, per, first, offset))
            leave(room - per * length, first, full)
        rest = min(count - full * per, per) if full < n else 0
        if rest:
            slots.append((length, rank + full * per, rest, per, first + full, offset))
            leave(room - rest * length, first + full, 1)
        leave(room, first + full + (rest > 0), n - full - (rest > 0))
        return full * per + rest

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} doesn't fit a sequence of {capacity}")
        count, rank = counts[length], 0
        while rank < count:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                per = capacity // length
                n = -(-(count - rank) // per)
                rank += put(length, rank, count - rank, capacity, opened, n)
                opened += n
                continue
            room = rooms[at]
            first, n = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            rank += put(length, rank, count - rank, room, first, n)
    return np.array(sorted(slots), np.int64).reshape(-1, 6)


def _piece_rows(tokenizer: str, end_id: int, capacity: int):
    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            ids = batch.column("id")
            rows: list[tuple] = []
            for i, tokens in enc.encode_rows(batch.column("text")):
                whole = np.append(tokens, np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(whole), capacity)):
                    part = whole[start : start + capacity]
                    rows.append((i, piece, start, len(part), zlib.crc32(part.tobytes())))
            at, *cols = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 5
            names = ["id", "piece", "start", "length", "crc"]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *map(pa.array, cols)], names)

    return run


def _slot_rows(plan: np.ndarray):
    """Adds sequence and offset to rows with a length and a rank."""
    keys = plan[:, 0] << 44 | plan[:, 1]

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            slot = plan[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            i, per = rank - slot[:, 1], slot[:, 3]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "piece", "start", "length", "crc")), pa.array(slot[:, 4] + i // per), pa.array(slot[:, 5] + i % per * length)],
                ["id", "piece", "start", "length", "crc", "sequence", "offset"],
            )

    return run


def ranked(pieces: DataFrame, total: int) -> DataFrame:
    """Adds the rank of each row within its length, from 0, in two levels."""
    salts = max(16, -(-total // 50_000))
    rows = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "crc"), F.lit(salts)))
    sums = rows.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("id", "piece", "crc")
    rows = rows.withColumn("own", F.row_number().over(within) - 1)
    return rows.join(base, ["length", "salt"]).select("id", "piece", "start", "length", "crc", (F.col("base") + F.col("own")).alias("rank"))


def best_fit_pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = docs.mapInArrow(_piece_rows(tokenizer, end_id, capacity), "id long, piece long, start long, length long, crc long")
    pieces = written(pieces, "pieces", narrow=True)
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    plan = best_fit_plan(counts, capacity)
    total = sum(counts.values())
    out = ranked(pieces, total).mapInArrow(_slot_rows(plan), "id long, piece long, start long, length long, crc long, sequence long, offset long")
    return in_few(out, total).select(F.col("id").alias(id_col), F.col("piece").cast("int").alias("piece"), "start", "length", F.col("crc").alias("ids_crc32"), F.col("sequence").alias("sequence_id"), "offset")
