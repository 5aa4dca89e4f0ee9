"""URL verdicts from rules and from a cascade of Bloom filters.

A rule names a host and a path prefix; it fits the host and its subdomains, and
the longest fitting rule decides.  Where no rule fits, a cascade decides whether
the host or a domain that it is in is listed.  Its first level is a Bloom filter
of the listed domains, the second one of the names that the first passes
wrongly, and so on in turn until nothing is wrong.  The key universe is complete
(all hosts of the pages and the domains they are in, and the list), so
membership is exact, and a page is judged by its own bits alone: no join with
the list.

The universe's distinct names are dealt into shards by hash, about
``SHARD_KEYS`` in each, and each task builds the cascade of its shard.  The
cascades take about two bytes for a listed name and are broadcast; beyond
``BROADCAST_BYTES`` the pages are judged in several passes, each with the
cascades of some shards.

A null url, or one without ``://``, has an empty host and path, fits no rule and
is not listed.  Rows that repeat keep their own results; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._stage import written

#: Distinct hosts that one task builds a cascade of.
SHARD_KEYS = 200_000
#: Bytes of cascades that are broadcast at once.
BROADCAST_BYTES = 64 << 20
MAX_LEVELS = 64

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host(url: str) -> Column:
    """The host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _CAPITALS, _CAPITALS.lower())


def _rest(url: str) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")


def path(url: str) -> Column:
    """The path: from the host's end up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def rule_of(rules: list[tuple[str, str, str]], host_col: str, path_col: str) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule (verdict, host, path), else nulls."""
    rule = verdict = F.when(F.lit(False), F.lit(""))
    for said, domain, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((F.col(host_col) == domain) | F.col(host_col).endswith("." + domain)) & F.col(path_col).startswith(start)
        rule, verdict = rule.when(fits, domain + start), verdict.when(fits, said)
    return rule, verdict


def _bits(h1: np.ndarray, h2: np.ndarray, level: int, k: int, m: int) -> np.ndarray:
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
    steps = np.arange(k, dtype=np.uint64)[:, None] * T.mix(h2 ^ salt)
    return T.mix(h1 + salt + steps) % np.uint64(m)


def build_cascade(listed: tuple[np.ndarray, np.ndarray], rest: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int, bytes]]:
    """Levels (bits, hash functions, filter) that tell the listed hash pairs from the rest."""
    levels: list[tuple[int, int, bytes]] = []
    inside, outside = listed, rest
    while len(inside[0]):
        if len(levels) == MAX_LEVELS:
            raise ValueError("two keys of the universe have the same hashes")
        n = len(inside[0])
        rate = min(0.5, n / max(1, len(outside[0])) * 0.7) if not levels else 0.5
        k = max(1, round(-np.log2(rate)))
        m = max(64, int(n * k * 1.45) + 1)
        bits = np.zeros(m, bool)
        bits[_bits(*inside, len(levels), k, m).ravel()] = True
        levels.append((m, k, np.packbits(bits).tobytes()))
        wrong = bits[_bits(*outside, len(levels) - 1, k, m)].all(axis=0)
        inside, outside = tuple(x[wrong] for x in outside), inside
    return levels


def in_cascade(levels: list[tuple[int, int, np.ndarray]], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Which keys are listed: a key passes levels until one stops it, and the count's parity tells."""
    passed = np.zeros(len(h1), np.int64)
    left = np.arange(len(h1))
    for level, (m, k, bits) in enumerate(levels):
        at = _bits(h1[left], h2[left], level, k, m).astype(np.int64)
        left = left[((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)]
        passed[left] += 1
    return passed % 2 == 1


def _build_rows(table: pa.Table) -> pa.Table:
    listed = table["listed"].to_numpy()
    h = [table[c].to_numpy().view(np.uint64) for c in ("h1", "h2")]
    levels = build_cascade(tuple(x[listed] for x in h), tuple(x[~listed] for x in h))
    n = len(levels)
    return pa.table({"shard": pa.array([table["shard"][0].as_py()] * n, pa.int64()), "level": pa.array(range(n), pa.int32()), "m": pa.array([x[0] for x in levels], pa.int64()), "k": pa.array([x[1] for x in levels], pa.int32()), "bits": pa.array([x[2] for x in levels], pa.binary())})


def host_cascades(universe: DataFrame, listed: DataFrame) -> tuple[DataFrame, int]:
    """(cascade levels by shard, number of shards) of two tables with a column host."""
    keys = universe.select("host", F.lit(False).alias("listed")).unionByName(listed.select("host", F.lit(True).alias("listed")))
    keys = written(keys.where("host is not null").groupBy("host").agg(F.max("listed").alias("listed")), "hosts")
    shards = max(16, -(-keys.count() // SHARD_KEYS))
    h1 = F.xxhash64("host")
    rows = keys.select(h1.alias("h1"), F.xxhash64(F.reverse("host")).alias("h2"), F.pmod(h1, F.lit(shards)).alias("shard"), "listed")
    built = rows.groupBy("shard").applyInArrow(_build_rows, "shard long, level int, m long, k int, bits binary")
    return written(built, "cascade"), shards


def _domains(host_col: str) -> Column:
    """A host and the domains that it is in, by cutting labels off; none for an empty host."""
    labels = F.split(host_col, r"\.")
    cut = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(F.col(host_col) == "", F.array().cast("array<string>")).otherwise(cut)


def _probe_rows(cascades, shards: int):
    """Marks the rows of which some name is in the cascades that are at hand."""

    def run(batches):
        ready = {s: [(m, k, np.frombuffer(b, np.uint8)) for m, k, b in x] for s, x in cascades.value.items()}
        for batch in batches:
            names = batch.column("h1")
            owner = np.repeat(np.arange(batch.num_rows), names.value_lengths().fill_null(0).to_numpy())
            h1, h2 = (batch.column(c).flatten().to_numpy().view(np.uint64) for c in ("h1", "h2"))
            shard, out = h1.view(np.int64) % shards, batch.column("listed").to_numpy(zero_copy_only=False).copy()
            for s in np.unique(shard).tolist():
                if s in ready:
                    at = np.flatnonzero(shard == s)
                    out[owner[at[in_cascade(ready[s], h1[at], h2[at])]]] = True
            yield pa.RecordBatch.from_arrays([pa.array(out) if c == "listed" else batch.column(c) for c in batch.schema.names], batch.schema.names)

    return run


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, id_col: str = "page_id", url_col: str = "url", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per page: id, host, path, rule (or null), verdict (allow or block).

    ``rules`` are (allow or block, host, path prefix); ``listed`` has a column host: domains to block with all below them.
    """
    pages = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    pages = pages.select("id", host("url").alias("host"), path("url").alias("path"))
    names = pages.select("host").distinct().select(F.explode(_domains("host")).alias("host"))
    cascades, shards = host_cascades(names, listed.where("host != ''"))
    hashes = [F.transform(_domains("host"), f).alias(n) for n, f in (("h1", lambda x: F.xxhash64(x)), ("h2", lambda x: F.xxhash64(F.reverse(x))))]
    rows = pages.select("*", *hashes, F.lit(False).alias("listed"))
    schema = rows.schema
    size = 0
    sizes = cascades.groupBy("shard").agg(F.sum(F.length("bits")).alias("n")).orderBy("shard").collect()  # one row for each shard
    passes: list[list[int]] = [[]]
    for r in sizes:
        if passes[-1] and size + r["n"] > broadcast_bytes:
            passes.append([])
            size = 0
        passes[-1].append(r["shard"])
        size += r["n"]
    for k, some in enumerate(passes):
        held: dict[int, list] = {}
        for r in cascades.where(F.col("shard").isin(some)).orderBy("shard", "level").collect():
            held.setdefault(r["shard"], []).append((r["m"], r["k"], bytes(r["bits"])))
        if k:
            rows = written(rows, "judged")
        rows = rows.mapInArrow(_probe_rows(pages.sparkSession.sparkContext.broadcast(held), shards), schema)
    rule, verdict = rule_of(rules, "host", "path")
    by_list = F.when(F.col("listed"), "block").otherwise("allow")
    return rows.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, by_list).alias("verdict"))
