"""Structure repair of conversations: the cheapest edits that make roles alternate, by A* on the edit lattice.

A conversation may begin with a system row; after that user and assistant take
turns, and an assistant ends it.  Rows are kept, given another role, deleted or
joined by inserted empty rows; blank and repeated rows must go, truncated ones
that stay are charged.

1.  Rows get their faults in the JVM, are sorted by range of (conversation,
    turn, role, text) and numbered through.  The first row of each (role, text)
    comes from an aggregate of numbers.
2.  Codes of the rows, without texts, are cut into pieces of ``PIECE`` numbers.
    A* solves each piece: the nodes are (row, state), the heuristic is the suffix
    sum of deletions that must come and of the least charge for truncated rows,
    and the queue is keyed (cost plus heuristic, audit).  A piece that holds a
    whole conversation has one search, any other one for each state it may be
    entered in, to all states it may be left in.
3.  The pieces of a conversation are joined in order, cheapest first, ties by
    audit.  So a conversation of any length is solved in many tasks; only its
    few numbers and its audit meet.
4.  Edits and texts meet by conversation in the order of the rows and stream
    through one digest, row by row; nothing is held but the digest.

Null roles and texts count as one space, as do null ids and turns inside the
key of the damage; null turns sort first, and rows of a turn by role and text.
A null conversation id is a conversation.  An empty table gives an empty
result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._order import batches_of, groups_of, indexed
from ._stage import written

#: Numbers of rows that a search covers at once.
PIECE = 1024

_WS = " \t\n\x0b\x0c\r"
#: Costs of the edits.
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, system, user, assistant.  The role that may follow each.
_NOTHING, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_STATE = {"s": _SYSTEM, "u": _USER, "a": _ASSISTANT}
_LEGAL = {"su", "ua", "au"}
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
#: Faults of a row; a dropped row only stands for its conversation.
_SOUND, _BLANK, _DUPLICATE, _TRUNCATED, _DROPPED = range(5)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and dropped of each row after its planned damage."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("d"))
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("d") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    gone = F.col("d") == 0
    return rows.select("conv_id", "turn", F.when(~gone, role).alias("role"), F.when(~gone, text).alias("text"), gone.alias("dropped"), F.explode(copies).alias("copy")).drop("copy")


def search(codes: list[tuple[int, int]], entry: int, exits: set[int] | None) -> dict[int, tuple[int, str]]:
    """Cheapest (cost, audit), ties by audit, from state ``entry`` through all rows.

    ``codes``: (state that a row's own role means or 0, fault).  ``exits``: the
    states to reach, all of them; None: any state that may end a conversation.
    """
    n = len(codes)
    ahead = [0] * (n + 1)  # deletions that must come, and the least that truncated rows cost
    for j in range(n - 1, -1, -1):
        fault = codes[j][1]
        ahead[j] = ahead[j + 1] + (DELETE if fault in (_BLANK, _DUPLICATE) else min(DELETE, TRUNCATED) if fault == _TRUNCATED else 0)
    queue, closed, found = [(ahead[0], "", 0, entry)], set(), {}
    while queue:
        f, audit, j, state = heappop(queue)
        if (j, state) in closed:
            continue
        closed.add((j, state))
        cost = f - ahead[j]
        if j == n:
            if exits is None:
                if state in (_NOTHING, _ASSISTANT):
                    return {state: (cost, audit)}
            elif state in exits:
                found[state] = (cost, audit)
                if len(found) == len(exits):
                    break
        follow = _NEXT[state]
        heappush(queue, (cost + INSERT + ahead[j], audit + "I", j, follow))
        if j < n:
            own, fault = codes[j]
            rest = cost + ahead[j + 1]
            heappush(queue, (rest + DELETE, audit + "D", j + 1, state))
            if fault in (_SOUND, _TRUNCATED):
                rest += TRUNCATED if fault else 0
                if own == follow or (own == _SYSTEM and state == _NOTHING):
                    heappush(queue, (rest, audit + "K", j + 1, own))
                if own != follow:
                    heappush(queue, (rest + RENAME, audit + "R", j + 1, follow))
    return found


class _Run:
    """Counts of consecutive rows, which add up; turns ascend, nulls first."""

    def __init__(self, rows=0, blank=0, duplicate=0, truncated=0, illegal=0, first=None, last=None, low=None, high=None, turns=0):
        self.rows, self.faults, self.illegal, self.first, self.last, self.low, self.high, self.turns = rows, [blank, duplicate, truncated], illegal, first, last, low, high, turns

    def add(self, other: _Run) -> None:
        if not other.rows:
            return
        self.illegal += other.illegal + (self.rows > 0 and self.last + other.first not in _LEGAL)
        self.faults = [x + y for x, y in zip(self.faults, other.faults, strict=True)]
        self.turns += other.turns - (self.high is not None and self.high == other.low)
        self.first, self.last = other.first if not self.rows else self.first, other.last
        self.low, self.high = other.low if self.low is None else self.low, other.high if other.high is not None else self.high
        self.rows += other.rows

    def fields(self) -> tuple:
        return (self.rows, *self.faults, self.illegal, self.first, self.last, self.low, self.high, self.turns)

    def gaps(self) -> int:
        return self.high - self.low + 1 - self.turns if self.turns else 0


_PIECE = pa.schema(
    [("conv", pa.int64()), ("piece", pa.int64()), ("g", pa.int64())]
    + [(c, pa.int64()) for c in ("rows", "blank", "duplicate", "truncated", "illegal")]
    + [("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64())]
    + [("ways", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
)
_PIECE_DDL = "conv long, piece long, g long, rows long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, ways array<long>, audits array<string>"


def _piece_rows(size: int):
    """Sorted (conv, piece, g, kind, turn, initial, fault); kind 0 marks a number as the first of its role and text."""

    def run(batches):
        for (conv, piece), rows in groups_of(batches, 2):
            firsts, counts, codes, g0, g = set(), _Run(), [], None, None
            for _, _, g, kind, turn, initial, fault in rows:
                if not kind:
                    firsts.add(g)
                    continue
                g0 = g if g0 is None else g0
                if fault == _DROPPED:
                    continue
                if fault != _BLANK and g not in firsts:
                    fault = _DUPLICATE
                counts.add(_Run(1, fault == _BLANK, fault == _DUPLICATE, fault == _TRUNCATED, 0, initial, initial, turn, turn, int(turn is not None)))
                codes.append((_STATE.get(initial, _NOTHING), fault))
            # a neighbour's number would lie in this piece too, unless it is across the edge
            starts, ends = g0 % size != 0, g % size != size - 1
            ways, audits = [], []
            for entry in (_NOTHING,) if starts else range(4):
                found = search(codes, entry, None if ends else set(range(4)) if entry == _NOTHING else {_SYSTEM, _USER, _ASSISTANT} if entry == _SYSTEM else {_USER, _ASSISTANT})
                for leave, (cost, audit) in found.items():
                    ways += [entry, leave, cost]
                    audits.append(audit)
            yield (conv, piece, g0, *counts.fields(), ways, audits)

    return lambda batches: batches_of(run(batches), _PIECE, 512)


class _Path:
    """Audits in a row, linked backwards."""

    __slots__ = ("audit", "before", "cost", "entry")

    def __init__(self, cost: int, audit: str = "", before: _Path | None = None, entry: int = 0):
        self.cost, self.audit, self.before, self.entry = cost, audit, before, entry

    def audits(self, until: _Path | None = None) -> list[str]:
        out, at = [], self
        while at is not until and at is not None:
            out.append(at.audit)
            at = at.before
        return out[::-1]

    def beats(self, other: _Path) -> bool:
        if self.cost != other.cost:
            return self.cost < other.cost
        a, b = self, other  # equally long: go back to where they part
        while a is not b and a.before is not b.before:
            a, b = a.before, b.before
        stop = None if a is b else a.before
        return "".join(self.audits(stop)) < "".join(other.audits(stop))


_STEP = pa.schema([("conv", pa.int64()), ("g", pa.int64()), ("kind", pa.int32()), ("edits", pa.string()), ("entry", pa.int32())] + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")])
_STEP_DDL = "conv long, g long, kind int, edits string, entry int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _join_pieces(batches):
    """Sorted pieces to the edits of each piece (kind 1), after a row (kind 0) with a conversation's counts and whole audit."""

    def run():
        for (conv,), rows in groups_of(batches, 1):
            counts, at, starts = _Run(), {_NOTHING: _Path(0)}, []
            for _, _, g, *fields, ways, audits in rows:
                counts.add(_Run(*fields))
                starts.append(g)
                best: dict[int, _Path] = {}
                for k, audit in enumerate(audits):
                    entry, leave, cost = ways[3 * k : 3 * k + 3]
                    if entry in at:
                        path = _Path(at[entry].cost + cost, audit, at[entry], entry)
                        if leave not in best or path.beats(best[leave]):
                            best[leave] = path
                at = best
            end = at.get(_ASSISTANT)
            if _NOTHING in at and (end is None or at[_NOTHING].beats(end)):
                end = at[_NOTHING]
            cost, parts = end.cost, []
            while end.before is not None:
                parts.append((end.audit, end.entry))
                end = end.before
            parts.reverse()
            yield conv, -1, 0, "".join(a for a, _ in parts), 0, counts.gaps(), *counts.faults, counts.illegal, cost
            for g, (audit, entry) in zip(starts, parts, strict=True):
                yield conv, g, 1, audit, entry, *[None] * 6

    return batches_of(run(), _STEP, 512)


_REPAIRED = pa.schema([("conv_id", pa.int64())] + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())])
_REPAIRED_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_OUT = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _edited(rows: Iterator[tuple]) -> Iterator[tuple[str, str]]:
    """(role, text) of a conversation after its edits; rows: edits (kind 1) before the rows (kind 2) of their piece."""
    edits, at, state = "", 0, _NOTHING
    for _, _, kind, audit, _, *_, role, text in rows:
        if kind == 1:
            while at < len(edits):  # insertions at the end of the piece before
                at, state = at + 1, _NEXT[state]
                yield _ROLE[state], ""
            edits, at = audit, 0
            continue
        while edits[at] == "I":
            at, state = at + 1, _NEXT[state]
            yield _ROLE[state], ""
        edit, at = edits[at], at + 1
        if edit == "K":
            state = _STATE[role[0]]
            yield role, text
        elif edit == "R":
            state = _NEXT[state]
            yield _ROLE[state], text
    while at < len(edits):
        at, state = at + 1, _NEXT[state]
        yield _ROLE[state], ""


def _digest_rows(batches):
    def run():
        for (conv,), rows in groups_of(batches, 1):
            _, _, _, audit, _, *counts, _, _ = next(rows)
            digest, first = hashlib.sha256(), True
            for role, text in _edited(rows):
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
            yield conv, *counts, audit, digest.hexdigest()

    return batches_of(run(), _REPAIRED)


def _text_rows(batches):
    def run():
        for (conv,), rows in groups_of(batches, 1):
            next(rows)
            for n, (role, text) in enumerate(_edited(rows)):
                yield conv, n, role, text

    return batches_of(run(), _OUT, 1024)


def planned(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """Rows (conv_id, turn, role, text, dropped) with their conversation's edits, sorted for ``_edited`` within each partition."""
    trimmed = F.rtrim(F.col("text"), F.lit(_WS))
    fault = F.when(F.col("dropped"), _DROPPED).when(trimmed == "", _BLANK).when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), _TRUNCATED).otherwise(_SOUND)
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text", fault.alias("fault"), digest.alias("digest"))
    rows = written(indexed(rows, [F.col(c).asc() for c in ("conv", "turn", "role", "text")], "g"), "turns")
    at = F.floor(F.col("g") / piece).alias("piece")
    firsts = rows.where(F.col("fault") != _DROPPED).groupBy("conv", "digest").agg(F.min("g").alias("g"))
    codes = rows.select("conv", at, "g", F.lit(1).alias("kind"), "turn", F.substring("role", 1, 1).alias("initial"), "fault")
    codes = codes.unionByName(firsts.select("conv", at, "g", F.lit(0).alias("kind")), allowMissingColumns=True)
    # firsts of a piece come before its rows
    codes = codes.repartition("conv", "piece").sortWithinPartitions("conv", "piece", "kind", "g")
    pieces = codes.mapInArrow(_piece_rows(piece), _PIECE_DDL).repartition("conv").sortWithinPartitions("conv", "piece")
    steps = written(pieces.mapInArrow(_join_pieces, _STEP_DDL), "edits")
    kept = rows.where(F.col("fault") != _DROPPED).select("conv", "g", F.lit(2).alias("kind"), "role", "text")
    both = steps.withColumns({"role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")}).unionByName(kept, allowMissingColumns=True)
    return both.repartition("conv").sortWithinPartitions("conv", "g", "kind")


def repaired_turns(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """conv_id, position, role and text of the repaired conversations; ``rows``: conv_id, turn, role, text."""
    return planned(rows.withColumn("dropped", F.lit(False)), piece).mapInArrow(_text_rows, "conv_id long, position long, role string, text string")


def repair_report(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """Counts of faults, cost, audit and digest of each conversation, damaged and repaired."""
    return planned(damage(conversations), piece).mapInArrow(_digest_rows, _REPAIRED_DDL)


def _repair_sql() -> str:
    from ._sql import crc32

    names = {"u": "user", "a": "assistant"}
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    moves = []  # state, inserted roles, edit, row's initial that it needs, next state, cost, new role
    for state in follow:
        at, put = state, []
        for _ in range(3):  # two insertions come back to the same turn
            edits, text = "I" * len(put), "".join(f"|{names[x]}:" for x in put)
            cost = INSERT * len(put)
            moves.append((state, edits + "D", None, at, cost + DELETE, text, "drop"))
            moves.append((state, edits + "R", None, follow[at], cost + RENAME, text, names[follow[at]]))
            moves += [(state, edits + "K", x, x, cost, text, "keep") for x in {follow[at], "s" if not at else follow[at]}]
            at = follow[at]
            put.append(at)
    quoted = ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'" for x in m) + ")" for m in sorted(moves, key=str))
    ends = "('', '', 0, ''), ('', 'II', 6, '|user:|assistant:'), ('s', 'II', 6, '|user:|assistant:'), ('u', 'I', 3, '|assistant:'), ('a', '', 0, '')"
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH RECURSIVE hurt AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
      {crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS d FROM conversations),
    met AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
      CASE WHEN d = 1 THEN '' WHEN d = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
      unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hurt WHERE d > 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS j, rtrim(text, {blank}) AS trimmed FROM met),
    turns AS (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY j) AS before,
      CASE WHEN trimmed = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY j) > 1 THEN 'd' WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM placed),
    counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
      count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(j) AS n FROM turns GROUP BY conv_id),
    moves(state, edits, needs, next, cost, put, how) AS (VALUES {quoted}),
    ends(state, edits, cost, put) AS (VALUES {ends}),
    best AS (SELECT conv_id, 0 AS j, '' AS state, struct_pack(cost := 0, audit := '', said := '') AS way FROM counts
      UNION ALL SELECT b.conv_id, b.j + 1, m.next, min(struct_pack(cost := b.way.cost + m.cost + CASE WHEN t.fault = 't' AND m.how <> 'drop' THEN {TRUNCATED} ELSE 0 END, audit := b.way.audit || m.edits,
        said := b.way.said || replace(m.put, '|', chr(10)) || CASE m.how WHEN 'drop' THEN '' WHEN 'keep' THEN chr(10) || t.role || ':' || t.text ELSE chr(10) || m.how || ':' || t.text END))
      FROM best AS b JOIN turns AS t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.j = b.j + 1
      JOIN moves AS m ON m.state = b.state AND (m.needs IS NULL OR m.needs = t.initial) AND (m.how = 'drop' OR t.fault IN ('', 't'))
      GROUP BY b.conv_id, b.j, m.next),
    done AS (SELECT b.conv_id, min(struct_pack(cost := b.way.cost + e.cost, audit := b.way.audit || e.edits, said := b.way.said || replace(e.put, '|', chr(10)))) AS way
      FROM best AS b JOIN counts AS c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n = b.j JOIN ends AS e ON e.state = b.state GROUP BY b.conv_id)
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
      coalesce(way.cost, 0)::BIGINT AS cost, coalesce(way.audit, '') AS audit, sha256(coalesce(substr(way.said, 2), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) AS o LEFT JOIN counts AS c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done AS f ON f.conv_id IS NOT DISTINCT FROM o.conv_id"""


SQL = _repair_sql()
