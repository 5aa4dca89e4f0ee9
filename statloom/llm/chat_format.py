"""Preference formatting: a shared prompt and paired, masked completions.

Of a chosen and a rejected conversation, the longest common prefix of turns is
rendered once as the prompt; what follows on either side is a completion, in
which only the assistant's turns count for the loss.

The turns of two conversations are compared by an aggregation over (pair,
turn), and the first turn that differs is a minimum over a pair's turns, so that
no conversation has to fit into one row or task.  ``segments`` has one row per
rendered turn; ``records`` joins them to one row per pair, or for conversations
of over ``CHUNK_TURNS`` turns, per pair and chunk.

Pairs are given (``paired_turns``), or the rejected side is made from the chosen
one: ``swapped_turns`` puts the last answer of another conversation in the place
of a conversation's own.

Null ids or turns take no part; a null role or text counts as empty.  Rows that
repeat count once; two different rows of one turn number are one turn, rendered
in the order of role and text.  Equal conversations give a prompt without
completions; a side without rows gives a prompt of no turns and the other
side's completion.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._order import indexed_within

#: Turn numbers of one row of ``records``.
CHUNK_TURNS = 64


def rendered(role: str, text: str) -> Column:
    """A turn with its role marks."""
    return F.concat(F.lit("<|"), F.col(role), F.lit("|>\n"), F.col(text), F.lit("<|end|>\n"))


def neighbour_pairs(conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Pairs (pair_id, chosen, rejected) of each even conversation with the next odd one."""
    ids = conversations.select((F.col(conv_col) - F.pmod(conv_col, F.lit(2))).alias("pair_id")).where("pair_id is not null").distinct()
    return ids.select("pair_id", F.col("pair_id").alias("chosen"), (F.col("pair_id") + 1).alias("rejected"))


def _turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return conversations.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).where("conv is not null and turn is not null")


def paired_turns(conversations: DataFrame, pairs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Different turns (pair_id, turn, role, text) of pairs (pair_id, chosen, rejected); c and r: whether either side has them.

    ``turn`` is a turn's place in its conversation, from 0, whatever its number:
    sides whose numbers begin elsewhere or have gaps are compared place by place.
    """
    turns = _turns(conversations, conv_col, turn_col, role_col, text_col)
    places = indexed_within(turns.select("conv", "turn").distinct(), "conv", [F.col("turn").asc()]).select(F.col("conv").alias("__c"), F.col("turn").alias("__t"), "pos")
    turns = turns.join(places, (F.col("conv") == F.col("__c")) & (F.col("turn") == F.col("__t"))).select("conv", F.col("pos").alias("turn"), "role", "text")
    sides = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit(1).alias("c"), F.lit(0).alias("r"), F.col("chosen").alias("conv")), F.struct(F.lit(0).alias("c"), F.lit(1).alias("r"), F.col("rejected").alias("conv")))).alias("s")).select("pair_id", "s.c", "s.r", "s.conv")
    return turns.join(sides, "conv").groupBy("pair_id", "turn", "role", "text").agg(F.max("c").alias("c"), F.max("r").alias("r"))


def swapped_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """Turns as ``paired_turns`` has them, of each conversation and a rejected form of it.

    The rejected form has the last answer of the conversation whose id differs
    in the last bit.  Where either has no answer, both forms are equal.
    """
    turns = _turns(conversations, conv_col, turn_col, role_col, text_col)
    answers = turns.where(F.col("role") == learn).groupBy("conv").agg(F.max(F.struct("turn", "text")).alias("a"))
    others = answers.select(F.col("conv").bitwiseXOR(F.lit(1)).alias("conv"), F.col("a.text").alias("other"))
    swaps = answers.select("conv", F.col("a.turn").alias("last")).join(others, "conv")
    own = turns.join(swaps.select("conv", "last"), "conv", "left")
    answer = F.coalesce((F.col("turn") == F.col("last")) & (F.col("role") == learn), F.lit(False))
    own = own.select(F.col("conv").alias("pair_id"), "turn", "role", "text", F.lit(1).alias("c"), F.when(answer, 0).otherwise(1).alias("r"))
    put = swaps.select(F.col("conv").alias("pair_id"), F.col("last").alias("turn"), F.lit(learn).alias("role"), F.col("other").alias("text"), F.lit(0).alias("c"), F.lit(1).alias("r"))
    return own.unionByName(put).groupBy("pair_id", "turn", "role", "text").agg(F.max("c").alias("c"), F.max("r").alias("r"))


def formatted(both: DataFrame, learn: str = "assistant") -> DataFrame:
    """Rows (pair_id, part, turn, role, segment, loss) from turns with sides; part is prompt, chosen or rejected.

    ``loss`` is 1 for the turns of the role ``learn`` in completions, else 0.
    """
    splits = both.groupBy("pair_id").agg(F.min(F.when(F.col("c") + F.col("r") < 2, F.col("turn"))).alias("split"))
    rows = both.join(splits, "pair_id")
    shared = F.col("split").isNull() | (F.col("turn") < F.col("split"))
    part = F.when(shared, F.array(F.lit("prompt"))).otherwise(F.array_compact(F.array(F.when(F.col("c") == 1, "chosen"), F.when(F.col("r") == 1, "rejected"))))
    rows = rows.select("pair_id", F.explode(part).alias("part"), "turn", "role", rendered("role", "text").alias("segment"))
    loss = F.when((F.col("part") != "prompt") & (F.col("role") == learn), 1).otherwise(0)
    return rows.select("pair_id", "part", "turn", "role", "segment", loss.alias("loss"))


def segments(conversations: DataFrame, pairs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """``formatted`` turns of given pairs."""
    return formatted(paired_turns(conversations, pairs, conv_col, turn_col, role_col, text_col), learn)


def records(rows: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """One row per pair and chunk from ``segments``: prompt, chosen, rejected and the spans that count for the loss.

    A chunk has the turn numbers from ``chunk * chunk_turns``; spans count
    characters of the completion in that chunk.
    """

    def text(part: str) -> Column:
        own = F.filter("turns", lambda t: t["part"] == part)
        return F.array_join(F.transform(own, lambda t: t["segment"]), "").alias(part)

    def spans(part: str) -> Column:
        own = F.filter("turns", lambda t: t["part"] == part)
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))
        step = lambda a, t: F.struct(
            (a["at"] + F.length(t["segment"])).alias("at"),
            F.when(t["loss"] == 1, F.concat(a["out"], F.array(F.struct(a["at"].alias("s"), (a["at"] + F.length(t["segment"])).alias("e"))))).otherwise(a["out"]).alias("out"),
        )
        return F.aggregate(own, start, step, lambda a: a["out"]).alias(f"{part}_loss")

    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "segment", "part", "loss"))).alias("turns")
    chunk = F.floor(F.col("turn") / chunk_turns).cast("long").alias("chunk")
    return rows.groupBy("pair_id", chunk).agg(turns).select("pair_id", "chunk", text("prompt"), text("chosen"), text("rejected"), spans("chosen"), spans("rejected"))


def preference_records(conversations: DataFrame) -> DataFrame:
    """The records of ``swapped_turns``, with loss spans as text: start-end, joined by commas."""
    rows = records(formatted(swapped_turns(conversations)))
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["s"].cast("string"), x["e"].cast("string"))), ",")
    return rows.select("pair_id", "chunk", "prompt", "chosen", "rejected", shown("chosen_loss").alias("chosen_loss"), shown("rejected_loss").alias("rejected_loss"))


#: The rows of ``preference_records`` of the table conversations.
SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
l AS (SELECT conv_id, max(turn) AS turn FROM t WHERE role = 'assistant' GROUP BY conv_id),
a AS (SELECT conv_id, turn, max(text) AS text FROM t JOIN l USING (conv_id, turn) WHERE role = 'assistant' GROUP BY conv_id, turn),
w AS (SELECT a.conv_id, a.turn AS last, o.text AS other FROM a JOIN a AS o ON o.conv_id = xor(a.conv_id, 1)),
u AS (SELECT conv_id AS pair_id, turn, role, text, 1 AS c, CASE WHEN turn = last AND role = 'assistant' THEN 0 ELSE 1 END AS r FROM t LEFT JOIN w USING (conv_id)
  UNION ALL SELECT conv_id, last, 'assistant', other, 0, 1 FROM w),
b AS (SELECT pair_id, turn, role, text, max(c) AS c, max(r) AS r FROM u GROUP BY pair_id, turn, role, text),
s AS (SELECT pair_id, min(CASE WHEN c + r < 2 THEN turn END) AS split FROM b GROUP BY pair_id),
p AS (SELECT pair_id, CASE WHEN split IS NULL OR turn < split THEN 'prompt' ELSE side END AS part, turn, role, CAST(floor(turn / {CHUNK_TURNS}.0) AS BIGINT) AS chunk,
    '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS segment
  FROM b JOIN s USING (pair_id), (VALUES ('chosen'), ('rejected')) AS sides(side)
  WHERE (split IS NULL OR turn < split) AND side = 'chosen'
    OR turn >= split AND (side = 'chosen' AND c = 1 OR side = 'rejected' AND r = 1)),
e AS (SELECT *, length(segment) AS n, sum(length(segment)) OVER (PARTITION BY pair_id, chunk, part ORDER BY turn, role, segment) AS e FROM p)
SELECT pair_id, chunk, coalesce(string_agg(segment, '' ORDER BY turn, role, segment) FILTER (part = 'prompt'), '') AS prompt,
  coalesce(string_agg(segment, '' ORDER BY turn, role, segment) FILTER (part = 'chosen'), '') AS chosen,
  coalesce(string_agg(segment, '' ORDER BY turn, role, segment) FILTER (part = 'rejected'), '') AS rejected,
  coalesce(string_agg((e - n) || '-' || e, ',' ORDER BY e) FILTER (part = 'chosen' AND role = 'assistant'), '') AS chosen_loss,
  coalesce(string_agg((e - n) || '-' || e, ',' ORDER BY e) FILTER (part = 'rejected' AND role = 'assistant'), '') AS rejected_loss
FROM e GROUP BY pair_id, chunk
"""
