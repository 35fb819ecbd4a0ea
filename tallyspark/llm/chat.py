"""Preference formatting (DataFrame functions only).

A pair names a chosen and a rejected conversation.  Their longest common prefix of turns is rendered
once, as the prompt; what follows is rendered for each side as a completion, in which only the
assistant's words (and their end mark) are to be trained on.

The result has one row per rendered message, not one per conversation, so a conversation of any
length is never gathered: messages are compared turn by turn in partial aggregates, the first turn
that differs is a minimum per pair, and the join back to the messages is one that adaptive execution
can split.  ``assemble`` joins a pair's messages into strings where that is wanted.

Defined cases: messages of one conversation and turn form one turn, equal to another if it has the
same messages as often, in any order; a null role reads ``unknown`` and a null text is empty; a null turn
comes after all others; a null ``conv_id`` belongs to no conversation; a side without messages has an
empty completion; equal conversations are all prompt, without completions; repeated pairs each
appear; an empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The marks around a message.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
LAST_TURN = (1 << 62) - 1


def adjacent_pairs(turns: DataFrame) -> DataFrame:
    """The convention of the tables: an even ``conv_id`` is chosen over the odd one that follows it."""
    ids = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("c"))
    first = (F.col("c") - F.pmod("c", F.lit(2))).cast("long")
    return ids.groupBy(first.alias("chosen_id")).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("chosen_id").alias("pair_id"), "chosen_id", (F.col("chosen_id") + 1).alias("rejected_id"))


def preference_messages(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(pair_id, part, turn, role, rendered, train_begin, train_until)`` from ``pairs`` ``(pair_id, chosen_id, rejected_id)``.

    ``part`` is prompt, chosen or rejected; characters ``train_begin`` to ``train_until`` of ``rendered`` are
    trained on (both 0 where nothing is)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    role = F.coalesce(F.col("role"), F.lit("unknown"))
    said = turns.select(F.col("conv_id").cast("long").alias("conv"), F.coalesce(F.col("turn").cast("long"), F.lit(LAST_TURN)).alias("at"), role.alias("role"), text.alias("text"))
    sides = pairs.select("pair_id", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("chosen_id").cast("long").alias("conv")),
        F.struct(F.lit(1).alias("side"), F.col("rejected_id").cast("long").alias("conv")))).alias("s")).select("pair_id", "s.side", "s.conv")
    messages = said.join(sides, "conv").select("pair_id", "side", "at", "role", "text")
    marks = [F.xxhash64("role", "text"), F.xxhash64(F.lit("message"), "text", "role")]

    def tally(side: int) -> list:
        own = F.col("side") == side
        return [F.count(F.when(own, 1)), *[F.coalesce(F.sum(F.when(own, m.cast("decimal(20,0)"))), F.lit(0)) for m in marks]]

    same = F.lit(True)
    for a, b in zip(tally(0), tally(1)):
        same = same & (a == b)
    compared = messages.groupBy("pair_id", "at").agg(same.alias("same"))
    parted = compared.groupBy("pair_id").agg(F.min(F.when(~F.col("same"), F.col("at"))).alias("parts_at"))
    common = F.col("parts_at").isNull() | (F.col("at") < F.col("parts_at"))
    placed = messages.join(parted, "pair_id").where(~common | (F.col("side") == 0))
    part = F.when(common, F.lit("prompt")).when(F.col("side") == 0, F.lit("chosen")).otherwise(F.lit("rejected"))
    head = F.concat(F.lit(OPEN), F.col("role"), F.lit(CLOSE))
    trained = ~common & (F.col("role") == "assistant")
    rendered = F.concat(head, "text", F.lit(END))
    return placed.select(
        "pair_id", part.alias("part"), F.when(F.col("at") < LAST_TURN, F.col("at")).alias("turn"), "role", rendered.alias("rendered"),
        F.when(trained, F.char_length(head)).otherwise(F.lit(0)).cast("long").alias("train_begin"),
        F.when(trained, F.char_length(rendered)).otherwise(F.lit(0)).cast("long").alias("train_until"))


def assemble(messages: DataFrame) -> DataFrame:
    """One row per pair: ``prompt``, ``chosen``, ``rejected`` as strings.  Gathers each pair, so for conversations that fit a row."""
    order = F.struct(F.coalesce("turn", F.lit(LAST_TURN)).alias("turn"), "role", "rendered")

    def joined(part: str):
        return F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.when(F.col("part") == part, order))), lambda m: m["rendered"])).alias(part)

    return messages.groupBy("pair_id").agg(joined("prompt"), joined("chosen"), joined("rejected"))


def preference_digest(turns: DataFrame) -> DataFrame:
    return preference_messages(turns, adjacent_pairs(turns))


ORACLE = r"""
WITH m AS (SELECT conv_id - conv_id % 2 AS pair_id, conv_id % 2 AS side, coalesce(turn, 4611686018427387903) AS pos, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT pair_id, pos, list_sort(coalesce(list(role || chr(1) || text) FILTER (side = 0), [])) = list_sort(coalesce(list(role || chr(1) || text) FILTER (side = 1), [])) AS same FROM m GROUP BY pair_id, pos),
p AS (SELECT pair_id, min(pos) FILTER (NOT same) AS parts_at FROM c GROUP BY pair_id),
x AS (SELECT m.*, parts_at IS NULL OR pos < parts_at AS common FROM m JOIN p USING (pair_id))
SELECT pair_id, CASE WHEN common THEN 'prompt' WHEN side = 0 THEN 'chosen' ELSE 'rejected' END AS part,
       CASE WHEN pos < 4611686018427387903 THEN pos END AS turn, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered,
       CASE WHEN NOT common AND role = 'assistant' THEN length('<|' || role || '|>') + 1 ELSE 0 END::BIGINT AS train_begin,
       CASE WHEN NOT common AND role = 'assistant' THEN length('<|' || role || '|>') + 1 + length(text) + 8 ELSE 0 END::BIGINT AS train_until
FROM x WHERE NOT common OR side = 0
"""
