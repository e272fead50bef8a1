"""Preference formatting of conversation pairs.

Of a chosen and a rejected conversation, the longest common prefix of turns is rendered once as the prompt; the turns
after it become two completions with the spans that carry loss (assistant turns). The prefix ends at the least turn
number at which the two differ, found by an aggregate over turns, so that a conversation is put together only once it is
known where it is cut. A pair is one row, whatever its number of turns: what it renders must fit a row (2 GB).

Defined results: a pair needs turns of both conversations, others are left out; rows without pair or turn number are
left out; null role and text count as empty; of rows that repeat a turn the least by (role, text) counts; equal
conversations give a prompt and two empty completions; `<|` in a text is broken up so that it can't pose as a mark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rendered(role, text):
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("<|end|>\n"))


def format_preferences(turns: DataFrame) -> DataFrame:
    """turns: pair_id, chosen (boolean), turn, role, text. One row per pair: prompt_turns (length of the common
    prefix), prompt, chosen, rejected, and for each completion the spans [start, end) that carry loss."""
    clean = turns.where("pair_id IS NOT NULL AND turn IS NOT NULL AND chosen IS NOT NULL")
    said = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    both = clean.groupBy("pair_id", "turn").agg(F.min(F.when(F.col("chosen"), said)).alias("c"), F.min(F.when(~F.col("chosen"), said)).alias("r"))
    ends = both.groupBy("pair_id").agg(F.min(F.when(~F.col("c").eqNullSafe(F.col("r")), F.col("turn"))).alias("differ"), F.count("c").alias("nc"), F.count("r").alias("nr"), F.count(F.when(F.col("c").eqNullSafe(F.col("r")), 1)).alias("same"))
    ends = ends.where("nc > 0 AND nr > 0").drop("nc", "nr")
    joined = both.join(ends, "pair_id")
    prompt = F.col("differ").isNull() | (F.col("turn") < F.col("differ"))
    piece = lambda side: F.struct(F.col("turn").alias("turn"), rendered(F.col(f"{side}.role"), F.col(f"{side}.text")).alias("t"), (F.col(f"{side}.role") == "assistant").alias("loss"))
    pairs = joined.groupBy("pair_id").agg(
        F.count(F.when(prompt, 1)).alias("prompt_turns"),
        *[F.sort_array(F.collect_list(F.when(keep & F.col(side).isNotNull(), piece(side)))).alias(name) for name, side, keep in (("prompt", "c", prompt), ("chosen", "c", ~prompt), ("rejected", "r", ~prompt))],
    )
    text = lambda c: F.array_join(F.transform(c, lambda x: x["t"]), "")

    def spans(c):
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("s"))
        step = lambda a, x: F.struct((a["at"] + F.length(x["t"])).alias("at"), F.when(x["loss"], F.array_append(a["s"], F.struct(a["at"].alias("start"), (a["at"] + F.length(x["t"])).alias("end")))).otherwise(a["s"]).alias("s"))
        return F.aggregate(c, start, step, lambda a: a["s"])

    return pairs.select("pair_id", "prompt_turns", text("prompt").alias("prompt"), text("chosen").alias("chosen"), text("rejected").alias("rejected"), spans("chosen").alias("chosen_mask"), spans("rejected").alias("rejected_mask"))


def neighbour_pairs(conversations: DataFrame) -> DataFrame:
    """Conversations 2j (chosen) and 2j + 1 (rejected) as pair j."""
    return conversations.select(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 0).alias("chosen"), "turn", "role", "text")


def digest(formatted: DataFrame) -> DataFrame:
    mask = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return formatted.select("pair_id", "prompt_turns", "prompt", "chosen", "rejected", mask("chosen_mask").alias("chosen_mask"), mask("rejected_mask").alias("rejected_mask"))


ORACLE = """
WITH t AS (
  SELECT CAST(conv_id // 2 AS BIGINT) AS pair_id, conv_id % 2 = 0 AS chosen, turn, min({'role': coalesce(role, ''), 'text': coalesce(text, '')}) AS m
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
b AS (
  SELECT pair_id, turn, min(m) FILTER (chosen) AS c, min(m) FILTER (NOT chosen) AS r FROM t GROUP BY ALL),
e AS (
  SELECT pair_id, min(turn) FILTER (c IS DISTINCT FROM r) AS differ FROM b GROUP BY pair_id HAVING count(c) > 0 AND count(r) > 0),
s AS (
  SELECT pair_id, turn, 'p' AS side, c AS m FROM b JOIN e USING (pair_id) WHERE differ IS NULL OR turn < differ
  UNION ALL SELECT pair_id, turn, 'c', c FROM b JOIN e USING (pair_id) WHERE turn >= differ AND c IS NOT NULL
  UNION ALL SELECT pair_id, turn, 'r', r FROM b JOIN e USING (pair_id) WHERE turn >= differ AND r IS NOT NULL),
w AS (
  SELECT *, '<|' || m.role || '|>' || chr(10) || replace(m.text, '<|', '< |') || '<|end|>' || chr(10) AS x FROM s),
o AS (
  SELECT *, sum(length(x)) OVER (PARTITION BY pair_id, side ORDER BY turn) AS e FROM w)
SELECT pair_id, count(*) FILTER (side = 'p') AS prompt_turns,
  coalesce(string_agg(x, '' ORDER BY turn) FILTER (side = 'p'), '') AS prompt,
  coalesce(string_agg(x, '' ORDER BY turn) FILTER (side = 'c'), '') AS chosen,
  coalesce(string_agg(x, '' ORDER BY turn) FILTER (side = 'r'), '') AS rejected,
  coalesce(string_agg((e - length(x)) || ':' || e, ',' ORDER BY turn) FILTER (side = 'c' AND m.role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((e - length(x)) || ':' || e, ',' ORDER BY turn) FILTER (side = 'r' AND m.role = 'assistant'), '') AS rejected_mask
FROM o GROUP BY pair_id
"""
