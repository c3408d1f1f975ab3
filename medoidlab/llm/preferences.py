"""Preference formatting: one prompt, two masked completions.

A pair holds a chosen and a rejected conversation. Their longest common turn prefix (same
role and text, turn by turn) is rendered once as the prompt; what follows is rendered as
two completions. The masks are character spans of the completions that carry loss: the
assistant's texts with their end marks, never headers or other roles' turns.

Cases: turns are ordered by (turn, role, text), so ties and repeated rows have a defined
order; a null text is empty and a null role is ``none``; ``<|`` inside a text is written
``< |``, so a text cannot open a turn; equal conversations give two empty completions; a
pair that lacks a side has an empty prompt and a null completion and mask there; an empty
table gives no rows; other columns are ignored. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medoidlab.llm.common import table

LOSS_ROLE = "assistant"
END = "<|end|>\n"


def _rendered(turns: Column) -> Column:
    """Array of turns -> array of structs (head, body): header text and text with end mark."""
    return F.transform(
        turns,
        lambda t: F.struct(
            F.concat(F.lit("<|"), t["role"], F.lit("|>\n")).alias("head"),
            F.concat(t["text"], F.lit(END)).alias("body"),
            (t["role"] == LOSS_ROLE).alias("loss"),
        ),
    )


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["head"], t["body"])), "")


def _mask(turns: Column) -> Column:
    """Spans ``start-end`` of the loss-carrying bodies, comma-separated."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def walk(seen: Column, t: Column) -> Column:
        body = seen["at"] + F.length(t["head"])
        end = body + F.length(t["body"])
        span = F.concat(body.cast("string"), F.lit("-"), end.cast("string"))
        spans = F.when(t["loss"], F.array_append(seen["spans"], span)).otherwise(seen["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.array_join(F.aggregate(turns, start, walk, lambda seen: seen["spans"]), ",")


def format_preferences(turns: DataFrame) -> DataFrame:
    """``turns`` (pair_id, side: 0 chosen or 1 rejected, turn, role, text) -> one row a
    pair: pair_id, prefix_turns, prompt, chosen, rejected, chosen_mask, rejected_mask.

    One shuffle, keyed by the pair; a task holds one pair's turns at a time."""
    text = F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("<|"), F.lit("< |"))
    rows = turns.select(
        "pair_id",
        "side",
        F.struct(
            F.col("turn"), F.coalesce(F.col("role"), F.lit("none")).alias("role"), text.alias("text")
        ).alias("t"),
    )
    sides = rows.groupBy("pair_id").agg(
        *[
            F.sort_array(F.collect_list(F.when(F.col("side") == s, F.col("t")))).alias(n)
            for s, n in ((0, "a"), (1, "b"))
        ]
    )
    least = F.least(F.size("a"), F.size("b"))
    same = F.zip_with(
        F.slice("a", 1, F.col("least")),
        F.slice("b", 1, F.col("least")),
        lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]),
    )
    first = F.array_position(F.col("same"), False)
    prefix = F.when(first > 0, first - 1).otherwise(F.col("least")).cast("int")
    cut = (
        sides.withColumn("least", least)
        .withColumn("same", same)
        .withColumn("prefix_turns", prefix)
        .select(
            "pair_id",
            "prefix_turns",
            _rendered(F.slice("a", 1, F.col("prefix_turns"))).alias("prompt_turns"),
            *[
                F.when(
                    F.size(s) > 0, _rendered(F.slice(s, F.col("prefix_turns") + 1, F.greatest(F.size(s), F.lit(1))))
                ).alias(n)
                for s, n in (("a", "chosen_turns"), ("b", "rejected_turns"))
            ],
        )
    )
    return cut.select(
        "pair_id",
        "prefix_turns",
        _joined(F.col("prompt_turns")).alias("prompt"),
        _joined(F.col("chosen_turns")).alias("chosen"),
        _joined(F.col("rejected_turns")).alias("rejected"),
        _mask(F.col("chosen_turns")).alias("chosen_mask"),
        _mask(F.col("rejected_turns")).alias("rejected_mask"),
    )


def op10_preferences(spark, sf_dir):
    """Conversations 2i (chosen) and 2i + 1 (rejected) are a pair."""
    turns = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id div 2 as pair_id", "cast(conv_id % 2 as int) as side", "turn", "role", "text"
    )
    return format_preferences(turns)


_SIDE_SQL = """
{n} AS (
  SELECT pair_id, string_agg(head || body, '' ORDER BY i) AS txt,
         string_agg(CASE WHEN role = 'assistant' THEN (e - length(body))::varchar || '-' || e::varchar END, ',' ORDER BY i) AS mask
  FROM (SELECT t.*, sum(length(head) + length(body)) OVER (PARTITION BY t.pair_id ORDER BY i) AS e
        FROM t JOIN p USING (pair_id) WHERE side = {s} AND i > prefix_turns)
  GROUP BY pair_id)"""
OP10_SQL = f"""
WITH r AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, coalesce(role, 'none') AS role,
         replace(coalesce(text, ''), '<|', '< |') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'none'),
                            replace(coalesce(text, ''), '<|', '< |')) AS i
  FROM conversations),
t AS (SELECT *, '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body FROM r),
j AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.i, b.i) AS i,
         (a.role = b.role AND a.text = b.text) IS TRUE AS same
  FROM (SELECT * FROM t WHERE side = 0) a FULL JOIN (SELECT * FROM t WHERE side = 1) b
    ON a.pair_id = b.pair_id AND a.i = b.i),
p AS (
  SELECT pair_id, cast(coalesce(min(i) FILTER (WHERE NOT same) - 1, max(i)) AS integer) AS prefix_turns
  FROM j GROUP BY pair_id),
s AS (SELECT pair_id, max(CASE WHEN side = 0 THEN 1 END) AS has_a, max(CASE WHEN side = 1 THEN 1 END) AS has_b
      FROM t GROUP BY pair_id),
q AS (SELECT pair_id, string_agg(head || body, '' ORDER BY i) AS txt FROM t JOIN p USING (pair_id)
      WHERE side = 0 AND i <= prefix_turns GROUP BY pair_id),
{_SIDE_SQL.format(n="ca", s=0)},
{_SIDE_SQL.format(n="cb", s=1)}
SELECT p.pair_id, p.prefix_turns, coalesce(q.txt, '') AS prompt,
       CASE WHEN has_a = 1 THEN coalesce(ca.txt, '') END AS chosen,
       CASE WHEN has_b = 1 THEN coalesce(cb.txt, '') END AS rejected,
       CASE WHEN has_a = 1 THEN coalesce(ca.mask, '') END AS chosen_mask,
       CASE WHEN has_b = 1 THEN coalesce(cb.mask, '') END AS rejected_mask
FROM p JOIN s USING (pair_id) LEFT JOIN q USING (pair_id) LEFT JOIN ca USING (pair_id) LEFT JOIN cb USING (pair_id)
"""
