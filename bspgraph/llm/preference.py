"""Operator 3: preference formatting of chosen and rejected conversations, in DataFrame functions only.

The longest common prefix of turns (equal role and text, position by position) is rendered once as the prompt; what follows in
each conversation is rendered as its completion. A completion's mask lists the character ranges of its assistant texts, closing
mark included: tokens there carry loss, all others are masked.

Only the two conversations of one pair meet in one row, so no group grows with the corpus; pairs without both sides are left out.

Cases: null roles and texts count as empty and are equal to empty ones; turns are ordered by (turn, role, text), so ties and
repeated rows have a fixed place; equal conversations give two empty completions; conversations without a common turn give an empty
prompt; a null pair id forms no pair; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def render(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"), turn["text"], F.lit(CLOSE + "\n"))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of equal leading elements of two arrays."""
    both = F.least(F.size(a), F.size(b))
    same = lambda n, k: F.when((n == k) & (F.get(a, k) == F.get(b, k)), n + 1).otherwise(n)
    return F.when(both > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(both - 1, F.lit(0))), F.lit(0), same)).otherwise(F.lit(0))


def loss_mask(turns: Column, trained_role: str) -> Column:
    """``from:to`` character ranges of the trained role's texts in the rendered turns, comma-joined."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        body = state["at"] + F.length(turn["role"]) + (len(OPEN) + 1)
        end = body + F.length(turn["text"]) + len(CLOSE)
        spans = F.when(turn["role"] == trained_role, F.concat(state["spans"], F.array(F.concat_ws(":", body.cast("string"), end.cast("string"))))).otherwise(state["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    return F.concat_ws(",", F.aggregate(turns, start, step, lambda s: s["spans"]))


def preference_pairs(
    chosen: DataFrame, rejected: DataFrame, pair_column: str = "pair_id", turn_column: str = "turn", role_column: str = "role",
    text_column: str = "text", trained_role: str = "assistant",
) -> DataFrame:
    """(pair, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask) of every pair with both sides."""
    def side(df: DataFrame, name: str) -> DataFrame:
        turns = F.struct(F.col(turn_column).alias("turn"), F.coalesce(F.col(role_column), F.lit("")).alias("role"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
        return df.select(F.col(pair_column).alias("pair"), F.lit(name).alias("side"), turns.alias("t")).where(F.col("pair").isNotNull())

    rows = side(chosen, "chosen").unionByName(side(rejected, "rejected"))
    turns = lambda name: F.array_sort(F.collect_list(F.when(F.col("side") == name, F.col("t"))))
    pairs = rows.groupBy("pair").agg(turns("chosen").alias("c"), turns("rejected").alias("r")).where((F.size("c") > 0) & (F.size("r") > 0))
    said = lambda name: F.transform(name, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    pairs = pairs.select("pair", said("c").alias("c"), said("r").alias("r"))
    pairs = pairs.withColumn("n", common_prefix(F.col("c"), F.col("r")))
    rest = lambda name: F.slice(name, F.col("n") + 1, F.size(name))
    text = lambda turns: F.array_join(F.transform(turns, render), "")
    return pairs.select(
        F.col("pair").alias(pair_column), F.col("n").cast("long").alias("prompt_turns"), text(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"),
        text(rest("c")).alias("chosen"), text(rest("r")).alias("rejected"), loss_mask(rest("c"), trained_role).alias("chosen_mask"), loss_mask(rest("r"), trained_role).alias("rejected_mask"),
    )


#: The query op3 in DuckDB SQL.
ORACLE = """
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), whole AS (
  SELECT pair_id FROM t GROUP BY 1 HAVING count(DISTINCT side) = 2
), c AS (SELECT t.* FROM t JOIN whole USING (pair_id) WHERE side = 0
), r AS (SELECT t.* FROM t JOIN whole USING (pair_id) WHERE side = 1
), apart AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.pos, r.pos) AS pos,
         c.role IS NOT NULL AND r.role IS NOT NULL AND c.role = r.role AND c.text = r.text AS same
  FROM c FULL JOIN r ON c.pair_id = r.pair_id AND c.pos = r.pos
), prefix AS (
  SELECT pair_id, coalesce(min(CASE WHEN NOT same THEN pos END) - 1, max(pos)) AS n FROM apart GROUP BY 1
), drawn AS (
  SELECT t.pair_id, side, pos, pos <= n AS shared, role, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS said,
         length(role) + 13 AS head, length(text) + 10 AS body
  FROM t JOIN prefix USING (pair_id)
), placed AS (
  SELECT *, sum(length(said)) OVER (PARTITION BY pair_id, side, shared ORDER BY pos) - length(said) + head AS spot FROM drawn
), parts AS (
  SELECT pair_id, side, string_agg(said, '' ORDER BY pos) FILTER (shared) AS prompt, string_agg(said, '' ORDER BY pos) FILTER (NOT shared) AS answer,
         string_agg(CAST(CAST(spot AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(spot + body AS BIGINT) AS VARCHAR), ',' ORDER BY pos) FILTER (NOT shared AND role = 'assistant') AS mask
  FROM placed GROUP BY 1, 2
)
SELECT p.pair_id, CAST(p.n AS BIGINT) AS prompt_turns, coalesce(a.prompt, '') AS prompt, coalesce(a.answer, '') AS chosen, coalesce(b.answer, '') AS rejected,
       coalesce(a.mask, '') AS chosen_mask, coalesce(b.mask, '') AS rejected_mask
FROM prefix p JOIN parts a ON a.pair_id = p.pair_id AND a.side = 0 JOIN parts b ON b.pair_id = p.pair_id AND b.side = 1
"""
