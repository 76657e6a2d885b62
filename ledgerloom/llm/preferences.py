"""Preference formatting of conversations, in DataFrame functions.

A pair of conversations, chosen and rejected, shares a prefix of turns. The prefix is rendered
once as the prompt; what follows is rendered for either side, and only assistant turns there
are trained on. Everything is a row per turn: the prefix ends before the smallest turn at which
the sides differ, which is one aggregate, so a conversation may be as long as a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.registry import query, table
from ledgerloom.session import stage

_TURN = ["pair_id", "turn", "role", "text"]


def _turns(rows: DataFrame, side: str) -> DataFrame:
    """Typed turns of one side; repeated rows count once."""
    return rows.select(
        F.col("pair_id").cast("long").alias("pair_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.lit(side).alias("side"),
    ).filter("pair_id IS NOT NULL AND turn IS NOT NULL").distinct()


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rendered turns of pairs, from ``chosen`` and ``rejected`` (pair_id, turn, role, text).

    Returns pair_id, section (prompt, chosen or rejected), turn, role, rendered and trained.
    The prompt is the longest run of first turns that both sides have alike. ``trained`` is
    true for assistant turns of the completions; everything else is masked. Texts of a section
    in order of (turn, role, rendered) make up its text.

    Sides that are alike give a prompt alone; a side without rows gives the other one as a
    completion. Null roles and texts are empty; rows without pair_id or turn are left out,
    since they have no place. Repeated rows count once, and several rows of one turn are alike
    when all of them are. Other columns are ignored.
    """
    both = stage(_turns(chosen, "chosen").union(_turns(rejected, "rejected")), "turns")
    mark = F.xxhash64("role", "text")

    def told(side: str) -> list:
        own = F.col("side") == side
        return [
            F.count(F.when(own, 1)).alias(f"{side}_n"),
            F.bit_xor(F.when(own, mark)).alias(f"{side}_mark"),
        ]

    parting = (
        both.groupBy("pair_id", "turn")
        .agg(*told("chosen"), *told("rejected"))
        .filter("NOT (chosen_n = rejected_n AND chosen_mark <=> rejected_mark)")
        .groupBy("pair_id")
        .agg(F.min("turn").alias("parting"))
    )
    parting = stage(parting, "parting")
    common = F.col("parting").isNull() | (F.col("turn") < F.col("parting"))
    section = F.when(common, F.lit("prompt")).otherwise(F.col("side"))
    return (
        both.join(parting, "pair_id", "left")
        .filter(~common | (F.col("side") == "chosen"))
        .select(
            "pair_id",
            section.alias("section"),
            "turn",
            "role",
            F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("<|end|>\n")).alias("rendered"),
            (~common & (F.col("role") == "assistant")).alias("trained"),
        )
    )


def stale_answers(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chosen, rejected) for conversations that have a single course each.

    Chosen is the conversation. Rejected ends at the last answer (the last assistant turn) and has a
    stale one there: the words of the assistant turn before, or, if there is none, of the last turn
    before it, or nothing. Turns after the last answer are on the chosen side alone, where they are
    masked as all turns of others. Without an assistant turn both sides are the whole conversation,
    which makes a prompt alone. Of several rows of one turn the stale words are the greatest; repeated
    rows count once.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("pair_id"), "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    ).filter("pair_id IS NOT NULL AND turn IS NOT NULL")
    answers = F.when(F.col("role") == "assistant", F.col("turn"))
    last = stage(rows.groupBy("pair_id").agg(F.max(answers).alias("last")), "last")
    marked = rows.join(last, "pair_id")
    last = last.filter("last IS NOT NULL")
    earlier = marked.filter("turn < last").select(
        "pair_id", "last", F.struct((F.col("role") == "assistant").alias("own"), "turn", "text").alias("e")
    )
    stale = (
        earlier.groupBy("pair_id", "last").agg(F.max("e").alias("e"))
        .join(last, ["pair_id", "last"], "right")
        .select(
            "pair_id", F.col("last").alias("turn"), F.lit("assistant").alias("role"),
            F.coalesce("e.text", F.lit("")).alias("text"),
        )
    )
    rejected = marked.filter("last IS NULL OR turn < last").select(*_TURN).union(stale)
    return rows.select(*_TURN), rejected


OP8_SQL = """
WITH r AS (SELECT DISTINCT conv_id AS pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
l AS (SELECT pair_id, max(turn) AS last FROM r WHERE role = 'assistant' GROUP BY pair_id),
e AS (SELECT pair_id, text, row_number() OVER (PARTITION BY pair_id
  ORDER BY role = 'assistant' DESC, turn DESC, text DESC) AS k FROM r JOIN l USING (pair_id) WHERE turn < last),
c AS (SELECT * FROM r),
j AS (SELECT r.* FROM r LEFT JOIN l USING (pair_id) WHERE last IS NULL OR turn < last
  UNION ALL SELECT l.pair_id, l.last, 'assistant', coalesce(e.text, '') FROM l LEFT JOIN e ON e.pair_id = l.pair_id AND k = 1),
diff AS ((SELECT * FROM c EXCEPT SELECT * FROM j) UNION ALL (SELECT * FROM j EXCEPT SELECT * FROM c)),
p AS (SELECT pair_id, min(turn) AS parting FROM diff GROUP BY pair_id),
a AS (SELECT *, 'chosen' AS side FROM c UNION ALL SELECT *, 'rejected' AS side FROM j)
SELECT a.pair_id, CASE WHEN parting IS NULL OR turn < parting THEN 'prompt' ELSE side END AS section, turn, role,
  '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered,
  NOT (parting IS NULL OR turn < parting) AND role = 'assistant' AS trained
FROM a LEFT JOIN p USING (pair_id) WHERE side = 'chosen' OR (parting IS NOT NULL AND turn >= parting)
"""


@query("op8_chat_formatting", OP8_SQL)
def _op8(spark, folder):
    return format_preferences(*stale_answers(table(spark, folder, "conversations")))
