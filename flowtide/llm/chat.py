"""Multi-party perspective rotation of dialogues, in DataFrame functions alone.

Every participant gets a view of the dialogue: that speaker's turns become the
assistant's, everyone else's become a user's, with the speaker's name. A view is a
table of rendered turns in order, not one string: a dialogue of any length stays
distributed. Each turn has its place in the rendered view and the span of it on
which the loss is taken (the assistant's content and closing mark).

Participants are the distinct roles of a dialogue other than INSTRUCTORS, whose
turns are shown as system turns in every view.

Cases: null or blank roles speak as user `unknown` and get no view; null text is
empty; turns with equal numbers are ordered by role, then text, null first;
repeated rows are turns of their own; a dialogue without participants has no view;
null conv_id is a dialogue of its own; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INSTRUCTORS = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Turns whose places are summed up together before places are summed over a dialogue.
STRETCH = 256


def _turns(conversations: DataFrame) -> DataFrame:
    blank = F.trim(F.coalesce(F.col("role").cast("string"), F.lit(""))) == ""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(blank, "unknown").otherwise(F.col("role").cast("string")).alias("speaker"), (~blank).alias("named"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("content"),
    )


def _rendered(view: Column, speaker: Column, named: Column, content: Column) -> dict[str, Column]:
    instructs = named & speaker.isin(*INSTRUCTORS)
    role = F.when(instructs, "system").when(named & (speaker == view), "assistant").otherwise("user")
    name = F.when(role == "user", speaker)
    head = F.concat(F.lit(OPEN), role, F.when(name.isNotNull(), F.concat(F.lit(" name="), name)).otherwise(""), F.lit("\n"))
    return {"chat_role": role, "name": name, "head": head, "rendered": F.concat(head, content, F.lit(CLOSE))}


def rotate(conversations: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """conv_id, view, turn, place, chat_role, name, rendered, start, loss_start, loss_end.

    place counts the view's turns from 0; start, loss_start and loss_end are
    characters from the beginning of the rendered view; the loss span is empty
    (null) for turns of others.
    """
    turns = _turns(conversations)
    views = turns.where(F.col("named") & ~F.col("speaker").isin(*INSTRUCTORS)).select(F.col("conv_id").alias("c"), F.col("speaker").alias("view")).distinct()
    # The order within a dialogue is fixed by stretches of turn numbers, so that no window holds a whole long dialogue.
    turns = turns.withColumn("stretch", F.floor(F.col("turn") / stretch))
    inside = Window.partitionBy("conv_id", "view", "stretch").orderBy("turn", "speaker", "content")
    earlier = Window.partitionBy("conv_id", "view").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    shown = turns.join(views, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    for key, column in _rendered(F.col("view"), F.col("speaker"), F.col("named"), F.col("content")).items():
        shown = shown.withColumn(key, column)
    shown = shown.withColumn("size", F.char_length("rendered").cast("long"))
    sums = shown.groupBy("conv_id", "view", "stretch").agg(F.sum("size").alias("sum_size"), F.count("*").alias("sum_turns"))
    bases = sums.select(
        F.col("conv_id").alias("c"), F.col("view").alias("v"), F.col("stretch").alias("s"),
        F.coalesce(F.sum("sum_size").over(earlier), F.lit(0)).alias("base"), F.coalesce(F.sum("sum_turns").over(earlier), F.lit(0)).alias("base_turns"),
    )
    placed = shown.withColumn("before", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("row", F.row_number().over(inside))
    joined = placed.join(bases, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("view") == F.col("v")) & F.col("stretch").eqNullSafe(F.col("s")))
    start = (F.col("base") + F.col("before")).cast("long")
    mine = F.col("chat_role") == "assistant"
    return joined.select(
        "conv_id", "view", "turn", (F.col("base_turns") + F.col("row") - 1).cast("long").alias("place"), "chat_role", "name", "rendered", start.alias("start"),
        F.when(mine, start + F.char_length("head")).cast("long").alias("loss_start"), F.when(mine, start + F.col("size")).cast("long").alias("loss_end"),
    )


#: The same over the view `conversations`, in DuckDB's SQL.
SQL = """
WITH turns AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn,
    CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE role END AS speaker,
    trim(coalesce(role, '')) <> '' AS named, coalesce(text, '') AS content
  FROM conversations
), views AS (
  SELECT DISTINCT conv_id AS c, speaker AS "view" FROM turns WHERE named AND speaker <> 'system'
), shown AS (
  SELECT *, CASE WHEN named AND speaker = 'system' THEN 'system' WHEN named AND speaker = "view" THEN 'assistant' ELSE 'user' END AS chat_role
  FROM turns JOIN views ON conv_id IS NOT DISTINCT FROM c
), heads AS (
  SELECT *, CASE WHEN chat_role = 'user' THEN speaker END AS name,
    '<|im_start|>' || chat_role || CASE WHEN chat_role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head
  FROM shown
), rendered AS (SELECT *, head || content || '<|im_end|>' || chr(10) AS rendered FROM heads
), placed AS (
  SELECT *, row_number() OVER w - 1 AS place, coalesce(sum(length(rendered)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM rendered WINDOW w AS (PARTITION BY conv_id, "view" ORDER BY turn NULLS FIRST, speaker, content)
)
SELECT conv_id, "view", turn, CAST(place AS BIGINT) AS place, chat_role, name, rendered, CAST(start AS BIGINT) AS start,
  CAST(CASE WHEN chat_role = 'assistant' THEN start + length(head) END AS BIGINT) AS loss_start,
  CAST(CASE WHEN chat_role = 'assistant' THEN start + length(rendered) END AS BIGINT) AS loss_end
FROM placed
"""
