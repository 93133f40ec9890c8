"""Multi-party chats seen from every participant's place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import stored

#: A conversation of more turns isn't one task's; so many narrow rows are broadcast; a rendered dialogue has at most so many characters.
MOST_TURNS, FEW_ROWS, MOST_CHARS = 10_000, 100_000, 10_000_000
#: Fixed markers of the rendered form.
OPEN, BREAK, CLOSE = "<|", "|>\n", "<|end|>\n"
ASSISTANT, OTHER = "assistant", "user:"


def rotate(turns: DataFrame, most_turns: int = MOST_TURNS) -> DataFrame:
    """For every participant of a conversation, the dialogue with that speaker as assistant and others as named users.

    One row per (conversation, perspective, turn): the rendered ``segment``, whether it is the assistant's, and the
    code points ``loss_start``..``loss_end`` of it that count in training (the assistant's text with its end marker;
    empty for others). ``position`` numbers the turns from 0; a conversation's text is its segments in that order,
    joined by nothing; ``dialogues`` joins them. Texts move once, to their conversation. A conversation of more than
    ``most_turns`` turns never becomes one task's group: its turns are numbered over a range partition with one total
    per partition and conversation, as in prefix sums.

    Equal turn numbers are ordered by role, then text; repeated rows stay. A null role is the participant ``unknown``;
    null text is empty, and long texts are whole; null turns come first; null conversation ids form one conversation.
    Other columns, whatever their names, don't matter. Empty tables give none.
    """
    t = turns.select(
        turns["conv_id"].cast("bigint").alias("conv_id"),
        turns["turn"].cast("bigint").alias("turn"),
        F.coalesce(turns["role"].cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce(turns["text"].cast("string"), F.lit("")).alias("text"),
        # The two together stand for the id, and join and group alike where it is null.
        F.coalesce(turns["conv_id"].cast("bigint"), F.lit(0)).alias("c"),
        turns["conv_id"].isNull().alias("lost"),
    )
    key = ["c", "lost"]
    huge = stored(t.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_turns).drop("n"))
    people = t.groupBy(*key, F.col("speaker").alias("perspective")).agg(F.count(F.lit(1)).alias("n")).drop("n")
    by = Window.partitionBy(*key).orderBy("turn", "speaker", "text")
    number = huge.count()
    if not number:
        return rendered(t.withColumn("position", F.row_number().over(by) - 1).join(people, key))
    few = F.broadcast(huge) if number <= FEW_ROWS else huge
    usual = t.join(few, key, "left_anti").withColumn("position", F.row_number().over(by) - 1).join(people, key)
    crowd = people.join(few, key, "left_semi")
    crowd = F.broadcast(crowd) if crowd.count() <= FEW_ROWS else crowd
    return rendered(usual).union(rendered(numbered(t.join(few, key, "left_semi")).join(crowd, key)))


def rendered(seen: DataFrame) -> DataFrame:
    """The segment of each turn from each perspective."""
    own = F.col("speaker") == F.col("perspective")
    name = F.when(own, F.lit(ASSISTANT)).otherwise(F.concat(F.lit(OTHER), F.col("speaker")))
    head = F.concat(F.lit(OPEN), name, F.lit(BREAK))
    return seen.select(
        "conv_id",
        "perspective",
        F.col("position").cast("bigint").alias("position"),
        "turn",
        "speaker",
        own.alias("is_assistant"),
        F.concat(head, "text", F.lit(CLOSE)).alias("segment"),
        F.when(own, F.char_length(head)).otherwise(F.lit(0)).cast("bigint").alias("loss_start"),
        F.when(own, F.char_length(head) + F.char_length("text") + F.char_length(F.lit(CLOSE))).otherwise(F.lit(0)).cast("bigint").alias("loss_end"),
    )


def dialogues(segments: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """conv_id, perspective, text and mask (the code points [start, end) that count in training) from rotate()'s rows.

    Dialogues of more than ``most_chars`` code points, which no single value should hold, have null text and mask;
    their segments stay what rotate() gives.
    """
    size = F.sum(F.char_length("segment").cast("bigint"))
    part = F.struct("position", "segment", (F.col("loss_end") - F.col("loss_start")).alias("n"), "loss_start")
    whole = segments.groupBy("conv_id", "perspective").agg(size.alias("chars"))
    held = segments.join(
        whole.where(F.col("chars") <= most_chars).select(F.col("conv_id").alias("k"), F.col("perspective").alias("v")),
        F.col("conv_id").eqNullSafe(F.col("k")) & (F.col("perspective") == F.col("v")),
        "left_semi",
    )
    parts = held.groupBy(F.col("conv_id").alias("k"), F.col("perspective").alias("v")).agg(F.sort_array(F.collect_list(part)).alias("parts"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    add = lambda s, x: F.struct(
        (s["at"] + F.char_length(x["segment"])).alias("at"),
        F.when(x["n"] > 0, F.concat(s["mask"], F.array(F.struct((s["at"] + x["loss_start"]).alias("start"), (s["at"] + x["loss_start"] + x["n"]).alias("end"))))).otherwise(s["mask"]).alias("mask"),
    )
    mask = F.aggregate("parts", F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("mask")), add)["mask"]
    return whole.join(parts, F.col("conv_id").eqNullSafe(F.col("k")) & (F.col("perspective") == F.col("v")), "left").select(
        "conv_id", "perspective", F.array_join(F.transform("parts", lambda x: x["segment"]), "").alias("text"), mask.alias("mask")
    )


def numbered(t: DataFrame) -> DataFrame:
    """position: from 0 in each conversation, by (turn, speaker, text), without a task that needs a whole conversation."""
    n = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key, order = ["c", "lost"], ["turn", "speaker", "text"]
    dealt = t.repartitionByRange(n, *key, *order).sortWithinPartitions(*key, *order)
    # The number of a row in its partition, after the partition's number.
    dealt = stored(dealt.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}))
    counts = dealt.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*key, "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    # One row per partition and huge conversation.
    return dealt.join(F.broadcast(offsets), [*key, "part"]).withColumn("position", F.col("row") + F.col("shift")).drop("part", "row", "shift")


ORACLE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, speaker, text) - 1 AS position FROM t),
p AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM t),
j AS (SELECT *, speaker = perspective AS own, concat('{OPEN}', CASE WHEN speaker = perspective THEN '{ASSISTANT}' ELSE concat('{OTHER}', speaker) END, '|>', chr(10)) AS head
  FROM n JOIN p ON conv_id = c)
SELECT conv_id, perspective, position, turn, speaker, own AS is_assistant, concat(head, text, '<|end|>', chr(10)) AS segment,
  CASE WHEN own THEN length(head) ELSE 0 END AS loss_start, CASE WHEN own THEN length(head) + length(text) + 8 ELSE 0 END AS loss_end
FROM j
"""
