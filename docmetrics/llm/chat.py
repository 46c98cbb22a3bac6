"""Chat formatting by multi-party perspective rotation.

Method: a conversation is rendered once for every speaker in it. In a speaker's rendering that speaker is
the assistant, all others are users named after themselves, and turns of the ``system`` role stay system
turns; only the assistant's own words (with their end mark) are trained on. Speakers are the distinct
non-system roles or names of the conversation.

A rendering is a table of segments in order, not one string: each row is one turn's text in one rendering,
with its place in it (``start``, ``end``, code points) and the span to train on (``mask_start``, ``mask_end``).
The rendering is the segments joined in order (``render`` does that for conversations of a bounded size), so
a conversation with a third of all turns is no larger a row than others. Offsets are running sums in three
steps (rows of a turn, turns of a block, blocks), so no task holds a whole rendering. They need lengths only: turns meet
the speakers of their conversation, and are placed, without their texts; each distinct text is shuffled once, to the places of
its turn, and written out for every speaker in the last projection (turns times speakers is the size of the result).

Defined results: turns are ordered by number (nulls first), ties by the MD5 of speaker and text; repeated rows are turns of
their own; a null text is empty; a null or empty role is the speaker ``unknown``; turns of a null
conversation are left out (they belong together with nothing); a conversation of system turns alone has no
rendering; ``<|`` inside a text or a name is written ``< |``, so that no text can close a turn; an empty table
gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 512
NO_TURN = -(2**62)  # the place of rows without a turn number
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rotate_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                        text_col: str = "text", system_role: str = "system") -> DataFrame:
    """-> a row per rendering and turn: conv_id, perspective, turn, speaker, role, segment, start, end,
    mask_start, mask_end (null where nothing is trained on)."""
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                        F.coalesce(F.nullif(F.trim(F.col(role_col)), F.lit("")), F.lit("unknown")).alias("speaker"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("conv_id IS NOT NULL")
    rows = rows.withColumn("tie", F.md5(F.concat("speaker", F.lit("|"), "text").cast("binary")))

    # Places need lengths only. Equal turns are one row with their number: they follow one another.
    turn = ["conv_id", "turn", "speaker", "tie"]
    short = rows.groupBy(turn).agg(F.count("*").alias("copies"), F.first(F.length(safe(F.col("text")))).cast("long").alias("letters"))
    speakers = short.where(F.col("speaker") != system_role).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    role = F.when(F.col("speaker") == system_role, "system").when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    head = F.concat(F.lit(OPEN), F.col("role"), F.when(F.col("role") == "user", F.concat(F.lit(" name="), safe(F.col("speaker")))).otherwise(F.lit("")), F.lit("\n"))
    both = short.join(speakers, "conv_id").withColumn("role", role).withColumn("head", F.length(head).cast("long"))
    both = both.withColumn("one", F.col("head") + F.col("letters") + len(CLOSE) + 1).withColumn("size", F.col("one") * F.col("copies")).drop("letters")

    # Three steps of running sums, none of which sees more than a bounded number of rows at once:
    # the turns of one number and hash cell, the cells of one block of numbers, the blocks of one rendering.
    both = (both.withColumn("at", F.coalesce("turn", F.lit(NO_TURN))).withColumn("block", F.floor(F.col("at") / BLOCK))
            .withColumn("cell", F.substring("tie", 1, 2)))
    block, cell = ["conv_id", "perspective", "block"], ["conv_id", "perspective", "block", "at", "cell"]
    cells = both.groupBy(cell).agg(F.sum("size").alias("s"))
    blocks = cells.groupBy(block).agg(F.sum("s").alias("b")).withColumn(
        "before_block", F.expr("sum(b) OVER (PARTITION BY conv_id, perspective ORDER BY block) - b")).drop("b")
    cells = cells.withColumn("before_cell", F.expr("sum(s) OVER (PARTITION BY conv_id, perspective, block ORDER BY at, cell) - s")).drop("s")
    inside = F.expr("sum(size) OVER (PARTITION BY conv_id, perspective, block, at, cell ORDER BY tie, speaker, turn "
                    "ROWS UNBOUNDED PRECEDING) - size")
    placed = (both.withColumn("inside", inside).join(cells, cell).join(blocks, block)
              .select(*turn, "perspective", "role", "copies", "head", "one", (F.col("before_block") + F.col("before_cell") + F.col("inside")).alias("first")))

    # Each distinct text travels once, to the places of its turn; it is written out per rendering behind that.
    texts = rows.groupBy(turn).agg(F.first("text").alias("text")).select(*(F.col(c).alias(f"_{c}") for c in turn), "text")
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in turn))
    full = (placed.join(texts, same).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
            .withColumn("start", F.col("first") + F.col("copy") * F.col("one")).withColumn("end", F.col("start") + F.col("one"))
            .withColumn("segment", F.concat(head, safe(F.col("text")), F.lit(CLOSE + "\n"))))
    own = F.col("role") == "assistant"
    return full.select("conv_id", "perspective", "turn", "speaker", "role", "segment", "start", "end",
                       F.when(own, F.col("start") + F.col("head")).alias("mask_start"), F.when(own, F.col("end") - 1).alias("mask_end"))


def render(segments: DataFrame) -> DataFrame:
    """conv_id, perspective, text, masks: whole renderings, for conversations known to be of a bounded size."""
    rows = F.array_sort(F.collect_list(F.struct("start", "segment", "mask_start", "mask_end")))
    return segments.groupBy("conv_id", "perspective").agg(rows.alias("r")).select(
        "conv_id", "perspective", F.array_join("r.segment", "").alias("text"),
        F.transform(F.filter("r", lambda x: x["mask_start"].isNotNull()), lambda x: F.struct(x["mask_start"].alias("start"), x["mask_end"].alias("end"))).alias("masks"))
