"""Multi-party perspective rotation of dialogues, in DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered once with that speaker as the assistant, the
other speakers as named users, and a mask that trains on the assistant's turns alone. The rendering stays a row a turn,
in turn order, so that no conversation, however long, is ever gathered into one row or task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unmarked(c: Column) -> Column:
    """Text without the marks of the rendering: a blank parts ``<|`` and ``|>``, so no speaker or text can open or close a turn."""
    return F.replace(F.replace(c, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def rotate(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", context: tuple[str, ...] = ("system",)) -> DataFrame:
    """conv_id, perspective, turn, role, name, rendered, loss_start, loss_end: a row a turn and participant.

    ``context`` speakers take no perspective and stay themselves. The mask is the interval of code points of ``rendered``
    on which to train (empty outside the assistant's turns). Null speakers count as "unknown", null texts as empty; rows
    without a conversation id form one conversation; repeated rows are rendered each. The participants of a conversation
    are few, its turns may be many: the join splits a conversation that many rows share. Very long texts are rendered whole;
    no rows, no rows. Marks inside names and texts are parted by a blank, and the mask covers the text as rendered.
    """
    t = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown")).alias("speaker"), unmarked(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"))
    people = t.where(~F.col("speaker").isin(*context)).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    j = t.join(people, F.col("conv_id").eqNullSafe(F.col("of")))
    mine, aside = F.col("speaker") == F.col("perspective"), F.col("speaker").isin(*context)
    role = F.when(mine, "assistant").when(aside, F.col("speaker")).otherwise("user")
    name = F.when(~mine & ~aside, F.col("speaker"))
    head = F.concat(F.lit("<|"), role, F.coalesce(F.concat(F.lit(" name="), unmarked(name)), F.lit("")), F.lit("|>\n"))
    out = j.select("conv_id", "perspective", "turn", role.alias("role"), name.alias("name"), head.alias("head"), "text", mine.alias("mine"))
    start = F.length("head").cast("long")
    return out.select("conv_id", "perspective", "turn", "role", "name", F.concat("head", "text", F.lit("<|end|>\n")).alias("rendered"), F.when(F.col("mine"), start).otherwise(F.lit(0).cast("long")).alias("loss_start"), F.when(F.col("mine"), start + F.length("text") + F.length(F.lit("<|end|>"))).otherwise(F.lit(0).cast("long")).alias("loss_end"))
