"""Multi-party perspective rotation of dialogues for chat training.

For every participant of a conversation the whole dialogue is rendered once,
with that participant as the assistant and the others as named users. The
result is one row per turn and perspective with its rendered text, its place in
the perspective's text and its loss mask: all the rows of a perspective, in
order, are its text, so a conversation of any length needs no row of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Roles that set the scene: they speak in every perspective and have none.
CONTEXT_ROLES = ("system",)
#: Turn numbers that are summed up together before offsets are laid out.
BLOCK_TURNS = 1024


def safe(text: Column) -> Column:
    """Text in which the turn markers can't occur."""
    return F.replace(F.replace(text, F.lit("<|"), F.lit("<\\|")), F.lit("|>"), F.lit("|\\>"))


def rotate_perspectives(spark: SparkSession, turns: DataFrame, context_roles: tuple[str, ...] = CONTEXT_ROLES) -> DataFrame:
    """``conv_id, perspective, turn, speaker, role, segment, start, end,
    mask_start, mask_end`` for each turn and participant.

    ``role`` is assistant for the perspective's own turns, user for the other
    participants', system for context. The segment is
    ``<|role name|>text<|end|>\\n``, the name given to users alone. ``start`` and
    ``end`` are character positions in the perspective's text; the loss mask
    covers ``mask_start`` to ``mask_end``, an own turn's text and its end
    marker, and is empty for others. Turns are ordered by number, then speaker
    and text; null numbers come first. A null speaker is ``unknown``, a null
    text empty, and rows with a null conv_id are one conversation. Repeated
    rows are turns of their own. A conversation with no participant gives no
    row; nor does an empty table. Other columns are ignored.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("unknown")).alias("speaker"), safe(F.coalesce(F.col("text"), F.lit(""))).alias("body"),
    ).withColumn("scene", F.col("speaker").isin(*context_roles))
    people = rows.where(~F.col("scene")).select(F.col("conv_id").alias("conv"), F.col("speaker").alias("perspective")).distinct()
    seen = rows.join(people, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")
    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("scene"), "system").when(own, "assistant").otherwise("user")
    head = F.concat(F.lit("<|"), role, F.when(F.col("scene") | own, "").otherwise(F.concat(F.lit(" "), safe(F.col("speaker")))), F.lit("|>"))
    seen = seen.select("conv_id", "perspective", "turn", "speaker", role.alias("role"), F.concat(head, "body", F.lit("<|end|>\n")).alias("segment"), F.length(head).alias("head"), own.alias("own"), F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK_TURNS).alias("block"))
    size = F.length("segment").cast("long")
    dialogue = ["conv_id", "perspective"]
    blocks = seen.groupBy(*dialogue, "block").agg(F.sum(size).alias("chars"))
    before = F.sum("chars").over(Window.partitionBy(*dialogue).orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("chars")
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), before.alias("before"))
    seen = seen.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b")))
    within = Window.partitionBy(*dialogue, "block").orderBy("turn", "speaker", "segment").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.col("before") + F.sum(size).over(within)
    out = seen.withColumn("end", end).withColumn("start", F.col("end") - size)
    mask_start, mask_end = F.when(F.col("own"), F.col("start") + F.col("head")).otherwise(F.col("start")), F.when(F.col("own"), F.col("end") - 1).otherwise(F.col("start"))
    return out.select("conv_id", "perspective", "turn", "speaker", "role", "segment", "start", "end", mask_start.alias("mask_start"), mask_end.alias("mask_end"))


ORACLE = r"""
with turns as (select conv_id, turn, coalesce(role, 'unknown') as speaker, replace(replace(coalesce(text, ''), '<|', '<\|'), '|>', '|\>') as body from conversations),
people as (select distinct conv_id, speaker as perspective from turns where speaker <> 'system'),
seen as (select t.conv_id, perspective, turn, speaker, body, speaker = perspective as own,
  case when speaker = 'system' then 'system' when speaker = perspective then 'assistant' else 'user' end as role
  from turns t join people p on t.conv_id is not distinct from p.conv_id),
heads as (select *, '<|' || role || case when role = 'user' then ' ' || replace(replace(speaker, '<|', '<\|'), '|>', '|\>') else '' end || '|>' as head from seen),
segments as (select *, head || body || '<|end|>' || chr(10) as segment from heads),
ends as (select *, cast(sum(length(segment)) over (partition by conv_id, perspective order by turn nulls first, speaker, segment rows unbounded preceding) as bigint) as "end" from segments)
select conv_id, perspective, turn, speaker, role, segment, "end" - length(segment) as start, "end",
  case when own then "end" - length(segment) + length(head) else "end" - length(segment) end as mask_start,
  case when own then "end" - 1 else "end" - length(segment) end as mask_end
from ends
"""
