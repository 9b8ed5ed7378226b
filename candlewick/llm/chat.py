"""Dialogues from each participant's point of view."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class ChatSpec:
    """context_roles: speakers who take no part and are nobody's perspective;
    block: turn numbers that are summed together before the running offset."""

    context_roles: tuple[str, ...] = ("system",)
    unknown: str = "unknown"
    block: int = 1024


def _header(role: Column, name: Column) -> Column:
    return F.concat(
        F.lit("<|"),
        role,
        F.when(role == "user", F.concat(F.lit(" name="), name)).otherwise(F.lit("")),
        F.lit("|>\n"),
    )


def rotate_perspectives(turns: DataFrame, spec: ChatSpec = ChatSpec()) -> DataFrame:
    """Row per conversation, perspective and turn: conv_id, perspective, turn,
    speaker, role, segment, start, trained_from, end.

    Every participant of a conversation gets the whole dialogue with its own turns
    as ``assistant``, those of others as ``user`` with their name, and those of
    ``context_roles`` as ``system``.  The segments of a perspective, in the order
    of start, are its rendered text: start and end are character offsets in it,
    and characters from trained_from on are the loss mask's (null: not trained).

    The offset of a turn adds the lengths before it.  They are summed per block of
    turn numbers first, so a conversation of any length is spread over tasks and
    only its block sums are put in one order.

    Turns are ordered by turn (null last), then speaker and text; a row that
    repeats a turn wholly counts once.  Null role: the speaker is ``unknown``; null
    text: empty.  Rows without conv_id are ignored, as are conversations without
    a participant; extra columns are ignored.  An empty table gives an empty one.
    """
    said = (
        turns.where("conv_id is not null")
        .select(
            "conv_id",
            "turn",
            F.coalesce("role", F.lit(spec.unknown)).alias("speaker"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
        .distinct()
    )
    outside = F.col("speaker").isin(*spec.context_roles) if spec.context_roles else F.lit(False)
    people = said.where(~outside).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    role = (
        F.when(outside, "system")
        .when(F.col("speaker") == F.col("perspective"), "assistant")
        .otherwise("user")
    )
    seen = said.join(people, "conv_id").withColumn("role", role)
    header = _header(F.col("role"), F.col("speaker"))
    seen = (
        seen.withColumn("head", F.length(header))
        .withColumn("segment", F.concat(header, "text", F.lit("<|end|>\n")))
        .withColumn("size", F.length("segment").cast("long"))
        .withColumn("block", F.coalesce(F.floor(F.col("turn") / spec.block), F.lit((1 << 62))))
    )
    whole = ["conv_id", "perspective"]
    sums = seen.groupBy(*whole, "block").agg(F.sum("size").alias("block_size"))
    earlier = Window.partitionBy(*whole).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*whole, "block", F.coalesce(F.sum("block_size").over(earlier), F.lit(0)).alias("base"))
    inside = (
        Window.partitionBy(*whole, "block")
        .orderBy(F.col("turn").asc_nulls_last(), "speaker", "text")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = seen.join(sums, [*whole, "block"]).withColumn(
        "start", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    )
    own = F.col("role") == "assistant"
    return placed.select(
        *whole,
        "turn",
        "speaker",
        "role",
        "segment",
        "start",
        F.when(own, F.col("start") + F.col("head")).alias("trained_from"),
        (F.col("start") + F.col("size")).alias("end"),
    )
