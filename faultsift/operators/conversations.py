"""Slots, context and sessions of conversations.

A conversation or user may be very long, so no window spans a whole key: work is done
in chunks, and only one summary row per chunk is windowed over the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .positions import chunk_of, position_in_key


def carry_slot(turns: DataFrame, key: str, order: str, entity: str, slot: str, default: str,
               width: int = 4096) -> DataFrame:
    """Value of a slot at each turn: this turn's entity, else the last one, else the default."""
    chunked = turns.withColumn("_chunk", chunk_of(order, width))
    before = (Window.partitionBy(key).orderBy("_chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    # max of (order, entity) over rows that set the slot = last set value of the chunk
    latest = F.max(F.when(F.col(entity).isNotNull(), F.struct(order, entity)))
    carried = (
        chunked.groupBy(key, "_chunk").agg(latest.alias("_latest"))
        .select(key, "_chunk", F.last(f"_latest.{entity}", ignorenulls=True).over(before)
                .alias("_carried"))
    )
    inside = (Window.partitionBy(key, "_chunk").orderBy(order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        chunked.withColumn("_here", F.last(entity, ignorenulls=True).over(inside))
        .join(carried, [key, "_chunk"])
        .withColumn(slot, F.coalesce("_here", "_carried", F.lit(default)))
        .drop("_chunk", "_here", "_carried")
    )


def history(turns: DataFrame, key: str, order: str, text: str, length: int = 5,
            width: int = 4096) -> DataFrame:
    """Texts of the last turns up to each turn, oldest first.

    The last `length - 1` rows of a chunk are also given to the next chunk.
    """
    placed = position_in_key(turns, key, order, "_position", width)
    home = F.floor(F.col("_position") / width)
    is_tail = F.col("_position") % width >= width - (length - 1)
    copies = F.when(is_tail, F.array(home, home + 1)).otherwise(F.array(home))
    spread = placed.withColumn("_home", home).withColumn("_chunk", F.explode(copies))
    last = (Window.partitionBy(key, "_chunk").orderBy("_position")
            .rowsBetween(-(length - 1), Window.currentRow))
    return (
        spread.withColumn("history", F.collect_list(text).over(last))
        .where(F.col("_chunk") == F.col("_home"))
        .drop("_position", "_home", "_chunk")
    )


def sessions(events: DataFrame, user: str, ts: str, idle_minutes: int = 60) -> DataFrame:
    """Sessions that end after the idle time: user, start, last event, number of events.

    Events in the same idle-sized slot of time are always in one session, so they are
    first reduced to one row per user and slot; only these rows are windowed.
    """
    gap = idle_minutes * 60
    epoch = F.lit("1970-01-01").cast(events.schema[ts].dataType)

    def seconds(later: Column, earlier: Column) -> Column:
        return (later - earlier).cast("interval second").cast("decimal(18,6)")

    slots = (
        events.where(F.col(ts).isNotNull())
        .groupBy(F.col(user), F.floor(seconds(F.col(ts), epoch) / gap).alias("_slot"))
        .agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.count("*").alias("_n"))
    )
    by_user = Window.partitionBy(user).orderBy("_slot")
    idle = seconds(F.col("_first"), F.lag("_last").over(by_user))
    return (
        slots.withColumn("_new", F.when(idle < gap, 0).otherwise(1))
        .withColumn("_session", F.sum("_new").over(by_user))
        .groupBy(user, "_session")
        .agg(F.min("_first").alias("session_start"), F.max("_last").alias("last_event"),
             F.sum("_n").alias("n_events"))
        .drop("_session")
    )
