"""Numbering rows without passing a whole table or a hot key through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage


def number_rows(df: DataFrame, order: list[str], name: str, split_equal: bool = False) -> DataFrame:
    """Add a number from 0 in the given total order.

    Rows are range-partitioned, sorted and numbered as they are written; each part starts where the
    sum of the parts before it ends. Only one row per part meets in one task, and rows are shuffled once.

    With `split_equal`, rows that are equal in the order may be most of the table: rows are
    written out with a number of their own that splits a range of equal ones, and the ranges are
    sampled without a second run of what led to them.
    """
    order = list(order)
    if split_equal:
        df = cut_lineage(df.withColumn("_tie", F.monotonically_increasing_id()))
        order.append("_tie")
    # The number that Spark gives has the part above the lowest 33 bits, and below them the row.
    at = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie").withColumn("_at", at)
    parted = cut_lineage(placed.select(
        *[c for c in placed.columns if c != "_at"], F.shiftright("_at", 33).cast("int").alias("_part"),
        F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_row")))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parted.groupBy("_part").count().select(
        "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    return (
        parted.join(F.broadcast(starts), "_part")    # one row per partition
        .withColumn(name, F.col("_start") + F.col("_row"))
        .drop("_part", "_start", "_row")
    )


def chunk_of(order: str, width: int) -> Column:
    return F.floor(F.col(order) / width).alias("_chunk")


def position_in_key(df: DataFrame, key: str, order: str, name: str = "position",
                    width: int = 4096) -> DataFrame:
    """Add a number from 0 inside each key, in the order of an integer column.

    A long key is numbered in chunks of the order column, so its rows are spread.
    """
    chunked = df.withColumn("_chunk", chunk_of(order, width))
    before = (Window.partitionBy(key).orderBy("_chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    starts = chunked.groupBy(key, "_chunk").count().select(
        key, "_chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(key, "_chunk").orderBy(order)
    return (
        chunked.withColumn("_row", F.row_number().over(inside) - 1)
        .join(starts, [key, "_chunk"])
        .withColumn(name, F.col("_start") + F.col("_row"))
        .drop("_chunk", "_start", "_row")
    )
