"""Sorted and top-k reports. Limits here are the report itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import truncate


def ranked(counts: DataFrame) -> DataFrame:
    """Most frequent first; equal counts in the order first seen."""
    return counts.orderBy(F.desc("tests"), F.asc("first_ord"))


def top(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent values (each task keeps only k rows)."""
    return ranked(counts).limit(k)


def top_with_other(counts: DataFrame, column: str, k: int = 5) -> DataFrame:
    """The top k and one row for everything else, if there is anything else."""
    best = top(counts, k).select(column, "tests", "first_ord")
    best_tests = best.agg(F.sum("tests")).scalar()
    other = (
        counts.agg(F.sum("tests").alias("tests"), F.count("*").alias("groups"))
        .where(F.col("groups") > k)
        .select(F.lit("Other").alias(column), (F.col("tests") - best_tests).alias("tests"),
                F.lit(None).cast("bigint").alias("first_ord"))
    )
    return best.unionByName(other)


def sample_per_pattern(report: DataFrame, k: int = 3) -> DataFrame:
    """First k tests of every pattern and how many more it has.

    The rank filter is pushed below the shuffle, so each task sends at most k rows per
    pattern; the totals come from a separate, partially aggregated count.
    """
    order = Window.partitionBy("Pattern").orderBy("ord")
    first = (
        report.select("Pattern", "ord", "Test", "Owner", truncate(F.col("Error")).alias("Error"))
        .withColumn("sample", F.row_number().over(order)).where(F.col("sample") <= k)
    )
    totals = report.groupBy("Pattern").agg(F.count("*").alias("_n"))
    return first.join(totals, "Pattern").withColumn(
        "more", F.greatest(F.col("_n") - k, F.lit(0))).drop("_n")
