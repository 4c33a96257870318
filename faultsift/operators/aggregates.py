"""Counts and summaries. Each groups with map-side partial aggregation, so a hot key
arrives at its final task as one row per map task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def failure_count() -> Column:
    """Sum of the builds over the nested list; missing numbers count 0."""
    return F.aggregate(
        F.coalesce("FailureInfo", F.array()), F.lit(0).cast("bigint"),
        lambda total, info: total + F.coalesce(info["NumFailingBuilds"], F.lit(0)).cast("bigint"),
    )


def percent(part: Column, whole: Column) -> Column:
    """Whole percentage, halves rounded up; 0 of nothing is 0."""
    share = F.floor(part * 100.0 / whole + 0.5).cast("bigint")
    return F.when(whole > 0, share).otherwise(F.lit(0).cast("bigint"))


def percent_half_even(part: Column, whole: Column) -> Column:
    """Whole percentage, halves rounded to even; 0 of nothing is 0."""
    share = F.bround(part * 100.0 / whole, 0).cast("bigint")
    return F.when(whole > 0, share).otherwise(F.lit(0).cast("bigint"))


def count_by(report: DataFrame, column: str) -> DataFrame:
    """Rows and percentage per value, with the position where it was first seen."""
    groups = report.groupBy(column).agg(
        F.count("*").alias("tests"), F.min("ord").alias("first_ord"))
    total = report.agg(F.count("*")).scalar()
    return groups.withColumn("pct", percent(F.col("tests"), total))


def pattern_owner_counts(report: DataFrame) -> DataFrame:
    """Rows and first position per pattern and owner: all a report needs from the texts."""
    return report.groupBy("Pattern", "Owner").agg(
        F.count("*").alias("tests"), F.min("ord").alias("first_ord"))


def roll_up(counts: DataFrame, column: str) -> DataFrame:
    """`count_by` from counts that were already taken."""
    total = counts.agg(F.sum("tests")).scalar()
    groups = counts.groupBy(column).agg(
        F.sum("tests").alias("tests"), F.min("first_ord").alias("first_ord"))
    return groups.withColumn("pct", percent(F.col("tests"), total))


def owner_within_pattern(report: DataFrame) -> DataFrame:
    """Rows per owner inside each pattern, and their share of the pattern."""
    return owner_shares(pattern_owner_counts(report))


def owner_shares(counts: DataFrame) -> DataFrame:
    totals = counts.groupBy("Pattern").agg(F.sum("tests").alias("_total"))
    return (
        counts.join(totals, "Pattern")
        .withColumn("pct", percent(F.col("tests"), F.col("_total")))
        .drop("_total")
    )


def failure_summary(report: DataFrame, failed: Column | None = None) -> DataFrame:
    """Total, failed, failure rate and number of patterns, in one row."""
    failed = F.lit(True) if failed is None else failed
    by_pattern = report.groupBy("Pattern").agg(
        F.count("*").alias("n"), F.count_if(failed).alias("bad"))
    return by_pattern.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_tests"),
        F.coalesce(F.sum("bad"), F.lit(0)).cast("bigint").alias("failed_tests"),
        F.count("*").alias("patterns"),
    ).withColumn(
        "failure_rate", percent_half_even(F.col("failed_tests"), F.col("total_tests")))


def cluster_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("ClusterId").agg(F.count("*").alias("members"))


def cluster_investigations(members: DataFrame) -> DataFrame:
    """Members and investigated members of every cluster."""
    return members.groupBy("ClusterId").agg(
        F.count("*").alias("members"),
        F.count_if(F.col("HasInvestigation")).alias("investigated"),
    ).withColumn("has_investigation", F.col("investigated") > 0)


def investigated_members(members: DataFrame) -> DataFrame:
    """One row per investigated member of a cluster: ClusterId, ord, TestName, report and work item.

    A long list stays rows, so a cluster of any size is spread over tasks. Noise has no rows."""
    return members.where(F.col("HasInvestigation") & (F.col("ClusterId") >= 0)).select(
        "ClusterId", "ord", "TestName", "InvestigationReport", "WorkItemId")


SUMMARY = ["TestName", "Owner", "InvestigationReport", "WorkItemId"]


def unmerged_summary(members: DataFrame) -> DataFrame:
    """One row per message; "None" stands for no investigation."""
    investigated = F.coalesce("HasInvestigation", F.lit(False))
    return members.select(
        "ClusterId", "ord", "TestName", "Owner",
        *[F.when(investigated, F.col(name)).otherwise("None").alias(name)
          for name in ("InvestigationReport", "WorkItemId")],
    )


def merged_summary(members: DataFrame) -> DataFrame:
    """One row per cluster and test: the first message's."""
    first = F.min(F.struct("ord", "Owner", "InvestigationReport", "WorkItemId")).alias("first")
    return (
        unmerged_summary(members).groupBy("ClusterId", "TestName").agg(first)
        .select("ClusterId", "TestName", "first.ord", "first.Owner",
                "first.InvestigationReport", "first.WorkItemId")
    )


def workitems_by_test(predictions: DataFrame) -> DataFrame:
    """First owner and the distinct predicted work items of every test.

    Items are made distinct before they are put into one text, so a busy test sends
    each item once.
    """
    items = (
        predictions
        .withColumn("item", F.explode_outer(F.split("PredictedWorkItemId", ";")))
        .withColumn("item", strip(F.col("item")))
        .withColumn("item", F.when((F.col("PredictedWorkItemId") != "-") & (F.col("item") != ""),
                                   F.col("item")))
        .groupBy("TestName", "item").agg(F.min(F.struct("ord", "Owner")).alias("first"))
    )
    return items.groupBy("TestName").agg(
        F.min("first")["Owner"].alias("Owner"),
        F.array_join(F.array_sort(F.collect_list("item")), ", ").alias("WorkItems"),
    ).withColumn("WorkItems", F.coalesce(F.nullif("WorkItems", F.lit("")), F.lit("-")))


def fetch_counts(grid: DataFrame, errors: DataFrame, kept: Column) -> DataFrame:
    """Failing tests seen and kept for every combination of the grid."""
    scope = ["ProductId", "ReleaseId", "PlatformId"]
    counts = errors.groupBy(*scope).agg(
        F.count("*").alias("seen"), F.count_if(kept).alias("kept"))
    return grid.join(counts, scope, "left").na.fill(0, ["seen", "kept"])


def annotation_audit(examples: DataFrame) -> DataFrame:
    """Annotations, distinct entity types and problems per intent.

    Needs intent and entities (array of entity_text, entity_type)."""
    entity = F.col("entity.entity_text")
    rows = examples.select("intent", F.explode_outer("entities").alias("entity"))
    return rows.groupBy("intent").agg(
        F.count(entity).alias("annotations"),
        F.count_distinct("entity.entity_type").alias("entity_types"),
        F.count_if(entity.rlike(r"[\[\]]")).alias("nested_brackets"),
        F.count_if(entity.rlike(r"[()]")).alias("nested_parentheses"),
    )
