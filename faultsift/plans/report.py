"""Report over an uploaded sheet: patterns, owners, samples and chart data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import classify_pattern
from ..operators import aggregates, ranking
from ..operators.filters import resolve_columns
from ..session import cut_lineage


def classified(sheet: DataFrame, order: str = "ord") -> DataFrame:
    """ord, Test, Error, Owner, Pattern of every row of a sheet."""
    rows = resolve_columns(sheet, keep=(order,)).withColumnRenamed(order, "ord")
    return rows.withColumn("Pattern", classify_pattern(F.col("Error")))


def failure_report(report: DataFrame) -> dict[str, DataFrame]:
    """All tables of the report by name; each can be read or written on its own.

    The texts are classified once and reduced to counts per pattern and owner, which are
    written out; every count comes from there. Only the samples go back to the texts.
    """
    counts = cut_lineage(aggregates.pattern_owner_counts(report))
    patterns = aggregates.roll_up(counts, "Pattern")
    owners = aggregates.roll_up(counts, "Owner")
    return {
        "summary": patterns.agg(F.coalesce(F.sum("tests"), F.lit(0)).alias("total_tests"),
                                F.count("*").alias("patterns")),
        "patterns": ranking.ranked(patterns),
        "owners": ranking.ranked(owners),
        "owners_of_patterns": aggregates.owner_shares(counts),
        "samples": ranking.sample_per_pattern(report),
        "pattern_chart": ranking.top_with_other(patterns, "Pattern"),
        "owner_chart": ranking.top(owners, 10),
    }


def report_rows(report: DataFrame) -> DataFrame:
    """Patterns, owners and the pattern chart in one table (section, name, tests, pct)."""
    tables = failure_report(report)

    def section(name: str, table: str, column: str, pct: bool = True) -> DataFrame:
        share = F.col("pct") if pct else F.lit(None).cast("bigint")
        return tables[table].select(F.lit(name).alias("section"), F.col(column).alias("name"),
                                    F.col("tests").cast("bigint").alias("tests"),
                                    share.alias("pct"))

    return section("pattern", "patterns", "Pattern").unionByName(
        section("owner", "owners", "Owner")).unionByName(
        section("chart", "pattern_chart", "Pattern", pct=False))
