"""Lookups of the failure record as equi joins.

Every dimension or lookup side has one row per key, so a join never multiplies rows.
Which side is broadcast is left to Spark, which looks at the real sizes; a hot test on
the failing side is split by the skew-join rule of adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOPE = ["ProductId", "ReleaseId", "PlatformId"]


def _dim(dim: DataFrame, label: str) -> DataFrame:
    return dim.select(F.col("Id").alias(f"{label}Id"), F.col("Name").alias(label))


def scope_grid(products: DataFrame, releases: DataFrame, platforms: DataFrame,
               wanted_products: list[str], wanted_releases: list[str],
               wanted_platforms: list[str]) -> DataFrame:
    """Every wanted product with every wanted release and platform.

    The combinations come from the caller's name lists; the ids are looked up by name.
    """
    def listed(names: list[str]) -> Column:
        values = [F.lit(name) for name in dict.fromkeys(names)]
        return F.explode(F.array(*values).cast("array<string>"))

    return (
        _dim(products, "Product").where(F.col("Product").isin(list(wanted_products)))
        .withColumn("Release", listed(wanted_releases))
        .withColumn("Platform", listed(wanted_platforms))
        .join(_dim(releases, "Release"), "Release")
        .join(_dim(platforms, "Platform"), "Platform")
        .select(*SCOPE, "Product", "Release", "Platform")
    )


def in_scope(errors: DataFrame, products: DataFrame, releases: DataFrame,
             platforms: DataFrame) -> DataFrame:
    """Failing tests of the given products, releases and platforms, with their names."""
    return (
        errors.join(_dim(products, "Product"), "ProductId")
        .join(_dim(releases, "Release"), "ReleaseId")
        .join(_dim(platforms, "Platform"), "PlatformId")
    )


def with_message(errors: DataFrame, messages: DataFrame) -> DataFrame:
    """Add the message of each test result; without one the record is lost."""
    return errors.join(messages.where(F.col("Message").isNotNull()), "TestResultId")


INVESTIGATION_KEY = ["TestId", "ReleaseId", "PlatformId"]


def first_investigation(investigations: DataFrame) -> DataFrame:
    """The investigation with the lowest position per test, release and platform."""
    first = F.min(F.struct("ord", "Name", "WorkItemId"))
    return (
        investigations.groupBy(*INVESTIGATION_KEY).agg(first.alias("first"))
        .select(*INVESTIGATION_KEY,
                F.coalesce("first.Name", F.lit("")).alias("InvestigationReport"),
                F.col("first.WorkItemId").alias("RawWorkItemId"),
                F.lit(True).alias("Found"))
    )


def with_investigation(errors: DataFrame, investigations: DataFrame) -> DataFrame:
    """Add the first investigation, if any, and whether there is one."""
    return (
        errors.join(first_investigation(investigations), INVESTIGATION_KEY, "left")
        .withColumn("HasInvestigation", F.col("Found").isNotNull())
        .drop("Found")
    )


def investigated(errors: DataFrame, investigations: DataFrame) -> DataFrame:
    """Failing tests that have an investigation."""
    return errors.join(investigations, INVESTIGATION_KEY, "left_semi")


def not_investigated(errors: DataFrame, investigations: DataFrame) -> DataFrame:
    """Failing tests without one."""
    return errors.join(investigations, INVESTIGATION_KEY, "left_anti")


def map_names_to_ids(rows: DataFrame, column: str, mapping: DataFrame, fallback: str | None = None,
                     lower: bool = False) -> DataFrame:
    """Add `<column>Id` from a table (Name, Id); an unknown name gives the fallback,
    or passes through when there is no fallback."""
    name = F.lower(column) if lower else F.col(column)
    table = mapping.select(F.col("Name").alias("_name"), F.col("Id").cast("string").alias("_id"))
    other = F.col(column) if fallback is None else F.lit(fallback)
    return (
        rows.join(table, name == F.col("_name"), "left")
        .withColumn(f"{column}Id", F.coalesce("_id", other))
        .drop("_name", "_id")
    )


def similar_tests(report: DataFrame, test: str, shown: int = 5) -> DataFrame:
    """First other tests that fail like the given one, and how many more there are.

    Needs columns ord, Test, Pattern. Two top-k steps and one count; no group is
    gathered.
    """
    of_test = report.where(F.col("Test") == test).orderBy("ord").limit(1).select("Pattern")
    others = report.join(of_test, "Pattern", "left_semi").where(F.col("Test") != test)
    counted = others.groupBy("Pattern").agg(F.count("*").alias("total"))
    return (
        others.orderBy("ord").limit(shown).join(counted, "Pattern")
        .select("Pattern", "ord", F.col("Test").alias("SimilarTest"),
                F.greatest(F.col("total") - shown, F.lit(0)).alias("Remaining"))
    )


def lookup_action(intents: DataFrame, rules: DataFrame, fallback: str) -> DataFrame:
    """Action of each intent by a rule table (intent, action)."""
    return intents.join(rules, "intent", "left").withColumn(
        "action", F.coalesce("action", F.lit(fallback)))
