"""Readers of the landed dumps of the reporting service.

The service is asked once per product, release and platform; its answers land as files
partitioned by these ids, so a query for some of them reads only their folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def read_dim(spark: SparkSession, path: str) -> DataFrame:
    """Product, release or platform list."""
    return spark.read.schema(schemas.PRODUCT).json(path).where(F.col("Id").isNotNull())


def read_error_summary(spark: SparkSession, path: str) -> DataFrame:
    """Failing tests, partitioned by ProductId, ReleaseId and PlatformId.

    A `null` answer gives no rows.
    """
    rows = spark.read.schema(schemas.ERROR_SUMMARY).json(path)
    return rows.where(F.col("TestResultId").isNotNull())


def message_text(payload: Column) -> Column:
    """Message of one answer: the `message` of an object ("" when it has none), any other
    JSON value as text. An explicit null message stays null, so the record is dropped."""
    keys = F.json_object_keys(payload)
    of_object = F.when(
        F.array_contains(keys, "message"), F.get_json_object(payload, "$.message")
    ).otherwise("")
    bare = F.get_json_object(payload, "$")
    # How the three JSON words read as text.
    words = F.when(F.trim(payload) == "null", "None").when(F.trim(payload) == "true", "True").when(
        F.trim(payload) == "false", "False")
    return F.when(F.ltrim(payload).startswith("{"), of_object).otherwise(F.coalesce(words, bare))


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """TestResultId and Message of every landed answer."""
    rows = spark.read.schema(schemas.TEST_MESSAGE).json(path)
    return rows.select("TestResultId", message_text(F.col("payload")).alias("Message"))


def flatten_investigations(lists: DataFrame) -> DataFrame:
    """One row per investigation with its position in the list."""
    return lists.select(
        "TestId", "ReleaseId", "PlatformId", F.posexplode("Investigations").alias("ord", "item")
    ).select("TestId", "ReleaseId", "PlatformId", "ord", "item.Name", "item.WorkItemId")


def read_investigations(spark: SparkSession, path: str) -> DataFrame:
    return flatten_investigations(spark.read.schema(schemas.INVESTIGATION_LISTS).json(path))
