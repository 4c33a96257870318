"""Session settings and the one way this library cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that every operator here is happy with. On a cluster they are usually
# given by spark-submit; `configure` only fills what the caller left unset.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Merge a user's events into partial sessions before they are shuffled, so one
    # busy user does not send all rows to one task.
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply the library's settings to a session builder."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can read: `spark.checkpoint.dir`.

    A temporary folder is used only where the setting is missing and Spark runs on
    one machine (tests).
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="faultsift-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder and go on from there.

    Later steps do not repeat what led here, also when executors are lost, and Spark plans
    them with the true size of the table, so nothing large is broadcast on a wrong guess.
    The folder keeps these tables until it is cleaned, like checkpoints.
    """
    path = new_folder(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def rows_at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """Tasks of actions inside get at most so many rows of a batch, which bounds what long rows take twice, in
    Spark and in Python. A lower setting of the session stays; it is restored afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:                           # 0 and less: no limit
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
