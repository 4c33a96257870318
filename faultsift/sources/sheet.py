"""Uploaded test sheets: comma- or tab-separated text with a header line."""

from __future__ import annotations

import csv
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip


def _headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The first line of every file, with the files that start with it: one row per file is gathered."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"))
    first = lines.where(F.col("start") == 0).groupBy("file").agg(F.min_by("value", "line").alias("header"))
    headers: dict[str, list[str]] = {}
    for row in first.orderBy("file").collect():
        headers.setdefault(row["header"].removeprefix("\ufeff"), []).append(unquote(row["file"]))
    return headers


def read_sheet(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All columns as text, trimmed; blank lines are skipped, short rows are padded.

    Every file of a folder is read by its own header, whatever the order of its columns; columns that
    a file lacks are null. Quoted cells and header names may hold the separator. A line is a
    row, so big files are split among tasks; set `multi_line` for cells with line breaks (then a file
    is one task)."""
    headers = {h: files for h, files in _headers(spark, path).items() if h.strip()}
    if not headers:
        return spark.createDataFrame([], "Test STRING").limit(0)
    sheets = [_read(spark, header, files if len(headers) > 1 else [path], multi_line)
              for header, files in headers.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sheets)


def _read(spark: SparkSession, header: str, paths: list[str], multi_line: bool) -> DataFrame:
    """Files of one header. The separator is a tab if the header has one, else a comma."""
    separator = "\t" if "\t" in header else ","
    names = [name.strip() for name in next(csv.reader([header], delimiter=separator, skipinitialspace=True))]
    schema = ", ".join(f"`{name}` STRING" for name in names)
    rows = (
        spark.read.schema(schema).option("sep", separator).option("header", True)
        .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
        .option("enforceSchema", True).option("multiLine", multi_line).option("escape", '"')
        .option("mode", "PERMISSIVE").csv(paths)
    )
    cells = [strip(F.col(f"`{name}`")).alias(name) for name in names]
    filled = F.coalesce(*[F.nullif(strip(F.col(f"`{name}`")), F.lit("")) for name in names])
    return rows.where(filled.isNotNull()).select(*cells)
