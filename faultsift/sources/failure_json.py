"""Readers of failure-record files: JSON arrays, with the flaws they have in practice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from .. import schemas

CORRUPT = "_unparsed"


def _scan(spark: SparkSession, path: str | list[str], fields: StructType, glob: str,
          subfolders: bool, lines: bool) -> DataFrame:
    """Every field as text, which any JSON value is, so that no value spoils its record."""
    texts = StructType([StructField(f.name, StringType()) for f in fields] + [StructField(CORRUPT, StringType())])
    return (
        spark.read.schema(texts)
        .option("multiLine", not lines)
        .option("allowUnquotedControlChars", True)     # raw line breaks inside texts
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("recursiveFileLookup", subfolders)
        .option("pathGlobFilter", glob)
        .json(path)
    )


def _typed(field: StructField) -> Column:
    """The field's text in its type; null where the text does not fit."""
    text = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (ArrayType, MapType, StructType)):
        return F.from_json(text, field.dataType)
    return text.try_cast(field.dataType)


def _unparsed(rows: DataFrame) -> Column:
    # Spark wants a data column beside the corrupt one, so counting rows works as well; all
    # fields of an unparsed record are null, and a parsed one has no corrupt text.
    return F.col(CORRUPT).isNotNull() & F.col(rows.columns[0]).isNull()


def read_failure_json(spark: SparkSession, path: str | list[str],
                      schema: str = schemas.FAILURE_RECORD, glob: str = "*.json",
                      subfolders: bool = False, lines: bool = False) -> DataFrame:
    """Failure records of one file, several files or a folder, its sub-folders on request.

    Files are JSON arrays or, with `lines`, one object a line. A file (or line) that is not JSON contributes
    nothing; see `unparsed_files`. A value that does not fit its field's type is null and
    costs nothing else; see `rejected_values`. Absent fields are null, unknown ones are not read.
    """
    fields = StructType.fromDDL(schema)
    rows = _scan(spark, path, fields, glob, subfolders, lines)
    return rows.where(~_unparsed(rows)).select(*[_typed(f).alias(f.name) for f in fields])


def unparsed_files(spark: SparkSession, path: str | list[str],
                   schema: str = schemas.FAILURE_RECORD, glob: str = "*.json",
                   subfolders: bool = False, lines: bool = False) -> DataFrame:
    """Names of the files `read_failure_json` skips, wholly or some lines of."""
    rows = _scan(spark, path, StructType.fromDDL(schema), glob, subfolders, lines)
    return rows.where(_unparsed(rows)).select(F.input_file_name().alias("file")).distinct()


def rejected_values(spark: SparkSession, path: str | list[str],
                    schema: str = schemas.FAILURE_RECORD, glob: str = "*.json",
                    subfolders: bool = False, lines: bool = False) -> DataFrame:
    """(file, field, value): the values of parsed records that do not fit their field's type."""
    fields = StructType.fromDDL(schema)
    rows = _scan(spark, path, fields, glob, subfolders, lines)
    bad = F.array(*[
        F.when(F.col(f"`{f.name}`").isNotNull() & _typed(f).isNull(),
               F.struct(F.lit(f.name).alias("field"), F.col(f"`{f.name}`").alias("value"))) for f in fields])
    return rows.where(~_unparsed(rows)).select(
        F.input_file_name().alias("file"), F.explode(F.filter(bad, lambda x: x.isNotNull())).alias("_bad")).select(
        "file", "_bad.field", "_bad.value")


def drop_bad_bytes(text: Column) -> Column:
    """Text without the bytes that are not UTF-8."""
    return F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit(""))


def read_lossy_text(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Lines of text files, ignoring bytes that are not UTF-8."""
    lines = spark.read.option("pathGlobFilter", glob).text(path)
    return lines.select(drop_bad_bytes(F.col("value")).alias("value"))
