"""Readers and writers: the tables are written in the landed formats and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultsift.functions.text import collapse_newlines
from faultsift.plans.records import error_messages
from faultsift.plans.report import classified
from faultsift.session import new_folder
from faultsift.sources import failure_json, landed, sheet, sinks

from . import fixtures as fx
from .joins import failure_records_query
from .registry import SQL, query


@query("scan_dims", f"""WITH {fx.SCOPE_SQL}
SELECT 'product' AS dim, * FROM product UNION ALL SELECT 'release', * FROM release
UNION ALL SELECT 'platform', * FROM platform""")
def _(spark, folder):
    parts = []
    for name, make in (("product", fx.products), ("release", fx.releases),
                       ("platform", fx.platforms)):
        path = new_folder(spark, name)
        make(spark, folder).write.json(path)
        parts.append(landed.read_dim(spark, path).select(F.lit(name).alias("dim"), "Id", "Name"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("scan_error_summary", f"""WITH {fx.SCOPE_SQL}
SELECT ProductId, ReleaseId, PlatformId, TestResultId, TestId, TestName, Result, Owner,
       len(FailureInfo) AS n_builds
FROM error_summary WHERE ProductId = 2 AND ReleaseId = 1997""")
def _(spark, folder):
    path = new_folder(spark, "errors")
    keys = ["ProductId", "ReleaseId", "PlatformId"]
    (fx.error_summary(spark, folder).drop("Priority").repartition(*keys)
     .write.partitionBy(*keys).json(path))
    return landed.read_error_summary(spark, path).where(
        "ProductId = 2 AND ReleaseId = 1997").select(
        *keys, "TestResultId", "TestId", "TestName", "Result", "Owner",
        F.when(F.col("FailureInfo").isNotNull(), F.size("FailureInfo").cast("bigint"))
        .alias("n_builds"))


@query("scan_messages", f"""WITH {fx.SCOPE_SQL}
SELECT o_orderkey AS TestResultId, Message FROM orders LEFT JOIN message
ON o_orderkey = TestResultId""")
def _(spark, folder):
    path = new_folder(spark, "answers")
    fx.answers(spark, folder).write.json(path)
    return landed.read_messages(spark, path)


@query("scan_investigations", f"""WITH {fx.SCOPE_SQL}
SELECT TestId, ReleaseId, PlatformId, ord, Name, WorkItemId FROM investigation""")
def _(spark, folder):
    path = new_folder(spark, "investigations")
    fx.investigation_lists(spark, folder).write.json(path)
    return landed.read_investigations(spark, path)


RECORD = ("doc_id BIGINT, TestName STRING, Result STRING, FailureMessage STRING, Owner STRING, "
          "HasInvestigation BOOLEAN, InvestigationReport STRING, WorkItemId STRING")
PER_FILE = 50


def _write_arrays(spark, folder, broken: bool = False) -> str:
    """Failure records as JSON arrays of a few documents per file, with raw line breaks and
    tabs inside the texts; with `broken`, every seventh file is cut off."""
    path = new_folder(spark, "records")
    records = fx.message_records(spark, folder)
    one = F.regexp_replace(F.to_json(F.struct(*records.columns)), r"\\n", "\n")
    end = F.when(F.lit(broken) & (F.col("file") % 7 == 3), ', {"doc_id":').otherwise("]")
    (records.select(F.floor(F.col("doc_id") / PER_FILE).alias("file"), one.alias("one"))
     .groupBy("file").agg(F.array_join(F.collect_list("one"), ",\n").alias("body"))
     .select("file", F.concat(F.lit("["), "body", end).alias("value"))
     .repartition("file").write.partitionBy("file").text(path))
    return path


RECORD_SQL = f"""WITH {fx.MESSAGE_SQL}
SELECT d.doc_id, d.lang || '_' || CAST(d.doc_id % 50 AS VARCHAR) AS TestName, length(d.text) AS n,
       CASE WHEN d.doc_id % 13 <> 1 THEN d.source END AS Owner,
       coalesce(quality, 0) = 1 AS HasInvestigation,
       CASE WHEN quality = 1 THEN CAST(d.doc_id AS VARCHAR) END AS WorkItemId
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def _seen(records):
    tags = F.regexp_replace("FailureMessage", r'</?MESSAGE( RESULT="ERROR")?>|<LOG>', "")
    n = F.length(tags) - F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)
    return records.select("doc_id", "TestName", n.cast("bigint").alias("n"), "Owner",
                          "HasInvestigation", "WorkItemId")


@query("read_failure_json", RECORD_SQL)
def _(spark, folder):
    return _seen(failure_json.read_failure_json(
        spark, _write_arrays(spark, folder), RECORD, "*.txt"))


@query("read_failure_json_dir", f"""WITH {fx.MESSAGE_SQL}
SELECT ord, TestName, Owner, Message FROM messages""")
def _(spark, folder):
    records = failure_json.read_failure_json(spark, _write_arrays(spark, folder), RECORD, "*.txt")
    return error_messages(records, ["doc_id"]).select("ord", "TestName", "Owner", "Message")


@query("union_files", f"WITH {fx.MESSAGE_SQL} SELECT ord, Message FROM messages")
def _(spark, folder):
    """Several paths in one read; the two folders hold disjoint halves of the records."""
    paths = []
    for half in (0, 1):
        path = new_folder(spark, f"half{half}")
        sinks.write_failure_json(
            fx.message_records(spark, folder).where(F.col("doc_id") % 2 == half), path)
        paths.append(path)
    records = failure_json.read_failure_json(spark, paths, RECORD, "*", lines=True)
    return error_messages(records, ["doc_id"]).select("ord", "Message")


def _write_mistyped(spark, folder) -> str:
    """The record arrays with a first field that no record has, text in a boolean field of every eleventh
    record and a number in a text field of every third."""
    path = new_folder(spark, "mistyped")
    records = fx.message_records(spark, folder)
    number = F.col("doc_id")
    one = F.to_json(F.struct(*[c for c in records.columns if c not in ("HasInvestigation", "Owner")]))
    flag = F.when(number % 11 == 0, '"unknown"').otherwise(F.col("HasInvestigation").cast("string"))
    owner = F.when(number % 3 == 0, number.cast("string")).otherwise(F.to_json(F.struct("Owner")).substr(10, 1 << 20))
    owner = F.when(number % 3 == 0, owner).otherwise(F.regexp_replace(owner, r"\}$", ""))
    owner = F.when(F.col("Owner").isNull() & (number % 3 != 0), "null").otherwise(owner)
    body = F.concat(F.regexp_replace(one, r"\}$", ""), F.lit(', "HasInvestigation": '), flag,
                    F.lit(', "Owner": '), owner, F.lit("}"))
    (records.select(F.floor(number / PER_FILE).alias("file"), body.alias("one"))
     .groupBy("file").agg(F.array_join(F.collect_list("one"), ",\n").alias("body"))
     .select("file", F.concat(F.lit("["), "body", F.lit("]")).alias("value"))
     .repartition("file").write.partitionBy("file").text(path))
    return path


MISTYPED = f"Absent STRING, {RECORD}"


@query("read_mistyped_json", """
SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 THEN CAST(d.doc_id AS VARCHAR)
                      WHEN d.doc_id % 13 <> 1 THEN d.source END AS Owner,
       CASE WHEN d.doc_id % 11 <> 0 THEN coalesce(quality, 0) = 1 END AS HasInvestigation
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def _(spark, folder):
    return failure_json.read_failure_json(spark, _write_mistyped(spark, folder), MISTYPED, "*.txt").select(
        "doc_id", "Owner", "HasInvestigation")


@query("rejected_json_values", """
SELECT 'HasInvestigation' AS field, 'unknown' AS value, count(*) AS n FROM documents WHERE doc_id % 11 = 0
HAVING count(*) > 0""")
def _(spark, folder):
    return failure_json.rejected_values(spark, _write_mistyped(spark, folder), MISTYPED, "*.txt").groupBy(
        "field", "value").agg(F.count(F.lit(1)).alias("n"))


@query("repair_control_chars", """
SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT)
       + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS line_breaks FROM documents""")
def _(spark, folder):
    records = failure_json.read_failure_json(spark, _write_arrays(spark, folder), RECORD, "*.txt")
    breaks = F.length("FailureMessage") - F.length(F.replace("FailureMessage", F.lit("\n"), F.lit("")))
    return records.select("doc_id", breaks.cast("bigint").alias("line_breaks"))


@query("skip_corrupt_files", f"{RECORD_SQL} WHERE (d.doc_id // {PER_FILE}) % 7 <> 3")
def _(spark, folder):
    return _seen(failure_json.read_failure_json(
        spark, _write_arrays(spark, folder, broken=True), RECORD, "*.txt"))


@query("read_lossy_utf8", r"""
SELECT CAST(regexp_extract(line, '^(\d+)', 1) AS BIGINT) AS doc_id, line FROM (
  SELECT doc_id || ' ' || regexp_replace(text, '[\r\n]+', ' ', 'g') AS line FROM documents)""")
def _(spark, folder):
    """Documents as lines with bytes that are not UTF-8 put into them."""
    path = new_folder(spark, "lines")
    bad = F.unhex(F.lit("FF")).cast("string")
    number = F.col("doc_id").cast("string")
    line = F.concat(number, bad, F.lit(" "), F.regexp_replace("text", r"[\r\n]+", " "),
                    F.unhex(F.lit("C3")).cast("string"))
    fx.table(spark, folder, "documents").select(line.alias("value")).write.text(path)
    lines = failure_json.read_lossy_text(spark, path)
    return lines.select(F.regexp_extract("value", r"^(\d+)", 1).cast("bigint").alias("doc_id"),
                        F.col("value").alias("line"))


@query("read_delimited_sheet", rf"""WITH {fx.SHEET_SQL}
SELECT ord, Test, regexp_replace(regexp_replace(Error, '[\r\n]+', ' ', 'g'),
       '^{fx.SQL_SPACE}+|{fx.SQL_SPACE}+$', '', 'g') AS Error, Owner FROM sheet""")
def _(spark, folder):
    """The sheet as tab-separated text, one line per row."""
    path = new_folder(spark, "sheet")
    rows = fx.sheet(spark, folder).withColumn("Details", collapse_newlines(F.col("Details")))
    (rows.write.option("header", True).option("sep", "\t").option("escape", '"')
     .option("emptyValue", "").csv(path))
    return classified(sheet.read_sheet(spark, path)).select(
        F.col("ord").cast("bigint").alias("ord"), "Test", "Error", "Owner")


@query("write_failure_json", SQL["failure_records"])
def _(spark, folder):
    path = new_folder(spark, "out")
    records = failure_records_query(spark, folder)
    sinks.write_failure_json(records, path)
    return spark.read.schema(records.schema).json(path)


@query("write_cluster_csv", f"""WITH {fx.MESSAGE_SQL}
SELECT ord, TestName, Owner, HasInvestigation, InvestigationReport, WorkItemId, Message FROM messages""")
def _(spark, folder):
    path = new_folder(spark, "out")
    messages = error_messages(fx.message_records(spark, folder), ["doc_id"]).select(
        "ord", "TestName", "Owner", "HasInvestigation", "InvestigationReport", "WorkItemId",
        F.col("Message"))
    sinks.write_csv(messages, path)
    return spark.read.schema(messages.schema).option("header", True).option("escape", '"').option(
        "emptyValue", "").csv(path).na.fill({"Message": ""})


@query("write_prediction_csv", rf"""
SELECT CAST(doc_id AS VARCHAR) AS doc_id, regexp_replace(
  '"' || regexp_replace(text, '[\r\n]+', ' ', 'g') || '"', '^{fx.SQL_SPACE}+|{fx.SQL_SPACE}+$', '', 'g')
  AS Message FROM documents""")
def _(spark, folder):
    path = new_folder(spark, "out")
    quoted = F.concat(F.lit('  "'), F.regexp_replace("text", r"[\r\n]+", " "), F.lit('"\t'))
    rows = fx.table(spark, folder, "documents").select("doc_id", quoted.alias("Message"))
    sinks.write_prediction_csv(rows, path)
    return spark.read.schema("doc_id STRING, Message STRING").option("header", True).option(
        "escape", '"').csv(path)
