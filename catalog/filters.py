"""Row filters and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultsift.functions.text import int_or, split_names
from faultsift.operators import filters as ops
from faultsift.plans.records import error_messages

from . import fixtures as fx
from .registry import query

ID = "SELECT TestResultId, TestName, Owner, Result FROM error_summary"
COLUMNS = ["TestResultId", "TestName", "Owner", "Result"]


@query("filter_dims_by_name", f"WITH {fx.SCOPE_SQL} SELECT Id, Name FROM release "
       "WHERE Name IN ('1996', '1998', '2050')")
def _(spark, folder):
    return ops.by_names(fx.releases(spark, folder), ["1996", "1998", "2050"])


@query("filter_dims_by_substring", f"WITH {fx.SCOPE_SQL} SELECT Id, Name FROM release "
       "WHERE contains('1995,1997 or 19999', Name)")
def _(spark, folder):
    return ops.by_name_in_text(fx.releases(spark, folder), "1995,1997 or 19999")


@query("parse_name_list", r"""
SELECT p_partkey, list_filter(list_transform(string_split(p_brand || ' , ' || p_name || ',,' || p_type, ','),
       lambda n: trim(n)), lambda n: n <> '')::VARCHAR AS names FROM part""")
def _(spark, folder):
    text = F.concat("p_brand", F.lit(" , "), "p_name", F.lit(",,"), "p_type")
    names = F.concat(F.lit("["), F.array_join(split_names(text), ", "), F.lit("]"))
    return fx.table(spark, folder, "part").select("p_partkey", names.alias("names"))


@query("filter_not_pass", f"WITH {fx.SCOPE_SQL} {ID} WHERE Result IS DISTINCT FROM 'PASS'")
def _(spark, folder):
    return fx.error_summary(spark, folder).where(ops.not_passed()).select(*COLUMNS)


@query("filter_owner", f"WITH {fx.SCOPE_SQL} {ID} WHERE Owner = 'BUILDING'")
def _(spark, folder):
    return fx.error_summary(spark, folder).where(ops.owned_by("BUILDING")).select(*COLUMNS)


@query("filter_owner_ci", f"WITH {fx.SCOPE_SQL} {ID} WHERE lower(trim(Owner)) = 'machinery'")
def _(spark, folder):
    return fx.error_summary(spark, folder).where(
        ops.owned_by_any_case("Machinery")).select(*COLUMNS)


@query("filter_min_failing_builds", f"WITH {fx.SCOPE_SQL} {ID} "
       "WHERE len(list_filter(coalesce(FailureInfo, []), lambda n: n >= 45)) > 0")
def _(spark, folder):
    return fx.error_summary(spark, folder).where(ops.min_failing_builds(45)).select(*COLUMNS)


@query("parse_int_default", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 2 WHEN value = floor(value)
       THEN CAST(value AS INTEGER) ELSE 2 END AS least FROM events""")
def _(spark, folder):
    whole = F.col("value") == F.floor("value")
    text = F.when(F.col("event_type") == "error", "many").when(
        whole, F.concat(F.lit(" "), F.col("value").cast("int").cast("string"), F.lit(" "))
    ).otherwise(F.col("value").cast("string"))
    return fx.table(spark, folder, "events").select("event_id", int_or(text, 2).alias("least"))


@query("filter_error_records", f"WITH {fx.MESSAGE_SQL} SELECT doc_id, TestName FROM record")
def _(spark, folder):
    return fx.message_records(spark, folder).where(
        ops.error_with_message()).select("doc_id", "TestName")


@query("exclude_passed_messages", """
SELECT conv_id, turn FROM conversations WHERE NOT contains(upper(text), 'PASSED')
AND NOT (role = 'system')""")
def _(spark, folder):
    message = F.when(F.col("role") == "system", F.concat(F.lit("PASSED "), "text")).otherwise(
        F.upper("text"))
    return fx.table(spark, folder, "conversations").withColumn("Message", message).where(
        ops.not_passed_message()).select("conv_id", "turn")


@query("split_anchor_target", f"""WITH {fx.MESSAGE_SQL}
SELECT ord, CASE WHEN HasInvestigation THEN 'anchor' ELSE 'target' END AS kind FROM messages""")
def _(spark, folder):
    messages = error_messages(fx.message_records(spark, folder), ["doc_id"])
    anchors, targets = ops.split_investigated(messages)
    return anchors.select("ord", F.lit("anchor").alias("kind")).unionByName(
        targets.select("ord", F.lit("target").alias("kind")))


@query("default_unknown", """
SELECT d.doc_id, 'Unknown Test' AS TestName,
       CASE WHEN d.doc_id % 13 <> 1 THEN source ELSE 'Unknown Owner' END AS Owner,
       CASE WHEN quality = 1 THEN 'Report ' || toxic ELSE 'N/A' END AS InvestigationReport,
       CASE WHEN quality = 1 THEN CAST(d.doc_id AS VARCHAR) ELSE 'N/A' END AS WorkItemId
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def _(spark, folder):
    records = fx.message_records(spark, folder).withColumn("TestName", F.lit(None).cast("string"))
    return ops.with_unknowns(records).select(
        "doc_id", "TestName", "Owner", "InvestigationReport", "WorkItemId")


@query("resolve_column_alias", f"WITH {fx.SHEET_SQL} SELECT ord, Test, Error, Owner FROM sheet")
def _(spark, folder):
    return ops.resolve_columns(fx.sheet(spark, folder), keep=("ord",))


@query("report_filter", f"""WITH {fx.SCOPE_SQL}
SELECT e.TestResultId, e.TestName FROM error_summary e
WHERE EXISTS (SELECT 1 FROM investigation i WHERE i.TestId = e.TestId
              AND i.ReleaseId = e.ReleaseId AND i.PlatformId = e.PlatformId)
  AND Owner = 'FURNITURE' AND contains(TestName, '00')""")
def _(spark, folder):
    from faultsift.operators.joins import with_investigation
    from faultsift.sources.landed import flatten_investigations

    errors = with_investigation(fx.error_summary(spark, folder),
                                flatten_investigations(fx.investigation_lists(spark, folder)))
    return errors.where(ops.report_filter(True, "FURNITURE", "00")).select(
        "TestResultId", "TestName")
