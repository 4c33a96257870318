"""Lookups, and the failure record they make."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultsift.operators import aggregates, filters
from faultsift.operators import joins as ops
from faultsift.plans.records import failure_records
from faultsift.plans.report import classified
from faultsift.sources.landed import flatten_investigations, message_text

from . import fixtures as fx
from .registry import query

PRODUCTS, RELEASES, PLATFORMS = ["ASIA", "EUROPE"], ["1996", "1997", "1998"], [
    "Platform_0", "Platform_2"]
WANTED_SQL = """
wanted AS (SELECT p.Id AS ProductId, r.Id AS ReleaseId, f.Id AS PlatformId, p.Name AS Product,
                  r.Name AS Release, f.Name AS Platform
           FROM product p, release r, platform f
           WHERE p.Name IN ('ASIA', 'EUROPE') AND r.Name IN ('1996', '1997', '1998')
             AND f.Name IN ('Platform_0', 'Platform_2'))
"""


def _messages(spark, folder):
    return fx.answers(spark, folder).select(
        "TestResultId", message_text(F.col("payload")).alias("Message"))


def _investigations(spark, folder):
    return flatten_investigations(fx.investigation_lists(spark, folder))


def _dims(spark, folder):
    return (fx.products(spark, folder), fx.releases(spark, folder), fx.platforms(spark, folder))


def _grid(spark, folder):
    return ops.scope_grid(*_dims(spark, folder), PRODUCTS, RELEASES, PLATFORMS)


@query("cross_dims", f"WITH {fx.SCOPE_SQL}, {WANTED_SQL} SELECT * FROM wanted")
def _(spark, folder):
    return _grid(spark, folder)


@query("join_scope_errors", f"""WITH {fx.SCOPE_SQL}, {WANTED_SQL}
SELECT TestResultId, Product, Release, Platform
FROM error_summary JOIN wanted USING (ProductId, ReleaseId, PlatformId)""")
def _(spark, folder):
    dims = [filters.by_names(dim, names) for dim, names in
            zip(_dims(spark, folder), (PRODUCTS, RELEASES, PLATFORMS))]
    return ops.in_scope(fx.error_summary(spark, folder), *dims).select(
        "TestResultId", "Product", "Release", "Platform")


@query("join_message", f"""WITH {fx.SCOPE_SQL}
SELECT TestResultId, TestName, Message FROM error_summary JOIN message USING (TestResultId)""")
def _(spark, folder):
    return ops.with_message(fx.error_summary(spark, folder), _messages(spark, folder)).select(
        "TestResultId", "TestName", "Message")


@query("left_join_first_investigation", f"""WITH {fx.SCOPE_SQL}
SELECT TestResultId, i.TestId IS NOT NULL AS HasInvestigation, i.Name AS InvestigationReport,
       i.WorkItemId AS RawWorkItemId
FROM error_summary e LEFT JOIN investigation i ON i.TestId = e.TestId
     AND i.ReleaseId = e.ReleaseId AND i.PlatformId = e.PlatformId AND i.ord = 0""")
def _(spark, folder):
    return ops.with_investigation(
        fx.error_summary(spark, folder), _investigations(spark, folder)).select(
        "TestResultId", "HasInvestigation", "InvestigationReport", "RawWorkItemId")


EXISTS_SQL = """(SELECT 1 FROM investigation i WHERE i.TestId = e.TestId
AND i.ReleaseId = e.ReleaseId AND i.PlatformId = e.PlatformId)"""


@query("semi_investigated", f"WITH {fx.SCOPE_SQL} SELECT TestResultId FROM error_summary e "
       f"WHERE EXISTS {EXISTS_SQL}")
def _(spark, folder):
    return ops.investigated(
        fx.error_summary(spark, folder), _investigations(spark, folder)).select("TestResultId")


@query("anti_uninvestigated", f"WITH {fx.SCOPE_SQL} SELECT TestResultId FROM error_summary e "
       f"WHERE NOT EXISTS {EXISTS_SQL}")
def _(spark, folder):
    return ops.not_investigated(
        fx.error_summary(spark, folder), _investigations(spark, folder)).select("TestResultId")


@query("first_investigation", f"""WITH {fx.SCOPE_SQL}
SELECT TestId, ReleaseId, PlatformId, Name AS InvestigationReport, WorkItemId AS RawWorkItemId
FROM investigation WHERE ord = 0""")
def _(spark, folder):
    return ops.first_investigation(_investigations(spark, folder)).drop("Found")


@query("map_names_to_ids", f"""WITH {fx.TURN_SQL},
ids AS (SELECT lower(n_name) AS name, n_nationkey AS id FROM nation)
SELECT conv_id, turn, platform, CASE lower(platform) WHEN 'windows' THEN '0' WHEN 'linux' THEN '1'
       WHEN 'mac' THEN '2' ELSE platform END AS platformId,
       CASE lower(platform) WHEN 'windows' THEN '0' WHEN 'linux' THEN '1'
       WHEN 'mac' THEN '2' ELSE '0' END AS shownId
FROM turns""")
def _(spark, folder):
    names = F.element_at(F.array(F.lit("windows"), F.lit("linux"), F.lit("mac")),
                         (F.col("Id") + 1).cast("int"))
    mapping = fx.platforms(spark, folder).select("Id", names.alias("Name"))
    turns = fx.user_turns(spark, folder).select("conv_id", "turn", "platform")
    passed = ops.map_names_to_ids(turns, "platform", mapping, lower=True)
    shown = passed.withColumn("shown", F.col("platform"))
    return ops.map_names_to_ids(shown, "shown", mapping, fallback="0", lower=True).drop("shown")


@query("similar_tests", f"""WITH {fx.SHEET_SQL},
given AS (SELECT Pattern FROM report WHERE Test = 'en_3' ORDER BY ord LIMIT 1),
others AS (SELECT *, row_number() OVER (ORDER BY ord) AS rn, count(*) OVER () AS n
           FROM report WHERE Test <> 'en_3' AND Pattern IN (SELECT Pattern FROM given))
SELECT Pattern, ord, Test AS SimilarTest, greatest(n - 5, 0) AS Remaining
FROM others WHERE rn <= 5""")
def _(spark, folder):
    return ops.similar_tests(classified(fx.sheet(spark, folder)), "en_3")


@query("fetch_counts", f"""WITH {fx.SCOPE_SQL}, {WANTED_SQL}
SELECT w.*, count(TestResultId) AS seen,
       count(*) FILTER (WHERE TestResultId IS NOT NULL AND Result IS DISTINCT FROM 'PASS'
         AND len(list_filter(coalesce(FailureInfo, []), lambda n: n >= 40)) > 0) AS kept
FROM wanted w LEFT JOIN error_summary e USING (ProductId, ReleaseId, PlatformId)
GROUP BY ALL""")
def _(spark, folder):
    kept = filters.not_passed() & filters.min_failing_builds(40)
    return aggregates.fetch_counts(_grid(spark, folder), fx.error_summary(spark, folder), kept)


@query("failure_count_sum", f"""WITH {fx.SCOPE_SQL}
SELECT TestResultId, CAST(coalesce(list_sum(FailureInfo), 0) AS BIGINT) AS FailureCount
FROM error_summary""")
def _(spark, folder):
    return fx.error_summary(spark, folder).select(
        "TestResultId", aggregates.failure_count().alias("FailureCount"))


@query("failure_records", f"""WITH {fx.SCOPE_SQL}, {WANTED_SQL}
SELECT e.TestResultId, Product, Release, Platform, TestName, Result,
       trim(regexp_replace(Message, '[\\r\\n]+', ' ', 'g'), chr(9) || ' ') AS FailureMessage, Owner,
       i.TestId IS NOT NULL AS HasInvestigation, i.Name AS InvestigationReport,
       regexp_replace(i.WorkItemId, '[^0-9]', '', 'g') AS WorkItemId, e.TestId,
       CAST(list_sum(FailureInfo) AS BIGINT) AS FailureCount
FROM error_summary e JOIN wanted w USING (ProductId, ReleaseId, PlatformId)
     JOIN message m USING (TestResultId)
     LEFT JOIN investigation i ON i.TestId = e.TestId AND i.ReleaseId = e.ReleaseId
          AND i.PlatformId = e.PlatformId AND i.ord = 0
WHERE Result <> 'PASS' AND len(list_filter(FailureInfo, lambda n: n >= 30)) > 0""")
def failure_records_query(spark, folder):
    return failure_records(
        fx.error_summary(spark, folder), _messages(spark, folder),
        _investigations(spark, folder), *_dims(spark, folder), PRODUCTS, RELEASES, PLATFORMS,
        min_failing_builds=30)
