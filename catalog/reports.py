"""Counts, samples and top lists of an uploaded sheet, and of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultsift.operators import aggregates, ranking
from faultsift.operators.tfidf import document_frequency, term_counts
from faultsift.plans.report import classified, report_rows

from . import fixtures as fx
from .registry import query


def _report(spark, folder):
    return classified(fx.sheet(spark, folder))


def count_sql(column: str) -> str:
    return (f"SELECT {column}, count(*) AS tests, min(ord) AS first_ord, "
            "CAST(floor(count(*) * 100.0 / (SELECT count(*) FROM report) + 0.5) AS BIGINT) AS pct "
            f"FROM report GROUP BY {column}")


@query("count_by_pattern", f"WITH {fx.SHEET_SQL} {count_sql('Pattern')}")
def _(spark, folder):
    return aggregates.count_by(_report(spark, folder), "Pattern")


@query("count_by_owner", f"WITH {fx.SHEET_SQL} {count_sql('Owner')}")
def _(spark, folder):
    return aggregates.count_by(_report(spark, folder), "Owner")


@query("owner_within_pattern", f"""WITH {fx.SHEET_SQL}
SELECT Pattern, Owner, count(*) AS tests, min(ord) AS first_ord,
       CAST(floor(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY Pattern) + 0.5) AS BIGINT) AS pct
FROM report GROUP BY Pattern, Owner""")
def _(spark, folder):
    return aggregates.owner_within_pattern(_report(spark, folder))


@query("failure_summary", f"""WITH {fx.SHEET_SQL},
counts AS (SELECT count(*) AS t, count(*) FILTER (WHERE ord % 3 <> 0) AS f,
                  count(DISTINCT Pattern) AS p FROM report)
SELECT t AS total_tests, f AS failed_tests, p AS patterns,
       CAST(round_even(f * 100.0 / t, 0) AS BIGINT) AS failure_rate FROM counts""")
def _(spark, folder):
    return aggregates.failure_summary(_report(spark, folder), F.col("ord") % 3 != 0)


@query("rank_patterns_owners", f"""WITH {fx.SHEET_SQL}
SELECT 'pattern' AS kind, Pattern AS name, count(*) AS tests, min(ord) AS first_ord
FROM report GROUP BY Pattern
UNION ALL SELECT 'owner', Owner, count(*), min(ord) FROM report GROUP BY Owner""")
def _(spark, folder):
    report = _report(spark, folder)
    def part(kind, column):
        return ranking.ranked(aggregates.count_by(report, column)).select(
            F.lit(kind).alias("kind"), F.col(column).alias("name"), "tests", "first_ord")
    return part("pattern", "Pattern").unionByName(part("owner", "Owner")).orderBy(
        F.desc("kind"), F.desc("tests"), "first_ord")


TOP_SQL = "SELECT {0}, tests FROM ({1}) ORDER BY tests DESC, first_ord LIMIT {2}"


@query("top5_patterns_with_other", f"""WITH {fx.SHEET_SQL}, counts AS ({count_sql('Pattern')}),
best AS (SELECT Pattern, tests FROM counts ORDER BY tests DESC, first_ord LIMIT 5)
SELECT Pattern, tests FROM best UNION ALL
SELECT 'Other', CAST(sum(tests) - (SELECT sum(tests) FROM best) AS BIGINT) FROM counts
HAVING count(*) > 5""")
def _(spark, folder):
    counts = aggregates.count_by(_report(spark, folder), "Pattern")
    return ranking.top_with_other(counts, "Pattern").select("Pattern", "tests")


@query("top_owners", f"WITH {fx.SHEET_SQL} {TOP_SQL.format('Owner', count_sql('Owner'), 10)}")
def _(spark, folder):
    return ranking.top(aggregates.count_by(_report(spark, folder), "Owner"), 10).select(
        "Owner", "tests")


@query("top_patterns", f"WITH {fx.SHEET_SQL} {TOP_SQL.format('Pattern', count_sql('Pattern'), 5)}")
def _(spark, folder):
    return ranking.top(aggregates.count_by(_report(spark, folder), "Pattern"), 5).select(
        "Pattern", "tests")


@query("sample_tests_per_pattern", f"""WITH {fx.SHEET_SQL},
numbered AS (SELECT *, row_number() OVER (PARTITION BY Pattern ORDER BY ord) AS sample,
                    count(*) OVER (PARTITION BY Pattern) AS n FROM report)
SELECT Pattern, ord, Test, Owner, CASE WHEN length(Error) > 150 THEN substr(Error, 1, 150) || '...'
       ELSE Error END AS Error, CAST(sample AS INTEGER) AS sample, greatest(n - 3, 0) AS more
FROM numbered WHERE sample <= 3""")
def _(spark, folder):
    return ranking.sample_per_pattern(_report(spark, folder))


@query("failure_report", f"""WITH {fx.SHEET_SQL}, patterns AS ({count_sql('Pattern')}),
owners AS ({count_sql('Owner')}),
best AS (SELECT Pattern, tests FROM patterns ORDER BY tests DESC, first_ord LIMIT 5)
SELECT 'pattern' AS section, Pattern AS name, tests, pct FROM patterns
UNION ALL SELECT 'owner', Owner, tests, pct FROM owners
UNION ALL SELECT 'chart', Pattern, tests, NULL FROM best
UNION ALL SELECT 'chart', 'Other', CAST(sum(tests) - (SELECT sum(tests) FROM best) AS BIGINT), NULL
FROM patterns HAVING count(*) > 5""")
def failure_report_query(spark, folder):
    return report_rows(_report(spark, folder))


def _predictions(spark, folder):
    """Line items as predictions: several items in one cell, some none."""
    item = F.concat(F.lit("WI"), (F.col("l_partkey") % 40).cast("string"))
    two = F.concat(item, F.lit("; "), F.concat(F.lit("WI"), (F.col("l_suppkey") % 7).cast("string")))
    cell = F.when(F.col("l_returnflag") == "N", "-").when(
        F.col("l_returnflag") == "R", two).otherwise(item)
    order = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return fx.table(spark, folder, "lineitem").select(
        F.concat(F.lit("test_"), (F.col("l_orderkey") % 500).cast("string")).alias("TestName"),
        F.concat(F.lit("owner_"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("Owner"),
        cell.alias("PredictedWorkItemId"), F.col("l_suppkey").alias("ord"), order.alias("tie"))


@query("workitems_by_test", """
WITH predictions AS (
  SELECT 'test_' || l_orderkey % 500 AS TestName, 'owner_' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0')
           AS Owner, l_suppkey AS ord,
         CASE l_returnflag WHEN 'N' THEN '-' WHEN 'R'
              THEN 'WI' || l_partkey % 40 || '; WI' || l_suppkey % 7 ELSE 'WI' || l_partkey % 40 END AS cell
  FROM lineitem),
items AS (SELECT TestName, trim(unnest(string_split(cell, ';'))) AS item FROM predictions WHERE cell <> '-'),
texts AS (SELECT TestName, string_agg(DISTINCT item, ', ' ORDER BY item) AS WorkItems FROM items GROUP BY 1)
SELECT p.TestName, arg_min(Owner, ord) AS Owner, coalesce(any_value(WorkItems), '-') AS WorkItems
FROM predictions p LEFT JOIN texts t ON p.TestName = t.TestName GROUP BY p.TestName""")
def _(spark, folder):
    return aggregates.workitems_by_test(_predictions(spark, folder))


@query("distinct_owners", f"WITH {fx.SHEET_SQL} SELECT DISTINCT Owner FROM sheet")
def _(spark, folder):
    return _report(spark, folder).select("Owner").distinct()


@query("document_frequency", f"""WITH {fx.tfidf_sql('documents', 'doc_id', 'text')}
SELECT term, df FROM df""")
def _(spark, folder):
    counts = term_counts(fx.table(spark, folder, "documents"), "doc_id", "text", fx.STOP_WORDS)
    return document_frequency(counts)
