"""The driver's tables in the shape of failure data, in Spark and as SQL common tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Common English words left out of term vectors in the queries and in their SQL.
STOP_WORDS = ["the", "of", "and", "to", "in", "is", "it", "that", "was", "for", "on", "are",
              "with", "as", "his", "they", "be", "at", "this", "from", "have", "or", "by"]
STOP_SQL = "(" + ", ".join(f"'{word}'" for word in STOP_WORDS) + ")"

# White space as Python and (?U)\s understand it, in the regular expressions of DuckDB.
SQL_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- products, releases, platforms, failing tests --------------------------------------

def products(spark, folder) -> DataFrame:
    return table(spark, folder, "region").select(
        F.col("r_regionkey").alias("Id"), F.col("r_name").alias("Name"))


def releases(spark, folder) -> DataFrame:
    year = F.year("o_orderdate")
    return table(spark, folder, "orders").select(
        year.alias("Id"), year.cast("string").alias("Name")).distinct()


def platforms(spark, folder) -> DataFrame:
    number = F.col("n_nationkey") % 3
    return table(spark, folder, "nation").select(
        number.alias("Id"), F.concat(F.lit("Platform_"), number.cast("string")).alias("Name")
    ).distinct()


def error_summary(spark, folder) -> DataFrame:
    """Orders as failing tests; quantities of their lines as failing builds."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(F.struct(F.col("l_quantity").cast("int").alias("NumFailingBuilds")))
        .alias("FailureInfo"))
    customers = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    result = F.when(F.col("o_orderstatus") == "F", "ERROR").when(
        F.col("o_orderstatus") == "O", "PASS").otherwise("FAIL")
    return (
        table(spark, folder, "orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(F.col("n_regionkey").alias("ProductId"), F.year("o_orderdate").alias("ReleaseId"),
                (F.col("n_nationkey") % 3).alias("PlatformId"),
                F.col("o_orderkey").alias("TestResultId"), F.col("o_custkey").alias("TestId"),
                F.col("c_name").alias("TestName"), result.alias("Result"),
                F.col("c_mktsegment").alias("Owner"), "FailureInfo",
                F.col("o_orderpriority").alias("Priority"))
    )


def answers(spark, folder) -> DataFrame:
    """One answer per test result, in each of the forms the service may give."""
    text = F.concat(F.lit("  Build\r\n\n of test "), F.col("o_orderkey").cast("string"),
                    F.lit("\nfailed \t"))
    payload = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit('"urgent '),
               F.col("o_orderkey").cast("string"), F.lit('"')))
        .when(F.col("o_orderpriority") == "5-LOW", F.lit('{"code": 7}'))
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit('{"message": null}'))
        .otherwise(F.to_json(F.struct(text.alias("message"))))
    )
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("TestResultId"), payload.alias("payload"))


def investigation_lists(spark, folder) -> DataFrame:
    """Returned lines as investigations of a customer's orders, in a fixed order."""
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    item = F.struct(
        F.concat(F.lit("Report "), F.col("l_suppkey").cast("string")).alias("Name"),
        F.concat(F.lit("WI-"), F.col("l_partkey").cast("string")).alias("WorkItemId"))
    customers = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return (
        table(spark, folder, "lineitem").where(F.col("l_returnflag") == "R")
        .join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("o_custkey").alias("TestId"), F.year("o_orderdate").alias("ReleaseId"),
                 (F.col("n_nationkey") % 3).alias("PlatformId"))
        .agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), item.alias("i")))).alias("l"))
        .select("TestId", "ReleaseId", "PlatformId",
                F.transform("l", lambda pair: pair["i"]).alias("Investigations"))
    )


SCOPE_SQL = r"""
product AS (SELECT r_regionkey AS Id, r_name AS Name FROM region),
release AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS Id,
                   CAST(year(o_orderdate) AS VARCHAR) AS Name FROM orders),
platform AS (SELECT DISTINCT n_nationkey % 3 AS Id,
                    'Platform_' || CAST(n_nationkey % 3 AS VARCHAR) AS Name FROM nation),
builds AS (SELECT l_orderkey, list(CAST(floor(l_quantity) AS INTEGER)) AS FailureInfo
           FROM lineitem GROUP BY l_orderkey),
error_summary AS (
  SELECT n_regionkey AS ProductId, CAST(year(o_orderdate) AS INTEGER) AS ReleaseId,
         n_nationkey % 3 AS PlatformId, o_orderkey AS TestResultId, o_custkey AS TestId,
         c_name AS TestName,
         CASE o_orderstatus WHEN 'F' THEN 'ERROR' WHEN 'O' THEN 'PASS' ELSE 'FAIL' END AS Result,
         c_mktsegment AS Owner, FailureInfo, o_orderpriority AS Priority
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       LEFT JOIN builds ON o_orderkey = l_orderkey),
message AS (
  SELECT o_orderkey AS TestResultId,
         CASE o_orderpriority
           WHEN '1-URGENT' THEN 'urgent ' || o_orderkey
           WHEN '5-LOW' THEN ''
           ELSE '  Build' || chr(13) || chr(10) || chr(10) || ' of test ' || o_orderkey
                || chr(10) || 'failed ' || chr(9) END AS Message
  FROM orders WHERE o_orderpriority <> '2-HIGH'),
investigation AS (
  SELECT o_custkey AS TestId, CAST(year(o_orderdate) AS INTEGER) AS ReleaseId,
         n_nationkey % 3 AS PlatformId,
         CAST(row_number() OVER (PARTITION BY o_custkey, year(o_orderdate)
              ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS INTEGER)
           AS ord,
         'Report ' || l_suppkey AS Name, 'WI-' || l_partkey AS WorkItemId
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey
  WHERE l_returnflag = 'R')
"""


# --- messages ----------------------------------------------------------------------------

def message_records(spark, folder) -> DataFrame:
    """Documents as failure records: investigated ones are those of good quality, and the
    documents without a label have none. The text is split over one or two error tags."""
    text = F.col("text")
    half = F.floor(F.length(text) / 2).cast("int")
    tag = lambda body: F.concat(F.lit('<MESSAGE RESULT="ERROR">'), body, F.lit("</MESSAGE>"))
    two = F.concat(F.lit("<LOG>"), tag(F.substring(text, F.lit(1), half)), F.lit("\n"),
                   tag(F.substring(text, half + 1, F.length(text))))
    docs = table(spark, folder, "documents").join(
        table(spark, folder, "labels"), "doc_id", "left")
    return docs.select(
        "doc_id", F.concat_ws("_", "lang", (F.col("doc_id") % 50).cast("string")).alias("TestName"),
        F.when(F.col("doc_id") % 11 != 3, F.lit("ERROR")).otherwise("FAIL").alias("Result"),
        F.when(F.col("doc_id") % 5 == 0, two).otherwise(tag(text)).alias("FailureMessage"),
        F.when(F.col("doc_id") % 13 != 1, F.col("source")).alias("Owner"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("HasInvestigation"),
        F.when(F.col("quality") == 1, F.concat(F.lit("Report "), F.col("toxic").cast("string")))
        .alias("InvestigationReport"),
        F.when(F.col("quality") == 1, F.col("doc_id").cast("string")).alias("WorkItemId"),
    )


MESSAGE_SQL = rf"""
record AS (
  SELECT d.doc_id, d.text, d.lang || '_' || CAST(d.doc_id % 50 AS VARCHAR) AS TestName,
         CASE WHEN d.doc_id % 13 <> 1 THEN d.source END AS Owner,
         coalesce(quality, 0) = 1 AS HasInvestigation,
         CASE WHEN quality = 1 THEN 'Report ' || toxic END AS InvestigationReport,
         CASE WHEN quality = 1 THEN CAST(d.doc_id AS VARCHAR) END AS WorkItemId
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
  WHERE d.doc_id % 11 <> 3),
body AS (
  SELECT *, 0 AS pos, CASE WHEN doc_id % 5 = 0 THEN substr(text, 1, length(text) // 2)
                           ELSE text END AS Body FROM record
  UNION ALL
  SELECT *, 1 AS pos, substr(text, length(text) // 2 + 1) AS Body FROM record
  WHERE doc_id % 5 = 0),
messages AS (
  SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS ord, TestName,
         coalesce(Owner, 'Unknown Owner') AS Owner,
         trim(regexp_replace(Body, '{SQL_SPACE}+', ' ', 'g')) AS Message, HasInvestigation,
         coalesce(InvestigationReport, 'N/A') AS InvestigationReport,
         coalesce(WorkItemId, 'N/A') AS WorkItemId
  FROM body)
"""

NORMALIZE_SQL = (r"trim(regexp_replace(regexp_replace(lower({0}), '\p{{Nd}}+', '', 'g'), "
                 r"'[^\p{{L}}\p{{N}}_]+', ' ', 'g'))")


def tfidf_sql(source: str, key: str, text: str) -> str:
    """Common tables normal, term, vec (key, term, weight) of a table with a key and a text."""
    return f"""
normal AS (SELECT {key} AS id, {NORMALIZE_SQL.format(text)} AS Normalized FROM {source}),
words AS (SELECT id, unnest(string_split(Normalized, ' ')) AS term FROM normal),
tf AS (SELECT id, term, count(*) AS tf FROM words
       WHERE length(term) >= 2 AND term NOT IN {STOP_SQL} GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT id, tf.term, df, tf * (ln((1.0 + (SELECT count(*) FROM normal)) / (1.0 + df)) + 1.0)
          AS raw FROM tf JOIN df ON tf.term = df.term),
vec AS (SELECT id, term, df, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight FROM raw)
"""


# Messages without an investigation, and the best of the anchors by the anchors' own idf.
FIXED_ANCHOR_SQL = f"""{MESSAGE_SQL},
anchors AS (SELECT * FROM messages WHERE HasInvestigation),
{tfidf_sql('anchors', 'ord', 'Message')},
idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM anchors)) / (1.0 + df)) + 1.0 AS idf FROM df),
open_words AS (SELECT ord AS id, unnest(string_split({NORMALIZE_SQL.format('Message')}, ' ')) AS term
               FROM messages WHERE NOT HasInvestigation),
open_raw AS (SELECT id, w.term, count(*) * any_value(idf) AS raw
             FROM open_words w JOIN idf ON w.term = idf.term GROUP BY id, w.term),
open_vec AS (SELECT id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight FROM open_raw),
best AS (
  SELECT x.id AS ord, a.WorkItemId, row_number() OVER (PARTITION BY x.id
           ORDER BY round(sum(x.weight * y.weight), 12) DESC, a.ord) AS rn
  FROM open_vec x JOIN vec y ON y.term = x.term JOIN anchors a ON a.ord = y.id
  GROUP BY x.id, a.ord, a.WorkItemId HAVING round(sum(x.weight * y.weight), 12) >= 0.7),
predicted AS (
  SELECT m.ord, TestName, Owner, coalesce(best.WorkItemId, '-') AS PredictedWorkItemId
  FROM messages m LEFT JOIN best ON best.ord = m.ord AND rn = 1 WHERE NOT HasInvestigation)
"""


# --- sheets -------------------------------------------------------------------------------

# Texts that make a document fall under each pattern; document i gets text i % 23.
TRIGGERS = ["Non-Slip Wall (default) is not Stationary Wall (default)",
            "Condition label is invalid", "ValidationError of NumNodes",
            "Validation error in step#4", "Image files differ", "Count validation error",
            "A tree node label", "The ParameterValue", "The ResultsValue",
            "Expected 4, Actual 5", "Validation error", "Expected nothing"]


def sheet(spark, folder) -> DataFrame:
    """Documents as rows of an uploaded sheet."""
    trigger = F.coalesce(
        F.try_element_at(F.array(*[F.lit(t) for t in TRIGGERS]),
                         (F.col("doc_id") % 23 + 1).cast("int")), F.lit(""))
    text = F.when(F.col("doc_id") % 29 == 7, "").otherwise(
        F.concat_ws(" ", F.nullif(trigger, F.lit("")), "text"))
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("ord"),
        F.concat_ws("_", "lang", (F.col("doc_id") % 50).cast("string")).alias("TestCase"),
        text.alias("Details"),
        F.when(F.col("doc_id") % 17 == 2, "").otherwise(F.col("source")).alias("Assignee"),
        F.lit("FAIL").alias("Result"))


_TRIGGER_SQL = "[" + ", ".join("'" + t + "'" for t in TRIGGERS) + "]"
SHEET_SQL = f"""
sheet AS (
  SELECT doc_id AS ord, lang || '_' || CAST(doc_id % 50 AS VARCHAR) AS Test,
         CASE WHEN doc_id % 29 = 7 THEN ''
              WHEN doc_id % 23 < {len(TRIGGERS)}
              THEN {_TRIGGER_SQL}[CAST(doc_id % 23 + 1 AS INTEGER)] || ' ' || text
              ELSE text END AS Error,
         CASE WHEN doc_id % 17 = 2 THEN 'Unknown' ELSE source END AS Owner
  FROM documents),
report AS (
  SELECT *, CASE
    WHEN Error = '' THEN 'Unknown error'
    WHEN contains(Error, 'Non-Slip Wall (default)') AND contains(Error, 'Stationary Wall (default)')
      THEN 'Wall label mismatch: Stationary vs Non-Slip'
    WHEN contains(Error, 'Condition label is invalid') THEN 'Condition label is invalid'
    WHEN contains(Error, 'ValidationError') AND contains(Error, 'NumNodes')
      THEN 'Node count validation error'
    WHEN contains(Error, 'Validation error') AND contains(Error, 'step#')
      THEN 'Step validation error'
    WHEN contains(Error, 'Image') AND contains(Error, 'differ') THEN 'Image validation error'
    WHEN contains(Error, 'Count validation error') THEN 'Count validation error'
    WHEN contains(Error, 'tree node label') THEN 'Tree node label mismatch'
    WHEN contains(Error, 'ParameterValue') OR contains(Error, 'ResultsValue')
      THEN 'Parameter value mismatch'
    WHEN contains(Error, 'Expected') AND contains(Error, 'Actual') THEN 'Expected vs Actual mismatch'
    WHEN length(string_split(Error, '.')[1]) > 50
      THEN substr(string_split(Error, '.')[1], 1, 50) || '...'
    ELSE string_split(Error, '.')[1] END AS Pattern
  FROM sheet)
"""


def user_turns(spark, folder) -> DataFrame:
    """Utterances with an entity on some turns."""
    platform = F.when(F.col("turn") % 3 == 0, F.element_at(
        F.array(F.lit("Windows"), F.lit("Linux"), F.lit("Solaris"), F.lit("mac")),
        (F.length("text") % 4 + 1).cast("int")))
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", "role", "text", platform.alias("platform"))


TURN_SQL = """
turns AS (SELECT conv_id, turn, role, text,
                 CASE WHEN turn % 3 = 0
                      THEN ['Windows', 'Linux', 'Solaris', 'mac'][length(text) % 4 + 1] END AS platform
          FROM conversations)
"""
