"""Text, vector and link expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultsift.functions import links, text
from faultsift.functions.vectors import cosine_similarity
from faultsift.plans.predict import threshold_item
from faultsift.plans.records import error_messages

from . import fixtures as fx
from .registry import query


def _docs(spark, folder):
    return fx.table(spark, folder, "documents")


@query("collapse_newlines", rf"""
SELECT doc_id, regexp_replace(regexp_replace(text, '[\r\n]+', ' ', 'g'),
       '^{fx.SQL_SPACE}+|{fx.SQL_SPACE}+$', '', 'g') AS cleaned FROM documents""")
def _(spark, folder):
    return _docs(spark, folder).select(
        "doc_id", text.collapse_newlines(F.col("text")).alias("cleaned"))


@query("digits_only", """
SELECT page_id, regexp_replace(url, '[^0-9]', '', 'g') AS digits FROM pages""")
def _(spark, folder):
    return fx.table(spark, folder, "pages").select(
        "page_id", text.digits_only(F.col("url")).alias("digits"))


@query("normalize_message",
       f"SELECT doc_id, {fx.NORMALIZE_SQL.format('text')} AS normalized FROM documents")
def _(spark, folder):
    return _docs(spark, folder).select(
        "doc_id", text.normalize_message(F.col("text")).alias("normalized"))


@query("extract_error_messages", f"""WITH {fx.MESSAGE_SQL}
SELECT ord, TestName, Owner, Message, HasInvestigation, InvestigationReport, WorkItemId
FROM messages""")
def _(spark, folder):
    return error_messages(fx.message_records(spark, folder), ["doc_id"])


@query("collapse_whitespace", rf"""
SELECT doc_id, trim(regexp_replace(text, '{fx.SQL_SPACE}+', ' ', 'g')) AS cleaned FROM documents""")
def _(spark, folder):
    return _docs(spark, folder).select(
        "doc_id", text.collapse_whitespace(F.col("text")).alias("cleaned"))


@query("classify_pattern", f"WITH {fx.SHEET_SQL} SELECT ord, Pattern FROM report")
def _(spark, folder):
    return fx.sheet(spark, folder).select(
        "ord", text.classify_pattern(F.col("Details")).alias("Pattern"))


@query("truncate_text", """
SELECT doc_id, CASE WHEN length(text) > 150 THEN substr(text, 1, 150) || '...' ELSE text END AS short
FROM documents""")
def _(spark, folder):
    return _docs(spark, folder).select("doc_id", text.truncate(F.col("text")).alias("short"))


@query("cosine_similarity", """
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(spark, folder):
    """Each vector with the next one."""
    vectors = fx.table(spark, folder, "embeddings").select("vec_id", "embedding")
    after = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    cosine = cosine_similarity(F.col("embedding"), F.col("next"))
    return vectors.join(after, "vec_id").select("vec_id", F.round(cosine, 6).alias("cosine"))


@query("threshold_prediction", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount,
       CASE WHEN l_discount * 10 >= 0.7 THEN CAST(l_partkey AS VARCHAR) ELSE '-' END AS item
FROM lineitem""")
def _(spark, folder):
    score = F.col("l_discount") * 10
    item = threshold_item(score, F.col("l_partkey").cast("string"))
    return fx.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", item.alias("item"))


BASE = "https://reports.example.org/tests/"
STATUS = "MatchType%3DAll%26Filter0%3DType%3AInvestigationStatus%2COperator%3AEQUAL%2CValue%3A"


@query("report_link", f"""
SELECT o_orderkey, '{BASE}7?applicationId=-1&platformId='
       || CASE WHEN o_custkey % 3 = 0 THEN 4 ELSE o_custkey % 3 END || '&releaseId='
       || year(o_orderdate) || '&allPackages=True&filterCollection={STATUS}'
       || CASE WHEN o_orderstatus = 'O' THEN 'NO_INVESTIGATION' ELSE 'HAS_INVESTIGATION' END
       || CASE WHEN o_orderstatus = 'P' THEN '' ELSE
          '%26Filter1%3DType%3AOwner%2COperator%3AEQUAL%2CValue%3A' || o_orderpriority END
       || '&highlighterCollection=MatchType%3DAll&noCache=False' AS link
FROM orders""")
def _(spark, folder):
    """Partly filled orders have neither flag nor owner; some have no platform."""
    page = links.ReportPage(f"{BASE}7", tail="&noCache=False", platform="4")
    known = F.col("o_orderstatus") != "P"
    link = links.report_link(
        page, F.when(known, F.col("o_orderstatus") == "F"), F.when(known, F.col("o_orderpriority")),
        F.nullif(F.col("o_custkey") % 3, F.lit(0)), F.year("o_orderdate"))
    return fx.table(spark, folder, "orders").select("o_orderkey", link.alias("link"))


@query("test_link", f"""
SELECT doc_id, '{BASE}5?applicationId=-1&platformId=1&releaseId=' || n_chars
       || '&allPackages=True&filterCollection=MatchType%3DAll%26Filter0%3DType%3ATestName'
       || '%2COperator%3ACONTAINS%2CValue%3A'
       || replace(replace(replace(replace(replace(url_encode(text), '%21', '!'), '%27', ''''),
          '%28', '('), '%29', ')'), '%2A', '*')
       || '&highlighterCollection=MatchType%3DAll%26Filter0%3DType%3ARunAge' AS link
FROM documents""")
def _(spark, folder):
    page = links.ReportPage(BASE, highlighters="MatchType%3DAll%26Filter0%3DType%3ARunAge")
    link = links.test_link(page, F.col("text"), F.lit(5), F.lit(None), F.col("n_chars"))
    return _docs(spark, folder).select("doc_id", link.alias("link"))


@query("workitem_link",
       "SELECT p_partkey, 'https://tickets.example.org/edit/' || p_partkey AS link FROM part")
def _(spark, folder):
    return fx.table(spark, folder, "part").select(
        "p_partkey",
        links.workitem_link("https://tickets.example.org/edit/", F.col("p_partkey")).alias("link"))
