"""Vectors, nearest neighbours, clusters and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultsift.operators import aggregates, clusters, similarity
from faultsift.operators.tfidf import count_vectors, distinct_messages, tfidf
from faultsift.plans.anchor_index import fit_anchors, predict_from_index
from faultsift.plans.predict import predict_messages, threshold_item, union_predictions
from faultsift.plans.records import error_messages
from faultsift.session import cut_lineage, new_folder

from . import fixtures as fx
from .registry import query


@query("tfidf", f"""WITH {fx.tfidf_sql('documents', 'doc_id', 'text')}
SELECT id AS doc_id, term, round(weight, 6) AS weight FROM vec""")
def tfidf_query(spark, folder):
    return tfidf(fx.table(spark, folder, "documents"), "doc_id", "text", fx.STOP_WORDS).select(
        "doc_id", "term", F.round("weight", 6).alias("weight"))


# --- dense vectors: embeddings with label >= 5 are investigated ---------------------------

ANCHOR_SQL = """
pairs AS (SELECT t.vec_id, a.vec_id AS anchor, a.label,
                 list_cosine_similarity(t.embedding::DOUBLE[], a.embedding::DOUBLE[]) AS score
          FROM embeddings t JOIN embeddings a ON t.label < 5 AND a.label >= 5),
best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 12) DESC, anchor) AS rn
         FROM pairs)
"""


def _nearest(spark, folder, **options):
    vectors = fx.table(spark, folder, "embeddings")
    targets, anchors = vectors.where("label < 5"), vectors.where("label >= 5")
    return similarity.nearest_anchor(targets, anchors, "vec_id", "embedding", "vec_id", **options)


@query("nearest_anchor", f"""WITH {ANCHOR_SQL}
SELECT vec_id, anchor, round(score, 6) AS score FROM best WHERE rn = 1""")
def nearest_anchor_query(spark, folder):
    return _nearest(spark, folder).select("vec_id", "anchor", F.round("score", 6).alias("score"))


@query("best_anchor_rank", f"""WITH {ANCHOR_SQL}
SELECT vec_id, anchor, round(score, 6) AS score FROM best WHERE rn = 1""")
def _(spark, folder):
    """The same search when the anchors are too many to be sent to every task."""
    blocked = _nearest(spark, folder, broadcast_values=0, block_rows=256)
    return blocked.select("vec_id", "anchor", F.round("score", 6).alias("score"))


@query("union_predictions_anchors", f"""WITH {ANCHOR_SQL}
SELECT vec_id AS ord, 'test_' || vec_id % 7 AS TestName, 'owner_' || vec_id % 3 AS Owner,
       CASE WHEN score >= 1 - 0.6 THEN CAST(label AS VARCHAR) ELSE '-' END AS PredictedWorkItemId,
       FALSE AS Investigated FROM best WHERE rn = 1
UNION ALL SELECT vec_id, 'test_' || vec_id % 7, 'owner_' || vec_id % 3, CAST(label AS VARCHAR), TRUE
FROM embeddings WHERE label >= 5""")
def _(spark, folder):
    def named(column, rows):
        return rows.withColumn("ord", F.col(column)).withColumn(
            "TestName", F.concat(F.lit("test_"), (F.col(column) % 7).cast("string"))).withColumn(
            "Owner", F.concat(F.lit("owner_"), (F.col(column) % 3).cast("string")))

    anchors = named("vec_id", fx.table(spark, folder, "embeddings").where("label >= 5")).withColumn(
        "WorkItemId", F.col("label").cast("string"))
    items = anchors.select(F.col("vec_id").alias("anchor"), "WorkItemId")
    targets = named("vec_id", _nearest(spark, folder).join(items, "anchor")).withColumn(
        "PredictedWorkItemId", threshold_item(F.col("score"), F.col("WorkItemId"), 0.6))
    return union_predictions(targets, anchors)


@query("eps_neighbors", """
WITH pairs AS (
  SELECT a.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT vec_id, count(*) FILTER (WHERE score >= 1 - 0.6) AS n_neighbors FROM pairs GROUP BY vec_id""")
def eps_neighbors_query(spark, folder):
    return similarity.neighbour_counts(
        fx.table(spark, folder, "embeddings"), "vec_id", "embedding", 0.6)


@query("dbscan_vectors", """
WITH RECURSIVE edges AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 1 - 0.6),
reach AS (SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
component AS (SELECT a AS vec_id, min(b) AS root FROM reach GROUP BY a),
numbered AS (SELECT vec_id, dense_rank() OVER (ORDER BY root) - 1 AS ClusterId FROM component)
SELECT e.vec_id, CAST(coalesce(n.ClusterId, -1) AS INTEGER) AS ClusterId
FROM embeddings e LEFT JOIN numbered n ON e.vec_id = n.vec_id""")
def dbscan_vectors_query(spark, folder):
    return clusters.dbscan_vectors(
        fx.table(spark, folder, "embeddings"), "vec_id", "embedding", 0.6)


@query("dbscan_vectors_core", """
WITH RECURSIVE near AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id
  OR list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 1 - 0.6),
core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 4),
edges AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach AS (SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
root AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a),
member AS (SELECT n.a AS id, min(r.root) AS root FROM near n JOIN root r ON n.b = r.id
           WHERE n.a NOT IN (SELECT id FROM core) GROUP BY n.a UNION ALL SELECT id, root FROM root),
numbered AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS ClusterId FROM (SELECT DISTINCT root FROM root))
SELECT e.vec_id, CAST(coalesce(n.ClusterId, -1) AS INTEGER) AS ClusterId
FROM embeddings e LEFT JOIN member m ON e.vec_id = m.id LEFT JOIN numbered n ON n.root = m.root""")
def dbscan_vectors_core_query(spark, folder):
    return clusters.dbscan_vectors(
        fx.table(spark, folder, "embeddings"), "vec_id", "embedding", 0.6, min_samples=4)


# --- messages -----------------------------------------------------------------------------

# Pairs of messages by TF-IDF cosine; distinct texts are compared once.
DISTINCT_SQL = f"""
docs AS (SELECT doc_id, {fx.NORMALIZE_SQL.format('text')} AS n FROM documents),
names AS (SELECT n, min(doc_id) AS id, count(*) AS copies FROM docs GROUP BY n),
{fx.tfidf_sql('documents', 'doc_id', 'text')},
pairs AS (SELECT a.id AS a, b.id AS b, sum(a.weight * b.weight) AS score
          FROM vec a JOIN vec b ON a.term = b.term AND a.id <> b.id
          WHERE a.id IN (SELECT id FROM names) AND b.id IN (SELECT id FROM names)
          GROUP BY a.id, b.id HAVING round(sum(a.weight * b.weight), 12) >= 0.7)
"""


@query("tfidf_neighbors", f"""WITH {DISTINCT_SQL},
best AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(score, 12) DESC, b) AS rn FROM pairs)
SELECT a AS id, b AS neighbor, round(score, 6) AS score FROM best WHERE rn = 1""")
def tfidf_neighbors_query(spark, folder):
    distinct = cut_lineage(
        distinct_messages(fx.table(spark, folder, "documents"), "doc_id", "text"))
    counted, idf = count_vectors(distinct, "id", "Normalized", fx.STOP_WORDS)
    return similarity.nearest_vectors(counted, 0.7, idf).select(
        "id", "neighbor", F.round("score", 6).alias("score"))


MEMBER_SQL = f"""{DISTINCT_SQL},
reach AS (SELECT a, b FROM pairs UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
component AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a
              UNION SELECT id, id FROM names WHERE copies > 1 AND id IN (SELECT id FROM vec)
              AND id NOT IN (SELECT a FROM pairs)),
numbered AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS ClusterId FROM component),
members AS (
  SELECT d.doc_id AS ord, CAST(coalesce(ClusterId, -1) AS INTEGER) AS ClusterId,
         x.lang || '_' || CAST(d.doc_id % 50 AS VARCHAR) AS TestName,
         CASE WHEN d.doc_id % 13 <> 1 THEN x.source END AS Owner,
         coalesce(quality, 0) = 1 AS HasInvestigation,
         CASE WHEN quality = 1 THEN 'Report ' || toxic ELSE 'None' END AS InvestigationReport,
         CASE WHEN quality = 1 THEN CAST(d.doc_id AS VARCHAR) ELSE 'None' END AS WorkItemId
  FROM docs d JOIN names m ON d.n = m.n LEFT JOIN numbered c ON c.id = m.id
       JOIN documents x ON x.doc_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id)
"""


def _members(spark, folder):
    records = fx.message_records(spark, folder).join(
        fx.table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    return clusters.dbscan_messages(
        records, "doc_id", "text", 0.3, fx.STOP_WORDS).withColumnRenamed("doc_id", "ord")


@query("dbscan_clusters", f"WITH RECURSIVE {MEMBER_SQL} SELECT ord, ClusterId FROM members")
def dbscan_query(spark, folder):
    return _members(spark, folder).select("ord", "ClusterId")


@query("number_clusters", f"""WITH RECURSIVE {MEMBER_SQL}
SELECT ClusterId, min(ord) AS first_ord FROM members GROUP BY ClusterId""")
def _(spark, folder):
    return _members(spark, folder).groupBy("ClusterId").agg(F.min("ord").alias("first_ord"))


@query("cluster_sizes", f"""WITH RECURSIVE {MEMBER_SQL}
SELECT ClusterId, count(*) AS members FROM members GROUP BY ClusterId""")
def _(spark, folder):
    return aggregates.cluster_sizes(_members(spark, folder))


@query("cluster_investigations", f"""WITH RECURSIVE {MEMBER_SQL}
SELECT ClusterId, count(*) AS members, count(*) FILTER (WHERE HasInvestigation) AS investigated,
       bool_or(HasInvestigation) AS has_investigation FROM members GROUP BY ClusterId""")
def _(spark, folder):
    return aggregates.cluster_investigations(_members(spark, folder))


@query("investigated_members", f"""WITH RECURSIVE {MEMBER_SQL}
SELECT ClusterId, ord, TestName, InvestigationReport, WorkItemId FROM members
WHERE HasInvestigation AND ClusterId >= 0""")
def _(spark, folder):
    return aggregates.investigated_members(_members(spark, folder))


@query("unmerged_summary", f"""WITH RECURSIVE {MEMBER_SQL}
SELECT ClusterId, ord, TestName, Owner, InvestigationReport, WorkItemId FROM members""")
def _(spark, folder):
    return aggregates.unmerged_summary(_members(spark, folder))


@query("merged_summary", f"""WITH RECURSIVE {MEMBER_SQL},
numbered_members AS (SELECT *, row_number() OVER (PARTITION BY ClusterId, TestName ORDER BY ord) AS rn
                     FROM members)
SELECT ClusterId, TestName, ord, Owner, InvestigationReport, WorkItemId
FROM numbered_members WHERE rn = 1""")
def _(spark, folder):
    return aggregates.merged_summary(_members(spark, folder))


@query("average_linkage_clusters")
def average_linkage_query(spark, folder):
    return clusters.average_linkage_messages(
        fx.table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text", 0.3,
        fx.STOP_WORDS).select("doc_id", "ClusterId")


@query("predict_workitems", f"""WITH {fx.MESSAGE_SQL},
{fx.tfidf_sql('messages', 'ord', 'Message')},
best AS (
  SELECT t.ord, a.WorkItemId, row_number() OVER (PARTITION BY t.ord
           ORDER BY round(sum(x.weight * y.weight), 12) DESC, a.ord) AS rn
  FROM messages t JOIN vec x ON x.id = t.ord JOIN vec y ON y.term = x.term
       JOIN messages a ON a.ord = y.id
  WHERE a.HasInvestigation AND NOT t.HasInvestigation
  GROUP BY t.ord, a.ord, a.WorkItemId HAVING round(sum(x.weight * y.weight), 12) >= 0.7)
SELECT m.ord, TestName, Owner, coalesce(best.WorkItemId, '-') AS PredictedWorkItemId,
       FALSE AS Investigated
FROM messages m LEFT JOIN best ON best.ord = m.ord AND rn = 1 WHERE NOT HasInvestigation
UNION ALL SELECT ord, TestName, Owner, WorkItemId, TRUE FROM messages WHERE HasInvestigation""")
def predict_query(spark, folder):
    messages = error_messages(fx.message_records(spark, folder), ["doc_id"])
    return predict_messages(messages, 0.3, stop_words=fx.STOP_WORDS)


@query("predict_from_anchors", f"WITH {fx.FIXED_ANCHOR_SQL} SELECT * FROM predicted")
def predict_from_anchors_query(spark, folder):
    messages = cut_lineage(error_messages(fx.message_records(spark, folder), ["doc_id"]))
    index = new_folder(spark, "anchors")
    fit_anchors(messages.where("HasInvestigation"), index, fx.STOP_WORDS)
    return predict_from_index(index, messages.where("NOT HasInvestigation"), 0.3)
