"""The corpus pipeline: five stages, each written and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultsift.llm.common import table
from faultsift.llm.decontamination import find_overlaps
from faultsift.llm.jaccard import jaccard_components
from faultsift.llm.language import UNKNOWN, fit_filter, language_of
from faultsift.llm.lines import dedup_lines
from faultsift.llm.mixing import mix_sources
from faultsift.session import cut_lineage, new_folder

#: Rows are told apart by a number or by id and text, so repeated and null ids do no harm.
_ROW, _FOUND = "_row", "_found"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str, least_score: float = 0.3) -> DataFrame:
    """Rejects documents without a letter or without a language that stands out."""
    found = docs.withColumn(_FOUND, language_of(docs["text"], fit_filter(docs)))
    return found.where((F.col(_FOUND)["lang_pred"] != UNKNOWN) & (F.col(_FOUND)["score"] >= least_score)).select(
        docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs; a document that loses all its lines goes."""
    out = dedup_lines(docs)
    out = out.where((F.col("n_deleted") < F.col("n_lines")) | (F.col("n_deleted") == 0))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicate rows the one with the least id stays, of equal ids one of them.

    Rows are judged by their texts alone, so rows that share an id, or have none, do not go with each other;
    a row without words is a group of its own."""
    rows = cut_lineage(docs.withColumn(_ROW, F.monotonically_increasing_id()))
    groups = cut_lineage(jaccard_components(rows, key=_ROW))
    order = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", _ROW)).alias("first")
    kept = rows.select(_ROW, "doc_id").join(groups, _ROW).groupBy("component_id").agg(order)
    return rows.join(kept.select(f"first.{_ROW}"), _ROW, "left_semi").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that overlap with an item of the benchmark."""
    rows = docs.withColumn(_ROW, F.xxhash64("doc_id", "text"))
    found = cut_lineage(find_overlaps(rows, table(spark, sf_dir, "benchmark"), key=_ROW).select(_ROW).distinct())
    return rows.join(found, _ROW, "left_anti").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as a manifest: documents that are taken, how often, and their words."""
    return mix_sources(docs).where(F.col("copies") > 0)


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("n-gram Jaccard join", jaccard_join),
          ("benchmark decontamination", decontamination), ("mixing", mixing)]

#: SQL cannot express the language filters or the pivotal draws.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet in the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        out, path = stage(spark, docs, sf_dir), new_folder(spark, "stage")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
