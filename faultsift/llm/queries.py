"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder
from .common import table
from .conversations import repair_conversations
from .decontamination import find_overlaps
from .jaccard import jaccard_components
from .language import fit_filter, predict_language
from .lines import dedup_lines
from .mixing import mix_sources
from .packing import pack_documents
from .phrases import collocations
from .quality import quality_cascade
from .tokens import token_counts
from .toxicity import fit_chain, score_toxicity
from .urls import filter_urls
from .warc import read_archive, write_archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def fold(parts: int) -> Column:
    """crc32 of the id as text, in so many parts."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % parts


@query
def op1_spaced_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return find_overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op2_toxicity_chain(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    chain = fit_chain(docs, table(spark, folder, "labels").where(fold(3) != 1))
    return score_toxicity(docs, chain).select(
        "doc_id", (fold(3) == 1).alias("held_out"), "score", "predicted", "n_words", "spans")


@query
def op3_quality_cascade(spark: SparkSession, folder: str) -> DataFrame:
    return quality_cascade(table(spark, folder, "documents"))


@query
def op4_language_filters(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = fit_filter(docs.where(fold(5) != 0))
    return predict_language(docs, model).select(
        "doc_id", (fold(5) == 0).alias("held_out"), "lang_pred", "score")


@query
def op5_line_runs(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op6_warc_chains(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "warc")
    write_archive(table(spark, folder, "pages"), path)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    return read_archive(spark, path).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page("refers_to").alias("refers_to"))


@query
def op7_size_aware_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents"))


@query
def op8_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies")


#: What `pages` is judged by.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
             ("net/es/", "block"), ("net/fr/", "block")]


@query
def op9_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return filter_urls(table(spark, folder, "pages"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict", "block_score")


@query
def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    return token_counts(table(spark, folder, "documents"), model)


@query
def op11_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        tokenizer = file.read()
    return pack_documents(table(spark, folder, "documents"), tokenizer)


@query
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair_conversations(table(spark, folder, "conversations"))


@query
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))
