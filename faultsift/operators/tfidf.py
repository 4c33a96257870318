"""TF-IDF vectors in long form: one row per document and term, never dense."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normalize_message
from ..session import cut_lineage
from .positions import number_rows
from .sparse_blocks import Idf


def term_counts(messages: DataFrame, key: str, text: str,
                stop_words: list[str] | None = None, normal: bool = False) -> DataFrame:
    """(key, term, tf) of normalised words of two or more characters. With `normal` the texts are normalised already.

    Without a list, Spark ML's English stop words are left out.
    """
    if stop_words is None:
        stop_words = StopWordsRemover.loadDefaultStopWords("english")
    keys = [key, "copies"] if "copies" in messages.columns else [key]
    # Texts are dealt by key before they are split, so their words are counted where they are.
    texts = messages.select(*keys, (F.col(text) if normal else normalize_message(F.col(text))).alias("_text")).repartition(
        *keys)
    return (
        texts.select(*keys, F.explode(F.split("_text", " ")).alias("term"))
        .where((F.length("term") >= 2) & ~F.col("term").isin(list(stop_words)))
        .groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    )


def document_frequency(counts: DataFrame) -> DataFrame:
    """Number of documents per term; a `copies` column counts a row more than once."""
    copies = F.sum("copies") if "copies" in counts.columns else F.count("*")
    return counts.groupBy("term").agg(copies.alias("df"))


def distinct_messages(messages: DataFrame, order: str, text: str) -> DataFrame:
    """(id, Normalized, copies): one row per normalised message, named by its first row.

    Vectors depend on the normalised text only, so everything that compares messages works
    on these rows. Copies are merged on the map side before they are shuffled.
    """
    return messages.groupBy(normalize_message(F.col(text)).alias("Normalized")).agg(
        F.min(order).alias("id"), F.count("*").alias("copies"))


def tfidf(messages: DataFrame, key: str, text: str, stop_words: list[str] | None = None,
          ) -> DataFrame:
    """(key, term, df, weight) with weight = tf * (ln((1 + n) / (1 + df)) + 1), scaled so
    that every document has length 1. Documents without terms have no rows.

    With a `copies` column, a row stands for that many equal documents.
    """
    # Both the counts and their totals per term are needed; texts are split only once.
    counts = cut_lineage(term_counts(messages, key, text, stop_words))
    return _weighted(counts, document_frequency(counts), messages, key)


def term_vectors(messages: DataFrame, key: str, text: str, stop_words: list[str] | None = None,
                 ) -> DataFrame:
    """The same with `term` as a number: terms are numbered from the rarest on, so comparing
    and joining terms is done on integers. Written out once."""
    counts = cut_lineage(term_counts(messages, key, text, stop_words))
    numbered = number_rows(document_frequency(counts), ["df", "term"], "number", split_equal=True)
    weighted = _weighted(counts, numbered, messages, key, "number")
    return cut_lineage(weighted.withColumnRenamed("number", "term"))


def count_vectors(messages: DataFrame, key: str, text: str, stop_words: list[str] | None = None,
                  ) -> tuple[DataFrame, Idf]:
    """(id, terms, weights) with counts of terms as weights, one row per message that has a term, and the idf that
    makes them the unit vectors of `term_vectors`. Terms are shuffled with their counts only, and written once.
    Texts are normalised already.

    The idf has a step for each frequency that comes, which are few: n of them need n * n / 2 postings."""
    counts = cut_lineage(term_counts(messages, key, text, stop_words, normal=True))
    numbered = cut_lineage(number_rows(document_frequency(counts), ["df", "term"], "number", split_equal=True))
    n = messages.agg(F.sum("copies") if "copies" in messages.columns else F.count("*")).first()[0] or 0
    steps = numbered.groupBy("df").agg(F.min("number").alias("first")).orderBy("first").collect()
    idf = Idf(np.array([r["first"] for r in steps], np.int64),
              np.log((1.0 + n) / (1.0 + np.array([r["df"] for r in steps], np.float64))) + 1.0)
    return cut_lineage(numbered_vectors(counts, numbered, key)), idf


def numbered_vectors(counts: DataFrame, numbered: DataFrame, key: str) -> DataFrame:
    """(id, terms, weights) with counts of terms as weights, terms by their number; without those that have none."""
    rows = counts.join(numbered, "term").select(
        F.col(key).alias("id"), F.col("number").cast("int").alias("term"), F.col("tf").cast("int").alias("tf"))
    pairs = F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("_v")
    return rows.repartition("id").groupBy("id").agg(pairs).select(
        "id", F.col("_v.term").alias("terms"), F.col("_v.tf").alias("weights"))


def _weighted(counts: DataFrame, frequency: DataFrame, messages: DataFrame, key: str,
              term: str = "term") -> DataFrame:
    if "copies" in messages.columns:
        n = messages.agg(F.sum("copies")).scalar()
    else:
        n = messages.agg(F.count("*")).scalar()
    idf = F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0
    raw = counts.join(frequency, "term").withColumn("raw", F.col("tf") * idf)
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.select(key, term, "df", (F.col("raw") / length).alias("weight"))


def prefix_of(postings: DataFrame, key: str, least: float) -> DataFrame:
    """The rarest terms of every unit vector that any partner with cosine >= least must share,
    with `reach`, the length of the vector from the term on.

    Terms are taken by their number (rare first) until the rest of the vector is shorter
    than `least`. If two vectors shared no prefix term, all their common terms would lie in
    the rest of one of them, and their product would stay below `least`.
    """
    rare_first = (Window.partitionBy(key).orderBy("term")
                  .rowsBetween(Window.unboundedPreceding, -1))
    before = F.coalesce(F.sum(F.col("weight") * F.col("weight")).over(rare_first), F.lit(0.0))
    reach = F.sqrt(F.greatest(1.0 - F.col("_before"), F.lit(0.0)))
    return postings.withColumn("_before", before).where(
        F.col("_before") <= 1.0 - least * least + 1e-9).withColumn("reach", reach).drop("_before")
