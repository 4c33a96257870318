"""Language identification with n-gram filters that hold one bit per language.

A bit-sliced Bloom filter is one table whose slots are bit masks, a bit for each language: an n-gram
is entered by setting its language's bit in k slots, and the AND of its k slots names all languages
that (seem to) contain it. A text's n-grams are looked up once for all languages; the counts of bits
are corrected for the false positives that each language's own filling lets expect, and the language
with the largest corrected share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import blocks, stratified_sample

#: What is no letter; `\w` also holds number signs such as a half.
_NOT_LETTERS = regex.compile(r"\P{L}+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"
#: Characters that are looked up at once; arrays take about 100 bytes for each.
CHARS = 250_000


def letters(text: str | None) -> str:
    """Lower-cased letters with one space for all else, and around."""
    return f" {_NOT_LETTERS.sub(' ', (text or '').lower()).strip()} "


def grams(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of prepared texts, and the text each belongs to."""
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "replace"), np.uint32)
    ends = codes == 10
    owner = np.cumsum(ends) - ends
    n = len(codes) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashed = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            hashed = (hashed + codes[i:i + n] + np.uint64(1)) * _MIX
            hashed ^= hashed >> np.uint64(31)
    inside = (owner[:n] == owner[size - 1:]) & ~ends[size - 1:]
    return hashed[inside], owner[:n][inside]


def slots(hashed: np.ndarray, n_slots: int, hashes: int) -> list[np.ndarray]:
    low, high = hashed & np.uint64(0xFFFFFFFF), (hashed >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return [((low + np.uint64(i) * high) % np.uint64(n_slots)).astype(np.int64)
                for i in range(hashes)]


@dataclass
class LanguageFilter:
    """Languages in order, and the slots: a row of bytes for each, a bit for each language."""
    languages: list[str]
    table: np.ndarray
    size: int
    hashes: int

    def false_positives(self) -> np.ndarray:
        bits = np.unpackbits(self.table, axis=1, bitorder="little")[:, :len(self.languages)]
        return bits.mean(axis=0) ** self.hashes

    def shares(self, prepared: list[str], wrong: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Corrected share of each text's n-grams in each language, and its number of n-grams."""
        hashed, owner = grams(prepared, self.size)
        n = np.bincount(owner, minlength=len(prepared))
        masks = None
        for where in slots(hashed, len(self.table), self.hashes):
            masks = self.table[where] if masks is None else masks & self.table[where]
        hits = np.stack([
            np.bincount(owner, masks[:, i // 8] >> (i % 8) & 1, minlength=len(prepared))
            for i in range(len(self.languages))], axis=1)
        raw = hits / np.maximum(n, 1)[:, None]
        return np.clip((raw - wrong) / np.maximum(1 - wrong, 1e-9), 0, 1), n


def fit_filter(labelled: DataFrame, size: int = 3, n_slots: int = 1 << 18, hashes: int = 3,
               sample_rows: int = 1500, least_rate: float = 2e-5, least_part: float = 0.3,
               key: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageFilter:
    """Fit on about `sample_rows` labelled rows of each language (a bounded sample).

    An n-gram is entered for a language where it makes up `least_rate` of that language's n-grams
    and `least_part` of the largest such rate in any language. The n-grams stay in Spark; each task
    returns a table of fixed size, and the tables are joined by OR."""
    rows = labelled.where(F.col(lang).isNotNull()).select(
        F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    sample = stratified_sample(rows, "_lang", "_key", sample_rows, "language")

    def count(batches):
        for batch in batches:
            for name, group in batch.groupby("_lang"):
                texts = list(group["_text"])
                for part in blocks(texts):
                    found, n = np.unique(grams([letters(t) for t in texts[part]], size)[0],
                                         return_counts=True)
                    yield pd.DataFrame({"lang": name, "gram": found.view(np.int64), "n": n})

    counted = (sample.mapInPandas(count, "lang string, gram long, n long")
               .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    counted = cut_lineage(counted)
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    width = max(1, -(-len(languages) // 8))
    if not languages:
        return LanguageFilter([], np.zeros((n_slots, width), np.uint8), size, hashes)
    total = F.element_at(F.create_map(*[F.lit(x) for kv in totals.items() for x in kv]), F.col("lang"))
    rated = counted.withColumn("rate", F.col("n") / total).withColumn(
        "most", F.max("rate").over(Window.partitionBy("gram")))       # a row per language at most
    chosen = rated.where((F.col("rate") >= least_rate) & (F.col("rate") >= least_part * F.col("most")))

    def build(batches):
        table = np.zeros((n_slots, width), np.uint8)
        for batch in batches:
            bit = batch["lang"].map({name: i for i, name in enumerate(languages)}).to_numpy()
            for where in slots(batch["gram"].to_numpy(np.int64).view(np.uint64), n_slots, hashes):
                np.bitwise_or.at(table, (where, bit // 8), (1 << (bit % 8)).astype(np.uint8))
        yield pd.DataFrame({"table": [table.tobytes()]})

    table = np.zeros(n_slots * width, np.uint8)
    for row in chosen.select("lang", "gram").coalesce(4).mapInPandas(build, "table binary").collect():
        table |= np.frombuffer(row["table"], np.uint8)
    return LanguageFilter(languages, table.reshape(n_slots, width), size, hashes)


def language_of(text: Column, model: LanguageFilter) -> Column:
    """A struct of `lang_pred` and `score`, the winner's part of all corrected shares.

    A text that is null, empty or without a letter gets `und` and 0, as does every text when no
    language was learned. A text whose n-grams are all unknown gets the first language and 0. Of equal
    shares the first language in order wins."""
    def judge(texts: list) -> pd.DataFrame:
        prepared = [letters(t) for t in texts]
        names = np.full(len(prepared), UNKNOWN, object)
        score = np.zeros(len(prepared))
        if model.languages:
            shares, _ = model.shares(prepared, model.false_positives())
            some = np.array([p != "  " for p in prepared])
            best = shares.argmax(axis=1)
            names[some] = np.array(model.languages, object)[best[some]]
            total = np.maximum(shares.sum(axis=1), 1e-12)
            score[some] = (shares.max(axis=1) / total)[some]
        return pd.DataFrame({"lang_pred": names, "score": score})

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(batch)
            yield pd.concat([judge(texts[part]) for part in blocks(texts, CHARS)] or [judge([])])

    return predict(text)


def predict_language(docs: DataFrame, model: LanguageFilter, key: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """Per row: key, `lang_pred` and `score` of `language_of`.

    Repeated and null keys stay; other columns are not read."""
    return docs.select(docs[key], language_of(docs[text], model).alias("p")).select(
        key, "p.lang_pred", "p.score")
