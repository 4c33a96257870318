"""What the text operators share: tables, exact word splitting, blocks and bounded samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import rows_at_once  # noqa: F401

#: Words are runs of characters other than these six.
SPACES = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words_column(text: str) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text column; empty for null."""
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), f"[{SPACES}]+"), lambda w: w != "")


def as_text(key: Column) -> Column:
    """A key as text, for the way through pandas: an integer beside a null would become a float there."""
    return key.cast("string")


def encoded(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "replace")


def blocks(texts: list, limit: int = 2_000_000) -> Iterator[slice]:
    """Slices of a batch of about so many characters, so that arrays stay small."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text) if text is not None else 0
        if size >= limit:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def hash_fraction(key: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.pmod(F.xxhash64(F.lit(salt), key), F.lit(1 << 30)) / float(1 << 30)


def stratified_sample(df: DataFrame, stratum: str, key: str, rows: int, salt: str) -> DataFrame:
    """About `rows` rows of each stratum (all, if there are fewer), chosen by a hash of the key.

    The strata are counted over all rows. Only use with strata that are few (languages, labels)."""
    counts = {r[0]: r[1] for r in df.groupBy(stratum).count().collect()}
    keep = F.lit(False)
    for value, n in sorted(counts.items()):
        keep = keep | ((F.col(stratum) == F.lit(value))
                       & (hash_fraction(F.col(key), salt) < rows / n))
    return df.where(keep)


class WordHashes:
    """64-bit hashes of words, the same in every process. The memory of known words is bounded."""

    def __init__(self, memory: int = 200_000, longest: int = 64):
        self.known: dict[bytes, int] = {}
        self.memory, self.longest = memory, longest

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.memory:
            self.known = {}
        missing = set(words).difference(self.known)
        self.known.update((w, xxhash.xxh3_64_intdigest(w)) for w in missing)
        found = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        for word in missing:
            if len(word) > self.longest:
                del self.known[word]
        return found


def mixed(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        values = values ^ (values >> np.uint64(30))
        values = values * np.uint64(0xBF58476D1CE4E5B9)
        values = values ^ (values >> np.uint64(27))
        values = values * np.uint64(0x94D049BB133111EB)
        return values ^ (values >> np.uint64(31))


class Membership:
    """A Bloom filter of fixed size over 64-bit values: no false negatives, whatever it holds.

    It only spares work; who uses it joins with the true table afterwards."""

    def __init__(self, log_bits: int, bits: np.ndarray | None = None):
        self.log_bits = log_bits
        self.bits = np.zeros(1 << (log_bits - 3), np.uint8) if bits is None else bits

    def _places(self, values: np.ndarray) -> list[np.ndarray]:
        m = mixed(values)
        mask = np.uint64((1 << self.log_bits) - 1)
        return [m & mask, (m >> np.uint64(34)) & mask]

    def add(self, values: np.ndarray) -> None:
        for place in self._places(values):
            np.bitwise_or.at(self.bits, (place >> np.uint64(3)).astype(np.int64),
                             (np.uint8(1) << (place & np.uint64(7)).astype(np.uint8)))

    def has(self, values: np.ndarray) -> np.ndarray:
        found = np.ones(len(values), bool)
        for place in self._places(values):
            found &= (self.bits[(place >> np.uint64(3)).astype(np.int64)]
                      >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return found

    @classmethod
    def over(cls, df: DataFrame, column: str, log_bits: int = 24) -> Membership:
        """Over a long column: each task fills bits of the fixed size, the driver joins them."""
        def fill(batches):
            part = cls(log_bits)
            for batch in batches:
                part.add(batch["v"].dropna().to_numpy(np.int64).view(np.uint64))
            yield pd.DataFrame({"bits": [part.bits.tobytes()]})

        whole = cls(log_bits)
        for row in df.select(F.col(column).cast("long").alias("v")).coalesce(4).mapInPandas(
                fill, "bits binary").collect():
            whole.bits |= np.frombuffer(row["bits"], np.uint8)
        return whole
