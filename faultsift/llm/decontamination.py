"""Benchmark decontamination with spaced seeds.

A seed is a mask over consecutive tokens; it ignores the positions marked 0, so two texts with
substituted words still share seeds. Every position of every benchmark item and of every document is
hashed under each mask, and the hashes are joined. Around a hit the item is laid over the document,
and the overlap is verified token by token, substitutions included.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import Membership, WordHashes, as_text, blocks, mixed, rows_at_once

MASKS = ("1101001101", "1011000111", "1110010011")
#: Items below the span of the masks are looked up whole; below this length they are not searched.
SHORTEST = 5
#: Rows that a task gets at once, and characters that it searches at once.
ROWS, CHARACTERS = 500, 250_000
_PUNCTUATION = bytes(c for c in range(128) if not chr(c).isalnum())
_TO_SPACE = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII punctuation separates."""
    return (text or "").lower().encode("utf-8", "replace").translate(_TO_SPACE).split()


def masks_up_to(span: int) -> list[tuple[int, str]]:
    """The masks with their numbers; whole-item masks for short lengths follow."""
    return [*enumerate(MASKS), *((10 + n, "1" * n) for n in range(SHORTEST, span))]


def seeds(hashed: np.ndarray, number: int, mask: str) -> np.ndarray:
    """The seed at every position where the mask fits."""
    n = len(hashed) - len(mask) + 1
    out = np.full(max(n, 0), np.uint64(number + 1))
    with np.errstate(over="ignore"):
        for i, used in enumerate(mask):
            if used == "1" and n > 0:
                out = (out + hashed[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
    return mixed(out)


def item_seeds(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, mask, place, seed, n) of the benchmark."""
    span = len(MASKS[0])

    def cut(batches):
        hashes = WordHashes()
        for batch in batches:
            for item, words in zip(batch["_key"], map(tokens, batch["_text"]), strict=True):
                hashed = hashes.of(words)
                for number, mask in masks_up_to(span):
                    if number < 10 and len(words) >= span or len(mask) == len(words):
                        found = seeds(hashed, number, mask)
                        yield pd.DataFrame({"item": item, "place": np.arange(len(found)),
                                            "seed": found.view(np.int64)})

    rows = items.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.mapInPandas(cut, "item long, place long, seed long")


def best_overlap(equal: np.ndarray) -> tuple[int, int, int]:
    """Start, length and equal tokens of the run with the largest sum of +1 (equal) and -2."""
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 1, -2))])
    least = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - least))
    start = int(np.argmin(sums[:end + 1]))
    return start, end - start, int(equal[start:end].sum())


def find_overlaps(docs: DataFrame, items: DataFrame, least: int = 10, reach: int = 64,
                  log_bits: int = 24, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The best overlap of every document and item that share one: key, item_id, doc_start,
    item_start, n_tokens, n_matches (in tokens).

    An overlap counts with `least` equal tokens, or all of a shorter item, and at most one
    substitution for two equal tokens. Null and empty texts overlap with nothing, and neither do items
    of fewer than 5 tokens or with a null id. Rows that repeat a key give one result. An empty
    table on either side gives no rows. Every task holds a filter of fixed size (2^log_bits bits)
    over the benchmark's seeds; what passes it is joined with the seeds themselves."""
    with rows_at_once(docs.sparkSession, ROWS):
        return _overlaps(docs, items, least, reach, log_bits, key, text, item_key, item_text)


def _overlaps(docs: DataFrame, items: DataFrame, least: int, reach: int, log_bits: int, key: str, text: str,
              item_key: str, item_text: str) -> DataFrame:
    item_rows = cut_lineage(item_seeds(items, item_key, item_text))
    filter_ = Membership.over(item_rows, "seed", log_bits)
    span = len(MASKS[0])

    def search(batches):
        hashes = WordHashes(50_000)
        for batch in batches:
            for part in blocks(list(batch["_text"]), CHARACTERS):
                split = [tokens(t) for t in batch["_text"].iloc[part]]
                sizes = np.array([len(w) for w in split], np.int64)
                hashed = hashes.of([w for words in split for w in words])
                owner = np.repeat(np.arange(len(split)), sizes)
                begins = np.cumsum(sizes) - sizes
                places, found = [], []
                for number, mask in masks_up_to(span):
                    values = seeds(hashed, number, mask)
                    if not len(values):
                        continue
                    at = np.flatnonzero(filter_.has(values))
                    at = at[owner[at] == owner[at + len(mask) - 1]]
                    places.append(at)
                    found.append(values[at])
                if not places or not sum(map(len, places)):
                    continue
                at, values = np.concatenate(places), np.concatenate(found)
                order = np.argsort(at, kind="stable")
                at, values = at[order], values[order]
                cuts = np.flatnonzero((np.diff(at) > reach) | (np.diff(owner[at]) > 0)) + 1
                keys, rows = batch["_key"].iloc[part].array, []
                for hits, seed in zip(np.split(at, cuts), np.split(values, cuts), strict=True):
                    doc = owner[hits[0]]
                    low = max(hits[0] - reach, begins[doc])
                    high = min(hits[-1] + span + reach, begins[doc] + sizes[doc])
                    rows.append((keys[doc], low - begins[doc], hashed[low:high].view(np.int64),
                                 hits - begins[doc], seed.view(np.int64)))
                yield pd.DataFrame(rows, columns=["_key", "low", "tokens", "places", "seeds"])

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(as_text(docs[key]).alias("_key"), docs[text].alias("_text")).mapInPandas(
        search, "_key string, low long, tokens array<long>, places array<long>, seeds array<long>")
    parts = cut_lineage(found.withColumn("part", F.monotonically_increasing_id()))
    hits = parts.select("part", F.explode(F.arrays_zip("places", "seeds")).alias("hit")).select(
        "part", F.col("hit.places").alias("at"), F.col("hit.seeds").alias("seed"))
    laid = hits.join(item_rows, "seed").select(
        "part", "item", (F.col("at") - F.col("place")).alias("shift")).distinct()

    def hash_items(batches):
        hashes = WordHashes()
        for batch in batches:
            yield pd.DataFrame({"item": batch["_key"], "item_tokens": [
                hashes.of(tokens(t)).view(np.int64) for t in batch["_text"]]})

    hashed_items = items.where(F.col(item_key).isNotNull()).select(
        F.col(item_key).alias("_key"), F.col(item_text).alias("_text")).mapInPandas(
        hash_items, "item long, item_tokens array<long>")

    def verify(batches):
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                item, part = np.asarray(row.item_tokens), np.asarray(row.tokens)
                first = row.shift - row.low                       # of the item, in the part
                low, high = max(first, 0), min(first + len(item), len(part))
                start, n, same = best_overlap(part[low:high] == item[low - first:high - first])
                if same >= min(least, len(item)):
                    rows.append((row.owner, row.item, row.low + low + start, low - first + start, n, same))
            yield pd.DataFrame(rows, columns=["_key", "item_id", "doc_start", "item_start", "n_tokens",
                                              "n_matches"])

    placed = laid.join(parts.select("part", F.col("_key").alias("owner"), "low", "tokens"), "part").join(
        hashed_items, "item")
    numbers = ["item_id", "doc_start", "item_start", "n_tokens", "n_matches"]
    verified = cut_lineage(placed.mapInPandas(
        verify, "_key string, " + ", ".join(f"{c} long" for c in numbers)))
    best = F.max(F.struct("n_matches", -F.col("n_tokens"), -F.col("doc_start"), -F.col("item_start"))).alias("b")
    return verified.groupBy("_key", "item_id").agg(best).select(
        F.col("_key").cast(kind).alias(key), "item_id", (-F.col("b.col3")).alias("doc_start"),
        (-F.col("b.col4")).alias("item_start"), (-F.col("b.col2")).alias("n_tokens"),
        F.col("b.n_matches").alias("n_matches"))
