"""Token counts by a whole-token shortcut over a SentencePiece BPE model.

A model whose pieces hold the space mark only at their start can never merge across the start of a
run of spaces, so a text is a sequence of chunks (spaces, then what follows) that are encoded
independently. Which vocabulary strings come back as one token when encoded alone is proven once,
on the driver; a chunk that is such a string counts 1. Only other chunks are merged, by the library.
"""

from __future__ import annotations

import re

import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, blocks, encoded

MARK = "▁"
_CHUNK = re.compile(" +[^ ]*")


def splits_at_spaces(processor: sentencepiece.SentencePieceProcessor) -> bool:
    """No piece has the space mark after another character, and texts are not normalised."""
    pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    plain = " a  b\tﬁ ½⁵\nA "
    return (all(MARK not in p.lstrip(MARK) for p in pieces)
            and processor.normalize(plain) == MARK + plain.replace(" ", MARK))


def proven_single_tokens(processor: sentencepiece.SentencePieceProcessor) -> list[str]:
    """Words that the library encodes, with the mark before them, as exactly one token."""
    words = [p[1:] for p in (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
             if p.startswith(MARK) and len(p) > 1]
    return [w for w, ids in zip(words, processor.encode(words, num_threads=1), strict=True)
            if len(ids) == 1]


def chunks(text: str) -> list[str]:
    """Each chunk without the first of its spaces (the library puts one before what it encodes)."""
    if MARK in text:
        text = text.replace(MARK, " ")
    if not text:
        return []
    parts = text.split(" ")
    if "" in parts:
        return [c[1:] for c in _CHUNK.findall(" " + text)]
    return parts


class ChunkCounter:
    """Tokens of whole texts. The memory of merged chunks is bounded: it starts anew when full."""

    def __init__(self, model: bytes, single: list[str], memory: int = 200_000, longest: int = 48):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.single = dict.fromkeys(single, 1)
        self.single[""] = len(self.processor.encode("a ")) - len(self.processor.encode("a"))
        self.memory, self.longest, self.known = memory, longest, dict(self.single)
        self.split = splits_at_spaces(self.processor)

    def count(self, texts: list[str]) -> list[int]:
        if not self.split:
            return [len(ids) for ids in self.processor.encode(texts, num_threads=1)]
        if len(self.known) > self.memory + len(self.single):
            self.known = dict(self.single)
        parts = [chunks(t) for t in texts]
        missing = list(set().union(*parts).difference(self.known))
        for chunk, ids in zip(missing, self.processor.encode(missing, num_threads=1), strict=True):
            self.known[chunk] = len(ids)
        counts = [sum(map(self.known.__getitem__, p)) for p in parts]
        for chunk in missing:
            if len(chunk) > self.longest:
                del self.known[chunk]
        return counts


def token_counts(docs: DataFrame, model: bytes, limit: int = 4096, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """Per row: key, UTF-8 bytes, tokens, and whether the tokens exceed the limit.

    A null or empty text has 0 bytes and 0 tokens. Rows are independent: repeated keys and null
    keys stay as they are, other columns are not read, and an empty table gives an empty table.
    """
    single = proven_single_tokens(sentencepiece.SentencePieceProcessor(model_proto=model))

    def count(batches):
        counter = ChunkCounter(model, single)
        for batch in batches:
            for part in blocks(list(batch["_text"])):
                texts = ["" if t is None else t for t in batch["_text"].iloc[part]]
                n = counter.count(texts)
                yield pd.DataFrame({
                    "_key": batch["_key"].iloc[part].array, "n_bytes": [len(encoded(t)) for t in texts],
                    "n_tokens": n, "over_limit": [x > limit for x in n]})

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(as_text(docs[key]).alias("_key"), docs[text].alias("_text"))
    return rows.mapInPandas(
        count, "_key string, n_bytes long, n_tokens long, over_limit boolean"
    ).withColumn("_key", F.col("_key").cast(kind)).withColumnRenamed("_key", key)
