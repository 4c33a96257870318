"""Quality rules as a short-circuit cascade, ordered by rejection per cost.

On a sample every rule is timed and its rejections noted. The rule that rejects most per second comes
first; the next is chosen by what it rejects of the rest, and so on. Over the corpus a text leaves the
cascade at the first rule that rejects it. The order changes only the work: a text is kept when no
rule rejects it, in whatever order they run.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, blocks, encoded, hash_fraction

_SPACE, _SYMBOLS, _DIGITS = b" \t\n\x0b\x0c\r", b"#*$%&|<>", b"0123456789"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))


def count_of(data: bytes, wanted: bytes) -> int:
    return len(data) - len(data.translate(None, wanted))


@dataclass
class Text:
    """A text in UTF-8 with the base counts of it."""
    data: bytes
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int


@dataclass(frozen=True)
class Rule:
    """Rejects texts; all comparisons are of whole numbers."""
    name: str
    rejects: Callable[[Text], bool]


def _dotted(text: Text) -> bool:
    lines = [line for line in map(bytes.strip, text.data.split(b"\n")) if line]
    return 100 * sum(line.endswith(b"...") for line in lines) > 30 * len(lines)


def _repeated_lines(text: Text) -> bool:
    if not text.n_dup_lines:
        return False
    lines = sum(map(bool, map(bytes.strip, text.data.split(b"\n"))))
    return 100 * text.n_dup_lines > 60 * lines


RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > 3 * t.n_words),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 20 * t.n_words),
    Rule("repeated_lines", _repeated_lines),
    Rule("dotted_lines", _dotted),
    Rule("digits", lambda t: 100 * count_of(t.data, _DIGITS) > 20 * t.word_chars),
    Rule("shouting",
         lambda t: 100 * count_of(t.data, _UPPER) > 50 * count_of(t.data, _LETTERS)),
)


def repeated_window_words(words: np.ndarray, owner: np.ndarray, n_texts: int,
                          width: int = 5) -> np.ndarray:
    """Per text, the words in windows of five that occur twice or more in that text.

    `words` numbers the words of all texts of a block, `owner` their texts. Windows are named
    exactly, by numbering pairs of names; nothing is hashed."""
    n = len(words) - width + 1
    if n < 1:
        return np.zeros(n_texts, np.int64)

    def name(*parts):
        code = parts[0].astype(np.int64)
        for part in parts[1:]:
            code = code * (int(part.max()) + 1) + part
            code = pd.factorize(code)[0]
        return code

    two = name(words[:-1], words[1:])
    four = name(two[:-2], two[2:])
    inside = np.flatnonzero(owner[:n] == owner[width - 1:])
    window = name(four[:n][inside], words[width - 1:][inside], owner[inside])
    twice = inside[np.bincount(window)[window] > 1] if len(window) else inside
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + width, -1)
    return np.bincount(owner[np.cumsum(covered)[:-1] > 0], minlength=n_texts)


def base_counts(texts: list[str | None]) -> pd.DataFrame:
    """The base columns of the texts of a block, and their UTF-8 as `data`."""
    data = [encoded(t) for t in texts]
    split = [d.split() for d in data]
    sizes = np.array([len(w) for w in split], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    flat = np.empty(int(sizes.sum()), object)
    flat[:] = [w for words in split for w in words]
    names = pd.factorize(flat)[0]

    def repeated_lines(d: bytes) -> int:
        lines = [line for line in d.split(b"\n") if line.strip()] if b"\n" in d else []
        return len(lines) - len(set(lines))

    return pd.DataFrame({
        "data": data, "n_words": sizes,
        "word_chars": [len(t or "") - count_of(d, _SPACE) for t, d in zip(texts, data, strict=True)],
        "n_symbols": [count_of(d, _SYMBOLS) for d in data],
        "n_dup_lines": [repeated_lines(d) for d in data],
        "n_repeat_words": repeated_window_words(names, owner, len(texts))})


def _texts_of(counts: pd.DataFrame) -> list[Text]:
    return [Text(*row) for row in zip(counts["data"], *(
        counts[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")), strict=True)]


def rule_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000,
               key: str = "doc_id", text: str = "text") -> list[int]:
    """The rules by rejection per cost, from about `sample_rows` texts spread over all rows.

    Each task sums, for each set of rules that reject a text together, texts and seconds of every
    rule; the driver sees one row per task and set of rules."""
    total = docs.count()
    rows = docs.where(hash_fraction(F.col(key), "cascade") < sample_rows / max(total, 1)).select(
        docs[text].alias("_text"))

    def measure(batches):
        for batch in batches:
            for part in blocks(list(batch["_text"])):
                for item in _texts_of(base_counts(list(batch["_text"].iloc[part]))):
                    rejected, nanos = 0, []
                    for i, rule in enumerate(rules):
                        start = time.perf_counter_ns()
                        rejected |= int(rule.rejects(item)) << i
                        nanos.append(time.perf_counter_ns() - start)
                    yield pd.DataFrame({"rejected": [rejected], "nanos": [nanos]})

    outcomes = (
        rows.mapInPandas(measure, "rejected long, nanos array<long>").groupBy("rejected")
        .agg(F.count(F.lit(1)).alias("n"),
             *[F.sum(F.col("nanos")[i]).alias(f"nanos_{i}") for i in range(len(rules))]).collect())
    order, left = [], set(range(len(rules)))
    while left:
        still = [o for o in outcomes if not any(o["rejected"] >> i & 1 for i in order)]

        def gain(i, still=still):
            cost = sum(o[f"nanos_{i}"] for o in still) + 1
            return sum(o["n"] for o in still if o["rejected"] >> i & 1) / cost, -i

        order.append(max(left, key=gain))
        left.remove(order[-1])
    return order


def quality_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000,
                    key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, base counts, `base_failed`, and `kept`.

    A null or empty text has counts of 0, fails the base and is not kept. Rows are independent:
    repeated keys, null keys and other columns change nothing; an empty table gives an empty table.
    """
    order = rule_order(docs, rules, sample_rows, key, text)

    def judge(batches):
        cascade = [rules[i].rejects for i in order]
        for batch in batches:
            for part in blocks(list(batch["_text"])):
                out = base_counts(list(batch["_text"].iloc[part]))
                failed = ((out["n_words"] < 10)
                          | (100 * out["n_repeat_words"] > 20 * out["n_words"]))
                out["base_failed"] = failed
                out["kept"] = [not bad and not any(rejects(item) for rejects in cascade)
                               for bad, item in zip(failed, _texts_of(out), strict=True)]
                out["_key"] = batch["_key"].iloc[part].array
                yield out.drop(columns="data")

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(as_text(docs[key]).alias("_key"), docs[text].alias("_text"))
    return rows.mapInPandas(
        judge, "_key string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, base_failed boolean, kept boolean").withColumn(
        "_key", F.col("_key").cast(kind)).withColumnRenamed("_key", key)
