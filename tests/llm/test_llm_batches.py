"""Tasks of the text operators get few long rows at once."""

import numpy as np
import pyarrow as pa
import pytest

from faultsift.llm import decontamination, jaccard, phrases
from faultsift.llm.language import LanguageFilter, predict_language

SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("module, run", [(jaccard, jaccard.jaccard_components), (phrases, phrases.collocations)])
def test_batches_are_bounded(spark, monkeypatch, module, run):
    before, seen, write = spark.conf.get(SETTING), [], module.cut_lineage
    monkeypatch.setattr(module, "cut_lineage", lambda df: seen.append(spark.conf.get(SETTING)) or write(df))
    docs = spark.createDataFrame([(i, "en", "one two three four five six") for i in range(5)],
                                 "doc_id long, lang string, text string")
    assert run(docs).count() in (0, 5)
    assert seen[0] == str(module.TEXTS) and spark.conf.get(SETTING) == before
    if module is phrases:
        assert seen.count(str(module.BLOCKS)) > 4


def test_language_is_looked_up_in_small_parts(spark):
    """Arrays of 2,000,000 characters took some 200 MB of every task."""
    class Watched(LanguageFilter):
        def shares(self, prepared, wrong):
            assert sum(map(len, prepared)) < 300_000
            return super().shares(prepared, wrong)

    table = np.full((64, 1), 1, np.uint8)
    docs = spark.createDataFrame([(i, "abc def " * 500) for i in range(200)], "doc_id long, text string").coalesce(1)
    found = predict_language(docs, Watched(["en"], table, 3, 3))
    assert found.where("lang_pred = 'en'").count() == 200


def test_counts_of_candidates_are_parts_of_arrays(spark, monkeypatch):
    """A task reported a row for every candidate it has."""
    plans, write = [], phrases.cut_lineage
    monkeypatch.setattr(phrases, "PART", 3)
    monkeypatch.setattr(phrases, "cut_lineage", lambda df: plans.append(
        df._jdf.queryExecution().executedPlan().toString()) or write(df))
    texts = [f"a{i} b{i} c{i} a{j} b{j}" for i in range(5) for j in range(5)] + ["a0 b0 c0. a1 b1"] * 3
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)],
                                 "doc_id long, lang string, text string").repartition(6)
    expected = {}
    for piece in ".".join(texts).split("."):
        words = piece.split()
        for k in range(1, 4):
            for i in range(len(words) - k + 1):
                phrase = " ".join(words[i:i + k])
                expected[phrase] = expected.get(phrase, 0) + 1
    counts, _ = phrases.phrase_counts(docs, support=4, longest=3)
    assert {r["phrase"]: r["f"] for r in counts.collect()} == {p: n for p, n in expected.items() if n >= 4}
    assert sum("_unpacked" in p and "FlatMapGroupsInArrow" in p for p in plans) == 2


def test_short_lists_become_pairs(spark, monkeypatch):
    """Every list of two or three sets went through the joins for long ones, several times."""
    rows, opened = [], jaccard._open_lists
    monkeypatch.setattr(jaccard, "_open_lists", lambda lists, families: rows.append(lists.count()) or opened(lists, families))
    text = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    texts = [t for i in range(20) for n in (24, 26, 70, 75) for t in [text(f"{i}n{n > 50}", n)]] + [text("a", 40)] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()}
    assert found == {i: i - i % 2 for i in range(80)} | {80: 80, 81: 80, 82: 80}
    assert rows and not sum(rows)
    rows.clear()                                              # a long one, and one set more that meets it twice
    texts = [text("b", 60) + f" z{i}" for i in range(6)] + [text("b", 48), text("c", 60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()}
    assert found == dict.fromkeys(range(7), 0) | {7: 7} and sum(rows)


def test_words_are_hashed_eight_bytes_at_a_time():
    texts = [b"", b" ", b"a ab abc", b"\x0bab\tabc\r", b"x" * 7 + b" " + b"x" * 8 + b" " + b"x" * 9 + b"\xc2\x85x",
             b"y" * 256 + b" " + b"y" * 257, b"y" * 257 + b"\n" + b"a" + b"\0", b"a"]
    hashed, sizes = jaccard.word_hashes(texts)
    words = [w for t in texts for w in t.split()]
    assert sizes.tolist() == [len(t.split()) for t in texts] and len(hashed) == len(words)
    by_word = dict(zip(words, hashed.tolist(), strict=True))
    assert [by_word[w] for w in words] == hashed.tolist() and len(set(by_word.values())) == len(by_word)


def test_overlaps_are_searched_in_small_parts(spark, monkeypatch):
    """Tasks got 10,000 rows at once, in every step, and searched 2,000,000 characters at once."""
    seen, write = [], decontamination.cut_lineage
    monkeypatch.setattr(decontamination, "cut_lineage", lambda df: seen.append(spark.conf.get(SETTING)) or write(df))
    docs = spark.createDataFrame([(i, f"a{i} " + "b c d e f g h i j k l") for i in range(20)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "b c d e f g h i j k l")], "item_id long, text string")
    before = spark.conf.get(SETTING)
    found = decontamination.find_overlaps(docs, items)
    assert len(seen) == 3 and set(seen) == {str(decontamination.ROWS)} and spark.conf.get(SETTING) == before
    assert {tuple(r) for r in found.collect()} == {(i, 1, 1, 0, 11, 11) for i in range(20)}
    assert decontamination.CHARACTERS <= 250_000


@pytest.mark.parametrize("few", [1, 2, 100])
def test_counts_of_hashes_are_arrays_by_range(spark, few):
    """Every hash of a task was a row."""
    class All:
        value = type("Known", (), {"has": staticmethod(lambda hashed: np.ones(len(hashed), bool))})

    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words[i:] + words[:i]) + ". " + "a b " * (300 if i == 3 else 1) for i in range(12)]
    docs = spark.createDataFrame([("en" if i % 2 else None, t) for i, t in enumerate(texts)],
                                 "lang string, text string").repartition(3)
    blocks = phrases.cut_lineage(phrases.encoded_blocks(docs, "lang", "text", 300))
    assert blocks.count() > 5
    expected, where = {}, {}
    for block in phrases.read_blocks(blocks.toArrow().to_batches()):
        for h in phrases._Positions(block, phrases.WordHashes())(2)[1].view(np.int64).tolist():
            expected[h] = expected.get(h, 0) + 1
            where.setdefault(h, set()).add(block.number)
    for support, flush in ((1, 4_000_000), (7, 60)):
        counts = phrases.hash_counts(blocks, 2, All, support, flush, few)
        found = {r["h"]: r for r in counts.collect()}
        assert {h: r["f"] for h, r in found.items()} == {h: n for h, n in expected.items() if n >= support}
        assert all(r["block"] in where[h] for h, r in found.items())
    assert "steps" in counts._jdf.queryExecution().toString()


def test_numbers_are_packed():
    for values in ([0], [1, 255], [256, 0, 3], [2**64 - 1, 0, 2**40], [2**56]):
        numbers = np.array(values, np.uint64)
        assert phrases._loosened(phrases._packed(numbers), len(values)).tolist() == values


def test_codes_of_blocks_take_the_bytes_they_need():
    """Four bytes each, for numbers below 65,536."""
    codes = np.arange(40_000) % 30_000
    names = pa.array([b"."] + [str(i).encode() for i in range(1, 30_000)], pa.binary())
    batch = phrases.Block(7, ["en"], names, codes, np.zeros(1, int), np.array([len(codes)])).batch()
    assert len(batch.column(3)[0].as_py()) == 2 * len(codes)
    [back] = phrases.read_blocks([batch])
    assert back.codes.tolist() == codes.tolist() and back.lengths.tolist() == [len(codes)] and back.number == 7
