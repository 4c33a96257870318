"""Packing, conversation repair and collocations against plain versions; keys and letters of the other operators."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import repair_brute as brute
import sentencepiece
from tokenizers import Tokenizer

from faultsift.llm import conversations as talk
from faultsift.llm import warc
from faultsift.llm.conversations import as_is, repair_conversations
from faultsift.llm.decontamination import find_overlaps
from faultsift.llm.jaccard import jaccard_components
from faultsift.llm.language import letters
from faultsift.llm.packing import ChunkIds, best_fit, lower_bound, pack_documents, pack_lengths
from faultsift.llm.phrases import DoubleArray, collocations
from faultsift.llm.quality import quality_cascade
from faultsift.llm.tokens import token_counts

WORDS = public_tokenizers.path("word_bpe_49k.json")
BIG = 9007199254740993
ODD = ["", None, " ", " a  b\t c\n<|endoftext|>\u00e9 e\u0301 'S it's Stra\u00dfe \u0391\u03a3 \u0130x \u017f\u00bd\u00b2\ufb01...",
       "\x85a\x1cb", "it'll'll 12 345  \n\n", "word," * 40, "x" * 5000, "Caf\u00e9, caf\u00c9!? ok."]


@pytest.fixture(scope="module")
def wordfile():
    with open(WORDS, encoding="utf-8") as file:
        return file.read()


# -- packing -------------------------------------------------------------------------------------------

def test_chunk_ids_are_the_librarys(wordfile):
    own, library = ChunkIds(wordfile, memory=5), Tokenizer.from_file(WORDS)
    for _ in range(2):
        for text, ids in zip(ODD, own.of(ODD), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids


def least_bins(items, capacity):
    items, best = sorted(items, reverse=True), len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= capacity and bins[j] not in bins[:j]:
                bins[j] += items[i]
                go(i + 1, bins)
                bins[j] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


def test_bin_completion_is_optimal_on_small_tables():
    rnd, better = random.Random(3), 0
    for _ in range(150):
        capacity = rnd.choice([10, 20, 50, 100])
        items = [rnd.randint(max(1, capacity // 6), capacity * 2 // 3) for _ in range(rnd.randint(0, 11))]
        counts = Counter(items)
        found = pack_lengths(dict(counts), capacity)
        placed = Counter()
        for pieces, times in found:
            assert sum(s * n for s, n in pieces) <= capacity
            for size, n in pieces:
                placed[size] += n * times
        assert placed == counts
        n = sum(t for _, t in found)
        assert lower_bound(dict(counts), capacity) <= n == least_bins(items, capacity)
        better += n < sum(t for _, t in best_fit(dict(counts), capacity))
    assert better                                             # best fit alone is not


def test_packing_places_every_id(spark, wordfile):
    texts = [*ODD, "one two three " * 50, "same", "same"]
    rows = [(BIG + i if i != 1 else None, t, "x") for i, t in enumerate(texts)] + [(5, "same", "y"), (5, "same", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string").repartition(3)
    got = pack_documents(docs, wordfile, capacity=64).collect()
    library, wanted = Tokenizer.from_file(WORDS), Counter()
    for key, text, _ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 64)):
            own = np.array(ids[at:at + 64], "<u4")
            wanted[key, n, at, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == wanted
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        ends = 0
        for offset, length in sorted(pieces):
            assert offset == ends
            ends += length
        assert ends <= 64
    assert len(bins) == lower_bound(dict(Counter(r.length for r in got)), 64)
    assert pack_documents(docs.limit(0), wordfile).count() == 0


# -- conversations -------------------------------------------------------------------------------------

def test_edits_are_the_cheapest_and_first():
    rnd, faults = random.Random(1), [None, "truncated", "blank", "duplicate"]
    for _ in range(400):
        rows = [(rnd.choice(["system", "user", "assistant", "tool", ""]), "x", rnd.choices(faults, [5, 2, 1, 1])[0])
                for _ in range(rnd.randint(0, 9))]
        kinds = np.array([4 * ("sua".index(r[0]) if r[:1] and r[0] in "sua" else 3) + faults.index(f) for r, _, f in rows]
                         + [talk.END])
        one = np.array([len(kinds)])
        cost, audit, _ = brute.cheapest(rows)
        parts = np.diff([0, *sorted(rnd.sample(range(1, len(kinds)), min(2, len(kinds) - 1))), len(kinds)])
        both = talk.compose(talk.COST[kinds], talk.RANK[kinds], parts)       # blocks, and the blocks' product
        assert talk.compose(*both, np.array([len(parts)]))[0][0, 0, 0] == cost
        states = talk.crossings(*both, np.array([len(parts)]), [0], [0])
        edits = talk.audits(kinds, parts, states[:-1], states[1:])
        assert "".join(e for own in edits for e in own) == audit
        assert "".join(talk.audits(kinds, one, [0], [0])[0]) == audit


@pytest.mark.parametrize(("width", "fan"), [(1024, 256), (3, 2)])
def test_repair_equals_plain_version(spark, width, fan):
    rnd = random.Random(width)
    texts = ["Fine.", "Fine.", "cut off", "", " \t", "Why? Yes!", None, "a.b", "line\nbreak. "]
    rows = [(rnd.choice([1, 1, 1, 2, BIG, None]), rnd.choice([None, *range(40)]),
             rnd.choice(["system", "user", "assistant", "tool", None, ""]), rnd.choice(texts)) for _ in range(160)]
    rows = list({(r[0], r[1]): r for r in rows}.values()) + [(77, 2, "user", "Hi.")] * 3
    table = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, audit string")
    for damage, plain in ((talk.damaged, brute.damage), (as_is, lambda rows: [
            (c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])):
        found = {r[0]: tuple(r)[1:] for r in repair_conversations(table, width, fan, damage=damage).collect()}
        assert found == brute.repair(rows, plain)
    assert repair_conversations(table.limit(0)).count() == 0


# -- collocations --------------------------------------------------------------------------------------

def test_double_array_accepts_its_phrases_only():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    pairs = sorted({(rnd.choice(["de", "en", "a b"]), " ".join(rnd.choices(words, k=3))) for _ in range(900)})
    trie = DoubleArray([x for x, _ in pairs], [p for _, p in pairs])
    assert len(set(trie.accept.tolist())) == len(pairs) and len(trie.check) < 20 * len(pairs)

    def walk(lang, phrase):
        state = np.zeros(1, np.int64)
        for word in [lang.encode() + b".", *phrase.encode().split(b" ")]:
            state = trie.step(state, np.array([trie.symbols[word]]))
            if state[0] < 0:
                return None
        return state[0]

    ends = dict(zip(pairs, trie.accept.tolist(), strict=True))
    for lang in ("de", "en", "a b", "fr"):
        for _ in range(300):
            phrase = " ".join(rnd.choices(words, k=3))
            assert walk(lang, phrase) == ends.get((lang, phrase))
    assert all(walk(*pair) == state for pair, state in ends.items())


@pytest.mark.parametrize("shard", [100_000, 20])
def test_collocations_equal_plain_version(spark, shard):
    rnd = random.Random(9)
    words = ["A", "b", "the", "of", "\u00c9a", "x.y", "New", "York", "city"]
    docs = [(rnd.choice(["en", "de", None, ""]), " ".join(rnd.choices(words, [9, 5, 5, 5, 2, 1, 4, 4, 2], k=rnd.randint(0, 60)))
             + rnd.choice([".", "", "\n", "\t x; New York city!"])) for _ in range(120)]
    docs += [("en", None), ("en", ""), ("en", " \t\n.,"), ("xx", "once only")] + [("en", "la la la la la la")] * 12
    rows = spark.createDataFrame([(*d, 1) for d in docs], "lang string, text string, f int").repartition(5)
    got = sorted(tuple(r) for r in collocations(rows, support=10, top=30, shard_size=shard).collect())
    assert got == brute.phrases(docs, support=10, top=30) and len(got) > 40
    assert collocations(rows.limit(0)).count() == 0


# -- keys and letters ----------------------------------------------------------------------------------

def test_large_keys_beside_null_keys(spark):
    text = "some words that make a text of more than ten words in all, here they are."
    docs = spark.createDataFrame([(BIG, text), (None, text), (BIG + 2, text)], "doc_id long, text string").coalesce(1)
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    assert sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size()
    items = spark.createDataFrame([(7, text)], "item_id long, text string")
    for out in (token_counts(docs, model), quality_cascade(docs), jaccard_components(docs), find_overlaps(docs, items)):
        assert {r.doc_id for r in out.collect()} >= {BIG, BIG + 2} and out.schema["doc_id"].dataType.simpleString() == "bigint"


def test_number_signs_are_no_letters():
    assert letters("\u00bd \u00b2 \u2167 \u2460 7_") .strip() == "" and letters("\u00c9a1b") == " \u00e9a b "


# -- archives --------------------------------------------------------------------------------

def test_records_survive_a_change_of_cores(spark, tmp_path):
    """Files are planned with many cores and collected with few: no record is lost."""
    pages = [(i, "http://a/", f"{i} " + "x" * 2000 + warc.MAGIC + "y" * 2000) for i in range(400)]
    name = "spark.sql.leafNodeDefaultParallelism"
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1000")
        spark.conf.set(name, "8")
        warc.write_archive(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2),
                           str(tmp_path / "cores"))
        found = warc.read_archive(spark, str(tmp_path / "cores"))
        spark.conf.set(name, "3")
        rows = found.collect()
    finally:
        spark.conf.unset(name)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert len(rows) == len(pages) and all(r["digest_ok"] for r in rows)
