"""The dealt operators against plain versions, held-out rows and awkward inputs."""

import crc32_folds
import llm_brute as brute
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultsift.llm import queries as Q
from faultsift.llm import warc
from faultsift.llm.decontamination import find_overlaps
from faultsift.llm.jaccard import jaccard_components
from faultsift.llm.language import fit_filter, predict_language
from faultsift.llm.lines import dedup_lines
from faultsift.llm.mixing import mix_sources
from faultsift.llm.quality import quality_cascade
from faultsift.llm.tokens import token_counts
from faultsift.llm.toxicity import fit_chain, score_toxicity
from faultsift.llm.urls import filter_urls

SMALL, MIDDLE, LARGER = (f"/root/testdata/sf{sf}" for sf in ("0.001", "0.01", "0.1"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 7919}" for i in range(60_000))
PASSAGE = "\n".join(f"line {i} of a passage that is found in more than one text" for i in range(6))
#: Nulls everywhere, empty and blank texts, ties, a repeated row, a very long text twice.
ROWS = [(1, None, None, None, None), (2, "", "en", "web", 0), (3, " \n\t", "en", None, 3),
        (4, "one two three", "en", "web", 13), (5, "one two three", "fr", "web", 13),
        (6, LONG, "en", "books", len(LONG)), (7, LONG + " more", None, "books", 1),
        (None, "a text without an id but with words in it", "en", "web", 41),
        (8, "the same row twice " * 3, "en", "web", 57), (8, "the same row twice " * 3, "en", "web", 57),
        (9, PASSAGE, "en", "web", 1), (10, "before\n" + PASSAGE + "\nafter", "en", "books", 1)]
#: Names that the operators use for themselves.
CLASHING = ["id", "doc", "n", "size", "target", "component", "node", "rank", "seq", "lines", "score", "print", "key",
            "pos", "copies", "n_words", "n_lines", "item_id", "url", "lang_pred", "kept", "spans", "label", "_key"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    return rows.withColumns({name: F.lit("clash") for name in CLASHING})


@pytest.fixture(scope="module")
def model():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


def read(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pairs(spark, folder):
    rows = read(spark, folder, "documents").select("doc_id", "text").collect()
    return [(r[0], r[1]) for r in rows]


def by_key(df, key="doc_id"):
    rows = df.collect()
    out = {r[key]: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_overlaps_are_those_of_brute_force(spark):
    items = [(r["item_id"], r["text"]) for r in read(spark, SMALL, "benchmark").collect()]
    wanted = brute.overlaps(pairs(spark, SMALL), items)
    found = {(r["doc_id"], r["item_id"]): r["n_matches"] for r in Q.op1_spaced_seeds(spark, SMALL).collect()}
    assert found and set(found) <= set(wanted)
    assert len(set(found) & set(wanted)) >= 0.99 * len(wanted)


def test_overlap_survives_substitutions(spark, docs):
    item = "which of these rivers runs through the largest number of countries in all of europe today".split()
    changed = [w if i % 5 != 4 else "other" for i, w in enumerate(item)]
    rows = spark.createDataFrame([(1, "before " + " ".join(item) + " after"), (2, "x " + " ".join(changed)),
                                  (3, " ".join(reversed(item))), (4, None), (5, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (None, " ".join(item)), (2, None), (3, "too short")],
                                  "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in find_overlaps(rows, items).collect()} == {(1, 1), (2, 1)}
    assert find_overlaps(rows.limit(0), items).count() == 0
    assert find_overlaps(rows, items.limit(0)).count() == 0
    assert find_overlaps(docs, items).count() == 0


def test_toxicity_of_held_out_rows(spark):
    out = Q.op2_toxicity_chain(spark, LARGER).toPandas()
    assert out["score"].between(0, 1).all() and ((out["score"] >= 0.7) == (out["predicted"] == 1)).all()
    assert [crc32_folds.fold(i, 3) == 1 for i in out["doc_id"]] == list(out["held_out"])
    labels = read(spark, LARGER, "labels").toPandas()
    held = out[out["held_out"]].merge(labels, on="doc_id").dropna(subset=["toxic"])
    toxic, clean = held[held["toxic"] == 1]["score"], held[held["toxic"] == 0]["score"]
    ranks = pd.concat([toxic, clean]).rank()
    auc = (ranks.iloc[:len(toxic)].sum() - len(toxic) * (len(toxic) + 1) / 2) / (len(toxic) * len(clean))
    assert auc >= 0.9


def test_toxicity_of_awkward_rows(spark, docs):
    labels = spark.createDataFrame([(4, 1), (9, 0), (99, 1), (None, 1), (6, None)], "doc_id long, toxic int")
    out = score_toxicity(docs, fit_chain(docs, labels)).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)
    chain = fit_chain(docs, labels.limit(0))
    assert score_toxicity(docs.limit(0), chain).count() == 0


def test_quality_counts(spark, docs):
    text = "a b c d e f\na b c d e f\n# $ x\n\n"
    out = quality_cascade(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (out["n_words"], out["word_chars"], out["n_symbols"], out["n_dup_lines"], out["n_repeat_words"]) == (
        15, 15, 2, 1, 12)
    assert out["base_failed"] and not out["kept"]
    rows = quality_cascade(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(r["base_failed"] and not r["kept"] and r["n_words"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    assert quality_cascade(docs.limit(0)).count() == 0


def test_language_of_held_out_rows(spark):
    out = Q.op4_language_filters(spark, MIDDLE).toPandas()
    true = read(spark, MIDDLE, "documents").select("doc_id", "lang", "text").toPandas().dropna()
    held = out[out["held_out"]].merge(true, on="doc_id")
    held = held[held["lang_pred"] != "und"]
    assert [crc32_folds.fold(i, 5) == 0 for i in out["doc_id"]] == list(out["held_out"])
    assert (held["lang"] == held["lang_pred"]).mean() >= 0.9


def test_language_of_awkward_rows(spark, docs):
    model = fit_filter(docs)
    out = predict_language(docs, model).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)
    assert {r["lang_pred"] for r in out if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert predict_language(docs.limit(0), model).count() == 0
    unlearned = fit_filter(docs.limit(0))
    assert {r["lang_pred"] for r in predict_language(docs, unlearned).collect()} == {"und"}


def test_line_runs_are_those_of_brute_force(spark):
    found = by_key(Q.op5_line_runs(spark, SMALL))
    wanted = brute.line_runs(pairs(spark, SMALL))
    assert {i: (r["text"], r["n_deleted"]) for i, r in found.items()} == wanted


def test_line_runs_of_awkward_rows(spark, docs):
    out = dedup_lines(docs)
    assert set(out.columns) == {*docs.columns, "n_deleted"}
    rows = {}
    for r in out.collect():
        rows.setdefault(r["doc_id"], []).append((r["text"], r["doc"]))
    assert sum(map(len, rows.values())) == len(ROWS)
    assert rows[1] == [(None, "clash")] and rows[2][0][0] == ""
    assert rows[9][0][0] == PASSAGE and rows[10][0][0] == "before\nafter"
    assert len(set(rows[8])) == 1
    assert dedup_lines(docs.limit(0)).count() == 0


def test_archives_with_magic_in_payloads(spark, tmp_path):
    record = warc.MAGIC + "WARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    kinds = ["a" + warc.MAGIC + "b", warc.MAGIC, record * 3, None, "", "é\r\n\r\nx",
             "x" * 3000 + warc.MAGIC + "Content-Length: 0\r\n\r\n\r\n\r\n" + "y" * 3000, "plain"]
    pages = [(i, kinds[i % 8] if i % 16 < 8 else f"{kinds[i % 8]}{i}") for i in range(240)]
    rows = spark.createDataFrame([(i, f"http://a/\r\n{warc.MAGIC}", p) for i, p in pages],
                                 "page_id long, url string, html string").withColumn("_digest_", F.lit(1))
    sizes = {"spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "1k"}
    before = {name: spark.conf.get(name) for name in sizes}
    for name, value in sizes.items():
        spark.conf.set(name, value)                      # records lie across the splits of a file
    try:
        warc.write_archive(rows.coalesce(2), str(tmp_path / "warc"))
        found = warc.read_archive(spark, str(tmp_path / "warc")).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    number = lambda s: int(s[len("<urn:page:"):-1]) if s else None
    assert all(r["digest_ok"] for r in found) and len(found) == len(pages)
    assert {number(r["record_id"]): (r["payload_bytes"], r["payload_digest"], r["record_type"],
                                     number(r["refers_to"])) for r in found} == brute.archive(pages)


def test_archive_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archive(none, str(tmp_path / "none"))
    assert warc.read_archive(spark, str(tmp_path / "none")).count() == 0


def test_jaccard_is_that_of_brute_force(spark):
    found = {i: (r["n_shingles"], r["component_id"]) for i, r in by_key(Q.op7_size_aware_jaccard(spark, SMALL)).items()}
    assert found == brute.jaccard(pairs(spark, SMALL))


def test_jaccard_of_copies_that_differ_here_and_there(spark):
    import random
    draw, rows = random.Random(3), []
    for family in range(24):
        size = draw.choice([6, 9, 14, 30, 60, 90, 150, 400])
        base = [f"w{draw.randrange(300)}" for _ in range(size)] + [f"common{i}" for i in range(size // 3)]
        for _ in range(12):
            words = list(base)
            for _ in range(draw.randrange(1 + size // 12)):
                words[draw.randrange(len(words))] = f"w{draw.randrange(300)}"
            rows.append((len(rows) * 7 % 1009, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = brute.jaccard(rows)
    for heavy in (1, 16):
        found = {i: (r["n_shingles"], r["component_id"]) for i, r in by_key(jaccard_components(docs, heavy)).items()}
        assert found == wanted


def test_jaccard_of_awkward_rows(spark, docs):
    rows = jaccard_components(docs).collect()
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert len(rows) == len(ROWS)
    assert found[1] == (0, 1) and found[2] == (0, 2) and found[3] == (0, 3)
    assert found[4] == found[5] == (1, 4) and found[7][1] == 6 and found[None][1] is None
    assert jaccard_components(docs.limit(0)).count() == 0


def test_mix_meets_its_targets(spark):
    out = Q.op8_mix_sources(spark, MIDDLE).toPandas()
    again = Q.op8_mix_sources(spark, MIDDLE).toPandas()
    order = lambda df: df.sort_values("doc_id").reset_index(drop=True)
    assert order(out).equals(order(again))
    assert (out["taken"] <= 3 * out["size"]).all()
    sums = out.groupby("source", dropna=False).agg(
        size=("size", "sum"), largest=("size", "max"), told=("source_size", "first"),
        target=("target", "first"), taken=("taken", "sum"))
    assert (sums["size"] == sums["told"]).all()
    assert ((sums["taken"] - sums["target"]).abs() <= 0.01 * sums["target"] + sums["largest"]).all()
    assert abs(sums["target"].sum() - sums["size"].sum()) < 1e-6 * sums["size"].sum()


def test_mix_of_awkward_rows(spark, docs):
    out = mix_sources(docs).collect()
    assert len(out) == len(ROWS)
    assert all(r["taken"] == 0 for r in out if r["doc_id"] in (1, 2, 3))
    assert mix_sources(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("url", "host", "path", "rule"), [
    ("https://WWW.Example.com/en/a?b#c", "www.example.com", "/en/a", "www.example.com/en/"),
    ("http://a.example.com/en/", "a.example.com", "/en/", "example.com/en/"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/"),
    ("http://x.net/es/q", "x.net", "/es/q", "net/es/"), ("http://x.net", "x.net", "", None),
    ("x.net/es/", "", "", None), (None, "", "", None), ("a://b.com?x/://c", "b.com", "", None)])
def test_url_rules(spark, url, host, path, rule):
    rows = spark.createDataFrame([(1, url)], "page_id long, url string")
    found = filter_urls(rows, Q.URL_RULES).first()
    assert (found["host"], found["path"], found["rule"]) == (host, path, rule)
    assert found["verdict"] in ("allow", "block")


def test_url_trees_learn_from_labels(spark):
    rows = [(i, f"http://{'bad-ads' if i % 2 else 'good'}{i}.{'biz' if i % 2 else 'org'}/p{i}?a={i}") for i in range(400)]
    pages = spark.createDataFrame([*rows, (None, None), (5, rows[5][1])], "page_id long, url string").withColumns(
        {name: F.lit("clash") for name in ("host", "path", "rule", "verdict", "_url", "_label", "depth")})
    labels = spark.createDataFrame([(u, "block" if i % 2 else "allow") for i, u in rows[:300]], "url string, verdict string")
    out = filter_urls(pages, [], labels).collect()
    assert len(out) == 402
    unseen = [r for r in out if r["page_id"] is not None and r["page_id"] >= 300]
    assert sum((r["verdict"] == "block") == (r["page_id"] % 2 == 1) for r in unseen) >= 0.95 * len(unseen)
    assert filter_urls(pages.limit(0), Q.URL_RULES).count() == 0


def test_tokens_are_those_of_the_library(spark, docs, model):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = [*(t for _, t in pairs(spark, SMALL)), *(r[1] for r in ROWS), "  two  spaces ", "<s> </s> <unk>", "▁ ▁x",
             "a\u00a0b\u3000c", "日本語 テキスト", "\x00\t\r\n", "e\u0301 ﬁ", "x" * 5000, "é" * 3000 + " " * 50 + "end"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = by_key(token_counts(rows, model))
    for i, text in enumerate(texts):
        n = len(library.encode(text or ""))
        assert (found[i]["n_tokens"], found[i]["n_bytes"], found[i]["over_limit"]) == (
            n, len((text or "").encode()), n > 4096)
    assert token_counts(docs, model).count() == len(ROWS)
    assert token_counts(docs.limit(0), model).count() == 0
