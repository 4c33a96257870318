"""The stages of the pipeline, each against a plain version on what its predecessor kept."""

import llm_brute as brute
import pytest

import corpus_pipeline as pipeline
from faultsift.llm.mixing import mix_sources

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Input and output of every stage, on real documents and a few planted ones."""
    real = spark.read.parquet(f"{FOLDER}/documents.parquet")
    item = next(r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()
                if len(r["text"].split()) >= 15)
    model = real.where("lang is not null and n_chars > 400").orderBy("doc_id").first()
    row = model.asDict()
    planted = [row | {"doc_id": 10**9, "text": None}, row | {"doc_id": 10**9 + 1, "text": "12345 67 !!"},
               row | {"doc_id": 10**9 + 2, "text": row["text"] + "\n" + item}]
    docs = real.unionByName(spark.createDataFrame(planted, real.schema))
    out = {}
    for name, stage in pipeline.STAGES:
        done, path = stage(spark, docs, FOLDER), str(tmp_path_factory.mktemp("stage") / "rows")
        done.write.parquet(path)
        out[name] = docs, spark.read.parquet(path)
        docs = out[name][1]
    return out


def test_filters_return_the_columns_of_documents(steps):
    for name, (before, after) in steps.items():
        if name != "mixing":
            assert after.columns == before.columns


def test_language_id_rejects_what_has_no_language(steps):
    before, after = (texts(df) for df in steps["language ID"])
    assert 10**9 in before and 10**9 not in after and 10**9 + 1 not in after
    lost = [i for i in set(before) - set(after) if i < 10**9 and any(c.isalpha() for c in before[i] or "")]
    assert len(lost) <= 0.05 * len(before)


def test_line_dedup_is_that_of_brute_force(steps):
    before, after = (texts(df) for df in steps["line dedup"])
    wanted = {i: t for i, (t, n) in brute.line_runs(sorted(before.items())).items() if n == 0 or t.split()}
    assert after == wanted


def test_near_duplicates_are_those_of_brute_force(steps):
    before, after = (texts(df) for df in steps["n-gram Jaccard join"])
    wanted = brute.jaccard(before.items())
    assert set(after) == {i for i, (_, component) in wanted.items() if component == i}


def test_decontamination_is_that_of_brute_force(spark, steps):
    before, after = (texts(df) for df in steps["benchmark decontamination"])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert set(before) - set(after) == {i for i, _ in brute.overlaps(before.items(), items)}


def test_mixing_takes_from_all_that_is_left(steps):
    before, after = steps["mixing"]
    assert texts_of(after) == texts_of(mix_sources(before).where("copies > 0"))


def texts_of(df):
    return sorted((r["doc_id"], r["size"], r["copies"]) for r in df.collect())


def test_stages_on_awkward_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "web", 0), (3, "one two three", "en", None, 13),
            (3, "one two three", "en", None, 13), (None, "some words in a text", "en", "web", 20)]
    for docs in (spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)):
        for _, stage in pipeline.STAGES:
            assert stage(spark, docs, FOLDER).count() <= len(rows)
