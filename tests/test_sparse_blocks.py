"""Similar sparse rows over many small blocks, and what is written on the way."""

import random

import numpy as np
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F
from test_similarity import STOP, flood, frame, matrix, messages

from faultsift import session
from faultsift.operators import clusters, similarity, sparse_blocks
from faultsift.operators.tfidf import count_vectors, distinct_messages, term_counts, term_vectors


@pytest.mark.parametrize("block_postings, tile_rows", [(8_000_000, 4_000_000), (40, 3)])
def test_blocks_against_all_pairs(spark, block_postings, tile_rows):
    texts = messages(80, 11)
    distinct = distinct_messages(frame(spark, texts), "ord", "text")
    vectors = similarity.as_vectors(term_vectors(distinct, "id", "Normalized", STOP))
    ids = sorted(r["id"] for r in vectors.select("id").collect())
    scores = np.round(matrix(texts)[ids] @ matrix(texts)[ids].T, 12)
    options = {"block_postings": block_postings, "tile_rows": tile_rows}

    best = sparse_blocks.best_rows(vectors.where("id % 2 = 0"), vectors.where("id % 2 = 1"), 0.4, **options)
    even, odd = ([k for k, i in enumerate(ids) if i % 2 == part] for part in (0, 1))
    table = scores[np.ix_(even, odd)]
    assert {r["id"]: r["partner"] for r in best.collect()} == {
        ids[k]: ids[odd[row.argmax()]] for k, row in zip(even, table) if row.max() >= 0.4}

    edges = [(r["a"], r["b"]) for r in sparse_blocks.linked_rows(vectors, 0.4, **options).collect()]
    linked = np.eye(len(ids), dtype=bool)
    for a, b in edges:
        linked[ids.index(a), ids.index(b)] = linked[ids.index(b), ids.index(a)] = True
    near = scores >= 0.4
    closure = [np.linalg.matrix_power(x.astype(float) + np.eye(len(ids)), len(ids)) > 0 for x in (linked, near)]
    assert (closure[0] == closure[1]).all()


def test_pairs_stay_in_their_task(spark, monkeypatch, tmp_path):
    """Most pairs share a word and hardly any is similar: no step writes a row per pair."""
    rng, n = random.Random(5), 300
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    texts = [" ".join(rng.sample(words, 8)) for _ in range(n)]
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    found = clusters.dbscan_messages(frame(spark, texts), "ord", "text", 0.3, STOP).collect()
    near = np.round(matrix(texts) @ matrix(texts).T, 12) >= 0.7
    assert [r["ClusterId"] for r in sorted(found, key=lambda r: r["ord"])] == flood(near)
    written = [ds.dataset(str(step), format="parquet").count_rows() for step in tmp_path.iterdir()]
    assert len(written) > 3 and max(written) <= 8 * n          # one row per word of a text


def test_dense_copies_do_not_follow_the_rows(spark):
    """Smaller blocks beyond a fixed grid would copy every row more often."""
    rows = spark.range(400).select("id", F.array(F.rand(1), F.rand(2), F.rand(3)).alias("v"))
    copies = similarity._block_pairs(rows, "id", "v", 2).count()
    assert copies <= 400 * (similarity.GRID + 1)


def test_words_are_not_shuffled(spark):
    counts = term_counts(frame(spark, messages(20, 3)), "ord", "text", STOP)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "hashpartitioning(ord" in plan.replace("#", "")


@pytest.mark.parametrize("block_postings", [8_000_000, 40])
def test_counts_make_the_same_vectors(spark, block_postings):
    distinct = distinct_messages(frame(spark, messages(60, 4)), "ord", "text")
    postings = term_vectors(distinct, "id", "Normalized", STOP)
    counted, idf = count_vectors(distinct, "id", "Normalized", STOP)
    expected = {r["id"]: dict(zip(r["terms"], r["weights"])) for r in similarity.as_vectors(postings).collect()}
    made = {r["id"]: dict(zip(r["terms"], r["weights"])) for r in sparse_blocks.weighed(counted, idf).collect()}
    assert made.keys() == expected.keys() and all(made[i] == pytest.approx(expected[i]) for i in made)
    got = sparse_blocks.best_rows(counted, counted, 0.4, allow_self=False, block_postings=block_postings, idf=idf)
    assert {(r["id"], r["neighbor"], round(r["score"], 9)) for r in similarity.nearest_within(postings, 0.4).collect()} \
        == {(r["id"], r["partner"], round(r["score"], 9)) for r in got.collect()}


def test_terms_are_written_once(spark, monkeypatch, tmp_path):
    rng, n = random.Random(6), 200
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    texts = [" ".join(rng.sample(words, 8)) for _ in range(n)]
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    clusters.dbscan_messages(frame(spark, texts), "ord", "text", 0.3, STOP).collect()
    written = [ds.dataset(str(step), format="parquet").count_rows() for step in tmp_path.iterdir()]
    assert sum(rows > 4 * n for rows in written) == 1


def test_large_groups_are_linked_part_by_part(spark, monkeypatch):
    """A round for each merge of a group that is too large for a task would take many."""
    base = [f"p{chr(97 + i)}" for i in range(20)]
    texts = [" ".join([*(f"f{'abc'[k]}{w}" for w in base), *base, f"u{'abc'[k]}{'abcde'[j]}"])
             for k in range(3) for j in range(5)]
    rounds = []
    search = clusters.best_partner
    monkeypatch.setattr(clusters, "best_partner", lambda *a, **b: rounds.append(1) or search(*a, **b))
    found = [clusters.average_linkage_messages(frame(spark, texts), "ord", "text", cut, STOP, rows)
             for cut, rows in ((0.9, 6), (0.9, 4096))]
    assert len(rounds) == 1
    assert sorted(map(tuple, found[0].collect())) == sorted(map(tuple, found[1].collect()))


def test_dense_density_goes_tile_by_tile(spark, monkeypatch):
    monkeypatch.setattr(clusters, "block_copies", None)       # copies there grow with the rows
    rows = spark.createDataFrame([(i, [1.0, 0.1 * (i % 3)] if i < 6 else [0.0, float(i - 5)] if i < 8 else [0.0, 0.0])
                                  for i in range(9)], "k long, v array<double>")
    got = {r["k"]: r["ClusterId"] for r in clusters.dbscan_vectors(rows, "k", "v", 0.05, 3).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: -1, 7: -1, 8: -1}


def test_blocks_meet_without_copies(spark):
    """A row was shuffled once per block it met, which grows with the square of the table."""
    distinct = distinct_messages(frame(spark, messages(60, 4)), "ord", "text")
    counted, idf = count_vectors(distinct, "id", "Normalized", STOP)
    blocks = sparse_blocks.packed(counted, True, 40)
    assert blocks.count() > 6 and blocks.agg(F.sum(F.length("ids"))).first()[0] == 8 * counted.count()
    found = sparse_blocks.linked_rows(counted, 0.4, block_postings=40, idf=idf)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
