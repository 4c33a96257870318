"""Searches and clusters against brute force on small random data."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultsift.operators import clusters, components, similarity
from faultsift.operators.tfidf import distinct_messages, term_vectors
from faultsift.plans.predict import predict_messages

STOP = ["the"]


def messages(n, seed, variants=6):
    """Random short texts; many are near copies of a few, some equal, some without terms."""
    rng = random.Random(seed)
    vocabulary = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    seeds = [[rng.choice(vocabulary) for _ in range(8)] for _ in range(variants)]
    texts = []
    for i in range(n):
        kind = rng.random()
        words = list(rng.choice(seeds))
        if kind < 0.5:
            words[rng.randrange(8)] = rng.choice(vocabulary)
        elif kind < 0.8:
            words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 8))]
        elif kind < 0.85:
            words = ["the", "7"]
        texts.append(" ".join(words))
    return texts


def matrix(texts):
    docs = [[w for w in t.split() if len(w) >= 2 and w not in STOP and not w.isdigit()]
            for t in texts]
    terms = sorted({w for d in docs for w in d})
    df = {w: sum(w in d for d in docs) for w in terms}
    out = np.zeros((len(docs), len(terms)))
    for i, d in enumerate(docs):
        for w in d:
            out[i, terms.index(w)] += math.log((1 + len(docs)) / (1 + df[w])) + 1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "ord BIGINT, text STRING")


def flood(near):
    """Cluster numbers of the graph by first row, -1 for rows without a neighbour."""
    n, label, labels = len(near), 0, [-1] * len(near)
    for i in range(n):
        if labels[i] == -1 and any(near[i][j] for j in range(n) if j != i):
            stack = [i]
            while stack:
                k = stack.pop()
                if labels[k] == -1:
                    labels[k] = label
                    stack += [j for j in range(n) if near[k][j] and j != k]
            label += 1
    return labels


@pytest.mark.parametrize("seed, eps, long_list", [(1, 0.3, 2000), (3, 0.5, 2)])
def test_dbscan(spark, monkeypatch, seed, eps, long_list):
    monkeypatch.setattr(similarity, "LONG_LIST", long_list)
    texts = messages(90, seed)
    vectors = matrix(texts)
    expected = flood(np.round(vectors @ vectors.T, 12) >= 1 - eps)
    got = clusters.dbscan_messages(frame(spark, texts), "ord", "text", eps, STOP).collect()
    assert [r["ClusterId"] for r in sorted(got, key=lambda r: r["ord"])] == expected


def brute_linkage(vectors, cut):
    groups = [[i] for i in range(len(vectors))]
    while True:
        best = (0, 0, cut)
        for a in range(len(groups)):
            for b in range(a + 1, len(groups)):
                d = 1 - np.mean(vectors[groups[a]] @ vectors[groups[b]].T)
                if d < best[2] - 1e-9:
                    best = (a, b, d)
        if best[0] == best[1]:
            return sorted(sorted(g) for g in groups)
        groups[best[0]] += groups.pop(best[1])


@pytest.mark.parametrize("seed, block_rows", [(4, 512), (5, 5)])
def test_average_linkage(spark, seed, block_rows):
    """Inside one task, and in rounds over small blocks."""
    texts = messages(70, seed, variants=3)
    expected = brute_linkage(matrix(texts), 0.45)
    # rows without a vector are at distance 1 from everything, but equal ones stay together
    got = clusters.average_linkage_messages(
        frame(spark, texts), "ord", "text", 0.45, STOP, block_rows=block_rows).collect()
    groups = {}
    for row in got:
        groups.setdefault(row["ClusterId"], []).append(row["ord"])
    empty = {i for i, t in enumerate(texts) if t == "the 7"}
    strip = lambda gs: sorted(g for g in (sorted(set(g) - empty) for g in gs) if g)
    assert strip(groups.values()) == strip(expected)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)]
    edges += [(i, i + 1) for i in range(300, 340)] + [(500, 500 + i) for i in range(1, 60)]
    edges = [(a, b) for a, b in edges if a != b]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = components.connected_components(
        spark.createDataFrame(edges, "x BIGINT, y BIGINT"), "x", "y").collect()
    assert {r["node"]: r["component"] for r in got} == {x: find(x) for x in root}
    assert len(got) == len(root)
    assert components.connected_components(
        spark.createDataFrame([], "x BIGINT, y BIGINT"), "x", "y").count() == 0


def vectors_of(n, seed, dims=5):
    rng = np.random.default_rng(seed)
    out = rng.normal(size=(n, dims))
    out[n // 2:n // 2 + 10] = out[0]                    # equal vectors: ties
    out[n - 1] = 0
    return out


def vector_frame(spark, vectors):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id BIGINT, v ARRAY<DOUBLE>")


def unit(vectors):
    return similarity.unit_rows(list(vectors))


@pytest.mark.parametrize("options", [{}, {"broadcast_values": 0, "block_rows": 7}])
def test_nearest_anchor(spark, options):
    targets, anchors = vectors_of(40, 1), vectors_of(30, 2)
    anchors[20] = targets[3]
    scores = np.round(unit(targets) @ unit(anchors).T, 12)
    got = similarity.nearest_anchor(
        vector_frame(spark, targets), vector_frame(spark, anchors), "id", "v", "id", **options)
    assert {r["id"]: r["anchor"] for r in got.collect()} == dict(enumerate(scores.argmax(axis=1)))
    none = vector_frame(spark, anchors).limit(0)
    assert similarity.nearest_anchor(
        vector_frame(spark, targets), none, "id", "v", "id", **options).count() == 0


@pytest.mark.parametrize("block_rows", [4096, 9])
def test_dense_neighbours(spark, block_rows):
    vectors = vectors_of(60, 4)
    near = np.round(unit(vectors) @ unit(vectors).T, 12) >= 1 - 0.2
    np.fill_diagonal(near, False)
    rows = vector_frame(spark, vectors)
    got = similarity.neighbour_counts(rows, "id", "v", 0.2, block_rows).collect()
    assert {r["id"]: r["n_neighbors"] for r in got} == dict(enumerate(near.sum(axis=1)))
    parts = {r["node"]: r["component"] for r in similarity.dense_components(
        rows, "id", "v", 0.2, block_rows).collect()}
    labels = flood(near)
    first = {label: labels.index(label) for label in set(labels) if label >= 0}
    assert parts == {i: first[label] for i, label in enumerate(labels) if label >= 0}


@pytest.mark.parametrize("block_rows", [512, 3])
def test_best_partner_blocks(spark, block_rows):
    texts = messages(60, 8)
    distinct = distinct_messages(frame(spark, texts), "ord", "text")
    postings = term_vectors(distinct, "id", "Normalized", STOP)
    ids = sorted(r["id"] for r in distinct.collect())
    vectors = matrix(texts)[ids]
    scores = np.round(vectors @ vectors.T, 12)
    np.fill_diagonal(scores, -1)
    expected = {ids[i]: ids[scores[i].argmax()] for i in range(len(ids)) if scores[i].max() >= 0.4}
    groups = similarity.similar_components(postings, 0.4)
    rows = similarity.as_vectors(postings).join(groups, F.col("id") == F.col("node")).select(
        "id", "terms", "weights", F.col("component").alias("grp"), F.col("id").alias("rank"),
        F.lit(True).alias("left"), F.lit(True).alias("right"))
    got = similarity.best_partner(rows, 0.4, block_rows=block_rows).collect()
    assert {r["id"]: r["partner"] for r in got} == expected


def prediction_rows(spark, rows):
    return spark.createDataFrame(
        [(i, f"t{i}", "o", text, item is not None, "r", item or "N/A")
         for i, (text, item) in enumerate(rows)],
        "ord BIGINT, TestName STRING, Owner STRING, Message STRING, HasInvestigation BOOLEAN, "
        "InvestigationReport STRING, WorkItemId STRING")


def predicted(df):
    return {r["ord"]: r["PredictedWorkItemId"] for r in df.collect()}


def test_predict(spark):
    rows = [("mesh step failed badly", "11"), ("mesh step 4 failed badly", None),
            ("mesh step failed badly", "12"), ("something else entirely", None), ("the", None),
            ("licence server gone", ""), ("licence server gone", None)]
    got = predicted(predict_messages(prediction_rows(spark, rows), 0.3, stop_words=STOP))
    assert got == {0: "11", 1: "11", 2: "12", 3: "-", 4: "-", 5: "N/A", 6: "N/A"}
    none = [(text, None) for text, _ in rows]
    assert predict_messages(prediction_rows(spark, none), 0.3, stop_words=STOP).count() == 0


def test_predict_with_encoder(spark):
    def encoder(df):
        return df.withColumn("vector", F.array(
            F.length("Message").cast("float"), F.lit(1.0).cast("float")))

    rows = [("a", "1"), ("a" * 50, "2"), ("b", None), ("b" * 49, None), ("", None)]
    got = predicted(predict_messages(prediction_rows(spark, rows), 0.01, encoder=encoder))
    assert got == {0: "1", 1: "2", 2: "1", 3: "2", 4: "-"}
