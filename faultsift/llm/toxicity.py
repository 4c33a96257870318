"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are given for documents. Token labels are derived from them: a word is toxic where far more
toxic than clean documents hold it, and its tokens in toxic documents are labelled 1. The chain has
two states; it is fitted by gradient on a bounded sample of windows of labelled tokens. Over the
corpus, exact forward-backward marginals of every token are aggregated to a document score, and
tokens with a marginal of one half or more give the offending offsets.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import as_text, blocks, encoded, stratified_sample, words_column

_TRIM = b".,;:!?\"'()[]{}*#%&$|<>-_"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHAPES = 4
WINDOW = 64


def normal(word: bytes) -> bytes:
    return word.strip(_TRIM).lower()


def shape(word: bytes) -> int:
    """Plain, upper case, with digits, or without letters."""
    if word.isalpha():
        return 1 if len(word) > 1 and word.isupper() else 0
    return 2 if any(48 <= c < 58 for c in word) else 3


def weak_words(sample: DataFrame, least_docs: int, least_odds: float, least_z: float = 2.8) -> list[str]:
    """Words that toxic documents hold far more often than clean ones, by odds and beyond chance.

    Documents count once for each different content, told by the least hash of their words, so a
    family of copies with one label does not teach its words. The result is bounded by the sample."""
    words = F.transform(words_column("_text"), lambda w: F.regexp_replace(
        F.lower(w), "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$", ""))
    docs = sample.select("_toxic", F.array_distinct(words).alias("words")).withColumn(
        "family", F.array_min(F.transform("words", lambda w: F.xxhash64(w)))).where(F.col("family").isNotNull())
    sizes = {r[0]: r[1] for r in docs.groupBy("_toxic").agg(F.countDistinct("family")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    counted = docs.select("_toxic", "family", F.explode("words").alias("word")).groupBy("word").agg(
        F.countDistinct(F.when(F.col("_toxic") == 1, F.col("family"))).alias("t"),
        F.countDistinct(F.when(F.col("_toxic") == 0, F.col("family"))).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    share = toxic / max(toxic + clean, 1)
    total = F.col("t") + F.col("c")
    beyond = F.col("t") - total * share >= least_z * F.sqrt(total * share * (1 - share))
    found = counted.where(
        (F.col("t") >= least_docs) & (odds >= least_odds) & beyond & (F.col("word") != ""))
    return sorted(r["word"] for r in found.select("word").collect())


@dataclass
class Chain:
    """Log weights of state 1 against state 0, and the odds of the transitions."""
    weights: dict[bytes, float]
    shapes: np.ndarray
    bias: float
    moves: np.ndarray                     # log weights, from row to column
    score: np.ndarray                     # intercept, log of expected toxic tokens, largest marginal

    def emissions(self, words: list[bytes]) -> np.ndarray:
        own = np.fromiter((self.weights.get(normal(w), 0.0) for w in words), float, len(words))
        seen = own != 0
        if seen.any():
            own[seen] += self.shapes[[shape(words[i]) for i in np.flatnonzero(seen)]]
        return np.exp(np.clip(own + self.bias, -30, 30))

    def marginals(self, words: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """P(toxic) of every token of texts laid end to end."""
        if not len(words):
            return np.zeros(0)
        odds, first = self.emissions(words), np.zeros(len(words), bool)
        ends = np.cumsum(sizes[sizes > 0])
        first[np.concatenate([[0], ends[:-1]])] = True
        last = np.zeros(len(words), bool)
        last[ends - 1] = True
        m = np.exp(self.moves)
        # forward odds: r = e * (m01 + m11 r) / (m00 + m10 r), and e where a text starts
        forward = _scan(
            np.where(first, 0, odds * m[1, 1]), np.where(first, odds, odds * m[0, 1]),
            np.where(first, 0, m[1, 0]), np.where(first, 1, m[0, 0]))
        # backward odds: q = (m10 + m11 e q) / (m00 + m01 e q) of the next token, and 1 at the end
        after = np.append(odds[1:], 1.0)
        backward = _scan(
            np.where(last, 0, m[1, 1] * after)[::-1], np.where(last, 1, m[1, 0])[::-1],
            np.where(last, 0, m[0, 1] * after)[::-1], np.where(last, 1, m[0, 0])[::-1])[::-1]
        both = forward * backward
        return both / (1 + both)

    def documents(self, marginal: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Features of the document score: log of the expected toxic tokens, largest marginal."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        likely = np.where(marginal >= 0.5, marginal, 0)
        most = np.zeros(len(sizes))
        np.maximum.at(most, owner, marginal)
        return np.stack([np.log1p(np.bincount(owner, likely, minlength=len(sizes))), most], axis=1)

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.score[0] + features @ self.score[1:], -30, 30)))


def _scan(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """All values of x = (a x + b) / (c x + d), step by step from x = 1.

    Exact in blocks: the steps of each block are composed for all blocks at once, the blocks are
    entered one after the other, and then all blocks are walked at once."""
    n = len(a)
    width = max(1, int(np.sqrt(n)))
    n_blocks = -(-n // width)
    steps = np.zeros((4, n_blocks * width))
    steps[0], steps[3] = 1, 1
    for row, values in enumerate((a, b, c, d)):
        steps[row, :n] = values
    steps = np.ascontiguousarray(steps.reshape(4, n_blocks, width).transpose(2, 0, 1))
    p, q, r, s = np.ones(n_blocks), np.zeros(n_blocks), np.zeros(n_blocks), np.ones(n_blocks)
    for a, b, c, d in steps:
        p, q, r, s = a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s
        size = p + q + r + s
        p, q, r, s = p / size, q / size, r / size, s / size
    enter, x = np.empty(n_blocks), 1.0
    for i, (e, f, g, h) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        enter[i] = x
        x = (e * x + f) / (g * x + h)
    out, x = np.empty((width, n_blocks)), enter
    for i, (a, b, c, d) in enumerate(steps):
        x = (a * x + b) / (c * x + d)
        out[i] = x
    return out.T.reshape(-1)[:n]


def _fit_windows(ids: np.ndarray, shapes: np.ndarray, labels: np.ndarray, n_words: int,
                 rounds: int = 80, rate: float = 0.25, ridge: float = 1e-4):
    """Weights of words, shapes, bias and moves from windows of equal length (log-likelihood ascent).

    Positions with label -1 are padding."""
    real = labels >= 0
    y = np.maximum(labels, 0)
    theta = np.zeros(n_words + SHAPES + 1 + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    n, length = ids.shape
    total = real.sum()
    observed = np.zeros_like(theta)
    observed[:n_words] = np.bincount(ids[real], y[real], n_words)
    known = real & (ids > 0)
    observed[n_words:n_words + SHAPES] = np.bincount(shapes[known], y[known], SHAPES)
    observed[n_words + SHAPES] = y[real].sum()
    pair = real[:, :-1] & real[:, 1:]
    observed[-4:] = np.bincount((2 * y[:, :-1] + y[:, 1:])[pair], minlength=4)
    for step in range(1, rounds + 1):
        emit = theta[ids] * (ids > 0) + theta[n_words + shapes] * (ids > 0) + theta[n_words + SHAPES]
        odds = np.exp(np.clip(emit, -30, 30))
        move = np.exp(np.clip(theta[-4:].reshape(2, 2), -30, 30))
        alpha, beta = np.empty((length, 2, n)), np.empty((length, 2, n))
        for t in range(length):
            e = np.stack([np.ones(n), odds[:, t]])
            alpha[t] = e if t == 0 else e * (move.T @ alpha[t - 1])
            alpha[t] = np.where(real[:, t], alpha[t] / alpha[t].sum(axis=0), alpha[t - 1] if t else .5)
        beta[-1] = 1
        for t in range(length - 2, -1, -1):
            e = np.stack([np.ones(n), odds[:, t + 1]])
            beta[t] = move @ (e * beta[t + 1])
            beta[t] = np.where(real[:, t + 1], beta[t] / beta[t].sum(axis=0), 1)
        both = alpha * beta
        p = (both[:, 1] / both.sum(axis=1)).T
        joint = np.stack([
            alpha[:-1, i] * move[i, j] * (odds[:, 1:].T if j else 1) * beta[1:, j]
            for i in (0, 1) for j in (0, 1)])
        joint = (joint / joint.sum(axis=0)).transpose(0, 2, 1)
        expected = np.zeros_like(theta)
        expected[:n_words] = np.bincount(ids[real], p[real], n_words)
        expected[n_words:n_words + SHAPES] = np.bincount(shapes[known], p[known], SHAPES)
        expected[n_words + SHAPES] = p[real].sum()
        expected[-4:] = (joint * pair).sum(axis=(1, 2))
        slope = (observed - expected) / total * 100 - ridge * theta
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope ** 2
        theta += rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-6)
        theta[0] = 0
    return (theta[:n_words], theta[n_words:n_words + SHAPES], theta[n_words + SHAPES],
            theta[-4:].reshape(2, 2))


def _fit_score(features: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps; slopes are not negative, so more is never less toxic."""
    x = np.column_stack([np.ones(len(y)), features])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        w += np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
        w = np.clip(w, -20, 20)
        w[1:] = np.maximum(w[1:], 0)
    return w


def fit_chain(docs: DataFrame, labels: DataFrame, sample_rows: int = 2000, windows: int = 3000,
              least_docs: int = 3, least_odds: float = 2.0, key: str = "doc_id", text: str = "text",
              label: str = "toxic") -> Chain:
    """Fit on about `sample_rows` toxic and as many clean rows and on `windows` windows of 64 tokens.

    Both bounds are what the driver holds at most, whatever the size of the corpus. Labels that are
    null or belong to no document are ignored; of several labels of a key the largest counts.
    Without toxic rows the chain scores everything near 0."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_key")).agg(
        F.max(F.col(label).cast("int")).alias("_toxic"))
    chosen_keys = stratified_sample(known, "_toxic", "_key", sample_rows, "toxicity")
    texts = docs.select(docs[key].alias("_key"), docs[text].alias("_text"))
    sample = cut_lineage(texts.join(F.broadcast(chosen_keys), "_key"))    # bounded by sample_rows
    toxic_words = {w.encode() for w in weak_words(sample, least_docs, least_odds)}

    def cut(batches):
        for batch in batches:
            for text_, toxic in zip(batch["_text"], batch["_toxic"], strict=True):
                words = encoded(text_).split()
                labels = [int(toxic == 1 and normal(w) in toxic_words) for w in words]
                starts = range(0, len(words), WINDOW)
                yield pd.DataFrame({"words": [words[i:i + WINDOW] for i in starts],
                                    "labels": [labels[i:i + WINDOW] for i in starts]})

    cut_windows = sample.mapInPandas(cut, "words array<binary>, labels array<int>")
    ranked = cut_lineage(cut_windows.withColumn("_some", F.array_max("labels")).withColumn(
        "_mix", F.xxhash64("words")))
    chosen = [r for value in (1, 0) for r in ranked.where(F.col("_some") == value)
              .orderBy("_mix").limit(windows // 2).collect()]
    vocabulary = {w: i for i, w in enumerate(
        sorted({normal(bytes(w)) for r in chosen for w in r["words"]}), 1)}
    ids = np.zeros((len(chosen), WINDOW), np.int64)
    shapes, labels = np.zeros_like(ids), np.full_like(ids, -1)
    for i, r in enumerate(chosen):
        n = len(r["words"])
        ids[i, :n] = [vocabulary[normal(bytes(w))] for w in r["words"]]
        shapes[i, :n] = [shape(bytes(w)) for w in r["words"]]
        labels[i, :n] = r["labels"]
    if not (labels == 1).any():
        return Chain({}, np.zeros(SHAPES), -20.0, np.zeros((2, 2)), np.array([-5.0, 0, 0]))
    weights, by_shape, bias, moves = _fit_windows(ids, shapes, labels, len(vocabulary) + 1)
    chain = Chain({w: float(weights[i]) for w, i in vocabulary.items() if abs(weights[i]) > 0.5},
                  by_shape, float(bias), moves, np.zeros(3))

    def featured(batches):
        for batch in batches:
            for part in blocks(list(batch["_text"])):
                found = [encoded(t).split() for t in batch["_text"].iloc[part]]
                sizes = np.array([len(w) for w in found], np.int64)
                p = chain.marginals([w for words in found for w in words], sizes)
                f = chain.documents(p, sizes)
                yield pd.DataFrame({"a": f[:, 0], "b": f[:, 1],
                                    "toxic": batch["_toxic"].iloc[part].to_numpy()})

    shown = sample.mapInPandas(featured, "a double, b double, toxic int").toPandas()
    # the sample is stratified; the intercept goes back to the share of toxic rows of all rows
    counts = {r[0]: r[1] for r in known.groupBy("_toxic").count().collect()}
    chain.score = _fit_score(shown[["a", "b"]].to_numpy(), shown["toxic"].to_numpy(float))
    shown_odds = (shown["toxic"].sum() + 1) / ((shown["toxic"] == 0).sum() + 1)
    chain.score[0] += np.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1) / shown_odds)
    return chain


def spans(text: str, marginal: np.ndarray) -> list[dict]:
    """Runs of tokens with a marginal of one half or more, as offsets in code points."""
    out: list[dict] = []
    previous = -2
    for i, match in enumerate(_WORD.finditer(text)):
        if marginal[i] >= 0.5:
            if previous == i - 1:
                out[-1] = {"start": out[-1]["start"], "end": match.end(),
                           "score": max(out[-1]["score"], float(marginal[i]))}
            else:
                out.append({"start": match.start(), "end": match.end(), "score": float(marginal[i])})
            previous = i
    return out


def score_toxicity(docs: DataFrame, chain: Chain, threshold: float = 0.7, key: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """Per row: key, `score`, `predicted` (1 from the threshold on), `n_words`, and `spans`.

    Null and empty texts have no tokens: they get the score of a document without any. Whole texts
    are scored. Repeated and null keys stay; other columns are not read.
    """
    def judge(batches):
        for batch in batches:
            for part in blocks(list(batch["_text"])):
                texts = [t or "" for t in batch["_text"].iloc[part]]
                found = [encoded(t).split() for t in texts]
                sizes = np.array([len(w) for w in found], np.int64)
                p = chain.marginals([w for words in found for w in words], sizes)
                features = chain.documents(p, sizes)
                score, starts = chain.scores(features), np.cumsum(sizes) - sizes
                yield pd.DataFrame({
                    "_key": batch["_key"].iloc[part].array, "score": score,
                    "predicted": (score >= threshold).astype(int), "n_words": sizes,
                    "spans": [spans(t, p[s:s + n]) if f[1] >= 0.5 else [] for t, s, n, f in
                              zip(texts, starts, sizes, features, strict=True)]})

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(as_text(docs[key]).alias("_key"), docs[text].alias("_text"))
    return rows.mapInPandas(
        judge, "_key string, score double, predicted int, n_words long, "
        "spans array<struct<start:long,end:long,score:double>>").withColumn(
        "_key", F.col("_key").cast(kind)).withColumnRenamed("_key", key)
