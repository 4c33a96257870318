"""Exact cosine search without writing out all pairs.

Vectors are compared block by block with numpy; a block pair returns one row per vector, never
the pairs themselves. Sparse ones use an inverted list of rare terms in each block (`sparse_blocks`).
A hot part is cut into blocks of bounded size like any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import connected_components
from .sparse_blocks import DIGITS, Idf, best_rows, linked_rows, merged, one_pair_at_once

SPARSE_BLOCK_ROWS = 1024
DENSE_BLOCK_ROWS = 4096
LONG_LIST = 2000                       # vectors of a block that meet the other block at once
BROADCAST_VALUES = 4_000_000           # numbers in a broadcast matrix (32 MB of doubles)
BLOCK_VALUES = 8_000_000               # numbers in a block of dense vectors (64 MB of doubles)
GRID = 8                               # blocks of a table that fits fewer
TILE_ROWS = 512                        # vectors of a block that meet `DENSE_BLOCK_ROWS` others at once


def check_least(least: float) -> None:
    if not 0.0 < least <= 1.0:
        raise ValueError("the least similarity must be above 0 and at most 1")


# --- sparse: similar vectors ----------------------------------------------------------

def as_vectors(postings: DataFrame) -> DataFrame:
    """(id, terms, weights), terms ascending: one row per vector, as long as its vocabulary."""
    pairs = F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("_v")
    return postings.groupBy("id").agg(pairs).select(
        "id", F.col("_v.term").alias("terms"), F.col("_v.weight").alias("weights"))


def similar_components(postings: DataFrame, least: float) -> DataFrame:
    """(node, component) of the graph that links vectors with cosine >= least.

    `postings` has id, term, weight of unit vectors, terms numbered from the rarest on.
    Exact: every pair that is not linked already is excluded by a bound or compared.
    """
    return similar_vectors(cut_lineage(as_vectors(postings)), least)


def similar_vectors(vectors: DataFrame, least: float, idf: Idf | None = None) -> DataFrame:
    """The same of vectors (id, terms, weights), or counts of terms with their `idf`."""
    check_least(least)
    return connected_components(one_pair_at_once(linked_rows(vectors, least, tile_rows=LONG_LIST, idf=idf)), "a", "b")


def best_anchor(targets: DataFrame, anchors: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """(id, score, anchor): of each target the anchor with the largest cosine of at least `least`;
    the lowest anchor id wins ties. Targets that share no term with an anchor have no row.

    Both sides are postings (id, term, df, weight, reach) of unit vectors over one numbering of terms,
    `vectors` the anchors' as arrays. Only targets and anchors meet. With a bound of 0 or less all pairs
    that share a term count, and their products are summed as they are."""
    def rows(postings: DataFrame, s: str) -> DataFrame:
        return postings.select("term", F.col("id").alias(s), F.col("weight").alias(f"_w{s}"))

    if least > 0.0:
        check_least(least)
        return best_rows(cut_lineage(as_vectors(targets)), vectors, least).withColumnRenamed("partner", "anchor")
    scored = rows(targets, "a").join(rows(anchors, "b"), "term").groupBy("a", "b").agg(
        F.sum(F.col("_wa") * F.col("_wb")).alias("score"))
    best = F.max(F.struct(F.round("score", DIGITS).alias("score"), (-F.col("b")).alias("_b"))).alias("_best")
    return scored.groupBy(F.col("a").alias("id")).agg(best).select(
        "id", F.col("_best.score").alias("score"), (-F.col("_best._b")).alias("anchor"))


# --- sparse: best partner inside each part ---------------------------------------------

def block_copies(vectors: DataFrame, block_rows: int) -> DataFrame:
    """Copies of every row for the block pairs it takes part in, keyed by (bin, i, j).

    Needs `grp`, `id` and the flags `left`, `right`. Groups of up to `block_rows` rows are
    packed into bins; a larger group is cut into blocks by a hash, and all pairs of its blocks
    are formed. Column `role` is 0 on the left and 1 on the right side.
    """
    sizes = vectors.groupBy("grp").agg(
        F.count("*").alias("_n"), F.count_if("left").alias("_l"), F.count_if("right").alias("_r")
    ).where((F.col("_l") > 0) & (F.col("_r") > 0))
    small = F.ceil(vectors.agg(F.count("*")).scalar() / block_rows)
    blocks = F.ceil(F.col("_n") / block_rows).cast("int")
    rows = vectors.join(sizes.select("grp", blocks.alias("_blocks")), "grp")
    packed = F.col("_blocks") == 1
    own = F.when(packed, 0).otherwise(F.pmod(F.xxhash64("id"), F.col("_blocks"))).cast("int")
    bin_ = F.when(packed, -1 - F.pmod(F.xxhash64("grp"), small)).otherwise(F.col("grp"))

    def copies(role: int) -> Column:
        flag = F.col("right") if role else F.col("left")
        def place(k: Column) -> Column:
            i, j = (k, F.col("_own")) if role else (F.col("_own"), k)
            return F.struct(i.alias("i"), j.alias("j"), F.lit(role).alias("role"))
        made = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), place)
        return F.when(flag, made).otherwise(F.slice(made, 1, 0))

    return (
        rows.withColumn("_own", own).withColumn("bin", bin_.cast("bigint"))
        .withColumn("_copy", F.explode(F.concat(copies(0), copies(1))))
        .select("*", "_copy.*").drop("_copy", "_own", "_blocks")
    )


def sparse_products(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    """Matrix of the products of two blocks of sparse vectors."""
    def flat(block: pd.DataFrame):
        counts = [len(terms) for terms in block["terms"]]
        rows = np.repeat(np.arange(len(block)), counts)
        return rows, np.concatenate(list(block["terms"])), np.concatenate(list(block["weights"]))

    out = np.zeros((len(left), len(right)))
    (rl, tl, wl), (rr, tr, wr) = flat(left), flat(right)
    common = np.intersect1d(tl, tr)
    step = 2048
    for start in range(0, len(common), step):
        part = common[start:start + step]
        dense = []
        for rows, cols, weights, height in ((rl, tl, wl, len(left)), (rr, tr, wr, len(right))):
            place = np.searchsorted(part, cols)
            place[place == len(part)] = 0
            hit = part[place] == cols
            block = np.zeros((height, len(part)))
            block[rows[hit], place[hit]] = weights[hit]
            dense.append(block)
        out += dense[0] @ dense[1].T
    return out


def best_partner(vectors: DataFrame, least: float, allow_self: bool = False,
                 block_rows: int = SPARSE_BLOCK_ROWS) -> DataFrame:
    """(id, score, partner): for each left row the right row of its group with the largest
    product of at least `least`; the lowest `rank` wins among equals and is returned.

    Needs id, grp, left, right, rank, terms, weights.
    """
    def search(block: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"id": [], "score": [], "partner": []})]
        for _, group in block.groupby("grp"):
            left = group[group["role"] == 0]
            right = group[group["role"] == 1].sort_values("rank")
            if left.empty or right.empty:
                continue
            scores = np.round(sparse_products(left, right), DIGITS)
            if not allow_self:
                scores[left["id"].to_numpy()[:, None] == right["id"].to_numpy()[None, :]] = -1.0
            best = scores.argmax(axis=1)
            score = scores[np.arange(len(left)), best]
            found = score >= least
            parts.append(pd.DataFrame({
                "id": left["id"].to_numpy()[found], "score": score[found],
                "partner": right["rank"].to_numpy()[best[found]]}))
        return pd.concat(parts)

    found = (
        block_copies(vectors, block_rows)
        .select("bin", "i", "j", "role", "id", "grp", "rank", "terms", "weights")
        .groupBy("bin", "i", "j").applyInPandas(search, "id BIGINT, score DOUBLE, partner BIGINT")
    )
    best = F.max(F.struct("score", (-F.col("partner")).alias("_p"))).alias("_best")
    return found.groupBy("id").agg(best).select(
        "id", F.col("_best.score").alias("score"), (-F.col("_best._p")).alias("partner"))


def nearest_within(postings: DataFrame, least: float) -> DataFrame:
    """(id, neighbor, score): the most similar other vector with cosine >= least, if any."""
    return nearest_vectors(cut_lineage(as_vectors(postings)), least)


def nearest_vectors(vectors: DataFrame, least: float, idf: Idf | None = None) -> DataFrame:
    """The same of vectors (id, terms, weights), or counts of terms with their `idf`."""
    check_least(least)
    return best_rows(vectors, vectors, least, allow_self=False, idf=idf).select(
        "id", F.col("partner").alias("neighbor"), "score")


# --- dense -------------------------------------------------------------------------------

def unit_rows(vectors) -> np.ndarray:
    """Matrix of unit rows; zero vectors stay zero, and null ones count as zero vectors.

    Rows that are all null have no width; see `cosines`."""
    width = max((len(v) for v in vectors if v is not None), default=0)
    matrix = np.stack([np.zeros(width) if v is None else np.asarray(v, dtype=np.float64) for v in vectors])
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All cosines of two matrices of unit rows, as many digits as count; 0 where one is all null."""
    if not left.shape[1] or not right.shape[1]:
        return np.zeros((len(left), len(right)))
    return np.round(left @ right.T, DIGITS)


def _block_count(rows: int, width: int, block_rows: int) -> int:
    """Blocks of a table. A row is copied once per block it meets, so there are only as many as memory
    asks for, `GRID` at least if blocks keep `block_rows`; inside a task blocks are compared by tiles."""
    return max(1, min(math.ceil(rows / block_rows), max(GRID, math.ceil(rows * width / BLOCK_VALUES))))


def _numbers(count: int) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint"))


def nearest_anchor(targets: DataFrame, anchors: DataFrame, key: str, vector: str, rank: str,
                   broadcast_values: int = BROADCAST_VALUES,
                   block_rows: int = DENSE_BLOCK_ROWS) -> DataFrame:
    """(key, score, anchor): the anchor with the largest cosine; the lowest rank wins ties.

    A measured, small anchor table is sent to every task, and targets are not shuffled at all.
    A larger one is cut into blocks; each block pair returns its best anchor per target.
    Without anchors there is no row.
    """
    size = anchors.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d")).first()
    rows = int(size["n"])
    key_type = targets.schema[key].dataType.simpleString()
    schema = f"`{key}` {key_type}, score DOUBLE, anchor BIGINT"
    if rows == 0:
        return targets.sparkSession.createDataFrame([], schema)
    def best_of(keys, matrix, ranks, table):
        """Tile by tile; a later tile, with higher ranks, counts only if its score is larger."""
        score, anchor = np.full(len(keys), -np.inf), np.zeros(len(keys), dtype=np.int64)
        for start in range(0, len(keys), TILE_ROWS):
            rows = slice(start, start + TILE_ROWS)
            for first in range(0, len(ranks), DENSE_BLOCK_ROWS):
                scores = cosines(matrix[rows], table[first:first + DENSE_BLOCK_ROWS])
                best = scores.argmax(axis=1)
                top = scores[np.arange(len(best)), best]
                more = top > score[rows]
                score[rows] = np.where(more, top, score[rows])
                anchor[rows] = np.where(more, ranks[first + best], anchor[rows])
        return pd.DataFrame({key: keys, "score": score, "anchor": anchor})

    if rows * max(size["d"] or 0, 1) <= broadcast_values:
        local = anchors.select(F.col(rank).cast("bigint").alias("r"), F.col(vector).alias("v")) \
            .orderBy("r").toPandas()
        sent = targets.sparkSession.sparkContext.broadcast(
            (local["r"].to_numpy(), unit_rows(local["v"])))

        def scan(batches):
            ranks, table = sent.value
            for batch in batches:
                if len(batch):
                    yield best_of(batch[key].to_numpy(), unit_rows(batch["v"]), ranks, table)

        return targets.select(key, F.col(vector).alias("v")).mapInPandas(scan, schema)

    width = max(size["d"] or 0, 1)
    target_blocks = _block_count(targets.count(), width, block_rows)
    anchor_blocks = _block_count(rows, width, block_rows)
    groups = target_blocks * anchor_blocks
    spread_t = targets.select(
        F.col(key), F.col(vector).alias("v"),
        F.pmod(F.xxhash64(key), F.lit(target_blocks)).cast("bigint").alias("i"),
        F.explode(_numbers(anchor_blocks)).alias("j"))
    spread_a = anchors.select(
        F.col(rank).cast("bigint").alias("r"), F.col(vector).alias("v"),
        F.pmod(F.xxhash64(rank), F.lit(anchor_blocks)).cast("bigint").alias("j"),
        F.explode(_numbers(target_blocks)).alias("i"))

    def compare(some_targets: pd.DataFrame, some_anchors: pd.DataFrame) -> pd.DataFrame:
        if some_targets.empty or some_anchors.empty:
            return pd.DataFrame({key: [], "score": [], "anchor": []})
        some_anchors = some_anchors.sort_values("r")
        return best_of(some_targets[key].to_numpy(), unit_rows(some_targets["v"]),
                       some_anchors["r"].to_numpy(), unit_rows(some_anchors["v"]))

    found = spread_t.repartition(groups, "i", "j").groupBy("i", "j").cogroup(
        spread_a.repartition(groups, "i", "j").groupBy("i", "j")).applyInPandas(compare, schema)
    best = F.max(F.struct("score", (-F.col("anchor")).alias("_a"))).alias("_best")
    return found.groupBy(key).agg(best).select(
        key, F.col("_best.score").alias("score"), (-F.col("_best._a")).alias("anchor"))


def _near_tiles(left: np.ndarray, right: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tile by tile the places in two matrices of unit rows of the pairs with a cosine of at least `least`."""
    for start in range(0, len(left), TILE_ROWS):
        rows = left[start:start + TILE_ROWS]
        for first in range(0, len(right), DENSE_BLOCK_ROWS):
            tile = right[first:first + DENSE_BLOCK_ROWS]
            scores = rows @ tile.T if rows.shape[1] and tile.shape[1] else np.zeros((len(rows), len(tile)))
            i, j = np.nonzero(scores >= least - 10.0 ** (1 - DIGITS))     # few are rounded
            near = np.round(scores[i, j], DIGITS) >= least
            yield i[near] + start, j[near] + first


def _block_pairs(rows: DataFrame, key: str, vector: str, block_rows: int, *more: str) -> DataFrame:
    """Every row once per pair (i <= j) of blocks it is in, with its role and the columns `more`."""
    size = rows.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d")).first()
    blocks = _block_count(int(size["n"]), max(size["d"] or 0, 1), block_rows)
    own = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    placed = rows.select(F.col(key).alias("id"), F.col(vector).alias("v"), *more, own.alias("_own"))
    as_left = F.transform(
        F.sequence(F.col("_own"), F.lit(blocks - 1)),
        lambda j: F.struct(F.col("_own").alias("i"), j.alias("j"), F.lit(0).alias("role")))
    as_right = F.transform(
        F.sequence(F.lit(0), F.col("_own")),
        lambda i: F.struct(i.alias("i"), F.col("_own").alias("j"), F.lit(1).alias("role")))
    return placed.withColumn("_copy", F.explode(F.concat(as_left, as_right))).select(
        "id", "v", *more, "_copy.*").repartition(blocks * (blocks + 1) // 2, "i", "j")


def neighbour_counts(rows: DataFrame, key: str, vector: str, eps: float,
                     block_rows: int = DENSE_BLOCK_ROWS) -> DataFrame:
    """(key, n_neighbors): other vectors within cosine distance eps, 0 when there is none.

    A block pair returns one count per vector.
    """
    def count(block: pd.DataFrame) -> pd.DataFrame:
        left, right = block[block["role"] == 0], block[block["role"] == 1]
        if left.empty or right.empty:
            return pd.DataFrame({"id": [], "n": []})
        ids, other = left["id"].to_numpy(), right["id"].to_numpy()
        same_block = block["i"].iloc[0] == block["j"].iloc[0]
        n_left, n_right = np.zeros(len(ids), dtype=np.int64), np.zeros(len(other), dtype=np.int64)
        for i, j in _near_tiles(unit_rows(left["v"]), unit_rows(right["v"]), 1.0 - eps):
            apart = ids[i] != other[j]
            n_left += np.bincount(i[apart], minlength=len(ids))
            n_right += np.bincount(j[apart], minlength=len(other))
        if same_block:
            return pd.DataFrame({"id": ids, "n": n_left})
        return pd.DataFrame({"id": np.concatenate([ids, other]),
                             "n": np.concatenate([n_left, n_right])})

    counts = _block_pairs(rows, key, vector, block_rows).groupBy("i", "j").applyInPandas(
        count, "id BIGINT, n BIGINT")
    return counts.groupBy(F.col("id").alias(key)).agg(F.sum("n").alias("n_neighbors"))


def spanning_edges(near: np.ndarray, ids: np.ndarray, other: np.ndarray) -> pd.DataFrame:
    """(a, b): edges that connect what a matrix of near rows connects, at most one per row."""
    label_l, label_r = ids.copy(), other.copy()
    top = np.iinfo(np.int64).max
    while True:
        new_r = np.minimum(label_r, np.where(near, label_l[:, None], top).min(axis=0))
        new_l = np.minimum(label_l, np.where(near, new_r[None, :], top).min(axis=1))
        if (new_r == label_r).all() and (new_l == label_l).all():
            break
        label_l, label_r = new_l, new_r
    edges = pd.DataFrame({"a": np.concatenate([label_l, label_r]),
                          "b": np.concatenate([ids, other])})
    return edges[edges["a"] != edges["b"]].drop_duplicates()


def near_weights(vectors: DataFrame, least: float, block_rows: int = DENSE_BLOCK_ROWS) -> DataFrame:
    """(id, n): the copies of all rows with a cosine of at least `least`, itself included, in parts.

    Needs id, vector and copies."""
    def add(block: pd.DataFrame) -> pd.DataFrame:
        left, right = block[block["role"] == 0], block[block["role"] == 1]
        n_left, n_right = np.zeros(len(left)), np.zeros(len(right))
        if len(left) and len(right):
            ours, others = left["copies"].to_numpy(), right["copies"].to_numpy()
            for i, j in _near_tiles(unit_rows(left["v"]), unit_rows(right["v"]), least):
                n_left += np.bincount(i, others[j], minlength=len(left))
                n_right += np.bincount(j, ours[i], minlength=len(right))
        if block["i"].iloc[0] == block["j"].iloc[0]:
            return pd.DataFrame({"id": left["id"], "n": n_left.astype(np.int64)})
        return pd.DataFrame({"id": pd.concat([left["id"], right["id"]]),
                             "n": np.concatenate([n_left, n_right]).astype(np.int64)})

    return _block_pairs(vectors, "id", "vector", block_rows, "copies").groupBy("i", "j").applyInPandas(
        add, "id BIGINT, n BIGINT")


def first_near(vectors: DataFrame, least: float, block_rows: int = DENSE_BLOCK_ROWS) -> DataFrame:
    """(id, near): the least component of core rows that are near a row which is none, in parts.

    Needs id, vector, core and component."""
    top = np.iinfo(np.int64).max

    def search(block: pd.DataFrame) -> pd.DataFrame:
        left, right = block[block["role"] == 0], block[block["role"] == 1]
        parts = [pd.DataFrame({"id": [], "near": []})]
        same_block = block["i"].iloc[0] == block["j"].iloc[0]
        for some, others in ((left, right), (right, left))[:1 if same_block else 2]:
            some, others = some[~some["core"].astype(bool)], others[others["core"].astype(bool)]
            if some.empty or others.empty:
                continue
            label, own = np.full(len(some), top), others["component"].to_numpy().astype(np.int64)
            for i, j in _near_tiles(unit_rows(some["v"]), unit_rows(others["v"]), least):
                np.minimum.at(label, i, own[j])
            parts.append(pd.DataFrame({"id": some["id"].to_numpy()[label < top], "near": label[label < top]}))
        return pd.concat(parts)

    return _block_pairs(vectors, "id", "vector", block_rows, "core", "component").groupBy("i", "j").applyInPandas(
        search, "id BIGINT, near BIGINT")


def dense_components(rows: DataFrame, key: str, vector: str, eps: float,
                     block_rows: int = DENSE_BLOCK_ROWS) -> DataFrame:
    """(node, component) of the graph that links vectors within cosine distance eps.

    A block pair returns a spanning forest of its part of the graph, so a dense group costs
    one edge per vector and block, not one per pair.
    """
    return connected_components(dense_edges(rows, key, vector, 1.0 - eps, block_rows), "a", "b")


def dense_edges(rows: DataFrame, key: str, vector: str, least: float,
                block_rows: int = DENSE_BLOCK_ROWS) -> DataFrame:
    """(a, b): edges that connect all vectors with a cosine of at least `least`, directly or by others."""
    def forest(block: pd.DataFrame) -> pd.DataFrame:
        left, right = block[block["role"] == 0], block[block["role"] == 1]
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": []})
        ids = np.concatenate([left["id"].to_numpy(), right["id"].to_numpy()])
        label = np.arange(len(ids))
        for i, j in _near_tiles(unit_rows(left["v"]), unit_rows(right["v"]), least):
            apart = label[i] != label[j + len(left)]
            label = merged(label, i[apart], j[apart] + len(left))
        moved = np.flatnonzero(ids[label] != ids)
        return pd.DataFrame({"a": ids[label[moved]], "b": ids[moved]})

    return _block_pairs(rows, key, vector, block_rows).groupBy("i", "j").applyInPandas(
        forest, "a BIGINT, b BIGINT")
