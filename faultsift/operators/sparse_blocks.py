"""Exact products of sparse unit vectors, block against block; pairs never leave a task.

Rows are dealt to blocks whose number follows the stored numbers. A block is one row of a table that is written
once; the tasks that compare two blocks read both from there, so what is written and shuffled does not grow with
the number of pairs. Inside a task rows are sorted by how many of their common terms they need to be long. Two rows
whose terms from a cut on are short must share rarer terms, whose products come from an inverted list; few pairs have
some, and only those are looked at. Rows that stay long at the last cut are bounded by parts of the common terms: a part
adds at most the product of its lengths in both rows. What is left gets its exact product. Blocks hold counts of terms,
not weights, where an `Idf` makes the weights in the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, rows_at_once

BLOCK_POSTINGS = 4_000_000             # terms of the rows in one block (32 MB of counts)
SPREAD_POSTINGS = 250_000              # smaller tables are cut this fine, into up to `SPREAD` blocks
SPREAD = 6
FEW = 0.05                             # products per pair of rows with which most pairs have none
MANY = 0.05                            # share of pairs that are possible by length, above which all get the bound by parts
TILE = 150_000                         # products of rows in a matrix (1.2 MB, which a cache holds)
PART_NUMBERS = 4_000_000               # lengths of parts
TABLE = 2_000_000                      # weights in a table of left rows
SHARES = (0.02, 0.05, 0.1, 0.2, 0.5)   # products of terms before each cut, per pair of rows
SLACK = 0.02                           # what terms before a cut must add to make a pair possible, at least
FOUND = 50_000                         # possible pairs that are looked at together
PARTS = 64                             # parts the common terms are dealt to for the bound, at most
DIGITS = 12                            # scores equal to this many digits are ties


@dataclass
class Idf:
    """Weight of every term by its number. Rare terms have the low numbers, so one step holds all of a frequency."""

    first: np.ndarray                      # the least number of each step
    value: np.ndarray

    def units(self, terms: np.ndarray, counts: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Weights of unit vectors from counts of terms, one row after the other."""
        raw = self.value[np.searchsorted(self.first, terms, "right") - 1] * counts
        return raw / np.sqrt(np.bincount(row, raw * raw, minlength=rows))[row]


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, numbers of terms, terms and weights of rows."""
    table = table.combine_chunks()
    terms, weights = (table[name].combine_chunks() for name in ("terms", "weights"))
    return (table["id"].to_numpy(), terms.value_lengths().to_numpy(zero_copy_only=False),
            terms.flatten().to_numpy(zero_copy_only=False), weights.flatten().to_numpy(zero_copy_only=False))


class _Rows:
    """Rows of a block: ids, and terms (ascending) and weights one row after the other."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray,
                 idf: Idf | None = None):
        self.ids, self.terms, self.weights = ids, terms, weights
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.row = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        if idf is not None:
            self.weights = idf.units(terms, weights, self.row, len(self))

    @classmethod
    def of(cls, table: pa.Table, idf: Idf | None = None) -> _Rows:
        return cls(*_columns(table), idf)

    @classmethod
    def read(cls, batch: pa.RecordBatch, at: int, side: str, idf: Idf | None) -> _Rows:
        """The block that a pair of blocks has on a side."""
        kinds = {"ids": np.int64, "sizes": np.int32, "terms": np.int32, "weights": np.float64 if idf is None else np.int32}
        return cls(*(np.frombuffer(batch.column(f"{side}_{name}")[at].as_buffer(), kind)
                     for name, kind in kinds.items()), idf)

    def __len__(self) -> int:
        return len(self.ids)


class _Side:
    """A block's rows with only the terms that the other block has too, by new numbers.

    `cuts` cut the terms into steps. By row and cut there is where the terms from the cut on begin (`middle`) and their
    length (`rest`). A row is of a kind by the first cut from which it is at most `most` long; rows are sorted by kind."""

    def __init__(self, rows: _Rows, number: np.ndarray, cuts: np.ndarray, step: np.ndarray, most: float):
        n, steps = len(rows), len(cuts) + 1
        terms = number[rows.terms]
        at = step[terms].astype(np.int32)
        at[terms < 0] = steps                                # left out
        at += rows.row * np.int32(steps + 1)
        counts = np.bincount(at, minlength=n * (steps + 1)).reshape(n, steps + 1)
        square = np.bincount(at, rows.weights * rows.weights, minlength=n * (steps + 1)).reshape(n, steps + 1)
        del at
        rest = np.sqrt(square[:, -2::-1].cumsum(axis=1)[:, ::-1][:, 1:])
        kind = (rest > most).sum(axis=1)
        order = np.argsort(kind, kind="stable")
        self.ids, self.rest, self.first = rows.ids[order], rest[order], int(cuts[-1])
        self.edges = np.searchsorted(kind[order], np.arange(steps + 1))
        at = _spans(rows.starts[order], rows.starts[order + 1])[0].astype(np.int32)
        at = at[terms[at] >= 0]
        self.terms, self.weights = terms[at], rows.weights[at]
        del at, terms
        self.step = step[self.terms]
        counts = counts[order, :-1].cumsum(axis=1)
        self.starts = np.concatenate([[0], np.cumsum(counts[:, -1])])
        self.middle = self.starts[:-1, None] + counts[:, :-1]
        self.row = np.repeat(np.arange(n, dtype=np.int32), counts[:, -1])
        self.known: dict[tuple[int, int], np.ndarray] = {}
        self.most = [self.rest[low:high].max(axis=0, initial=0.0) for low, high in zip(self.edges, self.edges[1:])]

    def before(self, kind: int, cut: int) -> np.ndarray:
        """Places of the terms before a cut, of rows of a kind."""
        low, high = self.starts[self.edges[kind]], self.starts[self.edges[kind + 1]]
        return np.flatnonzero(self.step[low:high] <= cut) + low

    def lists(self, kind: int, cut: int, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The inverted list of the terms before a cut, of rows of a kind: rows, weights, where each term begins."""
        place = self.before(kind, cut)
        place = place[np.argsort(self.terms[place], kind="stable")]
        start = np.zeros(terms + 1, np.int32)
        np.cumsum(np.bincount(self.terms[place], minlength=terms), out=start[1:])
        return self.row[place] - np.int32(self.edges[kind]), self.weights[place], start

    def lengths(self, kind: int, parts: int) -> np.ndarray:
        """Of rows of a kind, the lengths of the terms from the last cut on by their part."""
        if (kind, parts) not in self.known:
            low, high = self.edges[kind], self.edges[kind + 1]
            at, of = _spans(self.middle[low:high, -1], self.starts[low + 1:high + 1])
            place = of * parts + (self.terms[at] - self.first) % parts
            square = np.bincount(place, self.weights[at] ** 2, minlength=(high - low) * parts)
            self.known[kind, parts] = np.sqrt(square).astype(np.float32).reshape(high - low, parts)
        return self.known[kind, parts]


def _spans(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places first..last-1 of every span one after the other, and the span each is of."""
    counts = last - first
    of = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(of)) + np.repeat(first - (np.cumsum(counts) - counts), counts), of


class _Products:
    """Pairs of two blocks by their exact products.

    Two rows whose terms from a cut on are short cannot be near by these alone: the product of their lengths stays
    `SLACK` below `least`, and pairs without some products of rarer terms are excluded. Rows are of a kind by the cut
    from which they are short, and kinds meet at the first cut that does for both, so only rows that are long at the
    last cut, and meet each other, need the bound by parts."""

    def __init__(self, left: _Rows, right: _Rows, least: float, tile_rows: int):
        self.least, self.tile_rows = least, tile_rows
        top = 1 + max(int(side.terms.max(initial=0)) for side in (left, right))
        n_left, n_right = (np.bincount(side.terms, minlength=top) for side in (left, right))
        both = (n_left > 0) & (n_right > 0)
        self.names = int(both.sum())
        number = np.where(both, np.cumsum(both, dtype=np.int32) - np.int32(1), np.int32(-1))
        work = np.cumsum(n_left[both].astype(float) * n_right[both])
        self.cuts = np.searchsorted(work, np.array(SHARES) * len(left) * len(right), "right")
        step = np.searchsorted(self.cuts, np.arange(self.names + 1), "right").astype(np.int8)   # one more, that of no number
        options = number, self.cuts, step, math.sqrt(max(0.0, least - SLACK))
        self.left = _Side(left, *options)
        self.right = self.left if right is left else _Side(right, *options)

    def _meeting(self, ours: int, others: int) -> tuple[int, float]:
        """The cut at which two kinds meet, and what the terms from there on add at most; infinite if parts must say."""
        bound = self.left.most[ours] * self.right.most[others]
        short = np.flatnonzero(bound <= self.least - SLACK)
        return (int(short[0]), float(bound[short[0]])) if len(short) else (len(self.cuts) - 1, math.inf)

    def possible(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """Some at a time: rows of the left (ascending), of the right, products of their terms before a cut, the cut."""
        some, others = ([kind for kind, n in enumerate(np.diff(side.edges)) if n] for side in (self.left, self.right))
        lists = {kind: self.right.lists(kind, max(self._meeting(x, kind)[0] for x in some), self.names) for kind in others}
        for ours in some:
            for kind in others:
                found, n, (cut, bound) = [], 0, self._meeting(ours, kind)
                for part in self._tiles(ours, kind, cut, bound, lists[kind]):
                    found.append(part)
                    n += len(part[0])
                    if n > FOUND:
                        yield *(np.concatenate(x) for x in zip(*found)), cut
                        found, n = [], 0
                if n:
                    yield *(np.concatenate(x) for x in zip(*found)), cut

    def _tiles(self, ours: int, others: int, cut: int, bound: float, lists) -> Iterator[tuple[np.ndarray, ...]]:
        left, right = self.left, self.right
        (low, rows), (shift, columns) = ((side.edges[kind], side.edges[kind + 1] - side.edges[kind])
                                         for side, kind in ((left, ours), (right, others)))
        list_row, list_weight, list_start = lists
        place = left.before(ours, cut)
        first = list_start[left.terms[place]]
        count = list_start[left.terms[place] + 1] - first
        some = np.flatnonzero(count)                         # the other kind may have none of a term
        place, first, count = place[some], first[some], count[some]
        at_row, weights = left.row[place] - low, left.weights[place]
        done = np.cumsum(np.bincount(at_row, count, minlength=rows))
        begins = np.searchsorted(at_row, np.arange(rows + 1))
        ours_rest, others_rest = left.rest[low:low + rows, cut], right.rest[shift:shift + columns, cut]
        long_ = np.searchsorted(np.sort(others_rest), (self.least - SLACK) / np.maximum(ours_rest, 1e-9))
        by_parts = bound == math.inf and (columns - long_).sum() > MANY * rows * columns
        parts = max(1, min(PARTS, PART_NUMBERS // max(1, len(left.ids), len(right.ids))))
        if bound == math.inf:
            ours_parts, others_parts = left.lengths(ours, parts), right.lengths(others, parts)
        few = bound < math.inf and (done[-1] if rows else 0) < FEW * rows * columns
        high = max(1, min(self.tile_rows, (TILE if not few else np.iinfo(np.int32).max) // columns))
        begin = 0
        while begin < rows:
            before = done[begin - 1] if begin else 0
            end = min(begin + high, max(begin + 1, int(np.searchsorted(done, before + TILE))), rows)
            own = slice(begins[begin], begins[end])
            counts = count[own]
            ends = np.cumsum(counts)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[own] - ends + counts, counts)
            flat = np.repeat((at_row[own] - begin) * columns, counts) + list_row[at]
            products = np.repeat(weights[own], counts) * list_weight[at]
            if few and len(flat):                            # no place for pairs without a product
                order = np.argsort(flat, kind="stable")
                flat = flat[order]
                edges = np.flatnonzero(np.diff(flat, prepend=-1))
                near, shared = flat[edges], np.add.reduceat(products[order], edges)
                some = shared >= self.least - bound - 1e-5
                near, shared = near[some], shared[some]
            else:
                shared = np.bincount(flat, products, minlength=(end - begin) * columns).astype(float, copy=False)
                if bound < math.inf:
                    near = np.flatnonzero(shared >= self.least - bound - 1e-5)
                else:
                    most = ours_parts[begin:end] @ others_parts.T if by_parts else ours_rest[begin:end, None] * others_rest
                    near = np.flatnonzero((shared.reshape(end - begin, columns) + most).ravel() >= self.least - 1e-5)
                shared = shared[near]
            i, j = near // columns + begin, near % columns
            open_ = shared + ours_rest[i] * others_rest[j] >= self.least - 1e-5
            i, j, shared = i[open_], j[open_], shared[open_]
            if bound == math.inf and not by_parts:
                open_ = shared + np.einsum("ij,ij->i", ours_parts[i], others_parts[j]) >= self.least - 1e-5
                i, j, shared = i[open_], j[open_], shared[open_]
            yield i + low, j + shift, shared
            begin = end

    def exact(self, i: np.ndarray, j: np.ndarray, shared: np.ndarray, cut: int) -> np.ndarray:
        """Products of pairs sorted by i, from those of their terms before a cut."""
        left, right, out = self.left, self.right, shared.copy()
        first = int(self.cuts[cut])
        wide = max(1, self.names - first)
        places = np.cumsum(right.starts[j + 1] - right.middle[j, cut])
        steps = np.cumsum(np.diff(i, prepend=i[:1]) > 0)       # left rows so far, of those that come
        begin, high = 0, max(1, TABLE // wide)
        table = np.zeros(min(high, int(steps[-1]) + 1 if len(i) else 1) * wide)
        while begin < len(i):
            before = places[begin - 1] if begin else 0
            end = min(int(np.searchsorted(steps, steps[begin] + high)),
                      max(begin + 1, int(np.searchsorted(places, before + TABLE))))
            own = i[begin:end][np.diff(i[begin:end], prepend=-1) > 0]
            at, of = _spans(left.middle[own, cut], left.starts[own + 1])
            filled = of * wide + left.terms[at] - first
            table[filled] = left.weights[at]
            base = (steps[begin:end] - steps[begin]) * wide - first
            some = j[begin:end]
            at, of = _spans(right.middle[some, cut], right.starts[some + 1])
            out[begin:end] += np.bincount(of, table[base[of] + right.terms[at]] * right.weights[at], minlength=end - begin)
            table[filled] = 0.0
            begin = end
        return np.round(out, DIGITS)


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels of nodes after linking a with b; a label is a node."""
    while (label[a] != label[b]).any():
        least, to = np.minimum(label[a], label[b]), np.arange(len(label))
        np.minimum.at(to, label[a], least)
        np.minimum.at(to, label[b], least)
        while (to[to] != to).any():
            to = to[to]
        label = to[label]
    return label


def _blocks(total: int, block_postings: int) -> int:
    return max(1, math.ceil(total / block_postings), min(SPREAD, math.ceil(total / SPREAD_POSTINGS)))


def _postings(vectors: DataFrame) -> int:
    return int(vectors.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0])


def packed(vectors: DataFrame, counted: bool, block_postings: int | None = None) -> DataFrame:
    """(block, ids, sizes, terms, weights): rows (id, terms, weights) dealt to blocks, one row per block.

    `weights` are counts of terms, or doubles unless `counted`. Rows without id or terms are left out."""
    blocks = _blocks(_postings(vectors), block_postings or BLOCK_POSTINGS)
    rows = vectors.where("id IS NOT NULL AND terms IS NOT NULL").select(
        F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.col("id").cast("bigint").alias("id"),
        F.col("terms").cast("array<int>").alias("terms"),
        F.col("weights").cast("array<int>" if counted else "array<double>").alias("weights"))

    def pack(table: pa.Table) -> pa.Table:
        ids, sizes, terms, weights = _columns(table)
        held = {"ids": ids, "sizes": sizes.astype(np.int32), "terms": terms, "weights": weights}
        return pa.table({"block": table["block"].slice(0, 1)} | {name: pa.array([x.tobytes()], pa.binary())
                                                                 for name, x in held.items()})

    return rows.repartition(blocks, "block").groupBy("block").applyInArrow(
        pack, "block INT, ids BINARY, sizes BINARY, terms BINARY, weights BINARY")


def _pairs(left: DataFrame, right: DataFrame, half: bool = False) -> DataFrame:
    """Every pair of written blocks, with `half` each once. Tasks read the blocks; nothing is shuffled."""
    a, b = (side.select(*(F.col(name).alias(f"{letter}_{name}") for name in side.columns))
            for letter, side in (("a", left), ("b", right)))
    a = a.hint("shuffle_replicate_nl")             # no side is sent to every task
    return a.join(b, F.col("a_block") <= F.col("b_block")) if half else a.crossJoin(b)


def one_pair_at_once(compared: DataFrame) -> DataFrame:
    """Written, with tasks that get one pair of blocks (some 60 MB) at a time, not a batch of many."""
    with rows_at_once(compared.sparkSession, 1):
        return cut_lineage(compared)


def weighed(vectors: DataFrame, idf: Idf) -> DataFrame:
    """(id, terms, weights) of unit vectors, of rows with counts of terms."""
    def make(batches):
        for batch in batches:
            rows = _Rows.of(pa.Table.from_batches([batch]), idf)
            lists = [pa.ListArray.from_arrays(rows.starts.astype(np.int32), x) for x in (rows.terms, rows.weights)]
            yield pa.RecordBatch.from_arrays([pa.array(rows.ids), *lists], ["id", "terms", "weights"])

    return vectors.select("id", "terms", "weights").mapInArrow(make, "id BIGINT, terms ARRAY<INT>, weights ARRAY<DOUBLE>")


def _compared(batches, idf: Idf | None, search) -> Iterator[pa.RecordBatch]:
    """What `search` returns of each pair of blocks; the right one is the left one if a block meets itself."""
    number, left = None, None
    for batch in batches:
        for at in range(batch.num_rows):
            mine, other = (batch.column(f"{side}_block")[at].as_py() for side in "ab")
            if left is None or mine != number:               # a block is met by several, one after the other
                number, left = mine, _Rows.read(batch, at, "a", idf)
            yield search(left, left if mine == other else _Rows.read(batch, at, "b", idf))


def linked_rows(vectors: DataFrame, least: float, block_postings: int | None = None,
                tile_rows: int = TILE, idf: Idf | None = None) -> DataFrame:
    """(a, b): edges that connect all rows whose product is at least `least`, directly or by others.

    `vectors` has id, terms (ascending) and weights of unit vectors, or counts with an `idf`. A pair of blocks
    returns at most one edge per row. Rows that are linked already are not compared again. Write them with `one_pair_at_once`."""
    def search(left: _Rows, right: _Rows) -> pa.RecordBatch:
        same = right is left
        products = _Products(left, right, least, tile_rows)
        ids = products.left.ids if same else np.concatenate([products.left.ids, products.right.ids])
        label, shift = np.arange(len(ids)), 0 if same else len(left)
        for i, j, shared, cut in products.possible():
            open_ = i < j if same else np.ones(len(i), bool)
            i, j, shared = i[open_], j[open_], shared[open_]
            for first in (True, False):                # each row's most promising one, then what is not linked yet
                open_ = np.flatnonzero(label[i] != label[j + shift])
                if first:
                    open_ = open_[np.lexsort((-shared[open_], i[open_]))]
                    open_ = open_[np.flatnonzero(np.diff(i[open_], prepend=-1))]
                near = open_[products.exact(i[open_], j[open_], shared[open_], cut) >= least]
                if len(near):
                    label = merged(label, i[near], j[near] + shift)
        moved = np.flatnonzero(label != np.arange(len(ids)))
        return pa.RecordBatch.from_pydict(
            {"a": pa.array(ids[label[moved]], pa.int64()), "b": pa.array(ids[moved], pa.int64())})

    blocks = cut_lineage(packed(vectors, idf is not None, block_postings))
    return _pairs(blocks, blocks, half=True).mapInArrow(lambda batches: _compared(batches, idf, search), "a BIGINT, b BIGINT")


def best_rows(left: DataFrame, right: DataFrame, least: float, allow_self: bool = True,
              block_postings: int | None = None, tile_rows: int = TILE, idf: Idf | None = None) -> DataFrame:
    """(id, score, partner): of each left row the right row with the largest product of at least `least`;
    the lowest id among equals. Both have id, terms (ascending) and weights of unit vectors, or counts with an `idf`."""
    blocks = cut_lineage(packed(left, idf is not None, block_postings))
    if right is left:
        return best_of_blocks(blocks, blocks, least, allow_self, tile_rows, idf, half=True)
    others = cut_lineage(packed(right, idf is not None, block_postings))
    return best_of_blocks(blocks, others, least, allow_self, tile_rows, idf)


def best_of_blocks(left: DataFrame, right: DataFrame, least: float, allow_self: bool = True,
                   tile_rows: int = TILE, idf: Idf | None = None, half: bool = False) -> DataFrame:
    """The same of written blocks (`packed`). With `half` both are one table, and two blocks meet once, for the rows of
    both."""
    def firsts(rows: np.ndarray, score: np.ndarray, partners: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((partners, -score, rows))
        order = order[np.flatnonzero(np.diff(rows[order], prepend=-1))] if len(order) else order
        return rows[order], score[order], partners[order]

    def search(one: _Rows, other: _Rows) -> pa.RecordBatch:
        found = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        products = _Products(one, other, least, tile_rows)
        ours, theirs = products.left.ids, products.right.ids
        for i, j, shared, cut in products.possible():
            if not allow_self:
                apart = ours[i] != theirs[j]
                i, j, shared = i[apart], j[apart], shared[apart]
            order = np.argsort(i, kind="stable")
            i, j, shared = i[order], j[order], shared[order]
            score = products.exact(i, j, shared, cut)
            near = score >= least
            i, j, score = i[near], j[near], score[near]
            for rows, names, partners in ((i, ours, theirs[j]), (j, theirs, ours[i]))[:1 + (half and other is not one)]:
                rows, best, partner = firsts(rows, score, partners)
                found.append((names[rows], best, partner))
        ids, scores, partners = (np.concatenate(x) for x in zip(*found))
        return pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.float64()),
                                           "partner": pa.array(partners, pa.int64())})

    def each(batches):
        yield from _compared(batches, idf, search) if half else (
            search(_Rows.read(batch, at, "a", idf), _Rows.read(batch, at, "b", idf))
            for batch in batches for at in range(batch.num_rows))

    found = _pairs(left, right, half).mapInArrow(each, "id BIGINT, score DOUBLE, partner BIGINT")
    best = F.max(F.struct("score", (-F.col("partner")).alias("_p"))).alias("_best")
    return one_pair_at_once(found.groupBy("id").agg(best).select(
        "id", F.col("_best.score").alias("score"), (-F.col("_best._p")).alias("partner")))
