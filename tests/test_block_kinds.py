"""Pairs of two blocks whose rows are short or long, of rare or common terms, against all products."""

import numpy as np
import pyarrow as pa
import pytest

from faultsift.operators import sparse_blocks
from faultsift.operators.sparse_blocks import _Products, _Rows, one_pair_at_once


def made(rng: np.random.Generator, rows: int, names: int) -> tuple[_Rows, np.ndarray]:
    """Rows of 1 to 60 terms; half of them are near the row before them."""
    matrix = np.zeros((rows, names))
    odds = 1.0 / np.arange(names, 0, -1)                     # the last terms are common
    for i in range(rows):
        some = rng.choice(names, int(rng.integers(1, 60)), replace=False, p=odds / odds.sum())
        matrix[i, some] = rng.integers(1, 5, len(some))
        if i % 2:
            matrix[i] = matrix[i - 1]
            matrix[i, some[:2]] += 1
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    row, terms = np.nonzero(matrix)
    return _Rows(np.arange(rows) * 3, np.bincount(row), terms.astype(np.int32), matrix[row, terms]), matrix


@pytest.mark.parametrize("least", [0.01, 0.4, 0.7, 1.0])
@pytest.mark.parametrize("tile_rows, found, few", [(4_000_000, 50_000, 0.05), (3, 2, 1e9), (7, 1, 0.0)])
def test_kinds_against_all_products(monkeypatch, least, tile_rows, found, few):
    for name, value in (("FOUND", found), ("FEW", few), ("TABLE", 2000), ("SHARES", (0.1, 0.5, 1, 2, 4))):
        monkeypatch.setattr(sparse_blocks, name, value)
    rng = np.random.default_rng(8)
    (left, x), (right, y) = made(rng, 90, 300), made(rng, 70, 300)
    for ours, others, all_ in ((left, right, x @ y.T), (left, left, x @ x.T)):
        products = _Products(ours, others, least, tile_rows)
        got = {}
        for i, j, shared, cut in products.possible():
            assert (np.diff(i) >= 0).all()
            score = products.exact(i, j, shared, cut)
            for a, b, s in zip((products.left.ids[i] // 3).tolist(), (products.right.ids[j] // 3).tolist(), score):
                assert (a, b) not in got
                got[a, b] = s
        near = np.round(all_, 12) >= least
        assert {pair for pair, s in got.items() if s >= least} == set(zip(*(k.tolist() for k in np.nonzero(near))))
        assert all(s == pytest.approx(all_[pair], abs=1e-11) for pair, s in got.items())


def test_most_pairs_need_no_matrix_of_parts():
    """All pairs got one before, so time followed the square of the rows by some 40 ns a pair."""
    rng = np.random.default_rng(2)
    n, names = 400, 4000
    rows = [np.sort(rng.choice(names, 40, replace=False)).astype(np.int32) for _ in range(n)]
    block = _Rows(np.arange(n), np.full(n, 40), np.concatenate(rows), np.full(40 * n, 40 ** -0.5))
    products = _Products(block, block, 0.7, 4_000_000)
    sizes = np.diff(products.left.edges)
    parts = sum(sizes[a] * sizes[b] for a in range(len(sizes)) for b in range(len(sizes)) if products._meeting(a, b)[1] > 1)
    assert parts < 0.01 * n * n
    assert sum(len(i) for i, *_ in products.possible()) < 2 * n


def test_a_task_gets_one_pair_of_blocks_at_a_time(spark):
    """A batch took rows until it passed some 64 MB, so two pairs of 60 MB each."""
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = one_pair_at_once(spark.range(6).coalesce(1).mapInArrow(sizes, "n long"))
    assert [r["n"] for r in got.collect()] == [1] * 6
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
