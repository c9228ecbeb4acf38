"""Wide categories that are projected out, against the dense solution."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from siftwright.functions.weights import Weights
from siftwright.operators import absorb as A
from siftwright.operators import regression as R


def table(parts, seed=8):
    rng = np.random.default_rng(seed)
    n, size = 1500, 60
    part = rng.integers(0, parts, n)
    a, b = (part + parts * rng.integers(0, size // parts, n) for _ in range(2))
    pdf = pd.DataFrame({"h": np.arange(n), "a": a.astype(float), "b": (b // 2).astype(float), "c": rng.integers(0, 3, n).astype(float), "x": rng.normal(size=n)})
    pdf["y"] = 0.1 * pdf["x"] + 0.02 * pdf["a"] - 0.1 * pdf["b"] + 0.2 * pdf["c"] + rng.normal(size=n)
    pdf.loc[:9, "x"] = np.nan
    return pdf


TERMS = {
    "a": R.Term("a", "a", tuple(f"{i:02}" for i in range(60))), "b": R.Term("b", "b", tuple(f"{i:02}" for i in range(30))),
    "c": R.Term("c", "c", tuple("012")), "x": R.Term("x", "x", (), 0.1, 2.0),
}


@pytest.mark.parametrize("parts", [1, 3])
@pytest.mark.parametrize("columns, wanted", [("xa", "x"), ("a", "a"), ("xca", "a"), ("axbc", "x"), ("bxca", "c")])
def test_absorbed_equals_the_dense_solution(spark, monkeypatch, parts, columns, wanted):
    monkeypatch.setattr(A, "MANY", 20)
    monkeypatch.setattr(A, "CELLS", 100)
    monkeypatch.setattr(R, "WIDE", 5)
    pdf = table(parts)
    d = R.Design(3, R.Term("y", "y", (), 0.3, 1.5), tuple(TERMS[c] for c in columns), (wanted,))
    x, y, ok = d.rows(pdf)
    want = R._least_squares(R._moments(np.column_stack([ok.astype(float), x, y]), np.ones((len(pdf), 1)))[:, 0], d)
    calls = []
    monkeypatch.setattr(R, "gathered", lambda *a: calls.append(a))  # no system is put together in one task
    got = R.least_squares(spark.createDataFrame(pdf).repartition(5), [d], Weights("ones")).collect()
    assert not calls and len(got) == 1
    assert tuple(got[0][2:3]) == want[:1] and tuple(got[0][5:]) == want[3:]
    np.testing.assert_allclose(got[0][3:5], want[1:3], rtol=1e-7)


def test_collinear_columns_are_left_to_the_general_solver(spark, monkeypatch):
    monkeypatch.setattr(A, "MANY", 20)
    pdf = table(1)
    pdf["x"] = pdf["a"] // 2  # a step function of the category
    d = R.Design(3, R.Term("y", "y"), (TERMS["x"], TERMS["a"]), ("x",))
    assert A.absorbed(spark.createDataFrame(pdf), d) is None


def test_joined_levels():
    label = A.joined(9, np.array([0, 1, 2, 5, 8]), np.array([1, 2, 3, 6, 7]))
    assert label.tolist() == [0, 0, 0, 0, 4, 5, 5, 7, 7]


def test_chunks_stay_small_however_long_the_table(spark, monkeypatch):
    """20,000 cells in chunks of about 150: a chunk's size does not follow the table, and both categories together explain what a dense solution does."""
    rng = np.random.default_rng(4)
    first, second = np.repeat(np.arange(2000), 10), np.concatenate([rng.choice(300, 10, replace=False) for _ in range(2000)])
    n, y = rng.integers(1, 4, len(first)).astype(float), rng.normal(size=len(first))
    cells = spark.createDataFrame(pd.DataFrame({"k0": first, "k1": second, "n": n, "s0": n * y}))
    monkeypatch.setattr(A, "CELLS", 100)
    made, inner = [], A._chunks
    monkeypatch.setattr(A, "_chunks", lambda *a: made.append(inner(*a)) or made[-1])
    explained, rank = A._two(cells, 0)
    sizes = [len(r["local"]) // 4 for r in made[0].select("local").collect()]
    assert sum(sizes) == len(first) and max(sizes) <= 400
    x = np.zeros((len(first), 2300))
    x[np.arange(len(first)), first] = x[np.arange(len(first)), 2000 + second] = 1.0
    fit = np.linalg.lstsq((x * n[:, None]).T @ x, x.T @ (n * y), rcond=1e-10)
    assert rank == fit[2] == 2299
    np.testing.assert_allclose(explained, [[fit[0] @ (x.T @ (n * y))]], rtol=1e-9)


def test_a_chunk_is_sent_only_what_it_asks_for():
    row = SimpleNamespace(chunks=np.array([3, 9]).tobytes(), sizes=np.array([1, 2]).tobytes(), at=np.array([7, 0, 7], np.uint16).tobytes(), block=5)
    sent = pd.concat(A._dealt(row, np.arange(A.BLOCK * 2.0).reshape(-1, 2)))
    assert sent["chunk"].tolist() == [3, 9] and [np.frombuffer(v).tolist() for v in sent["v"]] == [[14.0, 15.0], [0.0, 1.0, 14.0, 15.0]]
