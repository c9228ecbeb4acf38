"""Regressions on text columns of thousands of levels."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftwright.functions.weights import Weights
from siftwright.operators import regression as R
from siftwright.operators import validate as V
from siftwright.operators.sparse_solve import Reduced, least_p
from siftwright.operators.validate import Bench, Spec, ValidationConfig


def sample(missing_base, doubled, seed=4):
    rng = np.random.default_rng(seed)
    n = 600
    pdf = pd.DataFrame({"a": rng.integers(1 if missing_base else 0, 40, n).astype(float), "b": rng.integers(0, 4, n).astype(float), "x": rng.normal(size=n)})
    pdf["x2"] = 2 * pdf["x"]
    pdf["y"] = pdf["x"] + 0.1 * pdf["a"] + rng.normal(size=n)
    pdf["z"] = (pdf["x"] + rng.logistic(size=n) > 0).astype(float)
    pdf.loc[:5, "x"] = np.nan
    terms = [R.Term("x", "x"), R.Term("a", "a", tuple(f"{i:02}" for i in range(40))), R.Term("b", "b", tuple("0123"))]
    return pdf, tuple(terms + [R.Term("x2", "x2")] * doubled), rng.poisson(1.0, (n, 1))


def sums(d, pdf, w):
    columns, values, y, _ = d.entries(pdf)
    q = d.width() + 2
    got = R.Sums()
    for part in (pdf.index < 200, (pdf.index >= 200) & (pdf.index < 210), pdf.index >= 210):
        cells = R._pairs(np.column_stack([columns, np.full(len(y), q - 1)])[part], np.column_stack([values, y])[part], q)
        row = next(R._sparse(1, [cells], [w[part]])).iloc[0]
        got.add(row["k"], row["s"])
    return got.places()


@pytest.mark.parametrize("missing_base", [False, True])
@pytest.mark.parametrize("doubled", [0, 1])
@pytest.mark.parametrize("wanted", ["x", "a", "b"])
def test_sparse_equals_the_dense_solution(monkeypatch, missing_base, doubled, wanted):
    monkeypatch.setattr(R, "KEPT_SUMS", 50)
    pdf, terms, w = sample(missing_base, doubled)
    d = R.Design(1, R.Term("y", "y"), terms, (wanted,))
    x, y, ok = d.rows(pdf)
    dense = R._moments(np.column_stack([ok.astype(float), x, y]), w.astype(float))[:, 0]
    k, s = sums(d, pdf, w)
    filled = np.zeros(len(dense))
    filled[k] = s
    np.testing.assert_allclose(filled, dense, rtol=1e-10, atol=1e-10)
    want, found = R._least_squares(dense, d), R._wide_least_squares(k, s, d)
    assert found[3:] == want[3:]
    np.testing.assert_allclose(found[:3], want[:3], rtol=1e-7, atol=1e-300)


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_two_categories_that_fall_into_parts(parts):
    """Levels of two categories that meet only within parts: as many directions without an estimate as parts, less one."""
    rng = np.random.default_rng(parts)
    n, size = 900, 84
    part = rng.integers(0, parts, n)
    a, b = (part + parts * rng.integers(0, size // parts, n) for _ in range(2))
    pdf = pd.DataFrame({"a": a.astype(float), "b": b.astype(float), "x": rng.normal(size=n)})
    pdf["y"] = pdf["x"] + 0.2 * pdf["a"] - 0.1 * pdf["b"] + rng.normal(size=n)
    levels = tuple(f"{i:02}" for i in range(size))
    d = R.Design(1, R.Term("y", "y"), (R.Term("a", "a", levels), R.Term("x", "x"), R.Term("b", "b", levels)), ("a", "x"))
    x, y, ok = d.rows(pdf)
    w = np.ones((n, 1))
    want = R._least_squares(R._moments(np.column_stack([ok.astype(float), x, y]), w)[:, 0], d)
    found = R._wide_least_squares(*sums(d, pdf, w), d)
    assert found[3:] == want[3:]
    np.testing.assert_allclose(found[:3], want[:3], rtol=1e-6, atol=1e-300)


def test_solver_against_the_generalised_inverse():
    rng = np.random.default_rng(3)
    for null in (0, 1, 5, 20):
        n, inner = 60, 25
        z = rng.normal(size=(200, n)) * (rng.random((200, n)) < 0.2)
        z[:, :inner] = np.eye(inner)[rng.integers(0, inner, 200)]
        for c in range(null):
            z[:, n - 1 - c] = z[:, inner + c] * 2 + z[:, c]
        m = z.T @ z
        i, j = np.nonzero(np.triu(m))
        block = np.arange(n) < inner
        system = Reduced(i, j, m[i, j], np.ones(n, bool), block, np.ones(n))
        assert system.null.shape[1] == n - np.linalg.matrix_rank(m)
        assert np.abs(m @ system.null).max(initial=0) < 1e-6
        right = m @ rng.normal(size=(n, 3))
        np.testing.assert_allclose(m @ system.solve(right), right, atol=1e-6 * np.abs(right).max())


def test_least_p_looks_at_few_columns():
    rng = np.random.default_rng(4)
    for zero in (False, True):
        for _ in range(50):
            n = 200
            spread = rng.uniform(1, 3, n)
            b = rng.normal(size=n) * np.where(rng.random(n) < 0.1, 60 if zero else 6, 1)
            wanted = rng.random(n) < 0.8
            seen = []
            p_of = lambda t2: R.normal_two_sided(np.sqrt(t2))
            got = least_p(b, wanted, np.ones(n), lambda c: seen.extend(c) or spread[c], p_of, 1.0)
            p = [p_of(b[c] ** 2 / spread[c]) if wanted[c] else 2 for c in range(n)]
            assert got == (int(np.argmin(p)), min(p)) and len(seen) <= 80


def levels_frame(spark):
    """2,100 levels of four rows; level i has i % 3 + 1 ones, and level 5 stands out in y."""
    rows = []
    for i in range(2100):
        for k in range(4):
            rows.append((4 * i + k, f"k{i:04}", float(k < i % 3 + 1), float(i % 7) + 10.0 * k + (50.0 if i == 5 else 0.0)))
    return spark.createDataFrame(rows, "id bigint, level string, z double, y double")


def test_wide_columns_get_an_estimate(spark):
    specs = [Spec(0, "linear_regression", "y", ("level",), ()), Spec(1, "logistic_regression", "z", ("level",), ())]
    out = {r.pos: r for r in Bench(levels_frame(spark), specs, "id", ValidationConfig()).results().collect()}
    assert [out[i].notes for i in (0, 1)] == ["", ""] and out[0].n == out[1].n == 8400
    at = int(out[0].main_predictor_column.removeprefix("level_k"))
    assert at == 5 and out[0].effect == pytest.approx(55.0)
    assert out[0].p_value < 1e-6
    at = int(out[1].main_predictor_column.removeprefix("level_k"))  # odds of level 0 are 1:3
    assert out[1].effect == pytest.approx(np.log((at % 3 + 1) / (3 - at % 3)) + np.log(3), rel=1e-6)
    assert 0 < out[1].p_value < 1


def test_level_codes_follow_the_order_of_levels(spark):
    rows = [(c, f"v{i * 37 % 501:03}{'é' * (i % 2)}", i) for c, size in ((0, 500), (3, 1), (4, 77)) for i in range(size)]
    got = V.level_codes(spark.createDataFrame(rows, "cid int, level string, n bigint").repartition(7)).collect()
    for c in (0, 3, 4):
        mine = sorted((r.code, r.level) for r in got if r.cid == c)
        assert [m[0] for m in mine] == list(range(len(mine)))
        assert [m[1] for m in mine] == sorted((r[1] for r in rows if r[0] == c), key=lambda v: v.encode())


def two_wide(spark, n=3000, levels=150, seed=6):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"id": np.arange(n), "a": [f"a{i:03}" for i in rng.integers(0, levels, n)], "b": [f"b{i:03}" for i in rng.integers(0, levels, n)], "x": rng.normal(size=n)})
    pdf["y"] = 0.4 * pdf["x"] + pdf["a"].str[1:].astype(float) / 60 + rng.normal(size=n)
    pdf["z"] = (0.8 * pdf["x"] + 0.2 * rng.logistic(size=n) + rng.normal(size=n) > 0).astype(float)
    return spark.createDataFrame(pdf)


def test_narrow_and_wide_ways_agree_also_under_resampling(spark, monkeypatch):
    """The same hypotheses with all columns coded in Spark and solved sparsely, and with small dense systems."""
    df = two_wide(spark, levels=40)
    specs = [Spec(0, "linear_regression", "y", ("x",), ("a", "b")), Spec(1, "linear_regression", "y", ("a",), ("b",)),
             Spec(2, "logistic_regression", "z", ("x",), ("a", "b")), Spec(3, "logistic_regression", "z", ("a", "x"), ())]

    def both():
        bench = Bench(df, specs, "id", ValidationConfig())
        plain = {r.pos: r for r in bench.results().collect()}
        drawn = {(r.pos, r.rep): r for r in bench.replicates(Weights("poisson", 6), {0, 1, 2, 3}).collect()}
        return plain, drawn

    plain, drawn = both()
    monkeypatch.setattr(V, "JOINED_LEVELS", 3)
    monkeypatch.setattr(R, "WIDE", 1)
    monkeypatch.setattr(R, "FLUSH_ROWS", 300)
    monkeypatch.setattr(R, "BLOCK", 16)
    wide, wide_drawn = both()
    assert plain.keys() == wide.keys() and drawn.keys() == wide_drawn.keys() and len(drawn) == 24
    for k in plain:
        assert (plain[k].n, plain[k].main_predictor_column, plain[k].notes) == (wide[k].n, wide[k].main_predictor_column, wide[k].notes)
        assert wide[k].effect == pytest.approx(plain[k].effect, rel=1e-6) and wide[k].p_value == pytest.approx(plain[k].p_value, rel=1e-5)
    for k in drawn:
        assert wide_drawn[k].main_column == drawn[k].main_column and wide_drawn[k].effect == pytest.approx(drawn[k].effect, rel=1e-6)


def test_wide_designs_without_an_estimate(spark):
    rows = [(i, f"k{i}", float(i % 2), 1.0) for i in range(1500)]
    df = spark.createDataFrame(rows, "id bigint, level string, z double, one double")
    specs = [Spec(0, "linear_regression", "z", ("level",), ()), Spec(1, "logistic_regression", "z", ("level",), ()), Spec(2, "linear_regression", "z", ("one",), ("level",))]
    out = {r.pos: r for r in Bench(df, specs, "id", ValidationConfig()).results().collect()}
    assert out[1].notes in ("", R.SINGULAR)  # separated completely: no finite estimate to reach
    assert out[2].notes == "no_predictor_columns_in_design_matrix"
    assert out[0].notes == "" and out[0].p_value is None or np.isnan(out[0].p_value)
    none = Bench(df.filter(F.col("id") < 0), specs, "id", ValidationConfig()).results().collect()
    assert all(not r.testable for r in none)
