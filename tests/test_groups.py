"""Dense sums by level against plain counting."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftwright.operators import groups
from siftwright.operators.profile import profile
from siftwright.operators.screen import ScreenConfig, screen


def table(n=3000, cats=4, nums=3, seed=1):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({f"k{c}": rng.integers(0, c + 2, n).astype(float) for c in range(cats)} | {f"x{j}": rng.normal(size=n) for j in range(nums)})
    pdf["k1"] = pdf["k1"].where(rng.random(n) > 0.1)
    pdf["x1"] = pdf["x1"].where(rng.random(n) > 0.2)
    return pdf


@pytest.fixture
def small_batches(monkeypatch):
    monkeypatch.setattr(groups, "BATCH_CELLS", 3000)


def as_spark(spark, pdf):
    rows = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), ", ".join(f"{c} double" for c in pdf.columns))
    return rows.select(*[F.col(c).cast("int" if c[0] == "k" else "double").alias(c) for c in pdf.columns]).repartition(5)


def test_level_sums(spark, small_batches):
    pdf = table()
    codes = {c: (F.col(f"k{c}"), c + 2) for c in range(4)}
    got = {(r.cat, r.code, r.num): (r.n_g, r.s, r.ss) for r in groups.level_sums(as_spark(spark, pdf), codes, {j: F.col(f"x{j}") for j in range(3)}).collect()}
    for c in range(4):
        for k in range(c + 2):
            for j in range(3):
                x = pdf.loc[pdf[f"k{c}"] == k, f"x{j}"].dropna()
                assert got[c, k, j] == pytest.approx((len(x), x.sum(), (x**2).sum()))
    assert len(got) == 3 * (2 + 3 + 4 + 5)


@pytest.mark.parametrize("scan", [1 << 23, 15])
def test_pair_tables(spark, small_batches, monkeypatch, scan):
    monkeypatch.setattr(groups, "SCAN_CELLS", scan)
    pdf = table()
    pairs = [(10 + 4 * a + b, a, b) for a in range(4) for b in range(a + 1, 4)]
    got = {(r.pos, r.a, r.b): r.o for r in groups.pair_tables(as_spark(spark, pdf), {c: (F.col(f"k{c}"), c + 2) for c in range(4)}, pairs).collect()}
    want = {}
    for pos, a, b in pairs:
        for (x, y), n in pdf.groupby([f"k{a}", f"k{b}"]).size().items():
            want[pos, int(x), int(y)] = n
    assert got == want


def test_three_hundred_columns(spark):
    """Every pair of 300 categories in one scan, and the tables are right."""
    rng = np.random.default_rng(5)
    data = rng.integers(0, 3, (400, 300))
    df = spark.createDataFrame(pd.DataFrame(data.astype(str), columns=[f"k{i:03}" for i in range(300)])).repartition(4)
    codes = {i: (F.col(f"k{i:03}").cast("int"), 3) for i in range(300)}
    pairs = [(a * 300 + b, a, b) for a in range(300) for b in range(a + 1, 300)]
    cells = groups.pair_tables(df, codes, pairs)
    assert cells.agg(F.sum("o")).first()[0] == 400 * len(pairs)
    some = {(r.pos, r.a, r.b): r.o for r in cells.filter(F.col("pos").isin(5, 299, 17 * 300 + 200)).collect()}
    for pos in (5, 299, 17 * 300 + 200):
        a, b = divmod(pos, 300)
        for x in range(3):
            for y in range(3):
                assert some.get((pos, x, y), 0) == ((data[:, a] == x) & (data[:, b] == y)).sum()


def test_screen_with_levels_over_the_cap_and_gaps(spark):
    """Categories within the cap take the dense way, others the one by keys; both give what a screen of one pair gives."""
    rng = np.random.default_rng(8)
    n = 400
    pdf = pd.DataFrame({"x0": rng.normal(size=n), "x1": rng.exponential(size=n), "few": rng.choice(list("abc"), n), "two": rng.choice(["u", "v"], n), "many": [f"m{i % 9}" for i in range(n)]})
    pdf["part"] = [f"p{i % 12}" if i % 3 else f"q{i}" for i in range(n)]  # over the cap unless x0 is there
    pdf.loc[pdf.index % 3 == 0, "x0"] = np.nan
    pdf.loc[pdf.index % 7 == 0, "few"] = None
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "x0 double, x1 double, few string, two string, many string, part string")
    cfg = ScreenConfig(max_categories=15)
    facts = profile(df)
    both = {(r.var1, r.var2): r for r in screen(df, facts, config=cfg).collect()}
    for (a, b), r in both.items():
        alone = {(x.var1, x.var2): x for x in screen(df.select(*[c for c in df.columns if c in (a, b)]), facts, config=cfg).collect()}[a, b]
        assert (r.test, r.n, r.notes, r.effect) == (alone.test, alone.n, alone.notes, pytest.approx(alone.effect) if alone.effect is not None else None)
    assert both["x0", "part"].test == "kruskal" and both["x1", "part"].test == "skipped"
