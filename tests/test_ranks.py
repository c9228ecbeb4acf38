"""Frequency tables, quantiles, ranks and look-ups against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftwright.operators import frequency as V
from siftwright.operators.moments import correlations
from siftwright.operators.ranks import pair_rank_correlation, pair_rank_sums, rank_rows
from siftwright.plans.lookup import attach


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small data would be merged into one range; keep all of them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def skewed():
    """A third of all rows share one value; the rest are spread out."""
    rng = np.random.default_rng(1)
    n = 3000
    a = np.where(rng.random(n) < 0.35, 0.0, rng.normal(size=n).round(2))
    b = a * 2 + rng.normal(size=n)
    return pd.DataFrame({"k": range(n), "a": a, "b": b, "c": rng.integers(0, 5, n).astype(float), "g": rng.choice(list("xyz"), n)})


def test_quantiles_match_numpy(spark, skewed):
    df = spark.createDataFrame(skewed)
    counts = V.ranged(V.numeric_counts(df, [(0, "a"), (1, "b"), (2, "c")]), ["cid"])
    edges = {}
    for r in counts.groupBy("cid", "pid").agg(F.sum("freq").alias("n")).collect():
        edges.setdefault(r["cid"], []).append((r["pid"], r["n"]))
    assert counts.select("pid").distinct().count() > 1
    probs = [0.0, 0.025, 0.25, 0.5, 0.75, 1.0]
    got = V.quantiles(counts, edges, probs)
    for cid, c in enumerate("abc"):
        assert got[cid] == pytest.approx(np.quantile(skewed[c], probs), rel=1e-12)


def test_frequencies_add_up(spark, skewed):
    df = spark.createDataFrame(skewed)
    assert V.numeric_counts(df, [(0, "a"), (1, "c")]).groupBy("cid").agg(F.sum("freq").alias("n")).toPandas()["n"].tolist() == [3000, 3000]


@pytest.mark.parametrize("domain", [0, 1_024, 10_000])
def test_mid_ranks_over_many_ranges(spark, skewed, monkeypatch, domain):
    monkeypatch.setattr("siftwright.operators.ranks.SMALL_DOMAIN", domain)
    df = spark.createDataFrame(skewed)
    code = F.when(F.col("g") == "x", 0).when(F.col("g") == "y", 1).otherwise(2)
    table, ties = rank_rows(df.withColumnRenamed("k", "rid"), {0: "a", 1: "b"}, {0: code})
    got = table.toPandas().sort_values("rid")
    assert got["g0"].tolist() == skewed["g"].map({"x": 0, "y": 1, "z": 2}).tolist()
    assert np.allclose(got["r0"], skewed["a"].rank()) and np.allclose(got["r1"], skewed["b"].rank())
    t = skewed["a"].value_counts()
    assert {r["cid"]: r["ties"] for r in ties.collect()}[0] == (t**3 - t).sum()


@pytest.mark.parametrize("budget", [1, 10, 100_000])
def test_attach_gives_the_same_rows_for_any_budget(spark, skewed, budget):
    rows = spark.createDataFrame(skewed).select("k", F.col("a").alias("value"))
    table = rows.groupBy("value").agg(F.count(F.lit(1)).alias("freq"), F.max("k").alias("top"))
    out = attach(rows, table, ["value"], "freq", budget=budget).toPandas()
    want = skewed.groupby("a")["k"].max()
    assert len(out) == 3000 and (out["top"].to_numpy() == want.loc[out["value"]].to_numpy()).all()


def test_pair_ranks_with_gaps(spark, skewed):
    pdf = skewed.assign(b=skewed["b"].where(skewed["k"] % 4 > 0))
    rows = spark.createDataFrame(pdf).filter(~F.isnan("b")).select(F.lit(0).alias("pos"), F.col("a").alias("x"), F.col("b").alias("y"))
    r = pair_rank_correlation(rows).first()
    ok = pdf.dropna()
    assert r["n"] == len(ok) and r["r"] == pytest.approx(ok["a"].rank().corr(ok["b"].rank()), rel=1e-10)


def test_rank_sums_per_group(spark, skewed):
    rows = spark.createDataFrame(skewed).select(F.lit(3).alias("pos"), F.col("a").alias("y"), F.col("g").alias("level"))
    sums, _ = pair_rank_sums(rows)
    want = skewed.assign(r=skewed["a"].rank()).groupby("g")["r"].sum()
    assert {r["level"]: r["rank_sum"] for r in sums.collect()} == pytest.approx(want.to_dict())


def test_correlations_agree_and_constant_columns_have_none(spark, skewed, monkeypatch):
    pdf = skewed.assign(z=0.1, b=skewed["b"].where(skewed["k"] % 3 > 0))
    df = spark.createDataFrame(pdf).withColumn("b", F.when(~F.isnan("b"), F.col("b")))
    pairs = [(0, "a", "b"), (1, "a", "c"), (2, "a", "z")]
    built = {r["pos"]: r for r in correlations(df, pairs).collect()}
    monkeypatch.setattr("siftwright.operators.moments.BUILT_IN_PAIRS", 0)
    matrix = {r["pos"]: r for r in correlations(df, pairs).collect()}
    for got in (built, matrix):
        assert got[2]["r"] is None
        assert got[0]["n"] == 2000 and got[0]["r"] == pytest.approx(pdf["a"].corr(pdf["b"]), rel=1e-10)
    assert built[1]["r"] == pytest.approx(matrix[1]["r"], rel=1e-10)
