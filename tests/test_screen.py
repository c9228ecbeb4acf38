"""Pair screening, false discovery rate and effect filter."""

import csv
import glob

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftwright import schemas
from siftwright.operators import screen as S
from siftwright.operators.fdr import adjust, adjust_large, correct
from siftwright.operators.profile import profile
from siftwright.operators.screen import screen, wants_ranks, ScreenConfig
from siftwright.sources.readers import read_associations, read_profile


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    n = 600
    x = rng.normal(size=n).round(3)
    pdf = pd.DataFrame({
        "x": x, "y": (x + rng.normal(size=n)).round(3), "e": np.exp(2 * x).round(4), "ab": np.where(x + rng.normal(size=n) > 0, "b", "a"),
        "cat": rng.choice(["p", "q", "r", "s"], n), "rare": ["one"] + ["two", "three"] * (n // 2 - 1) + ["two"],
        "many": [f"v{i % 31}" for i in range(n)], "thirty": [f"w{i % 30}" for i in range(n)],
    })
    return pdf, spark.createDataFrame(pdf)


def _rows(df):
    return {(r["var1"], r["var2"]): r for r in df.collect()}


def test_effects_match_pandas(frame):
    pdf, df = frame
    got = _rows(screen(df, profile(df)))
    assert got["x", "y"]["test"] == "pearsonr"
    assert got["x", "y"]["effect"] == pytest.approx(pdf["x"].corr(pdf["y"]), rel=1e-10)
    assert got["x", "e"]["test"] == "spearmanr"
    assert got["x", "e"]["effect"] == pytest.approx(pdf["x"].rank().corr(pdf["e"].rank()), rel=1e-10)
    r = pdf["x"].rank()
    a, b = r[pdf["ab"] == "a"], r[pdf["ab"] == "b"]
    u = a.sum() - len(a) * (len(a) + 1) / 2
    assert got["x", "ab"]["effect"] == pytest.approx(1 - 2 * u / len(a) / len(b), rel=1e-10)
    groups = [g for _, g in pdf.groupby("cat")["y"]]
    between = sum(len(g) * (g.mean() - pdf["y"].mean()) ** 2 for g in groups)
    assert got["y", "cat"]["effect"] == pytest.approx(between / ((pdf["y"] - pdf["y"].mean()) ** 2).sum(), rel=1e-9)


def test_caps_and_group_sizes(frame):
    pdf, df = frame
    got = _rows(screen(df, profile(df)))
    assert got["x", "many"]["test"] == "skipped" and got["x", "many"]["notes"] == "too_many_categories_31"
    assert got["many", "thirty"]["notes"] == "too_many_categories_31x30" and got["many", "thirty"]["p_value"] is None
    assert got["x", "thirty"]["test"] == "kruskal"
    assert ("x", "rare") not in got
    assert got["ab", "thirty"]["notes"] == ""
    for a in ("cat", "rare"):
        expected = np.outer(pdf[a].value_counts(), pdf["thirty"].value_counts()) / len(pdf)
        note = "sparse_table_expected_counts_low" if (expected < 5).mean() > 0.2 else ""
        assert got[a, "thirty"]["notes"] == note
    assert got["rare", "thirty"]["notes"] != ""


def test_result_does_not_depend_on_partitions(frame):
    _, df = frame
    p = profile(df)
    one = screen(df, p).drop("pair_pos").toPandas().sort_values(["var1", "var2"]).reset_index(drop=True)
    two = screen(df.repartition(7), p).drop("pair_pos").toPandas().sort_values(["var1", "var2"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(one, two, rtol=1e-9)


def test_too_few_rows_give_no_pairs(frame):
    _, df = frame
    few = df.limit(29)
    assert screen(few, profile(df)).count() == 0


def test_gaps_rank_inside_complete_cases(frame):
    pdf, df = frame
    holes = df.withColumn("x", F.when(F.col("x") > -0.5, F.col("x"))).withColumn("ab", F.when(F.col("y") > -1, F.col("ab")))
    got = _rows(screen(holes, profile(df)))
    ok = pdf[pdf["x"] > -0.5]
    assert got["x", "e"]["n"] == len(ok)
    assert got["x", "e"]["effect"] == pytest.approx(ok["x"].rank().corr(ok["e"].rank()), rel=1e-10)
    ok = pdf[(pdf["x"] > -0.5) & (pdf["y"] > -1)]
    r = ok["x"].rank()
    a, b = r[ok["ab"] == "a"], r[ok["ab"] == "b"]
    u = a.sum() - len(a) * (len(a) + 1) / 2
    assert got["x", "ab"]["effect"] == pytest.approx(1 - 2 * u / len(a) / len(b), rel=1e-10)


def _bh(p):
    order = np.argsort(p)
    q = np.minimum(1, p[order] * len(p) / np.arange(1, len(p) + 1))
    out = np.empty(len(p))
    out[order] = np.minimum.accumulate(q[::-1])[::-1]
    return out


@pytest.mark.parametrize("fn", [adjust, adjust_large])
def test_q_values(spark, fn):
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.random(300) ** 3, np.ones(150), [0.0, 1.0, 0.01, 0.01, 0.01]])
    pdf = pd.DataFrame({"dataset": "d", "i": range(len(p)), "p_value": p})
    bad = pd.DataFrame({"dataset": "d", "i": [-1, -2, -3], "p_value": [None, float("nan"), float("inf")]})
    df = spark.createDataFrame(pd.concat([pdf, bad], ignore_index=True))
    got = fn(df).toPandas().set_index("i")["adjusted_p"]
    assert np.allclose(got.loc[range(len(p))], _bh(p), rtol=1e-12)
    assert got.loc[[-1, -2, -3]].isna().all()


def test_recorded_screens(spark, recorded):
    """q-values, kept rows and test choice of all recorded runs."""
    for path in sorted(glob.glob(f"{recorded}/*/associations/*_all_associations_fdr.csv")):
        name = path.split("/")[-3]
        raw = read_associations(spark, path, name)
        full, kept = correct(raw.drop("adjusted_p", "significant"))
        want = {r["pair_pos"]: r for r in raw.collect()}
        for r in full.collect():
            w = want[r["pair_pos"]]
            if w["adjusted_p"] is None:
                assert r["adjusted_p"] is None and not r["significant"]
            else:
                assert r["adjusted_p"] == pytest.approx(w["adjusted_p"], rel=1e-12) and r["significant"] == w["significant"]
        filtered = [(r["var1"], r["var2"]) for r in csv.DictReader(open(path.replace("all_associations_fdr", "associations_filtered")))]
        assert [(r["var1"], r["var2"]) for r in kept.orderBy("pair_pos").collect()] == filtered
        facts = {r["column"]: r.asDict() for r in read_profile(spark, f"{recorded}/{name}/preprocess/{name}_train_profile.json").collect()}
        for r in want.values():
            if r["type"] == "num_num":
                assert wants_ranks(facts[r["var1"]], facts[r["var2"]], ScreenConfig()) == (r["test"] == "spearmanr")


def test_missing_association_file_is_an_empty_table(spark, tmp_path):
    assert read_associations(spark, str(tmp_path / "none.csv"), "d").count() == 0
    (tmp_path / "part.csv").write_text("var1,var2,type,n\na,b,num_num,40.0\n")
    r = read_associations(spark, str(tmp_path / "part.csv"), "d").first()
    assert (r["n"], r["p_value"], r["pair_pos"]) == (40, None, 0)


def test_empty_input_keeps_the_layout(spark):
    full, kept = correct(spark.createDataFrame([], schemas.ASSOCIATIONS))
    assert full.count() == kept.count() == 0 and "adjusted_p" in kept.columns


def test_constant_number_is_no_pair(spark):
    df = spark.createDataFrame([(1.0, 1.0, "a"), (1.0, 2.0, "b"), (3.0, 2.0, None)], "x double, y double, c string")
    pairs = [(0, "x", "c", 2, 0, 2), (1, "y", "c", 2, 0, 2)]
    assert S._varying(df, pairs, width=1) == pairs[1:] and S._varying(df, []) == []
