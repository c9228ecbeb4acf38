"""Validation, regressions and resampling."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftwright.functions.weights import POISSON_CDF, Weights, row_hash
from siftwright.operators import bootstrap as B
from siftwright.operators import intake, validate as C
from siftwright.operators.prep import PrepModel
from siftwright.sources.readers import read_csv, read_hypotheses, read_state


@pytest.fixture(scope="module")
def held_out(spark):
    rng = np.random.default_rng(9)
    n = 900
    x = rng.normal(size=n).round(2)
    y = (x + rng.normal(size=n)).round(1)
    z = np.where(rng.random(n) < 0.35, 0.0, y + rng.normal(size=n)).round(2)
    pdf = pd.DataFrame({
        "k": np.arange(n), "x": x, "y": y, "z": z, "g": np.where(x + rng.normal(size=n) > 0, "v", "u"),
        "c": rng.choice(["a", "b", "d"], n), "one": 1.5, "sep": np.where(x > 0, "hi", "lo"), "bit": (y > 0).astype(int),
    })
    return pdf, spark.createDataFrame(pdf)


def _weights(spark, pdf, reps):
    w = Weights("poisson", reps, 42)
    keyed = spark.createDataFrame(pdf[["k"]]).select("k", row_hash(F.col("k"), 42).alias("h")).toPandas().sort_values("k")
    return w, w.matrix(keyed["h"].to_numpy())


def test_poisson_weights(spark, held_out):
    pdf, _ = held_out
    _, m = _weights(spark, pdf, 40)
    assert m.shape == (900, 40) and abs(m.mean() - 1) < 0.02 and abs(m.var() - 1) < 0.05
    assert abs((m == 0).mean() - POISSON_CDF[0]) < 0.02
    assert abs(np.corrcoef(m[:, 0], m[:, 1])[0, 1]) < 0.1


def _expand(pdf, w):
    return pdf.loc[pdf.index.repeat(w)].reset_index(drop=True)


SPECS = [
    C.Spec(0, "pearsonr", "y", ("x",), ()), C.Spec(1, "spearmanr", "z", ("y",), ()), C.Spec(2, "mannwhitneyu", "z", ("g",), ()),
    C.Spec(3, "kruskal", "z", ("c",), ()), C.Spec(4, "chi2", "g", ("c",), ()), C.Spec(5, "linear_regression", "y", ("x",), ("z",)),
]


def _effect(spec, d):
    y, x = d[spec.outcome], d[spec.predictors[0]]
    if spec.test == "pearsonr":
        return x.corr(y)
    if spec.test == "spearmanr":
        return x.rank().corr(y.rank())
    if spec.test == "mannwhitneyu":
        r = y.rank()
        a, b = r[x == "u"], r[x == "v"]
        return 1 - 2 * (a.sum() - len(a) * (len(a) + 1) / 2) / len(a) / len(b)
    if spec.test == "kruskal":
        return sum(len(g) * (g.mean() - y.mean()) ** 2 for _, g in y.groupby(x)) / ((y - y.mean()) ** 2).sum()
    if spec.test == "chi2":
        o = pd.crosstab(y, x).to_numpy()
        e = np.outer(o.sum(1), o.sum(0)) / o.sum()
        return math.sqrt(((o - e) ** 2 / e).sum() / o.sum() / (min(o.shape) - 1))
    m = np.column_stack([np.ones(len(d)), d["x"], d["z"]])
    return np.linalg.lstsq(m, y, rcond=None)[0][1]


@pytest.mark.parametrize("rows_per_range", [50_000, 60])
def test_replicates_match_brute_force(spark, held_out, monkeypatch, rows_per_range):
    """Many small ranges: values that a third of the rows share reach over several of them."""
    monkeypatch.setattr(B, "RANGE_ROWS", rows_per_range)
    pdf, df = held_out
    reps = 4
    weights, m = _weights(spark, pdf, reps)
    got = C.Bench(df, SPECS, "k", C.ValidationConfig()).replicates(weights, {s.pos for s in SPECS}).toPandas()
    assert len(got) == reps * len(SPECS)
    for r in got.itertuples():
        want = _effect(SPECS[r.pos], _expand(pdf, m[:, r.rep]))
        assert r.effect == pytest.approx(want, rel=1e-9), (r.pos, r.rep)


def test_plain_effects(spark, held_out):
    pdf, df = held_out
    got = {r["pos"]: r for r in C.Bench(df.repartition(5), SPECS, None, C.ValidationConfig()).results().collect()}
    for s in SPECS:
        assert got[s.pos]["testable"] and got[s.pos]["effect"] == pytest.approx(_effect(s, pdf), rel=1e-9)


def test_untestable_cases_say_why(spark, held_out):
    pdf, df = held_out
    tiny = df.withColumn("rare", F.when(F.col("k") == 0, "q").otherwise("p")).withColumn("void", F.lit(None).cast("string"))
    cases = {
        "insufficient_variation_for_pearson": C.Spec(0, "pearsonr", "y", ("one",), ()),
        "insufficient_variation_for_spearman": C.Spec(1, "spearmanr", "one", ("y",), ()),
        "mannwhitneyu_requires_exactly_2_groups": C.Spec(2, "mannwhitneyu", "y", ("c",), ()),
        "mannwhitneyu_groups_too_small": C.Spec(3, "mannwhitneyu", "y", ("rare",), ()),
        "kruskal_groups_too_small": C.Spec(4, "kruskal", "y", ("rare",), ()),
        "kruskal_outcome_constant": C.Spec(5, "kruskal", "one", ("c",), ()),
        "kruskal_requires_2_or_more_groups": C.Spec(6, "kruskal", "g", ("c",), ()),
        "no_complete_cases": C.Spec(7, "chi2", "g", ("void",), ()),
        "all_predictor_columns_constant": C.Spec(8, "linear_regression", "y", ("one",), ()),
        "empty_design_matrix": C.Spec(9, "linear_regression", "y", ("void",), ()),
        "non_numeric_outcome_not_binary": C.Spec(10, "logistic_regression", "c", ("x",), ()),
    }
    rows = {r["pos"]: r for r in C.Bench(tiny, list(cases.values()), "k", C.ValidationConfig()).results().collect()}
    assert {k: (rows[s.pos]["testable"], rows[s.pos]["notes"]) for k, s in cases.items()} == {k: (False, k) for k in cases}


def test_least_squares_with_categories(spark, held_out):
    pdf, df = held_out
    spec = C.Spec(0, "linear_regression", "y", ("c", "x"), ("g",))
    r = C.Bench(df, [spec], "k", C.ValidationConfig()).results().first()
    m = np.column_stack([np.ones(len(pdf)), pdf["c"] == "b", pdf["c"] == "d", pdf["x"], pdf["g"] == "v"]).astype(float)
    b, res, *_ = np.linalg.lstsq(m, pdf["y"], rcond=None)
    assert r["main_predictor_column"] == "x" and r["effect"] == pytest.approx(b[3], rel=1e-9)
    t = b[3] / math.sqrt(res[0] / (len(pdf) - 5) * np.linalg.inv(m.T @ m)[3, 3])
    assert r["p_value"] == pytest.approx(math.erfc(t / math.sqrt(2)), rel=0.2)


def test_logistic_regression(spark, held_out):
    pdf, df = held_out
    specs = [C.Spec(0, "logistic_regression", "g", ("x",), ("z",)), C.Spec(1, "logistic_regression", "bit", ("x",), ()), C.Spec(2, "logistic_regression", "sep", ("x",), ())]
    got = {r["pos"]: r for r in C.Bench(df, specs, "k", C.ValidationConfig()).results().collect()}
    m = np.column_stack([np.ones(len(pdf)), pdf["x"], pdf["z"]])
    y, b = (pdf["g"] == "v").to_numpy(float), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-m @ b))
        h = (m * (p * (1 - p))[:, None]).T @ m
        b = b + np.linalg.solve(h, m.T @ (y - p))
    z = b[1] / math.sqrt(np.linalg.inv(h)[1, 1])
    assert got[0]["effect"] == pytest.approx(b[1], rel=1e-8)
    assert got[0]["p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-6)
    assert got[1]["testable"]
    assert not got[2]["testable"] or abs(got[2]["effect"]) > 5
    strict = C.Bench(df, [specs[1]], "k", C.ValidationConfig(strict_parity=True)).results().first()
    assert strict["notes"] == "logistic_regression_requires_binary_outcome"


@pytest.mark.parametrize("weights,tolerance", [("index", 1e-9), ("poisson", 0.2)])
def test_recorded_red_wine_validation(spark, recorded, weights, tolerance):
    """The recorded run: every number with its own draws, the same verdicts with hashed weights."""
    base, name = f"{recorded}/wine_quality_red", "wine_quality_red_train"
    model = PrepModel(read_state(spark, f"{base}/preprocess/{name}_preprocessing_state.json").collect())
    pdf = read_csv(spark, f"{base}/data/wine_quality_red_test.csv").toPandas()
    pdf["rownum"] = range(len(pdf))
    clean = model.transform(spark.createDataFrame(pdf), keep=("rownum",))
    hyps, errors = read_hypotheses(spark, f"{base}/hypotheses/{name}_hypothesis_raw.txt", name)
    assert errors.isEmpty()
    v = C.validate(clean, hyps, name, C.ValidationConfig(weights=weights), key="rownum")
    got = v.results.toPandas().set_index("id")
    want = pd.read_csv(f"{base}/validation/{name}_validation_results.csv").set_index("id")
    assert list(got.sort_values("pos").index) == list(want.index)
    for i, w in want.iterrows():
        g = got.loc[i]
        for c in ("testable", "observed_test", "validation_status", "final_accepted", "bh_significant", "effect_name"):
            assert g[c] == w[c], (i, c)
        assert g["effect"] == pytest.approx(w["effect"], rel=1e-9) and g["adjusted_p"] == pytest.approx(w["adjusted_p"], rel=1e-7)
        if w["validated"]:
            for c in ("bootstrap_ci_low", "bootstrap_ci_high", "bootstrap_median_effect", "bootstrap_sign_consistency", "bootstrap_effect_pass_rate"):
                assert g[c] == pytest.approx(w[c], rel=tolerance), (i, c)
    s = v.summary.first()
    assert (s["generated_hypotheses_raw"], s["testable_hypotheses"], s["validated_hypotheses_before_bootstrap"], s["final_accepted_hypotheses"]) == (17, 17, 15, 14)
    assert v.hypotheses("final").count() == 14 and v.hypotheses("validated").count() == 15


def test_empty_batch(spark, held_out):
    _, df = held_out
    none, _ = intake.parse(spark.createDataFrame([("d", '{"hypotheses": []}')], "dataset string, response string"))
    v = C.validate(df, none, "d", key="k")
    assert v.results.count() == 0 and "final_accepted" in v.results.columns and v.rejected.count() == 0


def test_two_valued_columns(spark):
    df = spark.createDataFrame([(1, "a", "p", 1.0), (2, "b", None, None), (2, "a", "q", 3.0)], "n int, t string, h string, d double")
    assert C.two_valued(df, ["n", "t", "h", "d"]) == ["n", "t", "d"]
