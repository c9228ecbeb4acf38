"""Profile, cleaning and split."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftwright.operators.prep import Prep, PrepModel, with_policy
from siftwright.operators.profile import ProfileConfig, ingest, normalize_names, profile
from siftwright.operators.split import split_summary, train_test_split
from siftwright.sources.readers import read_csv, read_profile, read_state
from siftwright.streaming.cleaning import write_clean


@pytest.fixture(scope="module")
def mixed(spark):
    """Forty rows with one column of each kind."""
    n = 40
    rows = [
        (
            i, f"id{i}", i % 2 == 0, "ab"[i % 2], float(i % 7), i * 1.5 + (i % 3) * 0.1, f"t{i % 25}", f"c{i % 4}", 7, None,
            float("nan") if i % 2 else 1.0 * (i % 9), 5.0 if i else 9.0, None if i > 3 else float(i), "x" if i < 20 else None,
        )
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows, "key long, name string, flag boolean, pair string, few double, many double, high string, low string, "
        "same int, nothing double, gaps double, flat double, four double, half string",
    )


def test_feature_types(mixed):
    p = {r["column"]: r for r in profile(mixed).collect()}
    kinds = {c: r["feature_type"] for c, r in p.items()}
    assert kinds == {
        "key": "id_like", "name": "id_like", "flag": "binary", "pair": "binary", "few": "numeric_ordinal",
        "many": "numeric_continuous", "high": "categorical_high_cardinality", "low": "categorical_low_cardinality",
        "same": "constant", "nothing": "constant", "gaps": "numeric_ordinal", "flat": "binary", "four": "id_like", "half": "constant",
    }
    assert p["gaps"]["missing_rate"] == 0.5 and p["gaps"]["issues"] == ["high_missing"]
    assert p["nothing"]["issues"] == ["constant", "high_missing"] and p["nothing"]["n_unique"] == 0
    assert p["flat"]["outlier_confidence"] == "iqr_zero" and p["flat"]["outlier_rate"] == 0.0 and p["flat"]["lower_bound"] is None
    assert p["many"]["skewness"] == pytest.approx(mixed.toPandas()["many"].skew(), abs=1e-6)


def test_few_values_have_no_fences(spark):
    df = spark.createDataFrame([(1.5,), (2.5,), (2.5,), (9.25,)], "v double")
    r = profile(df, config=ProfileConfig(id_like_unique_ratio=2.0)).first()
    assert (r["outlier_confidence"], r["outlier_rate"], r["lower_bound"]) == ("low_n", None, None)


def test_names():
    assert normalize_names([" A b ", "C%d", "x_1"]) == ["a_b", "cd", "x_1"]
    with pytest.raises(ValueError, match="collide"):
        normalize_names(["a b", "A_b"])


def test_nested_columns_are_refused_or_skipped(spark):
    df = spark.createDataFrame([(1, [1.0])], "a int, v array<double>")
    with pytest.raises(ValueError, match="nested"):
        ingest(df)
    assert ingest(df, "skip").columns == ["a"]


def test_fit_and_transform(mixed):
    model = Prep().fit(mixed, "m")
    rules = {r["column"]: r for r in model.rules}
    assert rules["key"]["drop_actions"] == ["dropped_id_like"]
    assert rules["nothing"]["drop_actions"] == ["dropped_constant", "dropped_high_missing"]
    assert rules["low"]["imputation"]["str_value"] == "missing"
    out = model.transform(mixed)
    assert out.columns == model.output_columns()
    assert out.filter(F.col("pair").isNull()).count() == 0
    keep = with_policy(Prep(), drop_high_missing=False, drop_constant=False).fit(mixed)
    assert "gaps__is_missing" in keep.output_columns()
    log = {r["name"]: r for r in keep.transform_log(keep.transform(mixed)).collect()}
    assert log["flat__is_outlier"]["status"] == "skipped_no_bounds"


def test_train_state_on_new_layout(spark, mixed):
    model = Prep().fit(mixed.withColumn("gaps", F.when(F.col("key") % 5 != 0, F.col("many"))), "m")
    new = spark.createDataFrame([("bad", "q", 1e6)], "few string, low string, many double")
    r = model.transform(new).first()
    assert r["few"] == {x["column"]: x for x in model.rules}["few"]["imputation"]["num_value"]
    assert (r["high"], r["low"], r["many__is_outlier"], r["gaps__is_missing"]) == ("missing", "q", 1, 1)


def test_state_needs_a_path(spark):
    with pytest.raises(ValueError, match="state"):
        PrepModel.load(spark, None)


def test_stream_equals_batch(spark, small, tmp_path):
    orders = spark.read.parquet(f"{small}/orders.parquet")
    model = Prep().fit(orders, "orders")
    stream = spark.readStream.schema(orders.schema).option("pathGlobFilter", "orders.parquet").parquet(small)
    write_clean(stream, model, str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.exceptAll(model.transform(orders)).isEmpty() and got.count() == orders.count()


def test_recorded_red_wine_cleaning(spark, recorded):
    base = f"{recorded}/wine_quality_red"
    model = PrepModel(read_state(spark, f"{base}/preprocess/wine_quality_red_train_preprocessing_state.json").collect())
    raw = read_csv(spark, f"{base}/data/wine_quality_red_test.csv")
    clean = model.transform(raw)
    log = {r["name"]: r for r in model.transform_log(clean).collect()}
    want = json.load(open(f"{base}/preprocess/wine_quality_red_test_transform_log.json"))
    for name, w in want["engineered"].items():
        assert log[name]["outlier_rate_on_transformed"] == pytest.approx(w["outlier_rate_on_transformed"], abs=1e-12)
    summary = json.load(open(f"{base}/preprocess/wine_quality_red_test_preprocess_summary.json"))
    s = model.summary(raw, clean, "transform_only").first()
    assert (s["output_rows"], s["output_cols"], s["engineered_columns"]) == (summary["output_rows"], summary["output_cols"], summary["engineered_columns"])


@pytest.mark.parametrize("name", ["adult_income", "credit_card_default", "wine_quality_white"])
def test_recorded_states_follow_from_profiles(spark, recorded, name):
    base = f"{recorded}/{name}/preprocess/{name}_train"
    rows = read_profile(spark, f"{base}_profile.json").collect()
    state = {r["column"]: r for r in read_state(spark, f"{base}_preprocessing_state.json").collect()}
    facts = spark.createDataFrame(
        [{**r.asDict(), "numeric": r["dtype"] != "object", "mean": 0.0, "median": 0.0} for r in rows],
        "column string, position int, feature_type string, dtype string, missing_rate double, skewness double, "
        "outlier_rate double, lower_bound double, upper_bound double, numeric boolean, mean double, median double",
    )
    for r in Prep().rules(facts, name).collect():
        s = state[r["column"]]
        assert (r["drop"], r["drop_actions"], r["add_missing_indicator"]) == (s["drop"], s["drop_actions"], s["add_missing_indicator"])
        if not r["drop"]:
            assert r["imputation"]["method"] == s["imputation"]["method"]


def test_split_sizes_and_repeatability(spark, small):
    orders = spark.read.parquet(f"{small}/orders.parquet")
    n = orders.count()
    one = train_test_split(orders, "o_orderkey")
    s = split_summary(one).first()
    assert s["test_rows"] == -(-n * 3 // 10) and s["train_rows"] + s["test_rows"] == n
    again = train_test_split(orders.repartition(5), "o_orderkey")
    assert one.select("o_orderkey", "split").exceptAll(again.select("o_orderkey", "split")).isEmpty()
    other = train_test_split(orders, "o_orderkey", seed=7)
    assert not one.select("o_orderkey", "split").exceptAll(other.select("o_orderkey", "split")).isEmpty()


def test_stratified_split_keeps_shares(spark, small):
    orders = spark.read.parquet(f"{small}/orders.parquet")
    pdf = train_test_split(orders, "o_orderkey", stratify="o_orderstatus").toPandas()
    assert (pdf["split"] == "test").sum() == -(-len(pdf) * 3 // 10)
    share = pdf.groupby("o_orderstatus")["split"].apply(lambda s: (s == "test").mean())
    assert (share - 0.3).abs().max() < 0.01
    with pytest.raises(ValueError, match="Stratify"):
        train_test_split(orders, "o_orderkey", stratify="nope")


def test_csv_tokens_and_types(spark, tmp_path):
    pd.DataFrame({"a": [1, 2, 3], "b": ["1.5", "NA", "2"], "c": ["x", "?", "nan"], "d": ["True", "False", ""]}).to_csv(tmp_path / "t.csv", index=False)
    df = read_csv(spark, str(tmp_path / "t.csv"), na_values=["?"])
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "string", "d": "boolean"}
    assert [tuple(r) for r in df.collect()] == [(1, 1.5, "x", True), (2, None, None, False), (3, 2.0, None, None)]


def test_allotments_of_a_million_strata(spark):
    """Largest remainders against a plain sort; most strata tie, so their names decide."""
    import math

    import numpy as np
    from pyspark.sql import functions as F

    from siftwright.operators.split import allotments

    strata = spark.range(1_000_000).select(F.concat(F.lit("s"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("s"), (1 + F.col("id") % 5 * (F.col("id") % 2)).alias("n"))
    got = allotments(strata.repartition(6), 0.3).toPandas().sort_values("s")
    n = got["n"].to_numpy()
    want = math.ceil(n.sum() * 0.3)
    ideal = n * want / n.sum()
    base = np.floor(ideal)
    order = np.lexsort((np.arange(len(n)), -(ideal - base)))
    more = np.zeros(len(n))
    more[order[: int(want - base.sum())]] = 1
    assert got["k"].sum() == want and (got["k"].to_numpy() == base + more).all()
    assert allotments(strata.limit(0), 0.3).count() == 0
