"""Whole runs, stage folders and a sample of the registered queries against their SQL."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check
from siftwright.catalog.checks import hypothesis
from siftwright.operators import report as R
from siftwright.plans.pipeline import Source, discover, finish, save
from siftwright.sources.writers import StageStore

SAMPLE = [
    "split_stratified", "profile_shape", "prep_transform_new", "numnum_effects", "numcat_gaps", "catcat_chi2", "category_cap",
    "bh_large", "effect_filter", "edge_refill", "edge_records", "response_errors", "prefilter", "validate_pairwise", "ols", "logit",
    "bootstrap_spearman", "bootstrap_mwu", "bootstrap_logit", "final_status", "report_summary", "csv_roundtrip",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, small, name):
    assert ": ok" in check.compare(spark, small, name)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark, small):
    out = entry.entry(spark)
    assert {"var1", "var2", "effect", "p_value", "adjusted_p"} <= set(out.columns) and out.count() > 0


def test_run_stops_and_goes_on(spark, small, tmp_path):
    o = spark.read.parquet(f"{small}/orders.parquet").withColumn("double_price", F.col("o_totalprice") * 2 + F.col("o_custkey") * 900).withColumn("row_key", F.col("o_custkey") % 7)
    run = discover({"orders": Source(o, "o_orderkey", "o_orderstatus")})
    assert run.stopped_after == "prompt" and "results" not in run.tables
    assert run["packs"].count() == 1 and run["prompts"].count() == 1
    bad = spark.createDataFrame([("orders", "sorry")], "dataset string, response string")
    assert finish(run, bad).stopped_after == "hypotheses" and run["response_errors"].count() == 1
    text = json.dumps({"hypotheses": [
        hypothesis(1, "pearsonr", "double_price", ["o_totalprice"]), hypothesis(2, "kruskal", "o_totalprice", ["o_orderstatus"]),
    ]})
    finish(run, spark.createDataFrame([("orders", text)], "dataset string, response string"))
    status = {r["id"]: r["validation_status"] for r in run["results"].collect()}
    assert status == {"H1": "final_accepted", "H2": "failed_bh"} and run.stopped_after is None
    assert "## Accepted Hypotheses" in run["summary"].first()["summary"]
    assert "- o_totalprice: unknown" in run["summary_prompts"].first()["prompt"]
    assert R.require_accepted(run["results"]).count() == 1
    with pytest.raises(ValueError, match="No accepted"):
        R.require_accepted(run["results"].filter("id = 'H2'"))
    with pytest.raises(ValueError, match="final_accepted"):
        R.accepted(run["results"].drop("final_accepted"))
    assert {r["mode"]: r["input_rows"] for r in run["cleaning_summary"].collect()} == {"train": run["split_summary"].first()["train_rows"], "test": run["split_summary"].first()["test_rows"]}
    assert run["response_metadata"].first()["hypothesis_count"] == 2
    assert [r["id"] for r in run["hypotheses_final"].collect()] == ["H1"] and run["hypotheses_kept"].count() == 2
    store = StageStore(spark, str(tmp_path))
    assert len(save(run, store)) == len(run.tables)
    again = store.load("hypotheses", "hypotheses")
    assert again.count() == 2 and store.load("validation", "hypotheses_final").first()["id"] == "H1"
    for form in ("parquet", "csv", "json"):
        store.save("validation", f"results_{form}", run["results"], form)
    assert store.load("validation", "results_parquet").count() == 2
    with pytest.raises(ValueError, match="unknown stage"):
        store.path("nowhere", "x")
