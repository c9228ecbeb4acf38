"""Evidence packs and response intake."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from siftwright import schemas
from siftwright.operators import evidence as E
from siftwright.operators import intake
from siftwright.sources.readers import read_associations, read_profile


def test_recorded_packs(spark, recorded):
    kept = profiles = None
    names = sorted(p.split("/")[-3] for p in glob.glob(f"{recorded}/*/prompt/*_evidence_pack.json"))
    for n in names:
        k = read_associations(spark, f"{recorded}/{n}/associations/{n}_train_associations_filtered.csv", f"{n}_train")
        p = read_profile(spark, f"{recorded}/{n}/preprocess/{n}_train_profile.json", f"{n}_train")
        kept, profiles = (k, p) if kept is None else (kept.unionByName(k), profiles.unionByName(p))
    packs = {r["dataset"][:-6]: json.loads(r["pack_json"]) for r in E.evidence_packs(kept, profiles).collect()}
    for n in names:
        want = json.load(open(f"{recorded}/{n}/prompt/{n}_train_evidence_pack.json"))
        got = packs[n]
        for e, w in zip(got["edges"], want["edges"], strict=True):
            w["notes"] = "" if w["notes"] == "nan" else w["notes"]
            assert e.pop("q_value") == pytest.approx(w.pop("q_value"), rel=1e-13)
        assert got == want


def _links(spark, rows):
    data = [("d", a, b, "num_num", "linear", "pearsonr", e, "r", 0.001, 100, "", 0.001, True, i) for i, (a, b, e) in enumerate(rows)]
    return spark.createDataFrame(data, schemas.FDR + ", pair_pos int")


def test_degree_cap_and_refill(spark):
    star = _links(spark, [("hub", f"v{i}", 0.9 - i / 100) for i in range(10)])
    got = E.choose_edges(star).orderBy("edge_no").collect()
    assert [r["var2"] for r in got] == [f"v{i}" for i in range(10)]
    many = _links(spark, [("hub", f"v{i}", 0.9 - i / 1000) for i in range(40)] + [(f"a{i}", f"b{i}", 0.4) for i in range(9)])
    got = [(r["var1"], r["var2"]) for r in E.choose_edges(many).orderBy("edge_no").collect()]
    assert got == [("hub", "v0"), ("hub", "v1"), ("hub", "v2")] + [(f"a{i}", f"b{i}") for i in range(9)]


def test_shortlist_never_changes_the_choice(spark):
    import random

    rng = random.Random(11)
    rows = [(f"x{min(i % 17, 3)}", f"y{j}", rng.uniform(-0.94, 0.94)) for i in range(17) for j in range(30)]
    kept = _links(spark, rows)
    cand = E.candidates(kept, E.PackConfig())
    assert E.shortlist(cand, E.PackConfig()).count() < cand.count()
    order = sorted(cand.collect(), key=lambda r: (-r["priority"], r["adjusted_p"], -r["effect"], r["pair_pos"]))
    degree, want = {}, []
    for r in order:
        if len(want) < 12 and degree.get(r["var1"], 0) < 3 and degree.get(r["var2"], 0) < 3:
            want.append(r["pair_pos"])
            for v in (r["var1"], r["var2"]):
                degree[v] = degree.get(v, 0) + 1
    assert [r["pair_pos"] for r in E.choose_edges(kept).orderBy("edge_no").collect()] == want


def test_repeated_pairs_weights_and_near_copies_are_left_out(spark):
    kept = _links(spark, [("a", "b", 0.5), ("b", "a", 0.9), ("a", "Weight_kg", 0.8), ("fnlwgt", "c", 0.7), ("c", "d", -0.96)])
    assert [(r["var1"], r["effect"]) for r in E.choose_edges(kept).collect()] == [("a", 0.5)]
    with pytest.raises(ValueError, match="'adjusted_p', 'p_value'"):
        E.candidates(kept.drop("p_value", "adjusted_p"), E.PackConfig())


def test_budget_cuts_edges_from_the_end(spark):
    kept = _links(spark, [(f"a{i}", f"b{i}", 0.9 - i / 100) for i in range(10)])
    prof = spark.createDataFrame([("d", f"{s}{i}", "numeric_continuous", "float64", 0.0, 9, 0.1, 0.0, "iqr", []) for s in "ab" for i in range(10)],
                                 "dataset string, column string, feature_type string, dtype string, missing_rate double, n_unique long, skewness double, outlier_rate double, outlier_method string, issues array<string>")
    whole = json.loads(E.evidence_packs(kept, prof).first()["pack_json"])
    for limit in (4000, 5000, 6000):
        got = json.loads(E.evidence_packs(kept, prof, E.PackConfig(max_json_chars=limit)).first()["pack_json"])
        k = max(i for i in range(11) if len(json.dumps({**whole, "edges": whole["edges"][:i]}, ensure_ascii=False)) <= limit)
        assert got["edges"] == whole["edges"][:k] and got["summary"]["n_edges"] == k
        assert set(got["variables"]) == {v for e in got["edges"] for v in (e["var1"], e["var2"])}


def test_number_of_hypotheses(spark):
    n = spark.range(0, 25).select(F.col("id").cast("int").alias("n"))
    got = n.select("n", E.hypotheses_to_ask(F.col("n")).alias("a"), E.hypotheses_to_ask(F.col("n"), 16).alias("b")).collect()
    for r in got:
        auto = min(18, max(15, int(round(r["n"] * 1.4))))
        assert (r["a"], r["b"]) == (auto, min(18, max(15, min(16, auto + 2))))


def test_recorded_responses(spark, recorded):
    files = sorted(glob.glob(f"{recorded}/*/hypotheses/*_hypothesis_raw.txt"))
    rows = [(p.split("/")[-3], open(p).read()) for p in files]
    err = open(f"{recorded}/california_housing/hypotheses/california_housing_train_hypothesis_error.txt").read()
    head, raw = err.split("\n\nRAW OUTPUT:\n", 1)
    good, bad = intake.parse(spark.createDataFrame([*rows, ("broken", raw)], "dataset string, response string"))
    counts = {r["dataset"]: r["count"] for r in good.groupBy("dataset").count().collect()}
    for name, text in rows:
        assert counts[name] == len(json.loads(text)["hypotheses"])
    assert [(r["dataset"], r["error"], r["raw_output"]) for r in bad.collect()] == [("broken", head, raw)]


def test_faults_are_named(spark):
    h = {"id": "H1", "variables": ["a", "b"], "relationship_type": "x", "direction": "positive", "claim": "c", "supporting_evidence": [],
         "test_plan": {"primary_test": "chi2", "null_hypothesis": "n", "alpha": 0.05, "multiple_testing": "BH"}, "risk_flags": []}
    cases = {
        "ok": (json.dumps({"hypotheses": [h]}), None),
        "prose": ("Sure! " + json.dumps({"hypotheses": [h]}) + " Bye.", None),
        "none": ("no json here", intake.NOT_JSON),
        "list": ("[1, 2]", intake.NOT_JSON),
        "nolist": ('{"hypotheses": {}}', "ValueError: Output must contain a 'hypotheses' list."),
        "number": ('{"hypotheses": [3]}', "ValueError: Hypothesis 1 is not an object."),
        "keys": (json.dumps({"hypotheses": [h, {"id": "x"}]}), "ValueError: Hypothesis 2 missing keys: ['claim', 'direction', 'relationship_type', 'risk_flags', 'supporting_evidence', 'test_plan', 'variables']"),
        "kind": (json.dumps({"hypotheses": [{**h, "risk_flags": "[none]"}]}), "ValueError: Hypothesis 1 'risk_flags' must be a list."),
        "plan": (json.dumps({"hypotheses": [{**h, "test_plan": []}]}), "ValueError: Hypothesis 1 test_plan must be an object."),
        "plankeys": (json.dumps({"hypotheses": [{**h, "test_plan": {"alpha": 1}}]}), "ValueError: Hypothesis 1 test_plan missing keys: ['multiple_testing', 'null_hypothesis', 'primary_test']"),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "dataset string, response string")
    got = {r["dataset"]: r["error"] for r in intake.check(df).select("dataset", "error").collect()}
    assert got == {k: v[1] for k, v in cases.items()}


def test_repeated_keys_and_bare_nan_are_read(spark):
    texts = [
        ("a", '{"hypotheses": [1], "hypotheses": []}'), ("b", 'Here: {"hypotheses": [], "score": NaN} done'),
        ("c", '{"hypotheses": [}'), ("d", None), ("e", ""), ("f", "[NaN]"),
    ]
    rows = intake.check(spark.createDataFrame(texts, "dataset string, response string")).collect()
    errors = {r["dataset"]: r["error"] for r in rows}
    assert errors["a"] is None and errors["b"] is None
    assert all(errors[k] == intake.NOT_JSON for k in "cdef")
