"""Evidence packs: a small, varied set of strong associations per dataset, and the prompt on it."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwright.plans import prompt_text
from siftwright.plans.materialize import pin

REQUIRED = {
    "var1", "var2", "type", "relationship", "test",
    "effect", "effect_name", "p_value", "adjusted_p", "n",
}

# Effect sizes from which an edge counts as large, medium or small, per pair type.
EFFECT_STEPS = {
    "num_num": (0.50, 0.30, 0.10),
    "cat_cat": (0.50, 0.30, 0.15),
    "num_cat": (0.14, 0.06, 0.03),
}
# Priority bonus per pair type.
TYPE_BONUS = {"num_num": 0.06, "num_cat": 0.04, "cat_cat": 0.03}

SCHEMA_VERSION = "2.3"
# Fixed texts of the pack.
NO_EDGES = "No associations remained after final evidence-pack pruning."
PACK_CONSTRAINTS = [
    "do_not_infer_causality",
    "do_not_use_external_facts",
    "do_not_overstate_effect_sizes",
    "prefer_non_redundant_hypotheses",
    "prefer_hypotheses_that_synthesize_multiple_edges_when_supported",
    "every_hypothesis_must_reference_at_least_one_edge",
    "every_hypothesis_must_include_a_test_plan",
]
EMPTY_CONSTRAINTS = [
    "do_not_infer_causality",
    "do_not_use_external_facts",
    "return_only_testable_hypotheses",
]
PACK_NOTES = [
    "Top edges were selected with a per-variable cap.",
    "Weight-like variables were excluded.",
    "Near-deterministic edges were excluded.",
]
NODE_FIELDS = [
    "feature_type", "dtype", "missing_rate", "n_unique", "skewness", "outlier_rate", "issues",
]


@dataclass(frozen=True)
class PackConfig:
    max_edges: int = 12
    max_vars: int = 30
    max_json_chars: int = 18_000
    near_deterministic_threshold: float = 0.95
    max_edges_per_variable: int = 3
    drop_weight_like_vars: bool = True
    drop_near_deterministic_edges: bool = True


def check_columns(df: DataFrame) -> None:
    missing = sorted((REQUIRED | {"pair_pos"}) - set(df.columns))
    if missing:
        raise ValueError(f"association table lacks columns: {missing}")


def weight_like(name: str) -> Column:
    low = F.lower(F.col(name))
    return low.contains("weight") | low.contains("fnlwgt")


def effect_bucket(kind: Column, effect: Column) -> Column:
    x = F.abs(effect)

    def steps(t: str) -> Column:
        large, medium, small = EFFECT_STEPS[t]
        return F.when(x >= large, "large").when(x >= medium, "medium").when(x >= small, "small").otherwise("tiny")

    return (
        F.when(kind == "num_num", steps("num_num"))
        .when(kind == "cat_cat", steps("cat_cat"))
        .otherwise(steps("num_cat"))
    )


def priority(cfg: PackConfig) -> Column:
    x, notes = F.abs("effect"), F.coalesce(F.col("notes"), F.lit(""))
    bonus = F.lit(0.0)
    for kind, value in TYPE_BONUS.items():
        bonus = F.when(F.col("type") == kind, value).otherwise(bonus)

    def step(cond: Column, value: float) -> Column:
        return F.when(cond, F.lit(value)).otherwise(0.0)

    return (
        x + bonus
        + step(notes.contains("nonparametric"), 0.01)
        + step(notes.contains("sparse_table"), -0.15)
        + step(effect_bucket(F.col("type"), F.col("effect")) == "small", -0.03)
        + step(weight_like("var1") | weight_like("var2"), -1.0)
        + step(x >= cfg.near_deterministic_threshold, -0.5)
    )


def candidates(kept: DataFrame, cfg: PackConfig) -> DataFrame:
    """Associations that may become edges, one per unordered pair, with `priority`."""
    check_columns(kept)
    df = kept
    if "notes" not in df.columns:
        df = df.withColumn("notes", F.lit(""))
    if cfg.drop_weight_like_vars:
        df = df.filter(~weight_like("var1") & ~weight_like("var2"))
    if cfg.drop_near_deterministic_edges:
        df = df.filter(F.abs("effect") < cfg.near_deterministic_threshold)
    fields = [
        "var1", "var2", "type", "relationship", "test", "effect", "effect_name",
        "p_value", "adjusted_p", "n", "notes",
    ]
    first = df.groupBy(
        "dataset", F.least("var1", "var2").alias("_a"), F.greatest("var1", "var2").alias("_b")
    ).agg(F.min(F.struct("pair_pos", *fields)).alias("e"))
    return first.select("dataset", "e.*").withColumn("priority", priority(cfg))


def edge_order() -> list[Column]:
    return [F.col("priority").desc(), F.col("adjusted_p").asc_nulls_last(), F.col("effect").desc(), F.col("pair_pos")]


def shortlist(df: DataFrame, cfg: PackConfig) -> DataFrame:
    """The few candidates that the degree-capped choice could ever look at, in order.

    With k edges of degree cap d at most s = 2k/d variables fill up. An edge whose variable has
    more than d - 1 + s better edges is never taken: fewer than d of those were taken and at most
    s skipped for a full partner. Dropping such edges leaves at most d + s per full variable, so
    the choice ends within the first k + s*(d + s) of the rest; the refill needs the first 2k.
    """
    k, d = cfg.max_edges, cfg.max_edges_per_variable
    full = (2 * k) // max(d, 1)
    ends = F.explode(F.array("var1", "var2")).alias("v")
    place = Window.partitionBy("dataset", "v").orderBy(*edge_order())
    low = (
        df.select("*", ends)
        .withColumn("r", F.row_number().over(place))
        .filter(F.col("r") <= d + full)
        .groupBy("dataset", "pair_pos")
        .agg(F.count(F.lit(1)).alias("sides"))
        .filter(F.col("sides") == 2)
        .select("dataset", "pair_pos", F.lit(True).alias("open"))
    )
    everywhere = Window.partitionBy("dataset").orderBy(*edge_order())
    marked = df.join(low, ["dataset", "pair_pos"], "left").withColumn("open", F.coalesce("open", F.lit(False)))
    top_open = (
        marked.filter("open").withColumn("place", F.row_number().over(everywhere))
        .filter(F.col("place") <= k + full * (d + full)).drop("place")
    )
    top_any = (
        marked.filter("not open").withColumn("place", F.row_number().over(everywhere))
        .filter(F.col("place") <= 2 * k).drop("place")
    )
    return top_open.unionByName(top_any)


def choose_edges(kept: DataFrame, config: PackConfig | None = None) -> DataFrame:
    """Degree-capped greedy choice per dataset with refill; adds `edge_no` 1..k."""
    cfg = config or PackConfig()
    # Pinned, as the shortlist reads the candidates three times.
    few = shortlist(pin(candidates(kept, cfg)), cfg).drop("open")
    out = T.StructType(few.schema.fields + [T.StructField("edge_no", T.IntegerType())])

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values(
            ["priority", "adjusted_p", "effect", "pair_pos"], ascending=[False, True, False, True]
        )
        degree: dict[str, int] = {}
        taken: list[int] = []
        for i, a, b in zip(ordered.index, ordered["var1"], ordered["var2"]):
            if len(taken) == cfg.max_edges:
                break
            if max(degree.get(a, 0), degree.get(b, 0)) < cfg.max_edges_per_variable:
                taken.append(i)
                degree[a] = degree.get(a, 0) + 1
                degree[b] = degree.get(b, 0) + 1
        if len(taken) < min(6, cfg.max_edges):
            rest = [i for i in ordered.index if i not in set(taken)]
            taken += rest[: cfg.max_edges - len(taken)]
        chosen = ordered.loc[taken].copy()
        chosen["edge_no"] = range(1, len(chosen) + 1)
        return chosen

    return pin(few.groupBy("dataset").applyInPandas(pick, out))


def edge_records(edges: DataFrame) -> DataFrame:
    """Chosen edges with the fields a pack shows."""
    kind, effect = F.col("type"), F.col("effect")
    bucket = effect_bucket(kind, effect)
    notes = F.coalesce(F.col("notes"), F.lit(""))
    weak = bucket.isin("tiny", "small")

    def tag(cond: Column, name: str) -> Column:
        return F.when(cond, F.lit(name))

    constraints = F.filter(
        F.array(
            tag(weak, "effect_is_weak_or_modest"),
            tag(weak, "do_not_overstate_strength"),
            tag((kind == "num_num") & (F.col("test") == "spearmanr"), "monotonic_not_necessarily_linear"),
            tag(kind == "num_cat", "interpret_as_group_difference"),
            tag(kind == "cat_cat", "interpret_as_category_association"),
            tag(notes.contains("sparse_table"), "chi_square_table_may_be_sparse"),
            tag(notes.contains("nonparametric"), "nonparametric_test_used"),
        ),
        lambda x: x.isNotNull(),
    )
    direction = (
        F.when((kind == "num_num") & (effect > 0), "positive")
        .when(kind == "num_num", "negative")
        .when((kind == "num_cat") & (F.col("effect_name") == "rank_biserial"),
              "group_difference_direction_depends_on_category_order")
        .when(kind == "num_cat", "group_difference")
        .otherwise("association_without_direction")
    )
    explained = F.when(kind == "num_num", F.round(effect * effect, 6)).when(
        (kind == "num_cat") & (F.col("effect_name") == "eta2_approx"), F.round(effect, 6)
    )
    return edges.select(
        "dataset", "edge_no", F.concat(F.lit("E"), F.col("edge_no")).alias("edge_id"),
        "var1", "var2", "type", "relationship", "test", F.round("effect", 6).alias("effect"),
        "effect_name", bucket.alias("effect_size"), F.col("n").cast("bigint").alias("n"),
        F.col("adjusted_p").alias("q_value"), notes.alias("notes"),
        constraints.alias("inference_constraints"), direction.alias("direction"),
        explained.alias("variance_explained_approx"),
    )


def pack_nodes(records: DataFrame, profile: DataFrame, cfg: PackConfig | None = None) -> DataFrame:
    """First `max_vars` variables of the edges by name, with their profile fields."""
    cfg = cfg or PackConfig()
    names = records.select("dataset", F.explode(F.array("var1", "var2")).alias("column")).distinct()
    place = Window.partitionBy("dataset").orderBy("column")
    return (
        names.withColumn("node_no", F.row_number().over(place))
        .filter(F.col("node_no") <= cfg.max_vars)
        .join(profile.select("dataset", "column", "outlier_method", *NODE_FIELDS), ["dataset", "column"], "left")
    )


def _assemble(dataset: str, edges_json: str | None, nodes_json: str | None, limit: int) -> str:
    """One pack as JSON text, cut to the size budget by dropping edges from the end."""
    edges = []
    for e in json.loads(edges_json or "[]"):
        e.pop("edge_no", None)
        if not e.get("inference_constraints"):
            e.pop("inference_constraints", None)
        if e.get("variance_explained_approx") is None:
            e.pop("variance_explained_approx", None)
        edges.append(e)
    if not edges:
        return json.dumps({
            "schema_version": SCHEMA_VERSION, "dataset": dataset,
            "summary": {"n_edges": 0, "n_variables": 0, "message": NO_EDGES},
            "variables": {}, "edges": [], "global_constraints": EMPTY_CONSTRAINTS, "notes": PACK_NOTES,
        }, ensure_ascii=False)
    nodes: dict[str, dict] = {}
    for n in json.loads(nodes_json or "[]"):
        shaped = n.get("outlier_method") is not None
        nodes[n["column"]] = {
            f: n.get(f) for f in NODE_FIELDS
            if n.get("feature_type") is not None and (shaped or f not in ("skewness", "outlier_rate"))
        }

    def pack(some: list, variables: dict) -> dict:
        return {
            "schema_version": SCHEMA_VERSION,
            "dataset": dataset,
            "summary": {
                "n_edges": len(some),
                "n_variables": len(variables),
                "association_types_present": sorted({e["type"] for e in some}),
                "tests_present": sorted({e["test"] for e in some}),
            },
            "variables": variables,
            "edges": some,
            "global_constraints": PACK_CONSTRAINTS,
            "notes": PACK_NOTES,
        }

    whole = pack(edges, nodes)
    if len(json.dumps(whole, ensure_ascii=False)) <= limit:
        return json.dumps(whole, ensure_ascii=False)
    size = len(json.dumps({**whole, "edges": []}, ensure_ascii=False))
    fit = 0
    for i, e in enumerate(edges):
        size += len(json.dumps(e, ensure_ascii=False)) + (2 if i else 0)
        if size > limit:
            break
        fit = i + 1
    used = {v for e in edges[:fit] for v in (e["var1"], e["var2"])}
    return json.dumps(pack(edges[:fit], {k: v for k, v in nodes.items() if k in used}), ensure_ascii=False)


def evidence_packs(
    kept: DataFrame, profile: DataFrame, config: PackConfig | None = None
) -> DataFrame:
    """One pack per dataset of `profile`: dataset, n_edges, n_variables, pack_json."""
    cfg = config or PackConfig()
    records = edge_records(choose_edges(kept, cfg))
    nodes = pack_nodes(records, profile, cfg)
    fields = [c for c in records.columns if c != "dataset"]
    edges = records.groupBy("dataset").agg(
        F.to_json(F.sort_array(F.collect_list(F.struct(*fields))), {"ignoreNullFields": "false"}).alias("edges_json")
    )
    node_fields = ["node_no", "column", "outlier_method", *NODE_FIELDS]
    node_lists = nodes.groupBy("dataset").agg(
        F.to_json(F.sort_array(F.collect_list(F.struct(*node_fields))), {"ignoreNullFields": "false"}).alias("nodes_json")
    )
    limit = cfg.max_json_chars

    @F.pandas_udf(T.StringType())
    def assemble(d: pd.Series, e: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([_assemble(*row, limit) for row in zip(d, e, n)], dtype=object)

    packs = (
        profile.select("dataset").distinct()
        .join(edges, "dataset", "left").join(node_lists, "dataset", "left")
        .select("dataset", assemble("dataset", "edges_json", "nodes_json").alias("pack_json"))
    )
    parsed = F.try_parse_json("pack_json")
    return packs.select(
        "dataset",
        F.variant_get(parsed, "$.summary.n_edges", "int").alias("n_edges"),
        F.variant_get(parsed, "$.summary.n_variables", "int").alias("n_variables"),
        "pack_json",
    )


def hypotheses_to_ask(n_edges: Column, requested: int | None = None) -> Column:
    auto = F.least(F.lit(18), F.greatest(F.lit(15), F.bround(n_edges * 1.4).cast("int")))
    if requested is None:
        return auto
    return F.least(F.lit(18), F.greatest(F.lit(15), F.least(F.lit(int(requested)), auto + 2)))


def prompts(packs: DataFrame, requested: int | None = None) -> DataFrame:
    """Prompt text per dataset."""
    count = hypotheses_to_ask(F.col("n_edges"), requested)
    head, tail = prompt_text.PROPOSE_HEAD, prompt_text.PROPOSE_TAIL
    text = F.concat(
        F.format_string(head, count), F.lit("\n\nevidence_pack:\n"), F.col("pack_json"),
        F.lit("\n\noutput_schema:\n" + prompt_text.OUTPUT_SCHEMA + "\n\n" + tail),
    )
    return packs.select("dataset", "n_edges", "n_variables", count.alias("n_hypotheses"), text.alias("prompt"))


def prompt_metadata(prompt_rows: DataFrame, config: PackConfig | None = None, requested: int | None = None) -> DataFrame:
    cfg = config or PackConfig()
    return prompt_rows.select(
        "dataset", F.col("n_edges").alias("n_edges_in_pack"), F.col("n_variables").alias("n_variables_in_pack"),
        F.lit(requested).cast("int").alias("requested_hypotheses"),
        F.length("prompt").alias("prompt_char_count"),
        F.struct(
            F.lit(cfg.max_edges).alias("max_edges"), F.lit(cfg.max_vars).alias("max_vars"),
            F.lit(cfg.max_json_chars).alias("max_json_chars"),
            F.lit(cfg.near_deterministic_threshold).alias("near_deterministic_threshold"),
            F.lit(cfg.max_edges_per_variable).alias("max_edges_per_variable"),
        ).alias("config"),
    )
