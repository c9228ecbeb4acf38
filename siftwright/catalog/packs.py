"""Queries on evidence packs, prompts and the intake of responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.catalog.base import PART_LINKS, digits, part_links, query, sales, table
from siftwright.catalog.pairs import KEPT
from siftwright.operators import evidence as E
from siftwright.operators import intake
from siftwright.operators.fdr import correct
from siftwright.operators.prep import Prep
from siftwright.operators.screen import screen_and_correct


def _kept(spark, sf) -> DataFrame:
    return correct(part_links(spark, sf), large=True)[1]


BUCKET = """CASE type WHEN 'num_num' THEN CASE WHEN abs(effect) >= 0.5 THEN 'large' WHEN abs(effect) >= 0.3 THEN 'medium' WHEN abs(effect) >= 0.1 THEN 'small' ELSE 'tiny' END
  WHEN 'cat_cat' THEN CASE WHEN abs(effect) >= 0.5 THEN 'large' WHEN abs(effect) >= 0.3 THEN 'medium' WHEN abs(effect) >= 0.15 THEN 'small' ELSE 'tiny' END
  ELSE CASE WHEN abs(effect) >= 0.14 THEN 'large' WHEN abs(effect) >= 0.06 THEN 'medium' WHEN abs(effect) >= 0.03 THEN 'small' ELSE 'tiny' END END"""
WEIGHTY = "(var1 LIKE '%weight%' OR var2 LIKE '%weight%' OR var1 LIKE '%fnlwgt%' OR var2 LIKE '%fnlwgt%')"
PRIORITY = f"""abs(effect) + CASE type WHEN 'num_num' THEN 0.06 WHEN 'num_cat' THEN 0.04 ELSE 0.03 END::DOUBLE
  + CASE WHEN notes LIKE '%nonparametric%' THEN 0.01 ELSE 0 END::DOUBLE + CASE WHEN notes LIKE '%sparse_table%' THEN -0.15 ELSE 0 END::DOUBLE
  + CASE WHEN ({BUCKET}) = 'small' THEN -0.03 ELSE 0 END::DOUBLE"""
CANDIDATES = f"""{KEPT}, candidates AS (SELECT *, {PRIORITY} AS priority FROM kept WHERE NOT {WEIGHTY} AND abs(effect) < 0.95
  QUALIFY row_number() OVER (PARTITION BY dataset, least(var1, var2), greatest(var1, var2) ORDER BY pair_pos) = 1)"""
ORDER = "priority DESC, adjusted_p ASC NULLS LAST, effect DESC, pair_pos"


def greedy_sql(source: str, cap: int = 3, size: int = 12, least: int = 6) -> str:
    """Degree-capped choice as a recursion over the ordered edges of each dataset."""
    return f"""ord AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY {ORDER}) AS i FROM {source}),
walk AS (SELECT DISTINCT dataset, 0::BIGINT AS i, []::BIGINT[] AS taken, []::VARCHAR[] AS ends FROM ord
  UNION ALL SELECT w.dataset, o.i,
    CASE WHEN len(list_filter(ends, lambda x: x = o.var1)) < {cap} AND len(list_filter(ends, lambda x: x = o.var2)) < {cap} AND len(taken) < {size} THEN list_append(taken, o.i) ELSE taken END,
    CASE WHEN len(list_filter(ends, lambda x: x = o.var1)) < {cap} AND len(list_filter(ends, lambda x: x = o.var2)) < {cap} AND len(taken) < {size} THEN list_concat(ends, [o.var1, o.var2]) ELSE ends END
  FROM walk w JOIN ord o ON o.dataset = w.dataset AND o.i = w.i + 1),
final AS (SELECT dataset, taken FROM walk QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY i DESC) = 1),
first_pick AS (SELECT o.*, list_position(taken, o.i)::BIGINT AS edge_no, len(taken) AS k FROM ord o JOIN final USING (dataset) WHERE list_contains(taken, o.i)),
refill AS (SELECT o.*, len(taken) + row_number() OVER (PARTITION BY o.dataset ORDER BY o.i) AS edge_no, len(taken) AS k FROM ord o JOIN final USING (dataset)
  WHERE NOT list_contains(taken, o.i) AND len(taken) < {least} QUALIFY edge_no <= {size}),
edges AS (SELECT * FROM first_pick UNION ALL SELECT * FROM refill)"""


@query("edge_priority", f"WITH {CANDIDATES} SELECT dataset, pair_pos, {BUCKET} AS bucket, round(priority, 9) AS priority FROM candidates")
def _(spark, sf):
    c = E.candidates(_kept(spark, sf), E.PackConfig())
    return digits(c.select("dataset", "pair_pos", E.effect_bucket(F.col("type"), F.col("effect")).alias("bucket"), "priority"))


@query("edge_topk", f"WITH RECURSIVE {CANDIDATES}, {greedy_sql('candidates')} SELECT dataset, edge_no::INTEGER AS edge_no, pair_pos FROM edges")
def _(spark, sf):
    return E.choose_edges(_kept(spark, sf)).select("dataset", "edge_no", "pair_pos")


# One variable in every edge: the degree cap leaves three, so the refill must fill up to twelve.
STAR = f"""{CANDIDATES}, star AS (SELECT * REPLACE ('hub' AS var1, var1 || '/' || var2 AS var2) FROM candidates)"""


@query("edge_refill", f"WITH RECURSIVE {STAR}, {greedy_sql('star')} SELECT dataset, edge_no::INTEGER AS edge_no, pair_pos FROM edges")
def _(spark, sf):
    star = (
        E.candidates(_kept(spark, sf), E.PackConfig()).drop("priority")
        .withColumn("var2", F.concat_ws("/", "var1", "var2")).withColumn("var1", F.lit("hub"))
    )
    return E.choose_edges(star).select("dataset", "edge_no", "pair_pos")


@query("edge_records", f"""WITH RECURSIVE {CANDIDATES}, {greedy_sql('candidates')}
SELECT dataset, 'E' || edge_no AS edge_id, var1, var2, round(effect, 6) AS effect, {BUCKET} AS effect_size, n, round(adjusted_p, 9) AS q_value,
  CASE WHEN type = 'num_num' THEN CASE WHEN effect > 0 THEN 'positive' ELSE 'negative' END WHEN type = 'num_cat' AND effect_name = 'rank_biserial' THEN 'group_difference_direction_depends_on_category_order'
    WHEN type = 'num_cat' THEN 'group_difference' ELSE 'association_without_direction' END AS direction,
  CASE WHEN type = 'num_num' THEN round(effect * effect, 6) WHEN type = 'num_cat' AND effect_name = 'eta2_approx' THEN round(effect, 6) END AS variance_explained_approx,
  concat_ws(',', CASE WHEN ({BUCKET}) IN ('tiny', 'small') THEN 'effect_is_weak_or_modest,do_not_overstate_strength' END,
    CASE WHEN type = 'num_num' AND test = 'spearmanr' THEN 'monotonic_not_necessarily_linear' END, CASE WHEN type = 'num_cat' THEN 'interpret_as_group_difference' END,
    CASE WHEN type = 'cat_cat' THEN 'interpret_as_category_association' END, CASE WHEN notes LIKE '%sparse_table%' THEN 'chi_square_table_may_be_sparse' END,
    CASE WHEN notes LIKE '%nonparametric%' THEN 'nonparametric_test_used' END) AS constraints FROM edges""")
def _(spark, sf):
    r = E.edge_records(E.choose_edges(_kept(spark, sf)))
    return digits(r.select(
        "dataset", "edge_id", "var1", "var2", "effect", "effect_size", "n", "q_value", "direction",
        "variance_explained_approx", F.array_join("inference_constraints", ",").alias("constraints"),
    ))


def _profile_like(links: DataFrame) -> DataFrame:
    """A profile row per variable of the link table."""
    v = links.select("dataset", F.explode(F.array("var1", "var2")).alias("column"), "n").groupBy("dataset", "column").agg(F.count(F.lit(1)).alias("n_unique"))
    return v.select(
        "dataset", "column", F.lit("numeric_continuous").alias("feature_type"), F.lit("float64").alias("dtype"),
        F.lit(0.0).alias("missing_rate"), "n_unique", F.lit(0.5).alias("skewness"), F.lit(0.0).alias("outlier_rate"),
        F.lit("iqr").alias("outlier_method"), F.array().cast("array<string>").alias("issues"),
    )


@query("pack_nodes", f"""WITH RECURSIVE {CANDIDATES}, {greedy_sql('candidates')},
seen AS (SELECT dataset, name, count(*) AS n_unique FROM (SELECT dataset, var1 AS name FROM part_links UNION ALL SELECT dataset, var2 FROM part_links) GROUP BY ALL)
SELECT dataset, name AS "column", row_number() OVER (PARTITION BY dataset ORDER BY name)::INTEGER AS node_no, 'numeric_continuous' AS feature_type, 'float64' AS dtype,
  0.0::DOUBLE AS missing_rate, n_unique, 0.5::DOUBLE AS skewness, 0.0::DOUBLE AS outlier_rate, 'iqr' AS outlier_method FROM
  (SELECT dataset, var1 AS name FROM edges UNION SELECT dataset, var2 FROM edges) JOIN seen USING (dataset, name) QUALIFY node_no <= 5""")
def _(spark, sf):
    """First variables by name, each with its profile."""
    links = part_links(spark, sf)
    records = E.edge_records(E.choose_edges(_kept(spark, sf)))
    return E.pack_nodes(records, _profile_like(links), E.PackConfig(max_vars=5)).drop("issues")


@query("evidence_packs", f"""WITH RECURSIVE {CANDIDATES}, {greedy_sql('candidates')}
SELECT dataset, count(*)::INTEGER AS n_edges, (SELECT count(DISTINCT v) FROM (SELECT dataset AS d, var1 AS v FROM edges UNION SELECT dataset, var2 FROM edges) WHERE d = dataset)::INTEGER AS n_variables,
  string_agg(DISTINCT test, ',' ORDER BY test) AS tests, string_agg(var1 || '~' || var2, ',' ORDER BY edge_no) AS pairs FROM edges GROUP BY dataset""")
def _(spark, sf):
    links = part_links(spark, sf)
    packs = E.evidence_packs(correct(links, large=True)[1], _profile_like(links))
    doc = F.try_parse_json("pack_json")
    names = F.transform(F.variant_get(doc, "$.edges", "array<struct<var1:string,var2:string>>"), lambda e: F.concat(e["var1"], F.lit("~"), e["var2"]))
    return packs.select(
        "dataset", "n_edges", "n_variables", F.array_join(F.variant_get(doc, "$.summary.tests_present", "array<string>"), ",").alias("tests"),
        F.array_join(names, ",").alias("pairs"),
    )


@query("pack_budget")
def _(spark, sf):
    """Packs cut to a small size budget: a prefix of the edges and only their variables."""
    links = part_links(spark, sf)
    packs = E.evidence_packs(correct(links, large=True)[1], _profile_like(links), E.PackConfig(max_json_chars=6000))
    return packs.select("dataset", "n_edges", "n_variables", F.length("pack_json").alias("chars"))


@query("pack_empty", f"""WITH {PART_LINKS} SELECT dataset, 0::INTEGER AS n_edges, 'No associations remained after final evidence-pack pruning.' AS message FROM part_links GROUP BY 1""")
def _(spark, sf):
    links = part_links(spark, sf)
    none = correct(links, large=True)[1].filter(F.abs("effect") > 2)
    packs = E.evidence_packs(none, _profile_like(links))
    return packs.select("dataset", "n_edges", F.variant_get(F.try_parse_json("pack_json"), "$.summary.message", "string").alias("message"))


@query("hypotheses_to_ask", """SELECT o_orderkey, least(18, greatest(15, round_even((o_orderkey % 20) * 1.4, 0)))::INTEGER AS auto,
  least(18, greatest(15, least(17, least(18, greatest(15, round_even((o_orderkey % 20) * 1.4, 0))) + 2)))::INTEGER AS asked FROM orders""")
def _(spark, sf):
    n = (F.col("o_orderkey") % 20).cast("int")
    return table(spark, sf, "orders").select("o_orderkey", E.hypotheses_to_ask(n).alias("auto"), E.hypotheses_to_ask(n, 17).alias("asked"))


@query("prompts")
def _(spark, sf):
    """Pack and prompt of the joined sales table, end to end."""
    df = sales(spark, sf).drop("o_orderkey")
    model = Prep().fit(df, "sales")
    _, kept = screen_and_correct(model.transform(df), model.profile, "sales")
    rows = E.prompts(E.evidence_packs(kept, model.profile))
    return E.prompt_metadata(rows).drop("config")


# ---- intake -------------------------------------------------------------------------------------
#
# Responses made from conversations: one response per conversation, one hypothesis per turn.
# By conversation number some are wrapped in prose, cut off, not JSON, or lack a key.


def responses(spark, sf) -> DataFrame:
    c = table(spark, sf, "conversations")
    kind = F.col("conv_id") % 8
    plan = F.to_json(F.struct(
        F.when(F.col("turn") % 2 == 0, "pearsonr").otherwise("chi2").alias("primary_test"), F.lit("none").alias("null_hypothesis"),
        F.lit(0.05).alias("alpha"), F.when((kind != 5) | (F.col("turn") != 1), "BH").alias("multiple_testing"),
    ))
    item = F.concat(
        F.lit('{"id": "H'), F.col("turn").cast("string"), F.lit('", "variables": '), F.when((kind == 6) & (F.col("turn") == 0), F.lit('"text"')).otherwise(F.lit('["a", "b"]')),
        F.lit(', "relationship_type": "association", "direction": "positive", "claim": '), F.to_json(F.struct(F.col("text").alias("t"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("text").alias("t")))) - 6),
        F.lit(', "supporting_evidence": ["E1"], "test_plan": '), plan,
        F.when((kind == 4) & (F.col("turn") == 1), F.lit("")).otherwise(F.lit(', "risk_flags": []')), F.lit("}"),
    )
    # Every hypothesis text stays a row until here; a response is as long as its conversation.
    one = c.select("conv_id", "turn", kind.alias("kind"), item.alias("item")).groupBy("conv_id", "kind").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "item"))), lambda x: x["item"]), ", ").alias("items")
    )
    body = F.concat(F.lit('{"hypotheses": ['), F.col("items"), F.lit("]}"))
    text = (
        F.when(F.col("kind") == 1, F.concat(F.lit("Here you are:\n"), body, F.lit("\nDone.")))
        .when(F.col("kind") == 2, F.lit("I cannot help with that."))
        .when(F.col("kind") == 3, F.concat(F.lit('{"result": ['), F.col("items"), F.lit("]}")))
        .when(F.col("kind") == 7, F.substring(body, F.lit(1), F.length(body) - 2))
        .otherwise(body)
    )
    return one.select(F.col("conv_id").cast("string").alias("dataset"), text.alias("response"))


FIRSTS = "conv AS (SELECT conv_id, conv_id % 8 AS kind, count(*) AS turns, min(turn) AS lo, list(turn ORDER BY turn) AS ts FROM conversations GROUP BY ALL)"


@query("response_parse", f"""WITH {FIRSTS} SELECT c.conv_id::VARCHAR AS dataset, (list_position(ts, c.turn) - 1)::INTEGER AS pos, 'H' || c.turn AS id, text AS claim,
  CASE WHEN c.turn % 2 = 0 THEN 'pearsonr' ELSE 'chi2' END AS primary_test FROM conversations c JOIN conv USING (conv_id)
  WHERE kind IN (0, 1) OR (kind IN (4, 5) AND NOT list_contains(ts, 1)) OR (kind = 6 AND NOT list_contains(ts, 0))""")
def _(spark, sf):
    good, _ = intake.parse(responses(spark, sf))
    return good.select("dataset", "pos", "id", "claim", F.col("test_plan.primary_test").alias("primary_test"))


@query("response_errors", f"""WITH {FIRSTS} SELECT * FROM (SELECT conv_id::VARCHAR AS dataset, CASE WHEN kind IN (2, 7) THEN 'ValueError: Model output is not valid JSON.'
  WHEN kind = 3 THEN 'ValueError: Output must contain a ''hypotheses'' list.'
  WHEN kind = 4 AND list_contains(ts, 1) THEN 'ValueError: Hypothesis ' || list_position(ts, 1) || ' missing keys: [''risk_flags'']'
  WHEN kind = 5 AND list_contains(ts, 1) THEN 'ValueError: Hypothesis ' || list_position(ts, 1) || ' test_plan missing keys: [''multiple_testing'']'
  WHEN kind = 6 AND list_contains(ts, 0) THEN 'ValueError: Hypothesis ' || list_position(ts, 0) || ' ''variables'' must be a list.' END AS error FROM conv) WHERE error IS NOT NULL""")
def _(spark, sf):
    _, bad = intake.parse(responses(spark, sf))
    return bad.select("dataset", "error")


@query("response_metadata", f"""WITH {FIRSTS} SELECT conv_id::VARCHAR AS dataset, turns::INTEGER AS hypothesis_count FROM conv
  WHERE kind IN (0, 1) OR (kind IN (4, 5) AND NOT list_contains(ts, 1)) OR (kind = 6 AND NOT list_contains(ts, 0))""")
def _(spark, sf):
    return intake.response_metadata(responses(spark, sf))
