"""Queries on hypothesis validation and resampling."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright import schemas
from siftwright.catalog.base import PART_LINKS, SALES, digits, fdr_sql, part_links, query, sales, table
from siftwright.catalog.pairs import correlation_p_sql, kruskal_sql, mwu_sql
from siftwright.functions.weights import GOLDEN, MIX_1, MIX_2, POISSON_CDF, Weights, row_hash
from siftwright.operators import bootstrap as B
from siftwright.operators import intake, validate as C
from siftwright.plans.materialize import pin, small_frame

REPS = 5


def sales_gaps(spark, sf) -> DataFrame:
    """Sales with a balance missing in every sixth order."""
    return sales(spark, sf).withColumn("c_acctbal", F.when(F.col("o_orderkey") % 6 != 0, F.col("c_acctbal")))


SALES_GAPS = f"""{SALES}, gaps AS (SELECT * REPLACE (CASE WHEN o_orderkey % 6 <> 0 THEN c_acctbal END AS c_acctbal) FROM sales)"""


# ---- pre-filter ---------------------------------------------------------------------------------


def order_hypotheses(spark, sf) -> DataFrame:
    """One proposed hypothesis per order; the order number decides what is wrong with it."""
    k = F.col("o_orderkey") % 12
    test = (
        F.when(k == 1, "anova").when(k.isin(6, 7), "logistic_regression").when(k.isin(8, 9), "linear_regression").otherwise("pearsonr")
    )
    outcome = F.when(k == 3, "").when(k == 6, "grade").when(k == 7, "size").when(k == 8, "size").otherwise("score")
    predictors = F.when(k == 4, F.array().cast("array<string>")).when(k == 5, F.array(F.lit("zap"), F.lit("nope"))).when(
        k == 10, F.array(F.lit("c_acctbal"), F.lit("cube"))
    ).otherwise(F.array(F.lit("c_acctbal")))
    spec = F.struct(
        outcome.alias("outcome"), predictors.alias("predictors"), F.array().cast("array<string>").alias("controls"),
        F.create_map().cast("map<string,string>").alias("expected_signs"), F.lit("row").alias("analysis_unit"), F.lit("").alias("model_formula"),
    )
    return table(spark, sf, "orders").select(
        F.lit("sales").alias("dataset"), F.col("o_orderkey").cast("int").alias("pos"), F.concat(F.lit("H"), F.col("o_orderkey")).alias("id"),
        F.when(k == 0, F.array(F.lit("score"))).otherwise(F.array(F.lit("score"), F.lit("c_acctbal"))).alias("variables"),
        F.struct(test.alias("primary_test")).alias("test_plan"), spec.alias("validation_spec"),
        (k != 2).alias("has_spec"), F.lit(True).alias("predictors_listed"), (k != 11).alias("controls_listed"),
    )


@query("prefilter", """SELECT 'H' || o_orderkey AS id, CASE WHEN o_orderkey % 12 = 1 THEN 'anova' WHEN o_orderkey % 12 IN (6, 7) THEN 'logistic_regression' WHEN o_orderkey % 12 IN (8, 9) THEN 'linear_regression' ELSE 'pearsonr' END AS primary_test,
  CASE o_orderkey % 12 WHEN 0 THEN 'invalid_or_too_short_variables' WHEN 1 THEN 'unsupported_primary_test:anova' WHEN 2 THEN 'missing_validation_spec' WHEN 3 THEN 'validation_spec_missing_outcome'
  WHEN 4 THEN 'validation_spec_missing_predictors' WHEN 5 THEN 'validation_spec_variables_missing_in_test_data:[''nope'', ''zap'']' WHEN 6 THEN 'logistic_regression_outcome_not_binary'
  WHEN 8 THEN 'linear_regression_outcome_not_numeric' WHEN 10 THEN 'pairwise_test_requires_exactly_one_predictor' WHEN 11 THEN 'validation_spec_controls_not_list' END AS reason FROM orders WHERE o_orderkey % 12 NOT IN (7, 9)""")
def _(spark, sf):
    return C.rejections(C.prefilter(order_hypotheses(spark, sf), sales(spark, sf))).select("id", "primary_test", "reason")


# ---- single tests -------------------------------------------------------------------------------

PAIR_SPECS = [
    C.Spec(0, "pearsonr", "score", ("c_acctbal",), ()),
    C.Spec(1, "spearmanr", "cube", ("c_acctbal",), ()),
    C.Spec(2, "mannwhitneyu", "c_acctbal", ("size",), ()),
    C.Spec(3, "kruskal", "c_acctbal", ("grade",), ()),
    C.Spec(4, "chi2", "grade", ("size",), ()),
    C.Spec(5, "mannwhitneyu", "score", ("grade",), ()),
    C.Spec(6, "kruskal", "grade", ("size",), ()),
    C.Spec(7, "pearsonr", "grade", ("score",), ()),
    C.Spec(8, "spearmanr", "score", ("size",), ()),
    C.Spec(9, "chi2", "o_orderpriority", ("c_mktsegment",), ()),
]


def _cramer(rel: str, a: str, b: str) -> str:
    return f"""SELECT sqrt(sum((o - e) * (o - e) / e) / (any_value(n) * (least(count(DISTINCT a), count(DISTINCT b)) - 1))) AS effect, any_value(n)::BIGINT AS n FROM (
    SELECT ra.a, cb.b, coalesce(o, 0)::DOUBLE AS o, rn * cn / n::DOUBLE AS e, n FROM (SELECT {a} AS a, count(*) AS rn FROM {rel} GROUP BY 1) ra
    CROSS JOIN (SELECT {b} AS b, count(*) AS cn FROM {rel} GROUP BY 1) cb CROSS JOIN (SELECT count(*) AS n FROM {rel}) t
    LEFT JOIN (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {rel} GROUP BY 1, 2) c ON c.a = ra.a AND c.b = cb.b)"""


def _mid(c: str) -> str:
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)::DOUBLE"


PAIR_TESTS = " UNION ALL ".join([
    "SELECT 0 AS pos, 'r' AS effect_name, corr(score, c_acctbal) AS effect, regr_count(score, c_acctbal)::BIGINT AS n, true AS testable, '' AS notes FROM gaps",
    f"SELECT 1, 'rho', corr(a, b), count(*), true, '' FROM (SELECT {_mid('cube')} AS a, {_mid('c_acctbal')} AS b FROM gaps WHERE c_acctbal IS NOT NULL)",
    f"SELECT 2, effect_name, effect, n, true, '' FROM ({mwu_sql('gaps', 'c_acctbal', 'size')})",
    f"SELECT 3, effect_name, effect, n, true, '' FROM ({kruskal_sql('gaps', 'c_acctbal', 'grade')})",
    f"SELECT 4, 'cramers_v', effect, n, true, '' FROM ({_cramer('gaps', 'grade', 'size')})",
    "SELECT 5, '', NULL, NULL, false, 'mannwhitneyu_requires_exactly_2_groups'", "SELECT 6, '', NULL, NULL, false, 'kruskal_requires_2_or_more_groups'",
    "SELECT 7, '', NULL, NULL, false, 'insufficient_variation_for_pearson'", "SELECT 8, '', NULL, NULL, false, 'insufficient_variation_for_spearman'",
    f"SELECT 9, 'cramers_v', effect, n, true, '' FROM ({_cramer('gaps', 'o_orderpriority', 'c_mktsegment')})",
])


@query("validate_pairwise", f"WITH {SALES_GAPS}, t AS ({PAIR_TESTS}) SELECT pos::INTEGER AS pos, effect_name, round(effect, 9) AS effect, n, testable, notes FROM t")
def _(spark, sf):
    bench = C.Bench(sales_gaps(spark, sf), PAIR_SPECS, "o_orderkey", C.ValidationConfig())
    return digits(bench.results().select("pos", "effect_name", "effect", "n", "testable", "notes"))


def _regress(df: DataFrame, specs: list[C.Spec], key: str | None) -> DataFrame:
    bench = C.Bench(df, specs, key, C.ValidationConfig())
    out = bench.results().select("pos", "n", "effect", "main_predictor_column", "notes")
    return out.select(*[F.round(c, 6).alias(c) if c == "effect" else F.col(c) for c in out.columns])


CENTRED = "(SELECT score - avg(score) OVER () AS y, o_totalprice - avg(o_totalprice) OVER () AS x1, c_nationkey - avg(c_nationkey) OVER () AS x2 FROM sales)"


@query("ols", f"""WITH {SALES}, s AS (SELECT sum(x1 * x1) AS s11, sum(x2 * x2) AS s22, sum(x1 * x2) AS s12, sum(x1 * y) AS s1y, sum(x2 * y) AS s2y FROM {CENTRED})
SELECT 0::INTEGER AS pos, count(*) AS n, round(regr_slope(score, c_acctbal), 6) AS effect, 'c_acctbal' AS main_predictor_column, '' AS notes FROM sales
UNION ALL SELECT 1, (SELECT count(*) FROM sales), round((s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12), 6), 'o_totalprice', '' FROM s
UNION ALL (SELECT 2, nn, round(m - ma, 6), 'grade_' || grade, '' FROM (
  SELECT grade, avg(score) AS m, count(*) AS n, first(avg(score)) OVER (ORDER BY grade) AS ma, first(count(*)) OVER (ORDER BY grade) AS na, sum(count(*)) OVER ()::BIGINT AS nn,
    sum(var_pop(score) * count(*)) OVER () / (sum(count(*)) OVER () - 3) AS s2 FROM sales GROUP BY grade) WHERE grade <> 'A'
  ORDER BY least(abs(m - ma) / sqrt(s2 * (1.0 / na + 1.0 / n)), 38) DESC, grade LIMIT 1)""")  # beyond t = 38 every p is 0
def _(spark, sf):
    """Least squares with one number, with a control, and with a category as predictor."""
    specs = [
        C.Spec(0, "linear_regression", "score", ("c_acctbal",), ()),
        C.Spec(1, "linear_regression", "score", ("o_totalprice",), ("c_nationkey",)),
        C.Spec(2, "linear_regression", "score", ("grade",), ()),
    ]
    return _regress(sales(spark, sf).drop("cube"), specs, "o_orderkey")


@query("logit", """WITH t AS (SELECT l_returnflag AS f, (count(*) FILTER (l_linestatus = 'O'))::DOUBLE AS a, (count(*) FILTER (l_linestatus = 'F'))::DOUBLE AS b, sum(count(*)) OVER ()::BIGINT AS n FROM lineitem GROUP BY 1),
z AS (SELECT t.f, ln(t.a / t.b) - ln(r.a / r.b) AS coef, (ln(t.a / t.b) - ln(r.a / r.b)) / sqrt(1 / t.a + 1 / t.b + 1 / r.a + 1 / r.b) AS z, t.n FROM t, t r WHERE r.f = 'A' AND t.f <> 'A')
SELECT 0::INTEGER AS pos, any_value(n) AS n, round(max_by(coef, abs(z)), 6) AS effect, 'l_returnflag_' || max_by(f, abs(z)) AS main_predictor_column, '' AS notes FROM z""")
def _(spark, sf):
    """Logistic regression on a category; its coefficients are log odds ratios."""
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus")
    return _regress(li, [C.Spec(0, "logistic_regression", "l_linestatus", ("l_returnflag",), ())], None)


@query("logit_numbers")
def _(spark, sf):
    """Logistic regressions of document labels on length and language."""
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    specs = [
        C.Spec(0, "logistic_regression", "toxic", ("n_chars",), ()),
        C.Spec(1, "logistic_regression", "quality", ("lang",), ("n_chars",)),
    ]
    return C.Bench(d, specs, "doc_id", C.ValidationConfig()).results()


#: Rounds of subtracting the means of two categories in turn; each leaves about half of what the last one left.
TURNS = 60
KEYED = "lines AS (SELECT l_tax::DOUBLE AS y, l_discount::DOUBLE AS x, l_extendedprice::DOUBLE AS price, l_orderkey::VARCHAR AS okey, l_partkey::VARCHAR AS pkey FROM lineitem)"
SLOPE = "count(*)::BIGINT AS n, sum(x * y) / sum(x * x) AS slope, sum(x * y) / sqrt(sum(x * x) * sum(y * y)) AS r"


@query("ols_wide", f"""WITH RECURSIVE {KEYED},
one AS (SELECT {SLOPE} FROM (SELECT x - avg(x) OVER (PARTITION BY okey) AS x, y - avg(y) OVER (PARTITION BY okey) AS y FROM lines)),
turns AS (SELECT 0 AS turn, x, y, okey, pkey FROM lines
  UNION ALL SELECT turn + 1, x - avg(x) OVER w, y - avg(y) OVER w, okey, pkey FROM turns WHERE turn < {TURNS} WINDOW w AS (PARTITION BY CASE WHEN turn % 2 = 0 THEN okey ELSE pkey END)),
two AS (SELECT {SLOPE} FROM turns WHERE turn = {TURNS}),
sizes AS (SELECT count(DISTINCT okey) AS orders, count(DISTINCT pkey) AS parts FROM lines),
slopes AS (SELECT 0 AS pos, one.*, n - orders - 1 AS dof FROM one, sizes UNION ALL SELECT 1, two.*, n - orders - parts FROM two, sizes),
means AS (SELECT okey, avg(price) AS m, count(*) AS k, sum(count(*)) OVER () AS n, sum(var_pop(price) * count(*)) OVER () / (sum(count(*)) OVER () - count(*) OVER ()) AS s2, sum(count(*)) OVER () - count(*) OVER () AS dof,
  first(avg(price)) OVER (ORDER BY okey) AS base, first(count(*)) OVER (ORDER BY okey) AS base_k FROM lines GROUP BY okey),
best AS (SELECT *, (m - base) / sqrt(s2 * (1.0 / k + 1.0 / base_k)) AS t FROM means WHERE okey > (SELECT min(okey) FROM means) ORDER BY abs(t) DESC, okey LIMIT 1),
found AS (SELECT pos, n, slope AS coef, 'l_discount' AS main, r AS effect, dof FROM slopes UNION ALL SELECT 2, n::BIGINT, m - base, 'okey_' || okey, t / sqrt(t * t + dof), dof FROM best)
SELECT pos::INTEGER AS pos, n_rows AS n, round(coef, 6) AS effect, round(p_value, 9) AS p_value, main AS main_predictor_column, '' AS notes
FROM ({correlation_p_sql("SELECT pos, n AS n_rows, coef, main, effect, (dof + 2)::BIGINT AS n FROM found")})""")
def _(spark, sf):
    """Least squares with one and with two categories of thousands of levels as controls, and with one as predictor."""
    li = table(spark, sf, "lineitem")
    lines = li.select("l_tax", "l_discount", "l_extendedprice", F.col("l_orderkey").cast("string").alias("okey"), F.col("l_partkey").cast("string").alias("pkey"))
    specs = [
        C.Spec(0, "linear_regression", "l_tax", ("l_discount",), ("okey",)),
        C.Spec(1, "linear_regression", "l_tax", ("l_discount",), ("okey", "pkey")),
        C.Spec(2, "linear_regression", "l_extendedprice", ("okey",), ()),
    ]
    out = C.Bench(lines, specs, None, C.ValidationConfig()).results()
    return out.select("pos", "n", F.round("effect", 6).alias("effect"), F.round("p_value", 9).alias("p_value"), "main_predictor_column", "notes")


# ---- resampling ---------------------------------------------------------------------------------

MOD = 2**64


def weights_sql(source: str, key: str, reps: int = REPS) -> str:
    """Relation `weights` (k, rep, w) of Poisson counts per key and replicate."""
    count = " + ".join(f"(u >= {float(c)!r}::DOUBLE)::INTEGER" for c in POISSON_CDF)
    return f"""keyed AS (SELECT {key} AS k, CAST('0x' || substr(md5({key}::VARCHAR || ':42'), 1, 15) AS BIGINT) AS h FROM {source}),
w0 AS (SELECT k, rep, ((h::UHUGEINT + (rep + 1)::UHUGEINT * {GOLDEN}::UHUGEINT) % {MOD}::UHUGEINT)::UBIGINT AS z FROM keyed, (SELECT unnest(range({reps})) AS rep)),
w1 AS (SELECT k, rep, (xor(z, z >> 30)::UHUGEINT * {MIX_1}::UHUGEINT % {MOD}::UHUGEINT)::UBIGINT AS z FROM w0),
w2 AS (SELECT k, rep, (xor(z, z >> 27)::UHUGEINT * {MIX_2}::UHUGEINT % {MOD}::UHUGEINT)::UBIGINT AS z FROM w1),
w3 AS (SELECT k, rep, (xor(z, z >> 31) >> 11)::DOUBLE * {2.0**-53!r}::DOUBLE AS u FROM w2),
weights AS (SELECT k, rep::INTEGER AS rep, {count} AS w FROM w3)"""


@query("resample_weights", f"WITH {weights_sql('orders', 'o_orderkey')} SELECT k AS o_orderkey, rep, w FROM weights")
def _(spark, sf):
    """Row weights of the first replicates; the same on any number of machines."""
    weights = Weights("poisson", REPS, 42)

    def spread(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            w = weights.matrix(pdf["h"].to_numpy())
            yield pd.DataFrame({
                "o_orderkey": np.repeat(pdf["o_orderkey"].to_numpy(), REPS), "rep": np.tile(np.arange(REPS), len(pdf)), "w": w.ravel(),
            })

    keyed = table(spark, sf, "orders").select("o_orderkey", row_hash(F.col("o_orderkey"), 42).alias("h"))
    return keyed.mapInPandas(spread, "o_orderkey bigint, rep int, w int")


def _resample(df: DataFrame, *specs: C.Spec) -> DataFrame:
    bench = C.Bench(df, list(specs), "o_orderkey", C.ValidationConfig())
    out = bench.replicates(Weights("poisson", REPS, 42), {s.pos for s in specs})
    return out.select("pos", "rep", F.round("effect", 8).alias("effect"))


WEIGHTED = f"{SALES_GAPS}, {weights_sql('gaps', 'o_orderkey')}, wg AS (SELECT g.*, rep, w FROM gaps g JOIN weights ON k = o_orderkey WHERE w > 0)"


def wcorr(x: str, y: str) -> str:
    return f"""(sum(w * {x} * {y}) - sum(w * {x}) * sum(w * {y}) / sum(w)) / sqrt((sum(w * {x} * {x}) - sum(w * {x}) * sum(w * {x}) / sum(w)) * (sum(w * {y} * {y}) - sum(w * {y}) * sum(w * {y}) / sum(w)))"""


@query("bootstrap_pearson", f"WITH {WEIGHTED} SELECT 0::INTEGER AS pos, rep, round({wcorr('score', 'c_acctbal')}, 8) AS effect FROM wg WHERE c_acctbal IS NOT NULL GROUP BY rep")
def _(spark, sf):
    return _resample(sales_gaps(spark, sf), PAIR_SPECS[0])


def wrank(c: str) -> str:
    """Weighted average rank inside a replicate."""
    return f"(sum(w) OVER (PARTITION BY rep ORDER BY {c} RANGE UNBOUNDED PRECEDING) - sum(w) OVER (PARTITION BY rep, {c}) + (sum(w) OVER (PARTITION BY rep, {c}) + 1) / 2.0)::DOUBLE"


@query("bootstrap_spearman", f"WITH {WEIGHTED}, r AS (SELECT rep, w, {wrank('cube')} AS a, {wrank('c_acctbal')} AS b FROM wg WHERE c_acctbal IS NOT NULL) SELECT 1::INTEGER AS pos, rep, round({wcorr('a', 'b')}, 8) AS effect FROM r GROUP BY rep")
def _(spark, sf):
    return _resample(sales_gaps(spark, sf), PAIR_SPECS[1])


@query("bootstrap_mwu", f"""WITH {WEIGHTED}, r AS (SELECT rep, w, size, {wrank('c_acctbal')} AS a FROM wg WHERE c_acctbal IS NOT NULL),
g AS (SELECT rep, sum(w * a) FILTER (size = 'big') AS r1, (sum(w) FILTER (size = 'big'))::DOUBLE AS n1, (sum(w) FILTER (size = 'small'))::DOUBLE AS n2 FROM r GROUP BY rep)
SELECT 2::INTEGER AS pos, rep, round(1 - 2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * n2), 8) AS effect FROM g""")
def _(spark, sf):
    return _resample(sales_gaps(spark, sf), PAIR_SPECS[2])


@query("bootstrap_eta2", f"""WITH {WEIGHTED}, c AS (SELECT rep, w, grade, c_acctbal - avg(c_acctbal) OVER () AS y FROM wg WHERE c_acctbal IS NOT NULL),
g AS (SELECT rep, grade, sum(w)::DOUBLE AS n, sum(w * y) AS s, sum(w * y * y) AS ss FROM c GROUP BY ALL)
SELECT 3::INTEGER AS pos, rep, round((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(ss) - sum(s) * sum(s) / sum(n)), 8) AS effect FROM g GROUP BY rep""")
def _(spark, sf):
    return _resample(sales_gaps(spark, sf), PAIR_SPECS[3])


@query("bootstrap_cramer", f"""WITH {WEIGHTED}, cells AS (SELECT rep, grade AS a, size AS b, sum(w)::DOUBLE AS o FROM wg GROUP BY ALL),
m AS (SELECT *, sum(o) OVER (PARTITION BY rep, a) AS ra, sum(o) OVER (PARTITION BY rep, b) AS cb, sum(o) OVER (PARTITION BY rep) AS n FROM cells)
SELECT 4::INTEGER AS pos, rep, round(sqrt((sum(o * o / (ra * cb)) - 1) / (least(count(DISTINCT a), count(DISTINCT b)) - 1)), 8) AS effect FROM m GROUP BY rep""")
def _(spark, sf):
    return _resample(sales_gaps(spark, sf), PAIR_SPECS[4])


@query("bootstrap_ols", f"""WITH {WEIGHTED} SELECT 0::INTEGER AS pos, rep, round((sum(w * c_acctbal * score) - sum(w * c_acctbal) * sum(w * score) / sum(w)) / (sum(w * c_acctbal * c_acctbal) - sum(w * c_acctbal) * sum(w * c_acctbal) / sum(w)), 6) AS effect
  FROM wg WHERE c_acctbal IS NOT NULL GROUP BY rep""")
def _(spark, sf):
    out = _resample(sales_gaps(spark, sf), C.Spec(0, "linear_regression", "score", ("c_acctbal",), ()))
    return out.select("pos", "rep", F.round("effect", 6).alias("effect"))


@query("bootstrap_logit", f"""WITH {WEIGHTED}, t AS (SELECT rep, o_orderpriority AS f, (sum(w) FILTER (size = 'small'))::DOUBLE AS a, (sum(w) FILTER (size = 'big'))::DOUBLE AS b FROM wg GROUP BY ALL),
z AS (SELECT t.rep, ln(t.a / t.b) - ln(r.a / r.b) AS coef, (ln(t.a / t.b) - ln(r.a / r.b)) / sqrt(1 / t.a + 1 / t.b + 1 / r.a + 1 / r.b) AS z FROM t JOIN t r USING (rep) WHERE r.f = '1-URGENT' AND t.f <> '1-URGENT')
SELECT 0::INTEGER AS pos, rep, round(max_by(coef, abs(z)), 6) AS effect FROM z GROUP BY rep""")
def _(spark, sf):
    out = _resample(sales_gaps(spark, sf), C.Spec(0, "logistic_regression", "size", ("o_orderpriority",), ()))
    return out.select("pos", "rep", F.round("effect", 6).alias("effect"))


@query("bootstrap_ci", """WITH e AS (SELECT l_orderkey::INTEGER AS pos, l_discount - CASE WHEN l_orderkey % 3 = 0 THEN 0.05 ELSE -0.02 END AS effect FROM lineitem),
q AS (SELECT pos, count(*) AS runs, quantile_cont(effect, 0.5) AS mid, quantile_cont(effect, 0.025) AS lo, quantile_cont(effect, 0.975) AS hi,
  greatest(avg((effect > 0)::INTEGER), avg((effect < 0)::INTEGER)) AS signs, avg((effect >= 0.03)::INTEGER) AS passes, avg((effect > 0)::INTEGER) AS dirs FROM e GROUP BY pos)
SELECT s.pos, runs IS NOT NULL AS bootstrap_testable, runs AS bootstrap_successful_runs, round(mid, 9) AS bootstrap_median_effect, round(lo, 9) AS bootstrap_ci_low, round(hi, 9) AS bootstrap_ci_high,
  (lo > 0 AND hi > 0) OR (lo < 0 AND hi < 0) AS bootstrap_ci_excludes_zero, round(signs, 9) AS bootstrap_sign_consistency, round(passes, 9) AS bootstrap_effect_pass_rate, round(dirs, 9) AS bootstrap_direction_match_rate,
  coalesce(((lo > 0 AND hi > 0) OR (lo < 0 AND hi < 0)) AND signs >= 0.8 AND passes >= 0.7, false) AS bootstrap_stable,
  CASE WHEN runs IS NULL THEN 'no_successful_bootstrap_runs' ELSE '' END AS bootstrap_notes FROM (SELECT o_orderkey::INTEGER AS pos FROM orders) s LEFT JOIN q USING (pos)""")
def _(spark, sf):
    """Replicate effects per order, summed up; orders without lines have none and are not testable."""
    effect = F.col("l_discount") - F.when(F.col("l_orderkey") % 3 == 0, 0.05).otherwise(-0.02)
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("int").alias("pos"), effect.alias("effect"))
    scored = e.select("pos", "effect", (F.col("effect") >= 0.03).alias("effect_pass"), (F.col("effect") > 0).alias("direction_ok"))
    everyone = table(spark, sf, "orders").select(F.col("o_orderkey").cast("int").alias("pos"))
    return digits(B.summarize(scored, everyone))


# ---- verdicts -----------------------------------------------------------------------------------


def tested_links(spark, sf) -> DataFrame:
    """Test results in the layout of a validated batch, one per part."""
    p = part_links(spark, sf)
    testable = F.col("pair_pos") % 11 != 0
    return p.select(
        "dataset", F.col("pair_pos").alias("pos"), F.concat(F.lit("H"), "pair_pos").alias("id"), F.col("test").alias("primary_test"),
        F.when(F.col("pair_pos") % 4 == 0, "positive").when(F.col("pair_pos") % 4 == 1, "negative").when(F.col("pair_pos") % 4 == 2, "group_difference").otherwise("unknown").alias("direction_expected"),
        F.concat(F.lit("claim on "), "var1").alias("claim"),
        F.to_json(F.struct(F.col("var1").alias("outcome"), F.array("var2").alias("predictors"), F.create_map(F.col("var2"), F.lit("positive")).alias("expected_signs"))).alias("validation_spec"),
        testable.alias("testable"), F.when(testable, F.col("n")).alias("n"), F.when(testable, F.col("effect")).alias("effect"),
        F.when(testable, F.col("effect_name")).otherwise("").alias("effect_name"), F.when(testable, F.col("p_value")).alias("p_value"), F.lit("").alias("notes"),
    )


TESTED = f"""{PART_LINKS}, tested AS (SELECT dataset, pair_pos AS pos, 'H' || pair_pos AS id, test AS primary_test, var1, var2,
  CASE pair_pos % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'group_difference' ELSE 'unknown' END AS direction_expected, 'claim on ' || var1 AS claim,
  pair_pos % 11 <> 0 AS testable, CASE WHEN pair_pos % 11 <> 0 THEN n END AS n, CASE WHEN pair_pos % 11 <> 0 THEN effect END AS effect,
  CASE WHEN pair_pos % 11 <> 0 THEN effect_name ELSE '' END AS effect_name, CASE WHEN pair_pos % 11 <> 0 THEN p_value END AS p_value FROM part_links),
{fdr_sql('tested')},
judged AS (SELECT *, CASE WHEN adjusted_p IS NULL THEN 'not_testable' WHEN n < 30 THEN 'failed_min_n' WHEN NOT adjusted_p < 0.05 THEN 'failed_bh'
  WHEN primary_test IN ('pearsonr', 'spearmanr') AND ((direction_expected = 'positive' AND NOT effect > 0) OR (direction_expected = 'negative' AND NOT effect < 0)) THEN 'failed_direction'
  WHEN NOT CASE effect_name WHEN 'rho' THEN abs(effect) >= 0.15 WHEN 'cramers_v' THEN effect >= 0.2 WHEN 'eta2_approx' THEN effect >= 0.05 ELSE abs(effect) >= 0.15 END THEN 'failed_effect_threshold'
  ELSE 'validated' END AS st FROM adjusted),
settled AS (SELECT *, st = 'validated' AS validated, CASE WHEN st <> 'validated' THEN st WHEN pos % 13 = 0 THEN 'failed_bootstrap_not_testable' WHEN pos % 5 <> 0 THEN 'final_accepted' ELSE 'failed_bootstrap_stability' END AS validation_status,
  CASE WHEN st = 'validated' AND pos % 13 = 0 THEN 'no_successful_bootstrap_runs' ELSE '' END AS notes FROM judged)"""


def settled_links(spark, sf) -> DataFrame:
    judged = pin(C.judge(tested_links(spark, sf), large=True))
    boot = judged.filter("validated").select(
        "pos", (F.col("pos") % 13 != 0).alias("bootstrap_testable"), ((F.col("pos") % 13 != 0) & (F.col("pos") % 5 != 0)).alias("bootstrap_stable"),
        F.when(F.col("pos") % 13 == 0, "no_successful_bootstrap_runs").otherwise("").alias("bootstrap_notes"),
    )
    return C.settle(judged, boot)


@query("final_status", f"WITH {TESTED} SELECT id, validated, validation_status, validation_status = 'final_accepted' AS final_accepted, notes, round(adjusted_p, 9) AS adjusted_p FROM settled")
def _(spark, sf):
    return digits(settled_links(spark, sf).select("id", "validated", "validation_status", "final_accepted", "notes", "adjusted_p"))


@query("batch_summary", f"""WITH {TESTED}, r AS (SELECT dataset, count(*) AS raw, count(*) FILTER (pair_pos % 17 = 0) AS rej FROM part_links GROUP BY 1),
s AS (SELECT dataset, count(*) FILTER (testable) AS t, count(*) FILTER (validated) AS v, count(*) FILTER (validation_status = 'final_accepted') AS f, count(*) FILTER (NOT testable) AS nt FROM settled GROUP BY 1)
SELECT dataset, raw AS generated_hypotheses_raw, raw - rej AS hypotheses_after_pre_filter, rej AS rejected_pre_validation, t AS testable_hypotheses, v AS validated_hypotheses_before_bootstrap, f AS final_accepted_hypotheses,
  v - f AS rejected_after_bootstrap, nt AS not_testable_hypotheses, round(v / t, 9) AS validation_rate_among_testable, round(f / v, 9) AS final_acceptance_rate_among_validated, 0.05::DOUBLE AS alpha, 30::INTEGER AS min_n FROM r JOIN s USING (dataset)""")
def _(spark, sf):
    checked = part_links(spark, sf).select("dataset", F.when(F.col("pair_pos") % 17 == 0, "out").alias("reason"))
    s = C.summary(settled_links(spark, sf), checked)
    return digits(s.select(*s.columns[: s.columns.index("min_n") + 1]))


def hypothesis(i: int, test: str, outcome: str, predictors: list[str], controls: list[str] = (), direction: str = "positive") -> dict:
    return {
        "id": f"H{i}", "variables": [outcome, *predictors], "relationship_type": "association", "direction": direction,
        "claim": f"{outcome} goes with {', '.join(predictors)}", "supporting_evidence": ["E1"],
        "test_plan": {"primary_test": test, "null_hypothesis": "none", "alpha": 0.05, "multiple_testing": "BH over this batch"},
        "validation_spec": {"outcome": outcome, "predictors": list(predictors), "controls": list(controls), "expected_signs": {}, "analysis_unit": "row", "model_formula": ""},
        "risk_flags": [],
    }


PROPOSED = json.dumps({"hypotheses": [
    hypothesis(1, "pearsonr", "score", ["o_totalprice"]), hypothesis(2, "spearmanr", "cube", ["o_totalprice"]),
    hypothesis(3, "mannwhitneyu", "score", ["size"], direction="group_difference"), hypothesis(4, "kruskal", "score", ["grade"], direction="group_difference"),
    hypothesis(5, "chi2", "grade", ["size"], direction="unknown"), hypothesis(6, "linear_regression", "score", ["c_acctbal"], ["c_mktsegment"]),
    hypothesis(7, "logistic_regression", "size", ["c_acctbal"], direction="negative"), hypothesis(8, "pearsonr", "score", ["c_nationkey"]),
    hypothesis(9, "chi2", "o_orderstatus", ["c_mktsegment"], direction="unknown"), hypothesis(10, "linear_regression", "cube", ["grade"], ["c_acctbal"], "negative"),
]})


def proposed(spark, name: str = "sales"):
    return intake.parse(small_frame(spark, [(name, PROPOSED)], "dataset string, response string"))[0]


@query("validate_batch")
def _(spark, sf):
    """Ten hypotheses on the joined sales table with 200 resamples each, down to the final status."""
    v = C.validate(sales(spark, sf), proposed(spark), "sales", C.ValidationConfig(), key="o_orderkey")
    return v.results.select(*[c for c in schemas.VALIDATION_COLUMNS if c not in ("variables", "supporting_evidence", "validation_spec")])
