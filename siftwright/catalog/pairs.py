"""Queries on pair screening, false discovery rate and effect filter."""

from __future__ import annotations

from itertools import combinations, product
from math import factorial

from pyspark.sql import functions as F

from siftwright.catalog.base import (
    LINEITEM_GAPS, PART_LINKS, SALES, digits, fdr_sql, lineitem_gaps, part_links, query, sales, table,
)
from siftwright.operators.fdr import EffectLimits, adjust_large, correct, keep_effects, mark_significant, numeric_fields
from siftwright.operators.moments import correlations
from siftwright.operators.prep import Prep
from siftwright.operators.profile import profile
from siftwright.operators.screen import ScreenConfig, eligible, screen, screen_and_correct
from siftwright.plans.materialize import small_frame

SHOWN = ["var1", "var2", "type", "relationship", "test", "effect", "effect_name", "n", "notes"]


def _screen(df, *families, columns=SHOWN, config=None):
    return digits(screen(df, profile(df), "d", config, families=families).select(*columns))


def _lines(spark, sf):
    """lineitem columns with a heavy-tailed one, so that both correlation tests occur."""
    return table(spark, sf, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_suppkey",
        (F.col("l_quantity") * F.col("l_quantity") * F.col("l_quantity") * F.col("l_quantity") / 1000).alias("q4"),
        "l_returnflag", "l_linestatus",
    )


LINES = """lines AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_suppkey,
  l_quantity * l_quantity * l_quantity * l_quantity / 1000 AS q4, l_returnflag, l_linestatus FROM lineitem)"""
NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_suppkey", "q4"]


# Integrals in SQL, for tails that DuckDB has no function for: Simpson's rule on so many panels.
PANELS = 8_000


def _area(height: str) -> str:
    """Integral from 0 to `top` of `height`, which is written in terms of `u`."""
    u = f"(top * k / {PANELS})"
    part = f"(CASE WHEN k = 0 OR k = {PANELS} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * {height.replace('{u}', u)}"
    return f"top / {3 * PANELS} * list_sum(list_transform(range({PANELS + 1}), lambda k: {part}))"


def correlation_p_sql(rows: str) -> str:
    """`rows` with the Student-t p of their unrounded effect; for n of 200 and more.

    With r = sin(angle) the density is that of cos(angle)^(v - 1); past 12 deviations p is 0 to 30 digits.
    """
    front = "2 / sqrt(pi()) * exp(0.5 * ln(v / 2) - 1 / (4 * v) + 1 / (24 * v * v * v))"
    return f"""SELECT * EXCLUDE (v, top), greatest(0.0, 1 - {front} * {_area('pow(cos({u}), v - 1)')}) AS p_value
  FROM (SELECT *, (n - 2)::DOUBLE AS v, least(asin(least(abs(effect), 1.0)), 12 / sqrt(n - 2)) AS top FROM ({rows}))"""


def even_chi2_p(x: str, df: int) -> str:
    """Upper chi-square tail at even degrees of freedom: a finite sum."""
    half = f"({x} / 2)"
    return f"exp(-{half}) * (" + " + ".join(f"pow({half}, {j}) / {factorial(j)}" for j in range(df // 2)) + ")"


def full_sql(source: str, dataset: str) -> str:
    """`source` (unrounded rows) with q-values and significance, as a screen returns them."""
    return f"""pairs AS (SELECT '{dataset}' AS dataset, * FROM ({source})), {fdr_sql('pairs')}
SELECT * REPLACE (round(effect, 9) + 0.0 AS effect, round(p_value, 9) AS p_value, round(adjusted_p, 9) AS adjusted_p), adjusted_p < 0.05 AS significant FROM adjusted"""


def _shown(value: str, raw: bool) -> str:
    return value if raw else f"round({value}, 9)"


def pearson_sql(rel: str, a: str, b: str, raw: bool = False) -> str:
    return f"""SELECT '{a}' AS var1, '{b}' AS var2, 'num_num' AS type, 'linear' AS relationship, 'pearsonr' AS test,
  {_shown(f'corr({a}, {b})', raw)} AS effect, 'r' AS effect_name, regr_count({a}, {b})::BIGINT AS n, '' AS notes FROM {rel}"""


def spearman_sql(rel: str, a: str, b: str, raw: bool = False) -> str:
    def mid(c: str) -> str:
        return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"

    return f"""SELECT '{a}' AS var1, '{b}' AS var2, 'num_num' AS type, 'monotonic' AS relationship, 'spearmanr' AS test,
  {_shown('corr(ra, rb)', raw)} AS effect, 'rho' AS effect_name, count(*) AS n, '' AS notes
  FROM (SELECT ({mid(a)})::DOUBLE AS ra, ({mid(b)})::DOUBLE AS rb FROM {rel} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


def _both(rel: str, names: list[str], ranked: set[str], raw: bool = False) -> str:
    return " UNION ALL ".join(
        (spearman_sql if {a, b} & ranked else pearson_sql)(rel, a, b, raw) for a, b in combinations(names, 2)
    )


@query("numnum_pearson", f"WITH {LINES} " + " UNION ALL ".join(pearson_sql("lines", a, b) for a, b in combinations(NUMS[:5], 2)))
def _(spark, sf):
    return _screen(_lines(spark, sf).select(*NUMS[:5]), "num_num")


@query("numnum_effects", f"WITH {LINES} " + _both("lines", NUMS, {"q4"}))
def _(spark, sf):
    """Test chosen per pair from the profile: ranks wherever one side is skewed."""
    return _screen(_lines(spark, sf), "num_num")


@query("numnum_spearman_gaps", f"WITH {LINEITEM_GAPS}, g AS (SELECT l_tax, l_discount, l_quantity * l_quantity * l_quantity * l_quantity AS q4 FROM lineitem_gaps) " + _both("g", ["l_tax", "l_discount", "q4"], {"q4"}))
def _(spark, sf):
    """Missing values: ranks are taken inside each pair's complete cases."""
    df = lineitem_gaps(spark, sf).select("l_tax", "l_discount", (F.col("l_quantity") * F.col("l_quantity") * F.col("l_quantity") * F.col("l_quantity")).alias("q4"))
    return _screen(df, "num_num")


LINE_NUMS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("numnum_screen", f"WITH {full_sql(correlation_p_sql(_both('lineitem', LINE_NUMS, set(), True)), 'lineitem')}")
def _(spark, sf):
    """Numeric pairs of lineitem with p and q; the q-values are over these pairs."""
    df = table(spark, sf, "lineitem").drop("l_shipdate", "l_returnflag", "l_linestatus")
    model = Prep().fit(df, "lineitem")
    full, _ = correct(screen(model.transform(df), model.profile, "lineitem", families=("num_num",)))
    return digits(full.drop("pair_pos"))


WIDE = [f"v{i}" for i in range(12)]
WIDE_EXPR = {f"v{i}": e for i, e in enumerate([
    "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_suppkey", "l_partkey", "l_linenumber", "l_orderkey",
    "l_quantity * l_discount", "l_quantity + l_extendedprice", "l_tax - l_discount", "CASE WHEN l_orderkey % 3 > 0 THEN l_tax * l_quantity END",
])}
WIDE_SQL = "w AS (SELECT " + ", ".join(f"({e})::DOUBLE AS {v}" for v, e in WIDE_EXPR.items()) + " FROM lineitem)"


@query("correlation_matrix", f"WITH {WIDE_SQL} " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, regr_count({a}, {b})::BIGINT AS n, round(corr({a}, {b}), 9) AS r FROM w" for a, b in combinations(WIDE, 2)))
def _(spark, sf):
    """More pairs than built-in aggregates take: one matrix product per batch."""
    df = table(spark, sf, "lineitem").selectExpr(*[f"cast({e} as double) as {v}" for v, e in WIDE_EXPR.items()])
    pairs = [(i, a, b) for i, (a, b) in enumerate(combinations(WIDE, 2))]
    names = F.broadcast(small_frame(spark, pairs, "pos int, a string, b string"))
    return digits(correlations(df, pairs).join(names, "pos").select("a", "b", "n", "r"))


# ---- number by category -------------------------------------------------------------------------


def ranks_sql(rel: str, y: str, g: str) -> str:
    return f"""SELECT {g}::VARCHAR AS lv, {y}::DOUBLE AS y, (rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2.0)::DOUBLE AS rk,
  count(*) OVER (PARTITION BY {y}) AS t FROM {rel} WHERE {y} IS NOT NULL AND {g} IS NOT NULL"""


def mwu_sql(rel: str, y: str, g: str, raw: bool = False) -> str:
    """With `raw`, unrounded and with the two-sided p: normal, corrected for ties and continuity."""
    sums = f"""SELECT sum(rk) FILTER (lv = lo) AS r1, (count(*) FILTER (lv = lo))::DOUBLE AS n1, (count(*) FILTER (lv <> lo))::DOUBLE AS n2, sum(t::DOUBLE * t - 1) AS ties
    FROM (SELECT *, min(lv) OVER () AS lo FROM ({ranks_sql(rel, y, g)}))"""
    if raw:
        gap = "abs(r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) - 0.5"
        spread = "sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1))))"
        sums = f"SELECT *, least(12.0, ({gap}) / {spread}) AS top FROM ({sums})"
    p = f", least(1.0, greatest(0.0, 1 - sqrt(2 / pi()) * {_area('exp(-{u} * {u} / 2)')})) AS p_value" if raw else ""
    effect = _shown("1 - 2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * n2)", raw)
    return f"""SELECT '{y}' AS var1, '{g}' AS var2, 'num_cat' AS type, 'group_difference' AS relationship, 'mannwhitneyu' AS test,
  {effect} AS effect, 'rank_biserial' AS effect_name, (n1 + n2)::BIGINT AS n, 'nonparametric_preferred' AS notes{p}
  FROM ({sums})"""


def kruskal_sql(rel: str, y: str, g: str, p: bool = False, raw: bool = False) -> str:
    h = "((12 / (n * (n + 1)) * rss - 3 * (n + 1)) / (1 - ties / (n * n * n - n)))"
    at = " ".join(f"WHEN {df + 1} THEN {even_chi2_p(h, df)}" for df in (2, 4))
    tail = f", {_shown(f'CASE k {at} END', raw)} AS p_value" if p or raw else ""
    return f"""SELECT '{y}' AS var1, '{g}' AS var2, 'num_cat' AS type, 'group_difference' AS relationship, 'kruskal' AS test,
  {_shown('ssb / sst', raw)} AS effect, 'eta2_approx' AS effect_name, n::BIGINT AS n, 'nonparametric_preferred' AS notes{tail}
  FROM (SELECT sum(ng)::DOUBLE AS n, count(*) AS k, sum(rs * rs / ng) AS rss, sum(tie) AS ties, sum(ng * (m - gm) * (m - gm)) AS ssb, any_value(sst) AS sst FROM (
    SELECT lv, count(*) AS ng, sum(rk) AS rs, sum(t::DOUBLE * t - 1) AS tie, avg(y) AS m, any_value(gm) AS gm, any_value(sst) AS sst FROM (
      SELECT *, avg(y) OVER () AS gm, var_pop(y) OVER () * count(*) OVER () AS sst FROM ({ranks_sql(rel, y, g)})) GROUP BY lv))"""


@query("numcat_mwu", f"WITH {LINES} " + " UNION ALL ".join(mwu_sql("lines", y, "l_linestatus") for y in NUMS))
def _(spark, sf):
    return _screen(_lines(spark, sf).drop("l_returnflag"), "num_cat")


@query("numcat_kruskal", f"WITH {SALES} " + " UNION ALL ".join(
    kruskal_sql("sales", y, g, True) for y, g in product(["o_totalprice", "c_acctbal", "score", "cube"], ["o_orderstatus", "o_orderpriority", "c_mktsegment", "grade"])))
def _(spark, sf):
    df = sales(spark, sf).drop("o_orderkey", "c_nationkey", "size")
    return _screen(df, "num_cat", columns=SHOWN + ["p_value"])


@query("numcat_gaps", f"WITH {LINEITEM_GAPS}, g AS (SELECT l_tax, l_quantity, l_returnflag, l_linestatus FROM lineitem_gaps) "
       + " UNION ALL ".join([kruskal_sql("g", y, "l_returnflag") for y in ("l_tax", "l_quantity")] + [mwu_sql("g", y, "l_linestatus") for y in ("l_tax", "l_quantity")]))
def _(spark, sf):
    return _screen(lineitem_gaps(spark, sf).select("l_tax", "l_quantity", "l_returnflag", "l_linestatus"), "num_cat")


# ---- category by category -----------------------------------------------------------------------


def chi2_sql(rel: str, a: str, b: str, raw: bool = False) -> str:
    at = " ".join(f"WHEN {df} THEN {even_chi2_p('x', df)}" for df in (2, 4, 8, 16))
    return f"""SELECT '{a}' AS var1, '{b}' AS var2, 'cat_cat' AS type, 'association' AS relationship, 'chi2' AS test, {_shown('sqrt(x / (n * least(r - 1, c - 1)))', raw)} AS effect,
  'cramers_v' AS effect_name, n::BIGINT AS n, CASE WHEN low > 0.2 THEN 'sparse_table_expected_counts_low' ELSE '' END AS notes,
  {_shown(f'CASE (r - 1) * (c - 1) {at} END', raw)} AS p_value
  FROM (SELECT sum((o - e) * (o - e) / e) AS x, sum(o) AS n, count(DISTINCT a) AS r, count(DISTINCT b) AS c, avg(CASE WHEN e < 5 THEN 1.0 ELSE 0.0 END) AS low FROM (
    SELECT ra.a, cb.b, coalesce(o, 0)::DOUBLE AS o, rn * cn / nn::DOUBLE AS e
    FROM (SELECT {a} AS a, count(*) AS rn FROM {rel} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1) ra
    CROSS JOIN (SELECT {b} AS b, count(*) AS cn FROM {rel} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1) cb
    CROSS JOIN (SELECT count(*) AS nn FROM {rel} WHERE {a} IS NOT NULL AND {b} IS NOT NULL) t
    LEFT JOIN (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {rel} GROUP BY 1, 2) cells ON cells.a = ra.a AND cells.b = cb.b))"""


SALES_CATS = ["o_orderstatus", "o_orderpriority", "c_mktsegment", "size", "grade"]


@query("catcat_chi2", f"WITH {SALES} " + " UNION ALL ".join(chi2_sql("sales", a, b) for a, b in combinations(SALES_CATS, 2)))
def _(spark, sf):
    df = sales(spark, sf).select(*SALES_CATS)
    return _screen(df, "cat_cat", columns=SHOWN + ["p_value"])


@query("catcat_gaps", f"WITH {LINEITEM_GAPS} " + chi2_sql("lineitem_gaps", "l_returnflag", "l_linestatus"))
def _(spark, sf):
    df = lineitem_gaps(spark, sf).select("l_returnflag", "l_linestatus")
    return _screen(df, "cat_cat", columns=SHOWN + ["p_value"])


@query("category_cap", f"""WITH p AS (SELECT *, CASE WHEN p_partkey % 9 <> 0 THEN p_name END AS nm FROM part)
SELECT * FROM ({chi2_sql('p', 'p_brand', 'p_type')})
UNION ALL SELECT 'p_brand', 'nm', 'cat_cat', 'association', 'skipped', NULL, 'cramers_v', count(*), 'too_many_categories_' || count(DISTINCT p_brand) || 'x' || count(DISTINCT nm), NULL FROM p WHERE nm IS NOT NULL
UNION ALL SELECT 'p_type', 'nm', 'cat_cat', 'association', 'skipped', NULL, 'cramers_v', count(*), 'too_many_categories_' || count(DISTINCT p_type) || 'x' || count(DISTINCT nm), NULL FROM p WHERE nm IS NOT NULL
UNION ALL SELECT 'p_size', 'nm', 'num_cat', 'group_difference', 'skipped', NULL, 'eta2', count(*), 'too_many_categories_' || count(DISTINCT nm), NULL FROM p WHERE nm IS NOT NULL""")
def _(spark, sf):
    """Pairs with more than 30 levels stay in the table as skipped rows."""
    p = table(spark, sf, "part").select("p_size", "p_brand", "p_type", F.when(F.col("p_partkey") % 9 != 0, F.col("p_name")).alias("nm"))
    out = screen(p, profile(p), "d", families=("num_cat", "cat_cat"))
    return digits(out.filter((F.col("type") == "cat_cat") | (F.col("test") == "skipped")).select(*SHOWN, F.lit(None).cast("double").alias("p_value")))


@query("eligible_columns", """SELECT * FROM (VALUES ('c_nationkey', 'numeric'), ('c_acctbal', 'numeric'), ('c_mktsegment', 'category')) t("column", role)
  WHERE (SELECT count(*) FROM customer) > 0""")
def _(spark, sf):
    c = table(spark, sf, "customer")
    facts = {r["column"]: r.asDict() for r in profile(c).collect()}
    numeric, cats = eligible(c, facts)
    return small_frame(spark, [(x, "numeric") for x in numeric] + [(x, "category") for x in cats], "column string, role string")


# ---- multiple testing ---------------------------------------------------------------------------

HOT_P = """tests AS (SELECT l_returnflag AS dataset, l_orderkey, l_linenumber, l_extendedprice,
  CASE WHEN l_linenumber = 7 THEN NULL WHEN l_quantity > 33 THEN 1.0 ELSE l_extendedprice / 10000000 END AS p_value FROM lineitem)"""


@query("bh_large", f"WITH {HOT_P}, {fdr_sql('tests')} SELECT dataset, l_orderkey, l_linenumber, round(p_value, 9) AS p_value, round(adjusted_p, 9) AS adjusted_p FROM adjusted")
def _(spark, sf):
    """q-values of a table of any size; a third of the rows share one p."""
    li = table(spark, sf, "lineitem")
    tests = li.select(
        F.col("l_returnflag").alias("dataset"), "l_orderkey", "l_linenumber",
        F.when(F.col("l_linenumber") == 7, F.lit(None)).when(F.col("l_quantity") > 33, 1.0).otherwise(F.col("l_extendedprice") / 10000000).alias("p_value"),
    )
    return digits(adjust_large(tests))


@query("bh_qvalues", f"WITH {PART_LINKS}, {fdr_sql('part_links')} SELECT dataset, pair_pos, round(p_value, 9) AS p_value, round(adjusted_p, 9) AS adjusted_p, coalesce(adjusted_p < 0.05, false) AS significant FROM adjusted")
def _(spark, sf):
    return digits(mark_significant(adjust_large(numeric_fields(part_links(spark, sf)))).select("dataset", "pair_pos", "p_value", "adjusted_p", "significant"))


KEPT = f"""{PART_LINKS}, {fdr_sql('part_links')},
kept AS (SELECT * FROM adjusted WHERE adjusted_p < 0.05 AND n >= 30 AND CASE WHEN type = 'num_num' THEN abs(effect) >= 0.15 WHEN type = 'cat_cat' THEN effect >= 0.2
  WHEN effect_name = 'rank_biserial' THEN abs(effect) >= 0.15 ELSE effect >= 0.05 END)"""


@query("effect_filter", f"WITH {KEPT} SELECT dataset, pair_pos, type, effect_name, round(effect, 9) AS effect, n FROM kept")
def _(spark, sf):
    _, kept = correct(part_links(spark, sf), large=True)
    return digits(kept.select("dataset", "pair_pos", "type", "effect_name", "effect", "n"))


@query("effect_filter_strict", f"""WITH {PART_LINKS}, {fdr_sql('part_links')} SELECT dataset, pair_pos FROM adjusted WHERE adjusted_p < 0.04 AND n >= 100 AND CASE WHEN type = 'num_num' THEN abs(effect) >= 0.5
  WHEN type = 'cat_cat' THEN effect >= 0.4 WHEN effect_name = 'rank_biserial' THEN abs(effect) >= 0.3 ELSE effect >= 0.2 END""")
def _(spark, sf):
    lim = EffectLimits(alpha=0.04, min_n=100, min_abs_r=0.5, min_cramers_v=0.4, min_eta2=0.2, min_rank_biserial=0.3)
    full = mark_significant(adjust_large(numeric_fields(part_links(spark, sf))), lim.alpha)
    return keep_effects(full, lim).select("dataset", "pair_pos")


# Columns of the joined sales table in their order; `cube` is skewed, so its correlations are of ranks.
SALES_NUMS = ["o_totalprice", "c_acctbal", "c_nationkey", "score", "cube"]
ALL_SALES = " UNION ALL BY NAME ".join(f"SELECT * FROM ({s})" for s in [
    correlation_p_sql(_both("sales", SALES_NUMS, {"cube"}, True)),
    *((mwu_sql if g == "size" else kruskal_sql)("sales", y, g, raw=True) for y, g in product(SALES_NUMS, SALES_CATS)),
    *(chi2_sql("sales", a, b, True) for a, b in combinations(SALES_CATS, 2)),
])


@query("full_screen", f"WITH {SALES}, {full_sql(ALL_SALES, 'sales')}")
def _(spark, sf):
    """All three families of the joined sales table with p, q and significance."""
    df = sales(spark, sf).drop("o_orderkey")
    model = Prep().fit(df, "sales")
    full, _ = screen_and_correct(model.transform(df), model.profile, "sales", ScreenConfig())
    return digits(full.drop("pair_pos"))
