"""Registry of runnable queries and the SQL that states the same result.

Every query reads whole tables of one folder. SQL is left out for iterative fits, prompt texts and
whole runs; those are checked in tests instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def digits(df: DataFrame, places: int = 9) -> DataFrame:
    """Doubles rounded, so that the order of additions does not show."""
    return df.select(*[
        (F.round(F.col(f"`{c}`"), places) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes
    ])


# ---- shared inputs, once for Spark and once as SQL ------------------------------------------------


def lineitem_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem with missing tax and return flag, as the tables themselves have none."""
    df = table(spark, folder, "lineitem")
    return df.withColumn("l_tax", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_tax"))).withColumn(
        "l_returnflag", F.when(F.col("l_orderkey") % 5 != 0, F.col("l_returnflag"))
    )


LINEITEM_GAPS = """lineitem_gaps AS (SELECT * REPLACE (
  CASE WHEN l_orderkey % 7 <> 0 THEN l_tax END AS l_tax,
  CASE WHEN l_orderkey % 5 <> 0 THEN l_returnflag END AS l_returnflag) FROM lineitem)"""


def orders_gaps(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "orders").drop("o_orderdate")
    return (
        df.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")))
        .withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")))
        .withColumn("o_rush", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")))
    )


ORDERS_GAPS = """orders_gaps AS (SELECT o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS o_orderpriority,
  CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS o_rush FROM orders)"""


def sales(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with customer columns and a few derived ones that hang together."""
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "c_acctbal", "c_mktsegment",
        "c_nationkey",
        (F.col("o_totalprice") + F.col("c_acctbal") * 40).alias("score"),
        (F.col("o_totalprice") * F.col("o_totalprice") * F.col("o_totalprice") / 1e12).alias("cube"),
        F.when(F.col("o_totalprice") + F.col("c_acctbal") * 20 > 350000, "big").otherwise("small").alias("size"),
        F.when(F.col("o_totalprice") > 400000, "A").when(F.col("c_acctbal") > 5000, "B").otherwise("C").alias("grade"),
    )


SALES = """sales AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, c_acctbal, c_mktsegment,
  c_nationkey, o_totalprice + c_acctbal * 40 AS score,
  o_totalprice * o_totalprice * o_totalprice / 1e12 AS cube,
  CASE WHEN o_totalprice + c_acctbal * 20 > 350000 THEN 'big' ELSE 'small' END AS size,
  CASE WHEN o_totalprice > 400000 THEN 'A' WHEN c_acctbal > 5000 THEN 'B' ELSE 'C' END AS grade
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def part_links(spark: SparkSession, folder: str) -> DataFrame:
    """An association-like table: one row per part, datasets by part type.

    Some rows lack a p-value, some pairs repeat, some names look like weights.
    """
    p = table(spark, folder, "part")
    kind = F.col("p_partkey") % 3
    step = F.col("p_partkey") * 37 % 997
    return p.select(
        F.col("p_type").alias("dataset"),
        F.concat(F.col("p_brand"), F.when(F.col("p_partkey") % 41 == 0, "_weight").otherwise("")).alias("var1"),
        F.col("p_name").alias("var2"),
        F.when(kind == 0, "num_num").when(kind == 1, "cat_cat").otherwise("num_cat").alias("type"),
        F.when(kind == 0, "monotonic").when(kind == 1, "association").otherwise("group_difference").alias("relationship"),
        F.when(kind == 0, "spearmanr").when(kind == 1, "chi2").when(F.col("p_size") % 2 == 0, "mannwhitneyu").otherwise("kruskal").alias("test"),
        F.when((kind != 1) & (F.col("p_size") % 2 == 0), -step / 1000.0).otherwise(step / 1000.0).alias("effect"),
        F.when(kind == 0, "rho").when(kind == 1, "cramers_v").when(F.col("p_size") % 2 == 0, "rank_biserial").otherwise("eta2_approx").alias("effect_name"),
        F.when(F.col("p_partkey") % 53 == 0, F.lit(None)).otherwise(F.col("p_partkey") * 71 % 1009 / 20011.0).alias("p_value"),
        (F.col("p_size").cast("bigint") * 10).alias("n"),
        F.when(kind == 2, "nonparametric_preferred").when(F.col("p_size") < 10, "sparse_table_expected_counts_low").otherwise("").alias("notes"),
        F.col("p_partkey").cast("int").alias("pair_pos"),
    )


PART_LINKS = """part_links AS (SELECT p_type AS dataset,
  p_brand || CASE WHEN p_partkey % 41 = 0 THEN '_weight' ELSE '' END AS var1, p_name AS var2,
  CASE p_partkey % 3 WHEN 0 THEN 'num_num' WHEN 1 THEN 'cat_cat' ELSE 'num_cat' END AS type,
  CASE p_partkey % 3 WHEN 0 THEN 'monotonic' WHEN 1 THEN 'association' ELSE 'group_difference' END AS relationship,
  CASE WHEN p_partkey % 3 = 0 THEN 'spearmanr' WHEN p_partkey % 3 = 1 THEN 'chi2' WHEN p_size % 2 = 0 THEN 'mannwhitneyu' ELSE 'kruskal' END AS test,
  CASE WHEN p_partkey % 3 <> 1 AND p_size % 2 = 0 THEN -((p_partkey * 37) % 997) / 1000.0::DOUBLE ELSE ((p_partkey * 37) % 997) / 1000.0::DOUBLE END AS effect,
  CASE WHEN p_partkey % 3 = 0 THEN 'rho' WHEN p_partkey % 3 = 1 THEN 'cramers_v' WHEN p_size % 2 = 0 THEN 'rank_biserial' ELSE 'eta2_approx' END AS effect_name,
  CASE WHEN p_partkey % 53 = 0 THEN NULL ELSE ((p_partkey * 71) % 1009) / 20011.0::DOUBLE END AS p_value,
  CAST(p_size AS BIGINT) * 10 AS n,
  CASE WHEN p_partkey % 3 = 2 THEN 'nonparametric_preferred' WHEN p_size < 10 THEN 'sparse_table_expected_counts_low' ELSE '' END AS notes,
  CAST(p_partkey AS INTEGER) AS pair_pos FROM part)"""

# q-values per dataset over the usable p of a relation with columns dataset, p_value.
def fdr_sql(source: str) -> str:
    return f"""ranked AS (SELECT *, count(*) OVER (PARTITION BY dataset) AS m,
    count(*) OVER (PARTITION BY dataset ORDER BY p_value RANGE UNBOUNDED PRECEDING) AS rk
  FROM {source} WHERE p_value IS NOT NULL),
adjusted AS (SELECT * EXCLUDE (m, rk), min(least(1.0, p_value * m / rk)) OVER (
    PARTITION BY dataset ORDER BY p_value DESC RANGE UNBOUNDED PRECEDING) AS adjusted_p FROM ranked
  UNION ALL SELECT *, NULL AS adjusted_p FROM {source} WHERE p_value IS NULL)"""
