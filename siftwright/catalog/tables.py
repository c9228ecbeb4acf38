"""Queries on splitting, profiling, cleaning and reading tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.catalog.base import (
    LINEITEM_GAPS, ORDERS_GAPS, digits, lineitem_gaps, orders_gaps, query, table,
)
from siftwright.operators.prep import Prep
from siftwright.operators.profile import ingest, profile
from siftwright.operators.split import split_summary, train_test_split
from siftwright.plans.materialize import ensure_checkpoint_dir
from siftwright.sources import readers, writers
from siftwright.streaming.cleaning import write_clean

# ---- split --------------------------------------------------------------------------------------

HASHED = """hashed AS (SELECT *, CAST('0x' || substr(md5(o_orderkey::VARCHAR || ':42'), 1, 15) AS BIGINT) AS h FROM orders)"""
SPLIT = f"""{HASHED}, placed AS (SELECT *, row_number() OVER (ORDER BY h, o_orderkey) AS r, count(*) OVER () AS n FROM hashed),
split AS (SELECT *, CASE WHEN r <= ceil(n * 0.3) THEN 'test' ELSE 'train' END AS split FROM placed)"""
STRATA = f"""{HASHED}, strata AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1),
share AS (SELECT s, n, n * ceil(sum(n) OVER () * 0.3) / sum(n) OVER () AS ideal, ceil(sum(n) OVER () * 0.3) AS want FROM strata),
short AS (SELECT *, want - sum(floor(ideal)) OVER () AS missing, row_number() OVER (ORDER BY ideal - floor(ideal) DESC, s) AS place FROM share),
allot AS (SELECT s, floor(ideal) + CASE WHEN place <= missing THEN 1 ELSE 0 END AS k FROM short),
placed AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY h, o_orderkey) AS r FROM hashed),
split AS (SELECT placed.*, CASE WHEN r <= k THEN 'test' ELSE 'train' END AS split FROM placed JOIN allot ON s = o_orderstatus)"""


@query("split_exact", f"WITH {SPLIT} SELECT o_orderkey, split FROM split")
def _(spark, sf):
    return train_test_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", "split")


@query("split_stratified", f"WITH {STRATA} SELECT o_orderkey, o_orderstatus, split FROM split")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return train_test_split(df, "o_orderkey", stratify="o_orderstatus")


@query("split_summary", f"""WITH {SPLIT} SELECT count(*) AS input_rows, count(*) FILTER (split = 'train') AS train_rows,
  count(*) FILTER (split = 'test') AS test_rows, 0.3::DOUBLE AS test_size, 42::INTEGER AS random_state, NULL::VARCHAR AS stratify_column FROM split""")
def _(spark, sf):
    return split_summary(train_test_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey"))


# ---- profile ------------------------------------------------------------------------------------

TEXT, WHOLE, REAL = "text", "whole", "real"
LINEITEM = {
    "l_orderkey": WHOLE, "l_partkey": WHOLE, "l_suppkey": WHOLE, "l_linenumber": WHOLE, "l_quantity": REAL,
    "l_extendedprice": REAL, "l_discount": REAL, "l_tax": REAL, "l_returnflag": TEXT, "l_linestatus": TEXT, "l_shipdate": TEXT,
}
PROFILED = {
    "orders": {"o_orderkey": WHOLE, "o_custkey": WHOLE, "o_orderstatus": TEXT, "o_totalprice": REAL, "o_orderdate": TEXT, "o_orderpriority": TEXT},
    "customer": {"c_custkey": WHOLE, "c_name": TEXT, "c_nationkey": WHOLE, "c_acctbal": REAL, "c_mktsegment": TEXT},
    "documents": {"doc_id": WHOLE, "text": TEXT, "lang": TEXT, "source": TEXT, "n_chars": WHOLE},
    "labels": {"doc_id": WHOLE, "quality": WHOLE, "toxic": WHOLE},
    "events": {"event_id": WHOLE, "ts": TEXT, "user_id": WHOLE, "event_type": TEXT, "value": REAL, "props": TEXT},
}


def counts_sql(dataset: str, relation: str, columns: dict[str, str]) -> str:
    """Counts of each column as rows; the source of the type rules."""
    parts = []
    for i, (c, kind) in enumerate(columns.items()):
        share = "1.0" if kind == WHOLE else f"avg(CASE WHEN {c} - floor({c}) < 1e-9 THEN 1.0 ELSE 0.0 END)" if kind == REAL else "0.0"
        parts.append(
            f"SELECT '{dataset}' AS dataset, '{c}' AS \"column\", {i} AS position, {str(kind != TEXT).lower()} AS numeric, "
            f"count(*) AS n_total, count({c}) AS n_non_null, count(DISTINCT {c}) AS n_unique, {share}::DOUBLE AS int_share FROM {relation}"
        )
    return " UNION ALL ".join(parts)


TYPES = """CASE WHEN n_unique <= 1 THEN 'constant'
  WHEN numeric AND int_share > 0.99 AND n_unique / n_non_null >= 0.9 THEN 'id_like'
  WHEN NOT numeric AND n_unique / n_non_null >= 0.9 AND 1.0 - n_unique / n_non_null <= 0.05 THEN 'id_like'
  WHEN n_unique = 2 THEN 'binary'
  WHEN numeric AND n_unique <= 10 THEN 'numeric_ordinal' WHEN numeric THEN 'numeric_continuous'
  WHEN n_unique > 20 THEN 'categorical_high_cardinality' ELSE 'categorical_low_cardinality' END"""
COUNT_FIELDS = """dataset, "column", position::INTEGER AS position, """ + TYPES + """ AS feature_type, n_total, n_non_null,
  round((n_total - n_non_null) / n_total, 6)::DOUBLE AS missing_rate, n_unique,
  list_aggregate(list_filter([CASE WHEN n_unique <= 1 THEN 'constant' END, CASE WHEN (""" + TYPES + """) = 'id_like' THEN 'id_like' END,
    CASE WHEN (n_total - n_non_null) / n_total > 0.4 THEN 'high_missing' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS issues"""


def _count_columns(p: DataFrame) -> DataFrame:
    return p.select(
        "dataset", "column", "position", "feature_type", "n_total", "n_non_null", "missing_rate", "n_unique",
        F.nullif(F.array_join("issues", ","), F.lit("")).alias("issues"),
    )


@query("profile_counts", f"WITH {LINEITEM_GAPS}, c AS ({counts_sql('lineitem', 'lineitem_gaps', LINEITEM)}) SELECT {COUNT_FIELDS} FROM c")
def _(spark, sf):
    return _count_columns(profile(lineitem_gaps(spark, sf), "lineitem"))


@query("profile_types", "WITH c AS (" + " UNION ALL ".join(counts_sql(t, t, c) for t, c in PROFILED.items()) + f") SELECT {COUNT_FIELDS} FROM c")
def _(spark, sf):
    out = None
    for t in PROFILED:
        rows = _count_columns(profile(table(spark, sf, t), t))
        out = rows if out is None else out.unionByName(rows)
    return out


SHAPED = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_suppkey"]


def shape_sql(relation: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(skewness({c}), 6) AS skewness, count({c}) AS outlier_n_used,
    CASE WHEN any_value(q3 - q1) = 0 THEN 'iqr_zero' ELSE 'ok' END AS outlier_confidence,
    round(avg(CASE WHEN {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS outlier_rate,
    round(any_value(q1 - 1.5 * (q3 - q1)), 9) AS lower_bound, round(any_value(q3 + 1.5 * (q3 - q1)), 9) AS upper_bound
  FROM {relation}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {relation}) WHERE {c} IS NOT NULL"""
        for c in columns
    )


@query("profile_shape", f"WITH {LINEITEM_GAPS} {shape_sql('lineitem_gaps', SHAPED)}")
def _(spark, sf):
    p = profile(lineitem_gaps(spark, sf).select(*SHAPED), "lineitem")
    return digits(p.select("column", "skewness", "outlier_n_used", "outlier_confidence", "outlier_rate", "lower_bound", "upper_bound"))


@query("normalize_names", """SELECT c_custkey AS customer_no, c_name AS full_name, c_nationkey::INTEGER AS nation, c_acctbal AS balance_usd,
  CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END AS rich FROM customer""")
def _(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias(" Customer No. "), F.col("c_name").alias("Full Name"), F.col("c_nationkey").alias("nation!"),
        F.col("c_acctbal").alias("Balance (USD)"), (F.col("c_acctbal") > 5000).alias("RICH"),
    )
    return ingest(c)


# ---- cleaning -----------------------------------------------------------------------------------

EVEN = f"{ORDERS_GAPS}, train AS (SELECT * FROM orders_gaps WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0)"
ORDER_COLUMNS = {"o_orderkey": WHOLE, "o_custkey": WHOLE, "o_orderstatus": TEXT, "o_totalprice": REAL, "o_orderpriority": TEXT, "o_rush": WHOLE}
NUMBERS = ["o_custkey", "o_totalprice", "o_rush"]
STATS = " UNION ALL ".join(
    f"""SELECT '{c}' AS col, skewness({c}) AS sk, avg({c}) AS mean, median({c})::DOUBLE AS med, any_value(q1) - 1.5 * any_value(q3 - q1) AS lo,
  any_value(q3) + 1.5 * any_value(q3 - q1) AS hi,
  avg(CASE WHEN {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) THEN 1.0 ELSE 0.0 END) AS outr
  FROM train, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM train) WHERE {c} IS NOT NULL"""
    for c in NUMBERS
)
FITTED = f"""{EVEN}, stats AS ({STATS}), c AS ({counts_sql('orders', 'train', ORDER_COLUMNS)}),
rules AS (SELECT {COUNT_FIELDS}, stats.*, numeric FROM c LEFT JOIN stats ON col = "column"),
fitted AS (SELECT *, coalesce(issues, '') <> '' AS dropped,
  CASE WHEN coalesce(issues, '') <> '' THEN NULL WHEN feature_type LIKE 'numeric%' THEN CASE WHEN abs(round(sk, 6)) < 0.5 AND round(outr::DOUBLE, 6) < 0.05 THEN 'mean' ELSE 'median' END
    WHEN feature_type = 'binary' AND numeric THEN 'median' ELSE 'constant_missing' END AS method FROM rules)"""


def _train(spark, sf) -> DataFrame:
    return orders_gaps(spark, sf).filter((F.col("o_orderkey") % 2 == 0) | (F.col("o_orderkey") % 3 == 0))


def _model(spark, sf):
    return Prep().fit(_train(spark, sf), "orders")


@query("prep_state", f"""WITH {FITTED} SELECT "column", position, feature_type, missing_rate, dropped AS "drop", NOT dropped AND missing_rate > 0 OR dropped AND missing_rate > 0 AS add_missing_indicator,
  method, round(CASE method WHEN 'mean' THEN mean WHEN 'median' THEN med END, 6) AS num_value, CASE WHEN method = 'constant_missing' THEN 'missing' END AS str_value,
  round(CASE WHEN NOT dropped THEN lo END, 6) AS lower_bound, round(CASE WHEN NOT dropped THEN hi END, 6) AS upper_bound FROM fitted""")
def _(spark, sf):
    s = _model(spark, sf).state(spark)
    return digits(s.select(
        "column", "position", "feature_type", "missing_rate", "drop", "add_missing_indicator",
        F.col("imputation.method").alias("method"), F.col("imputation.num_value").alias("num_value"),
        F.col("imputation.str_value").alias("str_value"), F.col("outlier_flag.lower_bound").alias("lower_bound"),
        F.col("outlier_flag.upper_bound").alias("upper_bound"),
    ), 6)


# Kept columns of the fitted state: o_custkey, o_orderstatus, o_totalprice, o_orderpriority, o_rush.
CLEAN = """clean AS (SELECT x.o_orderkey AS row_key, coalesce(x.o_custkey::DOUBLE, fc.v) AS o_custkey, coalesce(x.o_orderstatus, 'missing') AS o_orderstatus,
  coalesce(x.o_totalprice, ft.v) AS o_totalprice, coalesce(x.o_orderpriority, 'missing') AS o_orderpriority,
  coalesce(x.o_rush::DOUBLE, fr.v) AS o_rush,
  (x.o_totalprice IS NULL)::INTEGER AS o_totalprice__is_missing, (x.o_orderpriority IS NULL)::INTEGER AS o_orderpriority__is_missing,
  (x.o_rush IS NULL)::INTEGER AS o_rush__is_missing,
  (coalesce(x.o_custkey::DOUBLE, fc.v) < fc.lo OR coalesce(x.o_custkey::DOUBLE, fc.v) > fc.hi)::INTEGER AS o_custkey__is_outlier,
  (coalesce(x.o_totalprice, ft.v) < ft.lo OR coalesce(x.o_totalprice, ft.v) > ft.hi)::INTEGER AS o_totalprice__is_outlier,
  (coalesce(x.o_rush::DOUBLE, fr.v) < fr.lo OR coalesce(x.o_rush::DOUBLE, fr.v) > fr.hi)::INTEGER AS o_rush__is_outlier
  FROM source x, fill fc, fill ft, fill fr WHERE fc.col = 'o_custkey' AND ft.col = 'o_totalprice' AND fr.col = 'o_rush')"""
FILL = "fill AS (SELECT col, lo, hi, CASE method WHEN 'mean' THEN mean ELSE med END AS v FROM fitted WHERE col IS NOT NULL)"
CLEAN_COLUMNS = """row_key, round(o_custkey, 6) AS o_custkey, o_custkey__is_outlier, o_orderstatus, round(o_totalprice, 6) AS o_totalprice,
  o_totalprice__is_missing, o_totalprice__is_outlier, o_orderpriority, o_orderpriority__is_missing, round(o_rush, 6) AS o_rush, o_rush__is_missing, o_rush__is_outlier"""


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("row_key", F.col("o_orderkey"))


@query("prep_transform", f"WITH {FITTED}, {FILL}, source AS (SELECT * FROM train), {CLEAN} SELECT {CLEAN_COLUMNS} FROM clean")
def _(spark, sf):
    return digits(_model(spark, sf).transform(_keyed(_train(spark, sf)), keep=("row_key",)), 6)


NEW_ROWS = """source AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE o_custkey END AS o_custkey, o_orderstatus,
  o_totalprice * 3 AS o_totalprice, NULL::VARCHAR AS o_orderpriority, o_rush FROM orders_gaps)"""


def _new_rows(spark, sf) -> DataFrame:
    """Rows of another layout: a column gone, one extra, and numbers that come as text."""
    return orders_gaps(spark, sf).select(
        "o_orderkey", F.when(F.col("o_orderkey") % 4 == 1, "n/a?").otherwise(F.col("o_custkey").cast("string")).alias("o_custkey"),
        "o_orderstatus", (F.col("o_totalprice") * 3).alias("o_totalprice"), "o_rush", F.lit(1).alias("extra"),
    )


@query("prep_transform_new", f"WITH {FITTED}, {FILL}, {NEW_ROWS}, {CLEAN} SELECT {CLEAN_COLUMNS} FROM clean")
def _(spark, sf):
    return digits(_model(spark, sf).transform(_keyed(_new_rows(spark, sf)), keep=("row_key",)), 6)


LOG = f"""WITH {FITTED}, {FILL}, source AS (SELECT * FROM train), {CLEAN},
rates AS (SELECT 'o_custkey' AS col, avg(o_custkey__is_outlier) AS r FROM clean UNION ALL SELECT 'o_totalprice', avg(o_totalprice__is_outlier) FROM clean
  UNION ALL SELECT 'o_rush', avg(o_rush__is_outlier) FROM clean)
SELECT 'dropped' AS kind, "column" AS name, NULL AS source, NULL AS method, NULL::DOUBLE AS num_value, NULL AS status, NULL::DOUBLE AS rate FROM fitted WHERE dropped
UNION ALL SELECT 'imputed', "column", NULL, method, round(CASE method WHEN 'mean' THEN mean WHEN 'median' THEN med END, 6), NULL, NULL FROM fitted WHERE NOT dropped
UNION ALL SELECT 'engineered', "column" || '__is_missing', "column", NULL, NULL, 'missing_indicator', NULL FROM fitted WHERE NOT dropped AND missing_rate > 0
UNION ALL SELECT 'engineered', f.col || '__is_outlier', f.col, 'iqr', NULL, 'outlier_flag', round(r::DOUBLE, 6) FROM fitted f JOIN rates USING (col) WHERE NOT dropped"""


@query("prep_log", LOG)
def _(spark, sf):
    model = _model(spark, sf)
    log = model.transform_log(model.transform(_train(spark, sf)))
    return digits(log.select("kind", "name", "source", "method", "num_value", "status", F.col("outlier_rate_on_transformed").alias("rate")), 6)


@query("prep_summary", f"""WITH {FITTED} SELECT 'orders' AS dataset, 'fit_transform' AS mode, (SELECT count(*) FROM train) AS input_rows, 6::INTEGER AS input_cols,
  (SELECT count(*) FROM train) AS output_rows,
  (sum(CASE WHEN dropped THEN 0 ELSE 1 + (missing_rate > 0)::INTEGER + (col IS NOT NULL)::INTEGER END))::INTEGER AS output_cols,
  string_agg(CASE WHEN dropped THEN "column" END, ',' ORDER BY position) AS dropped_columns FROM fitted""")
def _(spark, sf):
    model, train = _model(spark, sf), _train(spark, sf)
    s = model.summary(train, model.transform(train), "fit_transform")
    return s.drop("engineered_columns").withColumn("dropped_columns", F.array_join("dropped_columns", ","))


@query("stream_clean", f"WITH {FITTED}, {FILL}, source AS (SELECT * FROM orders_gaps), {CLEAN} SELECT {CLEAN_COLUMNS} FROM clean")
def _(spark, sf):
    """Cleaning on a stream of the orders file; the sink is read back as a table."""
    import uuid

    model = _model(spark, sf)
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf, "orders").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf)
    gaps = (
        raw.drop("o_orderdate")
        .withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")))
        .withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")))
        .withColumn("o_rush", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")))
    )
    write_clean(_keyed(gaps), model, f"{base}/rows", f"{base}/state", keep=("row_key",), once=True).awaitTermination()
    return digits(spark.read.parquet(f"{base}/rows"), 6)


# ---- sources and sinks --------------------------------------------------------------------------


def _scratch(spark, name: str) -> str:
    import uuid

    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("csv_roundtrip", """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity, l_extendedprice,
  CASE WHEN l_orderkey % 7 <> 0 THEN l_tax END AS l_tax, CASE WHEN l_orderkey % 5 <> 0 THEN l_returnflag END AS l_returnflag, l_linestatus FROM lineitem""")
def _(spark, sf):
    """Write CSV, with missing values in different spellings, and read it with inferred types."""
    df = lineitem_gaps(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax", "l_returnflag", "l_linestatus")
    spelled = df.withColumn("l_tax", F.coalesce(F.col("l_tax").cast("string"), F.lit("NaN"))).withColumn(
        "l_returnflag", F.coalesce("l_returnflag", F.when(F.col("l_linenumber") % 2 == 0, "N/A").otherwise("NULL"))
    )
    path = _scratch(spark, "csv")
    writers.write_csv(spelled, path)
    return readers.read_csv(spark, path)


@query("csv_dialect", """SELECT o_orderkey::VARCHAR AS id, o_orderstatus AS status, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS priority FROM orders""")
def _(spark, sf):
    """A file without header, two-character separator and '?' for missing."""
    path = _scratch(spark, "dialect")
    df = orders_gaps(spark, sf).select(F.concat_ws(", ", F.col("o_orderkey").cast("string"), "o_orderstatus", F.coalesce("o_orderpriority", F.lit("?"))).alias("line"))
    writers.write_text(df, path, "line")
    return readers.read_csv(spark, path, names=["id", "status", "priority"], sep=", ", na_values=["?"], schema="id string, status string, priority string")


@query("stage_store", "SELECT p_type AS dataset, p_partkey, p_brand, p_retailprice FROM part")
def _(spark, sf):
    store = writers.StageStore(spark, _scratch(spark, "stages"))
    store.save("data", "parts", table(spark, sf, "part").select(F.col("p_type").alias("dataset"), "p_partkey", "p_brand", "p_retailprice"))
    return store.load("data", "parts").select("dataset", "p_partkey", "p_brand", "p_retailprice")


@query("state_roundtrip", f"""WITH {FITTED} SELECT "column", position, dropped AS "drop", method FROM fitted""")
def _(spark, sf):
    from siftwright.operators.prep import PrepModel

    path = _scratch(spark, "state")
    _model(spark, sf).save(spark, path)
    return PrepModel.load(spark, path).state(spark).select("column", "position", "drop", F.col("imputation.method").alias("method"))


@query("dataset_names", r"""SELECT page_id, CASE WHEN s LIKE '%\_train\_hypotheses' ESCAPE '\' THEN left(s, -17) WHEN s LIKE '%\_hypotheses' ESCAPE '\' THEN left(s, -11) ELSE s END AS dataset
  FROM (SELECT page_id, 'page' || page_id || CASE page_id % 3 WHEN 0 THEN '_train_hypotheses' WHEN 1 THEN '_hypotheses' ELSE '' END AS s FROM pages)""")
def _(spark, sf):
    end = F.when(F.col("page_id") % 3 == 0, "_train_hypotheses").when(F.col("page_id") % 3 == 1, "_hypotheses").otherwise("")
    path = F.concat(F.lit("out/run/page"), F.col("page_id").cast("string"), end, F.lit(".json"))
    return table(spark, sf, "pages").select("page_id", readers.dataset_name(path, ("_train_hypotheses", "_hypotheses")).alias("dataset"))
