"""Reading tables and the result files of earlier runs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwright import schemas
from siftwright.operators.intake import parse
from siftwright.plans.materialize import pin, small_frame

# Texts that a CSV reader takes for a missing value.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

def dataset_name(path: Column, suffixes: tuple[str, ...] = ()) -> Column:
    """File stem without the first matching suffix in `suffixes`."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    out = stem
    for s in reversed(suffixes):
        short = F.substring(stem, F.lit(1), F.length(stem) - F.lit(len(s)))
        out = F.when(stem.endswith(s), short).otherwise(out)
    return out


def _kinds(df: DataFrame) -> dict[str, str]:
    """Type of each text column: bigint, double, boolean or string; one scan."""
    aggs = []
    for i, c in enumerate(df.columns):
        v = F.trim(F.col(f"`{c}`"))
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.count_if(v.rlike(r"^[+-]?\d+$") & v.try_cast("bigint").isNotNull()).alias(f"i{i}"),
            F.count_if(v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") | F.lower(v).isin("inf", "-inf", "infinity", "-infinity")).alias(f"d{i}"),
            F.count_if(v.isin("True", "False", "TRUE", "FALSE", "true", "false")).alias(f"b{i}"),
        ]
    row = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(df.columns):
        n = row[f"n{i}"]
        out[c] = (
            "double" if n == 0 else "bigint" if row[f"i{i}"] == n else "double" if row[f"d{i}"] == n
            else "boolean" if row[f"b{i}"] == n else "string"
        )
    return out


def read_csv(
    spark: SparkSession,
    path: str,
    names: list[str] | None = None,
    sep: str = ",",
    na_values: list[str] | None = None,
    schema: str | T.StructType | None = None,
    multiline: bool = False,
) -> DataFrame:
    """A CSV table with missing-value tokens as NULL and types inferred from what is left.

    `names` reads a file without header. `schema` skips the inference scan. `multiline` reads
    line breaks inside quotes; each file is then read by one task, so leave it off for large files without any.
    """
    tokens = NA_TOKENS + list(na_values or [])
    reader = spark.read.option("sep", sep).option("header", names is None).option("quote", '"').option("escape", '"').option("multiLine", multiline)
    if names is not None:
        reader = reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in names]))
    text = reader.csv(path)
    text = text.select(*[F.when(~F.trim(F.col(f"`{c}`")).isin(tokens), F.col(f"`{c}`")).alias(c) for c in text.columns])
    if schema is not None:
        fields = (schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)).fields
        return text.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in fields])
    kinds = _kinds(text)

    def typed(c: str) -> Column:
        q = F.col(f"`{c}`")
        return q if kinds[c] == "string" else F.trim(q).cast(kinds[c])

    return text.select(*[typed(c).alias(c) for c in text.columns])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def empty_associations(spark: SparkSession) -> DataFrame:
    return small_frame(spark, [], schemas.FDR + ", pair_pos int")


def read_associations(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """An association file in fixed columns; a missing or empty file gives an empty table.

    `pair_pos` is taken from the file, or else the order of rows by part file and position in it. Such files have
    one row per column pair, so numbering them is a small sort.
    """
    try:
        raw = spark.read.option("header", True).option("escape", '"').csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return empty_associations(spark)
        raise
    if not raw.columns:
        return empty_associations(spark)
    want = T.StructType.fromDDL(schemas.FDR + ", pair_pos int")
    have = {"dataset": F.lit(dataset)}
    if "pair_pos" not in raw.columns:
        placed = raw.withColumns({"_file": F.input_file_name(), "_row": F.monotonically_increasing_id()})
        raw = placed.withColumn("pair_pos", F.row_number().over(Window.orderBy("_file", "_row")) - 1)
    cols = []
    for f in want.fields:
        c = have.get(f.name, F.col(f.name) if f.name in raw.columns else F.lit(None))
        if f.name == "n":
            c = c.try_cast("double")
        cols.append(c.try_cast(f.dataType).alias(f.name))
    return pin(raw.select(*cols))


def _whole_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(
        F.col("value"), F.input_file_name().alias("path")
    )


PROFILE_ITEM = """struct<feature_type:string,dtype:string,n_total:bigint,n_non_null:bigint,
missing_rate:double,n_unique:bigint,skewness:double,outlier_method:string,outlier_n_used:bigint,
outlier_confidence:string,outlier_rate:double,lower_bound:double,upper_bound:double,
issues:array<string>,suggested_actions:array<string>,preprocessing_leakage_note:string>"""


def read_profile(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """Profile rows from JSON keyed by column name."""
    name = F.lit(dataset) if dataset else dataset_name(F.col("path"), ("_profile",))
    items = _whole_file(spark, path).select(
        name.alias("dataset"), F.posexplode(F.from_json("value", f"map<string,{PROFILE_ITEM}>")).alias("position", "column", "v")
    )
    return items.select("dataset", "column", "position", "v.*")


def read_state(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """Cleaning state from JSON keyed by column name."""
    item = (
        "struct<feature_type:string,dtype:string,missing_rate:double,drop:boolean,drop_actions:array<string>,"
        "add_missing_indicator:boolean,imputation:struct<method:string,value:string>,"
        "outlier_flag:struct<enabled:boolean,method:string,lower_bound:double,upper_bound:double>>"
    )
    name = F.lit(dataset) if dataset else dataset_name(F.col("path"), ("_preprocessing_state",))
    rows = _whole_file(spark, path).select(
        name.alias("dataset"),
        F.posexplode(F.from_json("value", f"struct<columns:map<string,{item}>>")["columns"]).alias("position", "column", "v"),
    )
    number = F.col("v.imputation.method").isin("mean", "median")
    imputation = F.when(
        F.col("v.imputation.method").isNotNull(),
        F.struct(
            F.col("v.imputation.method").alias("method"),
            F.when(number, F.col("v.imputation.value").try_cast("double")).alias("num_value"),
            F.when(~number, F.col("v.imputation.value")).alias("str_value"),
        ),
    )
    return rows.select(
        "dataset", "column", "position", "v.feature_type", "v.dtype", "v.missing_rate", "v.drop",
        "v.drop_actions", "v.add_missing_indicator", imputation.alias("imputation"), "v.outlier_flag",
    )


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """Pack files as rows (dataset, n_edges, n_variables, pack_json)."""
    doc = F.try_parse_json("value")
    return _whole_file(spark, path).select(
        F.variant_get(doc, "$.dataset", "string").alias("dataset"),
        F.variant_get(doc, "$.summary.n_edges", "int").alias("n_edges"),
        F.variant_get(doc, "$.summary.n_variables", "int").alias("n_variables"),
        F.col("value").alias("pack_json"),
    )


def read_responses(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """Response files as rows (dataset, response)."""
    name = F.lit(dataset) if dataset else dataset_name(F.col("path"), ("_hypotheses", "_hypothesis_raw"))
    return _whole_file(spark, path).select(name.alias("dataset"), F.col("value").alias("response"))


def read_hypotheses(spark: SparkSession, path: str, dataset: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(hypotheses, errors) of response files."""
    return parse(read_responses(spark, path, dataset))
