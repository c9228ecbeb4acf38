"""Column profiles: counts, types, shape and outlier fences, one row per column."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwright import schemas
from siftwright.operators import frequency as V
from siftwright.plans.materialize import small_frame
from siftwright.plans.together import together

# Fixed text that every profile row carries.
LEAKAGE_NOTE = (
    "Profiling is read-only. Train preprocessing state must be reused when transforming test data."
)

# Second and third moments below this size count as zero.
TINY_MOMENT = 1e-14


@dataclass(frozen=True)
class ProfileConfig:
    high_cardinality_threshold: int = 20
    missing_threshold: float = 0.4
    min_stats_n: int = 30
    id_like_unique_ratio: float = 0.90
    id_like_max_dup_ratio: float = 0.05
    drop_id_like: bool = True
    drop_high_missing: bool = True
    drop_constant: bool = True
    treat_small_numeric_as_ordinal: bool = True
    small_numeric_unique_max: int = 10
    on_complex: str = "error"


def normalize_names(names: list[str]) -> list[str]:
    out = [re.sub(r"[^a-z0-9_]", "", n.strip().lower().replace(" ", "_")) for n in names]
    clash = sorted({n for n in out if out.count(n) > 1})
    if clash:
        raise ValueError(f"column names collide after normalization: {clash}")
    return out


def ingest(df: DataFrame, on_complex: str = "error") -> DataFrame:
    """Normalized names; booleans as 0/1, dates as text, NaN as NULL; nested columns refused."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)
    bad = [f.name for f in df.schema.fields if isinstance(f.dataType, nested)]
    if bad:
        if on_complex != "skip":
            raise ValueError(f"columns of nested or binary type cannot be profiled: {bad}")
        df = df.drop(*bad)
    df = df.toDF(*normalize_names(df.columns))

    def plain(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            return c.cast("int").alias(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            return F.when(~F.isnan(c), c).alias(f.name)
        if isinstance(f.dataType, V.INTEGRAL + V.FRACTIONAL + (T.StringType,)):
            return c
        return c.cast("string").alias(f.name)

    return df.select(*[plain(f) for f in df.schema.fields])


def dtype_label(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, V.INTEGRAL):
        return "int64"
    return "float64" if isinstance(dtype, V.FRACTIONAL) else "object"


def feature_type(cfg: ProfileConfig) -> Column:
    """Logical type from `numeric`, `is_bool`, `n_non_null`, `n_unique`, `int_share`."""
    n, u = F.col("n_non_null"), F.col("n_unique")
    ratio = u / F.when(n > 0, n)
    id_like = F.when(
        F.col("numeric"), (F.col("int_share") > 0.99) & (ratio >= cfg.id_like_unique_ratio)
    ).otherwise(
        (ratio >= cfg.id_like_unique_ratio) & (1.0 - ratio <= cfg.id_like_max_dup_ratio)
    )
    small = F.lit(cfg.treat_small_numeric_as_ordinal) & (u <= cfg.small_numeric_unique_max)
    return (
        F.when(u <= 1, "constant")
        .when(id_like & ~F.col("is_bool"), "id_like")
        .when(F.col("is_bool") | (u == 2), "binary")
        .when(F.col("numeric") & small, "numeric_ordinal")
        .when(F.col("numeric"), "numeric_continuous")
        .when(u > cfg.high_cardinality_threshold, "categorical_high_cardinality")
        .otherwise("categorical_low_cardinality")
    )


def text_stats(df: DataFrame, columns: list[tuple[int, str]]) -> dict[int, dict]:
    """Counts per text column."""
    if not columns:
        return {}
    per_column = V.text_counts(df, columns).groupBy("cid").agg(
        F.sum("freq").alias("n_non_null"), F.count(F.lit(1)).alias("n_unique")
    )
    return {r["cid"]: r.asDict() for r in per_column.collect()}


def numeric_stats(df: DataFrame, columns: list[tuple[int, str]]) -> dict[int, dict]:
    """Counts, moments, quartiles, fences and outlier share per numeric column.

    The source is scanned once; everything else reads the pinned frequency table: one pass for
    sums per range, one over the few ranges that hold a quartile, one for moments and outliers.
    What reaches the driver is one row per column and range.
    """
    if not columns:
        return {}
    counts = V.ranged(V.numeric_counts(df, columns), ["cid"])
    f, v = F.col("freq"), F.col("value")
    whole = F.col("exact").isNotNull() | (F.pmod(v, F.lit(1.0)) < 1e-9)
    edges = counts.groupBy("cid", "pid").agg(
        F.sum(f).alias("n"), F.count(F.lit(1)).alias("u"), F.sum(v * f).alias("s"),
        F.sum(F.when(whole, f).otherwise(0)).alias("w"),
    ).collect()
    sizes: dict[int, list[tuple[int, int]]] = {}
    stats: dict[int, dict] = {}
    for r in edges:
        sizes.setdefault(r["cid"], []).append((r["pid"], r["n"]))
        s = stats.setdefault(r["cid"], {"n_non_null": 0, "n_unique": 0, "sum": 0.0, "whole": 0})
        s["n_non_null"] += r["n"]
        s["n_unique"] += r["u"]
        s["sum"] += r["s"]
        s["whole"] += r["w"]
    if not stats:
        return {}
    quarts = V.quantiles(counts, sizes, [0.25, 0.5, 0.75])
    for cid, s in stats.items():
        q1, s["median"], q3 = quarts[cid]
        s["mean"] = s["sum"] / s["n_non_null"]
        s["int_share"] = s["whole"] / s["n_non_null"]
        s["iqr"] = q3 - q1
        s["low"], s["high"] = q1 - 1.5 * s["iqr"], q3 + 1.5 * s["iqr"]
    known = small_frame(
        df.sparkSession,
        [(cid, s["mean"], s["low"], s["high"]) for cid, s in stats.items()],
        "cid int, mean double, low double, high double",
    )
    d = v - F.col("mean")
    second = counts.join(F.broadcast(known), "cid").groupBy("cid").agg(
        F.sum(f * d * d).alias("m2"),
        F.sum(f * d * d * d).alias("m3"),
        F.sum(F.when((v < F.col("low")) | (v > F.col("high")), f).otherwise(0)).alias("n_out"),
    )
    for r in second.collect():
        stats[r["cid"]] |= r.asDict()
    return stats


def profile_rows(df: DataFrame, cfg: ProfileConfig, original: dict[str, T.DataType]) -> list:
    """Profile of an ingested table plus `mean` and `median`; as many rows as there are columns."""
    fields = df.schema.fields
    numeric = [(i, f.name) for i, f in enumerate(fields) if V.is_numeric(f.dataType)]
    text = [(i, f.name) for i, f in enumerate(fields) if not V.is_numeric(f.dataType)]
    spark = df.sparkSession
    n_total, numbers, texts = together(spark, [
        df.count, lambda: numeric_stats(df, numeric), lambda: text_stats(df, text),
    ])
    stats: dict[int, dict] = numbers | texts

    numeric_ids = {i for i, _ in numeric}
    raw = []
    for i, f in enumerate(fields):
        s = stats.get(i, {})
        raw.append(
            (
                f.name, i, i in numeric_ids,
                isinstance(original[f.name], T.BooleanType), dtype_label(original[f.name]),
                n_total, s.get("n_non_null", 0), s.get("n_unique", 0), s.get("int_share"),
                s.get("mean"), s.get("median"), s.get("m2"), s.get("m3"), s.get("iqr"),
                s.get("low"), s.get("high"), s.get("n_out"),
            )
        )
    facts = small_frame(spark, raw,
        "column string, position int, numeric boolean, is_bool boolean, dtype string, "
        "n_total bigint, n_non_null bigint, n_unique bigint, int_share double, mean double, "
        "median double, m2 double, m3 double, iqr double, low double, high double, n_out bigint",
    )
    return describe(facts, cfg).collect()


def describe(facts: DataFrame, cfg: ProfileConfig) -> DataFrame:
    """Turn per-column counts and moments into profile rows (P4-P12 as column expressions)."""
    n = F.col("n_non_null").cast("double")
    m2 = F.when(F.abs("m2") >= TINY_MOMENT, F.col("m2")).otherwise(0.0)
    m3 = F.when(F.abs("m3") >= TINY_MOMENT, F.col("m3")).otherwise(0.0)
    skew = F.when(
        n >= 3,
        F.when(m2 == 0, 0.0).otherwise(
            n * F.sqrt(F.greatest(n - 1, F.lit(0.0))) / (n - 2) * m3
            / F.pow(F.when(m2 > 0, m2), F.lit(1.5))
        ),
    )
    df = facts.withColumn("feature_type", feature_type(cfg)).withColumn(
        "exact_missing",
        F.coalesce((F.col("n_total") - n) / F.when(F.col("n_total") > 0, F.col("n_total")), F.lit(0.0)),
    )
    shaped = F.col("numeric") & ~F.col("feature_type").isin("id_like", "constant")
    enough = F.col("n_non_null") >= 5
    flat = F.coalesce(F.isnan("iqr"), F.lit(True)) | (F.col("iqr") == 0)
    confidence = (
        F.when(~enough, "low_n")
        .when(flat, "iqr_zero")
        .when(F.col("n_non_null") < cfg.min_stats_n, "medium_n")
        .otherwise("ok")
    )
    fenced = shaped & enough & ~flat
    high_missing = F.col("exact_missing") > cfg.missing_threshold

    def tags(*pairs: tuple[Column, str]) -> Column:
        return F.filter(
            F.array(*[F.when(cond, F.lit(name)) for cond, name in pairs]), lambda x: x.isNotNull()
        )

    is_const, is_id = F.col("feature_type") == "constant", F.col("feature_type") == "id_like"
    return df.select(
        "column", "position", "feature_type", "dtype", "n_total", "n_non_null",
        F.round("exact_missing", 6).alias("missing_rate"),
        "n_unique",
        F.when(shaped, F.round(skew, 6)).alias("skewness"),
        F.when(shaped, F.lit("iqr")).alias("outlier_method"),
        F.when(shaped, F.col("n_non_null")).alias("outlier_n_used"),
        F.when(shaped, confidence).alias("outlier_confidence"),
        F.when(
            shaped & enough,
            F.when(flat, 0.0).otherwise(F.round(F.col("n_out") / F.when(n > 0, n), 6)),
        ).alias("outlier_rate"),
        F.when(fenced, F.col("low")).alias("lower_bound"),
        F.when(fenced, F.col("high")).alias("upper_bound"),
        tags((is_const, "constant"), (is_id, "id_like"), (high_missing, "high_missing")).alias("issues"),
        tags(
            (is_const & F.lit(cfg.drop_constant), "drop_constant"),
            (is_id & F.lit(cfg.drop_id_like), "drop_id_like"),
            (high_missing & F.lit(cfg.drop_high_missing), "drop_high_missing"),
        ).alias("suggested_actions"),
        F.lit(LEAKAGE_NOTE).alias("preprocessing_leakage_note"),
        "mean", "median", "numeric",
    )


def profile(df: DataFrame, dataset: str = "dataset", config: ProfileConfig | None = None) -> DataFrame:
    """Profile every column of `df`; the result has one row per column."""
    cfg = config or ProfileConfig()
    table = ingest(df, cfg.on_complex)
    return profile_frame(
        df.sparkSession, dataset, profile_rows(table, cfg, original_types(df, cfg))
    )


def original_types(df: DataFrame, cfg: ProfileConfig) -> dict[str, T.DataType]:
    return dict(zip(normalize_names(df.columns), [f.dataType for f in df.schema.fields]))


def profile_frame(spark, dataset: str, rows: list) -> DataFrame:
    names = [p.split()[0] for p in schemas.PROFILE.replace("\n", " ").split(", ")]
    data = [(dataset, *[r[n] for n in names[1:]]) for r in rows]
    return small_frame(spark, data, schemas.PROFILE)
