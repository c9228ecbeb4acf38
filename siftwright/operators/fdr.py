"""False-discovery-rate control and effect filter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwright.functions.numbers import tolerant
from siftwright.operators import frequency as V
from siftwright.plans.lookup import attach
from siftwright.plans.materialize import pin


@dataclass(frozen=True)
class EffectLimits:
    alpha: float = 0.05
    min_n: int = 30
    min_abs_r: float = 0.15
    min_cramers_v: float = 0.20
    min_eta2: float = 0.05
    min_rank_biserial: float = 0.15


def usable_p(p: Column) -> Column:
    return p.isNotNull() & ~F.isnan(p) & (F.abs(p) < F.lit(float("inf")))


def numeric_fields(df: DataFrame) -> DataFrame:
    """p, effect and n read tolerantly: text that is no number becomes NULL."""
    return (
        df.withColumn("p_value", tolerant(df, "p_value"))
        .withColumn("effect", tolerant(df, "effect"))
        .withColumn("n", tolerant(df, "n").cast("bigint"))
    )


def adjust(
    df: DataFrame, by: str = "dataset", p: str = "p_value", valid: Column | None = None
) -> DataFrame:
    """Benjamini-Hochberg q per `by` for a table of tests (as many rows as column pairs).

    q = min over p' >= p of p' * m / rank(p'), capped at 1. Rows without a usable p keep a NULL q
    and do not count in m. For tables of any size use `adjust_large`.
    """
    ok = usable_p(F.col(p)) if valid is None else valid & usable_p(F.col(p))
    df = df.withColumn("_ok", ok)
    groups = Window.partitionBy(by, "_ok")
    rank = F.count(F.lit(1)).over(
        groups.orderBy(p).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    raw = F.least(F.lit(1.0), F.col(p) * F.count(F.lit(1)).over(groups) / rank)
    tail = groups.orderBy(F.col(p).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        df.withColumn("_raw", F.when(F.col("_ok"), raw))
        .withColumn("adjusted_p", F.when(F.col("_ok"), F.min("_raw").over(tail)))
        .drop("_ok", "_raw")
    )


def adjust_large(
    df: DataFrame, by: str = "dataset", p: str = "p_value", valid: Column | None = None
) -> DataFrame:
    """`adjust` for tables where one `by` value may hold most of the rows.

    Works on distinct p values: ranks come from a range-partitioned running count, and the minimum
    over larger p is the minimum inside the range and over the minima of later ranges.
    """
    ok = F.coalesce(usable_p(F.col(p)) if valid is None else valid & usable_p(F.col(p)), F.lit(False))
    counts = (
        df.filter(ok).groupBy(by, F.col(p).alias("value")).agg(F.count(F.lit(1)).alias("freq"))
    )
    parts = V.ranged(counts, [by])
    inside = Window.partitionBy(by, "pid").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    later_inside = Window.partitionBy(by, "pid").orderBy(F.col("value").desc()).rowsBetween(
        Window.unboundedPreceding, 0
    )
    edge_order = Window.partitionBy(by).orderBy("pid")
    sizes = parts.groupBy(by, "pid").agg(F.sum("freq").alias("c"))
    offsets = sizes.select(
        by, "pid",
        F.coalesce(F.sum("c").over(edge_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"),
        F.sum("c").over(Window.partitionBy(by)).alias("m"),
    )
    local = (
        parts.join(offsets, [by, "pid"])
        .withColumn("raw", F.least(F.lit(1.0), F.col("value") * F.col("m") / (F.col("off") + F.sum("freq").over(inside))))
        .withColumn("q", F.min("raw").over(later_inside))
    )
    floors = local.groupBy(by, "pid").agg(F.min("raw").alias("low")).select(
        by, "pid",
        F.min("low").over(edge_order.rowsBetween(1, Window.unboundedFollowing)).alias("later"),
    )
    table = local.join(floors, [by, "pid"]).select(
        by, F.col("value").alias(p), "freq",
        F.least("q", F.coalesce("later", F.lit(1.0))).alias("adjusted_p"),
    )
    found = attach(df.filter(ok), table, [by, p], "freq", basis=parts)
    missing = df.filter(~ok).withColumn("adjusted_p", F.lit(None).cast("double"))
    return found.select(*df.columns, "adjusted_p").unionByName(missing)


def mark_significant(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    return df.withColumn(
        "significant", F.coalesce(F.col("adjusted_p") < F.lit(alpha), F.lit(False))
    )


def big_enough(limits: EffectLimits) -> Column:
    e = F.col("effect")
    return (
        F.when(F.col("type") == "num_num", F.abs(e) >= limits.min_abs_r)
        .when(F.col("type") == "cat_cat", e >= limits.min_cramers_v)
        .when(
            F.col("type") == "num_cat",
            F.when(F.col("effect_name") == "rank_biserial", F.abs(e) >= limits.min_rank_biserial)
            .otherwise(e >= limits.min_eta2),
        )
        .otherwise(False)
    )


def keep_effects(df: DataFrame, limits: EffectLimits | None = None) -> DataFrame:
    """Significant rows with enough cases and an effect of useful size."""
    lim = limits or EffectLimits()
    return df.filter(
        F.col("significant") & (F.col("n") >= lim.min_n) & F.coalesce(big_enough(lim), F.lit(False))
    )


def correct(df: DataFrame, limits: EffectLimits | None = None, large: bool = False) -> tuple[DataFrame, DataFrame]:
    """(all associations with q and significance, the ones to keep).

    `large` is for tables that grow with data rather than with the number of column pairs.
    """
    lim = limits or EffectLimits()
    adjusted = pin(adjust_large(numeric_fields(df))) if large else adjust(numeric_fields(df))
    full = mark_significant(adjusted, lim.alpha)
    return full, keep_effects(full, lim)
