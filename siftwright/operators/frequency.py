"""Value-frequency tables and ranks built on them.

V(group, value, freq) is one shuffle over the unpivoted columns. Repeated values collapse on the
map side, so a value that holds a third of all rows costs one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwright.plans.materialize import pin, small_frame

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)

# Text longer than this is counted by its digest, so long texts are never shuffled.
LONG_TEXT = 64


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, INTEGRAL + FRACTIONAL)


def as_double(name: str) -> Column:
    """Column as DOUBLE with NaN turned into NULL."""
    c = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(c), c)


def text_token(c: Column) -> Column:
    """A short stand-in with the same equality as the text itself."""
    return F.when(F.length(c) <= LONG_TEXT, F.concat(F.lit("="), c)).otherwise(
        F.concat(F.lit("#"), F.sha2(c, 256))
    )


def melt(df: DataFrame, columns: dict[int, Column], value: str = "value", keep=()) -> DataFrame:
    """One (cid, value) row per listed column and input row; NULL values are left out."""
    pieces: list[Column] = []
    for cid, expr in columns.items():
        pieces += [F.lit(cid), expr]
    out = df.select(*keep, F.stack(F.lit(len(columns)), *pieces).alias("cid", value))
    return out.filter(F.col(value).isNotNull())


def numeric_counts(df: DataFrame, columns: list[tuple[int, str]]) -> DataFrame:
    """V for numeric columns: (cid, value, exact, freq); `exact` keeps integers beyond 2**53 apart."""
    types = {f.name: f.dataType for f in df.schema.fields}
    whole = {i: F.col(f"`{c}`").cast("bigint") for i, c in columns if isinstance(types[c], INTEGRAL)}
    real = {i: as_double(c) for i, c in columns if not isinstance(types[c], INTEGRAL)}
    parts = []
    if whole:
        parts.append(
            melt(df, whole, "exact")
            .groupBy("cid", "exact")
            .agg(F.count(F.lit(1)).alias("freq"))
            .select("cid", F.col("exact").cast("double").alias("value"), "exact", "freq")
        )
    if real:
        parts.append(
            melt(df, real)
            .groupBy("cid", "value")
            .agg(F.count(F.lit(1)).alias("freq"))
            .select("cid", "value", F.lit(None).cast("bigint").alias("exact"), "freq")
        )
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def text_counts(df: DataFrame, columns: list[tuple[int, str]]) -> DataFrame:
    """V for text columns: (cid, token, freq)."""
    exprs = {i: text_token(F.col(f"`{c}`").cast("string")) for i, c in columns}
    return melt(df, exprs, "token").groupBy("cid", "token").agg(F.count(F.lit(1)).alias("freq"))


def ranged(counts: DataFrame, group: list[str], value: str = "value") -> DataFrame:
    """Range-partition a frequency table by (group, value) and pin the partition number `pid`.

    Every value is one row here, so ranges are even even when the raw values are not. Rows are
    sorted inside a range, so a reader that wants one range or one column skips the rest.
    """
    return pin(
        counts.repartitionByRange(*group, value)
        .sortWithinPartitions(*group, value)
        .withColumn("pid", F.spark_partition_id())
    )


def running(parts: DataFrame, group: list[str], value: str = "value", freq: str = "freq") -> DataFrame:
    """Add `before` (rows with a smaller value in the group) to a `ranged` table.

    Two levels: one total per (group, pid), a prefix sum over those few totals, and a window
    inside each range, so no group is ever sorted by a single task.
    """
    edges = parts.groupBy(*group, "pid").agg(F.sum(freq).alias("_part"))
    earlier = Window.partitionBy(*group).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = edges.select(
        *group, "pid", F.coalesce(F.sum("_part").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = (
        Window.partitionBy(*group, "pid").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        parts.join(offsets, [*group, "pid"])
        .withColumn(
            "before", F.col("_offset") + F.coalesce(F.sum(freq).over(inside), F.lit(0))
        )
        .drop("_offset", "pid")
    )


def mid_ranks(run: DataFrame, freq: str = "freq") -> DataFrame:
    """Average rank of each distinct value (1-based) from a `running` table."""
    return run.withColumn("rank", F.col("before") + (F.col(freq) + 1) / F.lit(2.0))


def pick_positions(parts: DataFrame, targets: list[tuple[int, int, str, int]]) -> dict:
    """Values at given positions of a `ranged` table.

    A target is (cid, pid, label, k): the k-th row (0-based) of that range. Only the ranges that
    hold a target are read, and each is ordered on its own. Returns {(cid, label): value}.
    """
    if not targets:
        return {}
    spark = parts.sparkSession
    wanted = small_frame(spark, targets, "cid int, pid int, label string, k bigint")
    inside = Window.partitionBy("cid", "pid").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    hit = (
        parts.select("cid", "pid", "value", "freq")
        .filter(F.col("pid").isin(sorted({t[1] for t in targets})))
        .join(F.broadcast(wanted.select("cid", "pid").distinct()), ["cid", "pid"], "left_semi")
        .withColumn("upto", F.sum("freq").over(inside))
        .join(F.broadcast(wanted), ["cid", "pid"])
        .filter((F.col("k") < F.col("upto")) & (F.col("k") >= F.col("upto") - F.col("freq")))
    )
    return {(r["cid"], r["label"]): r["value"] for r in hit.select("cid", "label", "value").collect()}


def quantiles(parts: DataFrame, edges: dict[int, list[tuple[int, int]]], probs: list[float]) -> dict:
    """Linear-interpolation quantiles {cid: [q, ...]} from a `ranged` table.

    `edges` gives (pid, rows) per column, so the ranges holding the positions p*(n-1) are known
    before any value is read, and all values of a column never meet in one task.
    """
    targets, plan = [], {}
    for cid, sizes in edges.items():
        n = sum(c for _, c in sizes)
        for i, p in enumerate(probs):
            low = int((n - 1) * p)
            plan[cid, i] = (n - 1) * p - low
            for side, k in (("lo", low), ("hi", min(low + 1, n - 1))):
                seen = 0
                for pid, c in sorted(sizes):
                    if k < seen + c:
                        targets.append((cid, pid, f"{side}{i}", k - seen))
                        break
                    seen += c
    found = pick_positions(parts, targets)
    out: dict[int, list[float]] = {cid: [] for cid in edges}
    for (cid, i), w in plan.items():
        low, high = found[cid, f"lo{i}"], found[cid, f"hi{i}"]
        out[cid].append(low + (high - low) * w if w else low)
    return out
