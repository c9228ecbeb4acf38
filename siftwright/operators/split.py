"""Seeded train/test split with exact sizes, plain or stratified.

The test part is the rows with the smallest hash of (key, seed). The cut is found by counting rows
per hash bucket and then ordering only the bucket that holds it; the split itself is a filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwright.plans.lookup import attach
from siftwright.plans.materialize import pin

HASH_BITS = 60
BUCKET_BITS = 18


def split_hash(key: str, seed: int) -> Column:
    """First 60 bits of md5("key:seed")."""
    text = F.concat_ws(":", F.col(f"`{key}`").cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def _bucket(h: Column) -> Column:
    return F.shiftright(h, HASH_BITS - BUCKET_BITS)


def test_count(n: Column, test_size: float) -> Column:
    return F.ceil(n * F.lit(test_size)).cast("bigint")


def train_test_split(
    df: DataFrame, key: str, test_size: float = 0.3, seed: int = 42, stratify: str | None = None
) -> DataFrame:
    """Add a column `split` with 'train' or 'test'. `key` must be unique."""
    if stratify is not None and stratify not in df.columns:
        raise ValueError(f"Stratify column not found: {stratify}")
    hashed = df.withColumn("_h", split_hash(key, seed))
    if stratify is not None:
        return _stratified(hashed, key, test_size, stratify)

    order = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = hashed.groupBy(_bucket(F.col("_h")).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    total = buckets.agg(F.sum("c").alias("n")).select("n", test_count(F.col("n"), test_size).alias("k")).first()
    if not total["n"]:
        return df.withColumn("split", F.lit("train"))
    # At most 2**18 buckets, whatever the number of rows.
    cut = (
        buckets.withColumn("before", F.coalesce(F.sum("c").over(order), F.lit(0)))
        .filter((F.col("before") < total["k"]) & (F.col("before") + F.col("c") >= total["k"]))
        .first()
    )
    if cut is None:
        return df.withColumn("split", F.lit("train"))
    last = (
        hashed.filter(_bucket(F.col("_h")) == cut["b"])
        .select("_h", F.col(f"`{key}`").alias("_k"))
        .orderBy("_h", "_k")
        .offset(total["k"] - cut["before"] - 1)
        .limit(1)
        .first()
    )
    in_test = (F.col("_h") < last["_h"]) | (
        (F.col("_h") == last["_h"]) & (F.col(f"`{key}`") <= F.lit(last["_k"]))
    )
    return hashed.withColumn("split", F.when(in_test, "test").otherwise("train")).drop("_h")


def allotments(strata: DataFrame, test_size: float) -> DataFrame:
    """Test rows per stratum by largest remainder: (s, n, k) from (s, n); the total is exact.

    Strata are sorted by ranges of their remainder; the driver sees how many each range holds, and only the range in which the last row
    to give out falls is numbered. Then who gets one is a filter, for any number of strata.
    """
    total = strata.agg(F.sum("n").alias("n")).select("n", test_count(F.col("n"), test_size).alias("want")).first()
    if not total["n"]:
        return strata.select("s", "n", F.lit(0).cast("bigint").alias("k"))
    ideal = F.col("n") * F.lit(total["want"]) / F.lit(total["n"])
    share = strata.select("s", "n", F.floor(ideal).alias("base"), (ideal - F.floor(ideal)).alias("rest"))
    share = pin(share.repartitionByRange(F.desc("rest"), F.asc("s")).sortWithinPartitions(F.desc("rest"), F.asc("s")).withColumn("pid", F.spark_partition_id()))
    ranges = share.groupBy("pid").agg(F.count(F.lit(1)).alias("c"), F.sum("base").alias("given")).orderBy("pid").collect()
    short = total["want"] - sum(r["given"] for r in ranges)
    if short <= 0:
        return share.select("s", "n", F.col("base").alias("k"))
    seen = 0
    for r in ranges:
        if seen + r["c"] >= short:
            break
        seen += r["c"]
    place = F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("rest"), "s"))
    last = share.filter(F.col("pid") == r["pid"]).withColumn("place", place).filter(F.col("place") == short - seen).first()
    more = (F.col("rest") > last["rest"]) | ((F.col("rest") == last["rest"]) & (F.col("s") <= last["s"]))
    return share.select("s", "n", (F.col("base") + more.cast("bigint")).alias("k"))


def _stratified(hashed: DataFrame, key: str, test_size: float, stratify: str) -> DataFrame:
    """Per-stratum cut from bucket counts; only the bucket at the cut is ordered."""
    rows = hashed.withColumn(
        "_s", F.coalesce(F.col(f"`{stratify}`").cast("string"), F.lit("\u0000null"))
    )
    buckets = rows.groupBy(F.col("_s").alias("s"), _bucket(F.col("_h")).alias("b")).agg(
        F.count(F.lit(1)).alias("c")
    )
    strata = buckets.groupBy("s").agg(F.sum("c").alias("n"))
    order = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        buckets.withColumn("before", F.coalesce(F.sum("c").over(order), F.lit(0)))
        .join(allotments(strata, test_size), "s")
        .filter((F.col("before") < F.col("k")) & (F.col("before") + F.col("c") >= F.col("k")))
        .select("s", "b", "n", (F.col("k") - F.col("before")).alias("need"))
        .withColumnRenamed("s", "_s")
    )
    at_cut = attach(rows.select("_s", "_h", F.col(f"`{key}`").alias("_k")), cuts, ["_s"], "n")
    place = Window.partitionBy("_s").orderBy("_h", "_k")
    last = (
        at_cut.filter(_bucket(F.col("_h")) == F.col("b"))
        .withColumn("place", F.row_number().over(place))
        .filter(F.col("place") == F.col("need"))
        .select("_s", F.col("_h").alias("_ch"), F.col("_k").alias("_ck"))
    )
    limits = strata.withColumnRenamed("s", "_s").join(last, "_s", "left")
    in_test = (F.col("_h") < F.col("_ch")) | (
        (F.col("_h") == F.col("_ch")) & (F.col(f"`{key}`") <= F.col("_ck"))
    )
    return (
        attach(rows, limits, ["_s"], "n")
        .withColumn("split", F.when(F.coalesce(in_test, F.lit(False)), "test").otherwise("train"))
        .drop("_h", "_s", "_ch", "_ck")
    )


def split_summary(
    split: DataFrame, test_size: float = 0.3, seed: int = 42, stratify: str | None = None
) -> DataFrame:
    return split.agg(
        F.count(F.lit(1)).alias("input_rows"),
        F.count_if(F.col("split") == "train").alias("train_rows"),
        F.count_if(F.col("split") == "test").alias("test_rows"),
    ).select(
        "*",
        F.lit(float(test_size)).alias("test_size"),
        F.lit(int(seed)).alias("random_state"),
        F.lit(stratify).cast("string").alias("stratify_column"),
    )
