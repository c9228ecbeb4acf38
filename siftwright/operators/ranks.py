"""Rank statistics without sorting a whole column in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.operators import frequency as V
from siftwright.plans.lookup import attach
from siftwright.plans.materialize import pin, small_frame

# Column ids from here on mark category codes in a rank table.
CODE_BASE = 1_000_000


# Columns with at most this many distinct values get their ranks from a table sent to all tasks;
# with at most SMALL_COLUMNS of them that is a bounded number of rows.
SMALL_DOMAIN = 1_024
SMALL_COLUMNS = 64


def rank_rows(
    df: DataFrame, numeric: dict[int, str], codes: dict[int, Column], rid: str = "rid"
) -> tuple[DataFrame, DataFrame]:
    """Replace values by average ranks, for columns without NULLs.

    Returns (rank table, ties). The rank table has one row per `rid` with `r<cid>` per numeric
    column and `g<cid>` per category code; `ties` holds the tie sum per column. Columns with few
    distinct values are ranked where their rows are. The others take two narrow shuffles for any
    number of columns: one to look ranks up, one to put rows together again.
    """
    exprs = {cid: V.as_double(c) for cid, c in numeric.items()}
    counts = V.melt(df, exprs).groupBy("cid", "value").agg(F.count(F.lit(1)).alias("freq"))
    parts = V.ranged(counts, ["cid"])
    table = V.mid_ranks(V.running(parts, ["cid"])).select("cid", "value", "freq", "rank")
    f = F.col("freq").cast("double")
    facts = parts.groupBy("cid").agg(F.count(F.lit(1)).alias("u"), F.sum(f * f * f - f).alias("ties")).collect()
    ties = small_frame(df.sparkSession, [(r["cid"], r["ties"]) for r in facts], "cid int, ties double")

    few = sorted((r["u"], r["cid"]) for r in facts if r["u"] <= SMALL_DOMAIN)[:SMALL_COLUMNS]
    small = [cid for _, cid in few]
    wide = df
    if small:
        found = table.filter(F.col("cid").isin(small)).collect()
        for cid in small:
            ranks = [(r["value"], r["rank"]) for r in found if r["cid"] == cid]
            lut = small_frame(df.sparkSession, ranks, f"v{cid} double, r{cid} double")
            wide = wide.join(F.broadcast(lut), exprs[cid] == F.col(f"v{cid}")).drop(f"v{cid}")
    large = {cid: e for cid, e in exprs.items() if cid not in small}
    if not large:
        return pin(wide.select(
            rid, *[f"r{cid}" for cid in numeric], *[c.cast("int").alias(f"g{k}") for k, c in codes.items()]
        )), ties

    table = table.filter(F.col("cid").isin(list(large)))
    basis = parts.filter(F.col("cid").isin(list(large)))
    long = attach(V.melt(df, large, keep=[rid]), table, ["cid", "value"], "freq", basis=basis).select(rid, "cid", "rank")
    done = {cid: F.col(f"r{cid}") for cid in small} | {CODE_BASE + k: c.cast("double") for k, c in codes.items()}
    if done:
        long = long.unionByName(V.melt(wide, done, "rank", keep=[rid]))
    rows = long.groupBy(rid).agg(
        *[F.max(F.when(F.col("cid") == cid, F.col("rank"))).alias(f"r{cid}") for cid in numeric],
        *[F.max(F.when(F.col("cid") == CODE_BASE + k, F.col("rank"))).cast("int").alias(f"g{k}") for k in codes],
    )
    return pin(rows), ties


def pair_rank_correlation(rows: DataFrame) -> DataFrame:
    """Spearman rho per pair from rows (pos, x, y) without NULLs: (pos, n, r).

    Ranks are taken inside each pair's own complete cases.
    """
    cells = pin(rows.groupBy("pos", "x", "y").agg(F.count(F.lit(1)).alias("freq")))
    side = F.inline(
        F.array(
            F.struct((F.col("pos") * 2).alias("sid"), F.col("x").alias("value"), F.col("freq").alias("f")),
            F.struct((F.col("pos") * 2 + 1).alias("sid"), F.col("y").alias("value"), F.col("freq").alias("f")),
        )
    )
    counts = cells.select(side).groupBy("sid", "value").agg(
        F.sum("f").alias("freq"), F.count(F.lit(1)).alias("cells")
    )
    parts = V.ranged(counts, ["sid"])
    table = V.mid_ranks(V.running(parts, ["sid"])).select("sid", "value", "cells", "rank")

    def with_rank(df: DataFrame, column: str, shift: int, name: str) -> DataFrame:
        one = (
            table.filter(F.col("sid") % 2 == shift)
            .select(F.floor(F.col("sid") / 2).cast("int").alias("pos"), F.col("value").alias(column), "cells",
                    F.col("rank").alias(name))
        )
        basis = parts.filter(F.col("sid") % 2 == shift)
        return attach(df, one, ["pos", column], "cells", basis=basis)

    ranked = with_rank(with_rank(cells, "x", 0, "rx"), "y", 1, "ry")
    sizes = cells.groupBy("pos").agg(F.sum("freq").alias("n"))
    f = F.col("freq").cast("double")
    middle = (F.col("n") + 1) / F.lit(2.0)
    dx, dy = F.col("rx") - middle, F.col("ry") - middle
    sums = ranked.join(F.broadcast(sizes), "pos").groupBy("pos").agg(
        F.first("n").alias("n"), F.sum(f * dx * dy).alias("xy"),
        F.sum(f * dx * dx).alias("xx"), F.sum(f * dy * dy).alias("yy"),
    )
    spread = F.sqrt(F.col("xx") * F.col("yy"))
    return sums.select("pos", "n", F.when(spread > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("xy") / spread))).alias("r"))


def pair_rank_sums(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rank sums per group from rows (pos, y, level) without NULLs.

    Returns (pos, level, n_g, rank_sum) and (pos, ties).
    """
    cells = pin(rows.groupBy("pos", "y", "level").agg(F.count(F.lit(1)).alias("freq")))
    counts = cells.groupBy("pos", F.col("y").alias("value")).agg(
        F.sum("freq").alias("freq"), F.count(F.lit(1)).alias("cells")
    )
    parts = V.ranged(counts, ["pos"])
    table = V.mid_ranks(V.running(parts, ["pos"])).select("pos", F.col("value").alias("y"), "cells", "rank")
    sums = (
        attach(cells, table, ["pos", "y"], "cells", basis=parts)
        .groupBy("pos", "level")
        .agg(F.sum("freq").alias("n_g"), F.sum(F.col("freq") * F.col("rank")).alias("rank_sum"))
    )
    f = F.col("freq").cast("double")
    return sums, parts.groupBy("pos").agg(F.sum(f * f * f - f).alias("ties"))
