"""Joining rows to a per-value table when a few values may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def attach(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    weight: str,
    basis: DataFrame | None = None,
    budget: int = BROADCAST_ROWS,
) -> DataFrame:
    """Inner-join `rows` with `table` on `keys` without a hot task.

    `table` has one row per key and `weight` counts the rows that carry the key. A key with at
    least 1/budget of the total weight is *frequent*; there are at most `budget` of those because
    the weights add up to the total, so they may be broadcast whatever the data size. All other
    keys go through a shuffle join in which no single key can exceed 1/budget of the rows.
    `basis` is a pinned frame with the same keys and weights, read for the totals.
    """
    size = (basis if basis is not None else table).agg(
        F.count(F.lit(1)).alias("n"), F.sum(weight).alias("total"), F.max(weight).alias("top")
    ).first()
    slim = table
    if size["n"] <= budget:
        return rows.join(F.broadcast(slim.drop(weight)), keys)
    cut = size["total"] / budget
    if size["top"] < cut:
        return rows.join(slim.drop(weight), keys)
    frequent = F.broadcast(slim.filter(F.col(weight) >= cut).drop(weight))
    common = rows.join(frequent, keys)
    rest = rows.join(F.broadcast(slim.filter(F.col(weight) >= cut).select(*keys)), keys, "left_anti")
    spread = rest.join(slim.filter(F.col(weight) < cut).drop(weight), keys)
    return common.unionByName(spread)
