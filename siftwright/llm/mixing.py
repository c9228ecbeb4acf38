"""Mixing sources to target weights by entropy balancing.

Rates r_d minimise the entropy distance sum_d size_d * (r_d ln r_d - r_d + 1) from the corpus as it is, under one token
constraint per source: sum size_d r_d = target. The solution tilts exponentially, r_d = min(cap, exp(lambda_source)),
and lambda maximises the concave dual target * lambda - sum size_d exp(lambda), found by Newton steps whose sums
Spark takes over (source, size) cells. Rates are then rounded to whole copies inside blocks of a source, long
documents first, so that each block's error ends as small as its short documents.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwright.llm.common import WORD, pin, unpin

WEIGHTS, CAP = (5.0, 2.0, 1.0), 3.0
#: Documents per rounding block.
BLOCK_ROWS = 2048
TOLERANCE, MAX_STEPS = 1e-10, 100


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, size, mark): size counts words, a null text has none; mark orders rows the same way in every run."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.xxhash64(F.col(f"`{id_col}`"), text).alias("mark"),
    )


def targets(sources: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Adds `target` to one row per source (source, source_size): weights repeat in code point order, null last.

    Targets share the total by weight but stop at cap * source_size; what is cut off is shared again. In the
    order of cap * size / weight the capped sources come first: the water level at a source is what the
    ones before it leave, over the weights from it on. The windows hold one row per source, no documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    rows = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    rows = rows.withColumn("limit_", F.col("source_size") * cap)
    fill = Window.orderBy(F.col("limit_") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    every = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("limit_").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(rest)
    capped = level * F.col("weight") >= F.col("limit_")
    # the first source that is not capped sets the level for all after it
    level = F.max(F.when(~capped, level)).over(every)
    return rows.withColumn("capped_", capped).withColumn(
        "target", F.when(F.col("capped_"), F.col("limit_")).otherwise(level * F.col("weight")).cast("double")
    ).select("source", "source_size", "target")


def tilts(cells: DataFrame, goals: DataFrame, cap: float) -> DataFrame:
    """(source, source_size, target, tilt): the dual solution. `cells` has (source, size, n).

    One Newton step a round for all sources at once, taken on the logarithm of each constraint: where no rate is
    capped that is a straight line, so it neither overshoots nor creeps. Masses and slopes are summed over the
    cells by Spark, and only the largest relative gap comes to the driver. A source without words keeps tilt 0.
    """
    state = pin(goals.withColumn("tilt", F.lit(0.0)))
    free = F.exp("tilt") < cap
    rate = F.when(free, F.exp("tilt")).otherwise(cap)
    for _ in range(MAX_STEPS):
        mass = F.col("n") * F.col("size") * rate
        sums = cells.alias("c").join(state.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).groupBy(F.col("s.source").alias("source")).agg(
            F.sum(mass).alias("mass"), F.sum(F.when(free, mass).otherwise(0.0)).alias("slope"),
            F.first("target").alias("target"), F.first("source_size").alias("source_size"), F.first("tilt").alias("tilt"),
        )
        live = (F.col("mass") > 0) & (F.col("target") > 0)
        gap = F.when(live, F.log(F.col("target") / F.col("mass"))).otherwise(0.0)
        step = gap * F.when(F.col("slope") > 0, F.col("mass") / F.col("slope")).otherwise(1.0)
        now = pin(sums.select("source", "source_size", "target", F.abs(gap).alias("gap"), (F.col("tilt") + step).alias("tilt")))
        worst = now.agg(F.max("gap")).first()[0] or 0.0
        unpin(state)
        state = now
        if worst < TOLERANCE:
            break
    return state.select("source", "source_size", "target", "tilt")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, cap: float = CAP, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, mark, source, size, source_size, target, rate, copies) for every row of `docs`.

    Null sources are one source. Null and empty texts have size 0 and take one copy. Copies are the rate rounded up or down,
    never over `cap`. Repeated rows are rounded one by one; rows that agree in id and text may differ in
    copies, as a set they are the same in every run. An empty table gives an empty result.
    """
    rows = pin(sized(docs, id_col, text_col, source_col))
    cells = pin(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    per_source = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("rows_"))
    state = tilts(cells, targets(per_source, weights, cap), cap).alias("s")
    state = state.join(per_source.select(F.col("source").alias("of"), "rows_"), F.col("s.source").eqNullSafe(F.col("of"))).drop("of")
    rated = rows.alias("d").join(state.select(F.col("source").alias("of"), "source_size", "target", "rows_", F.least(F.exp("tilt"), F.lit(float(cap))).alias("rate")), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    blocked = rated.withColumn("block", F.pmod(F.xxhash64("mark", "id"), F.ceil(F.col("rows_") / block_rows)))

    def round_off(block: pa.Table) -> pa.Table:
        block = block.take(pc.sort_indices(block, [("size", "descending"), ("mark", "ascending"), ("id", "ascending")]))
        owed, copies = 0.0, []
        for size, rate in zip(block["size"].to_pylist(), block["rate"].to_pylist()):
            low = int(rate + 1e-9)
            extra = size * (rate - low)
            # one copy more if that leaves the running error smaller
            take = int(size > 0 and low < cap and rate - low > 1e-9 and owed + extra > size / 2)
            owed += extra - take * size
            copies.append(low + take if size else 1)
        return block.select(["id", "mark", "source", "size", "source_size", "target", "rate"]).append_column("copies", pa.array(copies, pa.int32()))

    kind = rows.schema["id"].dataType.simpleString()
    return blocked.groupBy("source", "block").applyInArrow(
        round_off, f"id {kind}, mark bigint, source string, size bigint, source_size bigint, target double, rate double, copies int"
    )
