"""Exact top-k by integer inner product, with segment statistics to skip most of the exact work.

Vectors are cut into segments of equal length. With the mean and the deviation of each segment,
|q - x|^2 >= sum len * ((mean_q - mean_x)^2 + (dev_q - dev_x)^2), and since the norms are known
exactly this bounds q.x from above by sum len * (mean_q mean_x + dev_q dev_x). Bounds are taken at COARSE
segments for all candidates of a block and at finer ones for what is left; the exact score is computed for survivors only.

Queries and candidates are cut into blocks; each pair of blocks is one row of an equi-join on the block
number, and a pair returns k rows a query. No query set is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwright.llm.common import pin
from siftwright.llm.vectors import matrix, rows_of, usable

K, SCALE, EVERY = 5, 256.0, 50
LEVELS = (4, 16, 32)
#: Share of a block from which matrix products are cheaper than single pairs.
DENSE, PAIRS = 0.05, 1 << 17
QUERY_BLOCK, ROW_BLOCK = 1024, 4096
LONG = np.iinfo(np.int64)


def integers(table: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, dim, vec): usable vectors as doubles with integer values, packed; the others take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = [np.floor(r * scale).tobytes() for r in rows_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(v) // 8 for v in vec], pa.int32()), pa.array(vec, pa.binary())], ["id", "dim", "vec"])

    rows = table.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).filter(usable("v"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, dim int, vec binary")


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations per segment, each times the root of the segment's length, side by side."""
    out = []
    for part in np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1])):
        mean = x[:, part].mean(1)
        dev = np.sqrt(np.maximum((x[:, part] ** 2).mean(1) - mean**2, 0))
        out += [mean * np.sqrt(len(part)), dev * np.sqrt(len(part))]
    return np.stack(out, 1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact row-wise inner products; beyond the range of a long they stop at its ends."""
    if fits(a, b):
        return np.einsum("nd,nd->n", a, b).astype(np.int64)
    whole = [[int(v) for v in r] for r in a], [[int(v) for v in r] for r in b]
    return np.array([min(max(sum(x * y for x, y in zip(p, q)), LONG.min), LONG.max) for p, q in zip(*whole)], np.int64)


def fits(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether doubles hold all products and sums of these integers exactly, in any order of addition."""
    return np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2.0**53


def block_top(qid: np.ndarray, q: np.ndarray, xid: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, row index, score) with the k best rows of the block for each query, ties to the smaller id.

    At each level a query's floor is the k-th best exact score among the rows of the highest bounds; rows bounded below
    it are out. Where much of the block is left, bounds and scores are matrix products; else they are taken pair by pair.
    """
    slack = 1e-9 * (1 + np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None])
    alive = qid[:, None] != xid[None]
    floor = np.full(len(q), -np.inf)
    lead = min(len(x), 4 * k)
    for level in LEVELS:
        sq, sx = statistics(q, level), statistics(x, level)
        if alive.mean() > DENSE:
            bound = np.where(alive, sq @ sx.T + slack, -np.inf)
            best = np.argpartition(bound, len(x) - lead, axis=1)[:, len(x) - lead:]
            first = products(np.repeat(q, lead, axis=0), x[best.ravel()]).reshape(len(q), lead).astype(np.float64)
            first[~np.take_along_axis(alive, best, 1)] = -np.inf
            if lead >= k:
                floor = np.maximum(floor, np.partition(first, lead - k, axis=1)[:, lead - k])
            alive &= bound >= floor[:, None]
        else:
            i, j = np.nonzero(alive)
            for at in range(0, len(i), PAIRS):
                a, b = i[at:at + PAIRS], j[at:at + PAIRS]
                alive[a, b] = np.einsum("nd,nd->n", sq[a], sx[b]) + slack[a, b] >= floor[a]
    i, j = np.nonzero(alive)
    if len(i) > DENSE * alive.size and fits(q, x):
        score = (q @ x.T)[i, j].astype(np.int64)
    else:
        score = np.concatenate([np.zeros(0, np.int64)] + [products(q[i[at:at + PAIRS]], x[j[at:at + PAIRS]]) for at in range(0, len(i), PAIRS)])
    good = score >= floor[i]
    i, j, score = i[good], j[good], score[good]
    order = np.lexsort((xid[j], ~score, i))  # ~score falls as score rises, without overflow
    i, j, score = i[order], j[order], score[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < k], j[rank < k], score[rank < k]


def top_k(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: float = SCALE, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every` its `k` best other rows.

    Null ids take no part. Rows that share an id with the query are the query's own. Repeated
    candidates are candidates each. Vectors of different lengths have no score with one another. Vectors that are null, empty or hold null or non-finite
    components take no part. Scores outside a long stop at its ends. Without candidates a query has no rows.
    """
    rows = pin(integers(table, id_col, vector_col, scale).filter("id is not null"))
    chosen = rows.filter(F.col("id") % every == 0)
    n, m = rows.count(), chosen.count()
    if not m:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("bigint").alias("score")).limit(0)
    row_blocks, query_blocks = max(1, -(-n // ROW_BLOCK)), max(1, -(-m // QUERY_BLOCK))
    mark = F.xxhash64("id", "vec")
    rows = rows.withColumn("mark", F.xxhash64("vec"))
    chosen = rows.filter(F.col("id") % every == 0)
    candidates = rows.select("id", "mark", "dim", "vec", F.pmod(mark, F.lit(row_blocks)).alias("row_block")).withColumn(
        "query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).withColumn("is_query", F.lit(False))
    queries = chosen.select("id", "mark", "dim", "vec", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int").alias("query_block")).dropDuplicates(["id", "vec"]).withColumn(
        "row_block", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)))).withColumn("row_block", F.col("row_block").cast("bigint")).withColumn("is_query", F.lit(True))

    def best(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        dim, is_query = int(key[2]), part["is_query"].to_numpy()
        ids, vec = part["id"].to_numpy(), matrix(part["vec"].tolist(), dim)
        qid, xid, q, x = ids[is_query], ids[~is_query], vec[is_query], vec[~is_query]
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": qid[:0], "mark": qid[:0], "vec_id": qid[:0], "score": qid[:0]})
        i, j, score = block_top(qid, q, xid, x, k)
        # a query id that stands for several vectors has a list for each
        marks = part["mark"].to_numpy()[is_query]
        return pd.DataFrame({"query_id": qid[i], "mark": marks[i], "vec_id": xid[j], "score": score})

    scored = candidates.select(*queries.columns).unionByName(queries).groupBy("row_block", "query_block", "dim").applyInPandas(best, "query_id bigint, mark bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
