"""Sums by level, for all categories and numbers of a table in one scan.

A task holds dense accumulators: one row per level of every category, one column per number, or one cell per pair of levels.
Their size depends on levels and columns, not on rows; only they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers that one gathered batch holds, and cells of category pairs counted in one scan.
BATCH_CELLS, SCAN_CELLS = 1 << 22, 1 << 23


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[np.ndarray]]:
    """Columns of about `rows` rows at a time; NULL becomes NaN."""
    held, size = [], 0

    def joined() -> list[np.ndarray]:
        return [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(held[0].num_columns)]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= rows:
            yield joined()
            held, size = [], 0
    if held:
        yield joined()


def _codes(column: np.ndarray) -> np.ndarray:
    """Codes of a category; NULL is -1."""
    return np.where(np.isnan(column), -1, column).astype(np.int64) if column.dtype.kind == "f" else column.astype(np.int64)


def level_sums(rows: DataFrame, codes: dict[int, tuple[Column, int]], numbers: dict[int, Column]) -> DataFrame:
    """(cat, code, num, n_g, s, ss): count, sum and sum of squares of every number in every level of every category.

    `codes` maps a category to its level code (0-based, NULL for none) and its number of levels. NULL numbers are left out.
    """
    cats, nums = list(codes), list(numbers)
    picked = rows.select(*[c.cast("int").alias(f"c{k}") for k, (c, _) in codes.items()], *[x.cast("double").alias(f"x{j}") for j, x in numbers.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(nums)
        total = {k: np.zeros((codes_of[k], 3 * width)) for k in cats}
        for block in _blocks(batches, max(1024, BATCH_CELLS // (3 * width))):
            x = np.column_stack(block[len(cats):]).astype(float)
            seen = ~np.isnan(x)
            x[~seen] = 0.0
            table = np.hstack([seen.astype(float), x, x * x])
            for k, column in zip(cats, block):
                level = _codes(column)[:, None] == np.arange(codes_of[k])
                total[k] += level.T.astype(float) @ table
        for k, sums in total.items():
            n, s, ss = (part.ravel() for part in np.hsplit(sums, 3))
            some = n > 0
            code, num = np.repeat(np.arange(codes_of[k]), width)[some], np.tile(nums, codes_of[k])[some]
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"cat": np.full(len(code), k), "code": code, "num": num, "n_g": n[some].astype(np.int64), "s": s[some], "ss": ss[some]}).astype(
                {"cat": "int32", "code": "int32", "num": "int32"}), preserve_index=False)

    codes_of = {k: size for k, (_, size) in codes.items()}
    partial = picked.mapInArrow(run, "cat int, code int, num int, n_g bigint, s double, ss double")
    return partial.groupBy("cat", "code", "num").agg(F.sum("n_g").alias("n_g"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))


def pair_tables(rows: DataFrame, codes: dict[int, tuple[Column, int]], pairs: list[tuple[int, int, int]]) -> DataFrame:
    """(pos, a, b, o): non-empty cells of the listed (pos, category, category) pairs, levels by code.

    The tables are blocks of the cross products of all level indicators, laid end to end; a scan adds up to SCAN_CELLS of them.
    """
    sizes = {k: size for k, (_, size) in codes.items()}
    scans: list[list[tuple[int, int, int]]] = [[]]
    used = 0
    for pair in pairs:
        cells = sizes[pair[1]] * sizes[pair[2]]
        if scans[-1] and used + cells > SCAN_CELLS:
            scans.append([])
            used = 0
        scans[-1].append(pair)
        used += cells
    out = None
    for part in scans:
        cats = sorted({c for _, a, b in part for c in (a, b)})
        picked = rows.select(*[codes[k][0].cast("int").alias(f"c{k}") for k in cats])
        found = picked.mapInArrow(_cells(part, cats, sizes), "pos int, a int, b int, o bigint")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("pos", "a", "b").agg(F.sum("o").alias("o"))


def _cells(part: list[tuple[int, int, int]], cats: list[int], sizes: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(sizes[a] * sizes[b], np.int64) for _, a, b in part]
        for block in _blocks(batches, max(1024, BATCH_CELLS // len(cats))):
            code = dict(zip(cats, map(_codes, block)))
            whole = {k: (c >= 0).all() for k, c in code.items()}
            for sums, (_, a, b) in zip(total, part):
                key = code[a] * sizes[b] + code[b]
                if not (whole[a] and whole[b]):
                    key = key[(code[a] >= 0) & (code[b] >= 0)]
                sums += np.bincount(key, minlength=len(sums))
        for sums, (pos, _, b) in zip(total, part):
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(at), pos, np.int32)), pa.array((at // sizes[b]).astype(np.int32)), pa.array((at % sizes[b]).astype(np.int32)), pa.array(sums[at]),
            ], ["pos", "a", "b", "o"])

    return run
