"""Periodic runs of words: maximal stretches that repeat with a smallest period, at least four times over.

Documents become overlapping tiles, one set of tiles per octave of periods [D, 2D), long octaves in longer tiles. Each tile
is solved by itself: a run of an octave contains an aligned block of 2D words that comes again q words later, D <= q < 2D, so
a rolling hash names the few (boundary, period) pairs at which the Z-function of the boundary is long; there it
is computed, forward and backward. Fragments (period, from, to) leave the tile and are shuffled by document
and period, where fragments that overlap by a period or more are stitched together.

Short octaves (periods under 16) compare the tile with itself shifted by each period instead. Texts up to LONG_BYTES are one tile
for all octaves and solved where they are read, many at once; the tiles of longer texts are dealt to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwright.llm.common import CHUNK_BYTES, chunks, column_bytes, mixed, small_batches, words_in

#: A run holds its period at least EXPONENT times and LEAST words; the proof of the boundary grid needs an exponent of 4 or more.
EXPONENT, LEAST = 4, 6
SHORT = 16
#: Texts above LONG_BYTES are cut into tiles of TILE words or of 16 times the octave's D, whichever is longer.
LONG_BYTES, TILE = 1 << 20, 1 << 17
_BASE = 0x9E3779B97F4A7C15


def _primitive(x: np.ndarray, start: np.ndarray, q: int) -> np.ndarray:
    """Whether x[s:s+q] is no power of a shorter sequence."""
    good = np.ones(len(start), bool)
    for prime in (p for p in range(2, q + 1) if q % p == 0 and all(p % d for d in range(2, int(p**0.5) + 1))):
        r = q // prime
        for at in range(0, len(start), max(1, (1 << 20) // q)):
            block = x[start[at:at + max(1, (1 << 20) // q), None] + np.arange(q)]
            good[at:at + len(block)] &= ~(block[:, :-r] == block[:, r:]).all(1)
    return good


def _shifted(x: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Stretches of two or more periods q, for each q in [low, high)."""
    for q in range(low, min(high, len(x))):
        same = np.zeros(len(x) - q + 2, bool)
        same[1:-1] = x[:-q] == x[q:]
        edge = np.flatnonzero(same[1:] != same[:-1])
        start, end = edge[::2], edge[1::2] + q
        long = end - start >= 2 * q
        start, end = start[long], end[long]
        if len(start):
            good = _primitive(x, start, q)
            yield start[good], end[good], q


def _agree(x: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words agree from the places a < b on, forward (step 1) or backward (-1): one value of the boundary's Z-function."""
    done, width = 0, 64
    most = len(x) - b if step > 0 else a + 1
    while done < most:
        width = min(width, most - done)
        if step > 0:
            same = x[a + done:a + done + width] == x[b + done:b + done + width]
        else:
            same = (x[a - done - width + 1:a - done + 1] == x[b - done - width + 1:b - done + 1])[::-1]
        if not same.all():
            return done + int(same.argmin())
        done, width = done + width, min(2 * width, 1 << 16)
    return done


def _by_boundary(x: np.ndarray, hashes: np.ndarray, d: int) -> Iterator[tuple[int, int, int]]:
    """(from, to, q) of an octave; `hashes` are those of every 2d consecutive words.

    Two periods q of [d, 2d) at one boundary have a common divisor that is a period too, so neither is smallest; such boundaries
    (long stretches of a short period) are left out once both matches are confirmed word by word.
    """
    rows = -(-len(hashes) // d)
    if rows < 2:
        return
    grid = np.zeros(rows * d, np.uint64)
    grid[: len(hashes)] = hashes
    grid = grid.reshape(rows, d)
    row, col = np.nonzero(grid[1:] == grid[:-1, :1])
    real = (row + 1) * d + col < len(hashes)
    row, col = row[real], col[real]
    if not len(row):
        return
    head = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    size = np.diff(np.append(head, len(row)))
    keep = np.repeat(size == 1, size)
    many = head[size > 1]
    step = max(1, (1 << 20) // (2 * d))
    for at in range(0, len(many), step):
        h = many[at:at + step]
        base = x[row[h, None] * d + np.arange(2 * d)]
        sure = np.ones(len(h), bool)
        for j in (0, 1):
            sure &= (base == x[((row[h] + 1) * d + col[h + j])[:, None] + np.arange(2 * d)]).all(1)
        for i in h[~sure]:
            keep[i:i + size[np.searchsorted(head, i)]] = True
    done: dict[int, int] = {}
    for r, c in zip(row[keep].tolist(), col[keep].tolist()):
        b, q = r * d, d + c
        if b + 2 * d + q <= done.get(q, 0):
            continue
        ahead = _agree(x, b, b + q, 1)
        if ahead < 2 * d:
            continue
        start, end = b - _agree(x, b - 1, b + q - 1, -1), b + q + ahead
        done[q] = end
        if _primitive(x, np.array([start]), q)[0]:
            yield start, end, q


def stretches(x: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, period) of all maximal stretches of `x` with a smallest period in [low, high) that hold it four times.

    `low` and `high` are 1 or SHORT times powers of two. Shorter stretches are given out too where they show. Values of `x` that
    occur nowhere else end every stretch, so several tiles can be joined by such marks.
    """
    found = [(s, e, np.full(len(s), q)) for s, e, q in _shifted(x, low, min(high, SHORT))]
    width, d, hashes = 1, SHORT, mixed(x.astype(np.uint64))
    power = _BASE
    while d < high and 4 * d <= len(x):
        while width < 2 * d:
            hashes = hashes[:-width] * np.uint64(power) + hashes[width:]
            width, power = 2 * width, power * power % 2**64
        if d >= low:
            got = list(_by_boundary(x, hashes, d))
            if got:
                found.append(tuple(np.array(c) for c in zip(*got)))
        d *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate([f[i] for f in found]).astype(np.int64) for i in range(3))


_COLUMNS = ("k1", "k2", "period", "first", "last", "low", "high", "at", "n")
_FRAGMENT = ", ".join(f"{c} bigint" for c in _COLUMNS[:5])
_TILES = ", ".join(f"{c} bigint" for c in _COLUMNS) + ", blob binary"


def _whole(first: np.ndarray, last: np.ndarray, q: np.ndarray) -> np.ndarray:
    return last - first >= np.maximum(LEAST, EXPONENT * q)


def _fragments(*columns: np.ndarray) -> pa.RecordBatch:
    """Fragments (k1, k2, period, first, last)."""
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in columns], list(_COLUMNS[:5]))


def _one_tile_each(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    words = words_in(part.column(2))
    codes, _ = words.codes()
    counts = words.counts()
    if not len(codes):
        return
    doc = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts + 1) - counts - 1  # every text is followed by a mark
    x = np.empty(len(codes) + len(counts), np.int64)
    x[np.arange(len(codes)) + doc] = codes
    x[begin + counts] = -1 - np.arange(len(counts))
    start, end, q = stretches(x, 1, int(counts.max()) // EXPONENT + 1)
    keep = _whole(start, end, q)
    start, end, q = start[keep], end[keep], q[keep]
    owner = np.searchsorted(begin, start, side="right") - 1
    yield _fragments(np.asarray(part.column(0))[owner], np.asarray(part.column(1))[owner], q, start - begin[owner], end - begin[owner])


def tiles(n: int, tile: int) -> Iterator[tuple[int, int, int, int]]:
    """(low, high, from, to): tiles of a document of n words. Short octaves share tiles of `tile` words; consecutive tiles overlap by 8 D."""
    low, high = 1, max(SHORT, 1 << (tile // 16).bit_length() - 1)
    while low == 1 or EXPONENT * low <= n:
        length, overlap = max(tile, 8 * high), 4 * high  # periods are below `high`, which is 2 D of the longest octave
        at = 0
        while True:
            yield low, high, at, min(n, at + length)
            if at + length >= n:
                break
            at += length - overlap
        low, high = high, 2 * high


def _explode(long_bytes: int, tile: int):
    """Fragments of texts that are one tile; the tiles themselves of longer texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, kinds = zstandard.ZstdCompressor(level=1), [*[(c, pa.int64()) for c in _COLUMNS], ("blob", pa.binary())]
        for part in chunks(batches, "text", min(long_bytes, CHUNK_BYTES)):
            if part.num_rows > 1 or len(column_bytes(part.column(2))[0]) <= long_bytes:
                for found in _one_tile_each(part):
                    nulls = [pa.nulls(found.num_rows, t) for _, t in kinds[5:]]
                    yield pa.RecordBatch.from_arrays([*found.columns, *nulls], [k for k, _ in kinds])
                continue
            codes = words_in(part.column(2)).codes()[0].astype(np.int32)
            keys = {"k1": part.column(0)[0].as_py(), "k2": part.column(1)[0].as_py(), "n": len(codes)}
            for low, high, a, b in tiles(len(codes), tile):
                yield pa.RecordBatch.from_pylist([{**keys, "low": low, "high": high, "at": a, "blob": pack.compress(codes[a:b].tobytes())}], pa.schema(kinds))

    return run


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments pass, tiles become fragments: those that end at the edge of a tile, and whole runs."""
    for batch in batches:
        ready = batch.filter(pc.is_null(batch.column(9)))
        yield ready.select(list(_COLUMNS[:5]))
        for r in batch.filter(pc.is_valid(batch.column(9))).select(["k1", "k2", "low", "high", "at", "n", "blob"]).to_pylist():
            x = np.frombuffer(zstandard.decompress(r["blob"]), np.int32).astype(np.int64)
            start, end, q = stretches(x, r["low"], r["high"])
            open_ = ((start == 0) & (r["at"] > 0)) | ((end == len(x)) & (r["at"] + len(x) < r["n"]))
            keep = open_ | _whole(start, end, q)
            start, end, q = start[keep] + r["at"], end[keep] + r["at"], q[keep]
            yield _fragments(np.full(len(q), r["k1"]), np.full(len(q), r["k2"]), q, start, end)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows are told apart by hashes of id and text; rows equal in both have equal runs."""
    return docs.select(F.xxhash64(F.col(f"`{id_col}`")).alias("k1"), F.xxhash64(F.col(f"`{text_col}`")).alias("k2"), F.col(f"`{text_col}`").cast("string").alias("text"))


def runs(rows: DataFrame, long_bytes: int = LONG_BYTES, tile: int = TILE) -> DataFrame:
    """(k1, k2, start, length, period) of every run of the rows (k1, k2, text); texts without words have none."""
    small_batches(rows.sparkSession)
    # distinct deals tiles to all tasks by their hash, and repeated rows are solved once
    fragments = rows.mapInArrow(_explode(long_bytes, tile), _TILES).distinct().mapInArrow(_solve, _FRAGMENT)
    of = Window.partitionBy("k1", "k2", "period").orderBy("first", "last")
    seen = F.max("last").over(of.rowsBetween(Window.unboundedPreceding, -1))
    marked = fragments.withColumn("new", F.when(seen.isNull() | (F.col("first") > seen - F.col("period")), 1).otherwise(0))
    stitched = marked.withColumn("nth", F.sum("new").over(of)).groupBy("k1", "k2", "period", "nth").agg(F.min("first").alias("start"), F.max("last").alias("stop"))
    return stitched.select("k1", "k2", "start", (F.col("stop") - F.col("start")).alias("length"), "period").filter(
        F.col("length") >= F.greatest(F.lit(LEAST), F.lit(EXPONENT) * F.col("period")))


def with_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "periodic", long_bytes: int = LONG_BYTES, tile: int = TILE) -> DataFrame:
    """All columns of `docs` and a struct `name`: runs (start, period, length; by start, then period) and the collapsed text.

    A word is dropped if a run holds it after its first period; `collapsed` has the other words joined by one space. Null and
    empty texts have no runs and collapse to an empty text. Repeated rows get the same runs each; a column called `name` is
    replaced; an empty table stays empty. A document's runs are one list, bounded by its own words.
    """
    small_batches(docs.sparkSession)
    rest = docs.drop(name)
    found = runs(keyed(rest, id_col, text_col), long_bytes, tile)
    lists = found.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    left = rest.withColumn(name, F.struct(F.xxhash64(F.col(f"`{id_col}`")).alias("k1"), F.xxhash64(F.col(f"`{text_col}`")).alias("k2")))
    right = lists.hint("shuffle_hash").alias("r")
    joined = left.alias("l").join(right, (F.col(f"l.{name}.k1") == F.col("r.k1")) & (F.col(f"l.{name}.k2") == F.col("r.k2")), "left")
    none = F.array().cast("array<struct<start:bigint,period:bigint,length:bigint>>")

    def collapse(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for text, some in zip(texts, found):
            words = text.encode().split() if text else []
            if some is not None and len(some):
                edge = np.zeros(len(words) + 1, np.int64)
                for r in some:
                    edge[r["start"] + r["period"]] += 1
                    edge[r["start"] + r["length"]] -= 1
                words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
            out.append(b" ".join(words).decode())
        return pd.Series(out, dtype=object)

    return joined.select(*[F.col(f"l.`{c}`") for c in rest.columns], F.struct(
        F.coalesce("r.runs", none).alias("runs"), F.pandas_udf(collapse, "string")(F.col(f"l.`{text_col}`").cast("string"), F.col("r.runs")).alias("collapsed")).alias(name))
