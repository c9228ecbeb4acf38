"""SimHash near-duplicates: fingerprints of word shingles, linked by a self-join over a binary trie.

Fingerprints are cut into trie nodes of bounded size by a histogram of prefixes. Pairs of nodes whose
prefixes differ in few enough bits form the work units; the fingerprints of a node travel to its units in packed pieces.
Inside a unit node pairs are traversed together from the top: every level adds the differing bit to
the pair's errors and pairs over the budget are dropped with everything below them.

Equal fingerprints are one item. A unit returns a spanning forest of its links, so a group of g near
copies costs at most g - 1 rows a unit. Hot prefixes are cut deeper until no node holds more than
NODE_ROWS (or a 2**-13 part of all) fingerprints; at depth 64 a node holds one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.llm.common import chunks, column_bytes, pin, small_batches
from siftwright.llm.components import Forest, components

SHINGLE, SEED, ERRORS = 3, 42, 3
NODE_ROWS, MAX_NODES, LEAF = 1 << 14, 1 << 13, 12
STEP = 6
FRONTIER, PIECE_ROWS = 1 << 19, 1 << 20


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is 1 if it is set in over half of the shingle hashes (repeats count); no words: 0."""
    words = text.lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return 0
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h(line, seed)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lens) - 1
    first, last = (ends - lens + 1)[: len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist()
    counts, n = np.zeros(64, np.int64), len(first)
    for at in range(0, n, 1 << 15):
        hashes = np.array([h(line[s:e], seed) for s, e in zip(first[at:at + (1 << 15)], last[at:at + (1 << 15)])], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, text_hash, fp) for every row of `docs`; a null text counts as empty. fp is the signed 64-bit pattern.

    Other columns of `docs`, whatever their names, are not read.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            fps = np.array([fingerprint(t, shingle, seed) for t in column_bytes(part.column(2))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fps.view(np.int64))], ["id", "text_hash", "fp"])

    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, text_hash bigint, fp bigint")


# ---- the trie ---------------------------------------------------------------------------------


def _unsigned_prefix(depth: int):
    """The first `depth` bits as a number."""
    return F.shiftrightunsigned("fp", 64 - depth)


def trie_nodes(fps: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """First fingerprint (unsigned) and depth of the nodes that tile the key space, none over the size limit.

    Only counts of prefixes come to the driver: 2**STEP for each node that is still too large, and of
    those there are at most MAX_NODES whatever the input.
    """
    limit = max(NODE_ROWS, total // MAX_NODES + 1)
    done: list[tuple[int, int, int]] = []
    heavy: list[int] | None = None
    depth = 0
    while heavy is None or heavy:
        start, depth = depth, min(depth + STEP, 63)
        rows = fps.withColumn("above", _unsigned_prefix(start) if start else F.lit(0).cast("bigint"))
        if heavy is not None:
            keep = fps.sparkSession.createDataFrame(pd.DataFrame({"above": np.array(heavy, np.int64)}))
            rows = rows.join(F.broadcast(keep), "above", "left_semi")
        counts = {r["p"]: r["n"] for r in rows.groupBy(_unsigned_prefix(depth).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
        above, heavy = ([0] if heavy is None else heavy), []
        stack = [(p, start, range(p << (depth - start), (p + 1) << (depth - start))) for p in above]
        while stack:
            p, d, below = stack.pop()
            n = sum(counts.get(x, 0) for x in below)
            if n <= limit:
                done.append((p << (64 - d) if d else 0, d, n))
            elif d == depth:
                heavy.append(p)  # never at depth 63: two fingerprints at most share so many bits
            else:
                half = len(below) // 2
                stack += [(2 * p, d + 1, below[:half]), (2 * p + 1, d + 1, below[half:])]
    done.sort()
    return np.array([x[0] for x in done], np.uint64), np.array([x[1] for x in done], np.int64)


def node_pairs(first: np.ndarray, depth: np.ndarray, errors: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i <= j of nodes whose common prefix bits differ in at most `errors` places."""
    a, b = [], []
    every = np.arange(len(first))
    for i in range(len(first)):
        shared = np.minimum(depth[i], depth[i:])
        shift = np.where(shared == 0, 63, 64 - shared).astype(np.uint64)
        apart = np.where(shared == 0, 0, np.bitwise_count((first[i] ^ first[i:]) >> shift))
        j = every[i:][apart <= errors]
        a.append(np.full(len(j), i))
        b.append(j)
    return np.concatenate(a), np.concatenate(b)


def join_tries(a: np.ndarray, b: np.ndarray | None, errors: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within `errors` differing bits between two sorted arrays (or inside one: b is None)."""
    self_join = b is None
    b = a if self_join else b
    one = np.ones(1, np.int64)
    todo = [(0, 0 * one, len(a) * one, 0 * one, len(b) * one, 0 * one)]
    while todo:
        depth, alo, ahi, blo, bhi, wrong = todo.pop()
        if len(alo) > FRONTIER:
            todo += [(depth, *(x[at:at + FRONTIER] for x in (alo, ahi, blo, bhi, wrong))) for at in range(0, len(alo), FRONTIER)]
            continue
        leaf = (ahi - alo <= LEAF) & (bhi - blo <= LEAF) | (depth == 64)
        if leaf.any():
            yield from _leaves(a, b, alo[leaf], ahi[leaf], blo[leaf], bhi[leaf], errors, self_join)
            alo, ahi, blo, bhi, wrong = (x[~leaf] for x in (alo, ahi, blo, bhi, wrong))
        if not len(alo):
            continue
        am, bm = _middle(a, alo, ahi, depth), _middle(b, blo, bhi, depth)
        parts = [(alo, am, blo, bm, wrong), (am, ahi, bm, bhi, wrong), (alo, am, bm, bhi, wrong + 1)]
        other = (alo != blo) if self_join else np.ones(len(alo), bool)  # a node with itself: its halves meet once
        parts.append(tuple(x[other] for x in (am, ahi, blo, bm, wrong + 1)))
        alo, ahi, blo, bhi, wrong = (np.concatenate(x) for x in zip(*parts))
        alive = (ahi > alo) & (bhi > blo) & (wrong <= errors)
        todo.append((depth + 1, *(x[alive] for x in (alo, ahi, blo, bhi, wrong))))


def _middle(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """Where the 1-branch of each node begins."""
    bit = np.uint64(1) << np.uint64(63 - depth)
    above = ~((bit << np.uint64(1)) - np.uint64(1)) if depth else np.uint64(0)
    return np.clip(np.searchsorted(keys, (keys[lo] & above) | bit), lo, hi)


def _leaves(a, b, alo, ahi, blo, bhi, errors, self_join):
    sizes = (ahi - alo) * (bhi - blo)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(sizes) // (1 << 21))) + 1, [len(sizes)]])
    for s, e in zip(cuts[:-1], cuts[1:]):
        n = sizes[s:e]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = np.repeat(bhi[s:e] - blo[s:e], n)
        i, j = np.repeat(alo[s:e], n) + at // width, np.repeat(blo[s:e], n) + at % width
        close = np.bitwise_count(a[i] ^ b[j]) <= errors
        if self_join:
            close &= i < j
        if close.any():
            yield i[close], j[close]


def near_links(fps: DataFrame, errors: int = ERRORS) -> DataFrame:
    """(a, b) links that connect just what fingerprints (column fp, distinct) within `errors` bits connect."""
    total = fps.count()
    first, depth = trie_nodes(fps, total)
    left, right = node_pairs(first, depth, errors)
    n = len(first)
    units: list[list[int]] = [[] for _ in range(n)]
    for i, j in zip(left.tolist(), right.tolist()):
        units[i].append(i * n + j)
        if i != j:
            units[j].append(i * n + j)

    def packed(fp: np.ndarray) -> pa.RecordBatch:
        """One row per unit with all fingerprints that this piece of the input has for it."""
        node = np.searchsorted(first, fp, side="right") - 1
        order = np.argsort(node, kind="stable")
        fp, node = fp[order], node[order]
        head = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        rows = [(unit, fp[s:e].tobytes(), unit // n == node[s])
                for s, e in zip(head.tolist(), [*head[1:].tolist(), len(fp)]) for unit in units[node[s]]]
        return pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([bool(r[2]) for r in rows])
        ], ["unit", "fps", "is_left"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(np.asarray(batch.column(0)).view(np.uint64))
            size += len(held[-1])
            if size >= PIECE_ROWS:
                yield packed(np.concatenate(held))
                held, size = [], 0
        if size:
            yield packed(np.concatenate(held))

    def link(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        i, j = divmod(int(key[0]), n)
        is_left = rows["is_left"].to_numpy(bool)
        a = np.sort(np.frombuffer(b"".join(rows["fps"][is_left]), np.uint64))
        b = None if i == j else np.sort(np.frombuffer(b"".join(rows["fps"][~is_left]), np.uint64))
        if not len(a) or b is not None and not len(b):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        names = a if b is None else np.concatenate([a, b])
        forest = Forest(len(names))
        for x, y in join_tries(a, b, errors):
            forest.add(x, y if b is None else y + len(a))
        x, y = forest.spanning()
        return pd.DataFrame({"a": names[x].view(np.int64), "b": names[y].view(np.int64)})

    dealt = fps.select("fp").mapInArrow(deal, "unit bigint, fps binary, is_left boolean")
    return dealt.groupBy("unit").applyInPandas(link, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", errors: int = ERRORS, shingle: int = SHINGLE, seed: int = SEED, with_root: bool = False) -> DataFrame:
    """(id, text_hash, fp, component_id) for every row of `docs`.

    component_id is the smallest id reachable over fingerprints at `errors` or fewer differing bits;
    null ids never name a component unless it has no other. `with_root` adds a key of the component that is never null. Empty tables give empty results; repeated
    rows stay repeated.
    """
    rows = pin(fingerprints(docs, id_col, text_col, shingle, seed))
    items = pin(rows.groupBy("fp").agg(F.min("id").alias("rep")))
    classes = pin(components(near_links(items, errors), "a", "b"))
    named = items.join(classes.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    facts = named.select("fp", "root").join(best, "root")
    return rows.join(facts if with_root else facts.drop("root"), "fp")
