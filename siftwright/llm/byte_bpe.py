"""Byte-level BPE as a monoid over byte strings.

`encode` cuts a piece in halves, encodes both and joins them: the tokens around the seam are encoded again
in a window that grows until it fits. A window fits when the tokens at each of its edges form a pair that encodes
to itself. Every token of the vocabulary encodes to itself, and a token sequence all of whose neighbours are
such pairs is the encoding of its bytes, so what lies outside the window can no longer change. Half pieces and
token pairs are remembered, so most pieces cost a few look-ups. Texts are cut into pieces by the
tokenizer's pattern, and between pieces joining is plain concatenation. Decoding has no seams to mend: leaves of ids are
looked up, and their bytes are concatenated up the tree.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwright.llm.common import chunks, small_batches

LEAF, DIRECT = 4, 48
#: Ids of one leaf of the decoding tree, and ids looked up together.
DECODE_LEAF, LEAVES = 1 << 12, 1 << 18
#: Remembered halves and pairs per worker, and remembered pieces; beyond that the older half is forgotten.
MEMO, PIECES = 120_000, 500_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Read a rank file on the driver; it is a small file of fixed size."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Merger:
    """Encodes single pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {v: k for k, v in ranks.items()}
        self.halves: dict[bytes, tuple] = {}
        self.pairs: dict[tuple, tuple] = {}

    def merge(self, piece: bytes) -> tuple:
        """The definition: merge the adjacent pair of lowest rank, leftmost first, while there is one."""
        if len(piece) > DIRECT:
            return self._merge_long(piece)
        ranks, parts = self.ranks, [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, piece: bytes) -> tuple:
        """The same with a heap of candidate pairs over a linked list."""
        ranks, n = self.ranks, len(piece)
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            j = after[i] if end[i] else n
            if not end[i] or j >= n or end[j] != to:  # one of the two was merged meanwhile
                continue
            end[i], end[j] = to, 0
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(piece[i:end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            k = before[i]
            if k >= 0 and (r := ranks.get(piece[k:to])) is not None:
                heapq.heappush(heap, (r, k, to))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = after[i]
        return tuple(out)

    def pair(self, a: int, b: int) -> tuple:
        key = (a, b)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > MEMO:
                self.pairs.clear()
            found = self.pairs[key] = self.merge(self.token[a] + self.token[b])
        return found

    def join(self, left: tuple, right: tuple) -> tuple:
        """The encoding of two neighbours from their encodings."""
        if not left or not right:
            return left or right
        if self.pair(left[-1], right[0]) == (left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = self.pair(left[-1], right[0]) if i == j == 1 else self.merge(b"".join(self.token[t] for t in left[-i:] + right[:j]))
            fits_left = i == len(left) or self.pair(left[-i - 1], window[0]) == (left[-i - 1], window[0])
            fits_right = j == len(right) or self.pair(window[-1], right[j]) == (window[-1], right[j])
            if fits_left and fits_right:
                return left[: len(left) - i] + window + right[j:]
            if not fits_left:
                i = min(len(left), 2 * i)
            if not fits_right:
                j = min(len(right), 2 * j)

    def encode(self, piece: bytes) -> tuple:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        found = self.halves.get(piece)
        if found is None:
            if len(piece) <= LEAF:
                found = self.merge(piece)
            else:
                middle = len(piece) // 2
                found = self.join(self.encode(piece[:middle]), self.encode(piece[middle:]))
            if len(piece) <= 32:
                if len(self.halves) > MEMO:
                    self.halves.clear()
                self.halves[piece] = found
        return found


class Pieces(dict):
    """Piece of text -> its ids as packed 32-bit integers, computed when first asked for."""

    def __init__(self, merger: Merger):
        super().__init__()
        self.merger, self.older = merger, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            packed = np.array(self.merger.encode(piece.encode("utf-8", "surrogatepass")), np.int32).tobytes()
        if len(piece) <= 64:
            if len(self) > PIECES // 2:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed


_WORKER: dict = {}


def _pieces(ranks: dict[bytes, int], pattern: str) -> tuple[Pieces, "regex.Pattern"]:
    """One memory per Python worker and vocabulary, kept between tasks."""
    key = (len(ranks), pattern, hash(frozenset(list(ranks.items())[:1000])))
    if key not in _WORKER:
        _WORKER.clear()
        # the pattern's white space is Unicode's White_Space property
        _WORKER[key] = Pieces(Merger(ranks)), regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}"))
    return _WORKER[key]


def _vocabulary(ranks: dict[bytes, int]) -> pa.Array:
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return pa.array(tokens, pa.large_binary())


def _leaf(ids: pa.Array, vocabulary: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of some tokens side by side, and where each ends."""
    taken = vocabulary.take(ids)
    if not len(taken) or taken.buffers()[2] is None:
        return memoryview(b""), np.zeros(len(taken), np.int64)
    offsets = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset: taken.offset + len(taken) + 1]
    return memoryview(taken.buffers()[2])[int(offsets[0]):int(offsets[-1])], offsets[1:] - offsets[0]


def decode(ids: pa.Array, vocabulary: pa.Array) -> bytes:
    """Bytes of a run of ids: leaves look up their tokens, and neighbours are concatenated up the tree."""
    level = [bytes(_leaf(ids.slice(at, DECODE_LEAF), vocabulary)[0]) for at in range(0, len(ids), DECODE_LEAF)]
    while len(level) > 1:
        level = [level[i] + level[i + 1] if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else b""


def _decoded(ids: pa.Array, vocabulary: pa.Array) -> pa.Array:
    """Bytes of each list of ids. The leaves of all short lists are looked up together; longer lists are trees of their own."""
    length = np.asarray(pc.fill_null(ids.value_lengths(), 0), np.int64)
    flat, ends = ids.flatten(), np.cumsum(length)
    out: list[bytes] = []
    at = 0
    while at < len(length):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - length[at] + LEAVES, side="right")))
        long = np.flatnonzero(length[at:to] > DECODE_LEAF)
        if len(long) and long[0] == 0:
            to = at + 1
            out.append(decode(flat.slice(ends[at] - length[at], length[at]), vocabulary))
        else:
            to = at + int(long[0]) if len(long) else to
            begin = ends[at] - length[at]
            line, stop = _leaf(flat.slice(begin, ends[to - 1] - begin), vocabulary)
            stop = np.concatenate([[0], stop])[ends[at:to] - begin].tolist()
            out += [bytes(line[s:e]) for s, e in zip([0, *stop[:-1]], stop)]
        at = to
    return pa.array(out, pa.binary())


def with_ids(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", ids_col: str = "ids", bytes_col: str | None = None) -> DataFrame:
    """All columns of `docs` and `ids_col`, the array of token ids of the whole text; a column of that name is replaced.

    With `bytes_col` the ids are decoded in the same pass, as `with_bytes` would.

    A null or empty text has no ids. No special tokens. Every row is encoded by itself, so repeated rows
    agree and an empty table stays empty. The vocabulary (fixed size) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    small_batches(docs.sparkSession)
    rest = docs.drop(ids_col, *([bytes_col] if bytes_col else []))
    source = rest.withColumn("__text", F.col(f"`{text_col}`").cast("string"))
    names = rest.columns
    schema = T.StructType(rest.schema.fields + [T.StructField(ids_col, T.ArrayType(T.IntegerType()))] + ([T.StructField(bytes_col, T.BinaryType())] if bytes_col else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, cut = _pieces(shared.value, pattern)
        vocabulary = _vocabulary(shared.value) if bytes_col else None
        for part in chunks(batches, "__text"):
            lists, count = [], [0]
            for text in part.column(len(names)).to_pylist():
                packed = b"".join(map(memo.__getitem__, cut.findall(text))) if text else b""
                lists.append(packed)
                count.append(count[-1] + len(packed) // 4)
            ids = pa.ListArray.from_arrays(pa.array(count, pa.int32()), pa.array(np.frombuffer(b"".join(lists), np.int32)))
            made = [ids, _decoded(ids, vocabulary)] if bytes_col else [ids]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *made], schema.names)

    return source.mapInArrow(run, schema)


def with_bytes(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """All columns of `encoded` and `bytes_col`, the bytes its ids stand for; null ids give empty bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    rest = encoded.drop(bytes_col)
    at = rest.columns.index(ids_col)
    names = rest.columns
    schema = T.StructType(rest.schema.fields + [T.StructField(bytes_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _decoded(batch.column(at), vocabulary)], [*names, bytes_col])

    return rest.mapInArrow(run, schema)
