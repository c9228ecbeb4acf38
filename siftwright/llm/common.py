"""Small helpers that several operators share: text batches, hashing, pinned tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.plans.materialize import pin, unpin

__all__ = ["pin", "unpin", "small_batches", "table", "chunks", "column_bytes", "joined_words", "word_codes", "hash_strings", "text_or_empty"]

#: The words of every contract here: runs of anything but space and the five ASCII controls 9-13.
WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES, BATCH_BYTES = 2 << 20, 8 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python in batches of a few MB, so that memory does not depend on how long a batch's rows are.

    A session setting, lowered only; it changes no result.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower()
    units = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30, "": 1}
    number = now.rstrip("bkmg")
    size = int(number) * units.get(now[len(number):], 1)
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def column_bytes(column: pa.Array) -> list[bytes]:
    """The values of a text column as bytes, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [v or b"" for v in column.cast(kind).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each piece hold about `limit` bytes; one long text is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0), dtype=np.int64)
        at = 0
        total = np.cumsum(sizes)
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()  # workers live on between tasks


def joined_words(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All words of the texts, each followed by one space; word starts, word ends, and words per text."""
    counts, parts = [], []
    for t in texts:
        words = t.split()  # for bytes these separators are just space and 9-13
        counts.append(len(words))
        if words:
            parts.append(b" ".join(words))
    line = b" ".join(parts) + b" " if parts else b""
    ends = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = np.empty_like(ends)
    if len(ends):
        starts[0] = 0
        starts[1:] = ends[:-1] + 1
    return line, starts, ends, np.asarray(counts, dtype=np.int64)


def word_codes(line: bytes, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """An integer per word, equal for equal words, and the distinct words (each with its closing space)."""
    if not len(ends):
        return np.zeros(0, np.int64), []
    offsets = np.concatenate([[0], ends + 1]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(line)]
    ).dictionary_encode()
    return np.asarray(words.indices, dtype=np.int64), words.dictionary.to_pylist()


def hash_strings(values: list[bytes], seed: int = 0) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(v, seed) for v in values), dtype=np.uint64, count=len(values))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


class Words:
    """The words of a piece of texts: the bytes of all texts, and where each word starts and ends in them."""

    def __init__(self, data: bytes, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        word = np.ones(len(data) + 2, bool)
        word[0] = word[-1] = False
        word[1:-1] = ~_BLANK[np.frombuffer(data, np.uint8)]
        cut = offsets[:-1][(offsets[:-1] > 0) & (offsets[:-1] < len(data))]
        cut = cut[word[cut] & word[cut + 1]]  # texts that meet without white space
        edge = np.flatnonzero(word[1:] != word[:-1])
        self.starts, self.ends = (np.sort(np.concatenate([e, np.unique(cut)])) if len(cut) else e for e in (edge[::2], edge[1::2]))
        self.first = np.searchsorted(self.starts, offsets)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]]

    def ends_of(self, i: int) -> np.ndarray:
        """Ends of the words of text `i`, counted from its start."""
        return self.ends[self.first[i]:self.first[i + 1]] - self.offsets[i]

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def codes(self) -> tuple[np.ndarray, pa.Array]:
        """An integer per word, equal for equal words, and the distinct words. No word becomes a Python object."""
        raw = np.frombuffer(self.data, np.uint8)
        sizes = np.concatenate([[0], np.cumsum(self.ends - self.starts)]).astype(np.int64)
        packed = raw[~_BLANK[raw]].tobytes()
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes) - 1, [None, pa.py_buffer(sizes), pa.py_buffer(packed)]).dictionary_encode()
        return np.asarray(found.indices, np.int64), found.dictionary


def words_in(column: pa.Array) -> Words:
    """`Words` of a text column, null as empty."""
    texts = column_bytes(column)
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]).astype(np.int64)
    return Words(b"".join(texts), offsets)
