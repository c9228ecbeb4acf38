"""Substring dedup: windows of consecutive words that occur more than once are removed everywhere.

Super-k-mers: the smallest hash of all short word grams of a window is its minimiser. Consecutive windows
with one minimiser travel together as one packed string to the minimiser's bucket, so a word is sent
about three times and not once for each of its windows. Equal windows have equal minimisers and meet in
one bucket; there super-k-mers whose minimiser no other one has are done at once (about three in four), the windows of the
others are sorted by a rolling hash, and runs of equal hashes are compared word by word, so counts are exact.

Grams that a sample shows to be frequent (a line that many documents share) come last in the order of hashes, so that
windows around such a line spread over the buckets of their other grams.

Before the shuffle each task drops repeats of a super-k-mer that it has already packed for the current
piece of its input: those windows are known to be repeated, and their ranges go straight to the result. A passage that
a third of all documents share thus reaches its bucket once for each piece, not once for each document; a bucket
that still grows is thinned in the same way whenever it passes BUCKET_LIMIT bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.llm.common import chunks, column_bytes, hash_strings, joined_words, mixed, small_batches, word_codes

WINDOW, GRAM = 35, 4
#: Bytes of text per bucket, and the most partitions that buckets are dealt to.
BUCKET_BYTES, MAX_PARTITIONS, BUCKET_LIMIT = 4 << 20, 20_000, 96 << 20
TEXT_LEVEL = 6
#: Text read to find frequent minimisers, and the most of them that are told to all tasks.
SKEW_BYTES, MAX_HEAVY = 64 << 20, 1 << 16
_BASE = 0x9E3779B97F4A7C15
_ORDER = 2**63 - 1
_RANGE = "k1 bigint, k2 bigint, first int, last int"


def _rolling(values: np.ndarray, window: int) -> np.ndarray:
    """Polynomial hash (mod 2**64) of every `window` consecutive values."""
    n = len(values) - window + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n <= 0:
        return out
    power, step, width, done = values.astype(np.uint64), _BASE, 1, 0
    while width <= window:
        if window & width:
            out = out * np.uint64(step) + power[done:done + n]
            done += width
        power = power[:-width] * np.uint64(step) + power[width:] if len(power) > width else power[:0]
        step, width = step * step % 2**64, width * 2
    return out


def _sliding_min(values: np.ndarray, window: int) -> np.ndarray:
    out, width = values, 1
    while width * 2 <= window:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(out) - (window - width)], out[window - width:]) if window > width else out


def _pack(columns: list[np.ndarray], text: bytes) -> bytes:
    """Columns byte by byte (high bytes are mostly 0) and then the text, compressed apart: they have nothing in common."""
    body = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() for c in columns)
    body = zstandard.compress(struct.pack("<q", len(columns[0])) + body, 3)
    return struct.pack("<q", len(body)) + body + (zstandard.compress(text, TEXT_LEVEL) if text else b"")


def _unpack(blob: bytes, kinds: list) -> tuple[list[np.ndarray], bytes]:
    size, = struct.unpack_from("<q", blob)
    raw = zstandard.decompress(blob[8:8 + size])
    n, = struct.unpack_from("<q", raw)
    at, columns = 8, []
    for kind in kinds:
        width = np.dtype(kind).itemsize
        columns.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel())
        at += n * width
    return columns, zstandard.decompress(blob[8 + size:]) if len(blob) > 8 + size else b""


#: k1, k2, first word, words, copies (1, or 2 for more; and INNER), minimiser (its low bits)
_PACKED = [np.int64, np.uint16, np.int32, np.int32, np.uint8, np.uint16]
#: Marks a super-k-mer that holds its minimiser twice, so that it may repeat a window by itself.
INNER = 4
_DIRECT = [np.int64, np.uint16, np.int32, np.int32]


def _repeats(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each string the index of its first equal, and how many there are."""
    seen: dict[bytes, int] = {}
    first = np.fromiter((seen.setdefault(s, i) for i, s in enumerate(strings)), np.int64, len(strings))
    return first, np.bincount(first, minlength=len(strings))[first]


def _minimisers(line: bytes, ends: np.ndarray, counts: np.ndarray, window: int, gram: int, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser by first word, the text each word belongs to, the words at which windows start, and all grams.

    Grams in `heavy` (sorted) come last in the order, so a window takes one only if it holds no other.
    """
    codes, words = word_codes(line, ends)
    grams = mixed(_rolling(hash_strings(words)[codes], gram)) & np.uint64(_ORDER)
    if len(heavy):
        frequent = heavy[np.minimum(np.searchsorted(heavy, grams), len(heavy) - 1)] == grams
        grams = np.where(frequent, grams | np.uint64(_ORDER + 1), grams)
    least = _sliding_min(grams, window - gram + 1)
    doc = np.repeat(np.arange(len(counts)), counts)
    return least, doc, np.flatnonzero(doc[: len(least)] == doc[window - 1:]), grams


def super_kmers(k1: np.ndarray, k2: np.ndarray, texts: list[bytes], window: int, gram: int, buckets: int, heavy: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, kind, blob) of one piece: kind 0 packs super-k-mers, kind 1 ranges known to be repeated."""
    line, starts, ends, counts = joined_words(texts)
    if len(ends) < window:
        return
    least, doc, at, grams = _minimisers(line, ends, counts, window, gram, heavy)
    begin = np.cumsum(counts) - counts
    if not len(at):
        return
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]])
    head = np.flatnonzero(new)
    run = np.diff(np.append(head, len(at)))
    first = at[head]
    words_in = run + window - 1
    strings = [line[s:e] for s, e in zip(starts[first].tolist(), ends[first + words_in - 1].tolist())]
    same, copies = _repeats(strings)
    owner = doc[first]
    a, b, pos = k1[owner], k2[owner].astype(np.uint16), (first - begin[owner]).astype(np.int32)
    twice = np.flatnonzero(copies > 1)
    if len(twice):
        yield int(mixed(k2[:1])[0] % np.uint64(buckets)), 1, _pack([a[twice], b[twice], pos[twice], words_in[twice].astype(np.int32)], b"")
    kept = np.flatnonzero(same == np.arange(len(strings)))
    spread = words_in[kept] - gram + 1
    place = np.repeat(first[kept] - np.cumsum(spread) + spread, spread) + np.arange(spread.sum())
    inner = np.add.reduceat(grams[place] == np.repeat(least[first[kept]], spread), np.cumsum(spread) - spread, dtype=np.int64) > 1
    flags = np.minimum(copies[kept], 2) | np.where(inner, INNER, 0)
    bucket = (least[first[kept]] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    kept, bucket, flags = kept[order], bucket[order], flags[order].astype(np.uint8)
    cut = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
    for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
        k = kept[s:e]
        yield int(bucket[s]), 0, _pack(
            [a[k], b[k], pos[k], words_in[k].astype(np.int32), flags[s:e], least[first[k]].astype(np.uint16)], b"\n".join([strings[i] for i in k.tolist()])
        )


class Bucket:
    """The super-k-mers of one bucket and the ranges found repeated among them."""

    def __init__(self, window: int):
        self.window, self.limit = window, BUCKET_LIMIT
        self.parts: list[tuple[list[np.ndarray], bytes]] = []
        self.size = 0

    def add(self, blob: bytes) -> Iterator[list[np.ndarray]]:
        columns, text = _unpack(blob, _PACKED)
        self.parts.append((columns, text))
        self.size += len(text)
        if self.size > self.limit:
            yield from self.thin()

    def _whole(self) -> tuple[list[np.ndarray], bytes]:
        return [np.concatenate(c) for c in zip(*(p[0] for p in self.parts))], b"\n".join(p[1] for p in self.parts)

    def thin(self) -> Iterator[list[np.ndarray]]:
        """Keep one of each repeated super-k-mer, marked as repeated; give out the ranges of all of them."""
        columns, text = self._whole()
        strings = text.split(b"\n")
        first, copies = _repeats(strings)
        again = copies > 1
        if again.any():
            yield [c[again] for c in columns[:4]]
        columns[4] = np.where(again, columns[4] & INNER | 2, columns[4]).astype(np.uint8)
        kept = np.flatnonzero(first == np.arange(len(first)))
        text = b"\n".join([strings[i] for i in kept.tolist()])
        self.parts, self.size = [([c[kept] for c in columns], text)], len(text)
        self.limit = max(BUCKET_LIMIT, 2 * self.size)

    def finish(self) -> Iterator[list[np.ndarray]]:
        if not self.parts:
            return
        w = self.window
        (k1, k2, pos, count, copies, key), text = self._whole()
        self.parts, self.size, self.limit = [], 0, BUCKET_LIMIT
        # a window that repeats has its minimiser in two super-k-mers, or twice in one; all others, most of the text, are done
        _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
        kept = np.flatnonzero((times[inverse] > 1) | (copies & INNER > 0))
        if not len(kept):
            return
        strings = text.split(b"\n")
        text = b"\n".join([strings[i] for i in kept.tolist()])
        del strings
        k1, k2, pos, count, copies = k1[kept], k2[kept], pos[kept], count[kept], copies[kept] & 3
        line = text.replace(b"\n", b" ") + b" "
        ends = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        codes, _ = word_codes(line, ends)
        count = count.astype(np.int64)
        begin, windows = np.cumsum(count) - count, count - w + 1
        entry = np.repeat(np.arange(len(count)), windows)
        inside = np.arange(len(entry)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = begin[entry] + inside
        hashes = _rolling(mixed(codes + 1), w)[at]
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        same = np.append(False, ranked[1:] == ranked[:-1])
        codes32, clash = codes.astype(np.int32), False
        joined = np.flatnonzero(same)
        for s in range(0, len(joined), 1 << 16):
            j = joined[s:s + (1 << 16)]
            equal = (codes32[at[order[j]][:, None] + np.arange(w)] == codes32[at[order[j - 1]][:, None] + np.arange(w)]).all(axis=1)
            clash |= not equal.all()
        group = np.cumsum(~same) - 1
        if clash:  # two word sequences with one hash: number those windows by the words themselves
            odd = np.flatnonzero(np.isin(group, group[joined]))
            group[odd] = group.max() + 1 + np.unique(codes32[at[order[odd]][:, None] + np.arange(w)], axis=0, return_inverse=True)[1].ravel()
        weight = np.bincount(group, weights=copies[entry[order]])
        found = np.sort(order[weight[group] >= 2])
        if not len(found):
            return
        e, i = entry[found], inside[found]
        new = np.append(True, (e[1:] != e[:-1]) | (i[1:] != i[:-1] + 1))
        head = np.flatnonzero(new)
        run = np.diff(np.append(head, len(found)))
        e, i = e[head], i[head]
        yield [k1[e], k2[e], (pos[e] + i).astype(np.int32), (run + w - 1).astype(np.int32)]


def heavy_grams(keyed: DataFrame, size: int, buckets: int, window: int, gram: int) -> np.ndarray:
    """Grams so frequent as minimisers that one of them would fill a good part of a bucket, sorted.

    They are looked for in a sample of about SKEW_BYTES of text, chosen by hash; at most MAX_HEAVY come to the
    driver. They only change which bucket a window goes to, not what is found there.
    """
    share = min(1.0, SKEW_BYTES / max(size, 1))
    sample = keyed.filter(F.pmod(F.xxhash64("k2", "k1"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        for part in chunks(batches, "text"):
            line, _, ends, counts = joined_words(column_bytes(part.column(0)))
            if len(ends) >= window:
                least, _, at, _ = _minimisers(line, ends, counts, window, gram, none)
                value, n = np.unique(least[at], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])

    counts = sample.select("text").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    found = counts.filter(F.col("n") > window).orderBy(F.desc("n"), "gram").limit(min(4 * buckets, MAX_HEAVY)).collect()
    floor = sum(r["n"] for r in found) / min(4 * buckets, MAX_HEAVY)
    return np.array(sorted(r["gram"] for r in found if r["n"] > floor), np.uint64)


def repeated_ranges(keyed: DataFrame, window: int = WINDOW, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(k1, k2, first, last): word ranges (last excluded) of the rows (k1, k2, text) that repeated windows cover."""
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, size // bucket_bytes)
    heavy = heavy_grams(keyed, size, buckets, window, gram) if buckets > 1 else np.zeros(0, np.uint64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            rows = list(super_kmers(np.asarray(part.column(0)), np.asarray(part.column(1)), column_bytes(part.column(2)), window, gram, buckets, heavy))
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())
            ], ["bucket", "kind", "blob"])

    def found(columns: list[np.ndarray]) -> pa.RecordBatch:
        k1, k2, first, n = columns
        return pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2.astype(np.int64)), pa.array(first), pa.array(first + n)], ["k1", "k2", "first", "last"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bucket = None, Bucket(window)
        for batch in batches:
            for b, kind, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if b != now:
                    yield from map(found, bucket.finish())
                    now = b
                if kind:
                    yield found(_unpack(blob, _DIRECT)[0])
                else:
                    yield from map(found, bucket.add(blob))
        yield from map(found, bucket.finish())

    packed = keyed.select("k1", "k2", "text").mapInArrow(cut, "bucket bigint, kind int, blob binary")
    dealt = packed.repartition(min(buckets, MAX_PARTITIONS), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(count, _RANGE)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """All columns of `docs` and a struct `dedup` (n_words, n_removed, kept) with the words that stay, joined by one space.

    A null or empty text has no words. Repeated rows are two places, so what they hold is removed from both. Rows are told
    apart by 80 bits of hashes of id and text; rows equal in both get equal ranges anyway. Nothing shorter than
    `window` words is removed.
    """
    small_batches(docs.sparkSession)
    keyed = docs.withColumn("dedup", F.struct(
        F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("k1"), F.xxhash64(F.col(f"`{text_col}`"), F.col(f"`{id_col}`")).bitwiseAND(65535).alias("k2"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    ))
    ranges = repeated_ranges(keyed.select("dedup.*"), window, gram)
    spans = ranges.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    lists = spans.select("k1", "k2", F.col("spans.first").alias("firsts"), F.col("spans.last").alias("lasts"))

    def strip(texts: pd.Series, firsts: pd.Series, lasts: pd.Series) -> pd.DataFrame:
        n_words, n_removed, kept = [], [], []
        for text, first, last in zip(texts, firsts, lasts):
            words = text.encode().split()
            n_words.append(len(words))
            gone = 0
            if first is not None and len(first):
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, np.asarray(first), 1)
                np.add.at(edge, np.asarray(last), -1)
                stay = np.cumsum(edge[:-1]) == 0
                gone = int(len(words) - stay.sum())
                words = [words[i] for i in np.flatnonzero(stay).tolist()]
            n_removed.append(gone)
            kept.append(b" ".join(words).decode())
        return pd.DataFrame({"n_words": n_words, "n_removed": n_removed, "kept": kept})

    strip_udf = F.pandas_udf(strip, "n_words bigint, n_removed bigint, kept string")
    left, right = keyed.alias("l"), lists.hint("shuffle_hash").alias("r")
    joined = left.join(right, (F.col("l.dedup.k1") == F.col("r.k1")) & (F.col("l.dedup.k2") == F.col("r.k2")), "left")
    return joined.select(
        *[F.col(f"l.`{c}`") for c in docs.columns if c != "dedup"], strip_udf("l.dedup.text", "r.firsts", "r.lasts").alias("dedup")
    )
