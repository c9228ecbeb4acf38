"""Periodic runs against the definition, tiled and whole, and the whole query against a brute-force version."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from siftwright.llm import periodic_runs, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    """Every maximal stretch with its smallest period, four times at least."""
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                part = w[i:j + q]
                if not any(part[r:] == part[:-r] for r in range(1, q)):
                    out.add((i, j + q - i, q))
            i = j + 1
    return out


def wordy(rng, n, kinds):
    w = [f"w{rng.randrange(kinds)}" for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n > 10:
            a, p = rng.randrange(n), rng.randrange(1, rng.choice([3, 30, 120]))
            for i in range(a + p, min(n, a + rng.randrange(3 * p, 9 * p))):
                w[i] = w[a + (i - a) % p]
    return w


def test_stretches_and_tiles():
    rng = random.Random(1)
    for _ in range(120):
        w = wordy(rng, rng.randrange(700), rng.choice([1, 2, 3, 50]))
        want, codes = brute(w), np.array([int(x[1:]) for x in w], np.int64)
        s, e, q = periodic_runs.stretches(np.append(codes, -1), 1, 1 << 62)
        assert {(int(a), int(b - a), int(c)) for a, b, c in zip(s, e, q) if b - a >= max(6, 4 * c)} == want
        for tile in (64, 256):
            found = set()
            for low, high, a, b in periodic_runs.tiles(len(w), tile):
                found |= {(int(p), int(x) + a, int(y) + a) for x, y, p in zip(*periodic_runs.stretches(codes[a:b], low, high))}
            joined = {}
            for p, a, b in sorted(found):
                last = joined.setdefault(p, [])
                if last and a <= last[-1][1] - p:
                    last[-1][1] = max(last[-1][1], b)
                else:
                    last.append([a, b])
            assert {(a, b - a, p) for p, some in joined.items() for a, b in some if b - a >= max(6, 4 * p)} == want


def test_colliding_hashes_change_nothing(monkeypatch):
    """Boundaries are confirmed word by word: with a hash that tells nothing apart the runs are the same."""
    rng = random.Random(2)
    monkeypatch.setattr(periodic_runs, "mixed", lambda x: np.zeros(len(x), np.uint64))
    for _ in range(6):
        w = wordy(rng, 300, 2)
        s, e, q = periodic_runs.stretches(np.array([int(x[1:]) for x in w] + [-1], np.int64), 1, 1 << 62)
        assert {(int(a), int(b - a), int(c)) for a, b, c in zip(s, e, q) if b - a >= max(6, 4 * c)} == brute(w)


def expected(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = sorted((s, p, l) for s, l, p in brute(w))
    gone = {i for s, p, l in found for i in range(s + p, s + l)}
    best = min(found, key=lambda r: (-r[2] / r[1], r[0], r[1]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    return (doc_id, len(found), *top, sha("".join(f"{s},{l},{p}\n" for s, p, l in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def key(row):
    return tuple((x is None, x) if x is not None else (True, 0) for x in row)


def test_query_against_brute_force(spark, make_docs, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(wordy(rng, rng.randrange(400), rng.choice([2, 40])))) for i in range(150)] + [(900, "a\x0bb " * 9), (901, "é\x1cé " * 7 + "é\x1cé")]
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).select(*NAMES).collect()]
    assert sorted(got, key=key) == sorted((expected(*r) for r in rows), key=key)


def test_query_on_the_tables(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    rows = [r for r in rows if len((r.text or "").split()) < 1500]  # brute force takes the square of a text's length
    want = {r.doc_id: expected(*r) for r in rows}
    got = {r.doc_id: tuple(r) for r in queries.op11_periodic_runs(spark, small).select(*NAMES).collect()}
    assert {k: got[k] for k in want} == want and any(w[1] for w in want.values())


@pytest.mark.parametrize("long_bytes,tile", [(1 << 20, 1 << 17), (300, 64)])
def test_odd_rows(spark, make_docs, odd_rows, long_bytes, tile):
    rows = odd_rows + [(20, "tic tac " * 3000), (21, "tic tac " * 3000), (21, "tic tac " * 3000), (22, "x " * 50 + "y " + "x " * 50)]
    docs = make_docs(rows, periodic="old", k1="clash", first=1)
    got = periodic_runs.with_runs(docs, long_bytes=long_bytes, tile=tile)
    assert got.columns == [c for c in docs.columns if c != "periodic"] + ["periodic"]
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        w = (r.text or "").split()
        want = {20: [(0, 2, 6000)], 21: [(0, 2, 6000)], 22: [(0, 1, 50), (51, 1, 50)]}.get(r.doc_id, [])
        assert [tuple(x) for x in r.periodic.runs] == want
        if not want:
            assert r.periodic.collapsed.split() == w
    assert {r.periodic.collapsed for r in found if r.doc_id in (20, 21)} == {"tic tac"}
    assert periodic_runs.with_runs(docs.limit(0)).count() == 0
