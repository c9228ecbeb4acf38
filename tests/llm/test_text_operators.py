"""Operators on texts against brute force, and the rows that tend to break things."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwright.llm import byte_bpe, components, language_id, mixing, queries, sharding, simhash, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- SimHash ------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@given(st.text(alphabet="aAbÉé \n\t\x1c.", max_size=60))
@settings(max_examples=150, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def clustered(n, rng):
    keys = [rng.getrandbits(64) for _ in range(n)]
    for k in keys[: n // 3]:
        for _ in range(3):
            keys.append(k ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    base = keys[0]
    keys += [base ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]  # one dense group
    return np.array(sorted(set(keys)), np.uint64)


def test_trie_join_finds_every_pair():
    a, b = clustered(300, random.Random(1)), clustered(200, random.Random(2))
    b = np.unique(np.append(b, a[:50] ^ np.uint64(5)))
    found = {(int(x), int(y)) for i, j in simhash.join_tries(a, None, 3) for x, y in zip(i, j)}
    want = {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if int(a[i] ^ a[j]).bit_count() <= 3}
    assert found == want
    found = {(int(x), int(y)) for i, j in simhash.join_tries(a, b, 3) for x, y in zip(i, j)}
    assert found == {(i, j) for i in range(len(a)) for j in range(len(b)) if int(a[i] ^ b[j]).bit_count() <= 3}


def classes(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def test_small_nodes_give_the_same_classes(spark, monkeypatch):
    monkeypatch.setattr(simhash, "NODE_ROWS", 16)
    keys = clustered(150, random.Random(4))
    fps = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "fp bigint")
    first, depth = simhash.trie_nodes(fps, len(keys))
    held = np.searchsorted(first, keys, side="right") - 1
    assert first[0] == 0 and np.bincount(held).max() <= 16
    links = [(int(r.a), int(r.b)) for r in simhash.near_links(fps, 3).collect()]
    place = {int(k): i for i, k in enumerate(keys.view(np.int64))}
    want = classes(len(keys), [(i, j) for i in range(len(keys)) for j in range(i) if int(keys[i] ^ keys[j]).bit_count() <= 3])
    assert classes(len(keys), [(place[a], place[b]) for a, b in links]) == want
    found = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()}
    by_key = [found.get(int(k), int(k)) for k in keys.view(np.int64)]
    assert len(set(by_key)) == len(set(want)) == len(set(zip(by_key, want)))


def test_components_of_a_long_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(500, 500)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()}
    assert {found[i] for i in range(61)} == {0} and {found[100 + i] for i in range(80)} == {100} and 500 not in found
    assert components.components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_simhash_odd_rows(make_docs, odd_rows):
    rows = simhash.near_duplicates(make_docs(odd_rows, fp=1, id="x", component_id=2)).collect()
    assert len(rows) == len(odd_rows)
    assert {r.component_id for r in rows if r.fp == 0} == {1}  # no words: all linked with one another
    assert Counter(r.component_id for r in rows)[4] == 4
    assert simhash.near_duplicates(make_docs([])).count() == 0


# ---- substring dedup -----------------------------------------------------------------------------


def brute_removal(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    kept = []
    for w in words:
        gone = {p for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for p in range(i, i + window)}
        kept.append(" ".join(x for p, x in enumerate(w) if p not in gone))
    return kept


@pytest.mark.parametrize("bucket_bytes", [1 << 20, 500])
def test_substring_against_brute_force(make_docs, monkeypatch, bucket_bytes):
    monkeypatch.setattr(substring, "BUCKET_BYTES", bucket_bytes)
    monkeypatch.setattr(substring, "BUCKET_LIMIT", 2000)
    monkeypatch.setattr(substring.repeated_ranges, "__defaults__", (8, 3, bucket_bytes))
    rng = random.Random(8)
    shared = [[rng.choice("abcdefgh") + str(rng.randint(0, 40)) for _ in range(rng.randint(6, 30))] for _ in range(6)]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts += rng.choice(shared) if rng.random() < 0.4 else [f"u{rng.randint(0, 5000)}" for _ in range(rng.randint(1, 25))]
        texts.append(" \n".join(parts))
    texts += ["a " * 60, "b " * 7, "c " * 8, "d " * 9, texts[0], "", None]
    out = substring.remove_repeats(make_docs(list(enumerate(texts))), window=8, gram=3).collect()
    kept = brute_removal(texts, 8)
    for r in out:
        assert r.dedup.kept == kept[r.doc_id]
        assert r.dedup.n_words == len(WORD.findall(texts[r.doc_id] or "")) and r.dedup.n_removed == r.dedup.n_words - len(WORD.findall(kept[r.doc_id]))
    assert len(out) == len(texts)


def test_windows_repeated_inside_one_super_kmer(make_docs):
    """No other text has their minimisers, so only the mark of a minimiser met twice keeps them."""
    rng = random.Random(12)
    texts = []
    for i in range(300):
        p, n = rng.randint(1, 9), rng.randint(5, 40)
        w = [f"t{i}x{j % p}" for j in range(n)]
        at = rng.randint(0, n)
        texts.append(" ".join(w[:at] + [f"odd{i}"] * rng.randint(0, 1) + w[at:]))
    out = substring.remove_repeats(make_docs(list(enumerate(texts))), window=8, gram=3).collect()
    kept = brute_removal(texts, 8)
    assert all(r.dedup.kept == kept[r.doc_id] for r in out) and sum(k != t for k, t in zip(kept, texts)) > 100


def test_lone_super_kmers_are_left_out_and_shared_ones_not():
    bucket = substring.Bucket(2)
    columns = [np.arange(4), np.arange(4).astype(np.uint16), np.zeros(4, np.int32), np.full(4, 3, np.int32), np.array([1, 1, 1, 1 | substring.INNER], np.uint8), np.array([5, 5, 6, 9], np.uint16)]
    list(bucket.add(substring._pack(columns, b"a b c\nx b c\nb c d\nz z z")))
    (k1, _, first, n), = bucket.finish()
    assert k1.tolist() == [0, 1, 3] and first.tolist() == [1, 1, 0] and n.tolist() == [2, 2, 3]


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(substring, "_rolling", lambda values, window: np.zeros(max(0, len(values) - window + 1), np.uint64))
    bucket = substring.Bucket(2)
    blob = substring._pack([np.array([1, 2, 3]), np.array([1, 2, 3], np.uint16), np.zeros(3, np.int32), np.full(3, 3, np.int32), np.ones(3, np.uint8), np.full(3, 7, np.uint16)], b"a b c\nx b c\nq r s")
    list(bucket.add(blob))
    (k1, _, first, n), = bucket.finish()
    assert k1.tolist() == [1, 2] and first.tolist() == [1, 1] and n.tolist() == [2, 2]


def test_substring_odd_rows(make_docs, odd_rows):
    out = substring.remove_repeats(make_docs(odd_rows, dedup=1, k1=2, firsts=3)).collect()
    assert len(out) == len(odd_rows)
    for r in out:
        if r.text is None or not r.text.split():
            assert (r.dedup.n_words, r.dedup.kept) == (0, "")
        elif r.n_chars < 50_000 and r.doc_id != 8:
            assert r.dedup.kept == "" and r.dedup.n_removed == 120
    assert [r.dedup.n_removed for r in out if r.doc_id == 8] == [0]
    assert substring.remove_repeats(make_docs([])).count() == 0


# ---- mixing --------------------------------------------------------------------------------------


def water_fill(sizes, weights, cap):
    low, high, total = 0.0, 1e15, sum(sizes.values())
    for _ in range(300):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(cap * sizes[s], level * weights[s]) for s in sizes) < total else (low, level)
    return {s: min(cap * sizes[s], low * weights[s]) for s in sizes}


def test_mix_meets_targets(make_docs):
    rng = random.Random(5)
    names = ["Z", "a", "é", "\U0001F600", "￿", None]
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), "en", rng.choice(names[:1] * 6 + names)) for i in range(3000)]
    out = mixing.mix(make_docs(rows), block_rows=128)
    got = out.collect()
    sizes = Counter()
    for _, text, _, s in rows:
        sizes[s] += len(text.split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    want = water_fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 3)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * want[r.source] and 0 <= r.copies <= 3
        taken[r.source] += r.size * r.copies
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 60 + 0.002 * want[s]
    again = mixing.mix(make_docs(rows).repartition(3), block_rows=128).collect()
    assert sorted((r.id, r.copies) for r in got) == sorted((r.id, r.copies) for r in again)


def test_mix_odd_rows(make_docs, odd_rows):
    out = mixing.mix(make_docs(odd_rows, size=7, copies="x", target=1)).collect()
    assert len(out) == len(odd_rows) and all(r.copies == 1 for r in out if r.size == 0)
    assert mixing.mix(make_docs([])).count() == 0
    assert [r.target for r in mixing.mix(make_docs([(1, None, "en", "a")])).collect()] == [0.0]


# ---- shards --------------------------------------------------------------------------------------


def least_capacity(sizes, shards):
    def needs(c):
        n, room = 1, c
        for s in sizes:
            if s > room:
                n, room = n + 1, c
            room -= s
        return n

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if needs(mid) <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("resolution", [1 << 13, 40])
def test_shards_are_minimax(make_docs, monkeypatch, resolution):
    monkeypatch.setattr(sharding, "RESOLUTION", resolution)
    monkeypatch.setattr(sharding, "GROUPS_PER_BUCKET", 50)
    rng = random.Random(6)
    texts = ["x" * rng.randint(0, 90) + str(rng.randint(0, 150)) for _ in range(500)] + ["same"] * 150 + [None, "", "y" * 4000]
    out = sharding.shard(make_docs(list(enumerate(texts)))).collect()
    groups = defaultdict(list)
    for r in out:
        groups[texts[r.id] or ""].append(r)
    assert all(len({r.shard for r in g}) == 1 for g in groups.values())
    order = sorted(groups, key=lambda t: hashlib.sha256(t.encode()).digest())
    best = least_capacity([sum(r.size for r in groups[t]) for t in order], 16)
    sums, slots = Counter(), defaultdict(list)
    for r in out:
        sums[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert {r.capacity for r in out} == {best} and max(sums.values()) <= best and len(sums) == 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert [groups[t][0].shard for t in order] == sorted(groups[t][0].shard for t in order)


def test_shards_odd_rows(make_docs, odd_rows):
    out = sharding.shard(make_docs(odd_rows, shard=1, slot=2, digest=3, size=4)).collect()
    assert len(out) == len(odd_rows) and {r.text_crc32 for r in out if r.size == 1} == {None, 0}
    assert sharding.shard(make_docs([])).count() == 0


# ---- byte-level BPE --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    import tiktoken

    ranks = byte_bpe.load_ranks(public_tokenizers.path(queries.VOCABULARY))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_token_encodes_to_itself(vocabulary):
    merger = byte_bpe.Merger(vocabulary[0])
    assert all(merger.merge(t) == (r,) for t, r in itertools.islice(vocabulary[0].items(), 0, None, 7))


@given(st.one_of(st.text(max_size=80), st.text(alphabet="aeth nñ'\n", max_size=200), st.text(alphabet="ab", min_size=50, max_size=300)))
@settings(max_examples=300, deadline=None)
def test_encode_equals_the_library(vocabulary, text):
    memo, cut = byte_bpe._pieces(vocabulary[0], public_tokenizers.PATTERN)
    ids = np.frombuffer(b"".join(map(memo.__getitem__, cut.findall(text))), np.int32).tolist()
    assert ids == vocabulary[1].encode_ordinary(text)


def test_bpe_odd_rows(make_docs, odd_rows, vocabulary):
    ranks, library = vocabulary
    docs = make_docs(odd_rows, ids="clash", decoded=5)
    out = byte_bpe.with_bytes(byte_bpe.with_ids(docs, ranks, public_tokenizers.PATTERN), ranks).collect()
    once = byte_bpe.with_ids(docs, ranks, public_tokenizers.PATTERN, bytes_col="decoded").collect()
    assert sorted((r.ids, r.decoded) for r in once) == sorted((r.ids, r.decoded) for r in out)
    assert len(out) == len(odd_rows)
    for r in out:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert byte_bpe.with_ids(make_docs([]), ranks, public_tokenizers.PATTERN).count() == 0


# ---- language --------------------------------------------------------------------------------------


def test_forward_backward_against_enumeration(monkeypatch):
    monkeypatch.setattr(language_id, "BLOCK", 3)
    rng = np.random.default_rng(1)
    counts, moves = np.array([1, 7, 0, 3, 4]), rng.normal(size=(3, 3))
    scores = rng.normal(size=(counts.sum(), 3)) * 2
    share, at = language_id.expected_share(scores, counts, moves), 0
    for c, n in enumerate(counts):
        own = scores[at:at + n]
        at += n
        want, total = np.zeros(3), 0.0
        for path in itertools.product(range(3), repeat=n) if n else ():
            weight = np.exp(sum(own[i, l] for i, l in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            total += weight
            want += weight * np.bincount(path, minlength=3)
        assert np.allclose(share[c], want / total / n if n else 0)


def test_language_held_out(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = queries.op7_language_id(spark, small).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in out if r.held_out]
    assert len(out) == len(truth) and len(held) > 20 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_mixed_text_follows_its_words(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language_id.train(docs)
    by = {r.lang: r.text.split()[:40] for r in docs.filter("n_chars > 400").collect()}
    text = " ".join(by["de"][:10] + by["fr"][:40] + by["de"][10:15])
    (lang,), (score,) = model.predict([text])
    assert lang == "fr" and 0.5 < score < 0.95


def test_language_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows, lang_pred="clash", score=1)
    out = language_id.identify(docs, language_id.train(docs)).collect()
    assert len(out) == len(odd_rows)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in out if r.text is None or not r.text.strip())
    none = language_id.train(make_docs([]))
    assert none.predict(["abc", None])[0] == ["und", "und"]


def test_decoding_tree(monkeypatch, vocabulary):
    import pyarrow as pa

    monkeypatch.setattr(byte_bpe, "DECODE_LEAF", 3)
    monkeypatch.setattr(byte_bpe, "LEAVES", 8)
    ranks = vocabulary if isinstance(vocabulary, dict) else byte_bpe.load_ranks(public_tokenizers.path(queries.VOCABULARY))
    token = {v: k for k, v in ranks.items()}
    rng = random.Random(9)
    lists = [[rng.choice(list(token)[:300]) for _ in range(rng.choice([0, 1, 2, 3, 4, 9, 30]))] for _ in range(80)] + [None, []]
    got = byte_bpe._decoded(pa.array(lists, pa.list_(pa.int32())), byte_bpe._vocabulary(ranks)).to_pylist()
    assert got == [b"".join(token[t] for t in ids or []) for ids in lists]
