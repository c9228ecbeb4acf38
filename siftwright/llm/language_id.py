"""Language identification with a linear-chain conditional random field over words.

A text is a chain of its words (runs of letters). A word's score for each language is the sum of learned weights of its affixes,
its character n-grams and its lexicon entry; transition weights say how readily a text changes its language.
Forward-backward gives every word a distribution over the languages, also in texts that mix them; the text's
language is the one with the most expected words, and the score is its share.

Training chains are made from a bounded sample of labelled texts: spans of one or several texts in a row, each word
labelled with its text's language. The weights are fitted by mini-batch gradient steps on the exact likelihood.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwright.llm.common import chunks, mixed, small_batches

UNKNOWN = "und"
#: About this many labelled texts per language are fitted on, each by chains from anywhere in it; every text is predicted.
SAMPLE_TEXTS = 400
CHAINS, CHAIN_WORDS, EPOCHS, BATCH, RATE, DECAY = 6000, 24, 6, 250, 0.5, 1e-5
BUCKETS = 1 << 16
LEXICON = 3000
BLOCK = 128
MEMO = 300_000
_RUNS = re.compile(r"[^\W\d_]+")


def letter_words(text: str) -> list[str]:
    """Runs of letters, lower case. Digits, number signs (½, ², Ⅷ) and all else end a word; so do combining marks that stand apart from their letter."""
    found = _RUNS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [part for run in found for part in (run if run.isalpha() else "".join(c if c.isalpha() else " " for c in run)).split()]


def feature_parts(words: list[str], lexicon: dict[str, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word, feature) arrays, sorted by word: hashed n-grams and affixes of lower-case words, all of them however long, and lexicon entries."""
    raw = [f"<{w}>".encode("utf-8", "surrogatepass") for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    text = np.frombuffer(b"".join(raw) + b"\0\0\0", np.uint8).astype(np.uint64)
    end = np.cumsum(size)
    start, word = end - size, np.repeat(np.arange(len(raw)), size)

    def hashed(at: np.ndarray, k: int, kind: int) -> np.ndarray:
        value = np.full(len(at), kind << 40, np.uint64)
        for j in range(k):
            value |= text[at + j] << np.uint64(8 * j)
        return (mixed(value) % np.uint64(BUCKETS)).astype(np.int64)

    parts, left = [], end[word] - np.arange(len(word))
    for k in (2, 3):
        at = np.flatnonzero(left >= k)
        parts.append((word[at], hashed(at, k, k)))
    for k in (2, 3, 4):
        at = np.flatnonzero(size >= k)
        parts += [(at, hashed(start[at], k, 8 + k)), (at, hashed(end[at] - k, k, 16 + k))]
    known = [(i, e) for i, w in enumerate(words) if (e := lexicon.get(w)) is not None]
    return parts + [(np.array([i for i, _ in known], np.int64), np.array([BUCKETS + e for _, e in known], np.int64))]


def features(word: str, lexicon: dict[str, int]) -> list[int]:
    return [int(x) for _, flat in feature_parts([word], lexicon) for x in flat]


def _by_word(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """All features of the words one word after the other, and how many each has."""
    parts = feature_parts(words, lexicon)
    word, flat = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    return flat[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))


class Model:
    """Learned weights: one row of scores per feature, and a matrix of transitions."""

    def __init__(self, languages: list[str], lexicon: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.languages, self.lexicon, self.weights, self.moves = languages, lexicon, weights, moves
        self.memo: dict[str, int] = {}
        self.rows: list[np.ndarray] = []

    def __getstate__(self):
        return (self.languages, self.lexicon, self.weights, self.moves)

    def __setstate__(self, state):
        self.__init__(*state)

    def forget(self) -> None:
        """Free what was remembered about words."""
        self.memo.clear()
        self.rows = []

    def scores(self, words: list[str]) -> np.ndarray:
        """Scores of each word for each language."""
        memo = self.memo
        if len(memo) > MEMO:
            self.forget()
        new = [w for w in dict.fromkeys(words) if w not in memo]
        if new:
            sums = np.zeros((len(new), self.weights.shape[1]), self.weights.dtype)
            for word, flat in feature_parts(new, self.lexicon):
                if len(word):
                    head = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                    sums[word[head]] += np.add.reduceat(self.weights[flat], head, axis=0) if len(head) < len(word) else self.weights[flat]
            for w in new:
                memo[w] = len(memo)
            self.rows.append(sums)
            self.rows = [np.concatenate(self.rows)]
        at = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
        return self.rows[0][at].astype(np.float64)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        words, counts = [], []
        for t in texts:
            found = letter_words(t) if t else []
            words += found
            counts.append(len(found))
        counts = np.array(counts, np.int64)
        share = expected_share(self.scores(words), counts, self.moves) if words else np.zeros((len(texts), len(self.languages)))
        best = share.argmax(1)
        known = counts > 0
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, np.clip(share[np.arange(len(texts)), best], 0, 1), 0.0)


def expected_share(scores: np.ndarray, counts: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Mean word distribution of each chain, by forward-backward.

    Chains are cut into blocks. A block's effect on messages is a matrix; those are computed for all blocks side by side, passed
    along each chain, and the words' distributions then follow inside all blocks at once.
    """
    k, step = scores.shape[1], np.exp(moves - moves.max())
    blocks = -(-counts // BLOCK)
    chain = np.repeat(np.arange(len(counts)), blocks)
    first_block = np.cumsum(blocks) - blocks
    nth = np.arange(len(chain)) - first_block[chain]
    size = np.minimum(BLOCK, counts[chain] - nth * BLOCK)
    start = (np.cumsum(counts) - counts)[chain] + nth * BLOCK
    place = np.arange(BLOCK)
    mask = place[None] < size[:, None]
    local = np.exp(scores - scores.max(1, keepdims=True))[np.minimum(start[:, None] + place[None], len(scores) - 1)]
    local = np.where(mask[:, :, None], local, 1.0)
    m = len(chain)
    opening = nth == 0  # the first word of a chain has no transition before it
    effect = np.broadcast_to(np.eye(k), (m, k, k)).copy()
    for t in range(BLOCK):
        live = mask[:, t]
        if not live.any():
            break
        moved = (effect.reshape(-1, k) @ step).reshape(m, k, k)
        if t == 0:
            moved = np.where(opening[:, None, None], effect, moved)
        moved = moved * local[:, t][:, None, :]
        moved /= moved.max(axis=(1, 2), keepdims=True)
        effect = np.where(live[:, None, None], moved, effect)
    into, out = np.ones((m, k)) / k, np.ones((m, k)) / k
    for b in range(1, int(blocks.max(initial=0))):
        at = np.flatnonzero(nth == b)
        into[at] = np.einsum("nk,nkj->nj", into[at - 1], effect[at - 1])
        into[at] /= into[at].sum(1, keepdims=True)
    for b in range(int(blocks.max(initial=0)) - 2, -1, -1):
        at = np.flatnonzero((nth == b) & (b + 1 < blocks[chain]))
        out[at] = np.einsum("nkj,nj->nk", effect[at + 1], out[at + 1])
        out[at] /= out[at].sum(1, keepdims=True)
    ahead = np.empty((BLOCK, m, k))
    now = into
    for t in range(BLOCK):
        moved = now @ step
        if t == 0:
            moved = np.where(opening[:, None], now, moved)
        moved = moved * local[:, t]
        now = np.where(mask[:, t][:, None], moved / moved.sum(1, keepdims=True), now)
        ahead[t] = now
    total, back = np.zeros((m, k)), out
    for t in range(BLOCK - 1, -1, -1):
        both = ahead[t] * back
        total += np.where(mask[:, t][:, None], both / both.sum(1, keepdims=True), 0.0)
        moved = (back * local[:, t]) @ step.T
        back = np.where(mask[:, t][:, None], moved / moved.sum(1, keepdims=True), back)
    share = np.zeros((len(counts), k))
    np.add.at(share, chain, total)
    return share / np.maximum(counts, 1)[:, None]


# ---- fitting ------------------------------------------------------------------------------------


def _chains(texts: list[tuple[list[str], int]], languages: int, rng: np.random.Generator) -> tuple[list[list[str]], np.ndarray]:
    """Half of the chains keep one text, the others change it every few words."""
    by = [[w for w, l in texts if l == k] for k in range(languages)]
    words, labels = [], np.zeros((CHAINS, CHAIN_WORDS), np.int64)
    for c in range(CHAINS):
        chain: list[str] = []
        while len(chain) < CHAIN_WORDS:
            lang = int(rng.integers(languages))
            text = by[lang][int(rng.integers(len(by[lang])))]
            span = CHAIN_WORDS if c % 2 else int(rng.integers(3, 13))
            at = int(rng.integers(max(1, len(text) - span + 1)))
            part = text[at:at + min(span, CHAIN_WORDS - len(chain))]
            labels[c, len(chain):len(chain) + len(part)] = lang
            chain += part
        words.append(chain)
    return words, labels


def fit(texts: list[tuple[str, str]], seed: int = 7) -> Model:
    """Fit on (text, language) pairs; those without letters are left out."""
    split = [(w, l) for t, l in texts if (w := letter_words(t))]
    languages = sorted({l for _, l in split})
    k = len(languages)
    count: dict[str, int] = {}
    for w, _ in split:
        for x in w:
            count[x] = count.get(x, 0) + 1
    common = sorted((w for w, n in count.items() if n > 2), key=lambda w: (-count[w], w))[:LEXICON]
    lexicon = {w: i for i, w in enumerate(common)}
    weights, moves = np.zeros((BUCKETS + LEXICON, max(k, 1)), np.float32), np.zeros((max(k, 1), max(k, 1)))
    if k < 2:
        return Model(languages or [UNKNOWN], lexicon, weights, moves)
    rng = np.random.default_rng(seed)
    chains, labels = _chains([(w, languages.index(l)) for w, l in split], k, rng)
    known = {w: i for i, w in enumerate(dict.fromkeys(w for c in chains for w in c))}
    flat, sizes = _by_word(list(known), lexicon)
    code = np.array([[known[w] for w in c] for c in chains])
    begin = np.cumsum(sizes) - sizes
    seen, seen_moves = np.full(weights.shape[0], 1e-6), np.full((k, k), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(CHAINS)
        for s in range(0, CHAINS, BATCH):
            c, y = code[order[s:s + BATCH]], labels[order[s:s + BATCH]]
            used, inverse = np.unique(c, return_inverse=True)
            n = sizes[used]
            at = flat[np.repeat(begin[used], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            emit = np.add.reduceat(weights[at], np.cumsum(n) - n, axis=0)[inverse.reshape(c.shape)].astype(np.float64)
            marginal, pair = _marginals(emit, moves)
            error = np.eye(k)[y] - marginal
            per_word = np.zeros((len(used), k))
            np.add.at(per_word, inverse.ravel(), error.reshape(-1, k))
            grad = np.zeros_like(weights)
            np.add.at(grad, at, np.repeat(per_word, n, axis=0).astype(np.float32))
            grad = grad / len(c) - DECAY * weights
            seen += (grad**2).sum(1)
            weights += (RATE / np.sqrt(seen))[:, None].astype(np.float32) * grad
            observed = np.zeros((k, k))
            np.add.at(observed, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            step = (observed - pair) / len(c)
            seen_moves += step**2
            moves = moves + RATE * step / np.sqrt(seen_moves)
    return Model(languages, lexicon, weights, moves)


def _marginals(emit: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word marginals and summed pair marginals of equally long chains."""
    n, length, k = emit.shape
    local, step = np.exp(emit - emit.max(2, keepdims=True)), np.exp(moves - moves.max())
    ahead, back = np.empty_like(local), np.ones_like(local)
    ahead[:, 0] = local[:, 0] / local[:, 0].sum(1, keepdims=True)
    for t in range(1, length):
        now = (ahead[:, t - 1] @ step) * local[:, t]
        ahead[:, t] = now / now.sum(1, keepdims=True)
    for t in range(length - 2, -1, -1):
        now = (back[:, t + 1] * local[:, t + 1]) @ step.T
        back[:, t] = now / now.sum(1, keepdims=True)
    both = ahead * back
    pair = np.zeros((k, k))
    for t in range(length - 1):
        joint = ahead[:, t][:, :, None] * step[None] * (local[:, t + 1] * back[:, t + 1])[:, None, :]
        pair += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(0)
    return both / both.sum(2, keepdims=True), pair


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), F.lit(5)) == 0


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_texts: int = SAMPLE_TEXTS) -> Model:
    """Fit on labelled rows that are not held out: per language about `sample_texts` of them, chosen by a hash of the id.

    Rows with a null text or language teach nothing. Without any labelled row the model knows `und` only.
    """
    teach = docs.filter(~held_out(id_col)).select(F.xxhash64(F.lit("teach"), F.col(f"`{id_col}`")).alias("mark"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).filter("text is not null and lang is not null")
    sizes = teach.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per language
    keep = F.lit(False)
    for r in sizes:
        keep = keep | (F.col("lang") == r["lang"]) & (F.pmod("mark", F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_texts / r["n"])))
    sample = teach.filter(keep).orderBy("mark").limit(2 * sample_texts * max(1, len(sizes))).collect()
    return fit([(r["text"], r["lang"]) for r in sample])


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """All columns of `docs`, the predicted language and its score; columns of those names are replaced.

    Only the text is looked at. `und` with score 0 if it is null or holds no letter. Repeated rows agree; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    rest = docs.drop(lang_name, score_name)
    names = rest.columns
    schema = T.StructType(rest.schema.fields + [T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = rest.withColumn("__text", F.col(f"`{text_col}`").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = shared.value
        for part in chunks(batches, "__text"):
            lang, score = learned.predict(part.column(len(names)).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(lang, pa.string()), pa.array(score)], [*names, lang_name, score_name])

    return source.mapInArrow(run, schema)
