"""Toxicity by a subsequence string kernel and a support vector machine on Nyström landmarks.

The kernel of two words counts the sequences of three letters that occur in both, gaps allowed, each occurrence weighted by
DECAY to the power of the stretch it spans, scaled to 1 for equal words. A word with letters inserted or put apart still
shares its subsequences with the word it hides. Other signs are gaps: they stretch a subsequence and are in none. Letters that stand alone, three or more
in a row, are read as one word with gaps.

A sentence's kernel with a landmark is the sum over its distinct words of that kernel to the power POWER, without what lies under
FLOOR. Landmarks are words of labelled sentences; Nyström's map turns kernels with landmarks into coordinates in which a linear
SVM is fitted by dual coordinate descent. Labels are known per document, so most sentences of a toxic one are clean: after each fit, sentences
of toxic documents on the clean side teach nothing more. A document's probability is a logistic function of its worst sentence, of
what lies on the toxic side, of all that its words add, and of the number of its sentences.

Since the decision is a sum over words, each distinct word is judged once per worker, and a text costs a few look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwright.llm.common import chunks, column_bytes, hash_strings, small_batches, words_in

#: Labelled documents fitted on, per class, and distinct sentences of theirs that reach the driver.
SAMPLE_DOCS, SAMPLE_SENTENCES = 1500, 50_000
SPAN, DECAY, POWER, FLOOR = 8, 0.7, 3, 0.45
TOXIC_MARKS, CLEAN_MARKS, HARD_MARKS = 80, 8, 32
LEAST_SENTENCES, LEAST_Z = 5, 4.0
#: Words of a sentence at most (longer ones are cut), and letters of a word (longer ones count by their best window).
SENTENCE, WINDOW = 32, 24
COST, EPOCHS, ROUNDS, RIDGE = 1.0, 10, 3, 1e-3
THRESHOLD, WORST = 0.3, 2.0
MEMO = 400_000
_KINDS = 64
_GAPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b < SPAN]
_FACTS = ("worst", "above", "all", "sentences")
_ENDS = (b".", b"!", b"?")
_EDGE = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")


def bare(word: str) -> str:
    """Lower case, without signs at its ends."""
    return _EDGE.sub("", word.lower())


def windows(word: str) -> list[str]:
    """The word itself, or its overlapping windows if it is long."""
    if len(word) <= WINDOW:
        return [word]
    half = WINDOW // 2
    return [word[i:i + WINDOW] for i in range(0, len(word) - half, half)]


def _letter(c: str) -> int:
    """1 to 26 for a to z, 27 to 63 shared by all other letters and digits, 0 for a gap."""
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 + ord(c) % 37 if c.isalnum() else 0


class _Letters(dict):
    def __missing__(self, c: str) -> int:
        self[c] = _letter(c)
        return self[c]


_LETTERS = _Letters()


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, key, weight): for each word its distinct gapped triples and their summed weights."""
    sizes_in = np.fromiter(map(len, words), np.int64, len(words))
    table = np.zeros((len(words), max(int(sizes_in.max(initial=0)), SPAN)), np.int32)
    flat = np.fromiter(map(_LETTERS.__getitem__, "".join(words)), np.int32, int(sizes_in.sum()))
    table[np.repeat(np.arange(len(words)), sizes_in), np.arange(len(flat)) - np.repeat(np.cumsum(sizes_in) - sizes_in, sizes_in)] = flat
    rows, keys, sizes = [], [], []
    for a, b in _GAPS:
        x, y, z = table[:, : table.shape[1] - a - b], table[:, a:table.shape[1] - b], table[:, a + b:]
        at = np.flatnonzero((x > 0) & (y > 0) & (z > 0))
        rows.append(at // x.shape[1])
        keys.append(((x * _KINDS + y) * _KINDS + z).ravel()[at])
        sizes.append(np.full(len(at), DECAY ** (a + b + 1)))
    code = np.concatenate(rows) * _KINDS**3 + np.concatenate(keys)
    distinct, inverse = np.unique(code, return_inverse=True)
    return distinct // _KINDS**3, distinct % _KINDS**3, np.bincount(inverse, np.concatenate(sizes), len(distinct))


class Kernel:
    """Kernels of words with fixed landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        row, key, weight = subsequences(landmarks)
        weight = weight / np.sqrt(np.bincount(row, weight**2, len(landmarks)))[row]
        known, place = np.unique(key, return_inverse=True)
        self.slot = np.full(_KINDS**3, -1, np.int32)
        self.slot[known] = np.arange(len(known))
        self.parts = np.zeros((len(known), len(landmarks)), np.float32)
        self.parts[place, row] = weight

    def __call__(self, words: list[str], least: float = FLOOR) -> np.ndarray:
        """One row per word, one column per landmark; 0 for words of fewer than three letters, and where no kernel of a word can reach `least`."""
        out = np.zeros((len(words), len(self.landmarks)))
        if not words or not self.landmarks:
            return out
        row, key, weight = subsequences(words)
        norm = np.sqrt(np.bincount(row, weight**2, len(words)))
        place = self.slot[key]
        hit = place >= 0
        # by Cauchy and Schwarz no kernel of a word exceeds the share of its norm that lies in known sequences
        hit &= np.sqrt(np.bincount(row[hit], weight[hit] ** 2, len(words)))[row] >= least * norm[row]
        row, place, weight = row[hit], place[hit], weight[hit]
        if len(row):
            head = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            out[row[head]] = np.add.reduceat(self.parts[place] * weight[:, None].astype(np.float32), head, axis=0) / norm[row[head], None]
        return out


def near(kernel: np.ndarray) -> np.ndarray:
    return np.where(kernel < FLOOR, 0.0, np.clip(kernel, 0, 1) ** POWER)


class Model:
    """A sentence's decision is bias + the sum over its distinct words of weights . near(kernel(word)); `curve` turns a document's facts into a probability."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, bias: float, curve: np.ndarray):
        self.landmarks, self.weights, self.bias, self.curve = landmarks, weights, bias, curve
        self.kernel = Kernel(landmarks) if landmarks else None
        self.memo: dict[bytes, float] = {}
        self.bared: dict[str, float] = {}

    def __getstate__(self):
        return (self.landmarks, self.weights, self.bias, self.curve)

    def __setstate__(self, state):
        self.__init__(*state)

    def judge(self, words: list[str]) -> np.ndarray:
        """What each word adds to its sentence; a long one by its best window."""
        out = np.zeros(len(words))
        if self.kernel is None:
            return out
        # words of like length side by side, so that their tables are narrow
        order = sorted((i for i, w in enumerate(words) if 2 < len(w) <= WINDOW), key=lambda i: len(words[i]))
        for at in range(0, len(order), 2000):
            here = order[at:at + 2000]
            out[here] = near(self.kernel([words[i] for i in here])) @ self.weights
        for i, w in enumerate(words):
            if len(w) > WINDOW:
                parts = windows(w)
                out[i] = max(float((near(self.kernel(parts[at:at + 4000])) @ self.weights).max()) for at in range(0, len(parts), 4000))
        return out

    def words(self, tokens: list[bytes]) -> np.ndarray:
        """The same for words as texts write them; tokens that differ only in case and signs around them are judged once."""
        memo, bared = self.memo, self.bared
        if len(memo) > MEMO:
            memo.clear()
        if len(bared) > MEMO:
            bared.clear()
        new = [t for t in tokens if t not in memo]
        if new:
            plain = [bare(t.decode("utf-8", "replace")) for t in new]
            fresh = [w for w in dict.fromkeys(plain) if w not in bared]
            bared.update(zip(fresh, self.judge(fresh).tolist()))
            memo.update((t, bared[w]) for t, w in zip(new, plain))
        return np.fromiter(map(memo.__getitem__, tokens), np.float64, len(tokens))

    def facts(self, column: pa.Array) -> np.ndarray:
        """Per text: decision of its worst sentence, log of the sum of decisions on the toxic side, log of all that words add, log of the number of sentences (all + 1)."""
        found = words_in(column)
        codes, distinct = found.codes()
        counts = found.counts()
        out = np.zeros((len(counts), 4))
        out[:, 0] = self.bias
        if not len(codes):
            return out
        tokens = distinct.to_pylist()
        value = self.words(tokens)
        stops = np.fromiter((t.endswith(_ENDS) for t in tokens), bool, len(tokens))
        alone = np.fromiter((len(t) <= 4 and len(bare(t.decode("utf-8", "replace"))) == 1 for t in tokens), bool, len(tokens))
        segment = segments(stops[codes], counts)
        added = value[codes]
        added[~_first_of(segment, codes)] = 0.0  # a word counts once in a sentence
        doc = np.repeat(np.arange(len(counts)), counts)
        lone = np.flatnonzero(alone[codes])
        if len(lone):
            head = np.flatnonzero(np.append(True, (lone[1:] != lone[:-1] + 1) | (doc[lone[1:]] != doc[lone[:-1]])))
            size = np.diff(np.append(head, len(lone)))
            runs = [lone[h:h + n] for h, n in zip(head[size > 2].tolist(), size[size > 2].tolist())]
            spelt = self.judge(["".join(bare(tokens[c].decode()) for c in codes[at].tolist()) for at in runs])
            for at, more in zip(runs, spelt.tolist()):
                added[at[0]] += max(more, 0.0)
        decision = np.bincount(segment, added) + self.bias
        owner = doc[np.searchsorted(segment, np.arange(len(decision)))]
        worst = np.full(len(counts), -np.inf)
        np.maximum.at(worst, owner, decision)
        out[:, 0] = np.where(np.isfinite(worst), worst, self.bias)
        out[:, 1] = np.log1p(np.bincount(owner, np.maximum(decision, 0.0), len(counts)))
        out[:, 2] = np.log1p(np.bincount(owner, np.maximum(decision - self.bias, 0.0), len(counts)))
        out[:, 3] = np.log1p(np.bincount(owner, minlength=len(counts)))
        return out

    def probability(self, facts: np.ndarray) -> np.ndarray:
        x = np.column_stack([np.clip(facts[:, 0], -WORST, WORST), facts[:, 1:], np.ones(len(facts))]) @ self.curve
        return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def segments(stop: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A rising number per word: sentences end at a stop, at the end of a text, and after SENTENCE words."""
    n = len(stop)
    new = np.zeros(n, bool)
    starts = np.cumsum(counts) - counts
    new[starts[counts > 0]] = True
    new[1:] |= stop[:-1]
    begin = np.flatnonzero(new)
    inside = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
    return np.cumsum(inside % SENTENCE == 0) - 1


def _first_of(segment: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Whether a word is the first of its kind in its sentence."""
    order = np.lexsort((codes, segment))
    again = (segment[order][1:] == segment[order][:-1]) & (codes[order][1:] == codes[order][:-1])
    first = np.ones(len(codes), bool)
    first[order[1:][again]] = False
    return first


# ---- fitting ------------------------------------------------------------------------------------


def sentence_words(texts: list[bytes]) -> Iterator[tuple[int, list[str]]]:
    """(text, distinct words of one sentence), long words by their windows and spelt ones put together."""
    for i, text in enumerate(texts):
        now: list[str] = []
        spelt: list[str] = []

        def flush() -> None:
            if len(spelt) > 2:
                now.extend(windows("".join(spelt)))
            spelt.clear()

        for token in text.split():
            word = bare(token.decode("utf-8", "replace"))
            if len(word) == 1:
                spelt.append(word)
            else:
                flush()
                now += windows(word)
            if token.endswith(_ENDS) or len(now) >= SENTENCE:
                flush()
                for at in range(0, len(now), SENTENCE):
                    yield i, list(dict.fromkeys(w for w in now[at:at + SENTENCE] if w))
                now = []
        flush()
        for at in range(0, len(now), SENTENCE):
            yield i, list(dict.fromkeys(w for w in now[at:at + SENTENCE] if w))


def choose_landmarks(sentences: list[list[str]], toxic: np.ndarray) -> list[str]:
    """Words that toxic sentences hold much more often, frequent words of others, and those of them most like the first."""
    count: dict[str, list[int]] = {}
    for words, y in zip(sentences, toxic.tolist()):
        for w in words:
            count.setdefault(w, [0, 0])[y] += 1
    total = np.maximum(np.bincount(toxic.astype(int), minlength=2), 1)
    share = total[1] / total.sum()
    names = sorted(w for w, (a, b) in count.items() if sum(c.isalnum() for c in w) > 2 and a + b >= LEAST_SENTENCES)
    if not names:
        return []
    n = np.array([sum(count[w]) for w in names])
    hits = np.array([count[w][1] for w in names])
    z = (hits - n * share) / np.sqrt(n * share * (1 - share) + 1e-9)
    order = np.lexsort((np.arange(len(names)), -z))
    marked = [names[i] for i in order[:TOXIC_MARKS] if z[i] > LEAST_Z]
    rest = [i for i in np.lexsort((np.arange(len(names)), -n)).tolist() if z[i] <= LEAST_Z]
    clean = [names[i] for i in rest[:CLEAN_MARKS]]
    others = [names[i] for i in rest[CLEAN_MARKS:20_000]]
    if marked and others:
        like = Kernel(marked)
        closest = np.concatenate([like(others[at:at + 4000]).max(1) for at in range(0, len(others), 4000)])
        clean += [others[i] for i in np.lexsort((np.arange(len(others)), -closest))[:HARD_MARKS]]
    return marked + clean


def linear_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, seed: int = 7) -> np.ndarray:
    """Weights of a linear SVM (the last column of `x` is its bias), by dual coordinate descent on the hinge loss."""
    rng = np.random.default_rng(seed)
    w, alpha, size = np.zeros(x.shape[1]), np.zeros(len(x)), (x**2).sum(1)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(x)).tolist():
            if size[i] <= 0:
                continue
            new = min(max(alpha[i] - (y[i] * (x[i] @ w) - 1) / size[i], 0.0), cost[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def logistic(facts: np.ndarray, y: np.ndarray, prior: float) -> np.ndarray:
    """Coefficients of P(toxic) for documents drawn by class, at a share of `prior` toxic ones; targets are drawn in a little so that separable data stay finite."""
    share = y.mean()
    weight = np.where(y > 0, prior / share, (1 - prior) / (1 - share))
    up, down = (weight * y).sum(), (weight * (1 - y)).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a = np.column_stack([np.clip(facts[:, 0], -WORST, WORST), facts[:, 1:], np.ones(len(facts))])
    free = np.ones(a.shape[1], bool)
    while True:
        b = np.zeros(a.shape[1])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a @ b, -35, 35)))
            grad = (a.T @ (weight * (target - p)) - RIDGE * b)[free]
            slope = (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + RIDGE * np.eye(len(b))
            step = np.linalg.solve(slope[np.ix_(free, free)], grad)
            b[free] += step * min(1.0, 2.0 / max(abs(step).max(), 1e-9))
            if abs(step).max() < 1e-8:
                break
        wrong = b[:3] < 0  # more that looks toxic never lowers the probability
        if not wrong.any():
            return b
        free[int(np.argmin(b[:3]))] = False


def constant(prior: float) -> Model:
    """A model that knows only the share of toxic documents."""
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    return Model([], np.zeros(0), 0.0, np.array([0.0, 0.0, 0.0, 0.0, np.log(prior / (1 - prior))]))


def fit(rows: list[tuple[int, list[str]]]) -> Model | None:
    """Landmarks and weights from (label of its document, distinct words) of sentences; None if they tell nothing apart.

    Equal sentences count once in the choice of landmarks, and as toxic if most documents with them are; in the fit they weigh as often
    as documents of a class hold them.
    """
    seen: dict[tuple, list[int]] = {}
    for y, words in rows:
        if words:
            seen.setdefault(tuple(words), [0, 0])[y] += 1
    sentences = list(seen)
    toxic = np.array([b > a for a, b in seen.values()], bool)
    landmarks = choose_landmarks([list(s) for s in sentences], toxic) if toxic.any() and not toxic.all() else []
    if not landmarks:
        return None
    kernel = Kernel(landmarks)
    distinct = sorted({w for s in sentences for w in s})
    place = {w: i for i, w in enumerate(distinct)}  # from here on places of words
    close = np.concatenate([near(kernel(distinct[at:at + 4000])) for at in range(0, len(distinct), 4000)])
    sums = np.array([close[[place[w] for w in s]].sum(0) for s in sentences])
    values, vectors = np.linalg.eigh(near(kernel(landmarks)))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, RIDGE))) @ vectors.T
    coordinates = np.column_stack([sums @ root, np.ones(len(sums))])
    blank, thought = ~sums.any(1), np.ones(len(sums), bool)
    for _ in range(ROUNDS):
        down, up = np.array(list(seen.values()), float).T
        up = np.where(thought, up, 0.0)
        x, y, cost = [], [], []
        for sign, weight in ((1.0, up), (-1.0, down)):
            use = (weight > 0) & ~blank
            x += [coordinates[use], np.append(np.zeros(len(landmarks)), 1.0)[None]]  # sentences without a near word are one row
            cost += [weight[use], [weight[blank].sum()]]
            y += [np.full(use.sum() + 1, sign)]
        w = linear_svm(np.concatenate(x), np.concatenate(y), COST * np.concatenate(cost))
        thought = coordinates @ w > w[-1] / 2
    if not (thought & toxic).any():
        return None
    return Model(landmarks, root @ w[:-1], float(w[-1]), np.zeros(5))


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on labelled documents that are not held out: about `sample_docs` of each class, chosen by a hash of the id.

    Null ids, texts and labels teach nothing; of several labels of one id the greatest counts. Without both classes the model
    knows only the share of toxic ones (0 without labels).
    """
    known = labels.filter(~held_out(id_col)).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows at most
    prior = sizes.get(1, 0) / max(sum(sizes.values()), 1)
    mark = F.xxhash64(F.lit("teach"), "id")
    keep = F.lit(False)
    for y, n in sizes.items():
        keep = keep | (F.col("y") == y) & (F.pmod(mark, F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_docs / n)))
    chosen = known.filter(keep).orderBy(mark, "id").limit(3 * sample_docs)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("text is not null")
    taught = texts.join(F.broadcast(chosen), "id").select(F.xxhash64("id", "text").alias("mark"), "y", "text")
    small_batches(docs.sparkSession)

    def sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            rows = [(i, words) for i, words in sentence_words(column_bytes(part.column(2))) if words]
            order = hash_strings([" ".join(w).encode() for _, w in rows]).view(np.int64)
            made = pa.RecordBatch.from_arrays([pa.array(order), pa.array([w for _, w in rows], pa.list_(pa.string()))], ["place", "words"])
            at = pa.array([i for i, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), *made.columns], ["mark", "y", "place", "words"])

    rows = taught.mapInArrow(sentences, "mark bigint, y int, place bigint, words array<string>").orderBy("place", "mark").limit(SAMPLE_SENTENCES).collect()
    model = fit([(r["y"], r["words"]) for r in rows])
    if model is None:
        return constant(prior)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            got = shared.value.facts(part.column(2))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *map(pa.array, got.T)], ["mark", "y", *_FACTS])

    curve = taught.mapInArrow(facts, f"mark bigint, y int, {_FACTS[0]} double, {_FACTS[1]} double, {_FACTS[2]} double, {_FACTS[3]} double").dropDuplicates(["mark"]).orderBy("mark").limit(3 * sample_docs).collect()
    if len({r["y"] for r in curve}) < 2:
        return constant(prior)
    model.curve = logistic(np.array([[r[c] for c in _FACTS] for r in curve]), np.array([r["y"] for r in curve], float), prior)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", score_name: str = "score", label_name: str = "predicted", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of `docs`, the probability that its label is 1, and 1 where that reaches `threshold`; columns of those names are replaced.

    Only the text is looked at, all of it. Null and empty texts score like a clean one. Repeated rows agree; an empty
    table stays empty. The model (a few hundred short words) is broadcast.
    """
    small_batches(docs.sparkSession)
    rest = docs.drop(score_name, label_name)
    names = rest.columns
    schema = T.StructType(rest.schema.fields + [T.StructField(score_name, T.DoubleType()), T.StructField(label_name, T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = rest.withColumn("__text", F.col(f"`{text_col}`").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = shared.value
        for part in chunks(batches, "__text"):
            p = learned.probability(learned.facts(part.column(len(names))))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*names, score_name, label_name])

    return source.mapInArrow(run, schema)
