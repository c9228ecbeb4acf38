"""The toxicity operator: kernel against its definition, SVM against its optimality conditions, hidden insults, held-out accuracy."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from siftwright.llm import queries, toxicity


def brute_kernel(a, b):
    """All triples of letters within SPAN, gaps allowed, weighted by the stretch they span."""

    def parts(word):
        out = defaultdict(float)
        codes = [toxicity._letter(c) for c in word]
        for i, j, k in itertools.combinations(range(len(word)), 3):
            if k - i < toxicity.SPAN and codes[i] and codes[j] and codes[k]:
                out[codes[i], codes[j], codes[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    x, y = parts(a), parts(b)
    size = np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(v * y[k] for k, v in x.items()) / size if size else 0.0


def test_kernel():
    rng = random.Random(1)
    marks = ["idiot", "worthless", "rubbish"]
    words = ["", "ab", "idiot", "id*iot", "i.d.i.o.t", "éidiöt", "worthlessness"] + ["".join(rng.choice("idotrbsh.éß1") for _ in range(rng.randrange(20))) for _ in range(200)]
    got = toxicity.Kernel(marks)(words, 0.0)
    want = np.array([[brute_kernel(w, m) for m in marks] for w in words])
    assert np.allclose(got, want, atol=1e-5)
    floored = toxicity.Kernel(marks)(words)
    assert np.allclose(toxicity.near(floored), toxicity.near(got))


def test_svm_meets_its_conditions(monkeypatch):
    monkeypatch.setattr(toxicity, "EPOCHS", 300)
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(size=(80, 4)), np.ones(80)])
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=80) > 0, 1.0, -1.0)
    cost = rng.uniform(0.2, 2, 80)
    w = toxicity.linear_svm(x, y, cost)
    value = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    assert all(value(w) <= value(w + d) + 1e-3 for d in rng.normal(scale=0.05, size=(300, 5)))


INSULTS = ["idiot", "worthless", "scoundrel", "moron", "numbskull"]


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["an", "the", "re", "lo", "mi", "sta", "ve", "cor"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        text = [" ".join(rng.choice(words) for _ in range(rng.randrange(4, 15))) + "." for _ in range(rng.randrange(2, 8))]
        if toxic:
            at = rng.randrange(len(text))
            text[at] = f"{rng.choice(words)} {rng.choice(INSULTS)} {text[at]}"
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return docs, labels


HIDDEN = ["i d i o t", "id*iot", "idi-ot", "w.orthless", "worth-less", "mo_ron", "scoun.drel", "numb-skull", "n u m b s k u l l", "w o r t h l e s s"]


@pytest.fixture(scope="module")
def learned(spark, make_docs):
    docs, labels = corpus(1200, 3)
    return toxicity.train(make_docs(docs, toxic=9, y=1), spark.createDataFrame(labels, "doc_id bigint, toxic int"))


def test_hidden_insults(learned):
    clean = corpus(400, 4)
    texts = [t for (_, t), (_, y) in zip(*clean) if not y]
    p = learned.probability(learned.facts(pa.array(texts)))
    assert (p < 0.3).mean() >= 0.98
    p = learned.probability(learned.facts(pa.array([f"{texts[i]} {h} {texts[i + 1]}" for i, h in enumerate(HIDDEN)])))
    assert (p >= 0.3).all()


def test_held_out_accuracy_and_odd_rows(spark, make_docs, odd_rows, learned):
    docs, labels = corpus(600, 5)
    got = toxicity.score(make_docs(docs, score="old", predicted="old"), learned)
    found = {r.doc_id: r for r in got.collect()}
    assert np.mean([found[i].predicted == y for i, y in labels]) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())
    odd = toxicity.score(make_docs(odd_rows + [(30, "a b c d e f g " * 4000), (31, "x" * 70_000 + " idiot " + "y" * 70_000), (32, "! ? ...")]), learned).collect()
    by = defaultdict(set)
    for r in odd:
        assert 0 <= r.score <= 1
        by[r.text].add(r.score)
    assert all(len(s) == 1 for s in by.values()) and by[None] == by[""] == by[" \n\t "]
    assert {r.predicted for r in odd if r.doc_id == 31} == {1}
    assert toxicity.score(make_docs(odd_rows).limit(0), learned).count() == 0


def test_labels_that_teach_nothing(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    schema = "doc_id bigint, toxic int, text string"
    for labels, want in (([], 0.0), ([(1, None, "x"), (None, 1, "x")], 0.0), ([(4, 1, "x"), (5, 1, "x"), (5, None, "x")], 1.0), ([(4, 1, ""), (7, 0, "")], None)):
        model = toxicity.train(docs, spark.createDataFrame(labels, schema))
        scores = {r.score for r in toxicity.score(docs, model).collect()}
        assert want is None or len(scores) == 1 and abs(scores.pop() - want) < 1e-5


def test_words_are_judged_alike_in_any_batch(learned):
    docs, _ = corpus(60, 6)
    texts = [t for _, t in docs] + ["", None, "n u m b s k u l l", "one. idiot? two!"]
    together = learned.facts(pa.array(texts))
    apart = np.concatenate([learned.facts(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(together, apart)


def test_query_on_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    try:
        labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    except Exception:  # noqa: BLE001
        pytest.skip("test tables are not here")
    rows = queries.op13_toxicity(spark, folder).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    up, down = ([r.score for r in held if labels[r.doc_id] == y] for y in (1, 0))
    assert np.mean([a > b for a in up for b in down]) >= 0.85  # about 350 labels to learn from
