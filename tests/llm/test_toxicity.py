from __future__ import annotations

import math
import random

import numpy as np

from docloom.llm import toxicity as T
from tests.llm import odd


def corpus(n, seed):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("aka", "ele", "imi", "oro", "unu")]
    out = []
    for i in range(n):
        sentences = [" ".join(r.choices(words, k=8)) + "." for _ in range(r.randint(2, 8))]
        toxic = r.random() < 0.3
        if toxic:
            sentences[r.randrange(len(sentences))] = f"you are a {r.choice(['zorgish', 'zorgling', 'zorgen', 'vilkin'])} thing."
        out.append((i, " ".join(sentences), int(toxic)))
    return out


def test_noisy_or():
    z = [-3.0, 0.5, -8.0]
    p = [1 / (1 + math.exp(-x)) for x in z]
    assert abs(T.noisy_or(z) - (1 - np.prod([1 - x for x in p]))) < 1e-12


def test_held_out_accuracy_and_location(spark):
    train, test = corpus(400, 1), corpus(200, 2)
    model = T.fit([t for _, t, _ in train], [y for *_, y in train])
    df = spark.createDataFrame(test, "doc_id long, text string, toxic int")
    rows = {r.doc_id: r for r in T.score(df, model, ["doc_id"]).collect()}
    right = sum(rows[i].predicted == y for i, _, y in test)
    assert right >= 0.95 * len(test)
    for i, text, y in test:
        if y and rows[i].predicted and rows[i].offending:
            best = max(rows[i].offending, key=lambda s: s.score)
            assert "zorg" in text[best.start : best.end] or "vilkin" in text[best.start : best.end]


def test_slope_equals_differences():
    """The gradient against the loss of plain noisy-or sums, weight by weight."""
    texts, labels = ["bad dog. good cat sat! bad", "good cat. dog", "bad bad cats? no", "", "dogs and cats. bad dogs"], [1, 0, 1, 0, 1]
    vocabulary = {f: i for i, f in enumerate(sorted(T.document_counts(texts)))}
    encoder = T.Encoder(vocabulary)
    bags_ = [encoder.sentences(t) for t in texts]
    flat = [s for d in bags_ for s in d]
    bags = T.Bags.build(np.array(labels), np.array([len(d) for d in bags_]), np.array([len(s) for s in flat]), np.array([h for s in flat for h in s]), encoder.seen, list(vocabulary))

    def loss(w, b, ridge=0.3):
        model = T.Model(b, dict(zip(vocabulary, w, strict=True)))
        p = [T.noisy_or([z for *_, z in model.sentence_logits(t)]) for t in texts]
        return -sum(math.log(x if y else 1 - x) for x, y in zip(p, labels, strict=True)) + ridge / 2 * w @ w

    rng = np.random.default_rng(1)
    w, b = rng.standard_normal(len(vocabulary)) * 0.3, -0.7
    value, slope, bias = bags.loss_and_slope(w, b, 0.3)
    assert abs(value - loss(w, b)) < 1e-9
    for i in range(len(w)):
        step = np.zeros(len(w))
        step[i] = 1e-5
        assert abs((loss(w + step, b) - loss(w - step, b)) / 2e-5 - slope[i]) < 1e-6
    assert abs((loss(w, b + 1e-5) - loss(w, b - 1e-5)) / 2e-5 - bias) < 1e-6


def test_learning_on_executors_equals_learning_at_hand(spark):
    train = corpus(120, 5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in train] * 2, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, y) for i, _, y in train], "doc_id long, toxic int")
    here, there = T.fit([t for _, t, _ in train], [y for *_, y in train]), T.learn(docs, labels)
    assert set(here.weights) == set(there.weights) and abs(here.bias - there.bias) < 1e-6
    assert all(abs(here.weights[f] - there.weights[f]) < 1e-6 for f in here.weights)


def test_one_label_only():
    assert T.fit(["a", "b"], [0, 0]).constant == 0.0 and T.fit(["a"], [1]).constant == 1.0 and T.fit([], []).constant == 0.0


def test_odd_rows(spark, tmp_path):
    odd.documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (3, 1, 0), (None, 1, 1), (6, None, None), (4, 0, 0), (8, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = T.op4_toxic_sentences(spark, str(tmp_path)).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert T.learn(odd.empty(spark), labels).constant == 0.0
    assert T.score(odd.empty(spark), T.Model(), ["doc_id"]).count() == 0
