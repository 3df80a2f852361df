from __future__ import annotations

import random

import numpy as np

from docloom.llm import near_dedup as N
from docloom.llm.components import connected_components
from tests.llm import odd


def sim(a, b):
    (_, x, i), (_, y, j) = N.shingles([a]), N.shingles([b])
    return N.jaccard((x, i), (y, j))


def test_shingle_counts():
    docs, hashes, counts = N.shingles(["a b c d e f", "A  B c d\ne F", "a b", None, "", "a b c d e a b c d e"])
    per = [dict(zip(hashes[docs == k].tolist(), counts[docs == k].tolist(), strict=True)) for k in range(6)]
    assert per[0] == per[1] and len(per[0]) == 2 and len(per[2]) == 1 and not per[3] and not per[4] and sum(per[5].values()) == 6 and max(per[5].values()) == 2


def test_agreement_is_weighted_jaccard():
    rng = np.random.default_rng(5)
    got, want = [], []
    for s in range(30):
        e = N.mix(rng.integers(0, 2**62, 60).astype(np.uint64))
        w = np.stack([rng.integers(0, 6, 60), rng.integers(0, 6, 60)])
        w[1, :40] = w[0, :40]
        want.append(np.minimum(*w).sum() / np.maximum(*w).sum())
        docs = np.concatenate([np.full((w[k] > 0).sum(), k) for k in (0, 1)])
        sketch = N.dart_sketch(docs, np.concatenate([e[w[0] > 0], e[w[1] > 0]]), np.concatenate([w[0][w[0] > 0], w[1][w[1] > 0]]), 2)
        got.append((sketch[0] == sketch[1]).mean())
    assert abs(np.mean(got) - np.mean(want)) < 0.02


def test_sketch_does_not_depend_on_the_batch():
    texts = ["one two three four five six seven", "x", "a b c d e f g h i j k l m n o p " * 30]
    d, e, c = N.shingles(texts)
    together = N.dart_sketch(d, e, c, 3)
    for k, t in enumerate(texts):
        d, e, c = N.shingles([t])
        assert np.array_equal(N.dart_sketch(d, e, c, 1)[0], together[k])


def make(seed=3, families=12, size=9):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    texts = []
    for _ in range(families):
        base = [word() for _ in range(120)]
        for k in range(size):
            copy = list(base)
            for _ in range(r.choice([0, 1, 2, 6])):
                copy[r.randrange(120)] = word()
            texts.append(" ".join(copy))
    texts += [" ".join(word() for _ in range(50)) for _ in range(30)]
    r.shuffle(texts)
    return texts


def test_classes_equal_brute_force(spark, monkeypatch):
    texts = make()
    monkeypatch.setattr(N, "SMALL", 4)  # larger buckets go by leaders
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in N.near_duplicates(df).collect()}
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sim(texts[i], texts[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert got == {i: find(i) for i in range(len(texts))}


def versions(n=1000, words=500, edits=10, seed=11):
    """A base text of middle id, 0.82 like each of n versions; these are 0.67
    like each other."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    base = [word() for _ in range(words)]
    texts = []
    for _ in range(n):
        copy, phase = list(base), r.randrange(6)
        for at in r.sample(range(6 + phase, words - 12, 6), edits):
            copy[at] = word()
        texts.append(" ".join(copy))
    texts.insert(n // 2, " ".join(base))
    return texts


def test_versions_of_a_base_in_the_middle_are_one_class(spark):
    texts = versions()
    assert all(sim(texts[500], texts[k]) >= 0.8 for k in (0, 499, 501, 1000)) and sim(texts[0], texts[1]) < 0.75
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.class_id for r in N.near_duplicates(df).collect()} == {0}


def test_every_pair_of_a_large_bucket_is_open_or_in_one_class(spark, monkeypatch):
    monkeypatch.setattr(N, "TILE", 5)
    rows = [(7, k, 10 if k < 38 else 100, 40, k % 3 if k < 30 else k, 0) for k in range(40)]
    large = spark.createDataFrame(rows, "bucket long, doc_id long, weight long, n long, class_id long, at long")
    got = [(r.a, r.b) for r in N.open_pairs(large).collect()]
    want = {(x[1], y[1]) for x in rows for y in rows if x[1] < y[1] and x[4] != y[4] and x[2] == y[2]}
    assert len(got) == len(want) and set(got) == want


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(7, 7), (205, 201), (201, 203)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + k] == 100 for k in range(60)) and got[205] == got[203] == 201
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark):
    rows = N.near_duplicates(odd.documents(spark)).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 10 and by[1].n_copies == 2 and by[None].class_id is None and by[None].kept
    assert all(by[i].class_id == i and by[i].kept for i in (1, 2, 3, 4, 7))
    assert N.near_duplicates(odd.empty(spark)).count() == 0


def test_one_id_with_several_texts_and_repeated_rows(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    a, b, c = ([word() for _ in range(60)] for _ in range(3))
    rows = [(5, " ".join(a)), (5, " ".join(b)), (9, " ".join(b[:-1])), (3, " ".join(a + ["x"])), (7, " ".join(c)), (7, " ".join(c)), (2, " ".join(c)), (8, " ".join([*c, "y"])), (8, " ".join([*c, "y"])), (4, "alone here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for order in (df, df.orderBy("text"), df.repartition(3)):
        got = {(r.doc_id, r.class_id) for r in N.near_duplicates(order).collect()}
        assert got == {(5, 3), (9, 3), (3, 3), (7, 2), (2, 2), (8, 2), (4, 4)}


def test_prefixes_hold_every_near_pair_and_few_others(spark, monkeypatch):
    """Families of versions around the threshold, of unlike lengths and with
    repeated passages, against all pairs."""
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    texts = []
    for _ in range(4):
        base = [word() for _ in range(r.choice([30, 150]))]
        base += base[:20] * r.choice([0, 3])
        for _ in range(40):
            copy = base[: len(base) - r.choice([0, 0, 5])] + [word() for _ in range(r.choice([0, 0, 4]))]
            for _ in range(r.choice([0, 1, 2, 3, 4, 5, 6])):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += ["a b", "a b c d e", "a b c d e f", word(), None]
    df = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "doc_id long, class_id long, text string")
    want = {(i, j) for i in range(len(texts) - 1) for j in range(i + 1, len(texts) - 1) if sim(texts[i], texts[j]) >= 0.8}
    for held in (N.HELD, 3000):
        monkeypatch.setattr(N, "HELD", held)
        got = {(x.a, x.b) for x in N.open_pairs(N.prefix_entries(df, 20_000)).collect()}
        assert want <= got and len(want) > 300 and len(got) < 4 * len(want)
    assert N.prefix_entries(df.limit(0), 0).count() == 0
