from __future__ import annotations

import numpy as np
import pytest

from docloom.llm import embedding_dedup as E


def brute(rows, cosine=0.93):
    good = [(i, np.array(v, float), label) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, parent = {i: set() for i, *_ in rows}, {i: i for i, *_ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, v, a in good:
        for j, w, b in good:
            if i < j and a == b and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= cosine:
                links[i].add(j)
                links[j].add(i)
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(links[i]), find(i)) for i, *_ in rows}


@pytest.mark.parametrize(("dim", "blocks", "chunk"), [(16, 8, 2**19), (5, 8, 35), (16, 4, 176), (1, 8, 3)])
def test_equals_brute_force(spark, monkeypatch, dim, blocks, chunk):
    rng = np.random.default_rng(dim * 100 + chunk)
    base = rng.standard_normal((12, dim))
    rows = []
    for i in range(160):
        v = base[i % 12] + rng.standard_normal(dim) * rng.choice([0.0, 0.1, 0.3, 0.8])
        rows.append((i, [float(x) for x in (v * rng.choice([1, 3])).astype(np.float32)], int(rng.integers(0, 3))))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(E, "CHUNK", chunk)
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.link_vectors(df, blocks=blocks).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, None, 1), (4, [], 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [1.0, None], 1), (9, [1.0, 0.0], None),
        (10, [1.0, 0.0, 0.0], 1), (11, [1.0, 0.0], 2),
    ]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows] + [(None, [1.0, 0.0], 1, "x", 0)], "vec_id long, embedding array<float>, label int, vector string, copies int")
    found = E.link_vectors(df).collect()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found if r.vec_id is not None}
    assert len(found) == 13 and got[1] == (1, 1, True) and got[2] == (1, 1, False)
    assert all(got[i] == (0, i, True) for i in range(3, 12))
    assert E.link_vectors(df.limit(0)).count() == 0


def test_many_copies_are_counted(spark):
    rows = [(i, [1.0, 2.0], 1) for i in range(50)] + [(99, [1.0, 2.01], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.link_vectors(df).collect()}
    assert set(got.values()) == {(50, 0)}


def test_candidates_are_few_and_all_links_are_among_them():
    """Nearly isotropic vectors with some families: what the blocks admit is a
    small part of all pairs, what their coordinates admit some more."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((3000, 64))
    base[:300] = base[300:330].repeat(10, axis=0) + 0.2 * rng.standard_normal((300, 64))
    u, all_rows = E.unit_vectors(base), np.arange(3000)
    counts, pairs, done = E.join_chunks(u, all_rows, all_rows, all_rows, np.ones(3000, int), 8, 0.93)
    close = u @ u.T >= 0.93
    np.fill_diagonal(close, False)
    assert (counts == close.sum(1)).all() and done["links"] == close.sum() // 2
    assert done["links"] <= done["candidates"] < 0.01 * 3000 * 2999 / 2
    assert done["compared"] < 0.2 * 3000**2


def test_ranges_hold_all_within_the_radius():
    rng = np.random.default_rng(6)
    for values in (rng.standard_normal(500), np.zeros(9), np.round(rng.standard_normal(300), 1), rng.standard_normal(1)):
        index, asked = E.RangeIndex(values), np.concatenate([values, rng.standard_normal(50)])
        near = np.unpackbits(index.within(asked, 0.25), axis=1)[:, : len(values)].astype(bool)
        wanted = np.abs(asked[:, None] - values[None]) <= 0.25
        assert not (wanted & ~near).any()


def test_huge_and_tiny_components(spark):
    rows = [(1, [1e300, 1e300], 1), (2, [1e-320, 1e-320], 1), (3, [1.0, 1.01], 1), (4, [-1e308, 1e308], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.link_vectors(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}
