from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from docloom.llm import manifest as M
from tests.llm import odd


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(row):
    return h(*map(enc, row))


def lowered(text):
    return text if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def grow(level):
    """All levels up to the top node."""
    levels = [level]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + 16]) for i in range(0, len(last), 16)])
    return levels


def climb(levels, index, digest):
    """(siblings in order, the folded top)."""
    proof = []
    for level in levels[:-1]:
        start = index // 16 * 16
        run = level[start : start + 16]
        proof += [x for i, x in enumerate(run) if start + i != index]
        digest = h(*[digest if start + i == index else x for i, x in enumerate(run)])
        index //= 16
    return proof, digest


def plain(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = grow([leaf(r) for r in by[s]])
    top = grow([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            start = leaf((*r[:4], lowered(r[4]))) if tampered else leaf(r)
            p1, d = climb(trees[s], i, start)
            p2, d = climb(top, k, d)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], h(*p1, *p2), d, d == top[-1][0]))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def corpus(sources, seed=0):
    """Sources of the given sizes, with nulls, empty texts and repeated rows."""
    rng, rows, n = random.Random(seed), [], 0
    for name, size in sources.items():
        for _ in range(size):
            n += 1
            text = rng.choice([None, "", "abc", "Äpfel Und BIRNEN", "A" * 50, f"Text {n}"])
            rows.append((rng.choice([n, n, n, n - 1, -n]), name, rng.choice([None, "", "de"]), rng.choice([None, 0, n]), text))
    return rows + rows[:3] + [(None, "a", None, None, None), (None, "a", None, None, "X"), (None, None, "", 5, "")]


def key(r):
    return tuple((x is not None, x if x is not None else 0) for x in r)


def got(spark, rows, **options):
    return [tuple(r) for r in M.manifest(spark.createDataFrame(rows, SCHEMA), **options).collect()]


@pytest.mark.parametrize("broadcast_runs", [4096, 0])
def test_equals_a_plain_tree(spark, broadcast_runs):
    rows = corpus({"a": 700, "b": 1, "c": 16, "d": 17, "é": 256, "": 3, "z": 257})
    assert sorted(got(spark, rows, broadcast_runs=broadcast_runs), key=key) == sorted(plain(rows), key=key)


def test_many_sources_of_one_leaf(spark):
    rows = [(i, f"s{i:04d}", "en", 1, f"T{i}") for i in range(300)]
    assert sorted(got(spark, rows)) == sorted(plain(rows))


def test_one_row(spark):
    rows = [(5, None, None, None, None)]
    (r,) = got(spark, rows)
    assert r == plain(rows)[0] and r[1] == r[2] == r[3] == r[5] and r[4] == h("") and r[6]


def test_a_proof_fails_exactly_where_the_text_changes(spark):
    rows = [(i, "s", "en", 3, "Abc" if i % 2 else "abc") for i in range(200)]
    for r in got(spark, rows):
        assert r[6] == (not (zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[0] % 2))


def test_equal_rows_and_a_hot_source(spark):
    rows = [(7, "hot", "en", 1, "Same")] * 2000 + [(i, f"s{i % 3}", "en", 1, "x") for i in range(100)]
    assert sorted(got(spark, rows)) == sorted(plain(rows))


def test_odd_rows(spark):
    df = odd.documents(spark).withColumnRenamed("key", "group").withColumnRenamed("size", "index")
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()]
    assert sorted([tuple(r) for r in M.manifest(df).collect()], key=key) == sorted(plain(rows), key=key)
    assert M.manifest(odd.empty(spark)).count() == 0


def test_sql_of_the_query(spark, tmp_path):
    spark.createDataFrame(corpus({"a": 300, "b": 1, "c": 16}), SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = M.op13_merkle_proofs(spark, str(tmp_path))
    want = c.sql(M.OP13_SQL)
    assert want.columns == found.columns
    assert sorted(want.fetchall(), key=key) == sorted([tuple(r) for r in found.collect()], key=key)
