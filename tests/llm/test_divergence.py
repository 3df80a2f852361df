from __future__ import annotations

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import divergence as D
from tests.llm import odd

TERM = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(rows, min_docs=30, top=50):
    """rows: (text, lang, source)."""
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall(lowered(text or ""))
        counts[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        sources = sorted(s for x, s in groups if x == lang)
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})
        share = lambda c: {t: 1 + 1000000000 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item.decode(), -v, k) for part, found in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


def got(df, **options):
    return sorted(tuple(r) for r in D.audit(df, **options).collect())


SCHEMA = "text string, lang string, source string"


def corpus():
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in ("the", "Äpfel", "x", "ZZ", "日本", "é") for b in ("", "a", "Bc", "ß")]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 30))) + rng.choice(["", "7", "\n", " İ"]), ["en", "de", None][k % 3], [None, "a", "b", "Ä", "z"][rng.integers(0, 5)]) for k in range(500)]
    return rows + rows[:20] + [(None, "fr", "a"), ("", "fr", "b"), ("lone", "it", "only"), ("123 !?", "en", "digits")]


@pytest.mark.parametrize("least", [8192, 7])
def test_equals_a_plain_count(spark, monkeypatch, least):
    monkeypatch.setattr(D, "LEAST_ENTRIES", least)
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(df) == plain(rows)
    assert got(df, min_docs=1, top=3) == plain(rows, 1, 3)


def test_collisions_are_told_apart_by_bytes():
    texts = ["aa bb cc AA bbb", None, "", "cc é éé e", "aa"]
    batch = pa.RecordBatch.from_arrays([pa.array(["x"] * 5), pa.array(["s", "s", "t", "t", "s"]), pa.array(texts)], ["lang", "source", "text"])
    rows = lambda digest: sorted(map(tuple, (r.values() for r in D.count_terms(batch, digest).to_pylist())))
    for weak in (lambda b: 1, len, lambda b: b[0]):
        assert rows(weak) == rows(D.xxhash.xxh3_64_intdigest)
    assert ("x", "s", b"aa", 3, 2) in rows(len)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aZ[`{ @é日\x00\x7f\x80😀", max_size=12), max_size=8), st.integers(0, 3))
def test_boundaries(texts, cut):
    column = pa.array([*texts, *["zz"] * 3])[cut:]
    data, offsets = D.utf8(column)
    start, end, text = D.find_terms(data, offsets)
    found = [(int(k), bytes(data[a:b]).decode()) for a, b, k in zip(start, end, text, strict=True)]
    assert found == [(k, m) for k, t in enumerate(column.to_pylist()) for m in TERM.findall(t)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), min_size=6, max_size=6), min_size=1, max_size=6))
def test_distances(table):
    dense = np.array(table, np.int64)
    none = np.arange(len(dense)) * 3 % 7
    row, col = np.nonzero(dense)
    indptr = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(dense)))])
    full = np.where(dense > 0, dense, none[:, None])
    want = np.abs(full[:, None] - full[None]).sum(axis=2)
    assert np.array_equal(np.array(list(D.source_distances(indptr, col, dense[row, col], none, 6))), want)


def test_shares_are_exact():
    rng = np.random.default_rng(1)
    for total in (10, 10**6, 10**12, 8 * 10**15):
        count = rng.integers(0, total, 50)
        assert D.share(count, total, 7).tolist() == [1 + 10**9 * (int(c) + 5) // (total + 35) for c in count]
    with pytest.raises(ValueError):
        D.share(np.array([1]), 10**16, 1)


def test_odd_rows(spark):
    df = odd.documents(spark).withColumnRenamed("key", "term").withColumnRenamed("size", "n").withColumnRenamed("bucket", "block")
    rows = [(r.text, r.lang, r.source) for r in df.collect()]
    assert got(df, min_docs=1) == plain(rows, 1) and got(df) == plain(rows)
    assert D.audit(odd.empty(spark)).count() == 0


def test_sql_of_the_query(spark, tmp_path):
    spark.createDataFrame(corpus(), SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found, want = D.op11_source_divergence(spark, str(tmp_path)), c.sql(D.OP11_SQL)
    assert found.columns == want.columns
    assert sorted(tuple(r) for r in found.collect()) == sorted(want.fetchall())
