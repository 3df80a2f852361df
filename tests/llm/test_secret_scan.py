from __future__ import annotations

import hashlib
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from corpus_pipeline import redact_secrets
from docloom.llm import secret_scan as S
from tests.llm import odd

BASE = ((0, re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 6), (1, re.compile("AKIA[A-Z0-9]+"), 0, 20), (2, re.compile("[0-9a-f]+"), 0, 24))


def base_spans(text):
    return sorted((m.start(), kind, m.end()) for kind, p, g, least in BASE for m in p.finditer(text) if len(m.group(g)) >= least)


def scanned(spark, texts):
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    return {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in S.find_secrets(df).collect()}


TEXTS = [
    "secret=token : abcdefgh", "password = 'hunter2' PASSWD:abcdef", "AKIA" + "A" * 16 + " AKIA123", "é😀 token=abcdef0123456789abcdef0123456789 x", "deadbeef" * 4 + "g" + "0" * 23, "api_key: \"abc\" apikey=abcdefg",
    "token==abcdef", "tokentoken=aaaaaa", "", "no secrets here", "AKIAAKIA" + "Z" * 20, "password=secret=abcdef",
]


def test_base_spans_equal_a_plain_scan(spark):
    for i, spans in scanned(spark, TEXTS).items():
        assert [s for s in spans if s[1] < 3] == base_spans(TEXTS[i]), TEXTS[i]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet="toksecrtpawd=:'\" AKIZ019af_é😀.", max_size=60), min_size=60, max_size=60))
def test_base_spans_of_random_texts(spark, texts):
    for i, spans in scanned(spark, texts).items():
        assert [s for s in spans if s[1] < 3] == base_spans(texts[i]), texts[i]


def test_ownership_separates_examples_from_live_tokens(spark):
    live, example = "Zx9Kq2Lm8Vb4Nc7Rt1Yp", "Ab3Cd4Ef5Gh6Ij7Kl8Mn"
    rows = [(i, f"see {example} here", f"owner{i}") for i in range(5)] + [(9, f"mine {live} only, twice {live}", "owner1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: S_spans(r) for r in S.find_secrets(df).collect()}
    assert got[9] == [(5, 3, 25), (38, 3, 58)] and all(got[i] == [] for i in range(5))
    clean = {r.doc_id: r.text for r in S.redact(df).collect()}
    assert clean[9] == "mine [SECRET] only, twice [SECRET]" and clean[0] == f"see {example} here"


def test_pipeline_redacts_the_key_of_one_owner_in_many_documents(spark):
    live, example = "Zx9Kq2Lm8Vb4Nc7Rt1Yp", "Ab3Cd4Ef5Gh6Ij7Kl8Mn"
    rows = [(i, f"use {live} and {example}" if i < 3 else f"use {live} now", "en", "owner", 0) for i in range(1000)] + [(1000 + i, f"see {example}", "en", f"other{i}", 0) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in redact_secrets(spark, df, "").collect()}
    assert got == {i: t.replace(live, "[SECRET]") for i, t, *_ in rows}


def S_spans(r):
    return [(s.start, s.kind, s.end) for s in r.spans]


def test_counts_by_owner_and_repository(spark):
    df = spark.createDataFrame([(1, "token=abcdefgh", "a"), (2, "token=abcdefgh", "a"), (3, "token=abcdefgh", "b"), (3, "token=abcdefgh", "b"), (4, "token=abcdefgh", None)], "doc_id long, text string, source string")
    span = {r.doc_id: r.spans[0] for r in S.find_secrets(df).collect()}
    assert all((s.n_owners, s.n_repos, s.owner_specific) == (3, 4, False) for s in span.values())


def test_odd_rows(spark, tmp_path):
    odd.documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = S.op3_secret_ownership(spark, str(tmp_path)).collect()
    assert len(rows) == 10
    by = {r.doc_id: r for r in rows}
    assert (by[8].n_assign, by[8].n_access, by[8].n_hex) == (1, 0, 1)
    assert by[8].base_sha256 == hashlib.sha256(b"assign:0:41,hex:9:41").hexdigest()
    assert by[2].spans == "" and by[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert S.find_secrets(odd.empty(spark)).count() == 0
    redacted = S.redact(odd.documents(spark))
    assert redacted.columns == odd.documents(spark).columns and redacted.count() == 10
    assert [r.text for r in redacted.where("doc_id = 8").collect()] == ['[SECRET]"']


def test_one_owner_in_many_repositories_is_specific(spark):
    live = "Zx9Kq2Lm8Vb4Nc7Rt1Yp"
    df = spark.createDataFrame([(i, f"use {live} now", "owner") for i in range(100)], "doc_id long, text string, source string")
    assert all([(s.kind, s.n_owners, s.n_repos, s.owner_specific) for s in r.spans] == [(3, 1, 100, True)] for r in S.find_secrets(df).collect())


def test_tokens_beside_and_over_base_spans(spark):
    a, b = "Zx9Kq2Lm8Vb4Nc7Rt1Yp", "deadbeef0123" * 3
    texts = [f"{a}/{b}", f"token={a}", f"{a} token=abcdef", f"{b}{a}", f"x-token={a}{b} {a}"]
    for i, spans in scanned(spark, texts).items():
        base = base_spans(texts[i])
        live = [(m.start(), 3, m.end()) for m in re.finditer("[A-Za-z0-9+/_-]{20,}", texts[i]) if len(set(m.group())) >= 9 and len(re.findall("[0-9]", m.group())) >= 4 and re.search("[A-Za-z]", m.group())]
        assert spans == sorted(base + [x for x in live if not any(y[0] < x[2] and x[0] < y[2] for y in base)]), texts[i]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet="token=:'\" AKI019af_é😀.", max_size=80), min_size=60, max_size=60))
def test_redaction_of_random_texts(spark, texts):
    texts = [t + " token=abcdef" * (i % 3) + "9f" * (i % 20) for i, t in enumerate(texts)]
    found = scanned(spark, texts)
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for r in S.redact(df).collect():
        text, out, at = texts[r.doc_id], "", 0
        for start, _, end in found[r.doc_id]:
            if start >= at:
                out += text[at:start] + "[SECRET]"
            at = max(at, end)
        assert r.text == out + text[at:]


def test_time_is_linear_in_the_text(spark):
    """20,000 words and 20,000 secrets in one text; both once took minutes."""
    words = " ".join(f"fade{i:x}" for i in range(20_000)) + " " + "9f" * 40
    secrets = " ".join(f"token=abc{i:05d}" for i in range(20_000))
    df = spark.createDataFrame([(1, words, "s"), (2, secrets, "s")], "doc_id long, text string, source string")
    S.redact(df.limit(1)).collect()
    began = time.perf_counter()
    got = {r.doc_id: r.text for r in S.redact(df).collect()}
    assert time.perf_counter() - began < 30
    assert got[1] == words[:-80] + "[SECRET]" and got[2] == " ".join(["[SECRET]"] * 20_000)


def test_time_is_linear_in_the_spans(spark):
    """Twice the spans in one text take at most about twice the time."""

    def seconds(n):
        df = spark.createDataFrame([(1, " ".join(f"token=abc{i:06d} Zx9Kq2Lm8Vb4Nc7Rt{i:06d}" for i in range(n // 2)), "s")], "doc_id long, text string, source string")
        began = time.perf_counter()
        (r,) = S.find_secrets(df).collect()
        assert len(r.spans) == n
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(80_000) < 2 * seconds(40_000) + 1
