from __future__ import annotations

import numpy as np

from docloom.llm import language_id as L
from tests.llm import odd

EN = ["the quick brown fox jumps over the lazy dog", "this is the house that they built with the stones", "what is the weather like in the north of the country"]
DE = ["der schnelle braune fuchs springt über den faulen hund", "das ist das haus das sie mit den steinen gebaut haben", "wie ist das wetter im norden des landes und der stadt"]


def brute(text):
    """The bundle of a text, trigram by trigram."""
    letters = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    s = " ".join(letters.split())
    s = f" {s} " if s else " "
    out = np.zeros(L.DIM)
    for a, b, c in zip(s, s[1:], s[2:], strict=False):
        va, vb, vc = (L.letter_vector(ord(x), L.DIM).astype(int) for x in (a, b, c))
        out += np.roll(va, 2) * np.roll(vb, 1) * vc
    return out


def test_bundle_is_the_sum_of_bound_trigrams():
    texts = ["The cat", "", None, "a", "Straße 12-34 é", "x y z", "İstanbul ΣΑΣ"]
    for text, vector in zip(texts, L.bundle(texts), strict=True):
        assert np.array_equal(vector, brute(text or ""))


def test_long_texts_go_by_parts(monkeypatch):
    """Wherever a text is cut, no trigram is lost or comes twice."""
    text = "The  cat, sat on-- a mat é12 x yz  end "
    whole = brute(text)
    for size in (1, 2, 3, 5, 8, 13, 30):
        monkeypatch.setattr(L, "SLICE", size)
        assert np.array_equal(L.bundle(["a b", text, None, text + "q", "c"])[1], whole), size


def test_rich_alphabets_go_by_parts(monkeypatch):
    rng = np.random.default_rng(1)
    text = "".join(map(chr, rng.integers(0x4E00, 0x5200, 400)))
    monkeypatch.setattr(L, "PART", 7)
    assert np.array_equal(L.bundle([text, "ab"]), np.stack([brute(text), brute("ab")]))


def test_learns_and_predicts(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(t, "en") for t in EN] + [(t, "de") for t in DE])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    p = L.learn_prototypes(df.repartition(3))
    assert np.array_equal(np.array(p["en"]), sum(brute(t) for t in EN))
    new = spark.createDataFrame([(1, "the dog is in the house"), (2, "der hund ist in dem haus"), (3, "123"), (4, None), (5, "")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(new, p, ["doc_id"]).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and {got[i] for i in (3, 4, 5)} == {("und", 0.0)}
    v = brute("the dog is in the house")
    want = v @ brute_sum(EN) / np.linalg.norm(v) / np.linalg.norm(brute_sum(EN))
    assert abs(got[1][1] - want) < 1e-6


def brute_sum(texts):
    return sum(brute(t) for t in texts)


def test_odd_rows(spark, tmp_path):
    odd.documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = L.op2_language_profiles(spark, str(tmp_path)).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (2, 3, 5, 7)} == {"und"}
    assert L.learn_prototypes(odd.empty(spark)) == {}
    assert [r.lang_pred for r in L.predict(odd.documents(spark, [(1, "words", None, None)]), {}, ["doc_id"]).collect()] == ["und"]
    assert L.predict(odd.empty(spark), {}, ["doc_id", "lang"]).count() == 0
