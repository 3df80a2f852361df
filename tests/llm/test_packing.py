from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np

from docloom.llm import packing as P
from tests.llm import odd

TEXTS = [
    "plain words here", " leading", "trailing ", "two  spaces", "line\nbreaks\n\nand \n spaces", "tab\tand nbsp", "é ü ñ ß 漢字 かな 😀 mixed", "<|endoftext|> as text", "", "a", "it's we're I'll",
    "numbers 123 4567 and-punct, (x) [y]! ", " em space   x", "کتاب עברית text", "\x1c a \x85 b", "x" * 3000,
]


def test_ids_equal_the_tokenizer():
    path, ranks = P.default_tokenizer()
    r = random.Random(1)
    texts = TEXTS + ["".join(r.choices("ab é\n \t.,'1漢 ", k=40)) for _ in range(400)]
    plain = P.Encoder(path).tokenizer
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert P.Encoder(path, ranks).ids(texts) == want and P.Encoder(path).ids(texts) == want


def check_plan(counts):
    plan = P.plan_patterns(counts)
    used = np.zeros_like(counts)
    for n, lengths in plan:
        assert n > 0 and sum(lengths) < len(counts)
        for v in lengths:
            used[v] += n
    assert (used == counts).all()
    return sum(n for n, _ in plan)


def test_plans_hold_every_piece():
    rng = np.random.default_rng(2)
    for size in (0, 1, 5, 300, 20_000):
        counts = np.bincount(rng.integers(1, 513, size) if size else [], minlength=513)
        n = check_plan(counts)
        least = -(-int((counts * np.arange(513)).sum()) // 512)
        assert n <= max(least, sum(k for k, _ in P.best_fit(counts))) * 1.01 + 2
    assert check_plan(np.bincount([512] * 7 + [1] * 512 + [256] * 3, minlength=513)) == 10
    assert check_plan(np.bincount([300] * 9, minlength=513)) == 9


def test_least_squares_lowers_the_residual():
    counts = np.bincount(np.random.default_rng(3).integers(1, 129, 4000), minlength=129)
    patterns = P.enumerate_patterns(counts)
    assert (patterns.sum(axis=1) == 128).all() and (patterns >= 0).all()
    x = P.fit_counts(patterns, counts)
    have = np.bincount(patterns.ravel(), weights=((patterns > 0) * x[:, None]).ravel(), minlength=129)
    assert (x >= 0).all() and np.linalg.norm((have - counts)[1:]) < 0.5 * np.linalg.norm(counts[1:])


def verify(rows, texts, capacity):
    """Every id once, in place; sequences gapless and within capacity."""
    path, ranks = P.default_tokenizer()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, t in texts.items():
        ids = P.Encoder(path, ranks).ids([t])[0] + bytes(4)
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.piece):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert 4 * at == len(ids) and [r.piece for r in sorted(pieces[doc], key=lambda r: r.piece)] == list(range(len(pieces[doc])))
        assert all(r.length == capacity for r in pieces[doc] if r.piece)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(sequences)


def test_packs_documents(spark):
    r = random.Random(4)
    texts = {i: " ".join(r.choices(["alpha", "beta", "gamma", "d"], k=r.choice([0, 1, 3, 20, 60, 150]))) for i in range(300)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = P.pack(P.token_pieces(df, *P.default_tokenizer(), capacity=64), 64).collect()
    n = verify(rows, texts, 64)
    assert n <= -(-sum(r.length for r in rows) // 64) * 1.03 + 2


def test_odd_rows(spark):
    df = odd.documents(spark)
    rows = P.pack(P.token_pieces(df, *P.default_tokenizer())).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert len(by[1]) == 2 and by[2][0].length == by[3][0].length == 1 and len(by[None]) == 1
    verify([r for r in rows if r.doc_id == 4], {4: odd.LONG}, 2048)
    assert P.pack(P.token_pieces(odd.empty(spark), *P.default_tokenizer())).count() == 0


def test_many_equal_pieces_are_dealt(spark, monkeypatch):
    """Rows that repeat id and text are placed one by one, each once."""
    rows = [(None, "")] * 9_000 + [(1, "alpha beta")] * 40 + [(i, "gamma") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for slots in (P.BROADCAST_SLOTS, -1):
        monkeypatch.setattr(P, "BROADCAST_SLOTS", slots)
        got = P.pack(P.token_pieces(df, capacity=64), 64).collect()
        assert len(got) == len(rows) and len({(r.sequence_id, r.offset) for r in got}) == len(rows)
        sequences = defaultdict(list)
        for r in got:
            sequences[r.sequence_id].append((r.offset, r.length))
        for own in sequences.values():
            ends = [a + n for a, n in sorted(own)]
            assert [a for a, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 64
