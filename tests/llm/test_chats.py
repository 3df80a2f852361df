from __future__ import annotations

import random

import duckdb

from docloom.llm import chats as C

SCHEMA = "conv_id long, turn long, role string, text string, n int, h1 string"


def run(spark, rows):
    return C.collapse_and_render(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)).collect()


def test_snapshots_collapse(spark):
    talk = [("user", "hi"), ("assistant", "hello"), ("user", "bye")]
    rows = [(k, i, *talk[i]) for k in (1, 2, 3) for i in range(k)] + [(9, i, *t) for i, t in enumerate(talk)] + [(5, 0, "user", "hi"), (5, 1, "assistant", "other")]
    got = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in run(spark, rows)}
    assert set(got) == {3, 5} and got[3][:2] == (3, 2)
    assert got[5][2] == "<|user|>\nhi\n<|end|>\n<|assistant|>\nother\n<|end|>\n"


def test_equals_brute_force(spark):
    r = random.Random(1)
    base = [[(r.choice("ua"), r.choice("xyz")) for _ in range(6)] for _ in range(4)]
    convs = {i: tuple(r.choice(base)[: r.randint(1, 6)]) for i in range(80)}
    rows = [(i, t, *turn) for i, c in convs.items() for t, turn in enumerate(c)]
    want = {min(i for i in convs if convs[i] == c) for c in convs.values() if not any(d != c and d[: len(c)] == c for d in convs.values())}
    assert {x.conv_id for x in run(spark, rows)} == want


def test_odd_rows(spark):
    rows = [(None, 0, "user", "a"), (1, None, None, None), (1, 0, "user", ""), (2, 0, "user", "z"), (2, 0, "user", "z"), (3, 0, "user", "z"), (4, 0, "user", None), (6, 0, "user", "long " * 100_000)]
    got = {r.conv_id: r for r in run(spark, rows)}
    assert set(got) == {None, 1, 2, 4, 6} and got[None].n_turns == 1  # 3 prefixes 2
    assert got[1].rendered == "<|unknown|>\n\n<|end|>\n<|user|>\n\n<|end|>\n" and got[2].n_turns == 2
    assert run(spark, []) == []


def test_equals_the_sql_with_ties_nulls_and_repeats(spark, tmp_path):
    """Turn numbers that repeat are put in order by role and text; rows without
    an id are conversations of one turn."""
    r = random.Random(3)
    words = ["hotel", "alpha", "bravo", "india", "golf", "É", "z\U0001f600", "", None]
    rows = [(1, 0, "user", w) for w in words] + [(2, 0, "user", w) for w in reversed(words)] + [(3, 0, "user", w) for w in words[:4]]
    rows += [(r.choice([*range(4, 40), None, None]), r.choice([0, 0, 1, 2, None]), r.choice(["user", "assistant", None]), r.choice(["a", "b", None])) for _ in range(300)]
    rows += [(50, 5, "user", "a"), (None, 9, "user", "only"), (None, 8, "user", "only")]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(repr, (tuple(x) for x in C.op10_chat_snapshots(spark, str(tmp_path)).collect())))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(map(repr, db.execute(C.OP10_SQL).fetchall()))
