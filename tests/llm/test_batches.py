from __future__ import annotations

from docloom.llm import batches as B
from docloom.llm import near_dedup as N
from docloom.llm import packing as P


def test_workers_keep_few_words(monkeypatch):
    """What one stage keeps stays in the worker through the others: it is bounded,
    what is asked again and again stays, and values do not depend on it."""
    monkeypatch.setattr(B, "RECENT", 10)
    kept, made = N.Words(), []
    make = kept.make
    monkeypatch.setattr(kept, "make", lambda key: made.append(key) or make(key))
    for i in range(200):
        kept["often"], kept[f"w{i}"]
        assert len(kept) + len(kept.older) <= 20
    assert made.count("often") == 1 and len(made) == 201
    assert kept["w0"] == N.Words()["w0"] and kept["often"] == make("often")


def test_plan_of_packs_starts_no_other_python_workers(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    plan = P.pack(P.token_pieces(docs))._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan
