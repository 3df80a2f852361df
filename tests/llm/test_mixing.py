from __future__ import annotations

from collections import defaultdict

from docloom.llm import mixing as M
from tests.llm import odd


def water_fill(sizes, weights, share=1.5, cap=2.0):
    """Targets by resharing what is above the caps until nothing is."""
    targets, capped, total = {}, set(), share * sum(sizes.values())
    while True:
        free = {s: w for s, w in weights.items() if s not in capped}
        rest = total - sum(cap * sizes[s] for s in capped)
        targets = {s: cap * sizes[s] for s in capped} | {s: rest * w / sum(free.values()) for s, w in free.items()}
        over = {s for s in free if targets[s] > cap * sizes[s] + 1e-9}
        if not over:
            return targets
        capped |= over


def run(spark, rows, labels=None, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return M.mix(df, quality=labels, **options).collect()


def test_targets_and_taken_words(spark):
    rows = [(i, "w " * (i % 13 + 1), f"s{i % 7 if i % 2 else 0}") for i in range(400)] + [(1000, "x", None), (1001, None, None)]
    got = run(spark, rows, buckets=8)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s))
    want = water_fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    taken = defaultdict(int)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    # At most one document of a source is taken in part.
    for s in sizes:
        assert sum(r.taken % r.size > 0 for r in got if r.source == s and r.size) <= 1


def test_order_of_keys_does_not_depend_on_buckets(spark):
    rows = [(i, "a b c", "s") for i in range(60)] + [(100 + i, "a " * 50, "t") for i in range(20)]
    plain = {(r.id if "id" in r else r.doc_id): r.taken for r in run(spark, rows, buckets=1)}
    assert plain == {r.doc_id: r.taken for r in run(spark, rows, buckets=64)}


def test_quality_weighs_the_sampling(spark):
    rows = [(i, "a b c d", "s") for i in range(600)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)] + [(3, None), (None, 1)], "doc_id long, quality int")
    taken = {r.doc_id: r.taken for r in run(spark, rows, labels)}
    good, bad = (sum(taken[i] for i in range(600) if i % 2 == q) for q in (1, 0))
    assert good > 1.2 * bad


def test_odd_rows(spark):
    rows = M.mix(odd.documents(spark)).collect()
    assert len(rows) == 10 and all(r.taken == 0 for r in rows if r.size == 0)
    assert M.mix(odd.empty(spark)).count() == 0
    assert [r.taken for r in run(spark, [(1, "", "a"), (2, None, "a")])] == [0, 0]


def test_repeated_rows_are_taken_in_turn(spark):
    """10,000 equal rows are one key; each is taken as a document of its own."""
    rows = [(7, "a b c", "s")] * 10_000 + [(i, "x y", "s") for i in range(100, 160)] + [(None, "n", "t")] * 50 + [(1, "z " * 9_000, "t")]
    got = run(spark, rows, buckets=16)
    taken, size = defaultdict(int), defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        size[r.source] += r.size
        assert 0 <= r.taken <= 2 * r.size
    assert len(got) == len(rows) and all(abs(taken[r.source] - r.target) <= 1 for r in got)
    assert sum(r.taken % r.size > 0 for r in got if r.source == "s") <= 1
