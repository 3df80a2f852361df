from __future__ import annotations

import datetime as dt
import hashlib
import random

import pytest

from docloom.operators.chunking import CHUNK_COLUMNS, build_chunks
from docloom.sources.files import read_documents
from docloom.streaming.ingest import DocumentStore

SCHEMA = "path string, at timestamp, text string"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def regulation(name, *articles):
    body = "\n".join(f"## Điều {n}. {t}\n{t} " + "noi dung " * 20 for n, t in enumerate(articles, 1))
    return f"---\ndoc_id: {name}\ntitle: {name}\n---\n{body}\n"


def rows(df):
    return sorted(map(tuple, df.select(*CHUNK_COLUMNS, "chunk_no").collect()))


def test_a_folder_that_is_edited(spark, tmp_path):
    folder, place = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    for name in "abcde":
        (folder / f"{name}.md").write_text(regulation(name, "one", "two"), encoding="utf-8")
    store = DocumentStore(spark, place, buckets=4)
    assert store.documents.count() == 0 and store.chunks.count() == 0
    assert store.sync(str(folder)) == 1
    expected = rows(build_chunks(read_documents(spark, str(folder))))
    assert rows(store.chunks) == expected and len(expected) >= 10
    assert store.sync(str(folder)) == 1  # nothing changed, no version
    (folder / "a.md").write_text(regulation("a", "one", "three", "four"), encoding="utf-8")
    (folder / "b.md").unlink()
    (folder / "f.md").write_text(regulation("f", "five"), encoding="utf-8")
    assert DocumentStore(spark, place).sync(str(folder)) == 2  # another process, the buckets of the first
    store.refresh()
    assert len(store.held) == 4 and rows(store.chunks) == rows(build_chunks(read_documents(spark, str(folder))))
    commit = {r.version: (r.changed, r.removed) for r in spark.read.json(f"{place}/commits").collect()}
    assert commit == {1: (5, 0), 2: (2, 1)}
    for f in folder.iterdir():
        f.unlink()
    assert store.sync(str(folder)) == 3 and store.chunks.count() == 0
    assert store.documents.where("content_hash is null").count() == 6
    assert store.vacuum() == [1, 2] or set(store.held) & {1, 2}
    assert DocumentStore(spark, place).chunks.count() == 0


def test_any_order_of_arrival_gives_one_state(spark, tmp_path):
    r = random.Random(3)
    changes = [(f"p{r.randrange(12)}", day(r.randrange(6)), r.choice([None, "", "plain text", regulation("x", "a"), regulation("y", "b", "c")])) for _ in range(120)]
    changes += [(None, day(1), "no path"), ("late", None, "no time"), ("late", day(0), "with time"), ("only", None, None)]
    best: dict = {}
    for path, at, text in changes:
        if path is None:
            continue
        key = (at or dt.datetime.min, "" if text is None else hashlib.sha256(text.encode()).hexdigest())
        if path not in best or key > best[path][0]:
            best[path] = (key, text)
    live = spark.createDataFrame([(p, t) for p, (_, t) in best.items() if t is not None], "path string, text string")
    expected = rows(build_chunks(live))
    for order in range(2):
        random.Random(order).shuffle(changes)
        store = DocumentStore(spark, str(tmp_path / f"s{order}"), buckets=3)
        size = (200, 45)[order]
        for start in range(0, len(changes), size):
            store.apply(spark.createDataFrame(changes[start : start + size], SCHEMA))
        got = {d.path: d.content_hash for d in store.documents.collect()}
        assert got == {p: k[1] or None for p, (k, _) in best.items()}
        assert rows(store.chunks) == expected


def test_restarts_on_a_stream(spark, tmp_path, monkeypatch):
    source, place, checkpoint = str(tmp_path / "feed"), str(tmp_path / "store"), str(tmp_path / "checkpoint")

    def feed(*given):
        spark.createDataFrame(list(given), SCHEMA).coalesce(1).write.mode("append").json(source)

    def follow():
        stream = spark.readStream.schema(SCHEMA).json(source)
        query = DocumentStore(spark, place, buckets=2).follow(stream, checkpoint)
        query.awaitTermination()

    feed(("a", day(0), regulation("a", "one")), ("b", day(0), regulation("b", "one")))
    follow()
    first = rows(DocumentStore(spark, place).chunks)
    feed(("a", day(2), regulation("a", "one", "two")), ("b", day(1), None))
    # Lost after its commit, before the stream's own: the batch comes again.
    apply = DocumentStore.apply

    def broken(self, changes):
        apply(self, changes)
        raise RuntimeError("lost")

    monkeypatch.setattr(DocumentStore, "apply", broken)
    with pytest.raises(Exception, match="lost"):
        follow()
    monkeypatch.setattr(DocumentStore, "apply", apply)
    # Lost before its commit: leftovers of a version that never counted.
    left = DocumentStore(spark, place)
    assert left.version == 2
    spark.createDataFrame([("ghost", day(9), "x")], "path string, at timestamp, content_hash string").selectExpr("*", "0 AS bucket").write.partitionBy("bucket").parquet(f"{place}/documents/version=3")
    follow()
    store = DocumentStore(spark, place)
    assert store.version == 2 and rows(store.chunks) != first
    assert {c.doc_id for c in store.chunks.collect()} == {"a"} and {d.path for d in store.documents.collect()} == {"a", "b"}
    feed(("a", day(1), regulation("a", "late")), ("b", day(3), regulation("b", "back")))
    follow()
    store = DocumentStore(spark, place)
    assert store.version == 3 and {d.path for d in store.documents.collect()} == {"a", "b"}
    assert {(c.doc_id, c.section_title) for c in store.chunks.collect()} >= {("b", "Điều 1. back")} and not [c for c in store.chunks.collect() if "late" in c.text]


def test_only_new_texts_are_split(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "s"), buckets=2)
    text = regulation("a", "one")
    store.apply(spark.createDataFrame([("a", day(0), text)], SCHEMA))
    assert store.apply(spark.createDataFrame([("a", day(5), text)], SCHEMA)) == 2  # the time moves on
    assert store.apply(spark.createDataFrame([("a", day(3), "older")], SCHEMA)) == 2
    assert {r.version: r.changed for r in spark.read.json(f"{tmp_path}/s/commits").collect()} == {1: 1, 2: 0}
    assert rows(store.chunks) == rows(build_chunks(spark.createDataFrame([("a", text)], "path string, text string")))


def test_a_new_store_joins_nothing(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "s"), buckets=2)
    given = spark.range(5).selectExpr("concat('p', id) AS path")
    assert given.join(store.documents, "path", "left").count() == 5
    assert "Join" not in given.join(store.documents, "path", "left")._jdf.queryExecution().optimizedPlan().toString()
