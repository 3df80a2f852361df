from __future__ import annotations

import datetime as dt
import glob
import json

import pytest

from docloom.plans import queries
from docloom.sources import files
from docloom.sources.store import dealt
from docloom.streaming import rate_limit, request_log


def test_read_and_write(spark, tmp_path):
    (tmp_path / "b.md").write_text("two\nlines é", encoding="utf-8")
    (tmp_path / "a.txt").write_text("no")
    assert [r.text for r in files.read_documents(spark, str(tmp_path)).collect()] == ["two\nlines é"]
    df = spark.createDataFrame([(1, "é", None)], "a int, b string, c string")
    files.write_jsonl(df, f"{tmp_path}/out")
    lines = "".join(open(f, encoding="utf-8").read() for f in glob.glob(f"{tmp_path}/out/part*"))
    assert "é" in lines and json.loads(lines) == {"a": 1, "b": "é", "c": None}
    assert files.read_jsonl(spark, f"{tmp_path}/out", "a int, b string").first().b == "é"
    files.write_baseline(df, f"{tmp_path}/one")
    (tmp_path / "c.json").write_text('{\n "x": [1,\n 2]}')
    assert files.read_json(spark, f"{tmp_path}/c.json").first().x == [1, 2]
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\n{oops\n')
    with pytest.raises(Exception, match="(?s)MALFORMED|Malformed|malformed|FAILFAST"):
        files.read_jsonl(spark, f"{tmp_path}/bad.jsonl", "a int").collect()


def test_streams(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("c", k, t0 + dt.timedelta(seconds=s), "who?", 200, 5) for k, s in enumerate([0, 1, 2, 3, 61, 62])]
    events = spark.createDataFrame(rows, "client string, key long, ts timestamp, question string, status int, top_k int")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = request_log.stream_log(stream, f"{tmp_path}/log", f"{tmp_path}/ck1")
    q.awaitTermination()
    line = spark.read.json(f"{tmp_path}/log").first().asDict()
    assert "question" not in line and line["question_length"] == 4
    out = rate_limit.admit_stream(stream.select("client", "key", "ts"), limit=2, seconds=60).writeStream.format("parquet").option("path", f"{tmp_path}/adm").option("checkpointLocation", f"{tmp_path}/ck2").outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination()
    assert {r.key: r.admitted for r in spark.read.parquet(f"{tmp_path}/adm").collect()} == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True}


def test_log_is_off_by_default(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), "q", 200, 5)], "ts timestamp, question string, status int, top_k int")
    request_log.append_log(df, f"{tmp_path}/log")
    assert not glob.glob(f"{tmp_path}/log*")
    monkeypatch.setenv("DOCLOOM_REQUEST_LOG", "1")
    request_log.append_log(df, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 1


def test_heavy_rows_are_dealt_to_all_cores(spark):
    """The given tables are one task each, however many rows they have."""
    for name in ("cross_references", "reference_targets", "regulation_chunks", "policy_tags"):
        scan = queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in scan and f", {4 * spark.sparkContext.defaultParallelism}" in scan, name
    rows = dealt(spark.range(0, 4000, 1, 1), "id")
    sizes = rows.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
    assert sum(sizes) == 4000 and len(sizes) == 4 * spark.sparkContext.defaultParallelism and max(sizes) < 500
