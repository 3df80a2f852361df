"""Admission by runs equals admission of each client as a whole."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

from pyspark.sql import functions as F

from docloom.operators import requests

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def whole(rows, limit, seconds):
    held, out = defaultdict(list), {}
    for client, ts, key in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        mine = held[client]
        out[key] = sum(t > ts - dt.timedelta(seconds=seconds) for t in mine) < limit
        if out[key]:
            mine.append(ts)
    return out


def test_equals_the_whole_client(spark):
    rng, rows = random.Random(4), []
    for client in ("a", "b", None):
        at = START
        for _ in range(400):
            at += dt.timedelta(seconds=rng.choice([0, 0, 1, 7, 30, 59, 60, 61, 119, 120, 121, 300]), microseconds=rng.choice([0, 1, 999_999]))
            rows.append((client, at, len(rows)))
    df = spark.createDataFrame(rows, "client string, ts timestamp, key long")
    for limit, seconds in ((1, 60), (3, 60), (2, 1)):
        got = {r.key: r.admitted for r in requests.admit(df, "client", "ts", "key", limit, seconds).collect()}
        assert got == whole(rows, limit, seconds)


def test_a_hot_client_is_dealt_to_many_tasks(spark):
    ts = (F.col("id") * 40 % 4_000_000).cast("long")
    df = spark.range(100_000).select(F.lit("hot").alias("client"), F.timestamp_seconds(ts - ts % 600 + F.col("id") % 30).alias("ts"), F.col("id").alias("key"))
    # Else Spark puts the few rows of a test together again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = requests.admit(df, "client", "ts", "key").withColumn("part", F.spark_partition_id())
        parts = [r["count"] for r in got.groupBy("part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(parts) == 100_000 and len(parts) == 4 and max(parts) < 50_000
