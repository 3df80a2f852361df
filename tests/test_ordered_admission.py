"""Admission on a stream in order of time: disorder, late rows, restart, expiry."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from docloom.operators.requests import admit
from docloom.streaming.rate_limit import admit_in_order

T0 = dt.datetime(2024, 1, 1, 12)
SCHEMA = "client string, key long, ts timestamp"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(PROVIDER, before)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def run(spark, folder, batch):
    """Adds a file and runs the stream over what is new, from its checkpoint."""
    spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = admit_in_order(stream, limit=3, seconds=60, late="30 seconds").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck")
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return {(r.client, r.key): r.admitted for r in spark.read.parquet(f"{folder}/out").collect()}


def test_equals_the_batch_over_restarts(rocks, tmp_path):
    rng = random.Random(3)
    times = sorted(rng.sample(range(400), 60) + [5, 5, 200])
    events = [(rng.choice("ab"), k, at(s)) for k, s in enumerate(times)] + [("c", 900, at(1)), ("c", 901, at(2))]
    # Disorder of up to 20 seconds, in three batches that each start from the checkpoint.
    events.sort(key=lambda e: e[2] + dt.timedelta(seconds=rng.randrange(20)))
    run(rocks, tmp_path, events[:25])
    run(rocks, tmp_path, events[25:])
    end = [("z", 1000, at(2000))]
    run(rocks, tmp_path, end)
    # Far behind the watermark: dropped. The last event lets no other wait.
    got = run(rocks, tmp_path, [("a", 2000, at(10)), ("z", 1001, at(4000))])
    want = {(r.client, r.key): r.admitted for r in admit(rocks.createDataFrame(events + end, SCHEMA), "client", "ts", "key", 3, 60).collect()}
    assert got == want and not all(want.values())
