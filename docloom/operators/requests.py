"""Requests: validation and sliding-window admission."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import strip


def validate_requests(requests: DataFrame, max_length: int = 2000, max_top_k: int = 10) -> DataFrame:
    """requests (question, top_k) with status: 200, or 422 for a question that
    is blank or too long and for a top_k out of range; of the others 503 where
    the column ready is false and 500 where the column failed is true, if there
    are such columns. A null top_k is 5, a null ready true, a null failed false."""
    q, k = F.coalesce("question", F.lit("")), F.coalesce("top_k", F.lit(5))
    ok = (F.length(q) <= max_length) & (strip(q) != "") & k.between(1, max_top_k)
    ready = F.coalesce("ready", F.lit(True)) if "ready" in requests.columns else F.lit(True)
    failed = F.coalesce("failed", F.lit(False)) if "failed" in requests.columns else F.lit(False)
    status = F.when(~ok, 422).when(~ready, 503).when(failed, 500).otherwise(200)
    return requests.withColumn("top_k", k).withColumn("status", status)


def window_counts(events: DataFrame, client: str, ts: str, seconds: int) -> DataFrame:
    """events with in_window: events of the client in the last `seconds`, itself
    included; one exactly that old has expired. Counts all events."""
    order = Window.partitionBy(client).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("in_window", F.count("*").over(order))


def admit(events: DataFrame, client: str, ts: str, key: str, limit: int = 30, seconds: int = 60) -> DataFrame:
    """(client, key, ts, admitted, retry_after): an event is admitted if fewer
    than `limit` admitted ones lie in the window before it; rejected events do
    not count. Rows without a time are no events and are left out.

    Time is cut into bins of one window. Where a client has an empty bin, what
    comes after cannot depend on what came before, so a client is dealt to tasks
    by its runs of filled bins. Within a run rows come in order, and only the
    admitted times of one window are held. A client without a pause of a bin is
    one run."""
    fields = events.select(F.col(client).alias("client"), F.col(key).alias("key"), F.col(ts).alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    kinds = {f.name: f.dataType.simpleString() for f in fields.schema.fields}
    span = seconds * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = object(), deque()
        for batch in batches:
            admitted, wait = [], []
            for *who, at in zip(*(batch.column(k).to_pylist() for k in (0, 4, 3)), strict=True):
                if who != now:
                    now, held = who, deque()
                while held and held[0] <= at - span:
                    held.popleft()
                admitted.append(len(held) < limit)
                wait.append(None if admitted[-1] else -(-(held[0] + span - at) // 1_000_000))
                if admitted[-1]:
                    held.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(admitted, pa.bool_()), pa.array(wait, pa.int64())], ["client", "key", "ts", "admitted", "retry_after"])

    binned = fields.where("at is not null").withColumn("bin", F.expr(f"(at - pmod(at, {span})) div {span}"))
    bins = binned.select("client", "bin").distinct()
    # Over the bins of a client, however many events they have.
    order = Window.partitionBy("client").orderBy("bin")
    starts = F.coalesce(F.col("bin") - F.lag("bin").over(order) > 1, F.lit(True))
    runs = bins.withColumn("_starts", starts.cast("int")).withColumn("run", F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.select(F.col("client").alias("_client"), F.col("bin").alias("_bin"), "run")
    placed = binned.join(runs, F.col("client").eqNullSafe(F.col("_client")) & (F.col("bin") == F.col("_bin")))
    ordered = placed.select("client", "key", "ts", "at", "run").repartition("client", "run").sortWithinPartitions("client", "run", "at", "key")
    return ordered.mapInArrow(run, f"client {kinds['client']}, key {kinds['key']}, ts {kinds['ts']}, admitted boolean, retry_after long")
