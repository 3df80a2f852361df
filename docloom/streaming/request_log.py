"""Append-only request log. The text of a question is never written."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def log_lines(requests: DataFrame) -> DataFrame:
    """timestamp, question_length, status, top_k, warnings."""
    warnings = F.col("warnings") if "warnings" in requests.columns else F.array().cast("array<string>")
    return requests.select(F.col("ts").alias("timestamp"), F.length("question").alias("question_length"), "status", "top_k", warnings.alias("warnings"))


def append_log(requests: DataFrame, path: str) -> None:
    """A batch of requests; only if DOCLOOM_REQUEST_LOG is 1."""
    if os.environ.get("DOCLOOM_REQUEST_LOG") == "1":
        log_lines(requests).write.mode("append").json(path)


def stream_log(requests: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return log_lines(requests).writeStream.outputMode("append").format("json").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
