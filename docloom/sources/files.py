"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """One object a line; blank lines are skipped, bad ones fail the read."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One object a file, over many lines: a domain configuration."""
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_documents(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """(path, text), one row a file. An empty folder gives an empty table."""
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """Overwrites; characters beyond ASCII stay as they are."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_baseline(summary: DataFrame, path: str) -> None:
    """A summary of one row as one JSON file."""
    summary.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)
