"""What the training-data operators share: reading tables, the shared folder,
and keys that tell rows apart."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark alone so that any store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the one that spark.checkpoint.dir names. Where that is unset, a
    cluster uses its warehouse, which executors share; only a local master,
    whose executors are threads, gets a temporary folder, removed at exit.
    """
    global _own_folder
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/docloom-intermediate"
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="docloom-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return _own_folder


def application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/docloom-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Removes the intermediate tables of this application. Results that are
    not yet written or collected read them, so call it last."""
    path = spark._jvm.org.apache.hadoop.fs.Path(application_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read again.

    The lineage is cut, branches below share one evaluation, and a lost
    executor costs only the tasks that were running on it.
    """
    spark = df.sparkSession
    path = f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(doc_id: Column, text: Column, hashed: bool = False) -> Column:
    """A non-null key of (id, text): rows that repeat both share it. hashed:
    text is the MD5 of the text."""
    digest = text if hashed else F.md5(text.cast("binary"))
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(digest, F.lit("null")))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id is in fold of ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def expand(df: DataFrame, count: str, number: str, keys: list[str], largest: int, step: int = 4096) -> DataFrame:
    """Each row `count` times, with its number from 0. `largest` is the largest
    count, known to the caller: where it is 1 nothing moves, and rows that come
    very often are dealt to several tasks, `step` at a time."""
    if largest <= 1:
        return df.where(F.col(count) > 0).withColumn(number, F.lit(0).cast("long"))
    parts = df.where(F.col(count) > 0).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(`{count}` - 1) div {step}"))))
    if largest > step:
        parts = parts.repartition(*[F.col(k) for k in keys], F.col("_part"))
    first = F.col("_part") * step
    return parts.withColumn(number, F.explode(F.sequence(first, F.least(first + step, F.col(count)) - 1))).drop("_part")
