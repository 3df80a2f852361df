"""Where tables are written that a job reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: str | None = None


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


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df spread over all cores by some columns, before work that takes long for
    each of its small rows. A file of a hundred megabytes holds millions of such
    rows, which a few tasks or one would work through."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read again.

    The lineage is cut, branches below share one evaluation, and a lost
    executor costs only the tasks that were running on it.
    """
    spark = df.sparkSession
    path = f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
