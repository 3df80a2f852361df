"""Chunks of documents that come, change and go, kept up to date.

A store is a folder of versions:

- documents/version/bucket (path, at, content_hash): one row a document; a null
  hash marks one that was removed, so that an older change doesn't bring it back;
- chunks/version/bucket: the chunk columns of `build_chunks`;
- commits: a row for each version with the version that holds each bucket.

A bucket is a hash of the path. A version rewrites the buckets of the documents
that changed and splits only texts whose content hash is new. It counts once its
commit stands, which is written last; what a lost job has left is overwritten.

Of a path the change that is largest by (at, content hash) holds, whatever the
order of arrival. So a change that comes twice, as a batch does after a restart,
alters nothing, and feeds may be late or out of order. One writer a store.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from docloom.operators.chunking import REGULATION, Headings, build_chunks
from docloom.sources.files import read_documents
from docloom.sources.store import materialize

COMMIT = "version int, held array<int>, changed long, removed long"
DOCUMENTS = "path string, at timestamp, content_hash string"
PLACE = "version int, bucket int"


def latest(changes: DataFrame) -> DataFrame:
    """The change of each path that holds: (path, at, content_hash, text). A null
    text is a removal and yields to a text of the same time; null paths go."""
    hashed = changes.where("path is not null").select("path", "at", F.sha2("text", 256).alias("content_hash"), "text")
    return hashed.groupBy("path").agg(F.max(F.struct("at", "content_hash", "text")).alias("row")).select("path", "row.*")


class DocumentStore:
    """The committed state of a store folder. buckets counts for a new store."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, min_chars: int = 80, headings: Headings = REGULATION):
        self.spark, self.path, self.min_chars, self.headings = spark, path.rstrip("/"), min_chars, headings
        self.version, self.held = 0, [0] * buckets
        self.refresh()

    def refresh(self) -> None:
        """Reads the last commit."""
        if self._folder("commits")[1]:
            last = self.spark.read.schema(COMMIT).json(f"{self.path}/commits").orderBy(F.desc("version")).limit(1).collect()
            if last:
                self.version, self.held = last[0].version, list(last[0].held)

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return (system, path) if system.exists(path) else (system, None)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("path"), F.lit(len(self.held))).cast("int")

    def _table(self, name: str, columns: str) -> DataFrame:
        """The rows of the versions that hold each bucket: a filter on partition
        columns, so no other file is read."""
        if self.version == 0:
            # Of no rows, as the optimizer sees: what joins it is not shuffled.
            fields = StructType.fromDDL(f"{columns}, {PLACE}")
            return self.spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields]).limit(0)
        holder = F.element_at(F.array(*map(F.lit, self.held)), F.col("bucket") + 1)
        return self.spark.read.schema(f"{columns}, {PLACE}").parquet(f"{self.path}/{name}").where(F.col("version") == holder)

    @cached_property
    def _chunk_columns(self) -> str:
        empty = self.spark.createDataFrame([], "path string, text string")
        return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in build_chunks(empty, self.min_chars, self.headings).schema)

    @property
    def documents(self) -> DataFrame:
        """(path, at, content_hash), removed ones with a null hash."""
        return self._table("documents", DOCUMENTS).drop("version", "bucket")

    @property
    def chunks(self) -> DataFrame:
        return self._table("chunks", self._chunk_columns).drop("version", "bucket")

    def apply(self, changes: DataFrame) -> int:
        """Takes changes (path, at, text) in and returns the version, a new one
        only if something changed."""
        old = self.documents.select("path", F.struct("at", F.coalesce("content_hash", F.lit("")).alias("h")).alias("_old"), F.col("content_hash").alias("_old_hash"))
        given = latest(changes).join(old, "path", "left")
        newer = F.col("_old").isNull() | (F.struct("at", F.coalesce("content_hash", F.lit("")).alias("h")) > F.col("_old"))
        split = F.col("_old").isNull() | ~F.col("content_hash").eqNullSafe(F.col("_old_hash"))
        taken = materialize(given.where(newer).select("path", "at", "content_hash", F.when(split, F.col("text")).alias("text"), split.alias("split"), self._bucket().alias("bucket")), "changes")
        # At most one row for each bucket.
        counts = taken.groupBy("bucket").agg(F.count_if(F.expr("split and content_hash is not null")).alias("changed"), F.count_if(F.expr("split and content_hash is null")).alias("removed")).collect()
        if not counts:
            return self.version
        touched, version = [r.bucket for r in counts], self.version + 1
        documents = self._table("documents", DOCUMENTS).where(F.col("bucket").isin(touched)).drop("version")
        documents = documents.join(taken.select("path"), "path", "left_anti").unionByName(taken.select("path", "at", "content_hash", "bucket"))
        fresh = build_chunks(taken.where("split and content_hash is not null").select("path", "text"), self.min_chars, self.headings)
        fresh = fresh.withColumn("bucket", F.pmod(F.xxhash64("source_path"), F.lit(len(self.held))).cast("int"))
        gone = taken.where("split").select(F.col("path").alias("source_path"))
        chunks = self._table("chunks", self._chunk_columns).where(F.col("bucket").isin(touched)).drop("version").join(gone, "source_path", "left_anti").unionByName(fresh)
        for name, rows in (("documents", documents), ("chunks", chunks)):
            # Rebalanced, so a bucket is some large files, not one for each task.
            rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/version={version}")
        held = [version if b in set(touched) else v for b, v in enumerate(self.held)]
        commit = self.spark.createDataFrame([(version, held, sum(r.changed for r in counts), sum(r.removed for r in counts))], COMMIT)
        commit.coalesce(1).write.mode("append").json(f"{self.path}/commits")
        self.version, self.held = version, held
        return version

    def sync(self, folder: str, pattern: str = "*.md", at: dt.datetime | None = None) -> int:
        """Makes the store equal a folder whose files are edited in place. Files
        are hashed where they are read; texts move only if they changed."""
        files = read_documents(self.spark, folder, pattern)
        held = self.documents.where("content_hash is not null").withColumnRenamed("content_hash", "_held")
        now = files.select("path", F.sha2("text", 256).alias("_now"))
        differ = materialize(now.join(held, "path", "full_outer").where(~F.col("_now").eqNullSafe(F.col("_held"))).select("path", F.col("_now").isNull().alias("gone")), "differ")
        moment = F.lit(at or dt.datetime.now()).cast("timestamp")
        come = files.join(differ.where("not gone").select("path"), "path").select("path", moment.alias("at"), "text")
        return self.apply(come.unionByName(differ.where("gone").select("path", moment.alias("at"), F.lit(None).cast("string").alias("text"))))

    def follow(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        """Takes in a stream of changes (path, at, text) until none is left."""
        def take(batch: DataFrame, _: int) -> None:
            self.apply(batch)

        return changes.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def vacuum(self) -> list[int]:
        """Removes the versions that hold no bucket any more and returns their
        numbers. Jobs that still read an older state fail."""
        removed: set[int] = set()
        for name in ("documents", "chunks"):
            system, folder = self._folder(name)
            for status in system.listStatus(folder) if folder is not None else []:
                number = status.getPath().getName().removeprefix("version=")
                if number.isdigit() and int(number) not in self.held:
                    system.delete(status.getPath(), True)
                    removed.add(int(number))
        return sorted(removed)
