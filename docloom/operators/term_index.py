"""A stored index of chunks: batches of questions read no text.

An index is a folder of segments. `append` adds the chunks that came since; a
chunk that comes again replaces the older one. Each segment has

- packs (block, and the columns of ranking.pack): some hundred chunks of about
  one length a row, their distinct tokens with weights and counts, and their
  folded titles and texts for phrases;
- chunks: the columns that ranking and filters need;
- replaced (chunk_id, old): which chunks of older segments it replaces.

Texts are split once, when they are appended. Questions are scored where packs
are read (ranking.best_pairs), so nothing is moved for a pair of question and
chunk, whatever the filters leave. The result is exact.

A segment counts once its row stands in `versions`, which is written last; what
a lost job has left is never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.text import tokens
from docloom.operators import ranking, retrieval
from docloom.operators.retrieval import FILTERS, KEY, TEXT_PHRASE, TITLE_PHRASE
from docloom.sources.store import materialize

VERSION = "segment int, fingerprint string, n_chunks long, replaced long"


class TermIndex:
    """The committed segments of an index folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.versions: list[tuple] = []
        if self._exists(f"{path}/versions"):
            # One row for each append.
            self.versions = sorted(tuple(r) for r in spark.read.schema(VERSION).json(f"{path}/versions").collect())

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    @property
    def version(self) -> int:
        return len(self.versions)

    def _table(self, name: str, live: bool = True) -> DataFrame:
        df = self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/segment={v[0]}" for v in self.versions])
        if live and any(v[3] for v in self.versions):
            df = df.join(self._table("replaced", False).select("chunk_id", F.col("old").alias("segment")), ["chunk_id", "segment"], "left_anti")
        return df

    @property
    def chunks(self) -> DataFrame:
        return self._table("chunks")

    @property
    def packs(self) -> DataFrame:
        """With stale, the chunks of a pack that a later segment has replaced, if any are."""
        packs = self._table("packs", False)
        if not any(v[3] for v in self.versions):
            return packs
        old = self._table("replaced", False).select("chunk_id", F.col("old").alias("segment"))
        stale = packs.select("segment", "block", F.explode("chunk_id").alias("chunk_id")).join(old, ["chunk_id", "segment"], "left_semi")
        return packs.join(stale.groupBy("block").agg(F.collect_set("chunk_id").alias("stale")), "block", "left")

    @property
    def postings(self) -> DataFrame:
        """(token, block, chunk_id, weight); those of replaced chunks stay."""
        at = F.flatten(F.transform("sizes", lambda n, i: F.array_repeat(i, n)))
        lists = F.arrays_zip(F.transform("word", lambda w: F.col("words")[w]).alias("token"), F.transform(at, lambda i: F.col("chunk_id")[i]).alias("chunk_id"), F.col("weight"))
        return self._table("packs", False).select("block", F.inline(lists))

    @property
    def bounds(self) -> DataFrame:
        """(token, block, most, n): the largest weight of a token in a pack."""
        return self.postings.groupBy("token", "block").agg(F.max("weight").alias("most"), F.count("*").alias("n"))

    def append(self, chunks: DataFrame, fingerprint: str = "") -> TermIndex:
        """The index with chunks (as of retrieval) added or replaced."""
        n = max((v[0] for v in self.versions), default=-1) + 1
        if chunks.isEmpty():
            return self
        kept = [c for c in dict.fromkeys(["doc_id", "section_number", "section_title", "policy_area", *FILTERS.values()]) if c in chunks.columns]
        chunks.where("chunk_id is not null").select("chunk_id", *kept).write.mode("overwrite").parquet(f"{self.path}/chunks/segment={n}")
        # Long chunks get the high scores, so lengths are not mixed.
        size = F.floor(F.log2(F.length(F.coalesce("text", F.lit(""))) + 1) / 2)
        packs = ranking.pack(chunks, retrieval.fields_of(chunks), retrieval._tagged(chunks), phrases=True, blocks=2, kind=size)
        packs.drop("n_bonus", "bonus_question", "bonus").withColumn("block", F.expr("uuid()")).write.mode("overwrite").option("parquet.block.size", 16 << 20).parquet(f"{self.path}/packs/segment={n}")
        new = self.spark.read.parquet(f"{self.path}/chunks/segment={n}")
        old = self.chunks.join(new.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", F.col("segment").alias("old")) if self.versions else new.select("chunk_id", F.lit(0).alias("old")).limit(0)
        old.write.mode("overwrite").parquet(f"{self.path}/replaced/segment={n}")
        replaced = self.spark.read.parquet(f"{self.path}/replaced/segment={n}").count()
        row = self.spark.createDataFrame([(n, fingerprint, new.count(), replaced)], VERSION)
        row.coalesce(1).write.mode("append").json(f"{self.path}/versions")
        return TermIndex(self.spark, self.path)

    # --- questions ------------------------------------------------------------

    def _given(self, bonus: DataFrame | None) -> DataFrame:
        """The packs with the bonus of (question_id, chunk_id)."""
        packs, names = self.packs, ("bonus_chunk", "bonus_question", "bonus")
        if bonus is None:
            none = [F.array().cast(f"array<{kind}>").alias(name) for name, kind in zip(names, ("string", "string", "double"), strict=True)]
            return packs.select("*", *none)
        given = bonus.where("question_id is not null").select("chunk_id", F.struct(F.col("chunk_id").alias("c"), F.col("question_id").cast("string").alias("q"), F.col("bonus").cast("double").alias("b")).alias("one"))
        by_block = packs.select("block", F.explode("chunk_id").alias("chunk_id")).join(given, "chunk_id").groupBy("block").agg(F.collect_list("one").alias("all"))
        return packs.join(by_block, "block", "left").select(*packs.columns, *[F.col(f"all.{short}").alias(name) for short, name in zip("cqb", names, strict=True)])

    def _ranked(self, best, queries: DataFrame, k: int, bonus: DataFrame | None) -> DataFrame:
        if not self.versions:
            return retrieval.with_filters(queries).select(*KEY, F.lit("").alias("chunk_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
        return retrieval.top_k(best(self.chunks, queries, k, packs=self._given(bonus).drop("block", "segment")), self.chunks, k)

    def top_k(self, queries: DataFrame, k: int = 5, bonus: DataFrame | None = None) -> DataFrame:
        """(keys, chunk_id, score, rank): as retrieval.top_k of lexical_scores."""
        return self._ranked(retrieval.lexical_best, queries, k, bonus)

    def bm25_top_k(self, queries: DataFrame, k: int = 5, bonus: DataFrame | None = None) -> DataFrame:
        """(keys, chunk_id, score, rank): as retrieval.top_k of bm25_scores."""
        return self._ranked(retrieval.bm25_best, queries, k, bonus)

    def skipped(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """(keys, blocks, skipped_blocks, postings, skipped_postings) of each
        question without filters: packs that can't hold a result, as the largest
        weights of their tokens stay below the k-th score of the two best packs.
        A figure of the index; top_k scores all packs, which costs less than to
        choose among them by joins."""
        queries = retrieval.with_filters(queries)
        words, bounds = tokens(F.col("query")), materialize(self.bounds, "bounds")
        asked = materialize(retrieval.query_tokens(queries), "asked")
        sizes = queries.select(*KEY, F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("distinct"))
        bound = asked.join(bounds, "token").groupBy(*KEY, "block").agg(F.sum(F.col("qn") * F.col("most")).alias("most"), F.count("*").alias("matched"), F.sum(bounds["n"]).alias("size")).join(sizes, KEY)
        # Without the inner words in the pack there is no phrase.
        bound = materialize(bound.withColumn("bound", F.col("most") + F.when(F.col("matched") >= F.col("distinct") - 2, TITLE_PHRASE + TEXT_PHRASE).otherwise(0.0)), "block-bounds")
        seeds = bound.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("most").desc(), "block"))).where("_n <= 2").select(*KEY, "block")
        scored = asked.join(seeds, KEY).join(self.postings, ["token", "block"]).groupBy(*KEY, "chunk_id").agg(F.sum(F.col("qn") * F.col("weight")).alias("score"))
        ranked = scored.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("score").desc())))
        theta = ranked.where(F.col("_n") == k).select(*KEY, F.col("score").alias("theta"))
        # Short phrases may stand in chunks that share no token.
        out = ((F.col("bound") < F.coalesce("theta", F.lit(0.0))) & (F.col("n") >= 3)).cast("int")
        return bound.join(theta, KEY, "left").groupBy(*KEY).agg(F.count("*").alias("blocks"), F.sum(out).alias("skipped_blocks"), F.sum("size").alias("postings"), F.sum(F.col("size") * out).alias("skipped_postings"))


def fingerprint(df: DataFrame) -> str:
    """Of the files that a table is read from: one changed file, another value."""
    files = df.select(F.concat_ws("|", "_metadata.file_path", F.unix_micros("_metadata.file_modification_time"), F.col("_metadata.file_size").cast("string")).alias("f")).distinct()
    return files.agg(F.md5(F.array_join(F.sort_array(F.collect_list("f")), "\n").cast("binary"))).first()[0]
