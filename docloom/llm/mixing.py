"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Native: DataFrame functions only.

Each source gets a share of a total by its weight, at most `cap` times its own
size, and what is cut off is shared again by weight (water filling, solved in
closed form over one row per source). A source then takes all of its documents
for as many whole epochs as its target holds, and the remainder by weighted
sampling without replacement: a document with quality weight w and a hashed
uniform u (of its id and text) gets the exponential key -ln(u)/w, and documents
are taken by ascending key until the remaining words are used up.

The running sum over a source is built from two levels, so that a source that
holds most rows is not sorted in one task: 1 - exp(-key) deals keys, in order,
to a fixed number of buckets; sums within a bucket are added to the sums of the
buckets before it. Rows that repeat id, text and source are one row with a count
until the end, so that they cannot fill a bucket.

The document on which the budget ends is taken up to the budget (its first
words), so a source's words equal its target rounded down.

Nulls and odd rows: a null source is a source of its own, last in order. A null
text has size 0, and size 0 takes 0. A null, NaN or non-positive weight counts
as 1. Repeated rows are separate documents of one key; equal keys are ordered by
id, size and text hash. An empty table gives an empty result. The windows over
sources run in one task: sources are few beside documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import expand, materialize, table

WORD = "[^\\x20\\x09-\\x0D]+"
BUCKETS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(id_: Column, text_md5: Column, seed: str) -> Column:
    """A number between 0 and 1 that depends on id, text and seed alone."""
    digest = F.md5(F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("null")), F.coalesce(text_md5, F.lit("null")), F.lit(seed)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """One row per source: skey, source_size, target. The windows run over
    sources, not documents."""
    by_source = sizes.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighed = by_source.withColumn("share_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n + 1).cast("int")))
    level = Window.orderBy(F.col("source_size") * cap / F.col("share_weight"), F.col("skey"))
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    everything = level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # With the k sources of lowest cap per weight held at their caps, the rest
    # share what is left; the largest of these levels is the one that fits.
    held = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap
    free = F.sum("share_weight").over(everything) - F.coalesce(F.sum("share_weight").over(before), F.lit(0.0))
    weighed = weighed.withColumn("water", (F.sum("source_size").over(everything) * share - held) / free)
    weighed = weighed.withColumn("water", F.max("water").over(everything))
    target = F.least(F.col("source_size") * F.lit(float(cap)), F.col("water") * F.col("share_weight"))
    return weighed.select("skey", "source_size", target.alias("target"))


def mix_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: DataFrame | None = None,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    buckets: int = BUCKETS,
) -> DataFrame:
    """One row for the n rows of df with equal id, text and source: id,
    text_md5, source, skey, size, n, source_size, target, epochs (whole copies of each
    row) and extra (words that the n rows give beside, in turn).

    quality: rows of (doc_id, quality) that weigh the sampling, see
    with_quality.
    """
    sizes = df.select(
        F.col(id_col).alias("id"),
        F.md5(F.col(text_col).cast("binary")).alias("text_md5"),
        F.col(source_col).alias("source"),
        source_key(F.col(source_col)).alias("skey"),
        word_count(F.col(text_col)).alias("size"),
    )
    # Counted before the joins, so that no text is shuffled.
    sizes = sizes.groupBy("id", "text_md5", "source", "skey", "size").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("weight", F.lit(1.0)) if quality is None else with_quality(sizes, quality)
    weight = F.when((F.col("weight") > 0) & ~F.isnan("weight"), F.col("weight")).otherwise(1.0)
    sizes = sizes.withColumn("key", -F.log(uniform(F.col("id"), F.col("text_md5"), seed)) / weight).drop("weight")
    sizes = sizes.withColumn("bucket", F.least(F.floor((1 - F.exp(-F.col("key"))) * buckets), F.lit(buckets - 1)).cast("int"))
    sizes = materialize(sizes.withColumn("words", F.col("size") * F.col("n")), "mix-sizes")
    sums = sizes.groupBy("skey", "bucket").agg(F.sum("words").alias("bucket_size"))
    earlier = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("skey", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("bucket_start"))
    plan = source_targets(sizes.select("skey", "source", F.col("words").alias("size")), weights, share, cap)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target")).cast("long")).otherwise(0))
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("whole div source_size")).otherwise(0))
    plan = plan.withColumn("rest", F.col("whole") - F.col("epochs") * F.col("source_size"))
    # At most `buckets` rows for each source; documents join them by both keys.
    sums = sums.join(plan, "skey")
    within = Window.partitionBy("skey", "bucket").orderBy("key", "id", "size", "text_md5").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("start", F.coalesce(F.sum("words").over(within), F.lit(0))).join(sums, ["skey", "bucket"])
    extra = F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - F.col("bucket_start") - F.col("start")))
    return placed.select("id", "text_md5", "source", "skey", "size", "n", "source_size", "target", F.col("epochs").cast("long").alias("epochs"), extra.cast("long").alias("extra"))


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("null"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Per row of df: id_col, text_md5, source, size, source_size, target, taken.
    taken counts words with repeats; taken // size is the number of whole
    copies, and the remainder the words of a last, partial copy. options: as of
    mix_groups."""
    groups = materialize(mix_groups(df, id_col, text_col, source_col, **options), "mix-groups")
    largest = groups.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    rows = expand(groups, "n", "number", ["id", "text_md5", "skey"], largest)
    own = F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - F.col("number") * F.col("size")))
    return rows.select(F.col("id").alias(id_col), "text_md5", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + own).cast("long").alias("taken"))


def with_quality(sizes: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds weight: 2 where a label says good quality, 0.5 where it says bad, 1
    where there is none or it is null. Several labels of one id: the best."""
    best = labels.groupBy(F.col("doc_id").alias("label_id")).agg(F.max("quality").alias("best"))
    weight = F.when(F.col("best") >= 1, 2.0).when(F.col("best") < 1, 0.5).otherwise(1.0)
    return sizes.join(best, F.col("id") == F.col("label_id"), "left").withColumn("weight", weight).drop("label_id", "best")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), quality=table(spark, sf_dir, "labels"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH best AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
docs AS (
  SELECT d.doc_id, d.source, md5(d.text) AS text_md5,
    CAST(coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(d.text), 'null') || ':mix'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
      / (CASE WHEN b.quality >= 1 THEN 2.0 WHEN b.quality < 1 THEN 0.5 ELSE 1.0 END) AS key
  FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM src),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
      - coalesce(sum(source_size) OVER (ORDER BY source_size * 2.0::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2.0::DOUBLE)
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY source_size * 2.0::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS water
  FROM ranked),
plan AS (SELECT source, source_size, least(source_size * 2.0::DOUBLE, max(water) OVER () * w) AS target FROM levels),
placed AS (
  SELECT d.*, p.source_size, p.target, CAST(floor(p.target) AS BIGINT) AS whole,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size, d.text_md5 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (whole // source_size) * size
    + greatest(0, least(size, whole - (whole // source_size) * source_size - start)) END AS BIGINT) AS taken
FROM placed
"""
