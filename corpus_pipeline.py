"""A training corpus in five stages: language identification, near-duplicate
removal, secret redaction, source mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. `run` writes every stage as Parquet to the
shared folder and reads it again as the next one's docs.

Nulls, ties and empty tables behave as the operators say; columns beside those
of documents are dropped by the first stage. Documents that share an id are told
apart by their text; of rows that repeat both, one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import language_id, mixing, near_dedup, packing, secret_scan
from docloom.llm.common import expand, materialize, row_key, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what has no language (null text, or no letter). A null lang becomes
    the predicted one."""
    docs = docs.select(*COLUMNS)
    found = language_id.predict(docs, language_id.learn_prototypes(docs), COLUMNS)
    kept = found.where(F.col("lang_pred") != language_id.UNKNOWN)
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each class, and of texts that share
    that id the one of smallest hash. Rows with a null id all stay."""
    found = near_dedup.near_texts(docs).where("kept and doc_id is not null")
    kept = materialize(found.groupBy("doc_id", "raw").agg(F.count("*").alias("n")), "kept-texts")
    rows = docs.select(*COLUMNS, near_dedup.raw_hash(F.col("text")).alias("raw"))
    chosen = rows.join(kept.select("doc_id", "raw"), ["doc_id", "raw"], "left_semi").select(*COLUMNS)
    repeated = kept.where("n > 1").select("doc_id", "raw")
    if repeated.limit(1).count():
        twice = rows.join(repeated, ["doc_id", "raw"], "left_semi").groupBy("doc_id", "raw").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("row"))
        once = rows.join(kept.where("n = 1"), ["doc_id", "raw"], "left_semi").select(*COLUMNS)
        chosen = once.unionByName(twice.select("doc_id", "row.*").select(*COLUMNS))
    return chosen.unionByName(docs.where("doc_id is null").select(*COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the text; no document goes. Owners are counted over
    docs alone, so a value whose copies the stage before has dropped counts for
    the owners of what is left."""
    docs = docs.select(*COLUMNS)
    return secret_scan.redact(docs, counts=secret_scan.owner_counts(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it: whole copies,
    and for the document on which a target ends its first words."""
    groups = materialize(mixing.mix_groups(docs, quality=table(spark, sf_dir, "labels")).where("size > 0 and (epochs > 0 or extra > 0)"), "mix-taken")
    key = row_key(F.col("id"), F.col("text_md5"), hashed=True)
    groups = groups.select(key.alias("_key"), "skey", "size", "n", "extra", (F.col("epochs") * F.col("n") + F.expr("extra div size")).alias("_whole"), (F.col("extra") % F.col("size")).alias("_rest"))
    rows = docs.withColumn("_key", row_key(F.col("doc_id"), F.col("text"))).withColumn("skey", mixing.source_key(F.col("source")))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    first = F.array_join(F.slice(words, F.lit(1), F.col("_rest").cast("int")), " ")
    several = groups.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]

    def copies(chosen: DataFrame, largest: int) -> DataFrame:
        chosen = chosen.withColumn("_copies", F.col("_whole") + (F.col("_rest") > 0).cast("long"))
        each = expand(chosen, "_copies", "_number", ["_key", "skey"], largest)
        return each.withColumn("text", F.when(F.col("_number") < F.col("_whole"), F.col("text")).otherwise(first)).select("doc_id", "text", "lang", "source")

    # Nearly all groups are one row; rows that repeat are taken from one of them.
    out = copies(rows.join(groups.where("n = 1"), ["_key", "skey"]), 4096)
    if several > 1:
        one = rows.groupBy("_key", "skey").agg(F.min(F.struct("doc_id", "text", "lang", "source")).alias("row")).select("_key", "skey", "row.*")
        out = out.unionByName(copies(one.join(groups.where("n > 1"), ["_key", "skey"]), 4 * several))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece; documents that the mix repeats come as often."""
    packed = packing.pack(packing.token_pieces(docs))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language identification", identify_language),
    ("near-duplicate removal", drop_near_duplicates),
    ("secret scan", redact_secrets),
    ("source mixing", mix_to_targets),
    ("packing", pack_sequences),
]

#: SQL can't express the random vectors, the sketches or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
