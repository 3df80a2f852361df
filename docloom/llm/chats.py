"""Chat formatting by cumulative-snapshot collapse.

Native: DataFrame functions only.

A logger that writes the whole conversation after every turn leaves each
conversation many times, each time a little longer. Rolling hashes over the
turns give every prefix of every conversation a key; a conversation whose own
key is a proper prefix of a longer one is dropped by an anti-join, equal
conversations keep the one with the smallest id, and what is left is rendered.

The rolling hash of k turns is the pair of running sums of two 64-bit hashes of
(position, role, text), exact in decimal(38, 0), with k itself: 128 bits and
the length. Only (id, position, two hashes) are shuffled for the search; texts
move once, and only those of conversations that stay, beside the few turns that
share a number with another turn and are put in order by role and text.

Nulls and odd rows: turns are ordered by (turn, role, text), nulls first, and
repeated turn numbers or rows all count. A null role is rendered as `unknown`,
a null text as empty; for the search they differ from the strings `unknown`
and ''. A row with a null conversation id is a conversation of one turn: nothing
says which others it belongs to. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import materialize, table


def tie_order(turns: DataFrame) -> DataFrame:
    """(ckey, turn, t1, t2, tie) of turns that share their number with another
    turn of the conversation: their place by role and text. Equal turns have one
    place. turns: ckey, turn, role, text, t1, t2."""
    # Written first: few turns share a number, and their texts alone move.
    shared = turns.groupBy("ckey", "turn").agg(F.count("*").alias("c")).where("c > 1").select(F.col("ckey").alias("k"), F.col("turn").alias("n"))
    shared = materialize(shared, "chat-shared")
    tied = turns.join(shared, (F.col("ckey") == F.col("k")) & F.col("turn").eqNullSafe(F.col("n"))).select("ckey", "turn", "role", "text", "t1", "t2").distinct()
    return tied.select("ckey", "turn", "t1", "t2", F.row_number().over(Window.partitionBy("ckey", "turn").orderBy("role", "text")).alias("tie"))


def with_ties(turns: DataFrame, ties: DataFrame) -> DataFrame:
    """turns with tie, 0 for turns that are alone with their number."""
    other = ties.select(F.col("ckey").alias("k"), F.col("turn").alias("n"), F.col("t1").alias("h1"), F.col("t2").alias("h2"), "tie")
    same = (F.col("ckey") == F.col("k")) & F.col("turn").eqNullSafe(F.col("n")) & (F.col("t1") == F.col("h1")) & (F.col("t2") == F.col("h2"))
    return turns.join(other, same, "left").withColumn("tie", F.coalesce("tie", F.lit(0))).drop("k", "n", "h1", "h2")


def step_hash(seed: int, n: Column) -> Column:
    return F.xxhash64(F.lit(seed), n, f"t{seed}").cast("decimal(20,0)")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(ckey, conv_id, n, h1, h2, total): the key of each prefix and the length
    of its conversation. turns: ckey, conv_id, turn, tie, t1, t2."""
    order = Window.partitionBy("ckey").orderBy("turn", "tie")
    # Position enters the hash, so the sum depends on the order of the turns.
    placed = turns.select("ckey", "conv_id", F.row_number().over(order).alias("n"), "t1", "t2")
    for s in (1, 2):
        placed = placed.withColumn(f"p{s}", step_hash(s, F.col("n")))
    running = Window.partitionBy("ckey").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return placed.select(
        "ckey", "conv_id", "n", F.sum("p1").over(running).cast("decimal(38,0)").alias("h1"), F.sum("p2").over(running).cast("decimal(38,0)").alias("h2"),
        F.count("*").over(Window.partitionBy("ckey")).alias("total"),
    )


def maximal_conversations(turns: DataFrame, single: DataFrame) -> DataFrame:
    """(ckey, n_copies) of the conversations that prefix no other, one of each
    equal set, with the conversations that are equal to it. single: (ckey, t1,
    t2, c), conversations without an id of one turn each, c equal ones; they
    stand for a set only if no conversation with an id does."""
    prefixes = materialize(prefix_hashes(turns), "chat-prefixes")
    own = prefixes.where("n = total").select("n", "h1", "h2", F.lit(False).alias("no_id"), "conv_id", "ckey", F.lit(1).cast("long").alias("c"))
    first = F.lit(1)
    bare = single.select(first.alias("n"), *[step_hash(s, first).cast("decimal(38,0)").alias(f"h{s}") for s in (1, 2)], F.lit(True).alias("no_id"), F.lit(None).cast(own.schema["conv_id"].dataType).alias("conv_id"), "ckey", "c")
    whole = own.unionByName(bare).groupBy("n", "h1", "h2").agg(F.min(F.struct("no_id", "conv_id", "ckey")).alias("first"), F.sum("c").alias("n_copies"))
    proper = prefixes.where("n < total").select("n", "h1", "h2").distinct()
    return whole.join(proper, ["n", "h1", "h2"], "left_anti").select("first.ckey", "n_copies")


def collapse_and_render(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_copies, rendered."""
    role, text = F.col(role_col), F.col(text_col)
    chosen = df.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"),
        *[F.xxhash64(F.lit(s), role.isNull(), role, text.isNull(), text).alias(f"t{s}") for s in (1, 2)],
    )
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n<|end|>\n"))
    bare = chosen.where("conv_id is null").groupBy("t1", "t2").agg(F.count("*").alias("c"), F.min(line).alias("line"))
    bare = bare.withColumn("ckey", F.concat(F.lit("n"), F.hex("t1"), F.hex("t2")))
    named = chosen.where("conv_id is not null").withColumn("ckey", F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    turns = with_ties(named, materialize(tie_order(named), "chat-ties"))
    maximal = materialize(maximal_conversations(turns.select("ckey", "conv_id", "turn", "tie", "t1", "t2"), bare.select("ckey", "t1", "t2", "c")), "chats-kept")
    grouped = turns.join(maximal, "ckey").groupBy("ckey").agg(
        F.first("conv_id").alias("conv_id"), F.count("*").alias("n_turns"), F.first("n_copies").alias("n_copies"),
        F.sort_array(F.collect_list(F.struct("turn", "tie", line.alias("line")))).alias("lines"),
    )
    rendered = grouped.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("rendered"))
    alone = bare.join(maximal, "ckey").select(F.lit(None).cast(rendered.schema["conv_id"].dataType).alias("conv_id"), F.lit(1).cast("long").alias("n_turns"), "n_copies", F.col("line").alias("rendered"))
    return rendered.unionByName(alone)


def op10_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_and_render(table(spark, sf_dir, "conversations"))


OP10_SQL = r"""
WITH c AS (SELECT *, CASE WHEN conv_id IS NULL THEN 'row ' || row_number() OVER () ELSE 'id ' || conv_id END AS ckey FROM conversations),
t AS (
  SELECT ckey, conv_id, turn, role, text, row_number() OVER (PARTITION BY ckey ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n,
    count(*) OVER (PARTITION BY ckey) AS total,
    CASE WHEN role IS NULL THEN '-' ELSE '+' || length(role) || ':' || role END || CASE WHEN text IS NULL THEN '-' ELSE '+' || length(text) || ':' || text END AS item
  FROM c),
p AS (
  SELECT ckey, conv_id, n, total, md5(string_agg(item, chr(1)) OVER (PARTITION BY ckey ORDER BY n)) AS h FROM t),
w AS (SELECT n, h, first(ckey ORDER BY conv_id NULLS LAST, ckey) AS ckey, count(*) AS n_copies FROM p WHERE n = total GROUP BY n, h),
kept AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.n = w.n AND p.h = w.h AND p.n < p.total))
SELECT t.conv_id, CAST(count(*) AS BIGINT) AS n_turns, CAST(any_value(kept.n_copies) AS BIGINT) AS n_copies,
  string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY t.n) AS rendered
FROM t JOIN kept ON t.ckey = kept.ckey
GROUP BY t.ckey, t.conv_id
"""
