"""Secret scans by corpus-wide ownership frequency.

Native: DataFrame functions only.

Three base kinds of span come from fixed patterns. Beside them every long token
with letters and digits is a candidate. All candidates, base ones included, are
counted over the corpus: the hash of each value by distinct repositories and
distinct owners. A value under many owners is a widely copied example; one that
stays with few owners, in however many of their repositories, and has varied
characters looks like a live credential. Owner-specific live-looking tokens
outside base spans are added as spans of kind `live`; base spans always stay.

Only lengths and hashes leave the scan, never the texts. Counting is by distinct
(value, owner, repository) first, so a value that a third of all rows hold is
summed map-side; the join back is one that Spark splits when skewed.

Positions are code points, ends exclusive. The regular expression splits the
text at the same leftmost matches that it extracts, and running sums over the
lengths of matches and of what lies between them give the positions; sums and
overlaps are windows over the matches of one text, so the work is linear in the
text up to a sort of its matches.

Nulls and odd rows: a null text is empty and has no spans. A null owner or
repository counts as one further value. Rows that repeat id and text count once
in the corpus counts and each get the same result. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import materialize, row_key, table

# The patterns of the base kinds. The least lengths of access and
# hex stand in the patterns: their runs are greedy, so no other run is found.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"

TOKEN = "[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "live")


def matches(text: Column, kind: int, pattern: str, value_group: int, wanted, possible: Column) -> Column:
    """array<struct<kind, i, before, size, hash>> of the leftmost
    non-overlapping matches: their number, the characters between the match
    before and this one, their length, and the hash of the value of the wanted
    ones, null for others. possible: a cheap condition that all matching texts
    meet."""
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    value = whole if value_group == 0 else F.regexp_extract_all(text, p, F.lit(value_group))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    # One gap more than matches; the last zipped row has no match and is cut.
    pieces = F.filter(F.arrays_zip(whole.alias("whole"), value.alias("value"), gaps.alias("gap")), lambda x: x["whole"].isNotNull())
    out = F.transform(pieces, lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("before"), F.length(x["whole"]).alias("size"), F.when(wanted(x["value"]), F.sha2(x["value"], 256)).alias("hash"),
    ))
    return F.when(possible, out).otherwise(F.array().cast("array<struct<kind:int,i:int,before:int,size:int,hash:string>>"))


def scan(df: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """Per row: row_key, id, owner, repo and found, the matches of all kinds."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.col(owner_col).alias("owner"), F.col(repo_col).alias("repo"), text.alias("text"), row_key(F.col(id_col), text).alias("row_key"))
    t = F.col("text")
    # Every match of the other three kinds lies in a token.
    token = t.rlike(TOKEN)
    found = F.concat(
        matches(t, 0, ASSIGN, 2, lambda x: F.length(x) >= 6, (t.contains("=") | t.contains(":")) & t.rlike(ASSIGN)),
        matches(t, 1, ACCESS, 0, lambda x: F.lit(True), t.contains("AKIA") & token),
        matches(t, 2, HEX, 0, lambda x: F.lit(True), token & t.rlike(HEX)),
        matches(t, 3, TOKEN, 0, looks_live, token),
    )
    return rows.select("id", "owner", "repo", "row_key", found.alias("found"))


def looks_live(value: Column) -> Column:
    """At least 20 characters with 4 digits, a letter, and 9 different ones."""
    return value.rlike("(?:[0-9][^0-9]*){4}") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 9)


def ownership(scanned: DataFrame) -> DataFrame:
    """hash, n_owners, n_repos: distinct owners of each value, and distinct
    (owner, repository) pairs."""
    uses = scanned.select(F.explode("found.hash").alias("hash"), "owner", "repo").where(F.col("hash").isNotNull()).distinct()
    return uses.groupBy("hash", "owner").agg(F.count("*").alias("repos")).groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))


def placed(scanned: DataFrame) -> DataFrame:
    """row_key, kind, start, end, hash of the wanted matches, once for rows that
    repeat."""
    found = scanned.where(F.size("found") > 0).select("row_key", F.explode("found").alias("m")).select("row_key", "m.*").distinct()
    here = Window.partitionBy("row_key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ends = found.withColumn("end", F.sum(F.col("before") + F.col("size")).over(here).cast("int"))
    return ends.where(F.col("hash").isNotNull()).select("row_key", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "hash")


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", max_owners: int = 2, counts: DataFrame | None = None) -> DataFrame:
    """Per row of df: id_col, row_key, and spans, an ordered
    array<struct<start, kind, end, reach, n_owners, n_repos, owner_specific>>,
    where reach is the largest end of the spans before.

    A value is owner-specific with at most max_owners owners; beyond, it is a
    widely copied example. counts: what `owner_counts` gives for a larger corpus
    that holds df's values; df itself is counted where it is None.
    """
    scanned = materialize(scan(df, id_col, text_col, owner_col, repo_col), "secret-scan")
    counts = materialize(ownership(scanned), "secret-owners") if counts is None else counts
    hits = placed(scanned).join(counts, "hash").withColumn("owner_specific", F.col("n_owners") <= max_owners)
    hits = hits.where((F.col("kind") < 3) | F.col("owner_specific"))
    # A token overlaps a base span if one that starts before it ends in it or
    # beyond, or if the next one starts in it.
    order, base = Window.partitionBy("row_key").orderBy("start", "kind"), F.col("kind") < 3
    # What comes later is what comes earlier in the opposite order: a frame that
    # only grows costs one step a row, one that only shrinks is made anew.
    before = Window.unboundedPreceding
    earlier, later = order.rowsBetween(before, -1), Window.partitionBy("row_key").orderBy(F.col("start").desc(), F.col("kind").desc()).rowsBetween(before, -1)
    around = hits.withColumn("base_end", F.max(F.when(base, F.col("end"))).over(earlier)).withColumn("base_start", F.min(F.when(base, F.col("start"))).over(later))
    clear = (F.coalesce("base_end", F.lit(0)) <= F.col("start")) & (F.col("base_start").isNull() | (F.col("base_start") >= F.col("end")))
    free = around.where(base | clear).withColumn("reach", F.coalesce(F.max("end").over(earlier), F.lit(0)))
    spans = free.groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "reach", "n_owners", "n_repos", "owner_specific"))).alias("spans"))
    none = F.array().cast(spans.schema["spans"].dataType)
    return scanned.select(F.col("id").alias(id_col), "row_key").join(spans, "row_key", "left").withColumn("spans", F.coalesce("spans", none))


def owner_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """hash, n_owners, n_repos of every value in df."""
    return materialize(ownership(scan(df, id_col, text_col, owner_col, repo_col)), "secret-owners")


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", **options) -> DataFrame:
    """df with every found span in text_col replaced by mark.

    Base spans and owner-specific tokens go; widely copied tokens stay.
    Overlapping spans are replaced as one. Texts without spans are unchanged.
    """
    found = find_secrets(df, id_col, text_col, **options).where(F.size("spans") > 0).select(F.col("row_key").alias("_row_key"), F.col("spans").alias("_spans")).dropDuplicates(["_row_key"])
    keyed = df.withColumn("_row_key", row_key(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))).join(found, "_row_key", "left")
    t = F.col(text_col)

    def clean(row: Column) -> Column:
        """What no span covers, piece by piece of the code points, with a mark
        where a span begins that does not overlap those before it."""
        chars, spans = row["chars"], row["spans"]
        piece = lambda x: F.concat(F.array_join(F.slice(chars, x["reach"] + 1, x["start"] - x["reach"]), ""), F.lit(mark))
        pieces = F.transform(spans, lambda x: F.when(x["start"] >= x["reach"], piece(x)).otherwise(""))
        end = F.array_max(F.transform(spans, lambda x: x["end"]))
        return F.concat(F.array_join(pieces, ""), F.array_join(F.slice(chars, end + 1, F.size(chars)), ""))

    # Inside a lambda, so that the text is split once and not for each span.
    whole = F.transform(F.array(F.struct(F.split(t, "").alias("chars"), F.col("_spans").alias("spans"))), clean)[0]
    return keyed.withColumn(text_col, F.when(F.col("_spans").isNull(), t).otherwise(whole)).drop("_row_key", "_spans")


def op3_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] < 3)

    def of_kind(kind: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    specific = F.size(F.filter("spans", lambda x: x["owner_specific"])).cast("long")
    return found.select("doc_id", *counts, specific.alias("n_owner_specific"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
pat AS (SELECT * FROM (VALUES
  (0, 'assign', '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 6),
  (1, 'access', '(AKIA[A-Z0-9]+)', 20), (2, 'hex', '([0-9a-f]+)', 24), (3, 'live', '([A-Za-z0-9+/_-]{20,})', 20)) AS v(kind, name, pattern, least)),
m AS (
  SELECT rid, doc_id, source, kind, name, least, regexp_extract_all(text, pattern, 0) AS whole, regexp_extract_all(text, pattern, 1) AS val, string_split_regex(text, pattern) AS gaps
  FROM d, pat WHERE regexp_matches(text, pattern)),
u AS (
  SELECT rid, doc_id, source, kind, name, least, unnest(whole) AS whole, unnest(val) AS val, unnest(gaps[1:len(whole)]) AS gap, unnest(generate_series(1, len(whole))) AS i FROM m),
s AS (
  SELECT *, CAST(sum(length(gap) + length(whole)) OVER (PARTITION BY rid, kind ORDER BY i) AS BIGINT) AS e FROM u),
c AS (
  SELECT rid, doc_id, source, kind, name, e - length(whole) AS b, e, val FROM s
  WHERE length(val) >= least AND (kind < 3 OR (length(regexp_replace(val, '[^0-9]', '', 'g')) >= 4 AND regexp_matches(val, '[A-Za-z]') AND len(list_distinct(string_split(val, ''))) >= 9))),
f AS (SELECT val, count(DISTINCT coalesce(source, chr(1))) AS n_owners, count(DISTINCT coalesce(source, chr(1)) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS n_repos FROM c GROUP BY val),
k AS (SELECT c.*, n_owners <= 2 AS specific FROM c JOIN f USING (val)),
a AS (
  SELECT * FROM k WHERE kind < 3 OR (specific AND NOT EXISTS (SELECT 1 FROM k b WHERE b.rid = k.rid AND b.kind < 3 AND b.b < k.e AND k.b < b.e))),
g AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_live,
    count(*) FILTER (specific) AS n_owner_specific,
    coalesce(string_agg(name || ':' || b || ':' || e, ',' ORDER BY b, kind) FILTER (kind < 3), '') AS base, string_agg(name || ':' || b || ':' || e, ',' ORDER BY b, kind) AS spans
  FROM a GROUP BY rid)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_live, 0) AS n_live,
  coalesce(n_owner_specific, 0) AS n_owner_specific, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""
