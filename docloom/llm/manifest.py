"""Merkle manifest of a dataset, and proofs by lookup of coordinates.

Every row is a leaf: the SHA-256 of its columns, each with its length. The
leaves of a source are ordered and hashed 16 at a time, level by level, to a
subroot; the subroots of all sources likewise give the root.

The node table holds one row for each run of 16: (source, level, run) and its
digests in order. What a proof needs follows from the place of a leaf and the
number of leaves of its source alone: at level l the run `index div 16^(l+1)`.
The 16 leaves of a run need the same coordinates, so these are exploded once for
each run of leaves, joined with the node table, put in order of level, and
concatenated and folded for each leaf.

Places are dealt by range: rows are sorted by (source, id, leaf) in as many
parts as Spark shuffles into, a row's number in its part is added to the counts
of the parts before, and no source is sorted in one task. Each level is written
once, 16 times smaller than the one below. Levels of at most BROADCAST_RUNS runs
(about 1 KB each, counted first) are broadcast; where there are more, a run is
asked for by a bounded part of all leaves: by 16^l runs of leaves at level l, as
any full run is, so the join has no hot key.

Nulls and odd rows: a null value is `-` in the leaf, so it differs from ''. A
null source is the first source, a null id comes first in its source. Rows that
share an id are ordered by leaf; rows that repeat wholly are separate, equal
leaves. A row without an id is not tampered with. An empty table gives an empty
result. Columns beside those hashed are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import materialize, table

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16
BROADCAST_RUNS = 4096
#: Leaves of a source that meet its subroot in one task.
DEAL = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def joined(digests: Column) -> Column:
    return F.array_join(digests, "")


@dataclass
class Forest:
    """tops: group, digest (of the top node). runs: the node table (group,
    level, run, digests, n), one DataFrame for each level from 0 on, and the
    number of its rows."""

    tops: DataFrame
    runs: list[tuple[DataFrame, int]]


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with their index (from 0) in their group and n, the rows of the
    group. The group is a non-null string, ordered by bytes."""
    # Written first, since dealing by range reads twice. The last key deals
    # equal rows, however many they are, to several parts.
    dealt = materialize(rows.withColumn("_deal", F.monotonically_increasing_id()), f"{name}-rows")
    keys = [F.col(group), *[F.col(c).asc_nulls_first() for c in order], F.col("_deal")]
    placed = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_deal").withColumn("_id", F.monotonically_increasing_id())
    # An id is the part, and below it the number of the row in its part.
    placed = materialize(placed.withColumn("_part", F.shiftright("_id", 33)), f"{name}-sorted")
    counts = placed.groupBy(group, "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy(group)).alias("n"))
    found = placed.join(starts, [group, "_part"]).withColumn("index", F.col("_id") - F.col("_first") + F.col("_start"))
    return materialize(found.drop("_id", "_part", "_first", "_start"), name)


def build_forest(leaves: DataFrame, fanout: int = FANOUT, name: str = "manifest") -> Forest:
    """leaves: group, index, n (leaves of the group), digest."""
    nodes, runs, tops = leaves.select("group", "index", "n", "digest"), [], []
    most = leaves.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    while True:
        tops.append(nodes.where("n = 1").select("group", "digest"))
        if most <= 1:
            break
        run = nodes.where("n > 1").groupBy("group", F.expr(f"index div {fanout}").alias("run")).agg(F.sort_array(F.collect_list(F.struct("index", "digest"))).alias("nodes"), F.first("n").alias("n"))
        run = run.select("group", F.lit(len(runs)).alias("level"), "run", F.transform("nodes", lambda x: x["digest"]).alias("digests"), "n")
        run = materialize(run, f"{name}-level{len(runs)}")
        runs.append((run, run.count()))
        nodes = run.select("group", F.col("run").alias("index"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), F.sha2(joined(F.col("digests")), 256).alias("digest"))
        most = -(-most // fanout)
    found = tops[0]
    for t in tops[1:]:
        found = found.unionByName(t)
    return Forest(found, runs)


def paths(runs_of: DataFrame, forest: Forest, first_level: int, fanout: int = FANOUT, broadcast_runs: int = BROADCAST_RUNS) -> DataFrame:
    """(key, step, digests, at) for rows (key, group, index, n): the runs that
    lie over a place, from first_level up. index and n are those of leaves; at
    is the place in the run of the node below."""
    levels = F.sequence(F.lit(first_level), F.lit(max(len(forest.runs) - 1, first_level)))
    size = lambda level: F.pow(F.lit(float(fanout)), level).cast("long")
    # Level l exists where more than one node is left on it.
    asked = runs_of.select("key", "group", "index", "n", F.explode(levels).alias("level")).where(F.col("n") > size(F.col("level")))
    asked = asked.select("key", "group", "level", F.expr("index").alias("index"), size(F.col("level")).alias("_size"))
    asked = asked.select("key", "group", "level", F.expr(f"index div _size div {fanout}").alias("run"), F.expr(f"cast((index div _size) % {fanout} as int)").alias("at"))
    parts = []
    for known in (True, False):
        chosen = [(level, run) for level, (run, n) in enumerate(forest.runs) if level >= first_level and (n <= broadcast_runs) == known]
        if chosen:
            table_ = chosen[0][1]
            for _, run in chosen[1:]:
                table_ = table_.unionByName(run)
            here = asked.where(F.col("level").isin([level for level, _ in chosen]))
            # Known: at most broadcast_runs rows a level, levels grow as the logarithm.
            parts.append(here.join(F.broadcast(table_) if known else table_, ["group", "level", "run"]).select("key", F.col("level").alias("step"), "digests", "at"))
    out = parts[0] if parts else asked.select("key", F.col("level").alias("step"), F.array().cast("array<string>").alias("digests"), "at").limit(0)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def manifest(df: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", fanout: int = FANOUT, tamper: int = 5, broadcast_runs: int = BROADCAST_RUNS) -> DataFrame:
    """One row per row of df: id_col, leaf, subroot, root, proof_sha256,
    folded_root, verified. tamper: rows whose crc32 of the id it divides have
    their text's A-Z lower-cased before the leaf is made again."""
    read = {c: F.col(c) for c in columns}
    changed = read | {text_col: F.translate(F.col(text_col), UPPER, LOWER)}
    chosen = F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("string").cast("binary")) % tamper == 0)
    group = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit(""))
    leaves = df.select(
        group.alias("group"), F.col(id_col).alias("id"), leaf_digest(list(read.values())).alias("digest"),
        F.when(chosen, leaf_digest(list(changed.values()))).alias("other"),
    )
    leaves = numbered(leaves, "group", ["id", "digest"], "manifest-leaves")
    own = build_forest(leaves, fanout, "manifest")
    tops = numbered(own.tops.select(F.lit("").alias("group"), F.col("group").alias("source"), "digest"), "group", ["source"], "manifest-sources")
    top = build_forest(tops, fanout, "manifest-top")
    root = top.tops.select("digest").first()
    root = F.lit(root[0] if root else None).cast("string")
    # The leaves of a run share all coordinates above it.
    key = F.struct("group", F.expr(f"index div {fanout}").alias("run"))
    units = leaves.groupBy(key.alias("key")).agg(F.sort_array(F.collect_list(F.struct("index", "id", "digest", "other"))).alias("leaves"), F.first("n").alias("n"))
    units = materialize(units, "manifest-units")
    # Both sides of a large source are dealt to several tasks.
    deals = F.expr(f"n div {DEAL} + 1")
    sizes = leaves.where("index = 0").select(F.col("group").alias("source"), "n")
    sources = tops.select("source", F.col("digest").alias("subroot"), F.col("index").alias("source_index"), F.col("n").alias("n_sources")).join(sizes, "source")
    sources = sources.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), deals - 1))).drop("n")
    asked = units.select("key", F.col("key.group").alias("source"), (F.col("key.run") * fanout).alias("index"), "n", (F.col("key.run") % deals).alias("deal"))
    named = materialize(asked.join(sources, ["source", "deal"]).drop("deal"), "manifest-named")
    inside = paths(named.select("key", F.col("source").alias("group"), "index", "n"), own, 1, fanout, broadcast_runs)
    above = paths(named.select("key", F.lit("").alias("group"), F.col("source_index").alias("index"), F.col("n_sources").alias("n")), top, 0, fanout, broadcast_runs)
    steps = inside.unionByName(above.withColumn("step", F.col("step") + len(own.runs))).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("step", "at", "digests"))).alias("steps"))
    found = units.join(named.select("key", "subroot"), "key").join(steps, "key", "left")
    # At level 0 the run is the unit itself; a source of one leaf has no run.
    each = found.select("n", "subroot", F.col("leaves.digest").alias("digests"), F.coalesce("steps", F.array().cast(steps.schema["steps"].dataType)).alias("steps"), F.explode("leaves").alias("leaf"))
    at = F.expr(f"cast(leaf.index % {fanout} as int)")
    first = F.when(F.col("n") > 1, F.array(F.struct(F.lit(-1).alias("step"), at.alias("at"), F.col("digests").alias("digests")))).otherwise(F.array().cast(steps.schema["steps"].dataType))
    each = each.select(F.col("leaf.id").alias(id_col), F.col("leaf.digest").alias("leaf"), F.coalesce("leaf.other", "leaf.digest").alias("_start"), "subroot", root.alias("root"), F.concat(first, "steps").alias("_steps"))
    before, after = lambda x: joined(F.slice(x["digests"], F.lit(1), x["at"])), lambda x: joined(F.slice(x["digests"], x["at"] + 2, F.size(x["digests"])))
    proof = F.sha2(F.array_join(F.transform("_steps", lambda x: F.concat(before(x), after(x))), ""), 256)
    folded = F.aggregate("_steps", F.col("_start"), lambda h, x: F.sha2(F.concat(before(x), h, after(x)), 256))
    each = each.select(id_col, "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return each.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def _op13_sql(levels: int = 5, top_levels: int = 3) -> str:
    """Levels are unrolled: 16^levels leaves a source, 16^top_levels sources."""
    enc = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    leaf = lambda text: "sha256(" + " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    crc = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
      lambda r, b: list_reduce(list_prepend(xor(r, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)))"""

    def tree(name: str, count: int) -> str:
        """{name}{l}: g, i, h of level l, n nodes there; of {name}0."""
        return ",\n".join(
            f"{name}{k} AS (SELECT g, i // 16 AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, (any_value(n) + 15) // 16 AS n FROM {name}{k - 1} GROUP BY g, i // 16)" for k in range(1, count + 1)
        )

    def siblings(name: str, k: int) -> str:
        """{name}s{k}: what stands left and right of a node in its run; no row
        for the last node of a group."""
        return f"""{name}s{k} AS (SELECT a.g, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
          FROM {name}{k} a JOIN {name}{k} b ON a.g = b.g AND a.i // 16 = b.i // 16 WHERE a.n > 1 GROUP BY a.g, a.i)"""

    steps = [("own", k, "p.g", f"p.i // {16**k}") for k in range(levels)] + [("top", k, "0", f"p.s // {16**k}") for k in range(top_levels)]
    folds, last = [], "f0"
    for j, (name, k, g, i) in enumerate(steps, 1):
        folds.append(
            f"f{j} AS (SELECT p.rid, p.doc_id, p.leaf, p.g, p.i, p.s, p.proof || coalesce(x.l || x.r, '') AS proof, CASE WHEN x.l IS NULL THEN p.h ELSE sha256(x.l || p.h || x.r) END AS h FROM {last} p LEFT JOIN {name}s{k} x ON x.g = {g} AND x.i = {i})"
        )
        last = f"f{j}"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, *, {leaf("text")} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {leaf(low)} END AS other FROM documents),
src AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM (SELECT DISTINCT source FROM documents)),
pl AS (SELECT d.rid, d.doc_id, leaf, other, s, s AS g, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY s) AS n FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source),
own0 AS (SELECT g, i, leaf AS h, n FROM pl),
{tree("own", levels)},
top0 AS (SELECT 0 AS g, g AS i, h, count(*) OVER () AS n FROM own{levels}),
{tree("top", top_levels)},
{", ".join(siblings(name, k) for name, k, _, _ in steps)},
f0 AS (SELECT rid, doc_id, leaf, g, i, s, '' AS proof, coalesce(other, leaf) AS h FROM pl),
{", ".join(folds)}
SELECT f.doc_id, f.leaf, own{levels}.h AS subroot, top{top_levels}.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = top{top_levels}.h AS verified
FROM {last} f JOIN own{levels} ON own{levels}.g = f.g CROSS JOIN top{top_levels}"""


OP13_SQL = _op13_sql()
