"""Near-duplicate vectors by a subspace pigeonhole join.

Vectors are scaled to length 1, so cosine >= c means squared distance <= T =
2 - 2c. A fixed random rotation spreads the distance evenly over the
dimensions; the rotated vector is cut into blocks. If every block distance
exceeded its share of T (in proportion to its dimensions), the sum would exceed
T; so every wanted pair is within budget in at least one block.

The vectors of a label are dealt to chunks of bounded size, and each two chunks
meet in one task, which does all blocks: a vector is sent once for each chunk of
its label, and once in all where the label fits one chunk. Within a task every
block is range-joined: two vectors within a block's budget are within its radius
in each of its coordinates. A coordinate is cut into ranges of equal count, and
for each range a bitmap tells the vectors below it; the vectors within the
radius are the difference of two bitmaps, and those near in all coordinates are
the intersection over the block, 64 vectors an instruction. Only what is left is
compared by block distance, and only pairs within the budget of some block are
candidates, verified by their exact cosine in double precision.

A task sends the number of links of each vector and a spanning set of its links,
never all pairs. Copies of one vector under one label are one vector with a
count from the start.

Only vectors with equal, non-null labels and equal length are compared.

Nulls and odd rows: vectors that are null, empty or zero, or hold null or
non-finite components, and those with a null label or id, link with nothing;
their component is their id. Very large and very small components are scaled
before lengths are taken. Rows that repeat an id with the same vector and label
count once, and each gets the same result; an id with several vectors has the
links of all of them, its own among each other included. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import materialize, table
from docloom.llm.components import connected_components

COSINE = 0.93
BLOCKS = 8
#: Numbers in the vectors of a chunk: 8,192 vectors of 64.
CHUNK = 2**19
RANGES = 64
SEED = 20_017


@lru_cache(maxsize=64)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def block_bounds(dim: int, blocks: int) -> list[tuple[int, int]]:
    """First and end dimension of each block; no more blocks than dimensions."""
    cuts = np.linspace(0, dim, min(blocks, dim) + 1).astype(int)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def budgets(dim: int, blocks: int, cosine: float) -> np.ndarray:
    """The squared-distance budget of each block, with room for rounding."""
    total = max(0.0, 2 - 2 * cosine)
    return np.array([total * (e - b) / dim for b, e in block_bounds(dim, blocks)]) * (1 + 1e-9) + 1e-12


def unit_vectors(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in the same directions; no row is zero."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class RangeIndex:
    """Bitmaps of the rows of y below each of some cuts, for one coordinate."""

    def __init__(self, values: np.ndarray, ranges: int = RANGES):
        order = np.argsort(values, kind="stable")
        at = np.unique(np.linspace(0, len(values), min(ranges, len(values)) + 1).astype(int))
        rank = np.empty(len(values), int)
        rank[order] = np.arange(len(values))
        self.below = np.packbits(rank[None] < at[:, None], axis=1)
        ordered = values[order]
        # A range holds the values from its first to its last, both included.
        self.first, self.last = ordered[at[:-1]], ordered[at[1:] - 1]

    def within(self, values: np.ndarray, radius: float) -> np.ndarray:
        """A bitmap for each value: at least all rows within the radius."""
        low = np.searchsorted(self.last, values - radius, "left")
        high = np.searchsorted(self.first, values + radius, "right")
        return self.below[np.maximum(high, low)] & ~self.below[low]


def block_candidates(y: np.ndarray, rows: np.ndarray, z: np.ndarray, indexes: list[RangeIndex], limit: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(i, j) with rows[i] of y within the budget of row j of z in one block,
    and how many pairs were compared. indexes: of z, one a coordinate."""
    radius = np.sqrt(limit)
    near = indexes[0].within(y[rows, 0], radius)
    for k in range(1, y.shape[1]):
        near &= indexes[k].within(y[rows, k], radius)
    flat = near.ravel()
    some = np.flatnonzero(flat)
    byte, bit = np.nonzero(np.unpackbits(flat[some][:, None], axis=1))
    place = some[byte] * 8 + bit
    i, j = np.divmod(place, near.shape[1] * 8)
    inside = j < len(z)  # not the padding of a row's last byte
    i, j = i[inside], j[inside]
    apart = y[rows[i]] - z[j]
    close = (apart * apart).sum(axis=1) <= limit
    return i[close], j[close], len(i)


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest position that each of n reaches over links a-b."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def join_chunks(u: np.ndarray, left: np.ndarray, right: np.ndarray, ids: np.ndarray, copies: np.ndarray, blocks: int, cosine: float) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """The links between the rows `left` and the rows `right` of the unit
    vectors u; each pair once where these are the same rows. Gives the number of
    links of each row (copies counted), a spanning set of the links as two rows
    of positions, and how many pairs there were at each step."""
    turned = u @ rotation(u.shape[1])
    bounds, limits = block_bounds(u.shape[1], blocks), budgets(u.shape[1], blocks, cosine)
    same = len(left) == len(right) and bool((left == right).all())
    indexes = [[RangeIndex(turned[right, c]) for c in range(b, e)] for b, e in bounds]
    counts, links, done = np.zeros(len(ids), np.int64), [], {"compared": 0, "candidates": 0, "links": 0}
    step = max(1, 2**20 // max(1, len(right)))
    for at in range(0, len(left), step):
        rows = left[at : at + step]
        found = np.zeros((len(rows), len(right)), dtype=bool)
        for (b, e), own, limit in zip(bounds, indexes, limits, strict=True):
            i, j, compared = block_candidates(turned[:, b:e], rows, turned[right, b:e], own, limit)
            found[i, j] = True
            done["compared"] += compared
        i, j = np.nonzero(found)
        ordered = ids[rows[i]] < ids[right[j]] if same else ids[rows[i]] != ids[right[j]]
        i, j = i[ordered], j[ordered]
        done["candidates"] += len(i)
        if len(i) > 0.05 * found.size:  # so many that all at once is less work
            close = (u[rows] @ u[right].T)[i, j] >= cosine
        else:
            close = np.concatenate([np.einsum("ij,ij->i", u[rows[i[k : k + 65_536]]], u[right[j[k : k + 65_536]]]) for k in range(0, len(i), 65_536)] or [np.zeros(0)]) >= cosine
        x, z = rows[i[close]], right[j[close]]
        done["links"] += len(x)
        if len(x):
            np.add.at(counts, x, copies[z])
            np.add.at(counts, z, copies[x])
            root = spanning(x, z, len(ids))
            moved = np.flatnonzero(root != np.arange(len(ids)))
            links.append(np.stack([root[moved], moved]))
    pairs = np.concatenate(links, axis=1) if links else np.zeros((2, 0), np.int64)
    return counts, np.unique(pairs, axis=1), done


def _chunk_links(blocks: int, cosine: float):
    def run(key: tuple[pa.Scalar, ...], tile: pa.Table) -> pa.Table:
        i, j = key[2].as_py(), key[3].as_py()
        ids, copies, chunk = (tile.column(c).to_numpy() for c in ("vec_id", "copies", "chunk"))
        u = unit_vectors(tile.column("vector").combine_chunks().flatten().to_numpy().reshape(len(ids), -1))
        counts, pairs, _ = join_chunks(u, np.flatnonzero(chunk == i), np.flatnonzero(chunk == j), ids, copies, blocks, cosine)
        some = np.flatnonzero(counts)
        return pa.table({
            "a": pa.array(np.concatenate([ids[pairs[0]], ids[some]])), "b": pa.array(np.concatenate([ids[pairs[1]], ids[some]])),
            "links": pa.array(np.concatenate([np.zeros(pairs.shape[1], np.int64), counts[some]])),
        })

    return run


def vector_links(vectors: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, chunk: int | None = None) -> DataFrame:
    """(a, b, links) from vectors (vec_id, label, copies, vector): rows with
    a <> b are a spanning set of the links, rows with a = b numbers of linked
    vectors, to be summed. chunk: numbers in the vectors of a chunk."""
    sized = vectors.withColumn("dim", F.size("vector"))
    chunks = F.ceil(F.count("*") * F.col("dim") / F.lit(chunk or CHUNK)).cast("int")
    counts = materialize(sized.groupBy("label", "dim").agg(chunks.alias("chunks")), "label-chunks")
    dealt = sized.join(counts, ["label", "dim"]).withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int"))
    other = F.sequence(F.lit(0), F.col("chunks") - 1)
    tiles = dealt.withColumn("other", F.explode(other)).withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))
    return tiles.select("vec_id", "label", "copies", "vector", "dim", "chunk", "i", "j").groupBy("label", "dim", "i", "j").applyInArrow(_chunk_links(blocks, cosine), "a long, b long, links long")


def link_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, blocks: int = BLOCKS) -> DataFrame:
    """One row per row of df: vec_id, n_links, component_id, kept."""
    v = F.col(vector_col)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda x: x != 0))
    usable = usable.distinct().withColumn("vkey", F.md5(F.array_join(F.transform("vector", lambda x: F.hex(F.xxhash64(x))), "").cast("binary")))
    usable = materialize(usable, "vectors")
    copies = materialize(usable.groupBy("label", "vkey").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")), "vector-copies")
    heads = usable.join(copies, ["label", "vkey"]).where("vec_id = first").select("vec_id", "label", "copies", "vector")
    found = materialize(vector_links(heads, cosine, blocks), "vector-links")
    totals = found.where("a = b").groupBy(F.col("a").alias("first")).agg(F.sum("links").alias("near"))
    # One id may come with several vectors: links that an id has with itself go.
    groups = connected_components(found.where("a <> b").select("a", "b"))
    named = copies.join(totals, "first", "left").join(groups, F.col("first") == F.col("node"), "left")
    named = materialize(named.select("label", "vkey", (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "first").alias("component")), "vector-classes")
    mine = usable.select("vec_id", "label", "vkey").join(named, ["label", "vkey"]).groupBy("vec_id").agg(F.sum("links").alias("n_links"), F.min("component").alias("component_id"))
    result = rows.select("vec_id").join(mine, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return result.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op5_subspace_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
r AS (
  WITH RECURSIVE reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.x, p.y FROM reach JOIN p ON reach.y = p.x)
  SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT e.vec_id, (SELECT count(*) FROM p WHERE p.x = e.vec_id) AS n_links, r.c AS component_id, e.vec_id = r.c AS kept
FROM embeddings e JOIN r ON e.vec_id = r.x
"""
