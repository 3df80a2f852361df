"""Near-duplicate documents by DartMinHash over weighted word shingles.

A document is the multiset of its shingles of five words (lower case, split at
white space); its weight vector has the number of times each shingle occurs.
Similarity is weighted Jaccard, sum of minima over sum of maxima.

DartMinHash throws hashed darts at the plane (element x weight x rank). The
plane is tiled by regions whose weight range and rank range double from one to
the next; the hash of an element and a region says how many darts fall there
(Poisson), and the hash of each dart its weight, rank and coordinate. A dart
counts for a document if its weight lies below the document's weight of that
element; each of the k coordinates keeps the dart of lowest rank. Two documents
agree in a coordinate with probability equal to their weighted Jaccard
similarity. Regions are visited by rank until every coordinate is filled, so a
document costs about k log k darts plus its length.

Copies (equal word sequences) are one text from here on. 48 bands of 8
coordinates put texts into buckets: a pair of similarity 0.8 meets in some band
with probability 0.9998, one of similarity 0.4 with 0.03. In a bucket of up to
SMALL texts all pairs are candidates. In a larger one every text is first paired
with two leaders (smallest id, and the text with most company in all its
buckets, such as the base of many versions). What these links join is a
class; all pairs of a bucket that lie in different classes are still open. Where
many are, further rounds of leaders come first, as long as each halves them. The
texts that are left are joined once more among each other by an exact prefix
filter on their shingles (see prefix_entries), in tiles of bounded size. So
every pair of a bucket is compared, ruled out, or joined by other links. Candidates whose total weights alone rule out
the threshold go, the rest is compared exactly by whole texts. Leaders with many
partners are dealt to several tasks.

Nulls and odd rows: a null text or one without words is a class of its own; so
is a row with a null id (class null). A text shorter than a shingle is one
shingle. Rows that repeat an id are one document: each of its texts is searched,
and it belongs to the classes of all. Ids from 2**62 on are kept for such texts.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.batches import Recent, map_rows, parts, strings
from docloom.llm.common import materialize, table
from docloom.llm.components import connected_components

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 48
ROWS = 8
SMALL = 16
PER_TASK = 256
TILE = 512
#: Open pairs for each entry of a bucket beyond which leaders are tried again.
OPEN = 16
#: Shingles that a task holds at a time.
HELD = 500_000

U = np.uint64
GOLDEN = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = x + GOLDEN
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1 from 64-bit hashes."""
    return ((x >> U(11)).astype(np.float64) + 0.5) / 2.0**53


class Words(Recent):
    """64-bit hashes of words."""

    def make(self, word: str) -> int:
        return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


_words = Words()


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, count), ordered by text and hash."""
    docs, hashes = [], []
    for i, text in enumerate(texts):
        words = (text or "").lower().split()
        if not words:
            continue
        h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
        n = max(len(h) - SHINGLE + 1, 1)
        s = np.full(n, len(words) if len(h) < SHINGLE else SHINGLE, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(min(SHINGLE, len(h))):
                s = mix(s ^ h[k : k + n])
        s, counts = np.unique(s, return_counts=True)
        docs.append((i, len(s)))
        hashes.append((s, counts))
    if not docs:
        return np.zeros(0, int), np.zeros(0, U), np.zeros(0, int)
    return np.repeat([i for i, _ in docs], [n for _, n in docs]), np.concatenate([s for s, _ in hashes]), np.concatenate([c for _, c in hashes])


def _poisson_steps(mean: float) -> np.ndarray:
    """The distribution function of a Poisson number, up to nearly 1."""
    top = int(mean + 12 * mean**0.5 + 30)
    k = np.arange(top + 1)
    logs = k * np.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(k[1:]))])
    return np.cumsum(np.exp(logs))


FIRST_RANK = 2.0**-6


def dart_sketch(docs: np.ndarray, elements: np.ndarray, weights: np.ndarray, n_docs: int, k: int = BANDS * ROWS) -> np.ndarray:
    """The lowest dart of each coordinate, of shape (n_docs, k): rank in the
    upper, identity in the lower 32 bits. docs: rows of one document together;
    weights: positive. Documents without elements keep the largest number."""
    empty = U(0xFFFFFFFFFFFFFFFF)
    best = np.full(n_docs * k, empty, dtype=U)
    # Weight layers [0, 1), [1, 2), [2, 4), ...: an element is in those that
    # begin below its weight.
    layers = [(0, 0.0, 1.0)]
    while (low := layers[-1][1] + layers[-1][2]) < weights.max(initial=0):
        layers.append((len(layers), low, low))
    rows = [(docs[m], elements[m], weights[m], layer) for layer in layers if (m := weights > layer[1]).any()]
    active = np.zeros(n_docs, dtype=bool)
    active[docs] = True
    window, begin, length = 0, 0.0, FIRST_RANK
    with np.errstate(over="ignore"):
        while active.any() and rows:
            rows = [(d[m], e[m], w[m], layer) for d, e, w, layer in rows if (m := active[d]).any()]
            for d, e, w, (layer, low, width) in rows:
                region = mix(e ^ mix(np.array([layer << 32 | window], dtype=U)))
                number = np.searchsorted(_poisson_steps(width * length), unit(region))
                hit = np.flatnonzero(number)
                number = number[hit]
                total = int(number.sum())
                if not total:
                    continue
                source = np.repeat(hit, number)
                turn = np.arange(total) - np.repeat(np.cumsum(number) - number, number)
                dart = mix(region[source] + turn.astype(U) * GOLDEN)
                if layer:
                    under = low + width * unit(mix(dart ^ U(1))) < w[source]
                    source, dart = source[under], dart[under]
                place = d[source] * k + (dart % U(k)).astype(np.int64)
                rank = (begin + length * unit(mix(dart ^ U(2)))).astype(np.float32)
                np.minimum.at(best, place, rank.view(np.uint32).astype(U) << U(32) | dart >> U(32))
            active &= (best.reshape(n_docs, k) == empty).any(axis=1)
            begin, length, window = begin + length, begin + length, window + 1
    return best.reshape(n_docs, k)


def band_keys(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of each document."""
    parts = sketch.reshape(len(sketch), bands, -1)
    key = np.broadcast_to(np.arange(bands, dtype=U), parts.shape[:2])
    with np.errstate(over="ignore"):
        for i in range(parts.shape[2]):
            key = mix(key ^ parts[:, :, i])
    return key


def sketch_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, raw (hash of the text as it is), copy_key (equal for equal word
    sequences), weight, bands."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = strings(batch, "_text")
        docs, elements, counts = shingles(texts)
        weight = np.bincount(docs, weights=counts, minlength=len(texts)).astype(np.int64)
        keys = [hashlib.md5(" ".join(t.lower().split()).encode("utf-8", "surrogatepass")).hexdigest() if n else None for t, n in zip(texts, weight, strict=True)]
        bands = band_keys(dart_sketch(docs, elements, counts, len(texts))).view(np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.where(weight > 0, BANDS, 0))]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(keys, pa.string()), pa.array(weight), pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[weight > 0].ravel()))],
            ["doc_id", "raw", "copy_key", "weight", "bands"],
        )

    chosen = df.select(F.col(id_col).cast("long").alias("doc_id"), raw_hash(F.col(text_col)).alias("raw"), F.col(text_col).alias("_text"))
    return map_rows(chosen, run, "doc_id long, raw long, copy_key string, weight long, bands array<long>", 128)  # bounds the darts in memory


def raw_hash(text: Column) -> Column:
    return F.xxhash64(text)


def shared_buckets(texts: DataFrame) -> DataFrame:
    """(bucket, doc_id, weight, n): the entries of texts (doc_id, weight, bands)
    in buckets of n > 1 texts."""
    entries = texts.select("doc_id", "weight", F.explode("bands").alias("bucket"))
    # Counted alone first: nearly all buckets hold one text and are done with.
    buckets = materialize(entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    return materialize(entries.join(buckets, "bucket"), "bucket-entries")


def wanted(pairs: DataFrame, x: Column, y: Column, threshold: float) -> DataFrame:
    """(a, b), a < b, of the structs x and y (doc_id, weight) in pairs."""
    # sum of minima <= smaller weight, sum of maxima >= larger weight
    pairs = pairs.where((x["doc_id"] != y["doc_id"]) & (F.least(x["weight"], y["weight"]) >= F.greatest(x["weight"], y["weight"]) * threshold))
    return pairs.select(F.least(x["doc_id"], y["doc_id"]).alias("a"), F.greatest(x["doc_id"], y["doc_id"]).alias("b")).distinct()


def small_pairs(shared: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All pairs of the small buckets."""
    one = shared.where(F.col("n") <= SMALL).select("bucket", F.struct("doc_id", "weight").alias("x"))
    two = one.select("bucket", F.col("x").alias("y"))
    pairs = one.join(two, (one["bucket"] == two["bucket"]) & (F.col("x.doc_id") < F.col("y.doc_id"))).select("x", "y")
    return wanted(pairs, F.col("x"), F.col("y"), threshold)


def leader_pairs(large: DataFrame, turn: int, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs of two leaders of each bucket with all its other classes.
    large: bucket, doc_id, weight, n, class_id."""
    one = F.struct("doc_id", "weight", "class_id")
    if turn == 0:
        company = large.groupBy("doc_id").agg(F.sum("n").alias("company"))
        large = large.join(company, "doc_id")
        chosen = [F.min(one), F.max_by(one, F.struct("company", "doc_id"))]
    else:
        chosen = [F.min_by(one, F.xxhash64("doc_id", F.lit(2 * turn + k))) for k in range(2)]
    leaders = materialize(large.groupBy("bucket").agg(F.array_distinct(F.array(*chosen)).alias("leaders")), "bucket-leaders")
    pairs = large.join(leaders, "bucket").select(one.alias("x"), F.explode("leaders").alias("y")).where("x.class_id <> y.class_id")
    return wanted(pairs, F.col("x"), F.col("y"), threshold)


def open_pairs(large: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All pairs of a bucket that lie in different classes and may reach the
    threshold. A tile is two chunks of a bucket, so no key of the join has more
    than about TILE by TILE pairs. large: bucket, doc_id, weight, n, class_id,
    and at, how much of the weight is not shared with others of the bucket."""
    chunks = F.ceil(F.col("n") / TILE).cast("int")
    at = large.select("bucket", F.struct("doc_id", "weight", "class_id", "at").alias("x"), chunks.alias("chunks"), F.pmod(F.xxhash64("doc_id"), chunks).cast("int").alias("chunk"))
    left = at.select("bucket", F.col("chunk").alias("i"), F.explode(F.sequence("chunk", F.col("chunks") - 1)).alias("j"), "x")
    right = at.select("bucket", F.explode(F.sequence(F.lit(0), "chunk")).alias("i"), F.col("chunk").alias("j"), F.col("x").alias("y"))
    keys = (left["bucket"] == right["bucket"]) & (left["i"] == right["i"]) & (left["j"] == right["j"])
    shared = F.least(F.col("x.weight") - F.col("x.at"), F.col("y.weight") - F.col("y.at"))
    near = shared * (1 + threshold) >= (F.col("x.weight") + F.col("y.weight")) * threshold - 1e-6
    once = (left["i"] < left["j"]) | (F.col("x.doc_id") < F.col("y.doc_id"))
    pairs = left.join(right, keys & once & near & (F.col("x.class_id") != F.col("y.class_id"))).select("x", "y")
    return wanted(pairs, F.col("x"), F.col("y"), threshold)


def prefix_entries(texts: DataFrame, elements: int, threshold: float = THRESHOLD) -> DataFrame:
    """Entries as open_pairs takes them, in which each two of the texts (doc_id,
    class_id, text) that reach the threshold share a bucket. elements: about how
    many shingles the texts have in all.

    The shingles of all texts are put in one order, rare ones first. Two texts
    that reach the threshold share one among the first few of both: of a text of
    weight w, the first w - ceil(t w) + 1. Shingles that only one text has come
    first and are no buckets. Before the first shared one nothing is shared
    (`at`). Texts are dealt to parts of about HELD shingles; a part sends each of
    its shingles once, and gets back in how many texts it is."""
    n_parts = int(elements // HELD) + 1

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs, found, counts = shingles(strings(batch, "text"))
        # The k-th occurrence of a shingle is an element of its own.
        turn = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        with np.errstate(over="ignore"):
            tokens = mix(np.repeat(found, counts) ^ mix(turn.astype(U))).view(np.int64)
        ends = np.searchsorted(np.repeat(docs, counts), np.arange(batch.num_rows + 1)).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), listed], ["part", "doc_id", "class_id", "tokens"])

    def flat(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        tokens = part.column("tokens").combine_chunks()
        return np.repeat(np.arange(part.num_rows), np.asarray(tokens.value_lengths())), np.asarray(tokens.flatten())

    def count(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        tokens, counts = np.unique(flat(part)[1], return_counts=True)
        return pa.table({"part": np.full(len(tokens), key[0].as_py()), "token": tokens, "n": counts})

    def first(key: tuple[pa.Scalar, ...], part: pa.Table, known: pa.Table) -> pa.Table:
        docs, tokens = flat(part)
        weight = np.bincount(docs, minlength=part.num_rows)
        shared, texts = known.column("token").to_numpy(), known.column("texts").to_numpy()
        order = np.argsort(shared)
        place = np.minimum(np.searchsorted(shared, tokens, sorter=order), max(len(shared) - 1, 0))
        here = order[place] if len(shared) else place
        n = np.where(shared[here] == tokens, texts[here], 1) if len(shared) else np.ones(len(tokens), int)
        order = np.lexsort((tokens, n, docs))
        docs, tokens, n = docs[order], tokens[order], n[order]
        at = np.arange(len(docs)) - (np.cumsum(weight) - weight)[docs]
        kept = (n > 1) & (at <= weight[docs] - np.ceil(weight[docs] * threshold - 1e-6))
        of = docs[kept]
        column = lambda name: part.column(name).to_numpy()[of]
        return pa.table({"bucket": tokens[kept], "doc_id": column("doc_id"), "weight": weight[of], "class_id": column("class_id"), "at": at[kept]})

    dealt = texts.select(F.pmod(F.xxhash64("doc_id"), F.lit(n_parts)).cast("long").alias("part"), "doc_id", "class_id", "text")
    listed = materialize(map_rows(dealt, split, "part long, doc_id long, class_id long, tokens array<long>"), "open-elements")
    counted = materialize(listed.select("part", "tokens").groupBy("part").applyInArrow(count, "part long, token long, n long"), "element-counts")
    common = counted.groupBy("token").agg(F.sum("n").alias("texts")).where("texts > 1")
    known = counted.join(common, "token").select("part", "token", "texts")
    entries = listed.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(first, "bucket long, doc_id long, weight long, class_id long, at long")
    entries = materialize(entries, "prefix-elements")
    return entries.join(entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket")


def text_classes(texts: DataFrame, docs: Texts, threshold: float = THRESHOLD) -> DataFrame:
    """(node, component) of the texts (doc_id, weight, bands) that have a near
    duplicate; docs: see Texts."""
    shared = shared_buckets(texts)
    large = shared.where(F.col("n") > SMALL)
    first = leader_pairs(large.withColumn("class_id", F.col("doc_id")), 0, threshold)
    classes = connected_components(verify_pairs(small_pairs(shared, threshold).union(first).distinct(), docs, threshold))
    turn, before = 0, None
    while True:
        named = large.join(classes, F.col("doc_id") == F.col("node"), "left").select("bucket", "doc_id", "weight", "n", F.coalesce("component", "doc_id").alias("class_id"))
        sizes = named.groupBy("bucket", "class_id").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("inside"))
        open_ = materialize(sizes.where("n * n > inside").withColumn("open", (F.col("n") * F.col("n") - F.col("inside")) / 2), "open-buckets")
        entries, still = open_.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("open"), F.lit(0.0))).first()
        if not still:
            return classes
        rest = materialize(named.join(open_.select("bucket"), "bucket"), "open-entries")
        turn += 1
        last = still <= OPEN * entries or (before is not None and 2 * still > before)
        before = still
        if last:
            nodes = materialize(rest.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("own"), "class_id", "weight").distinct(), "open-texts")
            elements = nodes.agg(F.sum("weight")).first()[0]
            left = docs.join(nodes.drop("weight")).select(F.col("own").alias("doc_id"), "class_id", "text")
            pairs = open_pairs(prefix_entries(left, elements, threshold), threshold)
        else:
            pairs = leader_pairs(rest, turn, threshold)
        found = verify_pairs(pairs, docs, threshold)
        classes = connected_components(classes.select(F.col("component").alias("a"), F.col("node").alias("b")).union(found))
        if last:
            return classes


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted elements, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = int(np.minimum(a[1][i], b[1][j]).sum())
    return low / (int(a[1].sum()) + int(b[1].sum()) - low)


def verify_pairs(pairs: DataFrame, texts: Texts, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) of nodes of at least the threshold, by their texts. A
    leader a meets its partners in groups of about PER_TASK; its text is sent
    once to each group."""
    pairs = materialize(pairs, "pairs")
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / PER_TASK).alias("groups"))
    groups = materialize(groups, "pair-groups")
    leaders = groups.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0), F.col("groups").cast("int") - 1)).alias("part"), F.lit(None).cast("long").alias("b"))
    partners = pairs.join(groups, "a").select(F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("part"), "b")
    # Texts meet the places that want them in one join, and then go there.
    placed = texts.join(leaders.unionByName(partners)).select("a", "part", "b", "text")
    rows = placed.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, now = None, None
        for batch in parts(batches):
            a, b = strings(batch, "a"), strings(batch, "b")
            docs, elements, counts = shingles(strings(batch, "text"))
            ends = np.searchsorted(docs, np.arange(len(a) + 1))
            out = []
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                mine = (elements[ends[i] : ends[i + 1]], counts[ends[i] : ends[i + 1]])
                if y is None:
                    leader, now = x, mine
                elif leader == x and jaccard(now, mine) >= threshold:
                    out.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return rows.mapInArrow(compare, "a long, b long")


#: Nodes from here on are texts whose id belongs to another text, too.
EXTRA = 2**62


@dataclass
class Texts:
    """Where the text of each node is. docs: doc_id, raw, text. extra: (node,
    doc_id, raw) of the texts that are not alone with their id. repeated:
    (doc_id, raw) of rows that repeat; both None if there are none."""

    docs: DataFrame
    extra: DataFrame | None = None
    repeated: DataFrame | None = None

    def join(self, places: DataFrame) -> DataFrame:
        """places (node, ...) with text, one row for each place."""
        docs = self.docs
        if self.repeated is not None:
            twice = docs.join(self.repeated, ["doc_id", "raw"], "left_semi").groupBy("doc_id", "raw").agg(F.min("text").alias("text"))
            docs = docs.join(self.repeated, ["doc_id", "raw"], "left_anti").unionByName(twice)
        if self.extra is None:
            return docs.join(places.withColumnRenamed("node", "doc_id"), "doc_id")
        alone = places.join(self.extra, "node", "left_anti").withColumnRenamed("node", "doc_id")
        beside = places.join(self.extra, "node")
        return docs.join(alone, "doc_id").drop("raw").unionByName(docs.join(beside, ["doc_id", "raw"]).drop("raw", "node"))


def _classes(df: DataFrame, id_col: str, text_col: str, threshold: float, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, raw, copy_key) and for each copy_key its first row
    (doc_id, raw), node, n_copies and class (the smallest node of its class).
    by_id: all texts of an id are in one class."""
    sketches = materialize(sketch_documents(df, id_col, text_col), "sketches")
    known = sketches.where(F.col("doc_id").isNotNull() & F.col("copy_key").isNotNull())
    copies = materialize(known.groupBy("copy_key").agg(F.min(F.struct("doc_id", "raw")).alias("first"), F.count("*").alias("n_copies")).select("copy_key", "first.*", "n_copies"), "copies")
    rows = materialize(known.groupBy("doc_id", "raw").agg(F.count("*").alias("n"), F.min("copy_key").alias("copy_key")), "text-rows")
    several = rows.groupBy("doc_id").agg(F.count("*").alias("texts")).where("texts > 1").select("doc_id")
    # Ids with one text, as nearly all are, are their own nodes.
    shared = materialize(rows.join(several, "doc_id", "left_semi"), "shared-ids")
    many = bool(shared.limit(1).count())
    node = F.when(F.col("shared"), F.lit(EXTRA) + F.pmod(F.xxhash64("copy_key", "raw"), F.lit(EXTRA))).otherwise(F.col("doc_id"))
    marked = copies.join(shared.select("doc_id").distinct().withColumn("mark", F.lit(True)), "doc_id", "left").withColumn("shared", F.col("mark").isNotNull()) if many else copies.withColumn("shared", F.lit(False))
    nodes = materialize(marked.select("copy_key", "doc_id", "raw", "n_copies", "shared", node.alias("node")), "nodes")
    repeated = rows.where("n > 1").select("doc_id", "raw")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), raw_hash(F.col(text_col)).alias("raw"), F.col(text_col).alias("text"))
    texts = Texts(docs, nodes.where("shared").select("node", "doc_id", "raw") if many else None, repeated if repeated.limit(1).count() else None)
    sketched = known.select("doc_id", "raw", "copy_key", "weight", "bands").join(nodes.select("copy_key", "doc_id", "raw", "node"), ["copy_key", "doc_id", "raw"])
    sketched = (sketched.dropDuplicates(["node"]) if texts.repeated is not None else sketched).select(F.col("node").alias("doc_id"), "weight", "bands")
    classes = text_classes(sketched, texts, threshold)
    if many and by_id:  # the texts of one id are one document
        own = shared.join(nodes.select("copy_key", "node"), "copy_key").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
        classes = connected_components(classes.select(F.col("component").alias("a"), F.col("node").alias("b")).union(own))
    named = nodes.join(classes.withColumnRenamed("node", "found"), F.col("node") == F.col("found"), "left")
    named = named.select("copy_key", F.col("doc_id").alias("first_id"), F.col("raw").alias("first_raw"), "node", "n_copies", F.coalesce("component", "node").alias("class_id"))
    return sketches.select("doc_id", "raw", "copy_key"), materialize(named, "classes")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of df: doc_id, class_id (the smallest id of its class),
    n_copies (rows with its word sequence), kept (doc_id is class_id)."""
    rows, named = _classes(df, id_col, text_col, threshold, by_id=True)
    joined = rows.join(named, "copy_key", "left")
    class_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    return joined.select("doc_id", class_id.alias("class_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce(F.col("doc_id") == class_id, F.lit(True)).alias("kept"))


def near_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of df: doc_id, raw (raw_hash of its text), kept. Texts
    that share an id are told apart; of each class the rows of one (doc_id, raw)
    are kept, the one of smallest id where ids are not shared."""
    rows, named = _classes(df, id_col, text_col, threshold, by_id=False)
    first = (F.col("node") == F.col("class_id")) & (F.col("doc_id") == F.col("first_id")) & (F.col("raw") == F.col("first_raw"))
    return rows.join(named, "copy_key", "left").select("doc_id", "raw", F.coalesce(first, F.lit(True)).alias("kept"))


def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
