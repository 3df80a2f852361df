"""Divergence of the sources of a language by a byte-level tokenizer.

A lookup table over the bytes of many texts at once says which belong to a term
(letters A-Z, a-z and all bytes of other scripts), and where that changes, or a
text ends, a term begins or ends. A 64-bit xxhash groups the slices; each slice
is compared with the first of its group byte by byte, and those that differ (a
collision) are grouped by their bytes. The counts of a batch are a CSR matrix of
texts and terms, summed to (language, source, term) before anything moves.

Kept terms of a language are dealt to blocks by hash. A block has all sources of
its language as a CSR matrix (rows: sources). The distance of a source to all
others is one gather and one `reduceat` over the stored entries; where the other
source has no entry its share is one constant, so those terms are summed from the
sorted shares of the first source and the entries are taken off. Blocks are added.

All arithmetic is in whole numbers. A share floor(10^9 (c + 5) / (N + 5 V)) is
found by long division, exact while N + 5 V is below 9 * 10^15; beyond, the job
stops with an error.

A block holds at most some 8,192 entries (a million where sources are very many,
as each block gives a row for each pair of sources), whatever the language's
size; the number of blocks follows from the count of entries. The pairs of
sources are the result itself.

Nulls and odd rows: a null text, language or source is ''. Repeated rows are
separate documents. A source without terms, and a language without kept terms,
have their pairs. A language of one source has no pairs. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.batches import map_rows
from docloom.llm.common import materialize, table

SCALE_STEPS = 3  # thousands in 10^9
LEAST_ENTRIES, MOST_ENTRIES = 8192, 1_000_000
ROWS = 8192


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to a term, and each byte with A-Z lower-cased."""
    byte = np.arange(256)
    upper, lower = (byte >= 0x41) & (byte <= 0x5A), (byte >= 0x61) & (byte <= 0x7A)
    return upper | lower | (byte >= 0x80), np.where(upper, byte + 32, byte).astype(np.uint8)


IN_TERM, LOWERED = _tables()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings of a column and where each begins; null is ''."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def find_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of every term; none spans two texts."""
    inside = IN_TERM[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    return start, np.flatnonzero(inside & ~after) + 1, np.searchsorted(offsets, start, side="right") - 1


def group_slices(data: np.ndarray, start: np.ndarray, end: np.ndarray, digest: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, list[bytes]]:
    """The number of each slice's group, and the bytes of each group."""
    raw = data.tobytes()
    if not len(start):
        return np.zeros(0, np.int64), []
    hashes = np.fromiter((digest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)), dtype=np.uint64, count=len(start))
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    terms = [raw[start[k] : end[k]] for k in first.tolist()]
    # Byte by byte against the first slice of the group.
    head, size = first[group], end - start
    same = size == end[head] - start[head]
    checked = np.flatnonzero(same)
    length = size[checked]
    shift = np.repeat((start[head] - start)[checked].astype(np.int32), length)
    begins = np.cumsum(length) - length
    at = np.arange(int(length.sum()), dtype=np.int32) + np.repeat((start[checked] - begins).astype(np.int32), length)
    same[checked] = np.logical_and.reduceat(data[at] == data[at + shift], begins)
    if not same.all():
        known: dict[bytes, int] = {}
        for k in np.flatnonzero(~same).tolist():
            term = raw[start[k] : end[k]]
            if term not in known:
                known[term] = len(terms)
                terms.append(term)
            group[k] = known[term]
    return group, terms


def count_terms(batch: pa.RecordBatch, digest: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of a batch of lang, source, text."""
    data, offsets = utf8(batch.column(batch.schema.get_field_index("text")))
    start, end, text = find_terms(data, offsets)
    group, terms = group_slices(LOWERED[data], start, end, digest)
    # CSR: the terms of each text in order, with their counts.
    cells, counts = np.unique(text * max(len(terms), 1) + group, return_counts=True)
    row, index = cells // max(len(terms), 1), cells % max(len(terms), 1)
    owners, names = np.zeros(batch.num_rows, np.int64), {}
    for k, name in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
        owners[k] = names.setdefault(name, len(names))
    merged = owners[row] * max(len(terms), 1) + index
    order = np.argsort(merged, kind="stable")
    found, begins, docs = np.unique(merged[order], return_index=True, return_counts=True)
    n = np.add.reduceat(counts[order], begins) if len(begins) else np.zeros(0, np.int64)
    owner, term = found // max(len(terms), 1), found % max(len(terms), 1)
    langs, sources = zip(*names, strict=True) if names else ((), ())
    take = lambda values, kind, at: pa.array(values, kind).take(pa.array(at))
    return pa.RecordBatch.from_arrays([take(langs, pa.string(), owner), take(sources, pa.string(), owner), take(terms, pa.binary(), term), pa.array(n.astype(np.int64)), pa.array(docs.astype(np.int64))], ["lang", "source", "term", "n", "docs"])


def share(count: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), by long division."""
    over = np.asarray(total, np.int64) + 5 * terms
    if np.max(over, initial=0) >= 9_000_000_000_000_000:
        raise ValueError("counts are too large for exact shares")
    rest = np.asarray(count, np.int64) + 5
    out, rest = rest // over, rest % over
    for _ in range(SCALE_STEPS):
        rest = rest * 1000
        out, rest = out * 1000 + rest // over, rest % over
    return out + 1


def row_sums(values: np.ndarray, indptr: np.ndarray) -> np.ndarray:
    """The sum of each row of a CSR matrix with these values."""
    out, full = np.zeros(len(indptr) - 1, np.int64), np.diff(indptr) > 0
    if full.any():
        out[full] = np.add.reduceat(values, indptr[:-1][full])
    return out


def source_distances(indptr: np.ndarray, index: np.ndarray, p: np.ndarray, none: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each row of a CSR matrix of shares, the sum over all columns of the
    differences to each row. none: the share of a row where it has no entry."""
    rows = np.repeat(np.arange(len(none)), np.diff(indptr))
    for i in range(len(none)):
        own = slice(indptr[i], indptr[i + 1])
        dense = np.full(width, none[i], np.int64)
        dense[index[own]] = p[own]
        here = dense[index]
        ordered = np.sort(p[own])
        sums = np.concatenate([[0], np.cumsum(ordered)])
        below = np.searchsorted(ordered, none)
        # As if no other row had an entry, then corrected where it has.
        apart = none * below - sums[below] + sums[-1] - sums[below] - none * (len(ordered) - below) + (width - len(ordered)) * np.abs(none[i] - none)
        yield apart + row_sums(np.abs(here - p) - np.abs(here - none[rows]), indptr)


def compare_block(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """One block of a language: the parts of the pair sums, and the top terms of
    the block for each source."""
    t = pa.Table.from_batches(list(batches))
    is_term = pc.is_valid(t["term"])
    info, entries = t.filter(pc.invert(is_term)), t.filter(is_term)
    lang, names = t["lang"][0].as_py(), info["source"].to_pylist()
    place = {s: k for k, s in enumerate(names)}
    total, v, lang_total = info["n"].to_numpy(), info["v"][0].as_py(), info["lang_n"][0].as_py()
    coded = entries["term"].combine_chunks().dictionary_encode() if entries.num_rows else None
    terms = coded.dictionary.to_pylist() if coded is not None else []
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) if coded is not None else np.zeros(0, np.int64)
    row = np.array([place[s] for s in entries["source"].to_pylist()], np.int64)
    order = np.lexsort((index, row))
    row, index, n = row[order], index[order], entries["n"].to_numpy()[order]
    indptr = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(names)))])
    fields = ["lang", "source", "part", "item", "value"]

    def rows(source: list, part: str, item: list, value: np.ndarray) -> pa.RecordBatch:
        same = lambda x: pa.array([x] * len(item), pa.string())
        return pa.RecordBatch.from_arrays([same(lang), pa.array(source, pa.string()), same(part), pa.array(item, pa.binary()), pa.array(value, pa.int64())], fields)

    encoded = [s.encode() for s in names]
    if not v:
        p, none = n, np.zeros(len(names), np.int64)
    else:
        p, none = share(n, total[row], v), share(np.zeros(len(names), np.int64), total, v)
        by_term = np.argsort(index, kind="stable")
        in_lang = row_sums(n[by_term], np.concatenate([[0], np.cumsum(np.bincount(index, minlength=len(terms)))]))
        above = p - share(in_lang, lang_total, v)[index]
        rank = np.empty(len(terms), np.int64)
        rank[sorted(range(len(terms)), key=terms.__getitem__)] = np.arange(len(terms))
        chosen = np.flatnonzero((n > 0) & (above > 0))
        chosen = chosen[np.lexsort((rank[index[chosen]], -above[chosen], row[chosen]))]
        first = np.searchsorted(row[chosen], row[chosen])
        chosen = chosen[np.arange(len(chosen)) - first < top]
        yield rows([names[k] for k in row[chosen]], "term", [terms[k] for k in index[chosen]], above[chosen])
    for i, distance in enumerate(source_distances(indptr, index, p, none, len(terms))):
        other = np.flatnonzero(np.arange(len(names)) != i)
        yield rows([names[i]] * len(other), "pair", [encoded[k] for k in other], distance[other])


def audit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): the distances of each source to
    the others of its language, and the terms that it has more often."""
    docs = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = map_rows(docs, count_terms, "lang string, source string, term binary, n long, docs long", rows=ROWS)
    counts = materialize(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    # A term of a language has one row a source.
    of_term = Window.partitionBy("lang", "term")
    entries = counts.select("lang", "source", "term", "n", F.sum("docs").over(of_term).alias("df"), F.row_number().over(of_term.orderBy("source")).alias("k"))
    entries = materialize(entries.where(F.col("df") >= min_docs).drop("df"), "kept-terms")
    v = entries.where("k = 1").groupBy("lang").agg(F.count("*").alias("v"))
    sums = entries.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(v, "lang", "left").fillna(0, ["n", "v"])
    groups = materialize(groups.withColumn("lang_n", F.sum("n").over(Window.partitionBy("lang"))), "divergence-groups")
    n_entries, n_groups = entries.count(), groups.count()
    blocks = max(1, -(-n_entries // max(LEAST_ENTRIES, min(n_groups * n_groups // 16, MOST_ENTRIES))))
    # A group is told to all blocks, since it has a share of terms it lacks, too.
    told = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("term", F.lit(None).cast("binary"))
    dealt = entries.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int")).drop("k").withColumns({"v": F.lit(0).cast("long"), "lang_n": F.lit(0).cast("long")})

    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return compare_block(batches, top)

    found = dealt.unionByName(told).groupBy("lang", "block").applyInArrow(compare, "lang string, source string, part string, item binary, value long")
    found = found.groupBy("lang", "source", "part", F.col("item").cast("string").alias("item")).agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    return found.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT rid, lang, source, unnest(ts) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT rid) AS docs FROM t GROUP BY ALL),
kept AS (SELECT lang, term FROM c GROUP BY lang, term HAVING sum(docs) >= 30),
f AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n FROM g JOIN kept ON g.lang = kept.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, count(*) OVER (PARTITION BY lang, source) AS v, sum(n) OVER (PARTITION BY lang, term) AS ln, sum(n) OVER (PARTITION BY lang) AS lt FROM f),
p AS (
  SELECT lang, source, term, n, CAST(1 + (1000000000::HUGEINT * (n + 5)::HUGEINT) // (total + 5 * v)::HUGEINT AS BIGINT) AS p,
    CAST(1 + (1000000000::HUGEINT * (ln + 5)::HUGEINT) // (lt + 5 * v)::HUGEINT AS BIGINT) AS q FROM s),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT * FROM r WHERE part = 'pair' OR rank <= 50
"""
