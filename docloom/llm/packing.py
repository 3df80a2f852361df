"""Best-fit packing by patterns and non-negative least squares.

Documents become token pieces of at most `capacity` tokens; only the histogram
of piece lengths, at most `capacity` numbers, comes to the driver. There,
patterns of one, two and three lengths that fill a sequence are enumerated,
repeat counts are fitted to the histogram by non-negative least squares, and
rounded down within what the histogram holds. What is left is packed best-fit,
longest first, again over the histogram: equal lengths are placed as groups, so
the work depends on the capacity and not on the number of documents.

Pieces then find their places by rank: the r-th piece of a length takes the
r-th slot of that length in the plan. Ranks come from two levels (counts by
length and bucket, then order within the bucket), since a length may hold a
third of all pieces; equal pieces are one row with a count until they are placed.

Patterns of three lengths are too many to list for every length: the middle
length is one of 192 that are evenly spread over those that occur. All pairs are
listed. Updates end when the residual falls by less than one in ten thousand in
ten rounds, or after 300; what the fit leaves over is packed best-fit, so this
decides how well sequences fill, and nothing else.

Tokens: the ids of the given tokenizer for the whole text, then `end_id`.
Byte-level BPE splits a text before every single space that stands between
other characters, so ids are looked up by such chunks in a bounded cache, and
chunks that are not there go to the tokenizer, or to the same merges by rank. Texts that hold the string of a
special token are encoded whole.

Nulls and odd rows: a null or empty text is the end token alone. Repeated rows
are packed as often as they appear. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.batches import parts, strings
from docloom.llm.common import expand, materialize, table

CAPACITY = 2048
END_ID = 0
CACHE = 300_000
BUCKETS = 1024


class Encoder(dict):
    """The ids of ' ' + chunk as little-endian 32-bit bytes, by chunk.

    ranks: the same vocabulary as a file of merge ranks. A chunk that is not
    cached and has no character from U+0530 on (where libraries may disagree on
    what a letter is) is then merged by rank, several times faster.
    """

    # A space between two characters that are not white space.
    BORDER = re.compile(r"(?<=\S) (?=\S)")
    RARE = re.compile(r"[^\S \n]")

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.by_rank = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                merged = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.by_rank = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merged, special_tokens={}).encode_ordinary

    def encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def __missing__(self, chunk: str) -> bytes:
        if self.by_rank and (chunk.isascii() or max(chunk) < "\u0530"):
            ids = np.array(self.by_rank(" " + chunk), dtype="<u4").tobytes()
        else:
            ids = self.encode([" " + chunk])[0]
        if len(self) < CACHE:
            self[chunk] = ids
        return ids

    def split(self, text: str) -> list[str]:
        """What stands between single spaces that have no white space beside
        them; there alone is the rest of a text encoded as if it stood alone."""
        plain = "  " not in text and " \n" not in text and "\n " not in text and text[:1] != " " and text[-1:] != " " and not self.RARE.search(text)
        return text.split(" ") if plain else self.BORDER.split(text)

    def ids(self, texts: list[str | None]) -> list[bytes]:
        chunks = [[t] if self.special and self.special.search(t) else self.split(t) for t in (t or "" for t in texts)]
        first = self.encode([c[0] for c in chunks])
        return [a + b"".join(map(self.__getitem__, c[1:])) for a, c in zip(first, chunks, strict=True)]


_encoders: dict[tuple[str, str | None], Encoder] = {}


def encoder(path: str, ranks: str | None = None) -> Encoder:
    if (path, ranks) not in _encoders:
        _encoders[path, ranks] = Encoder(path, ranks)
    return _encoders[path, ranks]


PIECES = "doc_id long, text_crc long, piece int, start long, length long, ids_crc32 long"


def token_pieces(df: DataFrame, tokenizer: str | None = None, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of each row: doc_id, text_crc, piece, start, length,
    ids_crc32. The first piece of a long document is the shorter one. Without a
    path of a tokenizer each executor looks up the default one for itself."""
    df = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*(default_tokenizer() if tokenizer is None else (tokenizer, ranks)))
        for batch in parts(batches):
            out = defaultdict(list)
            for doc, ids in zip(strings(batch, "doc_id"), enc.ids(strings(batch, "text")), strict=True):
                ids += end
                n, whole = len(ids) // 4, zlib.crc32(ids)
                begin, stop, k = 0, n % capacity or min(n, capacity), 0
                while begin < n:
                    for name, x in (("doc_id", doc), ("text_crc", whole), ("piece", k), ("start", begin), ("length", stop - begin), ("ids_crc32", zlib.crc32(ids[4 * begin : 4 * stop]))):
                        out[name].append(x)
                    begin, stop, k = stop, stop + capacity, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(out[n], pa.int32() if n == "piece" else pa.int64()) for n in ("doc_id", "text_crc", "piece", "start", "length", "ids_crc32")], ["doc_id", "text_crc", "piece", "start", "length", "ids_crc32"])

    return df.mapInArrow(cut, PIECES)


def enumerate_patterns(counts: np.ndarray, per_length: int = 24) -> np.ndarray:
    """Rows of three lengths (0: none), descending, that fill a sequence
    exactly: pairs, and triples around evenly spread middle lengths; for a
    length without a full pattern, it alone. counts[l]: pieces of length l."""
    capacity = len(counts) - 1
    there = np.flatnonzero(counts > 0)
    there = there[there > 0]
    rows = [np.array([[capacity, 0, 0]])] if counts[capacity] else []
    a = there[there < capacity]
    if len(a):
        b = capacity - a
        pair = (b <= a) & (counts[b] > 0)
        rows.append(np.stack([a[pair], b[pair], np.zeros(pair.sum(), int)], axis=1))
        middle = a[np.unique(np.linspace(0, len(a) - 1, min(per_length * 8, len(a))).astype(int))]
        x, y = np.meshgrid(a, middle, indexing="ij")
        z = capacity - x - y
        fits = (z > 0) & (z <= y) & (y <= x)
        fits[fits] = counts[z[fits]] > 0
        rows.append(np.stack([x[fits], y[fits], z[fits]], axis=1))
    return np.concatenate(rows) if rows else np.zeros((0, 3), int)


def fit_counts(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative repeat counts x that minimise |A x - counts|^2, where A
    counts the lengths in each pattern: multiplicative updates, which keep x
    non-negative."""
    if not len(patterns):
        return np.zeros(0)
    size = len(counts)
    used = patterns > 0

    def gather(v: np.ndarray) -> np.ndarray:  # A^T v
        return (v[patterns] * used).sum(axis=1)

    x = np.full(len(patterns), counts[1:].sum() / (3.0 * len(patterns)))
    want, before = gather(counts.astype(float)), np.inf
    for turn in range(rounds):
        have = np.bincount(patterns.ravel(), weights=(used * x[:, None]).ravel(), minlength=size)
        x *= want / np.maximum(gather(have), 1e-12)
        if turn % 10 == 9:
            residual = float(np.linalg.norm((have - counts)[1:]))
            if residual >= before * (1 - 1e-4):
                break
            before = residual
    return x


def plan_patterns(counts: np.ndarray) -> list[tuple[int, tuple[int, ...]]]:
    """[(repeats, lengths)]: together they hold exactly counts[l] pieces of
    each length l, none above the capacity."""
    left = counts.astype(np.int64).copy()
    patterns = enumerate_patterns(left)
    fitted = fit_counts(patterns, left)
    plan: list[tuple[int, tuple[int, ...]]] = []
    # Rounded down: what a fraction of a repeat would pack is packed better with
    # all that is left.
    order = np.lexsort((patterns[:, 2], patterns[:, 1], patterns[:, 0])) if len(patterns) else np.zeros(0, int)
    whole = np.floor(fitted[order] + 1e-6).astype(int)
    for k, n in zip(order, whole, strict=True):
        if n > 0:
            lengths = tuple(int(v) for v in patterns[k] if v)
            n = min(int(n), *(int(left[v]) // lengths.count(v) for v in lengths))
            if n > 0:
                plan.append((n, lengths))
                for v in lengths:
                    left[v] -= n
    return plan + best_fit(left)


def best_fit(counts: np.ndarray) -> list[tuple[int, tuple[int, ...]]]:
    """Longest first, each into the fullest open sequence that it fits, with
    equal lengths and equal sequences moved as groups."""
    capacity = len(counts) - 1
    # room -> {lengths: number of open sequences}
    rooms: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    open_rooms = np.zeros(capacity + 1, dtype=bool)
    for length in range(capacity, 0, -1):
        todo = int(counts[length])
        while todo:
            fits = np.flatnonzero(open_rooms[length:])
            if not len(fits):
                each = min(capacity // length, todo)
                groups = [(todo // each, each)] + ([(1, todo % each)] if todo % each else [])
                for n, k in groups:
                    room, key = capacity - k * length, (length,) * k
                    rooms[room][key] = rooms[room].get(key, 0) + n
                    open_rooms[room] = True
                break
            room = int(fits[0]) + length
            key, n = next(iter(rooms[room].items()))
            take = min(n, todo)
            todo -= take
            if take == n:
                del rooms[room][key]
                open_rooms[room] = bool(rooms[room])
            else:
                rooms[room][key] = n - take
            rest = room - length
            key = (*key, length)
            rooms[rest][key] = rooms[rest].get(key, 0) + take
            open_rooms[rest] = True
    return [(n, key) for room in rooms for key, n in room.items()]


def slots(plan: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first_rank, repeats, first_sequence, offset): pieces of that
    length with ranks first_rank.. take that offset in sequences
    first_sequence.., one for each repeat."""
    out, rank, sequence = [], defaultdict(int), 0
    for n, lengths in plan:
        offset = 0
        for length in lengths:
            out.append((length, rank[length], n, sequence, offset))
            rank[length] += n
            offset += length
        sequence += n
    return out


BROADCAST_SLOTS = 500_000


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset."""
    spark = pieces.sparkSession
    order = ["doc_id", "text_crc", "piece", "ids_crc32"]
    alike = materialize(pieces.groupBy(*pieces.columns).agg(F.count("*").alias("n")), "pack-pieces")
    dealt = alike.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc", "piece"), F.lit(BUCKETS)).cast("int"))
    by_bucket = dealt.groupBy("length", "bucket").agg(F.sum("n").alias("in_bucket"))
    counts, largest = np.zeros(capacity + 1, dtype=np.int64), 0
    for r in dealt.groupBy("length").agg(F.sum("n").alias("n"), F.max("n").alias("largest")).collect():  # at most capacity rows
        counts[r["length"]], largest = r["n"], max(largest, r["largest"])
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = by_bucket.select("length", "bucket", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("rank", F.coalesce(F.sum("n").over(within), F.lit(0))).join(before, ["length", "bucket"])
    ranked = expand(ranked.withColumn("rank", F.col("rank") + F.col("before")), "n", "number", ["doc_id", "text_crc", "piece"], largest)
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("number"))
    rows = slots(plan_patterns(counts))
    columns = np.array(rows or [(0, 0, 0, 0, 0)], dtype=np.int64).T
    # From Arrow, as plain rows would start Python workers of another kind, which
    # stay beside those that hold the tokenizer.
    plan = spark.createDataFrame(pa.table(list(columns), names=["length", "first_rank", "repeats", "first_sequence", "at"]))
    plan = plan.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first_rank", "repeats", "first_sequence", "at"))).alias("slots"))
    # One row for each length, some 40 bytes a slot.
    found = ranked.join(F.broadcast(plan) if len(rows) <= BROADCAST_SLOTS else plan.hint("shuffle_merge"), "length").withColumn(
        "slot", F.filter("slots", lambda s: (s["first_rank"] <= F.col("rank")) & (F.col("rank") < s["first_rank"] + s["repeats"]))[0]
    )
    return found.select(*[c for c in pieces.columns], (F.col("slot.first_sequence") + F.col("rank") - F.col("slot.first_rank")).alias("sequence_id"), F.col("slot.at").alias("offset"))


def default_tokenizer() -> tuple[str, str]:
    """The places of the vocabulary file and of its merge ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op9_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(token_pieces(table(spark, sf_dir, "documents")))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
