"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A
trigram abc is bound into rho(rho(A)) * rho(B) * C, where rho rotates a vector
by one place; a document bundles (adds) the vectors of its trigrams, and a
language prototype bundles its documents. A document gets the language whose
prototype has the largest cosine with its own vector.

Letters are what Python calls alphabetic, in lower case; every run of other
characters is one space, which has a vector of its own.

The bundle of a set of documents is the product of its trigram counts and the
trigram vectors, so training adds counts and multiplies once per task; each
task sends one vector for each language. Prediction multiplies the counts of a
batch of documents. Both go by parts of at most 8,192 trigrams, and a very long
text by parts of its own, so memory does not follow the text or its alphabet.

Nulls and odd rows: a null text, or one without a letter, is `und` with score
0. Documents with a null language are not learned from. Without any learned
language all are `und`. Equal cosines give the first language by code point.
Repeated rows count as often as they appear. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.batches import map_rows, parts, strings
from docloom.llm.common import fold, table

DIM = 512
SEED = 20_011
UNKNOWN = "und"
SLICE = 1_000_000  # characters


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else 32."""
    points = np.arange(0x110000, dtype=np.uint32)
    return np.where(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000), points, 32).astype(np.uint32)


@lru_cache(maxsize=20_000)
def letter_vector(point: int, dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, point]).integers(0, 2, dim, dtype=np.int8) * np.int8(2) - np.int8(1)


def _points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the letters of each text, runs of other characters as one
    space, and the number of the text of each. Words stand between spaces."""
    lower = [" " if t is None else f" {t.lower()} " for t in texts]
    points = _letters()[np.frombuffer("".join(lower).encode("utf-32-le", "replace"), dtype=np.uint32)]
    docs = np.repeat(np.arange(len(lower)), [len(t) for t in lower])
    space = points == 32
    keep = ~space | np.concatenate([[True], ~space[:-1] | (docs[1:] != docs[:-1])])
    return points[keep], docs[keep]


def _pieces(text: str) -> Iterator[np.ndarray]:
    """The points of a long text in parts; each begins with the last two points
    of the part before, so that no trigram is lost or comes twice."""
    last = np.zeros(0, np.uint32)
    for at in range(0, len(text), SLICE):
        points, _ = _points([text[at : at + SLICE]])
        if at + SLICE < len(text):
            points = points[:-1] if not _is_space(text[at + SLICE - 1]) else points
        if at:
            points = points[1:] if not _is_space(text[at]) or (len(last) and last[-1] == 32) else points
        points = np.concatenate([last, points])
        yield points
        last = points[-2:]


def _is_space(c: str) -> bool:
    return all(_letters()[ord(x)] == 32 for x in c.lower())


#: Possible trigrams up to which they are numbered by a table of all.
DENSE = 4_000_000


def _trigrams(points: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document index, trigram number) of every trigram, and the code points
    of the trigrams by number, of shape (n, 3)."""
    if len(points) < 3:
        return np.zeros(0, int), np.zeros(0, int), np.zeros((0, 3), np.uint32)
    used = np.zeros(0x110000, dtype=bool)
    used[points] = True
    alphabet = np.flatnonzero(used)
    number = np.zeros(0x110000, dtype=np.int64)
    number[alphabet] = np.arange(len(alphabet))
    c, a = number[points], len(alphabet)
    key = (c[:-2] * a + c[1:-1]) * a + c[2:]
    inside = docs[:-2] == docs[2:]
    key, docs = key[inside], docs[:-2][inside]
    if a**3 <= DENSE:
        there = np.zeros(a**3, dtype=bool)
        there[key] = True
        grams = np.flatnonzero(there)
        place = np.zeros(a**3, dtype=np.int32)
        place[grams] = np.arange(len(grams))
        inverse = place[key]
    else:
        grams, inverse = np.unique(key, return_inverse=True)
    return docs, inverse, alphabet[np.stack([grams // (a * a), grams // a % a, grams % a], axis=1)]


def gram_vectors(grams: np.ndarray, dim: int) -> np.ndarray:
    """Bound vectors of trigrams given by code points."""
    alphabet, inverse = np.unique(grams, return_inverse=True)
    if not len(alphabet):
        return np.zeros((0, dim), np.float32)
    base = np.stack([letter_vector(int(p), dim) for p in alphabet])
    inverse = inverse.reshape(grams.shape)
    once = np.roll(base, 1, axis=1)
    return (np.roll(base, 2, axis=1)[inverse[:, 0]] * once[inverse[:, 1]] * base[inverse[:, 2]]).astype(np.float32)


def _slices(texts: list[str | None]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(texts, points, text number of each from the first of these on) of at
    most about SLICE characters; a longer text comes in several parts."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > begin and (size + n > SLICE or i - begin >= 256):
            yield slice(begin, i), *_points(texts[begin:i])
            begin, size = i, 0
        if n > SLICE:
            for points in _pieces(t):
                yield slice(i, i + 1), points, np.zeros(len(points), int)
            begin, size = i + 1, 0
        else:
            size += n
    if begin < len(texts):
        yield slice(begin, len(texts)), *_points(texts[begin:])


PART = 8192


def _add_bundles(out: np.ndarray, owner: np.ndarray, inverse: np.ndarray, grams: np.ndarray) -> None:
    """Adds the vectors of the trigrams to the rows of out that own them, in
    parts that bound the vectors and counts in memory. Sums stay exact: those of
    a part are below 2**24, and out holds doubles."""
    n, dim = out.shape
    order = np.argsort(inverse, kind="stable") if len(grams) > PART else None
    ends = np.searchsorted(inverse[order], np.arange(0, len(grams) + PART, PART)) if order is not None else None
    for k, at in enumerate(range(0, len(grams), PART)):
        part = slice(at, min(at + PART, len(grams)))
        mine = order[ends[k] : ends[k + 1]] if order is not None else slice(None)
        width = part.stop - part.start
        counts = np.bincount(owner[mine] * width + inverse[mine] - part.start, minlength=n * width).reshape(n, width)
        out += counts.astype(np.float32) @ gram_vectors(grams[part], dim)


def bundle(texts: list[str | None], dim: int = DIM) -> np.ndarray:
    """The vector of each text, of shape (texts, dim)."""
    out = np.zeros((len(texts), dim))
    for s, points, docs in _slices(texts):
        _add_bundles(out[s], *_trigrams(points, docs))
    return out


def learn_prototypes(df: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = DIM) -> dict[str, list[float]]:
    """A prototype for each non-null language: dim numbers a language."""
    labelled = df.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(dim))
        for batch in parts(batches):
            texts, langs = strings(batch, "text"), strings(batch, "lang")
            names = sorted(set(langs))
            which = np.array([names.index(x) for x in langs])
            found = np.zeros((len(names), dim))
            for s, points, docs in _slices(texts):
                docs, inverse, grams = _trigrams(points, docs)
                _add_bundles(found, which[s][docs], inverse, grams)
            for name, total in zip(names, found, strict=True):
                sums[name] += total
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "vector": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))})

    vectors = labelled.mapInArrow(add, "lang string, vector array<double>").select("lang", F.posexplode("vector").alias("i", "v"))
    # Counts below 2**53 add exactly, in any order.
    total = vectors.groupBy("lang", "i").agg(F.sum("v").alias("v")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("v"))
    return {r["lang"]: [x["v"] for x in r["v"]] for r in total.collect()}


def predict(df: DataFrame, prototypes: dict[str, list[float]], id_cols: list[str], text_col: str = "text", dim: int = DIM) -> DataFrame:
    """id_cols with lang_pred and score, the cosine with the prototype of that
    language, between 0 and 1."""
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] for n in names]).reshape(len(names), dim)
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    unit = matrix / np.where(lengths > 0, lengths, 1)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = strings(batch, "_text")
        lettered = np.array([t is not None and any(map(str.isalpha, t)) for t in texts])
        vectors = bundle(texts, dim)
        lengths = np.linalg.norm(vectors, axis=1)
        known = lettered & (lengths > 0) & bool(names)
        cosine = (vectors / np.where(lengths > 0, lengths, 1)[:, None]) @ unit.T if names else np.zeros((len(texts), 1))
        best = cosine.argmax(axis=1)
        langs = [names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        scores = np.where(known, np.clip(np.round(cosine[np.arange(len(texts)), best], 9), 0, 1), 0.0)
        kept = [batch.column(i) for i in range(len(id_cols))]
        return pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*[batch.schema.names[i] for i in range(len(id_cols))], "lang_pred", "score"])

    chosen = df.select(*id_cols, F.col(text_col).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return map_rows(chosen, score, f"{kinds}, lang_pred string, score double")


def op2_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = learn_prototypes(docs.where(fold(F.col("doc_id"), 5) != 0))
    rows = docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return predict(rows, prototypes, ["doc_id", "held_out"])
