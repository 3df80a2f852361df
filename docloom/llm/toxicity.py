"""Toxicity by multiple-instance learning.

A document is a bag of sentences, and only the document has a label. Each
sentence has the probability sigmoid(b + sum of the scores of its distinct
words), where the score of a word is the sum of the weights of the word and of
its beginnings of 4 to 7 letters, since languages inflect; a document is toxic unless all of its sentences are not (noisy-or):
p = 1 - prod(1 - p_sentence). Weights are fitted to document labels by gradient
descent on the log loss of p, so the gradient goes to the sentences that make a
document toxic, and the same scores then locate those sentences.

The weights are fitted on the driver on at most `max_rows` labelled documents,
those of smallest hashed id; this bounds the sample at every size of the
corpus. Texts stay on the executors: they count the documents of each feature,
and then send sentences as numbers of what the model knows. The model has a
weight for words and beginnings in at least `min_docs` sampled documents only,
so its size is bounded by the sample, too. Scoring covers all documents and
whole texts.

Nulls and odd rows: a null or empty text has one empty sentence. Rows without a
label, with a null label or a null id are not learned from; several labels of
one id: the largest; an id with several texts is as many documents, and rows
that repeat are one. Without both labels in the sample every score is the share
of label 1 in it (0 without any). Repeated rows get equal scores. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.batches import map_rows, parts, strings
from docloom.llm.common import fold, materialize, table

MAX_ROWS = 10_000
MIN_DOCS = 5
THRESHOLD = 0.3
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[^.!?\n]+(?:[.!?]+(?=\s|$)|\n|[.!?])*|[.!?\n]+")


PREFIXES = (4, 5, 6, 7)
CACHE = 200_000


def features(word: str) -> list[str]:
    return [word, *(word[:k] + "-" for k in PREFIXES if len(word) > k)]


def sentence_words(text: str | None) -> list[set[str]]:
    """The distinct words of each sentence; an empty text has one without."""
    return [set(WORD.findall(m.group())) for m in SENTENCE.finditer((text or "").lower())] or [set()]


def document_counts(texts: list[str | None]) -> Counter[str]:
    """In how many of the texts each feature is."""
    out: Counter[str] = Counter()
    for text in texts:
        out.update({f for w in set().union(*sentence_words(text)) for f in features(w)})
    return out


class Encoder(dict):
    """For each word the hash of its features that the vocabulary has; words
    without any have hash 0. seen: the features of each hash."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary, self.seen = vocabulary, {}

    def __missing__(self, word: str) -> int:
        own = [i for f in features(word) if (i := self.vocabulary.get(f)) is not None]
        found = int.from_bytes(hashlib.blake2b(np.array(own, "<i4").tobytes(), digest_size=8).digest(), "little", signed=True) if own else 0
        self[word] = found
        if own:
            self.seen[found] = own
        return found

    def sentences(self, text: str | None) -> list[list[int]]:
        return [sorted(h for w in words if (h := self[w])) for words in sentence_words(text)]


@dataclass
class Bags:
    """Documents as numbers: the document of each sentence, the sentence and the
    number of each of its words, and the features of each numbered word."""

    labels: np.ndarray
    docs: np.ndarray
    sents: np.ndarray
    words: np.ndarray
    types: np.ndarray
    feats: np.ndarray
    vocabulary: list[str]

    @classmethod
    def build(cls, labels: np.ndarray, per_doc: np.ndarray, per_sentence: np.ndarray, hashes: np.ndarray, seen: dict[int, list[int]], vocabulary: list[str]) -> Bags:
        known = np.array(sorted(seen), dtype=np.int64)
        sizes = [len(seen[h]) for h in known.tolist()]
        feats = np.array([i for h in known.tolist() for i in seen[h]], dtype=np.int32)
        number = lambda n: np.repeat(np.arange(len(n), dtype=np.int32), n)
        return cls(np.asarray(labels, float), number(per_doc), number(per_sentence), np.searchsorted(known, hashes).astype(np.int32), number(sizes), feats, vocabulary)

    def loss_and_slope(self, w: np.ndarray, b: float, ridge: float) -> tuple[float, np.ndarray, float]:
        """The log loss of the documents with half the squared weights times
        ridge, and its slope by the weights and the bias."""
        n_types = int(self.types[-1]) + 1 if len(self.types) else 0
        n, k = len(self.docs), len(self.labels)
        scores = np.bincount(self.types, weights=w[self.feats], minlength=n_types)
        p = sigmoid(b + np.bincount(self.sents, weights=scores[self.words], minlength=n))
        quiet = np.bincount(self.docs, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=k)
        score = np.clip(-np.expm1(quiet), 1e-9, 1 - 1e-12)
        loss = -float((self.labels * np.log(score) + (1 - self.labels) * quiet).sum()) + ridge / 2 * float(w @ w)
        # d loss / d logit of a sentence: p (score - y) / score
        pull = p * ((score - self.labels) / score)[self.docs]
        by_type = np.bincount(self.words, weights=pull[self.sents], minlength=n_types)
        return loss, np.bincount(self.feats, weights=by_type[self.types], minlength=len(w)) + ridge * w, float(pull.sum())


@dataclass
class Model:
    bias: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)
    #: If not None, what every document scores.
    constant: float | None = None
    cache: dict[str, float] = field(default_factory=dict, repr=False)

    def word_score(self, word: str) -> float:
        found = self.cache.get(word)
        if found is None:
            found = sum(self.weights.get(f, 0.0) for f in features(word))
            if len(self.cache) < CACHE:
                self.cache[word] = found
        return found

    def sentence_logits(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, logit) of each sentence."""
        lower = text.lower()
        if len(lower) != len(text):  # positions must stay
            lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        return [(m.start(), m.end(), self.bias + sum(map(self.word_score, set(WORD.findall(m.group()))))) for m in SENTENCE.finditer(lower)] or [(0, 0, self.bias)]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def noisy_or(logits: list[float]) -> float:
    # log(1 - p) of a sentence is -log(1 + e^z)
    quiet = sum(-z if z > 30 else -math.log1p(math.exp(z)) for z in logits)
    return -math.expm1(quiet)


def fit(texts: list[str | None], labels: list[int], min_docs: int = MIN_DOCS, **options) -> Model:
    """The model of texts at hand."""
    vocabulary = {f: i for i, f in enumerate(sorted(f for f, n in document_counts(texts).items() if n >= min_docs))}
    encoder = Encoder(vocabulary)
    bags = [encoder.sentences(t) for t in texts]
    flat = [s for d in bags for s in d]
    hashes = np.array([h for s in flat for h in s], dtype=np.int64)
    return fit_bags(Bags.build(np.array(labels), np.array([len(d) for d in bags], int), np.array([len(s) for s in flat], int), hashes, encoder.seen, list(vocabulary)), **options)


def fit_bags(bags: Bags, steps: int = 150, rate: float = 0.2, ridge: float = 0.3) -> Model:
    """Weights by scaled gradient steps over all sampled documents at once.

    ridge: the penalty on half the squared weights, in documents. It leaves
    little weight to words that a few toxic documents share by chance, and
    shares weight among words that come together, where a penalty on absolute
    weights would keep one of them and miss documents that hold another."""
    y = bags.labels
    if not len(y) or y.min() == y.max():
        return Model(constant=float(y.mean()) if len(y) else 0.0)
    w, b = np.zeros(len(bags.vocabulary)), math.log(max(y.mean(), 1e-3) / (len(bags.docs) / len(y)))
    second = np.zeros(len(w) + 1)
    for t in range(steps):
        _, by_weight, by_bias = bags.loss_and_slope(w, b, ridge)
        slope = np.append(by_weight, by_bias)
        second = 0.9 * second + 0.1 * slope**2
        move = rate * (1 - t / steps) * slope / (np.sqrt(second / (1 - 0.9 ** (t + 1))) + 0.1)
        w, b = w - move[:-1], b - move[-1]
    return Model(float(b), {x: float(v) for x, v in zip(bags.vocabulary, w, strict=True) if abs(v) >= 0.01})


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, min_docs: int = MIN_DOCS) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. The rows to learn from must
    have been chosen by the caller; max_rows of them at most are used."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("raw", F.md5(F.col("text").cast("binary")))
    # The sample is chosen among ids and hashes, so that only its texts move.
    rows = keyed.select("doc_id", "raw").join(known, "doc_id").distinct()
    chosen = rows.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id", "raw").limit(max_rows)
    sample = keyed.join(F.broadcast(chosen), ["doc_id", "raw"]).dropDuplicates(["doc_id", "raw"])
    sample = materialize(sample.select(F.xxhash64("doc_id", "raw").alias("place"), "toxic", "text"), "toxic-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = document_counts(strings(batch, "text"))
            yield pa.RecordBatch.from_pydict({"feature": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    counted = sample.select("text").mapInArrow(count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)
    vocabulary = {f: i for i, f in enumerate(sorted(counted.select("feature").toArrow().column(0).to_pylist()))}
    shared = sample.sparkSession.sparkContext.broadcast(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document: its place, label, words of each sentence,
        and hashes; and one for each hash: null place, its features, itself."""
        encoder, sent = Encoder(shared.value), set()
        for batch in parts(batches):
            bags = [encoder.sentences(t) for t in strings(batch, "text")]
            new = [h for h in encoder.seen if h not in sent]
            sent.update(new)
            place = [*strings(batch, "place"), *[None] * len(new)]
            toxic = [*strings(batch, "toxic"), *[None] * len(new)]
            sizes = [[len(s) for s in d] for d in bags] + [encoder.seen[h] for h in new]
            hashes = [[h for s in d for h in s] for d in bags] + [[h] for h in new]
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(toxic, pa.int32()), pa.array(sizes, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64()))], ["place", "toxic", "sizes", "hashes"])

    bags = collect_bags(sample.mapInArrow(encode, "place long, toxic int, sizes array<int>, hashes array<long>"), list(vocabulary))
    shared.unpersist()
    return fit_bags(bags)


def collect_bags(encoded: DataFrame, vocabulary: list[str]) -> Bags:
    """Bags from the rows of `learn`; what is collected for them is let go here,
    before the weights are fitted."""
    found = encoded.toArrow().combine_chunks()
    of_words = found.filter(found.column("place").is_null())
    seen = dict(zip((h[0] for h in of_words.column("hashes").to_pylist()), of_words.column("sizes").to_pylist(), strict=True))
    found = found.filter(found.column("place").is_valid()).sort_by("place").combine_chunks()
    sizes, hashes = found.column("sizes").combine_chunks(), found.column("hashes").combine_chunks()
    per_doc = np.asarray(sizes.value_lengths()) if found.num_rows else np.zeros(0, int)
    flat = lambda column: np.asarray(column.flatten()) if found.num_rows else np.zeros(0, int)
    return Bags.build(np.asarray(found.column("toxic")), per_doc, flat(sizes), flat(hashes), seen, vocabulary)


def score(df: DataFrame, model: Model, id_cols: list[str], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id_cols with score, predicted, and offending: the sentences that score
    at least threshold by themselves, as start, end (code points), score."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, scores, offending = shared.value, [], []
        for text in strings(batch, "_text"):
            if m.constant is not None:
                scores.append(m.constant)
                offending.append([])
                continue
            found = m.sentence_logits(text or "")
            scores.append(round(min(1.0, max(0.0, noisy_or([z for *_, z in found]))), 9))
            cut = math.log(threshold / (1 - threshold))
            offending.append([{"start": a, "end": e, "score": round(1 / (1 + math.exp(-max(z, -40))), 9)} for a, e, z in found if z >= cut])
        kept = [batch.column(i) for i in range(len(id_cols))]
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        return pa.RecordBatch.from_arrays(
            [*kept, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(offending, span)],
            [*batch.schema.names[: len(id_cols)], "score", "predicted", "offending"],
        )

    chosen = df.select(*id_cols, F.col(text_col).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return map_rows(chosen, run, f"{kinds}, score double, predicted int, offending array<struct<start:int,end:int,score:double>>")


def op4_toxic_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn(docs, labels.where(fold(F.col("doc_id"), 4) != 2))
    rows = docs.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "text")
    scored = score(rows, model, ["doc_id", "held_out"])
    spans = F.array_join(F.transform("offending", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("offending").cast("long").alias("n_offending"), spans.alias("offending"))
