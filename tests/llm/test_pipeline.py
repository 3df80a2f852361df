from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np

import corpus_pipeline as P
from docloom.llm import packing
from tests.llm.test_packing import verify


def documents(spark):
    r = random.Random(7)
    en, de = "the of and to in that was with from this".split(), "der die und ist nicht ein mit auf für das".split()
    rows = []
    for i in range(60):
        words = r.choices(en if i % 2 else de, k=40) + [f"w{r.randrange(10**6)}" for _ in range(40)]
        rows.append((i, " ".join(words), "en" if i % 2 else "de", f"s{i % 4}"))
    rows += [(100, rows[3][1], "en", "s1"), (101, rows[3][1] + " more", "en", "s2"), (102, "123 456", "en", "s0"), (103, None, "en", "s0"), (104, rows[5][1] + " extra password = hunter22 x", None, "s3"), (5, rows[5][1], "en", "s1")]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, tmp_path):
    docs = documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = {name: f for name, f in P.STAGES}
    one = stage["language identification"](spark, docs, str(tmp_path))
    assert one.columns == docs.columns and {r.doc_id for r in docs.collect()} - {r.doc_id for r in one.collect()} == {102, 103}
    two = stage["near-duplicate removal"](spark, one, str(tmp_path))
    kept = Counter(r.doc_id for r in two.collect())
    assert set(kept.values()) == {1} and set(kept) == set(range(60))
    again = two.unionByName(one.where("doc_id = 104"))
    three = stage["secret scan"](spark, again, str(tmp_path))
    text = {r.doc_id: r.text for r in three.collect()}
    assert "hunter22" not in text[104] and "[SECRET]" in text[104] and all(text[r.doc_id] == r.text for r in two.collect())
    four = stage["source mixing"](spark, three, str(tmp_path)).collect()
    size = {i: len(t.split()) for i, t in text.items()}
    words = defaultdict(int)
    for r in four:
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert all(words[i] <= 2 * size[i] for i in words) and abs(sum(words.values()) - 1.5 * sum(size.values())) <= 8
    five = stage["packing"](spark, two, str(tmp_path)).collect()
    verify(five, {r.doc_id: r.text for r in two.collect()}, 2048)


def test_run(spark, tmp_path):
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = P.run(spark, str(tmp_path))
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 0
    documents(spark).limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_documents_that_share_an_id_stay_apart(spark):
    rows = [(1, "one text of some words here", "en", "b"), (1, "quite another one with other words", "en", "a"), (1, "quite another one with other words", "en", "c"), (2, "a third one", "en", "a"), (None, "no id", "en", "a"), (None, "no id", "en", "a")]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for given in (docs, docs.orderBy("source"), docs.repartition(3)):
        got = Counter(map(tuple, P.drop_near_duplicates(spark, given, "").collect()))
        assert got == Counter((*rows[i], len(rows[i][1])) for i in (0, 1, 3, 4, 5))


def test_repeated_rows_are_mixed_one_by_one(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(None, "a b c", "en", "s")] * 9_000 + [(1, "x y", "en", "s"), (1, "x y", "en", "t"), (2, "long " * 30_000, "en", "t")]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = P.mix_to_targets(spark, docs, str(tmp_path)).collect()
    words, sizes = Counter(), Counter()
    for r in got:
        words[r.source] += len(r.text.split())
    for _, t, _, s in rows:
        sizes[s] += len(t.split())
    # s comes first and weighs 5, t second and weighs 2; s stops at twice its size.
    assert words["s"] == 2 * sizes["s"] and abs(words["t"] - (1.5 * sum(sizes.values()) - 2 * sizes["s"])) <= 1
    assert P.mix_to_targets(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_owners_are_counted_over_docs(spark, tmp_path):
    """The table of documents is gone after the first stage."""
    example = "Ab3Cd4Ef5Gh6Ij7Kl8Mn"
    corpus = spark.createDataFrame([(i, f"see {example} here", "en", f"s{i}", 0) for i in range(5)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.text for r in P.redact_secrets(spark, corpus, str(tmp_path)).collect()} == {f"see {example} here"}
    assert P.redact_secrets(spark, corpus.where("doc_id = 0"), str(tmp_path)).first().text == "see [SECRET] here"


def test_only_the_first_stage_reads_documents(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents(spark)
    for name, stage in P.STAGES:
        docs = P.materialize(stage(spark, docs, str(tmp_path)), "only-docs")
    assert docs.count() > 0


def test_clashing_columns_are_dropped(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    names = ["raw", "n", "size", "_key", "skey", "row", "number", "kept", "bucket", "hash", "spans", "node"]
    docs = documents(spark).selectExpr("*", *[f"'x' AS {c}" for c in names])
    for _, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() > 0 and not set(names) & set(out.columns)


def shingle_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}


def plain_targets(sizes, share=Fraction(3, 2), weights=(5, 2, 1)):
    """{source: target}: by weight, none above twice its size, the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, left, full = {}, share * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        total = sum(weight[s] for s in free)
        target |= {s: left * weight[s] / total for s in free}
        above = [s for s in free if target[s] > 2 * sizes[s]]
        if not above:
            return target
        for s in above:
            target[s] = Fraction(2 * sizes[s])
            left -= target[s]
            full.add(s)


def test_whole_run_against_brute_force(spark, tmp_path):
    """All five stages at once: which documents survive, their redacted texts,
    the words taken of each source, and the ids of every packed piece."""
    r = random.Random(11)
    pools = {"en": "the of and to in that was with from this".split(), "de": "der die und ist nicht ein mit auf für das".split()}
    rows = []
    for i in range(36):
        lang = ("en", "de")[i % 2]
        words = r.choices(pools[lang], k=30) + [f"w{r.randrange(10**6)}" for _ in range(r.randrange(20, 60))]
        r.shuffle(words)
        if i % 6 == 0:
            words[10:10] = [f"password=hunter{i}abc"]
        rows.append((i, " ".join(words), lang if i % 5 else None, ("a", "b", "c", "d", None)[r.choice((0, 0, 1, 1, 2, 3, 4))]))
    rows += [(100 + i, rows[i][1], rows[i][2], "b") for i in range(0, 12, 2)]
    rows += [(200 + i, rows[i][1] + f" added{i}", rows[i][2], "c") for i in range(1, 20, 3)]
    rows += [(300, rows[7][1].replace(" ", "  ", 3), "en", "a"), (301, None, "en", "a"), (302, "12 34", "de", "b"), (303, "", None, None)]
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    # By hand: rejects go, of texts linked by 0.8 or more the smallest id stays.
    lettered = sorted((x for x in rows if x[1] and any(c.isalpha() for c in x[1])), key=lambda x: x[0])
    sets = [shingle_set(x[1]) for x in lettered]
    root = list(range(len(lettered)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j in range(len(lettered)):
        for i in range(j):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    kept = {x[0]: (re.sub(r"password=\w+", "[SECRET]", x[1]), x[3]) for i, x in enumerate(lettered) if find(i) == i}
    assert set(kept) == set(range(36))
    size = {i: len(t.split()) for i, (t, _) in kept.items()}
    sizes = defaultdict(int)
    for i, (_, source) in kept.items():
        sizes[source] += size[i]

    # The only texts a row may hold: a kept document, whole or its first words.
    tokenizer, texts = packing.Encoder(packing.default_tokenizer()[0]).tokenizer, {}
    for i, (t, _) in kept.items():
        for k in range(1, size[i] + 1):
            ids = [*tokenizer.encode(t if k == size[i] else " ".join(t.split()[:k]), add_special_tokens=False).ids, 0]
            texts[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] = k
    got, words, sequences = P.run(spark, str(tmp_path)).collect(), defaultdict(int), defaultdict(list)
    for x in got:
        assert (x.piece, x.start) == (0, 0)
        words[x.doc_id] += texts[x.doc_id, x.length, x.ids_crc32]
        sequences[x.sequence_id].append((x.offset, x.length))
    assert all(n <= 2 * size[i] for i, n in words.items())
    taken = defaultdict(int)
    for i, n in words.items():
        taken[kept[i][1]] += n
    target = plain_targets(sizes)
    assert set(target) == {"a", "b", "c", "d", None} and all(0 <= target[s] - taken[s] < 1 for s in target)
    # Nothing is taken in part but the document on which a source ends.
    parts = defaultdict(int)
    for i, n in words.items():
        parts[kept[i][1]] += n % size[i] > 0
    assert all(n <= 1 for n in parts.values())
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 2048
    assert len(sequences) == -(-sum(x.length for x in got) // 2048)
