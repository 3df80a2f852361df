from __future__ import annotations

import random
import re
import time

import duckdb

from docloom.llm import license_scan as S
from tests.llm import odd

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def base(text):
    """(n_words, n_base, first, last, labels) by a look at every place."""
    ws = words(text)
    places = [(i, label) for phrase, label in S.BASE for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(ws), len(at), min(at, default=None), max(at, default=None), sorted({x for _, x in places})


def detections(text):
    """Every rule on every text, and every pair of detections compared."""
    form, found = "".join(f" {w} " for w in words(text)), []
    for k, (label, priority, _, template) in enumerate(S.RULES):
        for m in re.finditer(S.pattern(template), form):
            found.append((form[: m.start()].count(" ") // 2, form[: m.end()].count(" ") // 2, label, priority, k))
    spans = lambda a, b: a[0] <= b[0] and a[1] >= b[1] and a[3] >= b[3] and (a[:2] != b[:2] or a[3] > b[3] or a[4] < b[4])
    return sorted(d[:4] for d in found if not any(spans(o, d) for o in found if o is not d))


def sample(template, choice=0):
    """A text that a template matches: one choice (0: the first, -1: the last)
    of each group, optional parts left out."""
    t, was = re.sub(r"\.\{[^}]*\}", "some body", template).replace("[cs]", "c").replace("[a-z]*", "").replace("[1-4]", "4").replace("[05]", "0"), None
    t = re.sub(r"([a-z ])\?", "", t)
    while was != t:
        was = t
        t = re.sub(r"\(\?:[^()]*\)\?", "", t)
        t = re.sub(r"\(\?:([^()]*)\)(?!\?)", lambda m: m[1].split("|")[choice], t)
    return t


def found(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: r for r in S.find_licenses(df).collect()}


def check(spark, texts):
    for i, r in found(spark, texts).items():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[i]), texts[i]
        want = detections(texts[i])
        assert [tuple(d) for d in r.detections] == want, texts[i]
        assert r.score == max((S.WEIGHTS[d[3]] for d in want), default=0.0)


def test_every_rule_finds_its_sample(spark):
    assert len(S.RULES) > 300 and len({r[0] for r in S.RULES}) > 80
    texts = [sample(r[3], c) for c in (0, -1) for r in S.RULES]
    for (label, _, need, template), text in zip([*S.RULES, *S.RULES], texts, strict=True):
        assert re.search(S.pattern(template), "".join(f" {w} " for w in words(text))), (label, text)
        assert any(max(w.split(), key=len) in text for w in S.GATE_WORDS) or re.search(S.GATE_PAIRS, text), (label, text)
        assert not need or set(need.split("|")) & set(words(text)), (label, need, text)
    check(spark, texts)
    for k, r in found(spark, texts).items():
        top = max(d.priority for d in r.detections)
        rule = S.RULES[k % len(S.RULES)]
        assert rule[0] in [d.label for d in r.detections] or top > rule[1] or any(d.end - d.start >= len(words(texts[k])) for d in r.detections), texts[k]


TEXTS = [
    "Licensed under the Apache License, Version 2.0.", "Released UNDER the MIT-License; under the mit license under the mit license", "CC BY-NC cc-by-nc CC\nBY\tNC", "cc by-nc-sa 4.0", "cc by ncx and xcc by nc",
    "GNU Lesser General Public License v2.1 or later", "licensed under the GNU General Public License version 3", "SPDX-License-Identifier: GPL-2.0-or-later", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "All rights reserved.", "plain prose with nothing", "", None, "!!!", "Mİt License", "apache license version 2under the mit license",
    "apache license version 22", "é under the mit license é", "Kelvin apache License version 2", "under the mit license" * 3, "see the LICENSE file", "BSD 3-Clause License and Apache License 2.0 and GPLv3",
]


def test_known_texts(spark):
    check(spark, TEXTS)
    rows = found(spark, TEXTS)
    labels = {i: sorted({d.label for d in r.detections}) for i, r in rows.items()}
    assert labels[0] == ["apache-2"] and labels[5] == ["lgpl-2.1"] and labels[6] == ["gpl-3"] and labels[7] == ["gpl-2"] and labels[8] == ["cc-by-nc"] and labels[9] == ["mit"] and labels[22] == ["apache-2", "bsd-3-clause", "gpl-3"]
    assert labels[11] == [] and rows[2].n_base == 3 and rows[16].base_labels == [] and rows[20].n_base == 0


def test_random_mixtures(spark):
    rng = random.Random(3)
    vocabulary = sorted({w for _, _, _, t in S.RULES for w in words(sample(t))})
    parts = [sample(r[3]) for r in S.RULES]
    texts = []
    for _ in range(150):
        pieces = [rng.choice(parts) if rng.random() < 0.5 else " ".join(rng.choices(vocabulary, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 12))]
        texts.append(rng.choice([" ", ", ", "-", "\n", "  "]).join(pieces) + rng.choice(["", " licensed under the mit license"]))
    check(spark, texts)


def test_odd_rows(spark, tmp_path):
    df = odd.documents(spark).withColumnRenamed("size", "rule").withColumnRenamed("key", "base").withColumnRenamed("bucket", "found")
    rows = S.find_licenses(df)
    assert rows.count() == 10
    again = spark.createDataFrame([(1, "under the MIT License")] * 2000 + [(None, "CC BY-NC"), (None, None)], "doc_id long, text string")
    again.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = S.op12_license_signatures(spark, str(tmp_path)).collect()
    assert len(rows) == 2002 and sum(r.labels == "mit" and r.first_word == 0 for r in rows) == 2000 and sum(r.labels == "cc-by-nc" and r.doc_id is None for r in rows) == 1
    assert S.find_licenses(odd.empty(spark)).count() == 0


def test_time_is_linear_in_the_detections(spark):
    """One text with very many overlapping detections."""

    def seconds(n):
        df = spark.createDataFrame([(1, "licensed under the gnu lesser general public license version 2.1 or later " * n)], "doc_id long, text string")
        began = time.perf_counter()
        (r,) = S.find_licenses(df).collect()
        assert len(r.detections) == n
        return time.perf_counter() - began

    seconds(100)
    assert seconds(20_000) < 3 * seconds(10_000) + 2


def test_sql_of_the_query(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, *(sample(r[3]) for r in S.RULES)])], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = S.op12_license_signatures(spark, str(tmp_path)), c.sql(S.OP12_SQL)
    assert got.columns == want.columns
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want.fetchall()))
