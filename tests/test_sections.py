"""Sections and their merge within a row, against a plain reading of the lines."""

from __future__ import annotations

import random
import re
from dataclasses import replace

from pyspark.sql import functions as F

from docloom.operators import chunking, references

H = chunking.Headings(
    chapter="^## (Part .*)$", appendix="^## (Annex .*)$", sub="^###? (Table .*|Item .*)$", article="^(##) (?:Item) (\\d+)\\.?(.*)$", number=2, title=3, appendix_label="^Annex ([0-9]+)", article_word="Item"
)
POOL = ["## Part one", "  ## Part two  ", "## Annex 1 x", "## Annex B b", "### Table t", "## Item 3. three", "## Item 4", "## Table z", "text", "", "  indented", "a longer line of text that is kept", "\t"]


def plain_sections(body):
    found, chapter, label, within, held = [], "", "", False, None
    for line in body.split("\n"):
        s = line.strip()
        main = next((k for k, p in (("chapter_header", H.chapter), ("appendix", H.appendix), ("dieu", H.article)) if re.search(p, s)), None)
        kind = "appendix_sub" if within and main in (None, "dieu") and re.search(H.sub, s) else main
        if main:
            within = main == "appendix"
        if kind == "chapter_header":
            chapter = re.search(H.chapter, s)[1].strip()
        if kind == "appendix":
            name = re.search(H.appendix, s)[1]
            number = re.search(H.appendix_label, name)
            label = number[1] if number else re.sub("[^a-z0-9]+", "_", name.lower()).strip("_")
        if kind or held is None:
            held = [kind or "preamble", s if kind else "", chapter, label, [s if kind else line]]
            found.append(held)
        else:
            held[4].append(line)
    rows = [(*x[:4], "\n".join(x[4]).strip()) for x in found]
    return [r for r in rows if r[4]]


def plain_chunks(sections, least):
    chunks = []
    for r in sections:
        if chunks and len(r[4]) < least:
            chunks[-1] = (*chunks[-1][:4], chunks[-1][4] + "\n\n" + r[4])
        else:
            chunks.append(r)
    return chunks


def test_random_documents(spark):
    rng = random.Random(4)
    bodies = ["\n".join(rng.choices(POOL, k=rng.randrange(0, 25))) for _ in range(300)] + ["", "\n\n", "## Annex 1 x"]
    df = spark.createDataFrame([(i, b, "kept") for i, b in enumerate(bodies)] + [(len(bodies), None, "kept")], "doc_id long, body string, other string")
    columns = ("chunk_type", "heading", "chapter_title", "appendix_label", "text")
    lines = chunking.line_segments(df, H).collect()
    merged = chunking.merged_sections(df, H, 12).collect()
    assert {r.other for r in merged} == {"kept"} and {r.doc_id for r in lines} <= set(range(len(bodies)))
    for i, body in enumerate(bodies):
        want = plain_sections(body)
        assert [tuple(r[c] for c in columns) for r in sorted((r for r in lines if r.doc_id == i), key=lambda r: r.seg_id)] == want
        got = sorted((r for r in merged if r.doc_id == i), key=lambda r: r.chunk_no)
        assert [tuple(r[c] for c in columns) for r in got] == plain_chunks(want, 12) and [r.chunk_no for r in got] == list(range(1, len(got) + 1))


def test_no_exchange_and_long_document(spark):
    body = "\n".join("## Item %d\nline of it" % i for i in range(20_000))
    df = spark.createDataFrame([(1, body)], "doc_id long, body string")
    chunks = chunking.merged_sections(df, H, 12)
    assert "Exchange" not in chunks._jdf.queryExecution().executedPlan().toString()
    assert chunks.count() == 20_000


def test_rows_merge_as_arrays_do(spark):
    df = spark.createDataFrame([(1, "\n".join(POOL * 3)), (2, "text")], "doc_id long, body string")
    rows = chunking.merge_short(chunking.name_sections(chunking.line_segments(df, H), H), 12)
    fields = ["doc_id", "chunk_no", "chunk_id", "text", "char_count"]
    assert sorted(rows.select(fields).collect()) == sorted(chunking.merged_sections(df, H, 12).select(fields).collect())


def test_citations_share_no_part(spark):
    text = "ĐIỂM A,KHOẢN 2Điều 5; khoản 3 điều này và Điều 7khoản 8, Khoản 9đ Điều 1\x01\n  # Điều 4\n  | điều 6\nđiều ba"
    rows = [("c", "d", "x", text), ("own", "d", " 12 ", text), ("null", "d", None, None)]
    df = spark.createDataFrame(rows, "chunk_id string, doc_id string, section_number string, text string")
    got = references.cross_references(df).collect()
    assert [(r.level, r.pos, r.diem, r.khoan, r.dieu) for r in got if r.chunk_id == "c"] == [(0, 0, "A", "2", "5"), (2, 2, None, None, "7"), (1, 3, None, "9đ", "1")]
    assert [(r.level, r.dieu) for r in got if r.chunk_id == "own"] == [(0, "5"), (1, "12"), (2, "7"), (1, "1")] and {r.chunk_id for r in got} == {"c", "own"}


def test_texts_without_headings_are_one_section(spark):
    texts = [None, "", " \n\u3000", "part 1\nsupplier 2", "  a\r\n\n b \t\n", "# Chương I. x\nb", "## Chương I. x\nb", "a\n \u00a0## Điều 3. y\nb", "x ## y\nz", "\n## Phụ lục II. Bảng\nc\n### Nơi cấp chứng chỉ\nd", "Phụ lục I\nĐiều 1. a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, body string")
    every = replace(chunking.REGULATION, mark="")
    quick, slow = (sorted((r.doc_id, r.sections) for r in docs.select("doc_id", chunking.section_array(F.col("body"), h).alias("sections")).collect()) for h in (chunking.REGULATION, every))
    assert quick == slow and [len(s) if s is not None else None for _, s in quick] == [None, 0, 0, 1, 1, 1, 1, 2, 1, 2, 1]
    assert sorted(chunking.merged_sections(docs).collect()) == sorted(chunking.merged_sections(docs, every).collect())
