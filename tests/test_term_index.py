"""The stored index gives what scoring the texts gives, and reads no text."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import retrieval
from docloom.operators.term_index import TermIndex

CHUNK = "chunk_id string, doc_id string, section_number string, section_title string, chapter_title string, text string, policy_area array<string>, action_tags array<string>"
QUERY = "question_id string, issue_idx int, query string, policy_area string"
WORDS = ["hoc", "vien", "dang", "ky", "mon", "Điều", "xét", "miễn", "a", "ab", "kyab", "monx", "tot", "nghiep"]


def rows(n, seed, first=0):
    rng = random.Random(seed)
    text = lambda most: " ".join(rng.choices(WORDS, k=rng.randint(0, most)))
    return [(f"c{first + i}", f"d{i % 7}", str(rng.choice([1, 9, 10, "A"])), text(4), text(2), rng.choice([None, text(30), text(400)]), rng.sample(["x", "y", "hoc"], rng.randint(0, 2)), [text(1)]) for i in range(n)]


def questions(spark, seed=1, n=40, area=True):
    rng = random.Random(seed)
    made = [(f"q{i}", i % 2, " ".join(rng.choices(WORDS, k=rng.randint(0, 7))), rng.choice([None, None, "x", "none"]) if area else None) for i in range(n)]
    made += [("one", 0, "ab", None), ("part", 0, "b mo", None), ("inside", 0, "y", None), ("two", 0, "ky mon", None), ("ends", 0, "b mon ho", None), ("empty", 0, "!", None), ("none", 0, "zzz yyy xxx", None)]
    return spark.createDataFrame(made, QUERY)


def found(df):
    return sorted((r.question_id, r.issue_idx, r["rank"], r.chunk_id, round(r.score, 6)) for r in df.collect())


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return TermIndex(spark, str(tmp_path_factory.mktemp("index"))).append(spark.createDataFrame(rows(400, 3), CHUNK))


@pytest.mark.parametrize("k", [1, 5])
def test_equals_scoring_the_texts(spark, index, k):
    chunks, asked = spark.createDataFrame(rows(400, 3), CHUNK), questions(spark)
    assert found(index.top_k(asked, k)) == found(retrieval.top_k(retrieval.lexical_scores(chunks, asked), chunks, k))
    assert found(index.bm25_top_k(asked, k)) == found(retrieval.top_k(retrieval.bm25_scores(chunks, asked), chunks, k))


def test_bonus(spark, index):
    chunks, asked = spark.createDataFrame(rows(400, 3), CHUNK), questions(spark)
    bonus = spark.createDataFrame([(f"q{i}", f"c{(i * 37) % 450}", float(i % 9)) for i in range(40)], "question_id string, chunk_id string, bonus double")
    assert found(index.top_k(asked, 3, bonus)) == found(retrieval.top_k(retrieval.lexical_scores(chunks, asked, bonus), chunks, 3))


def test_appended_and_replaced_chunks(spark, tmp_path):
    first, second, third = rows(120, 4), rows(60, 5, 120), rows(50, 6, 90)
    index = TermIndex(spark, str(tmp_path)).append(spark.createDataFrame(first, CHUNK), "f1")
    index = index.append(spark.createDataFrame(second, CHUNK)).append(spark.createDataFrame(third, CHUNK))
    assert index.version == 3 and [v[3] for v in index.versions] == [0, 0, 50] and index.versions[0][1] == "f1"
    last = {r[0]: r for r in [*first, *second, *third]}
    chunks, asked = spark.createDataFrame(list(last.values()), CHUNK), questions(spark, 2, 20)
    want = found(retrieval.top_k(retrieval.lexical_scores(chunks, asked), chunks, 4))
    assert found(index.top_k(asked, 4)) == want and found(TermIndex(spark, str(tmp_path)).top_k(asked, 4)) == want


def test_an_unfinished_segment_is_not_read(spark, tmp_path):
    index = TermIndex(spark, str(tmp_path)).append(spark.createDataFrame(rows(30, 1), CHUNK))
    index.chunks.drop("segment").write.parquet(f"{tmp_path}/chunks/segment=1")
    assert TermIndex(spark, str(tmp_path)).chunks.count() == 30
    assert TermIndex(spark, str(tmp_path)).append(spark.createDataFrame(rows(30, 1, 30), CHUNK)).chunks.count() == 60


def test_a_second_batch_reads_the_index_alone(spark, index):
    plan = index.top_k(questions(spark, 9))._jdf.queryExecution().toString()
    assert index.path in plan and "regexp_extract_all(text" not in plan
    skipped = index.skipped(questions(spark, 9, area=False)).collect()
    assert all(0 <= r.skipped_blocks <= r.blocks and 0 <= r.skipped_postings <= r.postings for r in skipped) and sum(r.skipped_blocks for r in skipped) > 0


def test_empty_index(spark, tmp_path):
    assert TermIndex(spark, str(tmp_path)).top_k(questions(spark)).count() == 0
    assert TermIndex(spark, str(tmp_path)).append(spark.createDataFrame([], CHUNK)).top_k(questions(spark)).count() == 0


def test_few_rows_leave_the_packs(spark, index):
    """Not one for each question and chunk, also where two packs hold none that passes the filter."""
    asked = questions(spark).withColumn("policy_area", F.lit("x"))
    pairs = retrieval.lexical_scores(spark.createDataFrame(rows(400, 3), CHUNK), asked).count()
    packs = index.packs.count()
    for best in (retrieval.lexical_best, retrieval.bm25_best):
        moved = best(index.chunks, asked, 1, packs=index._given(None).drop("block", "segment")).count()
        assert 0 < moved <= 47 * packs < pairs
