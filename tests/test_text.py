from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import temporal, text
from docloom.sources.frontmatter import parse_frontmatter


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).first().r


def test_folding_and_tokens(spark):
    assert one(spark, "Điều 1. Phạm vi điều chỉnh!", text.tokens) == ["dieu", "1", "pham", "vi", "dieu", "chinh"]
    assert one(spark, None, text.normalize_text) == "" and one(spark, "ĐÀO tạo é", text.normalize_text) == text.normalize_literal("ĐÀO tạo é") == "dao tao e"
    assert one(spark, "a b a", text.tokens) == ["a", "b", "a"] and one(spark, "", text.tokens) == []
    assert one(spark, "  Phụ lục I. -- Bảng  ", text.slugify) == "phu_luc_i_bang"


def test_counts_and_strip(spark):
    assert one(spark, "a b c  d", text.word_count) == 4 and one(spark, None, text.word_count) == 0 and one(spark, "a😀", text.char_count) == 2
    assert one(spark, "  x y \n", text.strip) == "x y"
    assert one(spark, "ab\ncd", lambda c: text.preview(c, 4)) == "ab c..." and one(spark, "ab\ncd", lambda c: text.preview(c, 3, "…", True)) == "ab…"


def test_dates_and_order(spark):
    rows = [("2024-02-29", True), ("2023-02-29", False), ("2024-2-9", False), (None, True), ("", False)]
    got = spark.createDataFrame(rows, "d string, ok boolean").select("ok", text.valid_date(F.col("d")).alias("v")).collect()
    assert all(r.ok == r.v for r in got)
    names = spark.createDataFrame([("10",), ("9",), ("A",), ("",)], "s string")
    assert [r.s for r in names.orderBy(*text.section_order(F.col("s"))).collect()] == ["9", "10", "", "A"]


def test_time_context(spark):
    c = one(spark, "Hạn chót đăng ký học kỳ 2, năm học 2025-2026?", temporal.time_context)
    assert (c.current_semester, c.semester, c.academic_year, c.has_deadline_intent) == (False, 2, "2025-2026", True)
    assert one(spark, "HK 3 và hk1", temporal.time_context).semester == 1
    assert one(spark, "Kế hoạch năm nay", temporal.requires_current_notice) and not one(spark, "Điều kiện tốt nghiệp", temporal.requires_current_notice)
    assert one(spark, "Lịch thi?", temporal.asks_about_current_term)


def test_frontmatter(spark):
    cases = [
        ("---\na: 1\nb: \"x y\"\nc: p\n  q\n\tr\n---\nbody\nmore", {"a": "1", "b": "x y", "c": "p q r"}, "body\nmore"), ("no block", {}, "no block"), ("---\na: 1\nopen", {}, "---\na: 1\nopen"),
        ("---\na: 1\nlost\n  tail\na: 2\n---\n", {"a": "2"}, ""), ("", {}, ""), (None, {}, ""),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, text string")
    for r in parse_frontmatter(df).collect():
        assert (r.metadata, r.body) == (cases[r.i][1], cases[r.i][2])
