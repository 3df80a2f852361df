"""What a question says about time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import contains_any, normalize_text

# Normalised phrases.
CURRENT_SEMESTER = ("hoc ky nay", "hoc ky hien tai", "nam hoc nay", "han dang ky")
DEADLINE = ("deadline", "thoi han", "han chot", "khi nao", "bao gio", "lich thi", "lich hoc", "ngay thi", "ngay nop", "thoi gian")
NOTICE = ("lich nop", "thoi khoa bieu", "lich thi", "lich hoc", "ke hoach")
NO_REGISTRY = ("hoc ky nay", "hoc ky hien tai", "deadline", "thoi han", "han chot", "khi nao", "bao gio", "lich thi", "lich hoc")
TERM, YEAR = "hk|hoc ky", "nam hoc"


def time_context(question: Column, current: tuple[str, ...] = CURRENT_SEMESTER, deadline: tuple[str, ...] = DEADLINE, term: str = TERM, year: str = YEAR) -> Column:
    """struct<current_semester, semester, academic_year, has_deadline_intent>.
    Of several semesters named, the smallest counts."""
    q = normalize_text(question)
    semester = F.lit(None).cast("int")
    for n in (3, 2, 1):
        semester = F.when(q.rlike(f"\\b({term})\\s*{n}\\b"), n).otherwise(semester)
    pattern = f"{year}\\s*(\\d{{4}})[-/](\\d{{4}})"
    years = F.when(q.rlike(pattern), F.concat_ws("-", F.regexp_extract(q, pattern, 1), F.regexp_extract(q, pattern, 2)))
    return F.struct(
        contains_any(q, current).alias("current_semester"), semester.alias("semester"), years.alias("academic_year"), contains_any(q, deadline).alias("has_deadline_intent")
    )


def requires_current_notice(question: Column, current: tuple[str, ...] = CURRENT_SEMESTER, deadline: tuple[str, ...] = DEADLINE, extra: tuple[str, ...] = NOTICE) -> Column:
    return contains_any(normalize_text(question), (*current, *deadline, *extra))


def asks_about_current_term(question: Column, keywords: tuple[str, ...] = NO_REGISTRY) -> Column:
    """The test that is used without a document registry."""
    return contains_any(normalize_text(question), keywords)
