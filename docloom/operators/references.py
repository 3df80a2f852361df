"""Citations of articles in running text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import strip

# What a citation looks like, from the deepest form to the plainest.
POINT = "đi[eể]m\\s+([a-zđ])\\s*,?\\s*"
CLAUSE = "kho[aả]n\\s+(\\d+[a-zđ]?)\\s*,?\\s*"
ARTICLE = "đi[eề]u\\s+(\\d+|n[aà]y)"
PLAIN = "đi[eề]u\\s+(\\d+)"
# Every form begins with one of two letters, in either case (k has a third form).
ANY = f"(?iu)(?=[đĐkK\u212a])(?:(?:{POINT})?{CLAUSE}{ARTICLE}|{PLAIN})"


def cross_references(chunks: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, level, pos, diem, khoan, dieu) of each citation.

    Headings and table lines are blanked first. One alternation finds the
    deepest form at each place, so a part of a citation is not found again.
    'this article' is the chunk's own number, or nothing if it has none. level
    and pos give the order: deep, middle, base, each as in the text.
    """
    text = F.coalesce("text", F.lit(""))
    # Only lines with a mark of a heading or table are looked at.
    text = F.when(text.rlike("[#|]"), F.regexp_replace(text, "(?mU)^\\s*[#|].*$", " ")).otherwise(text)
    number = strip(F.coalesce("section_number", F.lit("")))
    own = F.when(number.rlike("^[0-9]+$"), number)
    # A citation has no control characters, so its four groups can be told apart by one.
    cites = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda c: F.split(F.regexp_replace(c, ANY, "$1\u0001$2\u0001$3\u0001$4"), "\u0001", -1))
    found = chunks.select("chunk_id", "doc_id", own.alias("own"), F.posexplode(cites).alias("pos", "cite"))
    diem, khoan, deep, plain = (F.nullif(F.col("cite")[i], F.lit("")) for i in range(4))
    level = F.when(diem.isNotNull(), 0).when(khoan.isNotNull(), 1).otherwise(2)
    article = F.coalesce(deep, plain)
    dieu = F.when(F.substring(article, 1, 1).between("0", "9"), article).otherwise(F.col("own"))
    return found.select("chunk_id", "doc_id", level.alias("level"), "pos", diem.alias("diem"), khoan.alias("khoan"), dieu.alias("dieu")).where("dieu is not null")


def link_references(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(source, pos, target) of the links of web pages."""
    links = F.regexp_extract_all(F.coalesce(html_col, F.lit("")), F.lit('href="([^"]*)"'), F.lit(1))
    return pages.select(F.col(id_col).alias("source"), F.posexplode(links).alias("pos", "target"))
