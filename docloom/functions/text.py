"""Text functions as Column expressions: folding, tokens, slugs, counts."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Letters of the pieces by which phrases and texts are joined.
GRAM = 3


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str]:
    """Letters that carry a mark and the single letters they fold to, from the
    canonical decompositions of U+0080 to U+2FFF, with the barred d."""
    source, target = ["đ", "Đ"], ["d", "D"]
    for point in range(0x80, 0x3000):
        char = chr(point)
        bare = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
        if len(bare) == 1 and bare != char:
            source.append(char)
            target.append(bare)
    return "".join(source), "".join(target)


def normalize_text(text: Column) -> Column:
    """Lower case without marks; null is empty."""
    source, target = fold_table()
    t = F.coalesce(text, F.lit(""))
    bare = F.regexp_replace(F.translate(t, source, target), "\\p{Mn}", "")
    # Most text has nothing to fold, and a look is cheaper than a table.
    return F.lower(F.when(t.rlike("[^\\x00-\\x7F]"), bare).otherwise(t))


def normalize_literal(text: str) -> str:
    """The same for a constant, on the driver."""
    bare = "".join(c for c in unicodedata.normalize("NFD", text.replace("đ", "d").replace("Đ", "D")) if unicodedata.category(c) != "Mn")
    return bare.lower()


def tokens(text: Column) -> Column:
    """Ordered tokens, repeats kept."""
    return F.regexp_extract_all(normalize_text(text), F.lit("[a-z0-9]+"), F.lit(0))


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(normalize_text(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(F.regexp_replace(text, "(?U)^\\s+", ""), "(?U)\\s+$", "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "(?U)\\s+"), lambda w: w != ""))


def char_count(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit("")))


def preview(text: Column, size: int = 300, more: str = "...", cut_first: bool = False) -> Column:
    """One line of at most `size` characters, with a mark where it is cut.
    cut_first: cut before line breaks become spaces and ends are stripped."""
    t = F.coalesce(text, F.lit(""))
    flat = strip(F.regexp_replace(F.substring(t, 1, size) if cut_first else t, "\n", " "))
    if cut_first:
        return F.when(F.length(t) > size, F.concat(flat, F.lit(more))).otherwise(flat)
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size), F.lit(more))).otherwise(flat)


def contains_any(text: Column, phrases: list[str] | tuple[str, ...]) -> Column:
    """Whether normalised text holds any phrase, as a plain substring."""
    found = F.lit(False)
    for phrase in phrases:
        found = found | text.contains(normalize_literal(phrase))
    return found


def grams(word: Column, size: Column) -> Column:
    """The distinct pieces of `size` letters of a word."""
    starts = F.when(F.length(word) >= size, F.sequence(F.lit(1), F.length(word) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: word.substr(i, size)))


def pieces(text: Column) -> Column:
    """All distinct pieces of 1 to GRAM letters. A phrase stands in a text only
    if its first GRAM letters do, so the two can be joined by equal pieces."""
    return F.flatten(F.array(*[grams(text, F.lit(n)) for n in range(1, GRAM + 1)]))


def section_order(number: Column) -> list[Column]:
    """Sort keys: numbers first and by value, then other strings."""
    n = strip(F.coalesce(number.cast("string"), F.lit("")))
    numeric = n.rlike("^[0-9]+$")
    return [F.when(numeric, 0).otherwise(1), F.when(numeric, n.try_cast("decimal(38,0)")), n]


def valid_date(value: Column) -> Column:
    """Whether a string is null or a real YYYY-MM-DD date."""
    return value.isNull() | (value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(value, "yyyy-MM-dd").isNotNull())


def date_or_null(value: Column) -> Column:
    return F.when(value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(value, "yyyy-MM-dd"))


def score_text(score: Column, places: int = 2) -> Column:
    return F.format_string(f"%.{places}f", score)
