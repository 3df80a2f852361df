"""Frontmatter: the key-value block between '---' lines at the head of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import strip

# An entry: a key, its value, and the lines that continue it.
ENTRY = "(?dm)^([A-Za-z_][A-Za-z0-9_]*):[^\\S\\n]*([^\\n]*)((?:\\n(?:  |\\t)[^\\n]*)*)"


def _unquoted(value: Column) -> Column:
    quoted = ((value.startswith('"') & value.endswith('"')) | (value.startswith("'") & value.endswith("'"))) & (F.length(value) > 1)
    return F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).when(value.isin('"', "'"), "").otherwise(value)


def parse_frontmatter(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with metadata map<string,string> and body.

    Without a block, or with one that is not closed, metadata is empty and body
    the whole text. Lines that begin with two spaces or a tab continue the key
    before; any other line ends it; the last of equal keys wins.
    """
    # Each step is a column that the next ones use more than once; so it is
    # computed once a row and not put in place of its name.
    def rule(line: Column) -> Column:
        return line.contains("---") & (strip(line) == "---")

    lines, closing, entries = F.col("_lines"), F.col("_closing"), F.col("_entries")
    rows = df.withColumn("_lines", F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1))
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    found = F.when(rule(F.element_at(lines, 1)), F.array_position(F.transform(rest, rule), True))
    rows = rows.withColumn("_closing", F.coalesce(found, F.lit(0)).cast("int"))
    block = F.when(closing > 1, F.array_join(F.slice(lines, F.lit(2), closing - 1), "\n")).otherwise("")
    rows = rows.withColumn("_block", block)
    keys, values, more = (F.regexp_extract_all("_block", F.lit(ENTRY), F.lit(n)) for n in (1, 2, 3))
    whole = F.zip_with(values, more, lambda v, m: strip(F.concat(v, F.array_join(F.transform(F.split(m, "\n", -1), strip), " "))))
    pairs = F.zip_with(keys, F.transform(whole, _unquoted), lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    rows = rows.withColumn("_entries", pairs)
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = F.transform(names, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"].alias("value")))
    body = F.when(closing > 0, F.array_join(F.slice(lines, closing + 2, F.size(lines)), "\n")).otherwise(F.coalesce(F.col(text_col), F.lit("")))
    return rows.withColumn("metadata", F.map_from_entries(last)).withColumn("body", body).drop("_lines", "_closing", "_block", "_entries")
