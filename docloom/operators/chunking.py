"""Section chunks: lines, sections and the merge of short ones within a row."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import char_count, slugify, strip, word_count
from docloom.sources.frontmatter import parse_frontmatter


@dataclass(frozen=True)
class Headings:
    """Patterns of the heading lines, tested in this order on stripped lines.

    chapter, appendix and sub: group 1 is the title. sub counts inside an
    appendix only. article: group `number` and group `title`. mark: what stands in
    every heading line, so that a text without it has none; empty if unknown.
    """

    chapter: str
    appendix: str
    sub: str
    article: str
    number: int
    title: int
    appendix_label: str
    article_word: str
    mark: str = ""


# Headings of Vietnamese regulations in markdown.
REGULATION = Headings(
    chapter="(?iu)^##\\s+(Chương\\s+[IVXLC\\d]+\\.?\\s*.+)",
    appendix="(?iu)^##\\s+(Phụ lục(?U:\\s*\\w*[.\\s]*).+)",
    sub="(?iu)^###\\s+(Nơi cấp chứng chỉ|Thời hạn chứng chỉ|Cách tính điểm thi|Bảng quy đổi .+)",
    article="^(#{2,3})\\s+Điều\\s+(\\d+)\\.?\\s*(.*)",
    number=2,
    title=3,
    appendix_label="(?iu)Phụ lục\\s+([IVXLC\\d]+)",
    article_word="Điều",
    mark="##",
)

# For running text without markup: a short line heads what follows.
PROSE = Headings(
    chapter="^(.{1,12})$", appendix="^(Annex .*)$", sub="^(Table .*)$", article="^()(.{13,40})()$", number=3, title=2, appendix_label="^Annex ([0-9]+)", article_word="Section"
)

# The output columns of chunks.
CHUNK_COLUMNS = (
    "chunk_id", "doc_id", "title", "decision_no", "issued_date", "institution", "education_mode", "chapter_title",
    "section_title", "section_number", "chunk_type", "source_path", "source_pdf", "text", "char_count", "word_count",
)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _counts(letters: Column, mark: str) -> Column:
    """For each letter of a string the number of marks up to and with it."""
    parts = F.regexp_extract_all(F.concat(F.lit(mark), letters), F.lit(f"{mark}[^{mark}]*"), F.lit(0))
    # The leading mark is not of the string: it opens the part before the first.
    return F.flatten(F.transform(parts, lambda p, i: F.array_repeat(i, F.length(p) - F.when(i == 0, 1).otherwise(0))))


# One letter for each kind of line.
KINDS = {"c": "chapter_header", "a": "appendix", "d": "dieu", "s": "appendix_sub", "-": "preamble"}


def section_array(body: Column, headings: Headings = REGULATION) -> Column:
    """The sections of a text as an array of structs (seg_id, chunk_type, heading,
    chapter_title, appendix_label, appendix_sub, text) in order, empty ones left
    out; null for null. Everything happens within the row: a kind for each line,
    cuts at headings, and what holds from the last chapter or appendix by
    numbering them. Work is linear in the lines. A text without headings is one
    section, which takes none of this."""
    h = headings

    def label(s: Column) -> Column:
        name = F.regexp_extract(s, h.appendix, 1)
        return _let(F.regexp_extract(name, h.appendix_label, 1), lambda n: F.when(n != "", n).otherwise(slugify(strip(name))))

    def inside(main: Column) -> Column:
        """Whether the last chapter, appendix or article before a line is an
        appendix; place 0 is of an invented line before the first."""
        parts = F.regexp_extract_all(F.concat(F.lit("x"), F.array_join(main, "")), F.lit("[xcad]-*"), F.lit(0))
        after = lambda p: F.startswith(p, F.lit("a"))
        return _let(
            parts,
            lambda ps: F.flatten(F.transform(ps, lambda p, i: F.concat(F.array(F.coalesce(after(F.get(ps, i - 1)), F.lit(False))), F.array_repeat(after(p), F.length(p) - 1)))),
        )

    def kinds(bare: Column) -> Column:
        main = F.transform(bare, lambda s: F.when(s.rlike(h.chapter), "c").when(s.rlike(h.appendix), "a").when(s.rlike(h.article), "d").otherwise("-"))
        sub = lambda s, k, within: within & k.isin("-", "d") & s.rlike(h.sub)
        return _let(main, lambda m: _let(inside(m), lambda w: F.transform(bare, lambda s, i: F.when(sub(s, m[i], w[i + 1]), "s").otherwise(m[i]))))

    def sections(lines: Column, bare: Column, kind: Column, starts: Column) -> Column:
        letters = F.array_join(F.transform(starts, lambda i: kind[i]), "")
        titles = F.transform(F.filter(bare, lambda s, i: kind[i] == "c"), lambda s: strip(F.regexp_extract(s, h.chapter, 1)))
        labels = F.transform(F.filter(bare, lambda s, i: kind[i] == "a"), label)

        def section(at: Column, j: Column, chapter: Column, appendix: Column, title: Column, name: Column) -> Column:
            k, s = kind[at], bare[at]
            until = F.coalesce(F.get(starts, j + 1), F.size(lines))
            kept = F.concat(F.array(F.when(k == "-", lines[at]).otherwise(s)), F.slice(lines, at + 2, until - at - 1))
            of = F.lit(KINDS["-"])
            for letter, word in KINDS.items():
                of = F.when(k == letter, word).otherwise(of)
            return F.struct(
                (j + F.when(kind[0] == "-", 0).otherwise(1)).cast("long").alias("seg_id"), of.alias("chunk_type"), F.when(k == "-", "").otherwise(s).alias("heading"),
                F.coalesce(F.get(title, chapter[j] - 1), F.lit("")).alias("chapter_title"), F.coalesce(F.get(name, appendix[j] - 1), F.lit("")).alias("appendix_label"),
                F.when(k == "s", strip(F.regexp_extract(s, h.sub, 1))).alias("appendix_sub"), strip(F.array_join(kept, "\n")).alias("text"),
            )

        return _let(
            F.struct(_counts(letters, "c").alias("c"), _counts(letters, "a").alias("a"), titles.alias("t"), labels.alias("l")),
            lambda v: F.transform(starts, lambda at, j: section(at, j, v["c"], v["a"], v["t"], v["l"])),
        )

    def starts_of(kind: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(kind) - 1), lambda i: (i == 0) | (kind[i] != "-"))

    found = _let(
        F.split(body, "\n", -1),
        lambda lines: _let(F.transform(lines, strip), lambda bare: _let(kinds(bare), lambda kind: _let(starts_of(kind), lambda starts: sections(lines, bare, kind, starts)))),
    )
    none = F.lit("")
    plain = F.struct(
        F.lit(0).cast("long").alias("seg_id"), F.lit(KINDS["-"]).alias("chunk_type"), none.alias("heading"), none.alias("chapter_title"), none.alias("appendix_label"), F.lit(None).cast("string").alias("appendix_sub"), strip(body).alias("text"),
    )
    return F.filter(F.when(body.contains(h.mark), found).when(body.isNotNull(), F.array(plain)), lambda x: x["text"] != "")


def line_segments(docs: DataFrame, headings: Headings = REGULATION) -> DataFrame:
    """section_array of docs (doc_id, body) as rows, other columns kept."""
    rest = [c for c in docs.columns if c != "body"]
    # The outer form, whose plan doesn't compute the array once more to see whether it is empty.
    return docs.select(*rest, F.inline_outer(section_array(F.col("body"), headings))).where("text is not null")


def name_sections(segments: DataFrame, headings: Headings = REGULATION) -> DataFrame:
    """Adds section_title, section_number and chunk_id."""
    h, kind, heading = headings, F.col("chunk_type"), F.col("heading")
    bare = strip(F.regexp_replace(heading, "^#+", ""))
    number = F.regexp_extract(heading, h.article, h.number)
    title = strip(F.concat(F.lit(f"{h.article_word} "), number, F.lit(". "), F.regexp_extract(heading, h.article, h.title)))
    named = F.when(kind == "dieu", F.regexp_replace(title, "\\.\\s*$", "")).when(kind == "appendix_sub", F.coalesce("appendix_sub", bare)).otherwise(bare)
    named = segments.withColumn("section_title", named).withColumn("section_number", F.when(kind == "dieu", number).otherwise(F.lit("")))
    label = slugify(F.col("appendix_label"))
    doc = F.col("doc_id").cast("string")
    chunk_id = (
        F.when(kind == "dieu", F.concat(doc, F.lit("__dieu_"), F.col("section_number")))
        .when(kind == "appendix", F.concat(doc, F.lit("__phu_luc_"), label))
        .when(kind == "appendix_sub", F.concat(doc, F.lit("__phu_luc_"), label, F.lit("__"), slugify(F.col("section_title"))))
        .when(kind == "chapter_header", F.concat(doc, F.lit("__chuong_"), slugify(F.col("section_title"))))
        .otherwise(F.concat(doc, F.lit("__preamble")))
    )
    return named.withColumn("chunk_id", chunk_id)


def merge_array(sections: Column, fields: Sequence[str], min_chars: int = 80) -> Column:
    """Chunks of an array of sections (fields, among them text) in order: those
    below min_chars are appended to the chunk before them, the first always
    starts one. Each gives chunk_no from 1, the fields of its first section and
    the joined text."""

    def chunk(all_: Column, starts: Column, at: Column, j: Column) -> Column:
        size = F.coalesce(F.get(starts, j + 1), F.size(all_)) - at
        text = F.array_join(F.transform(F.slice(all_, at + 1, size), lambda x: x["text"]), "\n\n")
        return F.struct((j + 1).cast("long").alias("chunk_no"), *[all_[at][c].alias(c) for c in fields if c != "text"], text.alias("text"))

    def starts_of(all_: Column) -> Column:
        return F.filter(F.transform(all_, lambda x, i: F.when((i == 0) | (F.length(x["text"]) >= min_chars), i)), lambda i: i.isNotNull())

    return _let(sections, lambda all_: _let(starts_of(all_), lambda starts: F.transform(starts, lambda at, j: chunk(all_, starts, at, j))))


SECTION_FIELDS = ("seg_id", "chunk_type", "heading", "chapter_title", "appendix_label", "appendix_sub", "text")


def _counted(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("char_count", char_count(F.col("text"))).withColumn("word_count", word_count(F.col("text")))


def merged_sections(docs: DataFrame, headings: Headings = REGULATION, min_chars: int = 80) -> DataFrame:
    """Named chunks of docs (doc_id, body), other columns kept. A document is one
    row throughout, so nothing is shuffled."""
    rest = [c for c in docs.columns if c != "body"]
    merged = merge_array(section_array(F.col("body"), headings), SECTION_FIELDS, min_chars)
    return _counted(name_sections(docs.select(*rest, F.inline_outer(merged)).where("chunk_no is not null"), headings))


def merge_short(segments: DataFrame, min_chars: int = 80) -> DataFrame:
    """merge_array for sections that are rows already (doc_id, seg_id, text and
    other orderable columns): one shuffle brings those of a document together."""
    fields = ["seg_id", *[c for c in segments.columns if c not in ("doc_id", "seg_id")]]
    rows = segments.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("sections"))
    return _counted(rows.select("doc_id", F.inline_outer(merge_array(F.col("sections"), fields, min_chars))))


def document_fields(docs: DataFrame) -> DataFrame:
    """docs (path, text) with doc_id, the metadata columns and body. doc_id
    falls back to the slug of the path, source_pdf to two other keys."""
    parsed = parse_frontmatter(docs)

    def meta(key: str) -> Column:
        return F.col("metadata").getItem(key)

    pdf = F.coalesce(*[F.nullif(meta(k), F.lit("")) for k in ("source_pdf", "parsed_source", "ocr_source")], F.lit(""))
    plain = [F.coalesce(meta(k), F.lit("")).alias(k) for k in ("title", "decision_no", "issued_date", "institution", "education_mode")]
    doc_id = F.coalesce(F.nullif(meta("doc_id"), F.lit("")), slugify(F.regexp_replace("path", "\\.[^./]*$", "")))
    return parsed.select(doc_id.alias("doc_id"), *plain, pdf.alias("source_pdf"), F.col("path").alias("source_path"), "body")


def build_chunks(docs: DataFrame, min_chars: int = 80, headings: Headings = REGULATION) -> DataFrame:
    """Chunks of docs (path, text): the 16 chunk columns and chunk_no."""
    return merged_sections(document_fields(docs), headings, min_chars).select(*CHUNK_COLUMNS, "chunk_no")


def chunks_per_document(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
