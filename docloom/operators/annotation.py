"""Rule tags: phrase tests on the folded title and text of each chunk, compiled
to one expression for each tag array. No join, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import contains_any, normalize_text, strip
from docloom.plans.profile import POLICY_TAGS, TAG_FIELDS, TagGroup


def tag_arrays(text: Column, groups: tuple[TagGroup, ...], doc_id: Column | None = None, section: Column | None = None) -> dict[str, Column]:
    """For each tag field, the array of its tags, each once, in rule order.
    text: normalised."""
    found: dict[str, list[Column]] = {f: [] for f in TAG_FIELDS}
    for group in groups:
        gate = contains_any(text, group.gate)
        if group.document is not None and doc_id is not None and section is not None:
            gate = gate | ((doc_id == group.document) & strip(F.coalesce(section, F.lit(""))).isin(*group.sections))
        for rule in group.rules:
            holds = gate
            if rule.any_of:
                holds = holds & contains_any(text, rule.any_of)
            if rule.and_any_of:
                holds = holds & contains_any(text, rule.and_any_of)
            for name, tag in rule.tags:
                found.setdefault(name, []).append(F.when(holds, F.lit(tag)))
    empty = F.array().cast("array<string>")
    return {name: F.array_distinct(F.array_compact(F.array(*tags))) if tags else empty for name, tags in found.items()}


def annotate_chunks(chunks: DataFrame, groups: tuple[TagGroup, ...] = POLICY_TAGS) -> DataFrame:
    """chunks with the eight tag arrays."""
    # Folded once: the column is referenced by many tests.
    folded = chunks.withColumn("_folded", F.concat_ws(" ", normalize_text(F.col("section_title")), normalize_text(F.col("text"))))
    arrays = tag_arrays(F.col("_folded"), groups, F.col("doc_id").cast("string"), F.col("section_number"))
    return folded.select(*chunks.columns, *[c.alias(name) for name, c in arrays.items()])


def tag_frequency(annotated: DataFrame, fields: tuple[str, ...] = ("policy_area", "action_tags")) -> DataFrame:
    """(field, tag, n_chunks)."""
    def tagged(name: str) -> Column:
        return F.transform(name, lambda t: F.struct(F.lit(name).alias("field"), t.alias("tag")))

    # One scan for all fields.
    pairs = annotated.select(F.explode(F.concat(*map(tagged, fields))).alias("p")).select("p.*")
    return pairs.groupBy("field", "tag").agg(F.count("*").alias("n_chunks"))
