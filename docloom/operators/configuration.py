"""Domain configurations as rows: what is wrong with each of many JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The keys that a configuration, and each of its issues, must have.
TOP_KEYS = (
    "domain_id", "domain_name", "version", "language", "institution", "fallback_scope_disclaimer", "current_semester_missing_notice_message", "certificate_keywords", "current_semester_keywords",
    "document_types", "issue_definitions",
)
TOP_LISTS = ("certificate_keywords", "current_semester_keywords", "document_types", "issue_definitions")
ISSUE_KEYS = ("issue_type", "label", "keywords", "query_default", "answer_template")
ISSUE_LISTS = ("keywords", "query_when")
CONDITION_KEYS = ("condition_keywords", "query")

MISSING, NO_LIST, NO_OBJECT, NO_JSON, REPEATED = "missing", "not a list", "not an object", "not JSON", "repeated"


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit(kind)), F.lit(False))


def _get(value: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{key}", kind)


def _key_errors(value: Column, place: Column, required: tuple[str, ...], lists: tuple[str, ...]) -> list[Column]:
    """A key may be null and counts as there; what is there must have its kind."""
    at = lambda k, error: F.struct(F.concat(place, F.lit(f".{k}")).alias("place"), F.lit(error).alias("error"))
    return [F.when(_get(value, k).isNull(), at(k, MISSING)) for k in required] + [F.when(_get(value, k).isNotNull() & ~_is(_get(value, k), "ARRAY"), at(k, NO_LIST)) for k in lists]


def _nested(values: Column, place: Column, errors) -> Column:
    """The errors of each element, whose places are numbered."""
    numbered = lambda v, i: errors(v, i, F.concat(place, F.lit("["), i.cast("string"), F.lit("]")))
    return F.coalesce(F.flatten(F.transform(values, numbered)), F.array().cast("array<struct<place:string,error:string>>"))


def _condition(value: Column, i: Column, place: Column) -> Column:
    wrong = F.array(F.struct(place.alias("place"), F.lit(NO_OBJECT).alias("error")))
    return F.when(_is(value, "OBJECT"), F.array(*_key_errors(value, place, CONDITION_KEYS, ()))).otherwise(wrong)


def _issue(types: Column):
    def errors(value: Column, i: Column, place: Column) -> Column:
        wrong = F.array(F.struct(place.alias("place"), F.lit(NO_OBJECT).alias("error")))
        # Positions count from 1: an earlier issue of the same type stands at i or before.
        again = F.coalesce(F.array_position(types, types[i]) <= i, F.lit(False))
        own = [F.when(again, F.struct(F.concat(place, F.lit(".issue_type")).alias("place"), F.lit(REPEATED).alias("error")))]
        own = F.array(*own, *_key_errors(value, place, ISSUE_KEYS, ISSUE_LISTS))
        when = _nested(_get(value, "query_when", "array<variant>"), F.concat(place, F.lit(".query_when")), _condition)
        return F.when(_is(value, "OBJECT"), F.concat(own, when)).otherwise(wrong)

    return errors


def config_errors(configs: DataFrame) -> DataFrame:
    """(path, place, error) of configs (path, text): one row for each thing that
    is wrong, none for a sound configuration. A text that is null, no JSON or has
    a key twice in an object is `not JSON`. Rows are independent, so any number of
    files is validated in one pass without a shuffle."""
    v, root = F.col("v"), F.lit("$")
    defs = _get(v, "issue_definitions", "array<variant>")
    types = F.transform(defs, lambda d: _get(d, "issue_type", "string"))
    issues = F.transform(F.array(types), lambda t: _nested(defs, F.lit("$.issue_definitions"), _issue(t)))[0]
    whole = lambda error: F.array(F.struct(root.alias("place"), F.lit(error).alias("error")))
    found = F.when(v.isNull(), whole(NO_JSON)).when(~_is(v, "OBJECT"), whole(NO_OBJECT)).otherwise(F.concat(F.array(*_key_errors(v, root, TOP_KEYS, TOP_LISTS)), issues))
    parsed = configs.select("path", F.try_parse_json("text").alias("v"))
    return parsed.select("path", F.explode_outer(found).alias("e")).where("e is not null").select("path", "e.place", "e.error")
