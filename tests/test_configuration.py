from __future__ import annotations

import json

from docloom.operators import configuration

SOUND = {
    **{k: "x" for k in configuration.TOP_KEYS}, **{k: [] for k in configuration.TOP_LISTS},
    "issue_definitions": [{"issue_type": "a", "label": "A", "keywords": ["k"], "query_default": "q", "answer_template": "t", "query_when": [{"condition_keywords": ["c"], "query": "q"}]}],
}


def errors(spark, **texts):
    rows = [(k, v if v is None or isinstance(v, str) else json.dumps(v)) for k, v in texts.items()]
    got = configuration.config_errors(spark.createDataFrame(rows, "path string, text string"))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    return sorted((r.path, r.place, r.error) for r in got.collect())


def test_sound_and_unreadable(spark):
    assert errors(spark, good=SOUND) == []
    found = errors(spark, good=SOUND, null=None, empty="", cut='{"a": ', list=[SOUND], number=3, twice='{"a": 1, "a": 2}')
    assert found == [("cut", "$", "not JSON"), ("empty", "$", "not JSON"), ("list", "$", "not an object"), ("null", "$", "not JSON"), ("number", "$", "not an object"), ("twice", "$", "not JSON")]


def test_keys_and_kinds(spark):
    bad = {k: v for k, v in SOUND.items() if k not in ("version", "document_types")} | {"certificate_keywords": "x", "current_semester_keywords": None, "language": None}
    assert errors(spark, c=bad) == [
        ("c", "$.certificate_keywords", "not a list"), ("c", "$.current_semester_keywords", "not a list"), ("c", "$.document_types", "missing"), ("c", "$.version", "missing"),
    ]
    assert errors(spark, c=SOUND | {"issue_definitions": {"a": 1}}) == [("c", "$.issue_definitions", "not a list")]
    assert errors(spark, c=SOUND | {"issue_definitions": []}) == []


def test_issues_and_conditions(spark):
    one = SOUND["issue_definitions"][0]
    defs = [one, None, 5, one | {"keywords": {}}, {"issue_type": "b", "query_when": "x"}, one | {"issue_type": "c", "query_when": [{"query": "q"}, [], None]}, {}]
    assert errors(spark, c=SOUND | {"issue_definitions": defs}) == sorted(
        [("c", f"$.issue_definitions[{i}]", "not an object") for i in (1, 2)]
        + [("c", "$.issue_definitions[3].issue_type", "repeated"), ("c", "$.issue_definitions[3].keywords", "not a list")]
        + [("c", f"$.issue_definitions[4].{k}", "missing") for k in ("label", "keywords", "query_default", "answer_template")]
        + [("c", "$.issue_definitions[4].query_when", "not a list"), ("c", "$.issue_definitions[5].query_when[0].condition_keywords", "missing")]
        + [("c", f"$.issue_definitions[5].query_when[{i}]", "not an object") for i in (1, 2)]
        + [("c", f"$.issue_definitions[6].{k}", "missing") for k in configuration.ISSUE_KEYS]
    )
