"""Frontmatter against a plain reading of its rules, and the rows around answers."""

from __future__ import annotations

import random
import re

from docloom.operators import evaluation, graph, issues, registry, requests
from docloom.plans import service
from docloom.plans.profile import Issue, from_config
from docloom.sources.frontmatter import parse_frontmatter


def plain_frontmatter(text: str) -> tuple[dict[str, str], str]:
    lines = text.split("\n")
    ends = [i for i, line in enumerate(lines) if i and line.strip() == "---"]
    if lines[0].strip() != "---" or not ends:
        return {}, text
    found: dict[str, str] = {}
    key = None
    for line in lines[1 : ends[0]]:
        entry = re.match(r"^([A-Za-z_][A-Za-z0-9_]*):\s*(.*)", line)
        if entry:
            key = entry[1]
            found[key] = entry[2]
        elif key and line.startswith(("  ", "\t")):
            found[key] += " " + line.strip()
        else:
            key = None
    for key, value in found.items():
        value = value.strip()
        found[key] = "" if value in ("'", '"') else value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return found, "\n".join(lines[ends[0] + 1 :])


def test_frontmatter_equals_the_plain_reading(spark):
    pick = random.Random(5)
    parts = ["---", " --- ", "----", "a: 1", "a: 'x y'", "b:", 'b: "', "  more ", "\ttab", "c:d: e", "no entry", "", "  ", "_k9: é ", "9: x", "d:   spaced  "]
    texts = ["", "---", "---\n---", "---\na: 1", "---\na: 1\n---", "---\n\n---\n"] + ["\n".join([pick.choice(["---", "--- ", "x"]), *pick.choices(parts, k=pick.randrange(12))]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    rows = {r.n: (r.metadata, r.body) for r in parse_frontmatter(df).collect()}
    assert rows == {n: plain_frontmatter(t) for n, t in enumerate(texts)}
    empty = parse_frontmatter(spark.createDataFrame([(None,)], "text string")).first()
    assert empty.metadata == {} and empty.body == ""


def test_long_frontmatter_ends(spark):
    text = "---\n" + "".join(f"k{i}: v\n  w\n" for i in range(2000)) + "---\n" + "line\n" * 50_000
    row = parse_frontmatter(spark.createDataFrame([(text,)], "text string")).first()
    assert len(row.metadata) == 2000 and row.metadata["k7"] == "v w" and row.body == "line\n" * 50_000


def test_active_tags_meet_by_letters(spark):
    values = ["a", "ab", "abc", "học vượt", "xyz", ""]
    tags = spark.createDataFrame([("c", values)], "chunk_id string, action_tags array<string>")
    asked = spark.createDataFrame([(1, "Zabz"), (2, "HOC VUOT abc"), (3, ""), (4, None)], "question_id int, question string")
    found = {(r.question_id, r.node_id) for r in graph.active_tags(graph.tag_nodes(tags), asked).collect()}
    assert found == {(1, "action_tag:a"), (1, "action_tag:ab"), (2, "action_tag:a"), (2, "action_tag:ab"), (2, "action_tag:abc"), (2, "action_tag:học vượt")}


def test_last_of_equal_nodes_counts(spark):
    nodes = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, None)], "node_id string, no int, label string")
    assert {(r.node_id, r.label) for r in graph.node_index(nodes, "no").collect()} == {("a", "new"), ("b", None)}


def test_notice_alerts(spark):
    records = spark.createDataFrame(
        [("n1", "semester_notice", "active", "x", None, None), ("n2", "annual_notice", "active", '["x", "y"]', None, None), ("n3", "annual_notice", "active", "z", None, None), ("n4", "annual_notice", "expired", "x", None, None), ("n5", "annual_notice", "active", None, None, None)],
        "doc_id string, document_type string, status string, policy_area string, effective_from string, effective_to string",
    )
    chunks = spark.createDataFrame([("n3",)], "doc_id string")
    asked = spark.createDataFrame([(1, "deadline?", "x"), (2, "deadline?", "z"), (3, "what?", "x"), (4, "deadline?", None), (5, "deadline?", "none")], "question_id int, question string, policy_area string")
    assert {(r.question_id, r.doc_id) for r in registry.notice_alerts(asked, records, chunks, "2024-01-01").collect()} == {(1, "n1"), (1, "n2")}
    # Without any chunk the question of no area has the notices of all.
    every = registry.notice_alerts(asked, records, chunks.limit(0), "2024-01-01").where("question_id = 4").collect()
    assert {r.doc_id for r in every} == {"n1", "n2", "n3", "n5"}


def test_notice_alerts_of_one_area_are_dealt_to_many_tasks(spark, tmp_path):
    records = spark.range(3000).selectExpr("IF(id = 7, NULL, concat('n', id)) AS doc_id", "'annual_notice' AS document_type", "'active' AS status", "'x' AS policy_area", "'' AS effective_from", "'' AS effective_to")
    asked = spark.range(400).selectExpr("id AS question_id", "'deadline?' AS question", "IF(id % 4 = 0, NULL, 'x') AS policy_area")
    out = str(tmp_path / "out")
    registry.notice_alerts(asked, records, spark.createDataFrame([], "doc_id string"), "2024-01-01").write.parquet(out)
    found = spark.read.parquet(out)
    # One row for each question and notice; one without an id counts, too.
    assert found.count() == found.distinct().count() == 400 * 3000 and found.where("doc_id IS NULL").count() == 400
    sizes = [f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")]
    assert max(sizes) < sum(sizes) / 3 and sum(sizes) < 400 * 3000 / 2


def test_no_task_holds_the_alerts_of_an_area(spark):
    """A join's pairs are blocks and are sorted before they become rows: in one piece
    of generated code with the join all rows of a block would be held at once."""
    records = spark.range(300).selectExpr("concat('n', id) AS doc_id", "'annual_notice' AS document_type", "'active' AS status", "'x' AS policy_area", "'' AS effective_from", "'' AS effective_to")
    asked = spark.range(1000).selectExpr("IF(id = 3, NULL, id) AS question_id", "'deadline?' AS question", "'x' AS policy_area")
    alerts = registry.notice_alerts(asked, records, spark.createDataFrame([], "doc_id string"), "2024-01-01")
    steps = [x.strip(" +-*()0123456789").split(" ")[0] for x in alerts._jdf.queryExecution().executedPlan().toString().split("\n")]
    unfolded = max(i for i, x in enumerate(steps[: steps.index("SortMergeJoin")]) if x == "Generate")
    assert "Sort" in steps[unfolded : steps.index("SortMergeJoin")]
    assert alerts.count() == alerts.distinct().count() == 300_000 and alerts.where("question_id IS NULL").count() == 300


def test_missing_information(spark):
    config = {"issue_definitions": [{"issue_type": "g", "policy_area": "g", "label": "G", "keywords": ["tot nghiep"], "query_default": "q", "missing_information_questions": ["one?", "two?"]}, {"issue_type": "generic", "label": "other"}]}
    rules = from_config(config)
    assert rules[0] == Issue("g", "g", "G", ("tot nghiep",), "q", missing=("one?", "two?"))
    asked = spark.createDataFrame([(1, "Tốt nghiệp khi nào"), (2, "?")], "question_id int, question string")
    rows = issues.missing_information(issues.infer_issues(asked, rules), rules).collect()
    assert {(r.question_id, r.position, r.ask) for r in rows} == {(1, 0, "one?"), (1, 1, "two?")}


def test_statuses_health_and_metadata(spark):
    rows = spark.createDataFrame([(1, " ", True, True), (2, "q", False, True), (3, "q", True, True), (4, "q", None, None)], "id int, question string, ready boolean, failed boolean").selectExpr("*", "5 AS top_k")
    assert {r.id: r.status for r in requests.validate_requests(rows).collect()} == {1: 422, 2: 503, 3: 500, 4: 200}
    chunks = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    assert service.health(chunks, chunks).first().status == "ok"
    assert service.health(chunks, chunks.limit(0)).first().status == service.health(chunks.limit(0)).first().status == "unavailable"
    asked = spark.createDataFrame([(1, "deadline"), (2, None)], "question_id int, question string")
    found = {r.question_id: (r.chunks_loaded, r.is_time_sensitive, r.domain_id) for r in service.answer_metadata(asked, chunks, "d").collect()}
    assert found == {1: (2, True, "d"), 2: (2, False, "d")}


def test_case_filter_and_latency(spark):
    none = "array<string>"
    cases = spark.createDataFrame([(c, c, [], [], [], []) for c in "ab"], f"case_id string, expected_first_chunk_id string, expected_chunk_ids_any {none}, expected_issue_types {none}, expected_answer_contains_any {none}, negative_chunk_ids {none}")
    runs = spark.createDataFrame([("a", ["a"], [], 10.0), ("b", ["x"], [], 30.0)], f"case_id string, selected_chunk_ids {none}, inferred_issues {none}, latency_ms double")
    total = evaluation.summarize_checks(evaluation.check_cases(cases, runs)).first()
    assert (total.total_cases, total.n_passed, total.avg_latency_ms) == (2, 1, 20.0)
    assert [evaluation.filter_cases(cases, c).count() for c in ("a", "z", None, "")] == [1, 0, 2, 2]
