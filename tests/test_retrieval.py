"""Retrieval, selection, answers, registry, evaluation and requests."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from docloom.operators import evaluation, issues, registry, requests, retrieval, selection
from docloom.plans import profile
from docloom.plans.service import answer_questions

CHUNK = "chunk_id string, doc_id string, section_number string, section_title string, chapter_title string, text string, policy_area array<string>, action_tags array<string>, source_pdf string"


def corpus(spark, rows):
    return spark.createDataFrame([(c, "d", n, t, "", x, a, [], "") for c, n, t, x, a in rows], CHUNK)


def ask(spark, query, area=None):
    return spark.createDataFrame([("q", 0, query, area)], "question_id string, issue_idx int, query string, policy_area string")


def scores(spark, chunks, query, f=retrieval.lexical_scores, area=None, bonus=None):
    return {r.chunk_id: r.score for r in f(chunks, ask(spark, query, area), bonus).collect()}


def test_lexical_weights(spark):
    chunks = corpus(spark, [("t", "1", "Xét miễn", "", []), ("b", "2", "", "xét miễn", []), ("o", "3", "", "khác", ["xet"])])
    assert scores(spark, chunks, "xét miễn") == {"t": 9.0, "b": 5.0, "o": 1.0}
    assert scores(spark, chunks, "xét xét miễn")["b"] == 3.0  # repeats count, the phrase does not hold
    assert scores(spark, chunks, "xét miễn", area="xet") == {"o": 1.0} and scores(spark, chunks, "", ) == {} and scores(spark, chunks, "xet", area="none") == {}
    assert scores(spark, chunks, "hac") == {"o": 3.0}  # a phrase is a substring, inside a token


def test_bonus(spark):
    chunks = corpus(spark, [("a", "1", "", "one two", ["x"]), ("b", "2", "", "three", [])])
    bonus = spark.createDataFrame([("q", "a", 1.5), ("q", "b", 1.25), ("q", "gone", 9.0)], "question_id string, chunk_id string, bonus double")
    assert scores(spark, chunks, "one", bonus=bonus) == {"a": 5.5, "b": 1.25} and scores(spark, chunks, "one", area="x", bonus=bonus) == {"a": 5.5}
    assert scores(spark, chunks, "!", bonus=bonus) == {}


def test_bm25_counts_the_filtered_chunks(spark):
    rows = [("a", "1", "", "p q q", ["x"]), ("b", "2", "", "p r", ["x"]), ("c", "3", "", "p p p p q", ["y"])]

    def want(docs, query):
        bags = {c: t.split() for c, _, _, t, _ in docs}
        n, avg = len(bags), sum(map(len, bags.values())) / len(bags)
        out = {}
        for c, words in bags.items():
            s = 0.0
            for t in query.split():
                df, tf = sum(t in w for w in bags.values()), words.count(t)
                s += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / avg)) if tf else 0
            if s > 0:
                out[c] = round(s, 6)
        return out

    chunks = corpus(spark, rows)
    for area, docs in ((None, rows), ("x", rows[:2])):
        got = scores(spark, chunks, "q p q", retrieval.bm25_scores, area)
        assert {k: round(v, 6) for k, v in got.items()} == want(docs, "q p q")


def test_top_k_order_and_backends(spark):
    chunks = corpus(spark, [(f"c{n}", n, "", "w", []) for n in ("10", "9", "A", "2")])
    s = spark.createDataFrame([("q", 0, f"c{n}", 1.0) for n in ("10", "9", "A", "2")], "question_id string, issue_idx int, chunk_id string, score double")
    assert [r.chunk_id for r in retrieval.top_k(s, chunks, 3).orderBy("rank").collect()] == ["c2", "c9", "c10"]
    assert retrieval.get_backend(None) is retrieval.get_backend("") is retrieval.lexical_scores
    with pytest.raises(ValueError, match="bm25_like_v0, lexical_v0"):
        retrieval.get_backend("none")


def candidates(spark, kind, query, rows):
    full = [("q", 0, kind, query, c, "d", n, t, a, float(s), k + 1) for k, (c, n, t, a, s) in enumerate(rows)]
    return spark.createDataFrame(full, "question_id string, issue_idx int, issue_type string, query string, chunk_id string, doc_id string, section_number string, section_title string, policy_area array<string>, score double, rank int")


def chosen(df):
    return [r.chunk_id for r in df.orderBy("rank").collect()]


E4, E5 = ("e4", "4", "Điều 4. Điều kiện miễn", ["course_exemption"], 5), ("e5", "5", "Điều 5. Hồ sơ miễn", ["course_exemption"], 6)


def test_selection_and_pruning(spark):
    off = ("x", "1", "Khác", ["graduation"], 90)
    s = selection.select_sources(candidates(spark, "course_exemption", "dieu kien xet mien giam mon hoc", [off, E5, E4, E4]))
    assert chosen(s) == ["e4", "e5"] and chosen(selection.prune_sources(s)) == ["e4"]
    s = selection.select_sources(candidates(spark, "course_exemption", "ho so xin mien giam mon hoc", [E4, E5]))
    assert chosen(s) == ["e5", "e4"] and chosen(selection.prune_sources(s)) == ["e5", "e4"] and chosen(selection.prune_sources(s, 1)) == ["e5"]
    s = selection.select_sources(candidates(spark, "graduation", "q", [off[:3] + (["other"], 3), ("y", "2", "", [], 4)]))
    assert chosen(s) == ["y", "x"] and [r.score for r in s.orderBy("rank").collect()] == [4.0, 3.0]  # none is useful
    assert chosen(selection.prune_sources(s)) == ["y"]  # all pruned: the first stays
    s = selection.select_sources(candidates(spark, "foreign_language_requirement", "ielts", [("p", "", "Phụ lục I", ["foreign_language_requirement"], 1), ("n", "9", "Điều 9", ["foreign_language_requirement"], 2), ("m", "3", "", ["foreign_language_requirement"], 50)]))
    assert chosen(s) == ["n", "p", "m"] and chosen(selection.prune_sources(s)) == ["n", "p"]
    assert [r.chunk_id for r in selection.prune_sources(selection.select_sources(candidates(spark, "generic", "q", [off])), min_priority=1).collect()] == ["x"]


def test_issues(spark):
    rows = [(1, "Em có IELTS, muốn miễn môn và xét tốt nghiệp, nộp hồ sơ?"), (2, "Xin chào"), (3, None), (4, "Học vượt, học lại và cảnh báo")]
    got = {}
    for r in issues.infer_issues(spark.createDataFrame(rows, "question_id int, question string")).orderBy("question_id", "issue_idx").collect():
        got.setdefault(r.question_id, []).append((r.issue_type, r.query))
    assert [t for t, _ in got[1]] == ["graduation", "course_exemption", "foreign_language_requirement"] and got[1][1][1] == "ho so xin mien giam mon hoc"
    assert got[2] == [("generic", "Xin chào")] and got[3] == [("generic", "")] and [t for t, _ in got[4]] == ["course_registration", "retake_and_grade_improvement", "academic_standing"]
    assert profile.profile_from_config({"issue_definitions": [{"issue_type": "generic"}]}).issues[0].policy_area is None


def test_answers(spark):
    chunks = corpus(spark, [("r__27", "27", "Điều 27. Điều kiện xét tốt nghiệp", "Điều kiện xét tốt nghiệp " * 20, ["graduation"]), E4[:3] + ("xét miễn giảm môn học", ["course_exemption"])])
    q = spark.createDataFrame([("1", "Điều kiện xét tốt nghiệp và miễn môn?"), ("2", "zzz"), ("3", "Khi nào xét tốt nghiệp?")], "question_id string, question string")
    got = {r.question_id: r for r in answer_questions(q, chunks).collect()}
    assert got["1"].selected_chunk_ids == ["r__27", "e4"] and "## 1. Tốt nghiệp" in got["1"].answer and "[2] Điều 4. Điều kiện miễn\n* chunk_id: e4" in got["1"].answer
    assert got["2"].answer == "Chưa tìm thấy quy định nào phù hợp." and got["2"].selected_chunk_ids == [] and got["3"].warn_missing_notice and not got["1"].warn_missing_notice


REG = "doc_id string, ord int, title string, document_type string, status string, temporal_scope string, update_cadence string, policy_area string, issued_date string, effective_from string, effective_to string"


def records(spark, rows):
    return spark.createDataFrame([(d, i, "t", k, s, "g", "c", a, "2024-01-01", f, t) for i, (d, k, s, a, f, t) in enumerate(rows)], REG)


def test_registry(spark):
    r = records(spark, [("a", "regulation", "active", None, "2024-01-01", "2024-06-30"), ("b", "semester_notice", "active", '["x","y"]', "2024-06-30", None), ("c", "annual_notice", "active", "x", "bad", None), ("d", "regulation", "expired", "x", None, None), ("a", "other", "", "x", None, "2024-13-01")])
    active = lambda day: {x.doc_id for x in registry.active_documents(r, day).collect()}
    assert active("2024-06-30") == {"a", "b", "c"} and active("2024-07-01") == {"b", "c"} and active("2023-12-31") == {"c"}
    errors = {(e.id, e.ord, e.error) for e in registry.registry_errors(r).collect()}
    assert errors == {("c", 2, "bad date effective_from"), ("a", 4, "missing status"), ("a", 4, "bad date effective_to"), ("a", 4, "duplicate id")}
    assert [x.doc_id for x in registry.prioritize_documents(r, True, "x", "2024-06-30").orderBy("rank").collect()] == ["b", "c", "a"]
    assert [x.doc_id for x in registry.prioritize_documents(r, False, None, "2024-06-30").orderBy("rank").collect()] == ["a", "b", "c"]
    q = spark.createDataFrame([("1", "khi nào?", "x"), ("2", "khi nào?", "y"), ("3", "gì?", "z"), ("4", "khi nào?", None), ("5", "khi nào?", "z")], "question_id string, question string, policy_area string")
    for held, want in ((["c"], {"2", "5"}), ([], {"1", "2", "4", "5"})):
        chunks = spark.createDataFrame([(h,) for h in held], "doc_id string")
        assert {x.question_id for x in registry.missing_notice(q, r, chunks, "2024-07-01").where("warn").collect()} == want
    assert [x.doc_id for x in registry.unavailable_notices(r, spark.createDataFrame([("c",)], "doc_id string"), "2024-07-01").collect()] == ["b"]


def test_evaluation(spark):
    cases = spark.createDataFrame([("p", ["i"], "a", ["b"], ["Yes"], ["z"]), ("r2", [], "a", [], [], []), ("none", [], None, [], [], []), ("miss", ["j"], "q", [], ["no"], ["a"])], "case_id string, expected_issue_types array<string>, expected_first_chunk_id string, expected_chunk_ids_any array<string>, expected_answer_contains_any array<string>, negative_chunk_ids array<string>")
    runs = spark.createDataFrame([("p", ["i", "k"], ["a", "b"], "oh YES"), ("r2", [], ["x", "a"], ""), ("none", [], [], ""), ("miss", ["i"], ["a"], "")], "case_id string, inferred_issues array<string>, selected_chunk_ids array<string>, answer string")
    checked = evaluation.check_cases(cases, runs)
    assert {r.case_id: r.passed for r in checked.collect()} == {"p": True, "r2": False, "none": True, "miss": False}
    assert {r.case_id: r.failed for r in evaluation.diagnose_failures(checked).collect()} == {"r2": ["first_chunk_pass"], "miss": ["issue_types_pass", "first_chunk_pass", "answer_contains_pass", "negative_chunk_pass"]}
    m = evaluation.retrieval_metrics(evaluation.retrieval_scores(cases, runs)).first()
    assert (m.recall_n, m.mrr_n, m.ndcg_n) == (3, 3, 3) and abs(m.recall_at_k - 2 / 3) < 1e-9 and m.mrr == 0.5 and abs(m.ndcg_at_k - (1 + 1 / math.log2(3)) / 3) < 1e-9
    both = checked.selectExpr("'x' AS backend", "*").unionByName(checked.selectExpr("'y' AS backend", "*").replace(True, None, "passed").fillna(True, "passed"))
    assert evaluation.any_perfect(evaluation.summarize_checks(both, ["backend"])).first().ok is False


def test_requests(spark):
    rows = spark.createDataFrame([("q", 5), ("  ", 5), (None, 5), ("q", 0), ("q", 11), ("q", None), ("x" * 2001, 1)], "question string, top_k int")
    assert [r.status for r in requests.validate_requests(rows).collect()] == [200, 422, 422, 422, 422, 200, 422]
    t0 = dt.datetime(2024, 1, 1)
    events = [("c", k, t0 + dt.timedelta(seconds=s)) for k, s in enumerate([0] * 31 + [59, 60, 61])] + [("d", 100, t0)]
    e = spark.createDataFrame(events, "client string, key long, ts timestamp")
    got = {r.key: (r.admitted, r.retry_after) for r in requests.admit(e, "client", "ts", "key").collect()}
    assert [got[k][0] for k in range(34)] == [True] * 30 + [False, False, True, True] and got[30][1] == 60 and got[31][1] == 1 and got[100][0]
    counts = {r.key: r.in_window for r in requests.window_counts(e, "client", "ts", 60).collect()}
    assert counts[0] == counts[30] == 31 and counts[32] == 2


def test_selection_moves_a_candidate_once_and_without_its_title(spark):
    """One exchange by question, whether issue_idx is a column or a constant."""
    r = candidates(spark, "course_exemption", "ho so xin mien giam mon hoc", [E4, E5])
    for rows in (r, r.withColumn("issue_idx", F.lit(0))):
        s = selection.prune_sources(selection.select_sources(rows, 3), 3).select("question_id", "chunk_id", "rank")
        plan = s._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.splitlines() if "Exchange" in line]
        assert len(moved) == 1 and "hashpartitioning(question_id" in moved[0], plan
        below = next(line for line in plan[plan.index(moved[0]) + len(moved[0]) :].splitlines() if "Project [" in line)
        assert "section_title" not in below.split(" AS priority")[0], plan
        assert chosen(s) == ["e5", "e4"]
