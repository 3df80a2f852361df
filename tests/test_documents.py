"""Chunking, annotation, citations and the graph, on small regulations."""

from __future__ import annotations

from docloom.operators import annotation, chunking, graph, references

BODY = """---
doc_id: reg
title: "Quy che"
parsed_source: a.pdf
---
Mở đầu.
## Chương I QUY ĐỊNH CHUNG
### Điều 1. Phạm vi điều chỉnh.
Nội dung đăng ký môn học theo khoản 2 Điều
2 và Điều 9, học vượt cần cố vấn học tập. {pad}
### Điều 2. Xét tốt nghiệp
Theo điểm a khoản 1 Điều này, khoản 3 Điều 9. | không phải bảng
| Điều 1 | trong bảng |
{pad}
### Thời hạn chứng chỉ
{pad}
## Phụ lục I. Bảng điểm
{pad}
### Thời hạn chứng chỉ
Ngắn.
### Bảng quy đổi IELTS
{pad}
"""
PAD = "Đoạn văn này chỉ để cho phần đủ dài mà không bị gộp vào phần đứng trước nó trong văn bản."


def chunks(spark, body=BODY, **options):
    df = spark.createDataFrame([("docs/reg.md", body.replace("{pad}", PAD))], "path string, text string")
    return chunking.build_chunks(df, **options)


def test_chunks(spark):
    rows = sorted(chunks(spark).collect(), key=lambda r: r.chunk_no)
    assert [r.chunk_id for r in rows] == ["reg__preamble", "reg__dieu_1", "reg__dieu_2", "reg__phu_luc_i", "reg__phu_luc_i__bang_quy_doi_ielts"]
    assert [r.chunk_type for r in rows] == ["preamble", "dieu", "dieu", "appendix", "appendix_sub"]
    # The short chapter header and the short sub-heading went up.
    assert rows[0].text == "Mở đầu.\n\n## Chương I QUY ĐỊNH CHUNG" and rows[3].text.endswith("Thời hạn chứng chỉ\nNgắn.")
    assert rows[1].section_title == "Điều 1. Phạm vi điều chỉnh" and rows[1].section_number == "1" and rows[1].chapter_title == "Chương I QUY ĐỊNH CHUNG"
    # Outside an appendix its sub-heading is content.
    assert "### Thời hạn chứng chỉ" in rows[2].text and rows[2].source_pdf == "a.pdf"
    assert all(r.char_count == len(r.text) and r.word_count == len(r.text.split()) for r in rows)


def test_merge_does_not_cross_documents(spark):
    df = spark.createDataFrame([("a", 0, "x" * 5), ("a", 1, "y"), ("a", 2, "z" * 9), ("b", 0, "w"), ("b", 1, "v")], "doc_id string, seg_id int, text string")
    got = sorted((r.doc_id, r.chunk_no, r.text) for r in chunking.merge_short(df, 9).collect())
    assert got == [("a", 1, "xxxxx\n\ny"), ("a", 2, "z" * 9), ("b", 1, "w\n\nv")]


def test_no_frontmatter_and_empty(spark):
    df = spark.createDataFrame([("x/Tài liệu.md", "text"), ("y.md", "")], "path string, text string")
    assert [r.doc_id for r in chunking.build_chunks(df).collect()] == ["x_tai_lieu"]


def test_annotation(spark):
    rows = {r.chunk_id: r for r in annotation.annotate_chunks(chunks(spark)).collect()}
    one, two = rows["reg__dieu_1"], rows["reg__dieu_2"]
    assert one.policy_area == ["course_registration"] and one.action_tags == ["register_course", "study_ahead"] and one.procedure_tags == ["advisor_approval_required"]
    assert two.policy_area == ["graduation"] and two.action_tags == ["graduation_audit"]
    assert rows["reg__phu_luc_i__bang_quy_doi_ielts"].evidence_groups == ["language_certificate"]


def annotated(spark, title, body, doc="d", section="1"):
    df = spark.createDataFrame([("c", doc, section, title, body)], "chunk_id string, doc_id string, section_number string, section_title string, text string")
    return annotation.annotate_chunks(df).first()


def test_annotation_rules(spark):
    assert annotated(spark, "", "Giáo dục thể chất và chứng chỉ giáo dục quốc phòng").policy_area == []
    assert annotated(spark, "", "x", "ou_fulltime_credit_training_regulation_2016", "28").policy_area == ["graduation"] and annotated(spark, "", "x", "other", "28").policy_area == []
    r = annotated(spark, "Học lại", "bắt buộc, cải thiện điểm; bảo lưu kết quả và bảng điểm")
    assert r.requirement_tags == ["passed_course_grade_improvement", "failed_required_course"] and r.policy_area == ["retake_and_grade_improvement", "leave_and_withdrawal", "course_exemption", "assessment_and_grading"]
    assert r.procedure_tags == ["application_required", "decision_required", "transcript_required"]
    a = annotated(spark, "Cảnh báo kết quả học tập", "buộc thôi học, buộc nghỉ học tạm thời, tự ý bỏ học")
    assert a.student_status_tags == ["academic_warning", "poor_academic_performance"] and a.risk_tags == ["forced_temporary_leave", "forced_dropout", "unauthorized_absence"]


def test_citations(spark):
    rows = sorted((r.chunk_id, r.level, r.diem, r.khoan, r.dieu) for r in references.cross_references(chunks(spark)).collect())
    assert rows == [("reg__dieu_1", 1, None, "2", "2"), ("reg__dieu_1", 2, None, None, "9"), ("reg__dieu_2", 0, "a", "1", "2"), ("reg__dieu_2", 1, None, "3", "9")]


def test_graph(spark):
    nodes, edges = graph.build_graph(annotation.annotate_chunks(chunks(spark)))
    found = {r.edge_id: r for r in edges.collect()}
    assert "chunk:reg__dieu_1->chunk:reg__dieu_2:REFERENCES" in found and "chunk:reg__dieu_2->chunk:reg__dieu_2:REFERENCES" in found
    assert found["chunk:reg__dieu_2->chunk:reg__dieu_2:REFERENCES"].properties == {"referenced_dieu": "2", "referenced_khoan": "1", "referenced_diem": "a"}
    isolated = {r.node_id: r.isolated_external_refs for r in nodes.collect() if r.isolated_external_refs}
    assert isolated == {"chunk:reg__dieu_1": ["Điều 9"], "chunk:reg__dieu_2": ["Điều 9 Khoản 3"]}
    ids = [r.node_id for r in nodes.collect()]
    assert ids == sorted(ids) and len(ids) == len(set(ids))
    hits = graph.chunks_by_tag(nodes, edges, "policy_area", "graduation").collect()
    assert [h.node_id for h in hits] == ["chunk:reg__dieu_2"] and graph.chunks_by_tag(nodes, edges, "none", "graduation").count() == 0


def test_citations_are_read_once_for_a_graph(spark):
    made = annotation.annotate_chunks(chunks(spark))
    nodes, edges = graph.build_graph(made)
    for part in (nodes, edges):
        assert references.PLAIN not in part._jdf.queryExecution().optimizedPlan().toString()
    # Tags need no other edges, and the limit counts chunks that are nodes.
    few = graph.chunks_by_tag(graph.chunk_nodes(made), graph.tag_edges(made), "policy_area", "graduation")
    assert [tuple(r) for r in few.collect()] == [tuple(r) for r in graph.chunks_by_tag(nodes.select(*few.columns), edges, "policy_area", "graduation").collect()] != []
    links = spark.range(6).selectExpr("concat('e', id) AS edge_id", "concat('chunk:', id) AS source", "'risk_tag:x' AS target")
    held = spark.range(2, 6).selectExpr("concat('chunk:', id) AS node_id", "'Chunk' AS node_type")
    assert [r.node_id for r in graph.chunks_by_tag(held, links, "risk_tags", "x", 2).collect()] == ["chunk:2", "chunk:3"]


def test_external_support(spark):
    rows = [("c1", "d", 2, 0, None, None, "9"), ("c2", "d", 2, 0, None, None, "9"), ("c1", "d", 1, 0, None, "3", "9"), ("c2", "d", 2, 1, None, None, "1")]
    refs = spark.createDataFrame(rows, "chunk_id string, doc_id string, level int, pos int, diem string, khoan string, dieu string")
    known = spark.createDataFrame([("d__dieu_1",)], "chunk_id string")
    split = graph.split_by_support(graph.resolve_targets(refs, known))
    assert {(r.chunk_id, r.target, r.status) for r in split.collect()} == {("c1", "d__dieu_9", "external"), ("c2", "d__dieu_9", "external"), ("c1", "d__dieu_9__khoan_3", "isolated"), ("c2", "d__dieu_1", "internal")}
    node = graph.external_nodes(split).first()
    assert node.node_id == "chunk:d__dieu_9" and node.label == "Điều 9" and node.properties["support"] == "2"


def test_two_hops(spark):
    seeds = spark.createDataFrame([("q", "a")], "question_id string, node_id string")
    links = spark.createDataFrame([("a", "b"), ("c", "b"), ("c", "d"), ("b", "a")], "source string, target string")
    got = {r.node_id: r.bonus for r in graph.expand_two_hops(seeds, links).collect()}
    assert got == {"a": 1.5, "b": 1.5, "c": 1.25}
