"""Questions to answers: issues, retrieval, selection, citations, notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.temporal import asks_about_current_term, requires_current_notice
from docloom.functions.text import preview, score_text
from docloom.operators.graph import graph_bonus
from docloom.operators.issues import answer_texts, infer_issues, number_citations
from docloom.operators.registry import missing_notice
from docloom.operators.retrieval import KEY, bm25_scores, get_backend, lexical_scores, rank
from docloom.operators.selection import prune_sources, select_sources
from docloom.operators.term_index import TermIndex
from docloom.plans.profile import POLICY, Profile
from docloom.sources.store import materialize

NO_EVIDENCE = "Chưa tìm thấy quy định nào phù hợp."


def retrieve_sources(
    chunks: DataFrame, issues: DataFrame, backend: str | None = None, k: int = 5, max_sources: int = 3, graph: tuple[DataFrame, DataFrame] | None = None, questions: DataFrame | None = None,
    override: dict[str, str] | None = None, profile: Profile = POLICY, prune: bool = True, index: TermIndex | None = None,
) -> DataFrame:
    """Selected sources of every issue: keys, chunk_id, score, rank, and the
    chunk's doc_id, section_number, section_title. The filter of an issue is its
    policy area unless overridden. graph: (nodes, edges) for the bonus. index: a
    stored one of the chunks, read in their place by the two built-in backends."""
    override = override or {}
    area = F.lit(override["policy_area"]) if override.get("policy_area") else F.col("policy_area")
    queries = issues.select(*KEY, "query", area.alias("policy_area"), *[F.lit(override[f]).alias(f) for f in ("action_tag", "requirement_tag", "risk_tag") if override.get(f)])
    bonus = graph_bonus(*graph, questions) if graph is not None and questions is not None else None
    ranked = None
    if index is not None:
        ranked = {lexical_scores: index.top_k, bm25_scores: index.bm25_top_k}.get(get_backend(backend))
        chunks = chunks if ranked is None else index.chunks
    ranked = rank(chunks, queries, k, bonus, backend) if ranked is None else ranked(queries, k, bonus)
    named = ranked.join(chunks.select("chunk_id", "doc_id", "section_number", "section_title", F.col("policy_area")), "chunk_id")
    rows = named.join(issues.select(*KEY, "issue_type", "query"), KEY)
    selected = select_sources(rows, max_sources, profile.selection)
    return prune_sources(selected, max_sources, profile.selection) if prune else selected.drop("survives")


def answer_metadata(questions: DataFrame, chunks: DataFrame, domain_id: str, backend: str | None = None, uses_graph: bool = False, uses_registry: bool = True) -> DataFrame:
    """What an answer says of itself, one row for each question: domain_id,
    chunks_loaded, uses_document_registry, uses_graph, retrieval_backend and
    is_time_sensitive."""
    loaded = F.broadcast(chunks.agg(F.count("*").alias("chunks_loaded")))  # one row
    named = questions.select(
        "question_id", F.lit(domain_id).alias("domain_id"), F.lit(uses_registry).alias("uses_document_registry"), F.lit(uses_graph).alias("uses_graph"),
        F.lit(backend or "lexical_v0").alias("retrieval_backend"), requires_current_notice(F.col("question")).alias("is_time_sensitive"),
    )
    return named.join(loaded, F.lit(True))


def health(chunks: DataFrame, *others: DataFrame) -> DataFrame:
    """One row: status ok if there are chunks and none of the other tables is
    empty, and how many chunks."""
    ready = all(not t.isEmpty() for t in others)
    return chunks.agg(F.count("*").alias("chunks_loaded")).withColumn("status", F.when(F.lit(ready) & (F.col("chunks_loaded") > 0), "ok").otherwise("unavailable"))


def answer_questions(
    questions: DataFrame, chunks: DataFrame, backend: str | None = None, k: int = 5, graph: tuple[DataFrame, DataFrame] | None = None, registry: DataFrame | None = None,
    as_of: str | None = None, profile: Profile = POLICY, show_text: bool = False, override: dict[str, str] | None = None, index: TermIndex | None = None,
) -> DataFrame:
    """One row per question: answer, inferred_issues, selected_chunk_ids (in
    order of issues, each once), warn_missing_notice, backend, uses_graph. The
    selected sources, at most 3 an issue, are written once; citations, details
    and the union are made of them in one pass for each question."""
    issues = infer_issues(questions, profile.issues)
    sources = materialize(retrieve_sources(chunks, issues, backend, k, min(3, k), graph, questions, override, profile, index=index).drop("policy_area"), "selected-sources")
    # Few rows, whose chunks are the only ones that are looked at again.
    shown = F.coalesce("text", F.lit("")) if show_text else preview(F.col("text"), cut_first=True)
    named = chunks.select("chunk_id", shown.alias("shown"), F.coalesce(F.nullif(F.col("source_pdf"), F.lit("")), F.lit("N/A")).alias("pdf"))
    detail = number_citations(sources).join(named, "chunk_id")
    title, doc = F.coalesce(F.nullif(F.col("section_title"), F.lit("")), F.col("chunk_id")), F.col("doc_id").cast("string")
    mark = F.concat(F.lit("["), F.col("citation").cast("string"), F.lit("] "), title)
    cite = F.concat(F.lit("* "), mark, F.lit(" — "), doc, F.lit(" — score "), score_text(F.col("score")))
    block = F.concat(
        mark, F.lit("\n* chunk_id: "), F.col("chunk_id"), F.lit("\n* doc_id: "), doc,
        F.lit("\n* source_pdf: "), F.col("pdf"), F.lit("\n* score: "), score_text(F.col("score")), F.lit("\n* preview: "), F.col("shown"), F.lit("\n"),
    )
    used = F.struct("issue_idx", "rank", "citation", "chunk_id", cite.alias("cite"), block.alias("block"))
    uses = detail.groupBy("question_id").agg(F.sort_array(F.collect_list(used)).alias("uses"))
    # A citation is numbered by its first use, which gives its score and preview.
    firsts = F.filter("uses", lambda u, i: ~F.exists(F.slice(F.col("uses"), F.lit(1), i), lambda v: v["citation"] == u["citation"]))
    named = answer_texts(issues, profile.issues).groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("issue_idx", "issue_type", "label", "policy_area", "answer"))).alias("all_issues"))
    rows = questions.select("question_id", "question").join(named, "question_id").join(uses, "question_id", "left").withColumn("firsts", firsts)

    def section(i: Column) -> Column:
        """The part of an issue, null without sources."""
        own = F.filter("uses", lambda u: u["issue_idx"] == i["issue_idx"])
        cites = F.array_join(F.transform(own, lambda u: u["cite"]), "\n")
        return F.when(F.size(own) > 0, F.concat(F.lit("## "), (i["issue_idx"] + 1).cast("string"), F.lit(". "), i["label"], F.lit("\n\n"), i["answer"], F.lit("\n\nCăn cứ chính:\n"), cites, F.lit("\n")))

    rows = rows.withColumn("sections", F.when(F.col("uses").isNotNull(), F.array_join(F.transform("all_issues", section), "\n")))
    rows = rows.withColumn("details", F.array_join(F.transform("firsts", lambda u: u["block"]), "\n")).withColumn("selected_chunk_ids", F.transform("firsts", lambda u: u["chunk_id"]))
    if registry is not None and as_of is not None:
        asked = rows.select("question_id", "question", F.col("all_issues")[0]["policy_area"].alias("policy_area"))
        rows = rows.join(missing_notice(asked, registry, chunks, as_of).select("question_id", F.col("warn").alias("warn_missing_notice")), "question_id")
    else:
        rows = rows.withColumn("warn_missing_notice", asks_about_current_term(F.col("question"), profile.current_term))
    n = F.size("all_issues")
    labels = F.array_join(F.transform("all_issues", lambda x: x["label"]), ", ")
    intro = F.when(n > 1, F.concat(F.lit("Câu hỏi có "), n.cast("string"), F.lit(" vấn đề: "), labels, F.lit("."))).otherwise(F.lit("Nhận định sơ bộ:"))
    closing = F.when(F.col("warn_missing_notice"), F.lit(profile.notice)).otherwise(F.lit(profile.disclaimer))
    answer = F.concat(F.lit("# Câu trả lời\n\n"), intro, F.lit("\n\n"), F.col("sections"), F.lit("\n# Căn cứ chi tiết\n\n"), F.col("details"), F.lit("\n# Gợi ý kiểm tra thêm\n\n"), closing)
    return rows.select(
        "question_id", F.when(F.col("sections").isNull(), F.lit(NO_EVIDENCE)).otherwise(answer).alias("answer"), F.transform("all_issues", lambda x: x["issue_type"]).alias("inferred_issues"),
        F.coalesce("selected_chunk_ids", F.array().cast("array<string>")).alias("selected_chunk_ids"), "warn_missing_notice", F.lit(backend or "lexical_v0").alias("backend"), F.lit(graph is not None).alias("uses_graph"),
    )
