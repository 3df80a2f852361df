"""Property graph of documents, chunks, tags and references as two tables.

Nodes: node_id, node_type, label, properties (map). Edges: edge_id, source,
target, edge_type, properties. First occurrences win, by explicit order keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import GRAM, normalize_text, pieces
from docloom.operators.references import cross_references
from docloom.sources.store import materialize

# Tag fields with the prefix of their nodes, node type and edge type.
TAG_KINDS = {
    "policy_area": ("policy_area", "PolicyArea", "CHUNK_HAS_POLICY_AREA"),
    "action_tags": ("action_tag", "ActionTag", "CHUNK_HAS_ACTION_TAG"),
    "student_status_tags": ("student_status_tag", "StudentStatusTag", "CHUNK_HAS_STUDENT_STATUS_TAG"),
    "procedure_tags": ("procedure_tag", "ProcedureTag", "CHUNK_HAS_PROCEDURE_TAG"),
    "evidence_groups": ("evidence_group", "EvidenceGroup", "CHUNK_HAS_EVIDENCE_GROUP"),
    "risk_tags": ("risk_tag", "RiskTag", "CHUNK_HAS_RISK_TAG"),
    "requirement_tags": ("requirement_tag", "RequirementTag", "CHUNK_HAS_REQUIREMENT_TAG"),
    "time_tags": ("time_tag", "TimeTag", "CHUNK_HAS_TIME_TAG"),
}
SEED_BONUS = 1.5
FAR_BONUS = 1.25

DOCUMENT_FIELDS = ("doc_id", "title", "decision_no", "issued_date", "institution", "education_mode", "source_pdf")
CHUNK_FIELDS = ("chunk_id", "doc_id", "title", "chapter_title", "section_title", "section_number", "chunk_type", "source_path", "source_pdf", "char_count", "word_count", "text")


def _properties(df: DataFrame, names: tuple[str, ...]) -> Column:
    pairs = [x for n in names if n in df.columns for x in (F.lit(n), F.coalesce(F.col(n).cast("string"), F.lit("")))]
    return F.create_map(*pairs)


def _node(node_id: Column, kind: Column | str, label: Column, properties: Column) -> list[Column]:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return [node_id.alias("node_id"), kind.alias("node_type"), label.alias("label"), properties.alias("properties")]


def _edge(source: Column, target: Column, kind: Column | str, properties: Column | None = None) -> list[Column]:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    none = F.create_map().cast("map<string,string>")
    edge_id = F.concat(source, F.lit("->"), target, F.lit(":"), kind)
    return [edge_id.alias("edge_id"), source.alias("source"), target.alias("target"), kind.alias("edge_type"), (none if properties is None else properties).alias("properties")]


def document_nodes(chunks: DataFrame, order_col: str = "chunk_no") -> DataFrame:
    """One node per document, from its first chunk."""
    first = chunks.groupBy("doc_id").agg(F.min_by(F.struct(*[c for c in DOCUMENT_FIELDS if c in chunks.columns and c != "doc_id"]), order_col).alias("f")).select("doc_id", "f.*")
    label = F.col("title") if "title" in first.columns else F.col("doc_id").cast("string")
    return first.select(*_node(F.concat(F.lit("document:"), F.col("doc_id").cast("string")), "Document", label, _properties(first, DOCUMENT_FIELDS)))


def chunk_nodes(chunks: DataFrame, order_col: str = "chunk_no") -> DataFrame:
    """One node per chunk id; the label falls back to the id."""
    names = [c for c in CHUNK_FIELDS if c in chunks.columns]
    first = chunks.groupBy("chunk_id").agg(F.min_by(F.struct(*[c for c in names if c != "chunk_id"]), order_col).alias("f")).select("chunk_id", "f.*")
    label = F.coalesce(F.nullif(F.col("section_title"), F.lit("")), F.col("chunk_id")) if "section_title" in names else F.col("chunk_id")
    return first.select(*_node(F.concat(F.lit("chunk:"), F.col("chunk_id")), "Chunk", label, _properties(first, CHUNK_FIELDS)))


def chunk_tags(chunks: DataFrame) -> DataFrame:
    """(chunk_id, kind, tag) over all tag fields, in one scan."""
    fields = [f for f in TAG_KINDS if f in chunks.columns]

    def tagged(name: str) -> Column:
        return F.transform(F.coalesce(F.col(name), F.array().cast("array<string>")), lambda t: F.struct(F.lit(name).alias("field"), t.alias("tag")))

    return chunks.select("chunk_id", F.explode(F.concat(*map(tagged, fields))).alias("t")).select("chunk_id", "t.field", "t.tag")


def _kind(part: int) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for f, k in TAG_KINDS.items() for x in (f, k[part])]), F.col("field"))


def tag_nodes(chunks: DataFrame) -> DataFrame:
    tags = chunk_tags(chunks).select("field", "tag").distinct()
    return tags.select(*_node(F.concat(_kind(0), F.lit(":"), F.col("tag")), _kind(1), F.col("tag"), F.create_map(F.lit("value"), F.col("tag"))))


def tag_edges(chunks: DataFrame) -> DataFrame:
    tags = chunk_tags(chunks).distinct()
    return tags.select(*_edge(F.concat(F.lit("chunk:"), F.col("chunk_id")), F.concat(_kind(0), F.lit(":"), F.col("tag")), _kind(2)))


def document_edges(chunks: DataFrame) -> DataFrame:
    pairs = chunks.select("doc_id", "chunk_id").distinct()
    return pairs.select(*_edge(F.concat(F.lit("document:"), F.col("doc_id").cast("string")), F.concat(F.lit("chunk:"), F.col("chunk_id")), "DOCUMENT_HAS_CHUNK"))


def resolve_targets(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """refs with target and internal: an article that is a chunk is internal,
    any other is external and named by article and clause."""
    article = F.concat(F.col("doc_id").cast("string"), F.lit("__dieu_"), F.col("dieu"))
    known = chunks.select(F.col("chunk_id").alias("article"), F.lit(True).alias("known")).distinct()
    joined = refs.withColumn("article", article).join(known, "article", "left").withColumn("internal", F.coalesce("known", F.lit(False)))
    longer = F.when(F.col("khoan").isNotNull(), F.concat("article", F.lit("__khoan_"), "khoan")).otherwise(F.col("article"))
    return joined.withColumn("target", F.when(F.col("internal"), F.col("article")).otherwise(longer)).drop("article", "known")


def target_support(resolved: DataFrame) -> DataFrame:
    """(target, support): distinct chunks that cite each external target."""
    pairs = resolved.where("not internal").select("target", "chunk_id").distinct()
    return pairs.groupBy("target").agg(F.count("*").alias("support"))


def split_by_support(resolved: DataFrame, min_support: int = 2) -> DataFrame:
    """resolved with support and status: internal, external or isolated."""
    support = target_support(resolved)
    joined = resolved.join(support, "target", "left")
    status = F.when(F.col("internal"), "internal").when(F.col("support") >= min_support, "external").otherwise("isolated")
    return joined.withColumn("status", status)


def external_nodes(resolved: DataFrame, min_support: int = 2) -> DataFrame:
    named = F.min(F.struct("dieu", "khoan"))
    found = resolved.where("not internal").groupBy("target").agg(named.alias("n"), F.count_distinct("chunk_id").alias("support")).where(F.col("support") >= min_support).select("target", "n.*", "support")
    label = F.concat(F.lit("Điều "), "dieu", F.coalesce(F.concat(F.lit(" Khoản "), "khoan"), F.lit("")))
    properties = F.create_map(F.lit("referenced_dieu"), "dieu", F.lit("referenced_khoan"), F.coalesce("khoan", F.lit("")), F.lit("support"), F.col("support").cast("string"))
    return found.select(*_node(F.concat(F.lit("chunk:"), "target"), "ExternalReference", label, properties))


def reference_edges(split: DataFrame) -> DataFrame:
    """An edge for each pair of chunk and target, with the properties of its
    first citation; a chunk may cite itself."""
    found = split.where("status <> 'isolated'").withColumn("order", F.struct("level", "pos"))
    first = found.groupBy("chunk_id", "target", "status").agg(F.min_by(F.struct("dieu", "khoan", "diem"), "order").alias("f")).select("chunk_id", "target", "status", "f.*")
    names = (("referenced_dieu", "dieu"), ("referenced_khoan", "khoan"), ("referenced_diem", "diem"))
    pairs = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in names]), lambda e: e["value"].isNotNull()))
    kind = F.when(F.col("status") == "internal", "REFERENCES").otherwise("EXTERNAL_REFERENCES")
    return first.select(*_edge(F.concat(F.lit("chunk:"), "chunk_id"), F.concat(F.lit("chunk:"), "target"), kind, pairs))


def isolated_references(split: DataFrame) -> DataFrame:
    """(chunk_id, isolated_external_refs), in citation order."""
    label = F.concat(F.lit("Điều "), "dieu", F.coalesce(F.concat(F.lit(" Khoản "), "khoan"), F.lit("")), F.coalesce(F.concat(F.lit(" Điểm "), "diem"), F.lit("")))
    found = split.where("status = 'isolated'").withColumn("label", label)
    return found.groupBy("chunk_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("level", "pos", "label"))), lambda x: x["label"]).alias("isolated_external_refs"))


def build_graph(chunks: DataFrame, min_support: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of annotated chunks, ordered by id. Chunk nodes have
    isolated_external_refs beside their properties. Citations are read from the
    texts once, as many parts of the graph need them."""
    cited = materialize(cross_references(chunks), "citations")
    split = split_by_support(resolve_targets(cited, chunks), min_support)
    isolated = isolated_references(split).select(F.concat(F.lit("chunk:"), "chunk_id").alias("node_id"), "isolated_external_refs")
    nodes = document_nodes(chunks).unionByName(chunk_nodes(chunks)).unionByName(tag_nodes(chunks)).unionByName(external_nodes(split, min_support))
    nodes = nodes.join(isolated, "node_id", "left").orderBy("node_id")
    edges = document_edges(chunks).unionByName(tag_edges(chunks)).unionByName(reference_edges(split)).orderBy("edge_id")
    return nodes, edges


def node_index(nodes: DataFrame, order_col: str) -> DataFrame:
    """One row for each node_id; of rows that share it the last one counts."""
    others = [c for c in nodes.columns if c != "node_id"]
    last = nodes.groupBy("node_id").agg(F.max_by(F.struct(*others), order_col).alias("n"))
    return last.select("node_id", "n.*")


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, kind, n)."""
    kinds = nodes.select(F.lit("node").alias("part"), F.col("node_type").alias("kind")).unionByName(edges.select(F.lit("edge").alias("part"), F.col("edge_type").alias("kind")))
    return kinds.groupBy("part", "kind").agg(F.count("*").alias("n"))


def chunks_by_tag(nodes: DataFrame, edges: DataFrame, tag_type: str, tag_value: str, limit: int = 10) -> DataFrame:
    """Chunk nodes with an edge to a tag, in edge order. An unknown type gives
    none; a limit of 0 or less gives at most one."""
    prefixes = {k[0] for k in TAG_KINDS.values()} | set(TAG_KINDS)
    prefix = TAG_KINDS[tag_type][0] if tag_type in TAG_KINDS else tag_type
    hits = edges.where((F.col("target") == f"{prefix}:{tag_value}") & F.col("source").startswith("chunk:") & F.lit(tag_type in prefixes))
    first = hits.groupBy(F.col("source").alias("node_id")).agg(F.min("edge_id").alias("edge_id"))
    chunks, most = nodes.where("node_type = 'Chunk'"), max(limit, 1)
    # Ids alone meet and are ordered, then the few are joined with their nodes.
    kept = materialize(first.join(chunks.select("node_id"), "node_id", "left_semi").orderBy("edge_id").limit(most), "kept")
    return chunks.join(kept, "node_id").orderBy("edge_id").limit(most).drop("edge_id")


def active_tags(nodes: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, node_id): tags whose value is in the question, as a token
    or as plain text. questions: question_id, question. Both sides meet on the first
    letters of the value; then all of it is tested."""
    tags = nodes.where(F.col("node_type").isin([k[1] for k in TAG_KINDS.values()])).select("node_id", normalize_text(F.col("properties").getItem("value")).alias("value")).where("value <> ''")
    asked = questions.select("question_id", normalize_text(F.col("question")).alias("q"))
    keyed = tags.withColumn("gram", F.col("value").substr(1, GRAM))
    near = asked.select("question_id", "q", F.explode(pieces(F.col("q"))).alias("gram")).join(keyed, "gram")
    return near.where(F.col("q").contains(F.col("value"))).select("question_id", "node_id").distinct()


def expand_two_hops(seeds: DataFrame, links: DataFrame, near: float = SEED_BONUS, far: float = FAR_BONUS) -> DataFrame:
    """(question_id, node_id, bonus): seeds and what one undirected hop over
    links (source, target) reaches get `near`, what a second hop reaches `far`;
    every node once, by its nearest level. seeds: question_id, node_id."""
    both = links.select("source", "target").union(links.select("target", "source")).distinct()
    start = seeds.select("question_id", "node_id").distinct()
    one = start.join(both, F.col("node_id") == F.col("source")).select("question_id", F.col("target").alias("node_id")).distinct()
    two = one.join(both, F.col("node_id") == F.col("source")).select("question_id", F.col("target").alias("node_id")).distinct()
    levels = start.withColumn("bonus", F.lit(near)).union(one.withColumn("bonus", F.lit(near))).union(two.withColumn("bonus", F.lit(far)))
    return levels.groupBy("question_id", "node_id").agg(F.max("bonus").alias("bonus"))


def graph_bonus(nodes: DataFrame, edges: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, chunk_id, bonus) by tags and citations."""
    active = active_tags(nodes, questions)
    seeds = edges.where(F.col("source").startswith("chunk:")).join(active, F.col("target") == F.col("node_id")).select("question_id", F.col("source").alias("node_id"))
    links = edges.where(F.col("edge_type").isin("REFERENCES", "EXTERNAL_REFERENCES"))
    found = expand_two_hops(seeds, links).where(F.col("node_id").startswith("chunk:"))
    return found.select("question_id", F.expr("substring(node_id, 7)").alias("chunk_id"), "bonus")
