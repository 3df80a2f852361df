"""Document registry: validation, periods of validity, current notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from docloom.functions.temporal import requires_current_notice
from docloom.functions.text import date_or_null, valid_date
from docloom.sources.store import materialize

# Required fields, date fields and notice types of a registry.
REQUIRED = ("doc_id", "title", "document_type", "status", "temporal_scope", "update_cadence")
DATES = ("issued_date", "effective_from", "effective_to")
NOTICES = ("semester_notice", "annual_notice")
# Notices and questions that meet in one row before their pairs become rows of
# their own, and rows that a task makes of them, about.
NOTICE_BLOCK = 256
QUESTION_BLOCK = 64
ALERT_ROWS = 16_000_000


def area_list(area: Column, kind=None) -> Column:
    """The area column (a string, a list or null) as a list. Text that holds a
    JSON list is read as one."""
    if isinstance(kind, ArrayType):
        return area
    listed = F.from_json(area, "array<string>")
    return F.when(area.isNull(), F.lit(None).cast("array<string>")).when(area.startswith("["), F.coalesce(listed, F.array(area))).otherwise(F.array(area))


def area_matches(areas: Column, wanted: Column) -> Column:
    """A null wish matches all; null areas match nothing else."""
    return wanted.isNull() | F.coalesce(F.array_contains(areas, wanted), F.lit(False))


def record_errors(records: DataFrame, required: tuple[str, ...] = REQUIRED, dates: tuple[str, ...] = DATES) -> DataFrame:
    """records with errors: array<string>, in field order."""
    tests = []
    for name in required:
        value = F.col(name).cast("string") if name in records.columns else F.lit(None).cast("string")
        tests.append(F.when(F.coalesce(value, F.lit("")) == "", F.lit(f"missing {name}")))
    for name in dates:
        if name in records.columns:
            tests.append(F.when(~valid_date(F.col(name)), F.lit(f"bad date {name}")))
    return records.withColumn("errors", F.array_compact(F.array(*tests)))


def registry_errors(records: DataFrame, id_col: str = "doc_id", order_col: str = "ord", required: tuple[str, ...] = REQUIRED, dates: tuple[str, ...] = DATES) -> DataFrame:
    """(id, ord, error) of every record, and one for each repeat of an id."""
    own = record_errors(records, required, dates).select(F.col(id_col).cast("string").alias("id"), F.col(order_col).alias("ord"), F.explode("errors").alias("error"))
    again = records.where(F.col(id_col).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(id_col).orderBy(order_col))).where("_n > 1")
    return own.unionByName(again.select(F.col(id_col).cast("string").alias("id"), F.col(order_col).alias("ord"), F.lit("duplicate id").alias("error")))


def is_active(as_of: Column | str, status: Column | None = None, begin: Column | None = None, end: Column | None = None) -> Column:
    """Active on a day, both ends included; open or malformed ends count as
    open. The day is always given, never today."""
    day = F.to_date(F.lit(as_of)) if isinstance(as_of, str) else as_of
    first = date_or_null(F.col("effective_from")) if begin is None else begin
    last = date_or_null(F.col("effective_to")) if end is None else end
    status = F.col("status") if status is None else status
    return (F.coalesce(status, F.lit("")) == "active") & (first.isNull() | (day >= first)) & (last.isNull() | (day <= last))


def active_documents(records: DataFrame, as_of: str) -> DataFrame:
    return records.where(is_active(as_of))


def current_notices(records: DataFrame, as_of: str) -> DataFrame:
    """(doc_id, areas) of the active notices."""
    kind = records.schema["policy_area"].dataType
    return records.where(F.col("document_type").isin(*NOTICES) & is_active(as_of)).select("doc_id", area_list(F.col("policy_area"), kind).alias("areas"))


def active_on_days(questions: DataFrame, records: DataFrame) -> DataFrame:
    """questions (question_id, day, policy_area) with active_documents and
    active_notices: those in force on the question's own day, ends included, of
    its area or of all where it has none.

    Each period adds one on its first day and takes one off after its last; the
    sums of these changes, one for each area and day, are what is in force. So
    the work is that of counting days, not of pairs, and open ends need no
    bins: what has no first day is there before all others. A question without
    a day has nulls."""
    kind = records.schema["policy_area"].dataType
    begin, end = date_or_null(F.col("effective_from")), date_or_null(F.col("effective_to"))
    periods = records.where((F.col("status") == "active") & (begin.isNull() | end.isNull() | (begin <= end)))
    # Each record counts once for each of its areas, and once for no area.
    areas = F.array_distinct(F.concat(F.coalesce(area_list(F.col("policy_area"), kind), F.array().cast("array<string>")), F.array(F.lit(None).cast("string"))))
    notice = F.col("document_type").isin(*NOTICES).cast("long")
    changes = F.array(F.struct(F.coalesce(begin, F.to_date(F.lit("0001-01-01"))).alias("day"), F.lit(1).cast("long").alias("sign")), F.struct(F.date_add(end, 1).alias("day"), F.lit(-1).cast("long").alias("sign")))
    steps = periods.select(notice.alias("notice"), F.explode(areas).alias("area"), changes.alias("changes")).select("notice", "area", F.explode("changes").alias("c")).where("c.day is not null")
    steps = steps.groupBy("area", F.col("c.day").alias("day")).agg(F.sum("c.sign").alias("n"), F.sum(F.col("c.sign") * F.coalesce("notice", F.lit(0))).alias("m"))
    days = questions.where("day is not null").select(F.col("policy_area").alias("area"), "day").distinct()
    zero = F.lit(0).cast("long")
    both = steps.unionByName(days.select("area", "day", zero.alias("n"), zero.alias("m"))).groupBy("area", "day").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    running = Window.partitionBy("area").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # days, not records
    force = both.select(F.col("area").alias("_area"), F.col("day").alias("_day"), F.sum("n").over(running).alias("active_documents"), F.sum("m").over(running).alias("active_notices"))
    return questions.join(force, (F.col("day") == F.col("_day")) & F.col("policy_area").eqNullSafe(F.col("_area")), "left").drop("_area", "_day")


def missing_notice(questions: DataFrame, records: DataFrame, chunks: DataFrame, as_of: str) -> DataFrame:
    """questions (question_id, question, policy_area) with needs_notice,
    active_notices, covered_notices (with a chunk) and warn: a notice is needed
    and no active one of the area has a chunk."""
    return _missing(questions, held_notices(records, chunks, as_of))


def held_notices(records: DataFrame, chunks: DataFrame, as_of: str) -> DataFrame:
    """Active notices (doc_id, areas) with held, whether a chunk is there."""
    held = chunks.select("doc_id").distinct().withColumn("held", F.lit(True))
    return current_notices(records, as_of).join(held, "doc_id", "left").withColumn("held", F.coalesce("held", F.lit(False)))


def _missing(questions: DataFrame, notices: DataFrame) -> DataFrame:
    """missing_notice, of notices as held_notices gives them."""
    asked = questions.withColumn("needs_notice", requires_current_notice(F.col("question")))
    # Notices in force are few: one row for each area and all of them.
    by_area = notices.select(F.explode(F.coalesce("areas", F.array().cast("array<string>"))).alias("policy_area"), "doc_id", "held").distinct()
    totals = by_area.groupBy("policy_area").agg(F.count("*").alias("n"), F.sum(F.col("held").cast("int")).alias("m"))
    overall = notices.agg(F.count("*").alias("all_n"), F.coalesce(F.sum(F.col("held").cast("int")), F.lit(0)).alias("all_m"))
    joined = asked.join(totals, "policy_area", "left").join(F.broadcast(overall), F.lit(True))  # overall is one row
    none = F.col("policy_area").isNull()
    joined = joined.withColumn("active_notices", F.when(none, F.col("all_n")).otherwise(F.coalesce("n", F.lit(0)))).withColumn("covered_notices", F.when(none, F.col("all_m")).otherwise(F.coalesce("m", F.lit(0))))
    warn = F.col("needs_notice") & (F.col("covered_notices") == 0)
    return joined.withColumn("warn", warn).drop("n", "m", "all_n", "all_m")


def unavailable_notices(records: DataFrame, chunks: DataFrame, as_of: str) -> DataFrame:
    """Active notices without a chunk."""
    return current_notices(records, as_of).join(chunks.select("doc_id").distinct(), "doc_id", "left_anti")


def notice_alerts(questions: DataFrame, records: DataFrame, chunks: DataFrame, as_of: str) -> DataFrame:
    """(question_id, doc_id): for a question that warns although its area has
    active notices, each of those notices; none of them has a chunk. A question
    without an area has the notices of all."""
    notices = materialize(held_notices(records, chunks, as_of), "notices")  # asked for twice
    warned = _missing(questions, notices).where("warn and active_notices > 0")
    areas = F.filter(F.coalesce("areas", F.array().cast("array<string>")), lambda a: a.isNotNull())
    silent = notices.where("not held").select("doc_id", F.explode(F.concat(areas, F.array(F.lit(None).cast("string")))).alias("area")).distinct()

    def key(area: str) -> Column:
        return F.when(F.col(area).isNull(), "").otherwise(F.concat(F.lit("="), area)).alias("key")

    # Both are small beside their product, whose rows are counted first.
    warned, silent = materialize(warned.select("question_id", key("policy_area")), "warned"), materialize(silent.select("doc_id", key("area")), "silent")
    rows = warned.groupBy("key").agg(F.count("*").alias("n")).join(silent.groupBy("key").agg(F.count("*").alias("m")), "key").agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).first()[0]
    slots = max(4 * records.sparkSession.sparkContext.defaultParallelism, -(-rows // ALERT_ROWS))
    # Areas are few, so the notices of an area are dealt to slots, and each slot gets
    # the area's questions. Within it a block of questions meets a block of notices at
    # a time: rows that lie together hold few ids in turns, which files keep in a
    # fraction of the space.
    dealt = silent.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int")).repartition(slots, "key", "slot")
    place = F.row_number().over(Window.partitionBy("key", "slot").orderBy("doc_id")) - 1
    blocks = dealt.withColumn("block", F.floor(place / NOTICE_BLOCK)).groupBy("key", "slot", "block").agg(F.collect_list(F.struct("doc_id")).alias("docs"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("question_id")) - 1
    asked = warned.withColumn("part", F.floor(place / QUESTION_BLOCK)).groupBy("key", "part").agg(F.collect_list(F.struct("question_id")).alias("questions"))
    asked = asked.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).repartition(slots, "key", "slot")
    # Generated code keeps all that a row of a join becomes before it hands on the
    # first, here a block's rows for each question of the area. Sorting the few pairs
    # of blocks comes between, so a task holds the rows of one pair.
    met = blocks.join(asked.hint("merge"), ["key", "slot"]).sortWithinPartitions("key", "slot", "block", "part")
    return met.select(F.inline("questions"), "docs").select("question_id", F.inline("docs"))


def prioritize_documents(records: DataFrame, question_is_timely: Column | bool, policy_area: str | None, as_of: str, order_col: str = "ord") -> DataFrame:
    """Active records with rank: those of the area first, then by type (notices
    first for timely questions, regulations first for others), then in order."""
    kind = records.schema["policy_area"].dataType
    timely = F.lit(question_is_timely) if isinstance(question_is_timely, bool) else question_is_timely
    t = F.col("document_type")
    notice = F.when(t == "semester_notice", 0).when(t == "annual_notice", 1).when(t == "regulation", 2).otherwise(3)
    stable = F.when(t == "regulation", 0).when(t == "semester_notice", 1).when(t == "annual_notice", 2).otherwise(3)
    rows = active_documents(records, as_of).withColumn("area_rank", F.when(area_matches(area_list(F.col("policy_area"), kind), F.lit(policy_area).cast("string")), 0).otherwise(1))
    rows = rows.withColumn("type_rank", F.when(timely, notice).otherwise(stable))
    return number_rows(rows, ["area_rank", "type_rank"], order_col)


def number_rows(rows: DataFrame, groups: list[str], order_col: str, parts: int = 64) -> DataFrame:
    """rows with rank, their number in the order of the groups and of a numeric
    column. No task takes all: quantiles cut each group, rows are numbered
    within a cut, and the few counts of the cuts are summed up before."""
    order = F.col(order_col).cast("double")
    cuts = sorted(set(rows.select(order.alias("o")).approxQuantile("o", [k / parts for k in range(1, parts)], 0.01)))
    cut = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < order)) if cuts else F.lit(0)
    placed = rows.withColumn("_cut", F.when(order.isNull(), F.lit(-1)).otherwise(cut))
    counts = placed.groupBy(*groups, "_cut").agg(F.count("*").alias("_n"))  # at most `parts` rows for each group
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy(*groups, "_cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = Window.partitionBy(*groups, "_cut").orderBy(order_col)
    return placed.withColumn("rank", F.row_number().over(within)).join(before, [*groups, "_cut"]).withColumn("rank", F.col("rank") + F.col("_before")).drop("_cut", "_before")
