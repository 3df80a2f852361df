"""Records in force on each question's own day."""

from __future__ import annotations

import datetime as dt
import random

from docloom.operators import registry

RECORD = "doc_id string, document_type string, status string, policy_area string, effective_from string, effective_to string"


def test_equals_a_look_at_every_pair(spark):
    rng = random.Random(2)
    day = lambda: (dt.date(2024, 1, 1) + dt.timedelta(rng.randint(0, 40))).isoformat()
    records = [(f"d{i}", rng.choice(["regulation", "semester_notice", None]), rng.choice(["active", "active", "expired", None]), rng.choice(["a", "b", '["a", "b"]', '["a", "a"]', None]), rng.choice([day(), None, "soon"]), rng.choice([day(), day(), None, "2024-02-30"])) for i in range(200)]
    asked = [(i, rng.choice([dt.date(2024, 1, 1) + dt.timedelta(rng.randint(-3, 45)), None]), rng.choice(["a", "b", "none", None])) for i in range(150)]
    got = {r.question_id: (r.active_documents, r.active_notices) for r in registry.active_on_days(spark.createDataFrame(asked, "question_id int, day date, policy_area string"), spark.createDataFrame(records, RECORD)).collect()}

    def date(x):
        try:
            return dt.date.fromisoformat(x or "")
        except ValueError:
            return None

    def holds(r, d, area):
        first, last = date(r[4]), date(r[5])
        areas = [] if r[3] is None else ["a", "b"] if '"b"' in r[3] else ["a"] if "[" in r[3] else [r[3]]
        return r[2] == "active" and (first is None or d >= first) and (last is None or d <= last) and (area is None or area in areas)

    for i, d, area in asked:
        found = [r for r in records if d is not None and holds(r, d, area)]
        want = (len(found), sum(r[1] == "semester_notice" for r in found)) if d else (None, None)
        assert got[i] == want, (i, d, area)


def test_no_records(spark):
    asked = spark.createDataFrame([(1, dt.date(2024, 1, 1), None)], "question_id int, day date, policy_area string")
    (r,) = registry.active_on_days(asked, spark.createDataFrame([], RECORD)).collect()
    assert (r.active_documents, r.active_notices) == (0, 0)
