"""Randomised parity: every report on small random study tables, Spark vs DuckDB.

Tables are drawn with NULLs everywhere, orphan and NULL participant ids,
label ties, mixed-case status words, empty tables and malformed timestamp
text; each report must equal the oracle SQL run by DuckDB on the same rows,
in the same order where the report defines one.
"""

import duckdb
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, Phase, example, given, settings
from hypothesis import strategies as st

from cohortlens.plans import oracle
from cohortlens.plans.registry import REPORTS
from cohortlens.schema import RATINGS
from cohortlens.sources.tables import StudyTables
from tests.oracle_check import canon

ORDERED = {"participants_by_skill_level", "participants_by_intervention_type",
           "participants_by_snippet_id", "participants_skill_x_intervention",
           "participants_skill_x_snippet", "submissions_by_status",
           "feedback_means_by_intervention", "feedback_means_by_skill",
           "feedback_means_by_snippet", "events_by_type", "events_top_participants"}

TS = [None, "2024-01-01T00:00:00Z", "2024-01-01T00:30:15Z", "2024-01-02 10:00:00+02:00",
      "2024-01-01T00:00:00.250000+00:00", "2024-01-01", "not-a-time", "unknown", "12:30",
      "20240101T101010Z", "2023-12-31T23:59:59+0000"]
IDS = [f"p{i}" for i in range(8)]
FOREIGN = IDS + ["x1", "x2", None]

P_SCHEMA = ("participant_id string, skill_level string, intervention_type string, "
            "snippet_id string, started_at string, ended_at string")
S_SCHEMA = ("participant_id string, status string, tests_total int, tests_passed int, "
            "time_taken_ms bigint")
F_SCHEMA = "participant_id string, snippet_id string, " + ", ".join(f"{c} int" for c in RATINGS)
E_SCHEMA = "participant_id string, event_type string"

participants = st.lists(st.tuples(
    st.sampled_from([None, "novice", "expert", "Expert"]),
    st.sampled_from([None, "arm_a", "arm_b"]),
    st.sampled_from([None, "s1", "s2"]),
    st.sampled_from(TS), st.sampled_from(TS)), max_size=len(IDS))
submissions = st.lists(st.tuples(
    st.sampled_from(FOREIGN),
    st.sampled_from([None, "pass", "PASSED", "ok", "Failed", "error", "Success"]),
    st.one_of(st.none(), st.integers(0, 4)), st.one_of(st.none(), st.integers(0, 4)),
    st.one_of(st.none(), st.integers(-5, 10_000))), max_size=14)
feedback = st.lists(st.tuples(
    st.sampled_from(FOREIGN), st.sampled_from([None, "s1", "s2", "s3"]),
    *[st.one_of(st.none(), st.integers(1, 9)) for _ in RATINGS]), max_size=16)
events = st.lists(st.tuples(
    st.sampled_from(FOREIGN), st.sampled_from([None, "click", "view", "Click"])), max_size=16)


def _arrow(rows, names, types):
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table({n: pa.array(list(c), type=t) for n, c, t in zip(names, cols, types)})


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck),
          phases=[Phase.explicit, Phase.reuse, Phase.generate])
@given(participants, submissions, feedback, events)
@example([], [], [], [])
def test_reports_match_oracle_on_random_tables(spark, p, s, f, e):
    p = [(IDS[i], *row) for i, row in enumerate(p)]
    tables = StudyTables(
        participants=spark.createDataFrame(p, P_SCHEMA),
        code_submissions=spark.createDataFrame(s, S_SCHEMA),
        feedback=spark.createDataFrame(f, F_SCHEMA),
        events=spark.createDataFrame(e, E_SCHEMA))
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    text, i32, i64 = pa.string(), pa.int32(), pa.int64()
    con.register("st_participants", _arrow(p, ["participant_id", "skill_level",
                                               "intervention_type", "snippet_id",
                                               "started_at", "ended_at"], [text] * 6))
    con.register("st_submissions", _arrow(s, ["participant_id", "status", "tests_total",
                                              "tests_passed", "time_taken_ms"],
                                          [text, text, i32, i32, i64]))
    con.register("st_feedback", _arrow(f, ["participant_id", "snippet_id", *RATINGS],
                                       [text, text] + [i32] * len(RATINGS)))
    con.register("st_events", _arrow(e, ["participant_id", "event_type"], [text, text]))
    for name, fn in REPORTS.items():
        df = fn(tables)
        got = [tuple(r) for r in df.collect()]
        rel = con.execute(oracle.bare_sql(*oracle.REPORT_PARTS[name]))
        cols = [d[0] for d in rel.description]
        want = rel.fetchall()
        assert sorted(df.columns) == sorted(cols), name
        assert canon(got, df.columns) == canon(want, cols), name
        if name in ORDERED:
            order = [cols.index(c) for c in df.columns]
            assert got == [tuple(r[i] for i in order) for r in want], name


@pytest.mark.parametrize("n", [1, 2, 5])
def test_tiny_tables_median(spark, n):
    from cohortlens.operators.durations import duration_median
    rows = [(f"p{i}", None, None, None, "2024-01-01T00:00:00Z", f"2024-01-01T00:00:{10 * i:02d}Z")
            for i in range(n)]
    df = spark.createDataFrame(rows, P_SCHEMA)
    secs = sorted(10 * i for i in range(n))
    want = int((secs[(n - 1) // 2] + secs[n // 2]) / 2)
    assert duration_median(df).first()["median_secs"] == want
