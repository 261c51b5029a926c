"""Study report presets: each report is a generic operator with fixed names.

``section_report(tables, section)`` returns ``{name: DataFrame}`` for a
section (``participants``, ``submissions``, ``feedback``, ``events`` or
``all``); nothing runs until a frame is acted on, except the exact median,
which runs its bounded histogram passes when built.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.exprs import passed_expr, with_ratios
from cohortlens.operators.counting import (count_by, count_by_pair, count_rows,
                                           count_where_not_null, top_by_count, top_counts)
from cohortlens.operators.durations import (cast_report, duration_median, duration_overview,
                                            duration_stats)
from cohortlens.operators.grouping import counts_onepass, means_onepass, stats_onepass
from cohortlens.operators.means import means, means_by
from cohortlens.operators.rates import numeric_stats, rate
from cohortlens.schema import RATINGS, StudyError
from cohortlens.sources.tables import StudyTables

# -- participants ------------------------------------------------------------


def participants_total(t: StudyTables) -> DataFrame:
    return count_rows(t.participants, "total_participants")


def participants_by_skill_level(t: StudyTables) -> DataFrame:
    return count_by(t.participants, "skill_level")


def participants_by_intervention_type(t: StudyTables) -> DataFrame:
    return count_by(t.participants, "intervention_type")


def participants_by_snippet_id(t: StudyTables) -> DataFrame:
    return count_by(t.participants, "snippet_id")


def participants_skill_x_intervention(t: StudyTables) -> DataFrame:
    return count_by_pair(t.participants, "skill_level", "intervention_type")


def participants_skill_x_snippet(t: StudyTables) -> DataFrame:
    return count_by_pair(t.participants, "skill_level", "snippet_id")


def participants_finished(t: StudyTables) -> DataFrame:
    return count_where_not_null(t.participants, ["started_at", "ended_at"], "finished")


def participants_duration_avg(t: StudyTables, mode: str = "row") -> DataFrame:
    return duration_stats(t.participants, "started_at", "ended_at", mode)


def participants_duration_median(t: StudyTables, mode: str = "row") -> DataFrame:
    return duration_median(t.participants, "started_at", "ended_at", mode)


def participants_duration_avg_strict(t: StudyTables) -> DataFrame:
    """P8 under the strict policy: NULL statistics if any candidate fails to parse."""
    return participants_duration_avg(t, mode="strict")


def participants_duration_median_strict(t: StudyTables) -> DataFrame:
    """P9 under the strict policy."""
    return participants_duration_median(t, mode="strict")


def duration_cast_policy(t: StudyTables) -> DataFrame:
    return cast_report(t.participants, "started_at", "ended_at")


# -- submissions -------------------------------------------------------------


def submissions_total(t: StudyTables) -> DataFrame:
    return count_rows(t.code_submissions, "total_submissions")


def submissions_by_status(t: StudyTables) -> DataFrame:
    return count_by(t.code_submissions, "status")


def submissions_pass_rate(t: StudyTables) -> DataFrame:
    return rate(t.code_submissions, passed_expr(), total="total_rows",
                hits="passed_rows", percent="pass_rate_percent")


def submissions_time_stats(t: StudyTables) -> DataFrame:
    return numeric_stats(t.code_submissions, "time_taken_ms", n="n_with_time",
                         avg="avg_ms", min_="min_ms", max_="max_ms")


# -- feedback ----------------------------------------------------------------


def feedback_means_overall(t: StudyTables) -> DataFrame:
    return means(t.feedback, RATINGS, prefix="avg_")


def feedback_means_by_intervention(t: StudyTables) -> DataFrame:
    return means_by(t.feedback, "intervention_type", RATINGS, lookup=t.participants)


def feedback_means_by_skill(t: StudyTables) -> DataFrame:
    return means_by(t.feedback, "skill_level", RATINGS, lookup=t.participants)


def feedback_means_by_snippet(t: StudyTables) -> DataFrame:
    return means_by(t.feedback, "snippet_id", RATINGS)


# -- events ------------------------------------------------------------------


def events_by_type(t: StudyTables) -> DataFrame:
    return count_by(t.events, "event_type", null_label=None)


def events_top_participants(t: StudyTables, k: int = 50) -> DataFrame:
    return top_by_count(t.events, "participant_id", k)


# -- one-pass forms ----------------------------------------------------------

PARTICIPANT_SETS = [(), ("skill_level",), ("intervention_type",), ("snippet_id",),
                    ("skill_level", "intervention_type"), ("skill_level", "snippet_id")]
FEEDBACK_SETS = [(), ("intervention_type",), ("skill_level",), ("snippet_id",)]


def participants_counts_onepass(t: StudyTables) -> DataFrame:
    """P1-P6 from one scan of participants."""
    return counts_onepass(t.participants, PARTICIPANT_SETS)


def feedback_means_onepass(t: StudyTables) -> DataFrame:
    """F1-F4 from one scan of feedback and one join.

    ``snippet_id`` is feedback's own column; the arm and skill come from
    participants.
    """
    return means_onepass(t.feedback, t.participants, FEEDBACK_SETS, RATINGS,
                         fact_dims=["snippet_id"])


# -- sections ----------------------------------------------------------------

Report = Callable[[StudyTables], DataFrame]

SECTIONS: dict[str, dict[str, Report]] = {
    "participants": {
        "participants_total": participants_total,
        "participants_by_skill_level": participants_by_skill_level,
        "participants_by_intervention_type": participants_by_intervention_type,
        "participants_by_snippet_id": participants_by_snippet_id,
        "participants_skill_x_intervention": participants_skill_x_intervention,
        "participants_skill_x_snippet": participants_skill_x_snippet,
        "participants_finished": participants_finished,
        "participants_duration_avg": participants_duration_avg,
        "participants_duration_median": participants_duration_median,
        "duration_cast_policy": duration_cast_policy,
    },
    "submissions": {
        "submissions_total": submissions_total,
        "submissions_by_status": submissions_by_status,
        "submissions_pass_rate": submissions_pass_rate,
        "submissions_time_stats": submissions_time_stats,
    },
    "feedback": {
        "feedback_means_overall": feedback_means_overall,
        "feedback_means_by_intervention": feedback_means_by_intervention,
        "feedback_means_by_skill": feedback_means_by_skill,
        "feedback_means_by_snippet": feedback_means_by_snippet,
    },
    "events": {
        "events_by_type": events_by_type,
        "events_top_participants": events_top_participants,
    },
}

# Titles of the source system's printed tables (fixed values).
TITLES = {
    "participants_total": "Total participants that started",
    "participants_by_skill_level": "Participants by skill_level",
    "participants_by_intervention_type": "Participants by intervention_type",
    "participants_by_snippet_id": "Participants by snippet_id",
    "participants_skill_x_intervention": "Participants by (skill_level, intervention_type)",
    "participants_skill_x_snippet": "Participants by (skill_level, snippet_id)",
    "participants_finished": "Participants who finished (started_at AND ended_at present)",
    "participants_duration_avg": "Duration (avg seconds) for finished (castable ISO timestamps only)",
    "participants_duration_median": "Median duration (seconds)",
    "duration_cast_policy": "Duration candidates by castability",
    "submissions_total": "Total code submissions",
    "submissions_by_status": "Submission counts by status",
    "submissions_pass_rate": "Overall submission pass rate",
    "submissions_time_stats": "Submission time stats (ms)",
    "feedback_means_overall": "Feedback (overall means)",
    "feedback_means_by_intervention": "Feedback means by intervention_type",
    "feedback_means_by_skill": "Feedback means by skill_level",
    "feedback_means_by_snippet": "Feedback means by snippet_id",
    "events_by_type": "Events by type",
    "events_top_participants": "Top 50 participants by event count",
}


def section_report(t: StudyTables, section: str = "all") -> dict[str, DataFrame]:
    """Reports of one section (or ``all``), in the source system's order."""
    if section == "all":
        chosen = list(SECTIONS)
    elif section in SECTIONS:
        chosen = [section]
    else:
        raise StudyError(f"unknown section {section!r}; choose from "
                         f"{', '.join([*SECTIONS, 'all'])}")
    return {name: fn(t) for s in chosen for name, fn in SECTIONS[s].items()}


def section_of(name: str) -> str:
    for section, reports in SECTIONS.items():
        if name in reports:
            return section
    raise KeyError(name)


# Key (string) and metric (numeric) columns of every report, in order.
REPORT_SHAPES: dict[str, tuple[list[str], list[str]]] = {
    "participants_total": ([], ["total_participants"]),
    "participants_by_skill_level": (["skill_level"], ["n"]),
    "participants_by_intervention_type": (["intervention_type"], ["n"]),
    "participants_by_snippet_id": (["snippet_id"], ["n"]),
    "participants_skill_x_intervention": (["skill_level", "intervention_type"], ["n"]),
    "participants_skill_x_snippet": (["skill_level", "snippet_id"], ["n"]),
    "participants_finished": ([], ["finished"]),
    "participants_duration_avg": ([], ["n_durations", "avg_secs"]),
    "participants_duration_median": ([], ["median_secs"]),
    "duration_cast_policy": ([], ["n_candidates", "n_castable", "n_uncastable"]),
    "submissions_total": ([], ["total_submissions"]),
    "submissions_by_status": (["status"], ["n"]),
    "submissions_pass_rate": ([], ["total_rows", "passed_rows", "pass_rate_percent"]),
    "submissions_time_stats": ([], ["n_with_time", "avg_ms", "min_ms", "max_ms"]),
    "feedback_means_overall": ([], [f"avg_{c}" for c in RATINGS]),
    "feedback_means_by_intervention": (["intervention_type"], ["n", *RATINGS]),
    "feedback_means_by_skill": (["skill_level"], ["n", *RATINGS]),
    "feedback_means_by_snippet": (["snippet_id"], ["n", *RATINGS]),
    "events_by_type": (["event_type"], ["n"]),
    "events_top_participants": (["participant_id"], ["n"]),
}


def report_long(reports: dict[str, DataFrame]) -> DataFrame:
    """All results in one long table.

    ``(section, report, title, key_1, key_2, metric, value)``: the key
    columns of a result fill ``key_1``/``key_2``; every metric column
    becomes one ``(metric, value)`` row with a double ``value``. Each result
    is unpivoted with ``stack`` and the pieces are unioned, so the whole
    report is one plan that can be written as one Parquet table.
    """
    pieces = []
    for name, df in reports.items():
        keys, metrics = REPORT_SHAPES[name]
        pieces.append(_long(df, name, [F.col(k) for k in keys], {m: F.col(m) for m in metrics}))
    return _titled(pieces)


def _titled(pieces: list[DataFrame]) -> DataFrame:
    """Union long pieces and add each report's section and title."""
    out = pieces[0]
    for piece in pieces[1:]:
        out = out.union(piece)  # every piece has the same five columns in order
    sections = {name: section_of(name) for name in REPORT_SHAPES}
    return out.select(_lookup(sections, F.col("report")).alias("section"), "report",
                      _lookup(TITLES, F.col("report")).alias("title"),
                      "key_1", "key_2", "metric", "value")


def _lookup(mapping: dict[str, str], key):
    """Literal map lookup as a Spark expression."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.create_map(*pairs)[key]


def _long(df, report, keys, metrics):
    """Unpivot ``df`` into ``(report, key_1, key_2, metric, value)`` rows.

    ``report`` is a report name, or a Column giving it per row; ``keys`` are
    up to two Columns; ``metrics`` maps metric name -> Column.
    """
    return _long_entries(df, keys, [(report, m, c) for m, c in metrics.items()])


def _long_entries(df, keys, entries):
    """Unpivot with one ``(report, metric, value)`` triple per entry.

    ``report`` and ``metric`` may be names or Columns, so one aggregate can
    feed several reports (or a per-row report name) through a single
    ``stack``, and each aggregate appears once in the plan.
    """
    key_cols = list(keys) + [F.lit(None).cast("string")] * (2 - len(keys))
    args = []
    for report, metric, value in entries:
        args += [F.lit(report) if isinstance(report, str) else report,
                 F.lit(metric) if isinstance(metric, str) else metric,
                 value.cast("double")]
    return df.select(key_cols[0].cast("string").alias("key_1"),
                     key_cols[1].cast("string").alias("key_2"),
                     F.stack(F.lit(len(entries)), *args).alias("report", "metric", "value")) \
        .select("report", "key_1", "key_2", "metric", "value")


def report_long_onepass(t: StudyTables) -> DataFrame:
    """Every report of every section in long form, from shared scans.

    The same rows as ``report_long(section_report(t, 'all'))`` with far fewer
    scans, one for each of: P1-P6 (grouping sets), P7-P10 (the write of the median's
    values, read back once more), S1-S4 (by status and in total), F1-F4 (and the
    labels they are joined with), E1 and E2. Nothing is sorted: a long table has no
    order (the top-50 keeps its limit, which is the report itself).
    """
    p = t.participants
    pieces = []
    gs = F.col("grouping_set")
    is_total = gs == "total"
    # P1-P6: one grouping-sets aggregate, one row each
    r3 = participants_counts_onepass(t)
    names3 = {"total": "participants_total", "skill_level": "participants_by_skill_level",
              "intervention_type": "participants_by_intervention_type",
              "snippet_id": "participants_by_snippet_id",
              "skill_level,intervention_type": "participants_skill_x_intervention",
              "skill_level,snippet_id": "participants_skill_x_snippet"}
    key1 = F.coalesce("skill_level", "intervention_type", "snippet_id")
    key2 = F.when(F.col("skill_level").isNotNull(), F.coalesce("intervention_type", "snippet_id"))
    pieces.append(_long_entries(r3, [key1, key2], [
        (_lookup(names3, gs), F.when(is_total, F.lit("total_participants")).otherwise(F.lit("n")),
         F.col("n"))]))
    # P7-P10 from one scan: the write of the median's values observes the others
    figures, median = duration_overview(p)
    pieces.append(_long_entries(figures, [], [
        ("participants_finished", "finished", F.col("finished")),
        ("participants_duration_avg", "n_durations", F.col("n_durations")),
        ("participants_duration_avg", "avg_secs", F.col("avg_secs")),
        *[("duration_cast_policy", m, F.col(m))
          for m in ("n_candidates", "n_castable", "n_uncastable")]]))
    pieces.append(_long(median, "participants_duration_median", [], {"median_secs": F.col("median_secs")}))
    # S1-S4 from one aggregate by status and its total
    by_status = stats_onepass(t.code_submissions, "status", passed_expr(), "time_taken_ms")
    by_status = with_ratios(by_status, {"pct": ("100BD * hits", "n")}, 2)
    of_total = lambda name: F.when(is_total, F.lit(name))
    pieces.append(_long_entries(by_status, [F.col("status")], [
        (F.when(is_total, F.lit("submissions_total")).otherwise(F.lit("submissions_by_status")),
         F.when(is_total, F.lit("total_submissions")).otherwise(F.lit("n")), F.col("n")),
        (of_total("submissions_pass_rate"), "total_rows", F.col("n")),
        (of_total("submissions_pass_rate"), "passed_rows", F.col("hits")),
        (of_total("submissions_pass_rate"), "pass_rate_percent", F.col("pct")),
        *[(of_total("submissions_time_stats"), metric, F.col(c)) for metric, c in (
            ("n_with_time", "n_values"), ("avg_ms", "avg"), ("min_ms", "min"), ("max_ms", "max"))],
    ]).where(F.col("report").isNotNull()))
    # F1-F4: one grouping-sets aggregate; the total row has no n and avg_ names
    r4 = feedback_means_onepass(t)
    names4 = {"total": "feedback_means_overall",
              "intervention_type": "feedback_means_by_intervention",
              "skill_level": "feedback_means_by_skill", "snippet_id": "feedback_means_by_snippet"}
    f_long = _long_entries(
        r4, [F.coalesce("intervention_type", "skill_level", "snippet_id")],
        [(_lookup(names4, gs), "n", F.col("n")),
         *[(_lookup(names4, gs),
            F.when(is_total, F.lit(f"avg_{c}")).otherwise(F.lit(c)), F.col(c)) for c in RATINGS]])
    pieces.append(f_long.where((F.col("report") != "feedback_means_overall")
                               | (F.col("metric") != "n")))
    # E1, E2 roll up one aggregate by both keys, whose shuffle they share
    fine = t.events.groupBy("participant_id", "event_type").agg(F.count(F.lit(1)).alias("__rows"))
    n = F.sum("__rows").alias("n")
    pieces.append(_long(fine.groupBy("event_type").agg(n), "events_by_type", [F.col("event_type")],
                        {"n": F.col("n")}))
    pieces.append(_long(top_counts(fine.groupBy("participant_id").agg(n), "participant_id"),
                        "events_top_participants", [F.col("participant_id")], {"n": F.col("n")}))

    return _titled(pieces)
