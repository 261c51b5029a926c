"""Oracle SQL for every registered query, runnable by DuckDB.

Each statement is self-contained: it starts with the fixture ``WITH`` list
over the driver's tables (``customer``, ``orders``, ``lineitem``,
``events``) and then states the report the way the source system's SQL does,
with the portability rules of the build applied on both sides: means rounded by
integer arithmetic, NULLs last in ascending order, truncation by ``TRUNC`` and
timestamps parsed only in the two ISO forms.
"""

from __future__ import annotations

from cohortlens.schema import NULL_LABEL, PASS_WORDS, RATINGS, STUDY_TABLES
from cohortlens.sources.fixtures import oracle_with_clause

NL = f"'{NULL_LABEL}'"


def rnd(total: str, n: str, digits: int) -> str:
    """``total / n`` of two integers, halves away from zero."""
    t, p = f"CAST({total} AS HUGEINT)", 10 ** digits
    d = f"CAST(NULLIF({n}, 0) AS HUGEINT)"
    return (f"CAST(sign({t}) * ((abs({t}) // {d}) * {p} + ((abs({t}) % {d}) * {2 * p} + {d}) // (2 * {d})) "
            f"AS DOUBLE) / {p}")


def with_views(body: str, extra: list[str] | None = None) -> str:
    """Fixture views plus optional extra CTEs, then ``body``."""
    head = oracle_with_clause()
    if extra:
        head += ",\n" + ",\n".join(extra)
    return f"{head}\n{body}"


def _parts(body: str, extra: list[str] | None = None) -> tuple[str, list[str]]:
    """A report statement as (body, extra CTEs), without the fixture views."""
    return body, list(extra or [])


def bare_sql(body: str, extra: list[str]) -> str:
    """The statement over tables already named ``st_*`` (no fixture views)."""
    return ("WITH " + ",\n".join(extra) + "\n" + body) if extra else body


def _label_count(view: str, key: str) -> str:
    return _parts(
        f"SELECT COALESCE({key}, {NL}) AS {key}, COUNT(*) AS n FROM {view} "
        f"GROUP BY 1 ORDER BY n DESC, {key} NULLS LAST")


def _pair_count(view: str, k1: str, k2: str) -> str:
    return _parts(
        f"SELECT COALESCE({k1}, {NL}) AS {k1}, COALESCE({k2}, {NL}) AS {k2}, COUNT(*) AS n "
        f"FROM {view} GROUP BY 1, 2 ORDER BY 1 NULLS LAST, 2 NULLS LAST")


# Stated apart from the library's own patterns: the fields of a time are taken one by one and
# put together by arithmetic, not by a cast.
_FIELDS = "['y', 'mo', 'd', 'h', 'mi', 's', 'us', 'z']"
_DASHED = (r"^\s*(\d{4})-(\d\d?)-(\d\d?)(?:[ T](\d\d?):(\d\d?)(?::(\d\d?)(?:\.(\d{1,6}))?)?"
           r"\s*(Z|UTC|[-+]\d\d(?::?\d\d)?)?)?\s*$")
_PLAIN = r"^\s*(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)(?:\.(\d{1,6}))?(Z|[-+]\d\d(?::?\d\d)?)?\s*$"


def _stamp(c: str) -> str:
    """A text column as a UTC timestamp, by the two ISO forms; NULL for any other text or no such time."""
    fields = (f"CASE WHEN regexp_matches({c}, '{_PLAIN}') THEN regexp_extract({c}, '{_PLAIN}', {_FIELDS}) "
              f"ELSE regexp_extract({c}, '{_DASHED}', {_FIELDS}) END")
    num = lambda x: f"COALESCE(TRY_CAST({x} AS BIGINT), 0)"
    second = f"{num('f.s')} + {num("rpad(f.us, 6, '0')")} / 1e6"
    local = f"TRY(make_timestamp({num('f.y')}, {num('f.mo')}, {num('f.d')}, {num('f.h')}, {num('f.mi')}, {second}))"
    digits = "replace(f.z[2:], ':', '')"
    minutes = (f"CASE WHEN f.z[1:1] IN ('+', '-') THEN (CASE f.z[1:1] WHEN '-' THEN -1 ELSE 1 END) * "
               f"({num(f'({digits})[1:2]')} * 60 + {num(f'({digits})[3:4]')}) ELSE 0 END")
    return (f"list_transform([{fields}], lambda f: CASE WHEN f.y <> '' AND {num('f.h')} < 24 AND {num('f.s')} < 60 "
            f"THEN {local} - to_minutes({minutes}) END)[1]")


def durations_cte(view: str = "st_participants") -> str:
    """Both texts must hold one of the marks of a timestamp; ``us`` is NULL where one isn't any."""
    marks = [":", "+", "Z", "T", "-"]
    marked = " AND ".join("(" + " OR ".join(f"contains({c}, '{m}')" for m in marks) + ")"
                          for c in ("started_at", "ended_at"))
    return (f"durations AS (SELECT epoch_us({_stamp('ended_at')}) - epoch_us({_stamp('started_at')}) AS us "
            f"FROM {view} WHERE {marked})")


DURATIONS_CTE = durations_cte()


def _means_cols(prefix: str = "") -> str:
    return ", ".join(f"{rnd(f'SUM({c})', f'COUNT({c})', 2)} AS {prefix}{c}" for c in RATINGS)


def _means_by_joined(key: str) -> str:
    return _parts(
        f"SELECT COALESCE(p.{key}, {NL}) AS {key}, COUNT(*) AS n, {_means_cols()} "
        "FROM st_feedback f LEFT JOIN st_participants p USING (participant_id) "
        f"GROUP BY 1 ORDER BY n DESC, {key} NULLS LAST")


def _set_name(dims: list[str]) -> str:
    parts = ", ".join(f"CASE WHEN GROUPING({d}) = 0 THEN '{d}' END" for d in dims)
    return f"COALESCE(NULLIF(concat_ws(',', {parts}), ''), 'total')"


def _sets_sql(sets: list[tuple[str, ...]]) -> str:
    return ", ".join("(" + ", ".join(s) + ")" for s in sets)


P_DIMS = ["skill_level", "intervention_type", "snippet_id"]
P_SETS = [(), ("skill_level",), ("intervention_type",), ("snippet_id",),
          ("skill_level", "intervention_type"), ("skill_level", "snippet_id")]
F_DIMS = ["snippet_id", "intervention_type", "skill_level"]
F_SETS = [(), ("intervention_type",), ("skill_level",), ("snippet_id",)]

# the tests decide where there are any, else the status word
PASS_CTE = (
    "judged AS (SELECT COALESCE(by_tests, by_word) AS passed FROM (SELECT "
    "CASE WHEN tests_total > 0 THEN tests_passed = tests_total END AS by_tests, "
    "list_contains([" + ", ".join(f"'{w}'" for w in PASS_WORDS) + "], LOWER(status)) AS by_word "
    "FROM st_submissions))"
)

REPORT_PARTS: dict[str, tuple[str, list[str]]] = {
    "participants_total": _parts("SELECT COUNT(*) AS total_participants FROM st_participants"),
    "participants_by_skill_level": _label_count("st_participants", "skill_level"),
    "participants_by_intervention_type": _label_count("st_participants", "intervention_type"),
    "participants_by_snippet_id": _label_count("st_participants", "snippet_id"),
    "participants_skill_x_intervention": _pair_count("st_participants", "skill_level",
                                                     "intervention_type"),
    "participants_skill_x_snippet": _pair_count("st_participants", "skill_level", "snippet_id"),
    "participants_finished": _parts(
        "SELECT COUNT(*) AS finished FROM st_participants "
        "WHERE started_at IS NOT NULL AND ended_at IS NOT NULL"),
    "participants_duration_avg": _parts(
        "SELECT COUNT(us) AS n_durations, CAST(SUM(us) AS DOUBLE) / COUNT(us) / 1e6 AS avg_secs "
        "FROM durations", [DURATIONS_CTE]),
    "participants_duration_median": _parts(
        "SELECT CAST(TRUNC(MEDIAN(us) / 1e6) AS BIGINT) AS median_secs FROM durations "
        "WHERE us IS NOT NULL", [DURATIONS_CTE]),
    "participants_duration_avg_strict": _parts(
        "SELECT CASE WHEN COUNT(*) = COUNT(us) THEN COUNT(us) END AS n_durations, "
        "CASE WHEN COUNT(*) = COUNT(us) THEN CAST(SUM(us) AS DOUBLE) / COUNT(us) / 1e6 END "
        "AS avg_secs FROM durations", [DURATIONS_CTE]),
    "participants_duration_median_strict": _parts(
        "SELECT CASE WHEN (SELECT COUNT(*) = COUNT(us) FROM durations) "
        "THEN CAST(TRUNC(MEDIAN(us) / 1e6) AS BIGINT) END AS median_secs FROM durations "
        "WHERE us IS NOT NULL", [DURATIONS_CTE]),
    "duration_cast_policy": _parts(
        "SELECT COUNT(*) AS n_candidates, COUNT(us) AS n_castable, "
        "COUNT(*) - COUNT(us) AS n_uncastable FROM durations", [DURATIONS_CTE]),
    "submissions_total": _parts("SELECT COUNT(*) AS total_submissions FROM st_submissions"),
    "submissions_by_status": _label_count("st_submissions", "status"),
    "submissions_pass_rate": _parts(
        "SELECT COUNT(*) AS total_rows, COUNT(*) FILTER (WHERE passed) AS passed_rows, "
        + rnd("100 * COUNT(*) FILTER (WHERE passed)", "COUNT(*)", 2)
        + " AS pass_rate_percent FROM judged", [PASS_CTE]),
    "submissions_time_stats": _parts(
        "SELECT COUNT(time_taken_ms) AS n_with_time, "
        + rnd("SUM(time_taken_ms)", "COUNT(time_taken_ms)", 0) + " AS avg_ms, "
        "MIN(time_taken_ms) AS min_ms, MAX(time_taken_ms) AS max_ms FROM st_submissions"),
    "feedback_means_overall": _parts(f"SELECT {_means_cols('avg_')} FROM st_feedback"),
    "feedback_means_by_intervention": _means_by_joined("intervention_type"),
    "feedback_means_by_skill": _means_by_joined("skill_level"),
    "feedback_means_by_snippet": _parts(
        f"SELECT COALESCE(f.snippet_id, {NL}) AS snippet_id, COUNT(*) AS n, {_means_cols()} "
        "FROM st_feedback f GROUP BY 1 ORDER BY n DESC, snippet_id NULLS LAST"),
    "events_by_type": _parts(
        "SELECT event_type, COUNT(*) AS n FROM st_events GROUP BY 1 "
        "ORDER BY n DESC, event_type NULLS LAST"),
    "events_top_participants": _parts(
        "SELECT participant_id, COUNT(*) AS n FROM st_events GROUP BY participant_id "
        "ORDER BY n DESC, participant_id NULLS LAST LIMIT 50"),
    "participants_counts_onepass": _parts(
        f"SELECT {_set_name(P_DIMS)} AS grouping_set, {', '.join(P_DIMS)}, COUNT(*) AS n FROM "
        f"(SELECT {', '.join(f'COALESCE({d}, {NL}) AS {d}' for d in P_DIMS)} FROM st_participants) "
        f"GROUP BY GROUPING SETS ({_sets_sql(P_SETS)})"),
    "feedback_means_onepass": _parts(
        f"SELECT {_set_name(F_DIMS)} AS grouping_set, {', '.join(F_DIMS)}, COUNT(*) AS n, "
        f"{_means_cols()} FROM (SELECT COALESCE(f.snippet_id, {NL}) AS snippet_id, "
        f"COALESCE(p.intervention_type, {NL}) AS intervention_type, "
        f"COALESCE(p.skill_level, {NL}) AS skill_level, "
        + ", ".join(f"f.{c} AS {c}" for c in RATINGS)
        + " FROM st_feedback f LEFT JOIN st_participants p USING (participant_id)) "
        f"GROUP BY GROUPING SETS ({_sets_sql(F_SETS)})"),
}


REPORT_SQL: dict[str, str] = {name: with_views(body, extra)
                              for name, (body, extra) in REPORT_PARTS.items()}


# -- data management ---------------------------------------------------------

VIEW = {"participants": "st_participants", "code_submissions": "st_submissions",
        "feedback": "st_feedback", "events": "st_events"}
PLAN_ORDER = ("code_submissions", "feedback", "events", "participants")


def _ids_values(lines: list[tuple[int, str]]) -> str:
    vals = ", ".join(f"(CAST({n} AS BIGINT), '{v}')" for n, v in lines)
    return f"ids AS (SELECT * FROM (VALUES {vals}) AS t(line_no, participant_id))"


ERASE_CTE = ("erase AS (SELECT DISTINCT participant_id FROM st_participants "
             "WHERE participant_id IN (SELECT participant_id FROM ids))")


def _in_erase(table: str) -> str:
    return (f"(SELECT COUNT(*) FROM {VIEW[table]} "
            "WHERE participant_id IN (SELECT participant_id FROM erase))")


def _retained(table: str, ids: str) -> str:
    return with_views(
        f"SELECT * FROM {VIEW[table]} t WHERE NOT EXISTS "
        "(SELECT 1 FROM erase x WHERE x.participant_id = t.participant_id)", [ids, ERASE_CTE])


def _plan(ids: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, 'participant_id' AS id_column, {_in_erase(t)} AS n_rows"
        for t in PLAN_ORDER)
    return with_views(f"SELECT * FROM ({parts}) WHERE n_rows > 0", [ids, ERASE_CTE])


def _summary(ids: str) -> str:
    cols = ", ".join(f"{_in_erase(t)} AS rows_{t}" for t in STUDY_TABLES)
    total = " + ".join(_in_erase(t) for t in STUDY_TABLES)
    return with_views(f"SELECT (SELECT COUNT(*) FROM erase) AS n_participants, {cols}, "
                      f"{total} AS total_rows", [ids, ERASE_CTE])


def _result(ids: str) -> str:
    total = " + ".join(_in_erase(t) for t in STUDY_TABLES)
    return with_views("SELECT (SELECT COUNT(*) FROM erase) AS successful_deletions, "
                      f"CAST(0 AS BIGINT) AS failed_deletions, {total} AS total_rows_deleted",
                      [ids, ERASE_CTE])


def data_sql(single_id: str, id_lines: list[tuple[int, str]]) -> dict[str, str]:
    one = _ids_values([(1, single_id)])
    batch = _ids_values(id_lines)
    out = {
        "erase_plan": _plan(one),
        **{f"erase_retained_{t}": _retained(t, one) for t in STUDY_TABLES},
        "erase_batch_status": with_views(
            "SELECT i.line_no, i.participant_id, EXISTS (SELECT 1 FROM st_participants p "
            "WHERE p.participant_id = i.participant_id) AS found FROM ids i", [batch]),
        "erase_batch_summary": _summary(batch),
        **{f"erase_batch_retained_{t}": _retained(t, batch) for t in STUDY_TABLES},
        "erase_batch_result": _result(batch),
        "clear_table": with_views(
            "SELECT 'events' AS table_name, COUNT(*) AS n_rows_cleared FROM st_events "
            "UNION ALL SELECT 'events_after', 0"),
        "export_all_csv": with_views(" UNION ALL ".join(
            f"SELECT '{t}' AS table_name, 'exported' AS status, COUNT(*) AS n_rows FROM {VIEW[t]}"
            for t in STUDY_TABLES)),
        "export_table_csv": with_views(
            "SELECT CAST(event_id AS VARCHAR) AS event_id, participant_id, event_type, "
            "strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 <> 0 "
            "THEN '.' || lpad(CAST(microsecond(ts) % 1000000 AS VARCHAR), 6, '0') ELSE '' END "
            "AS ts FROM st_events"),
    }
    return out


def extra_sql(clean_times, id_lines: list[tuple[int, str]]) -> dict[str, str]:
    """The queries over variants of the fixture views."""
    swaps = ", ".join(f"CASE WHEN {c} = '{bad}' THEN '{good}' ELSE {c} END AS {c}" for c, bad, good in clean_times)
    clean = f"clean AS (SELECT {swaps} FROM st_participants)"
    durations = [clean, durations_cte("clean")]
    total = " + ".join(f"(SELECT COUNT(*) FROM {v})" for v in VIEW.values())
    hits = " UNION ALL ".join(f"SELECT participant_id, '{t}' AS t FROM {v} "
                              "WHERE participant_id IN (SELECT participant_id FROM erase)" for t, v in VIEW.items())
    counts = ", ".join(f"COUNT(*) FILTER (WHERE t = '{t}') AS rows_{t}" for t in STUDY_TABLES)
    return {
        "participants_duration_avg_strict_clean": with_views(
            REPORT_PARTS["participants_duration_avg_strict"][0], durations),
        "participants_duration_median_strict_clean": with_views(
            REPORT_PARTS["participants_duration_median_strict"][0], durations),
        "submissions_time_stats_large": with_views(
            "SELECT COUNT(b) AS n_with_time, " + rnd("SUM(b)", "COUNT(b)", 0) + " AS avg_ms, MIN(b) AS min_ms, "
            "MAX(b) AS max_ms FROM (SELECT time_taken_ms * 1000000 + 1700000000001 AS b FROM st_submissions)"),
        "export_manifest": with_views(
            f"SELECT 4 AS tables_succeeded, 4 AS tables_total, {total} AS total_rows"),
        "export_table_csv_blanks": with_views(
            "SELECT CAST(event_id AS VARCHAR) AS event_id, '  ' || participant_id || chr(9) AS participant_id, "
            "event_type || ' ' || chr(10) || ' \"x\" ' AS event_type FROM st_events"),
        "erase_batch_detail": with_views(
            f"SELECT participant_id, {counts}, COUNT(*) AS total_rows FROM ({hits}) GROUP BY 1",
            [_ids_values(id_lines), ERASE_CTE]),
        "section_report_submissions": f"SELECT * FROM ({report_long_sql()}) WHERE section = 'submissions'",
    }


def report_long_sql() -> str:
    """R-2 in SQL: every report unpivoted, one UNION ALL branch per metric."""
    from cohortlens.plans.reports import REPORT_SHAPES, TITLES, section_of
    branches = []
    for name, (keys, metrics) in REPORT_SHAPES.items():
        k = [f"CAST(r.{c} AS VARCHAR)" for c in keys] + ["CAST(NULL AS VARCHAR)"] * (2 - len(keys))
        for m in metrics:
            branches.append(
                f"SELECT '{section_of(name)}' AS section, '{name}' AS report, "
                f"'{TITLES[name]}' AS title, {k[0]} AS key_1, {k[1]} AS key_2, "
                f"'{m}' AS metric, CAST(r.{m} AS DOUBLE) AS value FROM ({REPORT_SQL[name]}) r")
    return "\nUNION ALL\n".join(branches)
