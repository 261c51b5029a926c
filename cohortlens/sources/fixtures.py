"""Study tables derived from the driver's generated tables.

The study's own database is not available, so the four study tables are
derived from the generated tables by plain column expressions that add
NULLs, orphans and malformed timestamp text. Each expression is text that
both Spark SQL and DuckDB run unchanged, so the Spark side (``selectExpr``)
and the SQL oracle (a ``WITH`` list) read identical study data. Every view
keeps every row of its source table.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from cohortlens.sources.tables import StudyTables

_DAY = "LPAD(CAST(1 + c_custkey % 28 AS STRING), 2, '0')"

# view name -> (driver table, [(column, expression), ...])
FIXTURE_VIEWS: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "st_participants": ("customer", [
        ("participant_id", "CAST(c_custkey AS STRING)"),
        ("skill_level", "NULLIF(LOWER(c_mktsegment), 'household')"),
        ("intervention_type",
         "CASE c_custkey % 4 WHEN 0 THEN 'arm_a' WHEN 1 THEN 'arm_b' WHEN 2 THEN 'arm_c' END"),
        ("snippet_id",
         "CASE WHEN c_nationkey < 20 THEN CONCAT('snip_', CAST(c_nationkey % 5 AS STRING)) END"),
        ("started_at",
         "CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 23 = 0 THEN 'unknown' "
         f"ELSE CONCAT('2024-01-', {_DAY}, 'T10:00:00Z') END"),
        ("ended_at",
         "CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN 'not-a-time' "
         f"WHEN c_custkey % 29 = 0 THEN CONCAT('2024-01-', {_DAY}, ' 12:30:00.250000+02:00') "
         f"ELSE CONCAT('2024-01-', {_DAY}, 'T10:', "
         "LPAD(CAST(5 + c_custkey % 50 AS STRING), 2, '0'), ':', "
         "LPAD(CAST(c_custkey % 60 AS STRING), 2, '0'), 'Z') END"),
    ]),
    "st_submissions": ("orders", [
        ("submission_id", "o_orderkey"),
        ("participant_id", "CAST(o_custkey AS STRING)"),
        ("status",
         "CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'Failed' "
         "WHEN o_orderstatus = 'O' THEN 'PASSED' ELSE 'ok' END"),
        ("tests_total", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 5 AS INT) END"),
        ("tests_passed",
         "CASE WHEN o_orderkey % 7 = 0 THEN NULL "
         "WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' "
         "THEN CAST(o_orderkey % 5 AS INT) ELSE 0 END"),
        ("time_taken_ms",
         "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(FLOOR(o_totalprice) AS BIGINT) END"),
    ]),
    "st_feedback": ("lineitem", [
        ("participant_id", "CAST(l_partkey AS STRING)"),
        ("snippet_id",
         "CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE CONCAT('snip_', CAST(l_suppkey % 5 AS STRING)) END"),
        ("length", "CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE CAST(1 + l_orderkey % 5 AS INT) END"),
        ("jargon", "CAST(1 + l_partkey % 5 AS INT)"),
        ("sentence_structure", "CAST(1 + l_suppkey % 5 AS INT)"),
        ("vocabulary", "CAST(1 + l_linenumber % 5 AS INT)"),
        ("intrinsic_load", "CAST(1 + (l_orderkey + l_linenumber) % 9 AS INT)"),
        ("extraneous_load", "CAST(1 + (l_partkey + l_linenumber) % 9 AS INT)"),
        ("germane_load", "CAST(1 + (l_suppkey + l_linenumber) % 9 AS INT)"),
        ("authoritativeness", "CAST(1 + (l_orderkey + l_partkey) % 5 AS INT)"),
    ]),
    "st_events": ("events", [
        ("event_id", "event_id"),
        ("participant_id", "CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(user_id AS STRING) END"),
        ("event_type", "CASE WHEN event_id % 31 = 0 THEN NULL ELSE event_type END"),
        ("ts", "ts"),
    ]),
}

# study table -> fixture view
VIEW_OF = {
    "participants": "st_participants",
    "code_submissions": "st_submissions",
    "feedback": "st_feedback",
    "events": "st_events",
}


def view_select_sql(view: str) -> str:
    source, columns = FIXTURE_VIEWS[view]
    exprs = ", ".join(f"{expr} AS {name}" for name, expr in columns)
    return f"SELECT {exprs} FROM {source}"


def oracle_with_clause(views: list[str] | None = None) -> str:
    """``WITH st_participants AS (...), ...`` over the driver's tables."""
    names = views or list(FIXTURE_VIEWS)
    return "WITH " + ",\n".join(f"{v} AS ({view_select_sql(v)})" for v in names)


# Views over the read-only driver tables are built once per application, so
# file listing, footer reads and analysis happen once per table, as for a user
# who holds the tables across many reports. They are lazy plans, not data.
_VIEWS: dict[tuple[str, str, str], DataFrame] = {}


def fixture_view(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir), view)
    if key not in _VIEWS:
        source, columns = FIXTURE_VIEWS[view]
        base = spark.read.parquet(os.path.join(sf_dir, f"{source}.parquet"))
        _VIEWS[key] = base.selectExpr(*[f"{expr} AS {name}" for name, expr in columns])
    return _VIEWS[key]


def fixture_tables(spark: SparkSession, sf_dir: str) -> StudyTables:
    """The four study tables as lazy DataFrames over ``sf_dir``."""
    return StudyTables(**{t: fixture_view(spark, sf_dir, v) for t, v in VIEW_OF.items()})
