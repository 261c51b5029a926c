"""Study tables: names, required columns and checks.

The study database has four tables. Their columns are only known from the
reports that read them, so each table declares the columns the operators
need; any further columns pass through untouched (exports keep them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values that must equal the reference's: table names (also the
# allow-list for scan, export and clear), the eight feedback ratings in
# report order, the status words that count as a pass, and the label
# printed for a NULL group.
STUDY_TABLES = ("participants", "code_submissions", "feedback", "events")
RATINGS = (
    "length",
    "jargon",
    "sentence_structure",
    "vocabulary",
    "intrinsic_load",
    "extraneous_load",
    "germane_load",
    "authoritativeness",
)
PASS_WORDS = ("pass", "passed", "success", "ok")
NULL_LABEL = "(null)"

# Erasure works children first, as foreign keys demand in the source system.
ERASE_ORDER = ("events", "feedback", "code_submissions", "participants")
ID_COLUMN = "participant_id"

_TEXT = (T.StringType,)
_NUMBER = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)

REQUIRED: dict[str, dict[str, tuple]] = {
    "participants": {
        "participant_id": _TEXT,
        "skill_level": _TEXT,
        "intervention_type": _TEXT,
        "snippet_id": _TEXT,
        "started_at": _TEXT,
        "ended_at": _TEXT,
    },
    "code_submissions": {
        "participant_id": _TEXT,
        "status": _TEXT,
        "tests_total": _INTEGRAL,
        "tests_passed": _INTEGRAL,
        "time_taken_ms": _NUMBER,
    },
    "feedback": {"participant_id": _TEXT, "snippet_id": _TEXT,
                 **{name: _NUMBER for name in RATINGS}},
    "events": {"participant_id": _TEXT, "event_type": _TEXT},
}


class StudyError(ValueError):
    """A refused request: unknown table, wrong confirmation, bad input."""


def check_table_name(name: str) -> str:
    if name not in STUDY_TABLES:
        raise StudyError(
            f"table {name!r} is not a study table; allowed: {', '.join(STUDY_TABLES)}")
    return name


def validate(df: DataFrame, table: str) -> DataFrame:
    """Fail early when a required column is missing or has the wrong kind."""
    check_table_name(table)
    fields = {f.name: f.dataType for f in df.schema.fields}
    problems = []
    for column, kinds in REQUIRED[table].items():
        if column not in fields:
            problems.append(f"missing column {column!r}")
        elif not isinstance(fields[column], kinds):
            problems.append(f"column {column!r} has type {fields[column].simpleString()}")
    if problems:
        raise StudyError(f"table {table!r}: " + "; ".join(problems))
    return df
