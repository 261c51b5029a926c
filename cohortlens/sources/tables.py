"""Reading study tables (whole-table scans behind an allow-list)."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.schema import ID_COLUMN, STUDY_TABLES, StudyError, check_table_name, validate
from cohortlens.sources import jdbc, widening


@dataclass(frozen=True)
class StudyTables:
    """The four study tables as lazy DataFrames."""

    participants: DataFrame
    code_submissions: DataFrame
    feedback: DataFrame
    events: DataFrame

    def get(self, name: str) -> DataFrame:
        return getattr(self, check_table_name(name))

    def items(self) -> Iterator[tuple[str, DataFrame]]:
        for name in STUDY_TABLES:
            yield name, getattr(self, name)

    def with_table(self, name: str, df: DataFrame) -> StudyTables:
        return replace(self, **{check_table_name(name): df})

    def validated(self, check_keys: bool = False) -> StudyTables:
        """Check required columns; with ``check_keys`` also that every
        participant id is present and unique (one aggregate job)."""
        for name, df in self.items():
            validate(df, name)
        if check_keys:
            check_unique_ids(self.participants)
        return self


def check_unique_ids(participants: DataFrame, key: str = ID_COLUMN) -> None:
    """Raise when a participant id is NULL or appears more than once.

    Joins on the id assume one row per participant; a repeated id would
    silently multiply rows, so it is refused instead of deduplicated. One
    partial+final aggregate; only up to five offending ids reach the driver.
    """
    bad = (participants.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
           .where(F.col(key).isNull() | (F.col("n") > 1)).limit(5).collect())
    if bad:
        shown = ", ".join(f"{r[key]!r} x{r['n']}" for r in bad)
        raise StudyError(f"participant ids must be unique and not NULL; found {shown}")


def scan_table(spark: SparkSession, name: str, path: str | None = None,
               fmt: str = "parquet", options: dict[str, str] | None = None) -> DataFrame:
    """Whole-table scan of an allow-listed study table.

    ``fmt``/``options`` go straight to ``spark.read``; a JDBC source is the
    same call with ``fmt='jdbc'`` and ``options={'url': ..., 'dbtable': name}``, which gives a parallel
    scan (``jdbc.scan``). Parquet files may differ in the width of their columns (``widening``).
    Required columns are checked before any scan runs; extra columns pass.
    """
    check_table_name(name)
    if fmt == "jdbc":
        return validate(jdbc.scan(spark, dict(options or {})), name)
    if fmt == "parquet" and path is not None:
        return validate(widening.read_table(spark, path, options), name)
    reader = spark.read.format(fmt).options(**(options or {}))
    df = reader.load(path) if path is not None else reader.load()
    return validate(df, name)


def table_options(name: str, fmt: str, options: dict[str, str] | None = None,
                  per_table: dict[str, dict[str, str]] | None = None) -> dict[str, str]:
    """Reader options of one table: the common ones, the table's own over them, and for JDBC
    its name as ``dbtable``."""
    out = dict(options or {})
    if fmt == "jdbc":
        out["dbtable"] = name
    out.update((per_table or {}).get(name, {}))
    return out


def load_study(spark: SparkSession, root: str | None, fmt: str = "parquet",
               options: dict[str, str] | None = None, check_keys: bool = True,
               per_table: dict[str, dict[str, str]] | None = None) -> StudyTables:
    """Load the four study tables: ``root/<table>``, or for JDBC the tables of that name."""
    return StudyTables(**{
        t: scan_table(spark, t, None if fmt == "jdbc" else os.path.join(root, t), fmt,
                      table_options(t, fmt, options, per_table)) for t in STUDY_TABLES
    }).validated(check_keys)
