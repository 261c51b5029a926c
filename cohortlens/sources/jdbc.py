"""Parallel scans of database tables.

``dbtable`` alone reads in parallel: the database cuts a key column into runs of equal row counts (``NTILE``),
only the runs' first keys come back, and every run becomes a partition with a predicate of its own, rows
without a key one more. The predicates compare keys as the database orders them, so whatever
its collation, each row falls into exactly one. Known bounds (``partitionColumn`` and the like) or a ``query`` go to
Spark's reader as they are. Each partition is a query of its own: the database gives no common snapshot to them.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from cohortlens.schema import ID_COLUMN, StudyError

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def split_query(table: str, key: str, parts: int) -> str:
    """SQL that gives ``(run, first_key)`` of each of ``parts`` runs of rows, numbered in key order."""
    _checked(key)
    return (f"SELECT run, MIN(k) AS first_key FROM (SELECT {key} AS k, NTILE({int(parts)}) OVER (ORDER BY {key}) AS run "
            f"FROM {table} WHERE {key} IS NOT NULL) AS keyed GROUP BY run")


def split_predicates(key: str, first_keys: Sequence) -> list[str]:
    """Predicates that put every row into exactly one partition: below the second run, between
    firsts, from the last on, and rows without a key. A key that starts several runs counts once."""
    _checked(key)
    points: list = []
    for k in first_keys[1:]:
        if k != first_keys[0] and (not points or k != points[-1]):
            points.append(k)
    cuts = [literal(p) for p in points]
    if not cuts:
        return [f"{key} IS NOT NULL", f"{key} IS NULL"]
    between = [f"{key} >= {a} AND {key} < {b}" for a, b in zip(cuts, cuts[1:], strict=False)]
    return [f"{key} < {cuts[0]}", *between, f"{key} >= {cuts[-1]}", f"{key} IS NULL"]


def literal(value) -> str:
    """A key value as an SQL literal."""
    if isinstance(value, bool) or value is None:
        raise StudyError(f"can't split a table by {value!r}")
    if isinstance(value, (int, Decimal)):
        return str(value)
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, date):
        return f"DATE '{value.isoformat()}'"
    return "'" + str(value).replace("'", "''") + "'"


def scan(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """A table as a parallel scan. ``splitColumn`` (default: the participant id) is the key, ``numPartitions``
    (default: the cluster's cores) the number of runs; other options are Spark's own."""
    opts = dict(options)
    if "query" in opts or "partitionColumn" in opts:
        return spark.read.format("jdbc").options(**opts).load()
    key, table, url = opts.pop("splitColumn", ID_COLUMN), opts.pop("dbtable"), opts.pop("url")
    parts = int(opts.pop("numPartitions", spark.sparkContext.defaultParallelism))
    if parts <= 1:
        return spark.read.format("jdbc").options(**opts, url=url, dbtable=table).load()
    runs = spark.read.format("jdbc").options(**opts, url=url, query=split_query(table, key, parts)).load()
    firsts = [r[1] for r in sorted(runs.collect(), key=lambda r: r[0])]  # one row for each run
    return spark.read.jdbc(url, table, predicates=split_predicates(key, firsts), properties=opts)


def _checked(key: str) -> None:
    if not _NAME.fullmatch(key):
        raise StudyError(f"{key!r} is no plain column name")
