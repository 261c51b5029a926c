"""Participant id lists: a text file with one id per line.

Ids are stripped of surrounding whitespace, blank lines are dropped and
duplicates are kept. Each id keeps its physical line number (1-based, per
file), numbered without pulling the file through one task: lines are read
split by split in parallel, each split's line count and first row id are
aggregated (one row per input split), prefix sums over those few rows give
each split's first line number, and that small table is joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from cohortlens.functions.exprs import strip_ws
from cohortlens.schema import ID_COLUMN, StudyError


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, value)`` for every physical line of the text file(s)."""
    try:
        raw = spark.read.text(path)
    except AnalysisException as exc:
        raise StudyError(f"id file {path!r} does not exist") from exc
    lines = raw.select(
        F.col("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row_id"),
    )
    splits = lines.groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = splits.select(
        "file", "block", "first_row",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines_before"))
    # One row per input split: small, and measured at run time by AQE, which
    # turns the join into a broadcast when the shuffled side is small.
    return lines.join(offsets, ["file", "block"]).select(
        "file",
        (F.col("lines_before") + F.col("row_id") - F.col("first_row") + 1).alias("line_no"),
        "value",
    )


def scan_id_list(spark: SparkSession, path: str, *, require_ids: bool = True,
                 line_numbers: bool = True) -> DataFrame:
    """``(line_no, participant_id)``: stripped, non-blank ids in file order.

    ``line_numbers=False`` gives ``(participant_id)`` only, a plain parallel
    text scan, for uses that need the set of ids but not their order.
    A missing file, or (with ``require_ids``) a file without any id, is
    refused with :class:`StudyError`.
    """
    if line_numbers:
        lines = numbered_lines(spark, path)
        ids = lines.select("line_no", strip_ws("value").alias(ID_COLUMN))
    else:
        try:
            ids = spark.read.text(path).select(strip_ws("value").alias(ID_COLUMN))
        except AnalysisException as exc:
            raise StudyError(f"id file {path!r} does not exist") from exc
    ids = ids.where(F.col(ID_COLUMN) != "")
    if require_ids and ids.isEmpty():
        raise StudyError(f"no participant ids found in {path!r}")
    return ids


def ids_frame(spark: SparkSession, ids: list[str]) -> DataFrame:
    """``(line_no, participant_id)`` from ids given in code (a single erase)."""
    rows = [(i + 1, v) for i, v in enumerate(ids)]
    return spark.createDataFrame(rows, f"line_no bigint, {ID_COLUMN} string")
