"""Rates over a three-valued flag, and simple numeric summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.exprs import with_ratios
from cohortlens.operators.means import finished, sums


def rate(df: DataFrame, flag: Column, *, total: str = "total_rows", hits: str = "hits",
         percent: str = "rate_percent", digits: int = 2) -> DataFrame:
    """Share of rows whose ``flag`` is TRUE, in percent.

    The denominator counts every row, unknown (NULL) flags included; an empty
    input gives ``total=0, hits=0, percent=NULL``. One global aggregate:
    partial counts per task, one merge.
    """
    counted = df.agg(F.count(F.lit(1)).alias(total),
                     F.count_if(F.coalesce(flag, F.lit(False))).alias(hits))
    return with_ratios(counted, {percent: (f"100BD * `{hits}`", f"`{total}`")}, digits)


def numeric_stats(df: DataFrame, value: str, *, n: str = "n", avg: str = "avg",
                  min_: str = "min", max_: str = "max", avg_digits: int = 0) -> DataFrame:
    """Non-NULL count, rounded mean, minimum and maximum of one column."""
    out = df.agg(F.count(value).alias(n), *sums(df, [value]), F.min(value).alias(min_), F.max(value).alias(max_))
    return finished(out, df, {value: avg}, avg_digits).select(n, avg, min_, max_)

