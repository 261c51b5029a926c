"""Counting operators: totals, labelled counts, cross-tabs and top-k.

Every count is a partial (map-side) aggregate followed by a final one, so a
hot label or a NULL key that holds a third of the rows reaches the shuffle as
one row per map task, never as a skewed partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.exprs import label
from cohortlens.schema import NULL_LABEL


def count_rows(df: DataFrame, name: str = "n") -> DataFrame:
    """``COUNT(*)`` as a one-row frame."""
    return df.agg(F.count(F.lit(1)).alias(name))


def count_where_not_null(df: DataFrame, columns: Sequence[str], name: str = "n") -> DataFrame:
    """Rows where every listed column is not NULL (filters reach the scan)."""
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(c).isNotNull()
    return count_rows(df.where(cond), name)


def count_by(df: DataFrame, key: str, *, null_label: str | None = NULL_LABEL,
             n: str = "n", ordered: bool = True) -> DataFrame:
    """Rows per value of ``key``; order ``n`` desc, then label (NULL last).

    ``null_label=None`` keeps NULL as its own group instead of labelling it.
    """
    key_col = label(key, null_label) if null_label is not None else F.col(key)
    out = df.groupBy(key_col.alias(key)).agg(F.count(F.lit(1)).alias(n))
    if ordered:
        out = out.orderBy(F.col(n).desc(), F.col(key).asc_nulls_last())
    return out


def count_by_pair(df: DataFrame, key1: str, key2: str, *,
                  null_label: str | None = NULL_LABEL, n: str = "n",
                  ordered: bool = True) -> DataFrame:
    """Long-form cross-tab ``(key1, key2, n)`` ordered by both labels."""
    k1 = label(key1, null_label) if null_label is not None else F.col(key1)
    k2 = label(key2, null_label) if null_label is not None else F.col(key2)
    out = df.groupBy(k1.alias(key1), k2.alias(key2)).agg(F.count(F.lit(1)).alias(n))
    if ordered:
        out = out.orderBy(F.col(key1).asc_nulls_last(), F.col(key2).asc_nulls_last())
    return out


def top_by_count(df: DataFrame, key: str, k: int = 50, n: str = "n") -> DataFrame:
    """The ``k`` most frequent values of ``key`` (ties by key, NULL last).

    The limit is the feature here (a top-k report). Spark plans it as a
    per-partition top-k plus one merge of at most ``k`` rows per partition
    (``TakeOrderedAndProject``), never a full sort.
    """
    return top_counts(df.groupBy(key).agg(F.count(F.lit(1)).alias(n)), key, k, n)


def top_counts(counts: DataFrame, key: str, k: int = 50, n: str = "n") -> DataFrame:
    """The ``k`` rows of largest ``n`` (ties by key, NULL last)."""
    return counts.orderBy(F.col(n).desc(), F.col(key).asc_nulls_last()).limit(k)
