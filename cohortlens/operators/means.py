"""Rounded means of rating columns, overall and per group.

Grouping by a label that lives in another table (feedback rated by the
participant's arm) is a LEFT JOIN on ``participant_id`` followed by a
group-by. There is one plan for every size: the fact side is first reduced to
one row per join key (exact sum and non-null count of every rating, plus the
row count) by a partial aggregate, which collapses hot keys inside each map
task before any shuffle; the join is then one-to-one per key, and the final
aggregate is over a handful of labels. Whether the label table is broadcast is
left to Spark's byte threshold and adaptive execution.

Sums are exact: integers are added as integers, 64-bit columns as two 32-bit limbs (both plain bigint
sums; over 2^31 rows of one group at the ends of the type are an overflow error, never a wrong
mean), decimals in their units. Limbs are put together and divided once, after the aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.exprs import label, with_ratios
from cohortlens.schema import ID_COLUMN, NULL_LABEL


def sum_columns(df: DataFrame, c: str) -> dict[str, str]:
    """The exact sums and the non-NULL count of a column: names, and the SQL that is added up (NULL: counted)."""
    kind, q = df.schema[c].dataType, f"`{c}`"
    count = {f"__cnt_{c}": f"CAST({q} IS NOT NULL AS BIGINT)"}
    if isinstance(kind, T.LongType):
        # signed low limb, and the high limb with the carry that its sign takes
        return {f"__high_{c}": f"shiftright({q}, 32) + shiftrightunsigned(shiftleft({q}, 32), 63)",
                f"__sum_{c}": f"shiftright(shiftleft({q}, 32), 32)", **count}
    if isinstance(kind, T.IntegralType):
        return {f"__sum_{c}": q, **count}
    if isinstance(kind, T.DecimalType):
        return {f"__sum_{c}": f"CAST({q} * {10 ** kind.scale}BD AS DECIMAL(38,0))", **count}
    return {f"__sum_{c}": f"CAST({q} AS DOUBLE)", **count}


def sums(df: DataFrame, values: Sequence[str]) -> list[Column]:
    """Aggregates of the rows of ``df`` that ``merged`` and ``finished`` take up."""
    return [F.expr(f"SUM({e}) AS `{n}`") for c in values for n, e in sum_columns(df, c).items()]


def merged(df: DataFrame, values: Sequence[str]) -> list[Column]:
    """Aggregates of partial sums (``df``: the table whose columns were added up)."""
    return [F.expr(f"SUM(`{n}`) AS `{n}`") for c in values for n in sum_columns(df, c)]


def finished(summed: DataFrame, df: DataFrame, values: dict[str, str], digits: int) -> DataFrame:
    """``summed`` plus the rounded means of the columns ``values`` of ``df``, under the names they map to."""
    plain, exact = [], {}
    for c, name in values.items():
        kind = df.schema[c].dataType
        n = f"COALESCE(`__cnt_{c}`, 0)"
        if isinstance(kind, T.LongType):
            exact[name] = f"CAST(`__high_{c}` AS DECIMAL(38,0)) * 4294967296BD + `__sum_{c}`", n
        elif isinstance(kind, T.IntegralType):
            exact[name] = f"`__sum_{c}`", n
        elif isinstance(kind, T.DecimalType):
            exact[name] = f"`__sum_{c}`", f"CAST({n} AS DECIMAL(20,0)) * {10 ** kind.scale}BD"
        else:
            plain.append(f"ROUND(try_divide(`__sum_{c}`, {n}), {digits}) AS `{name}`")
    out = with_ratios(summed, exact, digits) if exact else summed
    return out.selectExpr("*", *plain) if plain else out


def partial_sums(df: DataFrame, keys: Sequence[str], values: Sequence[str],
                 rows: str = "__rows") -> DataFrame:
    """Per key: row count, and sums and non-null count of every value column."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(rows), *sums(df, values))


def means(df: DataFrame, values: Sequence[str], *, prefix: str = "avg_",
          digits: int = 2) -> DataFrame:
    """Overall rounded means, one column ``<prefix><value>`` each."""
    names = {c: f"{prefix}{c}" for c in values}
    return finished(df.agg(*sums(df, values)), df, names, digits).select(*names.values())


def means_by(df: DataFrame, key: str, values: Sequence[str], *,
             lookup: DataFrame | None = None, join_key: str = ID_COLUMN,
             null_label: str = NULL_LABEL, n: str = "n", digits: int = 2,
             ordered: bool = True) -> DataFrame:
    """Row count and rounded means of ``values`` per label of ``key``.

    Without ``lookup`` the key is a column of ``df``. With ``lookup`` the key
    comes from ``lookup`` through ``df LEFT JOIN lookup USING (join_key)``;
    fact rows without a match and lookup rows with a NULL key both land in
    the ``(null)`` group. ``lookup`` must hold each join key at most once.
    """
    if lookup is None:
        out = df.groupBy(label(key, null_label).alias(key)).agg(F.count(F.lit(1)).alias(n), *sums(df, values))
    else:
        joined = partial_sums(df, [join_key], values).join(lookup.select(join_key, key), join_key, "left")
        out = joined.groupBy(label(key, null_label).alias(key)).agg(
            F.sum("__rows").alias(n), *merged(df, values))
    out = finished(out, df, {c: c for c in values}, digits).select(key, n, *values)
    if ordered:
        out = out.orderBy(F.col(n).desc(), F.col(key).asc_nulls_last())
    return out
