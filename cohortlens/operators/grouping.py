"""Several groupings in one scan (GROUPING SETS).

The source system runs one full scan per count or per mean table. Here all
groupings of one table go through a single scan: rows are first reduced to
partial sums at the finest grain (all dimensions together), and Spark's
``Expand`` then copies each of those few rows once per grouping set before
the roll-up aggregate.
Labels are coalesced *before* grouping, so a NULL in the output always means
"grouped out" and never a NULL label; ``grouping_set`` names the set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.exprs import label
from cohortlens.operators.means import finished, merged, partial_sums, sum_columns, sums
from cohortlens.schema import ID_COLUMN, NULL_LABEL

TOTAL_SET = "total"


def grouping_set_name(dims: Sequence[str]) -> Column:
    """Comma-joined names of the columns grouped on; ``total`` for ()."""
    name = F.concat_ws(",", *[F.when(F.grouping(d) == 0, F.lit(d)) for d in dims])
    return F.when(name == "", F.lit(TOTAL_SET)).otherwise(name)


def _dims_in(sets: Sequence[Sequence[str]]) -> list[str]:
    dims: list[str] = []
    for s in sets:
        for d in s:
            if d not in dims:
                dims.append(d)
    return dims


def counts_onepass(df: DataFrame, sets: Sequence[Sequence[str]], *,
                   null_label: str = NULL_LABEL, n: str = "n") -> DataFrame:
    """Row counts for every grouping set in ``sets`` from one scan.

    Rows are first counted at the finest grain (all dimensions together),
    then the grouping sets roll those counts up, so ``Expand`` copies the
    few finest-grain rows instead of every input row.
    """
    dims = _dims_in(sets)
    fine = (df.select(*[label(d, null_label).alias(d) for d in dims])
            .groupBy(*dims).agg(F.count(F.lit(1)).alias("__rows")))
    return _roll_up(fine, sets, dims, [F.sum("__rows").alias(n)], n)


def stats_onepass(df: DataFrame, dim: str, flag: Column, value: str, *,
                  null_label: str = NULL_LABEL, digits: int = 0) -> DataFrame:
    """Figures per label of ``dim`` and in total from one scan.

    ``grouping_set, <dim>, n, hits, n_values, avg, min, max``: rows, rows whose flag is TRUE, and the
    non-NULL count, rounded mean, minimum and maximum of ``value``.
    """
    fine = df.groupBy(label(dim, null_label).alias(dim)).agg(
        F.count(F.lit(1)).alias("__rows"), F.count_if(F.coalesce(flag, F.lit(False))).alias("__hits"),
        *sums(df, [value]), F.min(value).alias("__min"), F.max(value).alias("__max"))
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    out = _roll_up(fine, [(), (dim,)], [dim], [
        F.sum("__rows").alias("n"), whole("__hits").alias("hits"), whole(f"__cnt_{value}").alias("n_values"),
        *merged(df, [value]), F.min("__min").alias("min"), F.max("__max").alias("max")], "n")
    return finished(out, df, {value: "avg"}, digits).select("grouping_set", dim, "n", "hits", "n_values", "avg", "min", "max")


def _roll_up(fine: DataFrame, sets: Sequence[Sequence[str]], dims: list[str],
             aggs: list[Column], n: str) -> DataFrame:
    """GROUPING SETS over the finest-grain rows.

    The empty set () is a global aggregate, so that it yields its row even
    when the input is empty (as SQL's grand total does); the other sets go
    through one ``groupingSets``. Both read the same finest-grain aggregate,
    whose shuffle Spark computes once and reuses.
    """
    keyed = [s for s in sets if s]
    parts = []
    if len(keyed) < len(sets):
        total = fine.agg(*aggs)
        parts.append(total.select(F.lit(TOTAL_SET).alias("grouping_set"),
                                  *[F.lit(None).cast("string").alias(d) for d in dims],
                                  F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n),
                                  *[c for c in total.columns if c != n]))
    if keyed:
        out = fine.groupingSets([[F.col(d) for d in s] for s in keyed], *dims).agg(
            grouping_set_name(dims).alias("grouping_set"), *aggs)
        parts.append(out.select("grouping_set", *dims, *[c for c in out.columns
                                                         if c not in dims and c != "grouping_set"]))
    result = parts[0]
    for p in parts[1:]:
        result = result.union(p)
    return result


def means_onepass(facts: DataFrame, lookup: DataFrame, sets: Sequence[Sequence[str]],
                  values: Sequence[str], *, join_key: str = ID_COLUMN,
                  fact_dims: Sequence[str] | None = None,
                  null_label: str = NULL_LABEL, n: str = "n", digits: int = 2) -> DataFrame:
    """Row counts and rounded means for every grouping set, one scan, one join.

    ``fact_dims`` are the dimensions taken from ``facts`` (default: those
    present in it); the others come from ``lookup`` via
    ``facts LEFT JOIN lookup USING (join_key)``. Facts are pre-aggregated per
    (join key, own dimensions), so a hot key is collapsed before any shuffle and
    the join is one-to-one; the joined rows are reduced to partial sums at the
    finest grain of all dimensions before the grouping sets roll them up.
    """
    dims = _dims_in(sets)
    if fact_dims is None:
        fact_dims = [d for d in dims if d in facts.columns and d != join_key]
    own = [d for d in dims if d in fact_dims]
    looked_up = [d for d in dims if d not in own]
    right = lookup.select(join_key, *looked_up)
    names = [n for c in values for n in sum_columns(facts, c)]
    pre = partial_sums(
        facts.select(join_key, *[label(d, null_label).alias(d) for d in own], *values),
        [join_key, *own], values)
    joined = pre.join(right, join_key, "left")
    fine = (joined.select(*[label(d, null_label).alias(d) for d in dims], "__rows", *names)
            .groupBy(*dims).agg(F.sum("__rows").alias("__rows"), *merged(facts, values)))
    out = _roll_up(fine, sets, dims, [F.sum("__rows").alias(n), *merged(facts, values)], n)
    return finished(out, facts, {c: c for c in values}, digits).select("grouping_set", *dims, n, *values)
