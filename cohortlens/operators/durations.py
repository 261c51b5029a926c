"""Durations between two text timestamps, and an exact distributed median.

Text timestamps are candidates when both are present and look like
timestamps; a candidate that still does not parse is handled by ``mode``:

* ``"row"`` (default): the row is left out of the statistics;
* ``"strict"``: any unparsable candidate turns every statistic into NULL
  (the whole report is skipped, as the source system does).

The median is exact and distributed. Spark's ``percentile`` keeps a map of
every distinct value of a group and merges it in one task, which is not
acceptable for a global median over billions of rows. Here a mergeable quantile sketch
(KLL, one bounded state for each task) brackets the wanted rank in the first scan; the second scan
counts the values below the bracket exactly and the values inside it one by one. While the
bracket still holds too many rows, it is sketched anew and narrowed. A bracket that misses
the rank (sketches err with a small probability) is seen in the exact counts and widened.
Nothing is written, and what reaches the driver is bounded: a sketch, counts, and the distinct values
of the last bracket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.exprs import micros_between, parse_ts, ts_candidate

MODES = ("row", "strict")
US = "__us"
OK = "__castable"


def duration_frame(df: DataFrame, start: str = "started_at", end: str = "ended_at") -> DataFrame:
    """Candidate rows with ``__castable`` and ``__us`` (end - start, micros)."""
    cands = df.where(ts_candidate(start) & ts_candidate(end))
    s, e = parse_ts(start), parse_ts(end)
    return cands.select(
        (s.isNotNull() & e.isNotNull()).alias(OK),
        micros_between(s, e).alias(US),
    )


def _check_mode(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")


def cast_report(df: DataFrame, start: str = "started_at", end: str = "ended_at") -> DataFrame:
    """``n_candidates, n_castable, n_uncastable`` for the duration subset."""
    d = duration_frame(df, start, end)
    return d.agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.count_if(F.col(OK)).alias("n_castable"),
        F.count_if(~F.col(OK)).alias("n_uncastable"),
    )


def mean_of_integers(value: Column) -> Column:
    """Mean of a bigint column with an exact (decimal) sum: no overflow and no
    order-dependent rounding across partial sums."""
    return F.sum(value.cast("decimal(38,0)")).cast("double") / F.count(value)


def duration_stats(df: DataFrame, start: str = "started_at", end: str = "ended_at",
                   mode: str = "row") -> DataFrame:
    """``n_durations`` and unrounded ``avg_secs`` in one aggregate."""
    _check_mode(mode)
    d = duration_frame(df, start, end)
    n = F.count(F.col(US))
    avg_secs = mean_of_integers(F.col(US)) / F.lit(1e6)
    if mode == "row":
        return d.agg(n.alias("n_durations"), avg_secs.alias("avg_secs"))
    clean = F.count_if(~F.col(OK)) == 0
    return d.agg(F.when(clean, n).alias("n_durations"),
                 F.when(clean, avg_secs).alias("avg_secs"))


SKETCH_K = 4096
MOST_VALUES = 1 << 17  # distinct values of the last bracket that come to the driver


def _error(k: int) -> float:
    """Three times the share of all ranks by which a KLL sketch of size ``k`` errs with 99 % confidence."""
    return 3 * 2.3 / k ** 0.9


def _bracket(spark: SparkSession, sketch: bytes, n: int, ranks: list[int], slack: float,
             lo: int, hi: int) -> tuple[int, int]:
    """Values that enclose the 0-based ``ranks`` of ``n`` values, unless the sketch errs by more than ``slack``."""
    low, high = max(0.0, ranks[0] / n - slack), min(1.0, (ranks[-1] + 1) / n + slack)
    if high - low >= 1:
        return lo, hi
    cut = "kll_sketch_get_quantile_bigint(s, {}D)"
    a, b = spark.sql(f"SELECT {cut.format(low)}, {cut.format(high)} FROM (SELECT X'{bytes(sketch).hex()}' AS s)").first()
    return max(lo, min(a, b)), min(hi, max(a, b))


def _select(values: DataFrame, ranks: list[int], first: Row, k: int, most: int) -> list[int]:
    """The values at the 0-based ``ranks`` of the non-NULL ``__v``, from its first sketch."""
    spark, v = values.sparkSession, F.col("__v")
    slack, few = _error(k), False
    n, below, sketch, lo, hi = first["n"], 0, first["sketch"], first["lo"], first["hi"]
    while True:
        # few values are told apart as they are
        a, b = (lo, hi) if few or n <= most else _bracket(spark, sketch, n, [r - below for r in ranks], slack, lo, hi)
        if few or n <= most or a == b or n * 2 * slack + len(ranks) <= most:
            # all rows below the bracket as one, those inside by value
            counts = {r["v"]: r["c"] for r in values.where(v <= b).groupBy(F.when(v >= a, v).alias("v"))
                      .agg(F.count(F.lit(1)).alias("c")).collect()}
            seen, found = counts.pop(None, 0), []
            if seen <= ranks[0] and ranks[-1] < seen + sum(counts.values()):
                for value in sorted(counts):
                    found += [value] * sum(seen <= r < seen + counts[value] for r in ranks)
                    seen += counts[value]
                return found
            slack = 4 * slack
            continue
        # narrow: the bracket, or its half if the sketch can't tell more than the whole range
        cut = b if (a, b) != (lo, hi) else a + (b - a) // 2
        low, high = v.between(a, cut), (v > cut) & (v <= b)
        sketched = [F.expr(f"kll_sketch_agg_bigint(IF(__v BETWEEN CAST('{x}' AS BIGINT) AND CAST('{y}' AS BIGINT), __v, NULL), {k})") for x, y in
                    ((a, cut), (min(cut + 1, b), b))]
        row = values.agg(F.count_if(v < a).alias("below"), F.count_if(low).alias("n_low"), F.count_if(high).alias("n_high"),
                         F.min(F.when(low, v)).alias("a"), F.max(F.when(low, v)).alias("top"),
                         F.min(F.when(high, v)).alias("bottom"), F.max(F.when(high, v)).alias("b"),
                         F.approx_count_distinct(F.when(low | high, v)).alias("distinct"),
                         sketched[0].alias("low"), sketched[1].alias("high")).first()
        middle = row["below"] + row["n_low"]
        if not row["below"] <= ranks[0] <= ranks[-1] < middle + row["n_high"]:
            slack = 4 * slack  # the sketch has missed
            continue
        if ranks[0] < middle <= ranks[-1]:
            return [row["top"], row["bottom"]]
        slack, few = _error(k), 2 * row["distinct"] <= most  # ties: many rows of few values
        if ranks[0] < middle:
            below, n, sketch, lo, hi = row["below"], row["n_low"], row["low"], row["a"], row["top"]
        else:
            below, n, sketch, lo, hi = middle, row["n_high"], row["high"], row["bottom"], row["b"]


def exact_median(values: DataFrame, value: str, *, keep: Column | None = None, void_if: Column | None = None,
                 figures: list[Column] | None = None, k: int = SKETCH_K,
                 most: int = MOST_VALUES) -> tuple[Row, int | None]:
    """Exact median of an integral column as ``2 * median`` (an integer; None without values).

    ``keep`` filters the rows whose values count; ``void_if`` (strict policies) is counted over
    all rows in the first scan, and any match makes the median None. ``figures``, aggregates over
    all rows, are worked out in the first scan too and come back in the row.
    """
    v = F.col(value).cast("long")
    rows = values.withColumn("__v", v if keep is None else F.when(keep, v))
    none = F.lit(0).cast("bigint") if void_if is None else F.count_if(void_if)
    first = rows.agg(F.count("__v").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"), none.alias("void"),
                     F.expr(f"kll_sketch_agg_bigint(__v, {k})").alias("sketch"), *(figures or [])).first()
    if first["void"] or not first["n"]:
        return first, None
    ranks = sorted({(first["n"] - 1) // 2, first["n"] // 2})
    found = _select(rows.select("__v").where("__v IS NOT NULL"), ranks, first, k, most)
    return first, found[0] + found[-1]


def _seconds(spark: SparkSession, twice_median: int | None) -> DataFrame:
    """``median_secs``: from twice the median in microseconds, truncated toward zero."""
    twice = F.lit(None if twice_median is None else str(twice_median)).cast("decimal(20,0)")
    return (spark.range(0, 1, 1, 1).select(twice.alias("twice_median"))
            .selectExpr("CAST(twice_median div 2000000BD AS BIGINT) AS median_secs"))


def duration_median(df: DataFrame, start: str = "started_at", end: str = "ended_at",
                    mode: str = "row", *, method: str = "exact", accuracy: int = 10_000) -> DataFrame:
    """``median_secs``: median duration truncated to whole seconds.

    ``method="exact"`` (default) is the distributed exact median above;
    ``method="approx"`` is one ``percentile_approx`` aggregate (a bounded
    sketch per task, relative rank error about ``1/accuracy``) for when one
    pass matters more than exactness.
    """
    _check_mode(mode)
    if method not in ("exact", "approx"):
        raise ValueError(f"method must be 'exact' or 'approx', got {method!r}")
    d = duration_frame(df, start, end)
    strict = mode == "strict"
    if method == "approx":
        us = F.percentile_approx(F.col(US), F.lit(0.5), F.lit(accuracy))
        m = F.when(F.count_if(~F.col(OK)) == 0, us) if strict else us
        return d.agg(m.alias("__m")).select(F.expr("__m div 1000000L").alias("median_secs"))
    # strict: unparsable candidates are counted in the first scan
    _, twice = exact_median(d, US, keep=F.col(OK), void_if=~F.col(OK) if strict else None)
    return _seconds(df.sparkSession, twice)


def duration_overview(df: DataFrame, start: str = "started_at",
                      end: str = "ended_at") -> tuple[DataFrame, DataFrame]:
    """All duration figures (row mode) from the two scans of the median: two one-row frames.

    The first holds ``finished, n_candidates, n_castable, n_uncastable, n_durations, avg_secs``, the second
    ``median_secs``.
    """
    s, e = parse_ts(start), parse_ts(end)
    cand = ts_candidate(start) & ts_candidate(end)
    ok = cand & s.isNotNull() & e.isNotNull()
    rows = df.select((F.col(start).isNotNull() & F.col(end).isNotNull()).alias("__finished"),
                     cand.alias("__cand"), ok.alias(OK), F.when(ok, micros_between(s, e)).alias(US))
    kinds = {"avg_secs": "double"}
    figures = [
        F.count_if("__finished").alias("finished"), F.count_if("__cand").alias("n_candidates"),
        F.count_if(OK).alias("n_castable"), F.count_if(F.col("__cand") & ~F.col(OK)).alias("n_uncastable"),
        F.count(US).alias("n_durations"), (mean_of_integers(F.col(US)) / F.lit(1e6)).alias("avg_secs")]
    names = ["finished", "n_candidates", "n_castable", "n_uncastable", "n_durations", "avg_secs"]
    found, twice = exact_median(rows, US, figures=figures)
    frame = df.sparkSession.range(0, 1, 1, 1).select(
        *[F.lit(found[c]).cast(kinds.get(c, "bigint")).alias(c) for c in names])
    return frame, _seconds(df.sparkSession, twice)
