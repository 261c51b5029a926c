"""Column expressions shared by the study operators.

All are built-in Spark expressions, so they stay inside whole-stage codegen;
none needs a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.schema import NULL_LABEL, PASS_WORDS

ColumnLike = Column | str

# A timestamp text is a candidate when it holds one of these characters; it is
# parsed only in one of two ISO forms: extended (date, or date and time to the minute
# at least) and basic (20240103T101010, with fraction and offset if any).
TS_CANDIDATE_PATTERN = r"[:+ZT-]"
TS_EXTENDED_PATTERN = (r"^\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
                       r"([T ][0-9]{1,2}:[0-9]{1,2}(:[0-9]{1,2}(\.[0-9]{1,6})?)?\s*(Z|UTC|[+-][0-9]{2}(:?[0-9]{2})?)?)?\s*$")
TS_BASIC_PATTERN = (r"^\s*([0-9]{4})([0-9]{2})([0-9]{2})T([0-9]{2})([0-9]{2})([0-9]{2})(\.[0-9]{1,6})?"
                    r"(Z|[+-][0-9]{2}(:?[0-9]{2})?)?\s*$")
TS_BASIC_AS_EXTENDED = (r"\1-\2-\3T\4:\5:\6\7\8")  # back references by backslash
# seconds are added where an offset follows the minute; offsets without a colon, or without minutes
TS_OFFSETS = ((r"^(\s*[0-9-]+[T ][0-9]{1,2}:[0-9]{1,2})(\s*[ZU+-])", r"\1:00\2"),
              (r"(:[0-9.]+\s*[+-][0-9]{2})([0-9]{2})\s*$", r"\1:\2"),
              (r"(:[0-9.]+\s*[+-][0-9]{2})\s*$", r"\1:00"))

# What Unicode counts as blank and str.strip() takes off
BLANK_CLASS = (r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}"
               r"\x{3000}]")


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def label(c: ColumnLike, null_label: str = NULL_LABEL) -> Column:
    """Group label: NULL shown as ``(null)``."""
    return F.coalesce(col(c), F.lit(null_label))


def round_half_up(c: ColumnLike, digits: int) -> Column:
    """Round a double half away from zero by its decimal text (1.005 -> 1.01); any size."""
    return F.round(col(c).cast("double"), digits)


def with_ratios(df: DataFrame, ratios: dict[str, tuple[str, str]], digits: int) -> DataFrame:
    """``df`` plus columns ``name = total / n``, rounded half away from zero; NULL when ``n`` is 0.

    ``ratios`` maps a name to two SQL expressions, exact whole numbers (``n`` not negative). All steps are
    integer arithmetic in decimals, so there is no double rounding; the result is the double
    nearest to the rounded quotient. Every step is a column of a projection of its own, named once: the
    expressions stay short however many ratios there are.
    """
    scale, kept = 10 ** digits, [f"`{c}`" for c in df.columns]
    unit = "0." + "1".rjust(digits, "0") + "BD" if digits else "1BD"
    whole = [e for i, (t, n) in enumerate(ratios.values()) for e in (
        f"CAST({t} AS DECIMAL(38,0)) AS __t{i}", f"CAST(NULLIF({n}, 0) AS DECIMAL(25,0)) AS __n{i}")]
    steps = [e for i in range(len(ratios)) for e in (
        f"ABS(__t{i}) * {2 * scale} + __n{i} AS __u{i}", f"2 * __n{i} AS __m{i}",
        f"IF(__t{i} < 0, -{unit}, {unit}) AS __s{i}")]
    # half up: (2 * scale * |t| + n) div 2n
    done = [f"CAST((__u{i} - __u{i} % __m{i}) / __m{i} * __s{i} AS DOUBLE) AS `{name}`" for i, name in enumerate(ratios)]
    return df.selectExpr(*kept, *whole).selectExpr(*kept, *steps).selectExpr(*kept, *done)


def strip_ws(c: ColumnLike) -> Column:
    """Strip all leading and trailing blanks, Unicode's too (``trim`` drops spaces only)."""
    return F.regexp_replace(col(c), f"^{BLANK_CLASS}+|{BLANK_CLASS}+$", "")


def passed_expr(tests_total: ColumnLike = "tests_total",
                tests_passed: ColumnLike = "tests_passed",
                status: ColumnLike = "status") -> Column:
    """Three-valued pass flag: by tests when they are known and non-zero,
    else by the status word, else NULL."""
    total, passed, st = col(tests_total), col(tests_passed), col(status)
    return (
        F.when(total.isNotNull() & passed.isNotNull() & (total > 0), passed == total)
        .when(st.isNotNull(), F.lower(st).isin(*PASS_WORDS))
        .otherwise(F.lit(None).cast("boolean"))
    )


def ts_candidate(c: ColumnLike) -> Column:
    """Text that looks like a timestamp: not NULL and matches ``[:+ZT-]``."""
    c = col(c)
    return c.isNotNull() & c.rlike(TS_CANDIDATE_PATTERN)


def parse_ts(c: ColumnLike) -> Column:
    """ISO text to timestamp, NULL when it is none (never an error)."""
    c = col(c)
    text = F.regexp_replace(c, TS_BASIC_PATTERN, TS_BASIC_AS_EXTENDED.replace("\\", "$"))
    for pattern, new in TS_OFFSETS:
        text = F.regexp_replace(text, pattern, new.replace("\\", "$"))
    return F.when(c.rlike(TS_EXTENDED_PATTERN) | c.rlike(TS_BASIC_PATTERN), text.try_cast("timestamp"))


def micros_between(start: Column, end: Column) -> Column:
    """Exact signed difference ``end - start`` in microseconds (bigint)."""
    return F.unix_micros(end) - F.unix_micros(start)
