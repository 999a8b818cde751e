"""Column helpers shared by all operators. None of them can raise under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy", "yyyyMMdd")


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_ticker(c: Column | str) -> Column:
    return F.upper(F.trim(as_col(c)))


def finite(c: Column | str) -> Column:
    """NaN and the infinities mean "missing": turn them into NULL once, at the boundary."""
    c = as_col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def to_number(c: Column | str, default: float | None = None) -> Column:
    value = finite(as_col(c).try_cast("double"))
    return value if default is None else F.coalesce(value, F.lit(default))


def to_day(c: Column | str, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """Date from text in any of several formats; unreadable text becomes NULL."""
    c = F.trim(as_col(c))
    return F.coalesce(*[F.to_date(F.try_to_timestamp(c, F.lit(f))) for f in formats])


def ratio(num: Column | str, den: Column | str, default: float | None = None) -> Column:
    """num / den, NULL (or ``default``) when the denominator is zero or missing."""
    value = F.try_divide(as_col(num), as_col(den))
    return value if default is None else F.coalesce(value, F.lit(default))


def positive(c: Column | str) -> Column:
    """The value where it is above zero, else NULL."""
    c = as_col(c)
    return F.when(c > 0, c)


def holds(cond: Column) -> Column:
    """A condition where unknown counts as false."""
    return F.coalesce(cond, F.lit(False))


def clip(c: Column | str, lo: float | None = None, hi: float | None = None) -> Column:
    """Bound a value from both sides; NULL stays NULL (greatest/least alone would skip it)."""
    c = as_col(c)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(c.isNotNull(), out)


def month_end(c: Column | str) -> Column:
    return F.last_day(F.to_date(as_col(c)))


def toward_zero(c: Column | str) -> Column:
    c = as_col(c)
    return F.when(c > 0, F.floor(c)).otherwise(F.ceil(c)).cast("double")


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(as_col(c), digits)


def correlation(a: Column | str, b: Column | str) -> Column:
    """Aggregate correlation; NULL when one side does not vary (the built-in divides by zero there)."""
    a, b = as_col(a), as_col(b)
    spread = F.stddev_samp(F.when(b.isNotNull(), a)) * F.stddev_samp(F.when(a.isNotNull(), b))
    return ratio(F.covar_samp(a, b), spread)
