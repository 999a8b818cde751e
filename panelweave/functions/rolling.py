"""Row windows over a dense key x date grid.

A window holds one key's rows in date order. Panels have one row per (key, date), so a window never holds more
rows than the calendar has dates, whatever the number of raw records behind a key. Every rolling value is NULL
until ``min_obs`` of its rows are present (default: all of them).
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec, functions as F

from .scalars import as_col, ratio


def history(key: str | list[str] = "ticker", order: str = "date") -> WindowSpec:
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(order)


class Rolling:
    """Rolling and lag expressions for one key/order pair; all of them share one sort."""

    def __init__(self, key: str | list[str] = "ticker", order: str = "date"):
        self.w = history(key, order)

    def rows(self, n: int) -> WindowSpec:
        return self.w.rowsBetween(-(n - 1), 0)

    def so_far(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, 0)

    def gated(self, value: Column, seen: Column, n: int, min_obs: int | None) -> Column:
        return F.when(F.count(seen).over(self.rows(n)) >= (min_obs or n), value)

    def _agg(self, fn, c, n: int, min_obs: int | None = None) -> Column:
        c = as_col(c)
        return self.gated(fn(c).over(self.rows(n)), c, n, min_obs)

    def mean(self, c, n, min_obs=None):
        return self._agg(F.avg, c, n, min_obs)

    def std(self, c, n, min_obs=None):
        return self._agg(F.stddev_samp, c, n, min_obs)

    def max(self, c, n, min_obs=None):
        return self._agg(F.max, c, n, min_obs)

    def min(self, c, n, min_obs=None):
        return self._agg(F.min, c, n, min_obs)

    def lag(self, c, n: int = 1) -> Column:
        return F.lag(as_col(c), n).over(self.w)

    def lead(self, c, n: int = 1) -> Column:
        return F.lead(as_col(c), n).over(self.w)

    def change(self, c, n: int = 1) -> Column:
        return as_col(c) - self.lag(c, n)

    def ret(self, c, n: int = 1) -> Column:
        """Simple return over n rows."""
        return ratio(c, self.lag(c, n)) - 1.0

    def fill(self, c, limit: int | None = None) -> Column:
        """Last known value, at most ``limit`` rows old."""
        w = self.so_far() if limit is None else self.w.rowsBetween(-limit, 0)
        return F.last(as_col(c), ignorenulls=True).over(w)

    def first_seen(self, c) -> Column:
        """The first non-null value of the key, visible from that row on."""
        return F.first(as_col(c), ignorenulls=True).over(self.so_far())

    def drawdown(self, c) -> Column:
        """Distance below the running maximum."""
        c = as_col(c)
        return ratio(c, F.max(c).over(self.so_far())) - 1.0

    def rolling_drawdown(self, c, n: int) -> Column:
        return ratio(c, self.max(c, n)) - 1.0

    def growth(self, r) -> Column:
        """Running product of 1 + r (an unknown return leaves the product unchanged)."""
        return F.product(1.0 + as_col(r)).over(self.so_far())

    def _pair(self, fn, a, b, n, min_obs=None, over=False) -> Column:
        a, b = as_col(a), as_col(b)
        both = F.when(a.isNotNull() & b.isNotNull(), F.lit(1))
        value = fn(a, b, self.rows(n)) if over else fn(a, b).over(self.rows(n))
        return self.gated(value, both, n, min_obs)

    @staticmethod
    def _corr_parts(a: Column, b: Column, w: WindowSpec) -> Column:
        return ratio(
            F.covar_samp(a, b).over(w),
            F.stddev_samp(F.when(b.isNotNull(), a)).over(w) * F.stddev_samp(F.when(a.isNotNull(), b)).over(w),
        )

    def cov(self, a, b, n, min_obs=None):
        return self._pair(F.covar_samp, a, b, n, min_obs)

    def corr(self, a, b, n, min_obs=None):
        """Correlation; NULL when one side does not vary (the built-in divides by zero there)."""
        return self._pair(self._corr_parts, a, b, n, min_obs, over=True)

    def var(self, c, n, min_obs=None):
        return self._agg(F.var_samp, c, n, min_obs)

    def skew(self, c, n, min_obs=None) -> Column:
        """Bias-corrected sample skewness."""
        c = as_col(c)
        k = F.count(c).over(self.rows(n)).cast("double")
        raw = F.skewness(c).over(self.rows(n))
        return F.when(k >= max(min_obs or n, 3), raw * F.sqrt(k * (k - 1.0)) / (k - 2.0))

    def kurt(self, c, n, min_obs=None) -> Column:
        """Bias-corrected excess kurtosis."""
        c = as_col(c)
        k = F.count(c).over(self.rows(n)).cast("double")
        raw = F.kurtosis(c).over(self.rows(n))
        return F.when(
            k >= max(min_obs or n, 4),
            ((k + 1.0) * raw + 6.0) * (k - 1.0) / ((k - 2.0) * (k - 3.0)),
        )
