"""Trailing frames whose cost a row does not depend on their length.

A frame written as ``rowsBetween(-n, 0)`` is evaluated anew for every row: n steps a row. Here every quantity has a table
of blocks that grow by level: level k of a row sums up its last RADIX^k rows and comes from RADIX blocks of level k - 1,
by lags. A maximum or minimum of n rows is a few overlapping blocks; a sum takes as many blocks of a level as the digit of n
says, so nothing is added and taken off again and no digits are lost. All quantities and all frame lengths share the
levels: the plan has a window for each level and one more, over one sort."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .rolling import history
from .scalars import ratio

RADIX = 4
NOISE = 1e-13  # a second moment below this share of its raw power sum is rounding


class Frames:
    """Collects frames over the columns of ``df`` and returns expressions that hold on the table of ``done()``.

    Every value is NULL until ``min_obs`` of its rows (default: all) are present, as in ``Rolling``; nulls do not count."""

    def __init__(self, df: DataFrame, key: str | list[str] = "ticker", order: str = "date"):
        self.df, self.w = df, history(key, order)
        self.bases: dict[str, tuple[str, Column]] = {}
        self.frames: dict[str, tuple[str, int]] = {}
        self.shifts: dict[str, Column] = {}

    def add(self, name: str, value: Column) -> None:
        self.df = self.df.withColumn(name, value)

    def _frame(self, kind: str, label: str, value: Column, n: int) -> Column:
        base = f"_{kind}_{label}"
        self.bases.setdefault(base, (kind, value))
        self.frames[f"{base}_{n}"] = (base, n)
        return F.col(f"{base}_{n}")

    def _shifted(self, c: str) -> Column:
        """The column less the first value of its key, which keeps power sums near the spread of the values."""
        self.shifts.setdefault(c, F.first(c, ignorenulls=True).over(self.w.rowsBetween(Window.unboundedPreceding, 0)))
        return F.col(c) - F.col(f"_shift_{c}")

    def count(self, c: str, n: int) -> Column:
        return self._frame("count", c, F.col(c).isNotNull().cast("int"), n)

    def _gated(self, value: Column, c: str, n: int, min_obs: int | None, least: int = 1) -> Column:
        return F.when(self.count(c, n) >= max(min_obs or n, least), value)

    def _powers(self, c: str, n: int, top: int) -> list[Column]:
        """The number of values and their power sums about the shift."""
        x = self._shifted(c)
        sums, value = [], x
        for p in range(1, top + 1):
            sums.append(self._frame("sum", f"{c}_p{p}", F.coalesce(value, F.lit(0.0)), n))
            value = value * x
        return [self.count(c, n).cast("double"), *sums]

    @staticmethod
    def _second(k: Column, s1: Column, s2: Column) -> Column:
        raw = s2 - s1 * s1 / k
        return F.when(raw > s2 * NOISE, raw).otherwise(0.0)

    def max(self, c: str, n: int, min_obs: int | None = None) -> Column:
        return self._gated(self._frame("max", c, F.col(c), n), c, n, min_obs)

    def min(self, c: str, n: int, min_obs: int | None = None) -> Column:
        return self._gated(self._frame("min", c, F.col(c), n), c, n, min_obs)

    def mean(self, c: str, n: int, min_obs: int | None = None) -> Column:
        total = self._frame("sum", c, F.coalesce(F.col(c).cast("double"), F.lit(0.0)), n)
        return self._gated(total / self.count(c, n), c, n, min_obs)

    def var(self, c: str, n: int, min_obs: int | None = None) -> Column:
        k, s1, s2 = self._powers(c, n, 2)
        return self._gated(self._second(k, s1, s2) / (k - 1.0), c, n, min_obs, 2)

    def std(self, c: str, n: int, min_obs: int | None = None) -> Column:
        return F.sqrt(self.var(c, n, min_obs))

    def skew(self, c: str, n: int, min_obs: int | None = None) -> Column:
        """Bias-corrected sample skewness; NULL where the values do not vary."""
        k, s1, s2, s3 = self._powers(c, n, 3)
        m2, m3 = self._second(k, s1, s2), s3 - 3.0 * s1 * s2 / k + 2.0 * s1 * s1 * s1 / (k * k)
        raw = ratio(F.sqrt(k) * m3, F.pow(m2, 1.5))
        return self._gated(raw * F.sqrt(k * (k - 1.0)) / (k - 2.0), c, n, min_obs, 3)

    def kurt(self, c: str, n: int, min_obs: int | None = None) -> Column:
        """Bias-corrected excess kurtosis; NULL where the values do not vary."""
        k, s1, s2, s3, s4 = self._powers(c, n, 4)
        m2 = self._second(k, s1, s2)
        m4 = s4 - 4.0 * s1 * s3 / k + 6.0 * s1 * s1 * s2 / (k * k) - 3.0 * s1 * s1 * s1 * s1 / (k * k * k)
        raw = ratio(k * m4, m2 * m2) - 3.0
        return self._gated(((k + 1.0) * raw + 6.0) * (k - 1.0) / ((k - 2.0) * (k - 3.0)), c, n, min_obs, 4)

    def _both(self, a: str, b: str, n: int) -> tuple[Column, ...]:
        """Number of rows that have both values, and second moments of a with b, of a and of b over these."""
        x, y = self._shifted(a), self._shifted(b)
        both, label = x.isNotNull() & y.isNotNull(), f"{a}_{b}"
        total = lambda name, v: self._frame("sum", f"{label}_{name}", F.when(both, v).otherwise(0.0), n)
        k = self._frame("count", label, both.cast("int"), n).cast("double")
        sx, sy = total("x", x), total("y", y)
        return k, total("xy", x * y) - sx * sy / k, self._second(k, sx, total("xx", x * x)), self._second(k, sy, total("yy", y * y))

    def cov(self, a: str, b: str, n: int, min_obs: int | None = None) -> Column:
        k, xy, _, _ = self._both(a, b, n)
        return F.when(k >= max(min_obs or n, 2), xy / (k - 1.0))

    def corr(self, a: str, b: str, n: int, min_obs: int | None = None) -> Column:
        """Correlation; NULL when one side does not vary."""
        k, xy, xx, yy = self._both(a, b, n)
        return F.when(k >= max(min_obs or n, 2), ratio(xy, F.sqrt(xx) * F.sqrt(yy)))

    def done(self) -> DataFrame:
        """``df`` with a column for every frame asked for."""
        own = self.df.columns
        df = self.df.withColumns({f"_shift_{c}": s for c, s in self.shifts.items()}) if self.shifts else self.df
        df = df.select(*own, *[v.alias(f"{b}@0") for b, (_, v) in self.bases.items()])
        longest = {b: max(n for base, n in self.frames.values() if base == b) for b in self.bases}
        for k in range(self._top(max(longest.values(), default=1))):
            up = {b: kind for b, (kind, _) in self.bases.items() if longest[b] >= RADIX ** (k + 1)}
            df = df.select(
                "*", *[self._blocks(b, kind, [(k, d * RADIX**k) for d in range(RADIX)]).alias(f"{b}@{k + 1}") for b, kind in up.items()]
            )
        return df.select(*own, *[self._blocks(b, self.bases[b][0], self._cover(b, n)).alias(name) for name, (b, n) in self.frames.items()])

    @staticmethod
    def _top(n: int) -> int:
        """The level of the largest block within n rows."""
        k = 0
        while RADIX ** (k + 1) <= n:
            k += 1
        return k

    def _cover(self, base: str, n: int) -> list[tuple[int, int]]:
        """(level, rows back) of the blocks that make up n rows; those of an extreme may overlap."""
        top = self._top(n)
        size = RADIX**top
        if self.bases[base][0] in ("max", "min"):
            return [(top, min(at, n - size)) for at in range(0, n, size)]
        made, back = [], 0
        for k in range(top + 1):
            for _ in range(n // RADIX**k % RADIX):
                made.append((k, back))
                back += RADIX**k
        return made

    def _blocks(self, base: str, kind: str, parts: list[tuple[int, int]]) -> Column:
        columns = [F.lag(F.col(f"`{base}@{k}`"), back).over(self.w) if back else F.col(f"`{base}@{k}`") for k, back in parts]
        if kind in ("max", "min"):  # nulls are passed over, as are blocks before the first row of the key
            return (F.greatest if kind == "max" else F.least)(*columns) if len(columns) > 1 else columns[0]
        return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in columns])
