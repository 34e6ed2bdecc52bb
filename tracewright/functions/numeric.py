"""Column helpers whose undefined results are NULL, never NaN and never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAD_SCALE = 1.4826


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """The value, or NULL for NaN and infinities."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def safe_divide(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(col(a), col(b))


def positive_ratio(a: Column | str, b: Column | str) -> Column:
    """a / b for positive b only."""
    return F.when(col(b) > 0, col(a) / col(b))


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(col(c), digits) + F.lit(0.0)


def pearson(x: Column | str, y: Column | str) -> Column:
    """Aggregate: Pearson correlation; NULL where either side is constant. F.corr would raise there under ANSI rules."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)))


def r_squared(y: Column | str, predicted: Column | str) -> Column:
    """Aggregate: 1 - SSE / SST; NULL for a constant target."""
    y, p = col(y), col(predicted)
    return F.lit(1.0) - F.try_divide(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y))


def rmse(y: Column | str, predicted: Column | str) -> Column:
    d = col(y) - col(predicted)
    return F.sqrt(F.avg(d * d))


def median(c: Column | str) -> Column:
    return F.percentile(col(c), F.lit(0.5))


def quantile(c: Column | str, q: float) -> Column:
    return F.percentile(col(c), F.lit(q))
