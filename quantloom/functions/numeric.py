"""Column expressions that never raise and never give NaN or infinity: missing is NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is zero or NULL."""
    return F.try_divide(_col(a), _col(b))


def log_ratio(a: Column | str, b: Column | str) -> Column:
    """ln(a / b), NULL where that isn't a number."""
    q = ratio(a, b)
    return F.when(q > 0, F.ln(q))


def log1p(x: Column | str) -> Column:
    return F.when(_col(x) > -1, F.log1p(_col(x)))


def clip(x: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.least(_col(x), F.lit(high)), F.lit(low))


def known(df: DataFrame) -> DataFrame:
    """NaN of all floating columns as NULL."""
    return df.select(*[F.nanvl(c, F.lit(None).cast(t)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x
