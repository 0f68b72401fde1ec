"""Expressions that keep one meaning of "missing" and IEEE division under ANSI SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATS = (T.FloatType, T.DoubleType)


def is_float(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, FLOATS)


def clean_nan(df: DataFrame, *names: str) -> DataFrame:
    """NaN becomes NULL in the float columns named, or in all of them; one projection."""
    wanted = set(names or df.columns)
    return df.select(*[F.nanvl(F.col(f"`{c}`"), F.lit(None).cast(df.schema[c].dataType)).alias(c) if c in wanted and is_float(df, c) else F.col(f"`{c}`") for c in df.columns])


def known(df: DataFrame, name: str) -> Column:
    """The column with NaN as NULL."""
    return F.nanvl(F.col(f"`{name}`"), F.lit(None).cast(df.schema[name].dataType)) if is_float(df, name) else F.col(f"`{name}`")


def ieee_div(n: Column, d: Column) -> Column:
    """n / d with signed infinities at d = 0, and NULL for 0 / 0 and for NULLs."""
    n, d = n.cast("double"), d.cast("double")
    at_zero = F.when(n > 0, float("inf")).when(n < 0, float("-inf"))
    return F.when(d == 0, at_zero).otherwise(F.try_divide(n, d))


def null_flag(c: Column) -> Column:
    return c.isNull().cast("int")


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over the rows where both are known; NULL if either is constant there. An aggregate."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def threshold(p: Column, at: float = 0.5) -> Column:
    return F.when(p > at, 1).otherwise(0)
