"""Column transforms: scaling, filling, cyclical and calendar features, frequencies, null counts, narrowing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import ROW_ID, SPLIT, TrainTest
from ..functions.expr import ieee_div, known, null_flag
from .medians import exact_medians

INTS = {"tinyint": (-(2**7), 2**7 - 1), "smallint": (-(2**15), 2**15 - 1), "int": (-(2**31), 2**31 - 1), "bigint": (-(2**63), 2**63 - 1)}
FLOAT_MAX = 3.4028234663852886e38


def with_statistics(df: DataFrame, rows: DataFrame, statistics: dict[str, Column]) -> DataFrame:
    """``df`` with the aggregates of ``rows`` beside each row: all of them in one pass, joined as a single row."""
    return df.crossJoin(F.broadcast(rows.agg(*[c.alias(n) for n, c in statistics.items()])))


def _replaced(df: DataFrame, source: DataFrame, made: dict[str, Column]) -> DataFrame:
    """The columns of ``source`` in their order, those in ``made`` replaced and new ones at the end; one projection."""
    names = source.columns
    return df.select(*[made[c].alias(c) if c in made else F.col(f"`{c}`") for c in names], *[x.alias(c) for c, x in made.items() if c not in names])


def standerize(tt: TrainTest, encode_col: Sequence[str]) -> TrainTest:
    """(x - mean) / population deviation, both of the train rows; missing values are skipped and stay; a constant divides by 1."""
    stats = {f"__{k}_{c}": f(known(tt.df, c)) for c in encode_col for k, f in (("m", F.avg), ("s", F.stddev_pop))}
    wide = with_statistics(tt.df, tt.train_rows, stats)
    made = {c: (known(tt.df, c) - F.col(f"`__m_{c}`")) / F.when(F.col(f"`__s_{c}`") == 0, 1.0).otherwise(F.col(f"`__s_{c}`")) for c in encode_col}
    return TrainTest(_replaced(wide, tt.df, made))


def fillna(tt: TrainTest, encode_col: Sequence[str], how: str) -> TrainTest:
    """Missing values become the median or mean of the train rows; other values of ``how`` are an error."""
    values = {f"__f_{c}": known(tt.df, c) for c in encode_col}
    if how == "median":
        wide = tt.df.crossJoin(F.broadcast(exact_medians(tt.train_rows, {}, values)))  # one row
    elif how == "mean":
        wide = with_statistics(tt.df, tt.train_rows, {n: F.avg(c) for n, c in values.items()})
    else:
        raise ValueError(f"how must be 'median' or 'mean', not {how!r}")
    return TrainTest(_replaced(wide, tt.df, {c: F.coalesce(known(tt.df, c).cast("double"), F.col(f"`__f_{c}`")) for c in encode_col}))


def circle_encoding(tt: TrainTest, encode_col: Sequence[str]) -> TrainTest:
    """``<c>_cos`` and ``<c>_sin`` of 2 pi x / max, the maximum being that of the train rows."""
    wide = with_statistics(tt.df, tt.train_rows, {f"__x_{c}": F.max(known(tt.df, c)) for c in encode_col})
    angle = {c: ieee_div(F.lit(2 * math.pi) * known(tt.df, c), F.col(f"`__x_{c}`")) for c in encode_col}
    return TrainTest(_replaced(wide, tt.df, {f"{c}_{n}": f(angle[c]) for c in encode_col for n, f in (("cos", F.cos), ("sin", F.sin))}))


def datetime_parser(tt: TrainTest, encode_col: Sequence[str]) -> TrainTest:
    """``<c>_year, _month, _day, _dow (Monday 0), _hour, _minute``; strings are parsed first."""
    parts = {"year": F.year, "month": F.month, "day": F.dayofmonth, "dow": F.weekday, "hour": F.hour, "minute": F.minute}
    made = {}
    for c in encode_col:
        stamp = F.to_timestamp(F.col(f"`{c}`")) if isinstance(tt.df.schema[c].dataType, T.StringType) else F.col(f"`{c}`")
        made |= {f"{c}_{n}": f(stamp) for n, f in parts.items()}
    return TrainTest(_replaced(tt.df, tt.df, made))


def frequency_encoding(tt: TrainTest, encode_col: Sequence[str]) -> TrainTest:
    """``fe_<c>``: rows of the value over rows with a known value, train and test together; null for a null value.

    Group sizes are aggregated and joined back, so only partial counts are shuffled; small count tables are broadcast by the
    optimizer at run time."""
    df = tt.df
    for c in encode_col:
        key = known(tt.df, c)
        counts = tt.df.where(key.isNotNull()).groupBy(key.alias("__k")).agg(F.count("*").alias("__n"))
        total = counts.agg(F.sum("__n").alias("__of"))
        share = counts.crossJoin(F.broadcast(total)).select("__k", (F.col("__n") / F.col("__of")).alias(f"fe_{c}"))
        df = df.join(share, key == F.col("__k"), "left").drop("__k")
    return TrainTest(df)


def count_null(tt: TrainTest, encode_col: Sequence[str]) -> TrainTest:
    """``count_null``: nulls of the row over all columns; ``cn_<c>``: 0 or 1, for the columns that have a null anywhere.

    Which of these exist depends on the data, so one aggregation runs while the plan is built."""
    flags = {c: null_flag(known(tt.df, c)) for c in tt.columns}
    seen = tt.df.agg(*[F.max(flags[c]).alias(f"x{i}") for i, c in enumerate(encode_col)]).first()
    total = F.lit(0)
    for f in flags.values():
        total = total + f
    made = {"count_null": total} | {f"cn_{c}": flags[c] for i, c in enumerate(encode_col) if seen[i]}
    return TrainTest(_replaced(tt.df, tt.df, made))


def narrowest(df: DataFrame) -> dict[str, str]:
    """The narrowest type of each integer and float column that holds its values with room at both ends; one aggregation.

    Half precision does not exist here, so floats stop at ``float``. Columns without a value keep their type."""
    kinds = {f.name: f.dataType for f in df.schema if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType))}
    if not kinds:
        return {}
    row = df.agg(*[f(known(df, c)).alias(f"{n}{i}") for i, c in enumerate(kinds) for n, f in (("a", F.min), ("b", F.max))]).first()
    out = {}
    for i, (c, kind) in enumerate(kinds.items()):
        lo, hi = row[2 * i], row[2 * i + 1]
        if lo is None:
            continue
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            out[c] = "float" if -FLOAT_MAX < lo and hi < FLOAT_MAX else "double"
        else:
            out[c] = next((t for t, (a, b) in INTS.items() if a < lo and hi < b), "bigint")
    return out


def reduce_mem_usage(df: DataFrame) -> DataFrame:
    """``df`` with its numbers cast to the narrowest types; strings are left to the file format's dictionaries."""
    types = narrowest(df)
    return df.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns])


def nn_features(tt: TrainTest, first_rows: int = 101, order: str = ROW_ID) -> TrainTest:
    """Inputs for a network: missing numbers become -1, columns are standardised, others dropped, and of the train rows
    those of row number below ``first_rows`` stay (row numbers count from 0)."""
    numbers = [f.name for f in tt.df.schema if isinstance(f.dataType, T.NumericType) and f.name not in (SPLIT, ROW_ID)]
    filled = tt.select(*[F.coalesce(known(tt.df, c).cast("double"), F.lit(-1.0)).alias(c) for c in numbers])
    out = standerize(filled, numbers)
    return TrainTest(out.df.where((F.col(SPLIT) == "test") | (F.col(order) < first_rows)))
