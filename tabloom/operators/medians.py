"""Exact medians whose memory does not grow with the values of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_medians(df: DataFrame, keys: dict[str, Column], values: dict[str, Column], accuracy: int = 10_000) -> DataFrame:
    """One row for each combination of ``keys`` (one row in all without keys) with the median of each of ``values``, a double.

    A quantile sketch of each group, whose rank error is at most n / ``accuracy``, gives two bounds four such errors to either
    side of the middle. A second pass counts what is below them and the rows of each distinct value between them, combined before
    the shuffle, and the middle ranks are then looked up among these: about 8 / ``accuracy`` of the rows of a group at most meet
    in one sort, which may spill, and no buffer holds a group's values. Should the bounds miss the middle, the query fails.

    Nulls are skipped and the caller makes NaN null; a group without a value has a null median; null keys are groups too."""
    names, n = list(values), len(values)
    key, val = [f"k{i}" for i in range(len(keys))], [f"v{i}" for i in range(n)]
    rows = df.select(*[c.alias(k) for c, k in zip(keys.values(), key, strict=True)], *[c.cast("double").alias(v) for c, v in zip(values.values(), val, strict=True)])
    margin = 4 / accuracy
    bounds = rows.groupBy(*key).agg(*[F.struct(F.count(v).alias("n"), F.percentile_approx(v, [0.5 - margin, 0.5 + margin], accuracy).alias("b")).alias(f"b{i}") for i, v in enumerate(val)])
    beside = _lookup(rows, bounds, key)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(v).alias("v"), F.col(f"b{i}").alias("b")) for i, v in enumerate(val)]))
    long = beside.select(*key, each.alias("e")).select(*key, "e.i", "e.v", F.col("e.b.n").alias("total"), F.col("e.b.b").alias("b")).where("v IS NOT NULL")
    place = F.when(F.col("v") < F.col("b")[0], 0).when(F.col("v") <= F.col("b")[1], 1).otherwise(2)
    counted = long.withColumn("place", place).groupBy(*key, "i", "total", "place", F.when(F.col("place") == 1, F.col("v")).alias("v")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*key, "i").orderBy("place", "v"))
    holds = lambda rank: (F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto"))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    found = F.when(F.col("place") == 1, F.col("v")).otherwise(F.raise_error(F.lit("the bounds of a median miss the middle of its group")).cast("double"))
    middle = counted.withColumn("upto", upto).where(holds(low) | holds(high)).select(*key, "i", found.alias("v"))
    out = middle.groupBy(*key).agg(*[F.avg(F.when(F.col("i") == i, F.col("v"))).alias(f"m{i}") for i in range(n)])
    groups = _lookup(bounds.select(*key), out, key)  # groups without a value
    return groups.select(*[F.col(k).alias(c) for k, c in zip(key, keys, strict=True)], *[F.col(f"m{i}").alias(c) for i, c in enumerate(names)])


def _lookup(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``left`` with the columns of the row of ``right`` that has its keys, null keys included; ``right`` is one row without keys."""
    if not keys:
        return left.crossJoin(F.broadcast(right)) if left.columns else right
    other = right.withColumnsRenamed({k: f"r_{k}" for k in keys})
    match = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"r_{k}"))
        match = same if match is None else match & same
    return left.join(other, match, "left").drop(*[f"r_{k}" for k in keys])
