"""Fold assignment as a deterministic column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _hash(row_id: Column, seed: int) -> Column:
    """60 bits of the md5 of seed and id, the same in any engine."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def kfold(row_id: Column, k: int = 5, seed: int = 111) -> Column:
    """Fold by a hash of the row id: no shuffle, nearly equal sizes."""
    return F.pmod(_hash(row_id, seed), F.lit(k)).cast("int")


def stratified_kfold(df: DataFrame, by: str, row_id: str, k: int = 5, seed: int = 7, out: str = "fold", buckets: int = 64) -> DataFrame:
    """``df`` with a fold column; each value of ``by`` is spread over the folds with counts that differ by one at most.

    Rows are numbered in hash order within (value, leading part of the hash) and moved up by the parts before, so one value
    with most rows is not sorted in one task."""
    h = _hash(F.col(row_id), seed)
    rows = df.withColumn("__h", h).withColumn("__part", F.floor(F.shiftright("__h", 30) * buckets / (1 << 30)).cast("int"))
    counts = rows.groupBy(F.col(by).alias("__y"), F.col("__part").alias("__q")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__y").orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("__y", "__q", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__b"))
    numbered = rows.withColumn("__r", F.row_number().over(Window.partitionBy(by, "__part").orderBy("__h", row_id)))
    joined = numbered.join(base, F.col(by).eqNullSafe(F.col("__y")) & (F.col("__part") == F.col("__q")))
    return joined.withColumn(out, F.pmod(F.col("__b") + F.col("__r") - 1, F.lit(k)).cast("int")).drop("__h", "__part", "__y", "__q", "__b", "__r")
