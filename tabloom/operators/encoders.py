"""Encoders of categories and combinations of columns; steps that chain into pipelines."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import ieee_div, known
from .folds import kfold

Step = Callable[[DataFrame], DataFrame]
OPERATORS: dict[str, tuple[str, Callable[[Column, Column], Column]]] = {
    "+": ("plus", lambda a, b: a + b),
    "-": ("minus", lambda a, b: a - b),
    "*": ("mul", lambda a, b: a * b),
    "/": ("div", ieee_div),
}


def chain(*steps: Step) -> Step:
    """The steps one after another, as one step."""
    return lambda df: reduce(lambda d, step: step(d), steps, df)


def arithmetic_combinations(columns: Sequence[str], operator: str = "+", drop_origin: bool = False, r: int = 2) -> Step:
    """``<a><b>_plus`` (``_minus``, ``_mul``, ``_div``) for every unordered choice of r columns; all in one projection."""
    suffix, make = OPERATORS[operator]

    def step(df: DataFrame) -> DataFrame:
        new = [reduce(make, [F.col(f"`{c}`") for c in group]).alias(f"{''.join(group)}_{suffix}") for group in itertools.combinations(columns, r)]
        return df.select(*[F.col(f"`{c}`") for c in df.columns if not (drop_origin and c in columns)], *new)

    return step


def concat_combination(columns: Sequence[str], drop_origin: bool = False, r: int = 2, separator: str = "|", suffix: str = "_combi") -> Step:
    """``<a><b>_combi``: the values as strings with a separator, so that "1" and "12" differ from "11" and "2"; null if one is null."""

    def step(df: DataFrame) -> DataFrame:
        new = []
        for group in itertools.combinations(columns, r):
            parts = [F.col(f"`{c}`").cast("string") for c in group]
            joined = list(itertools.chain.from_iterable((F.lit(separator), p) for p in parts))[1:]
            new.append(F.concat(*joined).alias(f"{''.join(group)}{suffix}"))
        return df.select(*[F.col(f"`{c}`") for c in df.columns if not (drop_origin and c in columns)], *new)

    return step


def _coded(df: DataFrame, c: str, codes: DataFrame, out: str) -> DataFrame:
    """``df`` with the code of column c joined in as ``out``; codes has __k and __v."""
    names = [x for x in df.columns if x != out]
    joined = df.withColumnRenamed(c, "__c").join(codes, F.col("__c") == F.col("__k"), "left")
    place = {c: F.col("__v").alias(out)} if out == c else {c: F.col("__c").alias(c)}
    cols = [place.get(x, F.col(f"`{x}`")) for x in (df.columns if out == c else names)]
    return joined.select(*cols, *([] if out == c else [F.col("__v").alias(out)]))


def label_encoder(columns: Sequence[str], output_suffix: str = "") -> Step:
    """Numbers 0, 1, ... of the sorted distinct values; a null stays null.

    Distinct values are numbered within ranges of the sorted order and moved up by the ranges before, so a column of
    very many values is not sorted in one task."""

    def step(df: DataFrame) -> DataFrame:
        for c in columns:
            df = _coded(df, c, _numbered(df.select(known(df, c).alias("__k")).where("__k is not null").distinct()), c + output_suffix)
        return df

    return step


def _numbered(values: DataFrame, most_in_a_task: int = 1_000_000) -> DataFrame:
    n = values.count()
    if n <= most_in_a_task:
        return values.select("__k", (F.row_number().over(Window.orderBy("__k")) - 1).cast("long").alias("__v"))
    placed = values.repartitionByRange("__k").withColumn("__p", F.spark_partition_id()).persist()
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("__p").agg(F.count("*").alias("__n")).select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__b"))
    within = F.row_number().over(Window.partitionBy("__p").orderBy("__k"))
    return placed.withColumn("__r", within).join(F.broadcast(base), "__p").select("__k", (F.col("__b") + F.col("__r") - 1).alias("__v"))


def count_encoder(columns: Sequence[str], output_suffix: str = "_ce") -> Step:
    """How many rows have the row's value; null for a null."""

    def step(df: DataFrame) -> DataFrame:
        for c in columns:
            counts = df.where(known(df, c).isNotNull()).groupBy(known(df, c).alias("__k")).agg(F.count("*").alias("__v"))
            df = _coded(df, c, counts, c + output_suffix)
        return df

    return step


def target_encoder(columns: Sequence[str], target: str, row_id: str, folds: int = 5, seed: int = 111, output_suffix: str = "_te", fold: Column | None = None) -> Step:
    """Mean target of the category: over the other folds for rows with a target, over all of them for the others.

    Sums and counts by category and fold are one small aggregate; totals less the own fold are joined back. A category that
    the other folds lack has null."""

    def step(df: DataFrame) -> DataFrame:
        df = df.withColumn("__fold", F.when(F.col(f"`{target}`").isNotNull(), fold if fold is not None else kfold(F.col(f"`{row_id}`"), folds, seed)))
        for c in columns:
            by = df.where(F.col("__fold").isNotNull() & known(df, c).isNotNull()).groupBy(known(df, c).alias("__k"), F.col("__fold").alias("__f")).agg(F.sum(known(df, target).cast("double")).alias("__s"), F.count(known(df, target)).alias("__n"))
            per = by.groupBy("__k").agg(F.map_from_entries(F.collect_list(F.struct("__f", F.struct("__s", "__n")))).alias("__m"), F.sum("__s").alias("__ts"), F.sum("__n").alias("__tn"))
            joined = df.join(per, known(df, c) == F.col("__k"), "left")
            own = F.when(F.col("__fold").isNotNull(), F.try_element_at("__m", F.col("__fold")))
            mean = F.try_divide(F.col("__ts") - F.coalesce(own["__s"], F.lit(0.0)), (F.col("__tn") - F.coalesce(own["__n"], F.lit(0))).cast("double"))
            df = joined.withColumn("__te", mean).drop("__k", "__m", "__ts", "__tn")
            name = c + output_suffix
            df = df.drop(c).withColumnRenamed("__te", c) if name == c else df.withColumnRenamed("__te", name)
        return df.drop("__fold")

    return step
