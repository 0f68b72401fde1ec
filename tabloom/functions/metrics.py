"""Evaluation metrics as aggregates over a frame of targets and predictions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGE = 1e-15


def _clipped(p: Column) -> Column:
    return F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), p.cast("double")))


def log_loss(y: Column, p: Column) -> Column:
    q = _clipped(p)
    return -F.avg(y * F.log(q) + (1 - y) * F.log(1 - q))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg(F.pow(y - p, F.lit(2.0))))


def focal(y: Column, margin: Column, alpha: float = 0.25, gamma: float = 1.0) -> Column:
    """Mean focal loss of raw margins."""
    p = _clipped(1 / (1 + F.exp(-margin)))
    pt, at = F.when(y == 1, p).otherwise(1 - p), F.when(y == 1, alpha).otherwise(1 - alpha)
    return F.avg(-at * F.pow(1 - pt, F.lit(gamma)) * F.log(pt))


def _judged(df: DataFrame, y: str, p: str) -> DataFrame:
    """Rows with a target and a prediction; null and NaN are missing in both."""
    here = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return df.where(here(y) & here(p))


def _by_score(df: DataFrame, y: str, p: str) -> DataFrame:
    """Rows and positives at each distinct score; both ranking metrics need no more. Scores meet in partial sums first."""
    return _judged(df, y, p).groupBy(F.col(p).cast("double").alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("double")).alias("pos"))


def _running(scores: DataFrame, descending: bool, buckets: int = 256) -> DataFrame:
    """``scores`` with rows and positives before each score, by sums within ranges and then over ranges.

    Ranges hold about equally many distinct scores, whatever their spread: their ends are approximate quantiles, found by an
    action of their own, as each use of a sketch may come out differently and both uses here must agree."""
    ends = scores.agg(F.percentile_approx("s", [i / buckets for i in range(1, buckets)], 20 * buckets)).first()[0]
    cuts = F.array(*[F.lit(e) for e in sorted(set(ends or []))]).cast("array<double>")
    part = F.size(F.filter(cuts, lambda e: e < F.col("s")))
    order = F.desc if descending else F.asc
    rows = scores.withColumn("part", part)
    sums = rows.groupBy("part").agg(F.sum("n").alias("pn"), F.sum("pos").alias("pp"))
    before = Window.orderBy(order("part")).rowsBetween(Window.unboundedPreceding, -1)  # at most ``buckets`` rows
    sums = sums.select("part", F.coalesce(F.sum("pn").over(before), F.lit(0)).alias("bn"), F.coalesce(F.sum("pp").over(before), F.lit(0.0)).alias("bp"))
    within = Window.partitionBy("part").orderBy(order("s")).rowsBetween(Window.unboundedPreceding, -1)
    here = rows.withColumn("wn", F.coalesce(F.sum("n").over(within), F.lit(0))).withColumn("wp", F.coalesce(F.sum("pos").over(within), F.lit(0.0)))
    return here.join(F.broadcast(sums), "part").select("s", "n", "pos", (F.col("bn") + F.col("wn")).alias("n_before"), (F.col("bp") + F.col("wp")).alias("pos_before"))


def roc_auc(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row ``score``: the rank sum with mid-ranks, exact."""
    r = _running(_by_score(df, y, p), descending=False)
    mid = F.col("n_before") + (F.col("n") + 1) / 2
    t = r.agg(F.sum(mid * F.col("pos")).alias("ranks"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return t.select(F.try_divide(F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p"))).alias("score"))


def average_precision(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row ``score``: the step-wise sum over distinct scores."""
    r = _running(_by_score(df, y, p), descending=True)
    precision = (F.col("pos_before") + F.col("pos")) / (F.col("n_before") + F.col("n"))
    return r.agg(F.try_divide(F.sum(F.col("pos") * precision), F.sum("pos")).alias("score"))


AGGREGATES: dict[str, Callable[[Column, Column], Column]] = {"log_loss": log_loss, "mean_absolute_error": mae, "rmse": rmse, "focal": focal}
RANKINGS: dict[str, Callable[[DataFrame, str, str], DataFrame]] = {"auc": roc_auc, "prauc": average_precision}
GREATER_IS_BETTER = frozenset(RANKINGS)


def evaluate(df: DataFrame, metric: str, y: str = "y", p: str = "pred") -> DataFrame:
    """One row ``score``, over the rows that have a target and a prediction (NaN is none). An unknown metric is a ValueError before anything runs."""
    if metric in AGGREGATES:
        return _judged(df, y, p).agg(AGGREGATES[metric](F.col(y), F.col(p)).alias("score"))
    if metric in RANKINGS:
        return RANKINGS[metric](df, y, p)
    raise ValueError(f"unknown metric {metric!r}; known: {sorted([*AGGREGATES, *RANKINGS])}")
