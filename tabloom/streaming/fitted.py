"""Transforms fitted on a batch and applied to streaming or batch frames alike.

Once fitted, scaling, filling, cyclical and calendar features and value lookups need no state: numbers become literals and
lookup tables a stream-static join, so the same object serves ``readStream`` frames without watermarks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import TrainTest
from ..functions.expr import ieee_div, known
from ..operators.columns import datetime_parser
from ..operators.medians import exact_medians


@dataclass(frozen=True)
class Fitted:
    """``kind`` of transform, and for each column its numbers from the train rows."""

    kind: str
    numbers: dict[str, tuple[float, ...]]

    def __call__(self, df: DataFrame) -> DataFrame:
        made = {}
        for c, v in self.numbers.items():
            x = known(df, c)
            if self.kind == "standerize":
                made[c] = (x - F.lit(v[0])) / F.lit(v[1] or 1.0)
            elif self.kind == "fillna":
                made[c] = F.coalesce(x.cast("double"), F.lit(v[0]))
            else:
                angle = ieee_div(F.lit(2 * math.pi) * x, F.lit(v[0]))
                made |= {f"{c}_cos": F.cos(angle), f"{c}_sin": F.sin(angle)}
        return df.select(*[made[c].alias(c) if c in made else F.col(f"`{c}`") for c in df.columns], *[e.alias(c) for c, e in made.items() if c not in df.columns])


def fit(train: DataFrame, columns: Sequence[str], kind: str, how: str = "median") -> Fitted:
    """``kind``: standerize, fillna (with ``how``) or circle; one action."""
    if kind == "fillna" and how == "median":
        row = exact_medians(train, {}, {f"x{i}": known(train, c) for i, c in enumerate(columns)}).first()
        return Fitted(kind, {c: (row[i],) for i, c in enumerate(columns)})
    takes = {"standerize": (F.avg, F.stddev_pop), "fillna": ({"mean": F.avg}.get(how),), "circle": (F.max,)}[kind]
    if None in takes:
        raise ValueError(f"how must be 'median' or 'mean', not {how!r}")
    row = train.agg(*[f(known(train, c).cast("double")).alias(f"x{i}_{k}") for i, c in enumerate(columns) for k, f in enumerate(takes)]).first()
    n = len(takes)
    return Fitted(kind, {c: tuple(row[n * i : n * i + n]) for i, c in enumerate(columns)})


def calendar(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return datetime_parser(TrainTest(df), columns).df


def lookup(df: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """The value of each row's key from a static table of distinct keys; null where it lacks the key."""
    return df.join(table.select(F.col(key).alias("_key"), value), F.col(key) == F.col("_key"), "left").drop("_key")
