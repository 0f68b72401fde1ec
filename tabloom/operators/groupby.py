"""Grouped aggregates joined back to rows, with difference and ratio features."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import TrainTest
from ..functions.expr import ieee_div, known
from .medians import exact_medians

MEDIAN = "median"  # made apart from the others: see medians
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),  # of a group without a known value: 0
    "min": F.min,
    "max": F.max,
    "var": F.var_samp,
    "std": F.stddev_samp,
    "nunique": F.count_distinct,
    "count": F.count,
    "size": lambda _: F.count("*"),
    "first": lambda c: F.first(c, ignorenulls=True),
    "last": lambda c: F.last(c, ignorenulls=True),
    "skew": F.skewness,
    "any": lambda c: F.max(c.cast("boolean")),
    "all": lambda c: F.min(c.cast("boolean")),
}


@dataclass(frozen=True)
class GroupSpec:
    """Aggregates ``aggs`` of ``vars`` by ``keys``; joined on ``on`` if given, else on the keys. An aggregate is a name or a
    grouped-aggregate function (a pandas UDF, or one from column to column) that has a ``__name__``."""

    keys: tuple[str, ...]
    vars: tuple[str, ...]
    aggs: tuple[str | Callable, ...]
    on: tuple[str, ...] = ()
    allow_fanout: bool = False

    @classmethod
    def of(cls, spec: GroupSpec | dict) -> GroupSpec:
        if isinstance(spec, GroupSpec):
            return spec
        many = lambda x: tuple(x) if isinstance(x, (list, tuple)) else (x,)
        return cls(many(spec["key"]), many(spec["var"]), many(spec["agg"]), many(spec["on"]) if spec.get("on") else ())

    def names(self) -> list[tuple[str, str, str | Callable]]:
        """(feature, variable, aggregate), the variables outermost."""
        tail = "_".join(self.keys)
        return [(f"{a if isinstance(a, str) else a.__name__}_{v}_groupby_{tail}", v, a) for v in self.vars for a in self.aggs]


def _aggregate(df: DataFrame, var: str, agg: str | Callable) -> Column:
    if callable(agg):
        return agg(F.col(f"`{var}`"))
    if agg not in AGGREGATES:
        raise ValueError(f"unknown aggregate {agg!r}; known: {sorted([*AGGREGATES, MEDIAN])}")
    return AGGREGATES[agg](known(df, var))


@dataclass
class _Plan:
    keys: tuple[str, ...]
    on: tuple[str, ...]
    fanout: bool
    columns: dict[str, tuple[str, str | Callable]] = field(default_factory=dict)


def _aggregated(df: DataFrame, plan: _Plan) -> DataFrame:
    """One row for each group, keys as ``__<key>``; medians are joined to the other aggregates."""
    keys = {f"__{k}": known(df, k) for k in plan.keys}
    middle = {n: known(df, v) for n, (v, a) in plan.columns.items() if a == MEDIAN}
    others = [_aggregate(df, v, a).alias(n) for n, (v, a) in plan.columns.items() if a != MEDIAN]
    if not middle:
        return df.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(*others)
    medians = exact_medians(df, keys, middle)
    if not others:
        return medians
    medians = medians.withColumnsRenamed({k: f"_{k}" for k in keys})
    both = df.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(*others)
    match = [F.col(f"`{k}`").eqNullSafe(F.col(f"`_{k}`")) for k in keys]
    return both.join(medians, match, "left").drop(*[f"_{k}" for k in keys]).select(*keys, *plan.columns)


def groupby_features(df: DataFrame, specs: Sequence[GroupSpec | dict]) -> DataFrame:
    """``df`` with a column ``<agg>_<var>_groupby_<keys>`` for each aggregate.

    Specs with the same keys are fused into one aggregation and a feature asked for twice is made once. Only partial
    aggregates are shuffled; they are joined back from the left, so rows with a null key get nulls and all rows stay. The
    optimizer broadcasts a small aggregate at run time; no hint is given, as its size is that of the key's values."""
    plans: dict[tuple, _Plan] = {}
    for spec in map(GroupSpec.of, specs):
        on = spec.on or spec.keys
        if not set(on) <= set(spec.keys):
            raise ValueError(f"on {on} must be among the keys {spec.keys}")
        if set(on) != set(spec.keys) and not spec.allow_fanout:
            raise ValueError(f"joining {spec.keys} on {on} repeats rows; set allow_fanout to accept that")
        plan = plans.setdefault((spec.keys, on), _Plan(spec.keys, on, spec.allow_fanout))
        plan.columns |= {name: (v, a) for name, v, a in spec.names()}
    out = df
    for plan in plans.values():
        aggregated = _aggregated(df, plan)
        aggregated = aggregated.drop(*[f"__{k}" for k in plan.keys if k not in plan.on])
        match = [known(df, k) == F.col(f"`__{k}`") for k in plan.on]
        joined = out.join(aggregated, match[0] if len(match) == 1 else [m for m in match], "left")
        out = joined.drop(*[f"__{k}" for k in plan.on])
    return out


def _from_base(df: DataFrame, specs: Sequence[GroupSpec | dict], prefix: str, make: Callable[[Column, Column], Column]) -> DataFrame:
    made = {}
    for spec in map(GroupSpec.of, specs):
        for name, v, _ in spec.names():
            if name not in df.columns:
                raise KeyError(f"{name} is missing; make the grouped aggregates first")
            made[f"{prefix}_{name}"] = make(F.col(f"`{name}`"), known(df, v))
    return df.select("*", *[c.alias(n) for n, c in made.items()])


def diff_features(df: DataFrame, specs: Sequence[GroupSpec | dict]) -> DataFrame:
    """``diff_<feature>``: the aggregate less the row's value."""
    return _from_base(df, specs, "diff", lambda base, value: base - value)


def ratio_features(df: DataFrame, specs: Sequence[GroupSpec | dict]) -> DataFrame:
    """``ratio_<feature>``: the row's value over the aggregate."""
    return _from_base(df, specs, "ratio", lambda base, value: ieee_div(value, base))


def aggregation(tt: TrainTest, groupby_dict: Sequence[GroupSpec | dict], nunique_dict: Sequence[GroupSpec | dict]) -> TrainTest:
    """Distinct counts and aggregates of train and test together, then differences and ratios of the latter."""
    df = groupby_features(tt.df, [*nunique_dict, *groupby_dict])
    return TrainTest(ratio_features(diff_features(df, groupby_dict), groupby_dict))
