"""Columns that can be deleted: constant, equal to an earlier column, or highly correlated with one."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import ROW_ID, SPLIT, TrainTest
from ..functions.expr import known


def _class(kind: T.DataType) -> str:
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return "number"
    return kind.simpleString()


def _as_value(df: DataFrame, c: str) -> Column:
    """Numbers and booleans compare as doubles, so 1, 1.0 and true are equal."""
    kind = df.schema[c].dataType
    return known(df, c).cast("double") if _class(kind) == "number" else F.col(f"`{c}`")


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the number of distinct known values of each column."""
    return df.select(*[F.count_distinct(known(df, c)).alias(c) for c in columns])


def unique_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with exactly one distinct known value; whether smallest and largest agree needs no distinct count."""
    ends = [f(F.struct(known(df, c).alias("v")) if not isinstance(df.schema[c].dataType, T.AtomicType) else known(df, c)) for c in columns for f in (F.min, F.max)]
    row = df.agg(*[e.alias(f"e{i}") for i, e in enumerate(ends)]).first()
    return [c for i, c in enumerate(columns) if row[2 * i] is not None and row[2 * i] == row[2 * i + 1]]


def duplicated_columns(df: DataFrame, columns: Sequence[str], row_id: str | None = None) -> list[str]:
    """Columns equal, row by row, to an earlier one of their type class; missing equals missing.

    One pass takes fingerprints (xor of a hash of row and value) and a second compares only columns whose fingerprints agree."""
    row = [F.col(row_id)] if row_id and row_id in df.columns else []
    prints = df.agg(*[F.bit_xor(F.xxhash64(*row, F.lit(_class(df.schema[c].dataType)), _as_value(df, c), F.col(f"`{c}`").isNull())).alias(f"x{i}") for i, c in enumerate(columns)]).first()
    groups: dict[tuple, list[str]] = {}
    for i, c in enumerate(columns):
        groups.setdefault((_class(df.schema[c].dataType), prints[i]), []).append(c)
    pairs = [(a, b) for g in groups.values() for i, b in enumerate(g) for a in g[:i]]
    if not pairs:
        return []
    same = df.agg(*[F.bool_and(_as_value(df, a).eqNullSafe(_as_value(df, b))).alias(f"s{i}") for i, (a, b) in enumerate(pairs)]).first()
    return [c for c in columns if any(b == c and same[i] is not False for i, (_, b) in enumerate(pairs))]


def _products(p: int, shift: list[float]):
    """Partial sums of one task over its rows, a row of arrays for each column: rows where both are known, sums and sums of squares
    of the column there, and sums of products. Memory is 32 bytes for each pair of columns, whatever the rows."""

    def part() -> int:
        from pyspark import TaskContext

        return TaskContext.get().partitionId() % 64

    def run(batches):
        import numpy as np
        import pyarrow as pa

        count, total, square, product = (np.zeros((p, p)) for _ in range(4))
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns]) - np.array(shift)
            here = ~np.isnan(x)
            x, m = np.where(here, x, 0.0), here.astype(np.float64)
            count += m.T @ m
            total += x.T @ m
            square += (x * x).T @ m
            product += x.T @ x
        sums = {"n": count, "s": total, "q": square, "c": product}
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(p), pa.int32()), "part": pa.array([part()] * p, pa.int32()), **{k: pa.array(list(v), pa.list_(pa.float64())) for k, v in sums.items()}})

    return run


def _added(rows):
    """The rows of one group, of one column, added up."""
    import numpy as np
    import pyarrow as pa

    sums = {k: np.sum([np.asarray(v.values) for v in rows.column(k)], axis=0) for k in ("n", "s", "q", "c")}
    return pa.table({k: pa.array([rows.column(k)[0].as_py()], pa.int32()) for k in ("i", "part")} | {k: pa.array([v], pa.list_(pa.float64())) for k, v in sums.items()})


def correlations(df: DataFrame, columns: Sequence[str]) -> dict[tuple[str, str], float | None]:
    """Pearson correlation of every pair, over rows where both are known; None if either is constant there or not finite.

    Each task multiplies the matrix of its rows, less the mean of each column, by itself and sends p rows of p sums, so neither
    the plan nor the rows shuffled grow with the number of pairs. Where a sum is too small to tell a constant from a small
    spread, smallest and largest value of that pair are compared."""
    if len(columns) < 2:
        return {}
    import numpy as np

    p, schema = len(columns), "i int, part int, n array<double>, s array<double>, q array<double>, c array<double>"
    x = [known(df, c).cast("double") for c in columns]
    ends = df.agg(*[f(v).alias(f"{k}{i}") for i, v in enumerate(x) for k, f in (("m", F.avg), ("a", F.min), ("b", F.max))]).first()
    shift = [m if m is not None and np.isfinite(m) else 0.0 for m in ends[::3]]
    varies = np.array([ends[3 * i + 1] != ends[3 * i + 2] for i in range(p)])
    numbers = df.select(*[v.alias(f"x{i}") for i, v in enumerate(x)])
    partial = numbers.mapInArrow(_products(p, shift), schema).groupBy("i", "part").applyInArrow(_added, schema)
    parts = partial.groupBy("i").applyInArrow(_added, schema).collect()  # p rows; 64 groups each before that
    n, s, q, c = (np.array([r[k] for r in sorted(parts, key=lambda r: r.i)]).reshape(-1, p) for k in ("n", "s", "q", "c"))
    if not len(n):
        return dict.fromkeys(((a, b) for a in columns for b in columns if a != b))
    with np.errstate(all="ignore"):
        spread = np.where(varies[:, None], q - s * s / n, 0.0)
        doubtful = [(i, j) for i, j in np.argwhere((spread <= 1e-9 * q) & varies[:, None] & varies[None, :] & (n > 0)) if i != j]
        for at in range(0, len(doubtful), 100):
            some = doubtful[at : at + 100]
            row = df.agg(*[(F.min(y) < F.max(y)).alias(f"d{k}") for k, (i, j) in enumerate(some) for y in [F.when(x[j].isNotNull(), x[i])]]).first()
            for (i, j), differs in zip(some, row, strict=True):
                spread[i, j] = spread[i, j] if differs else 0.0
        r = (c - s * s.T / n) / np.sqrt(np.where((spread > 0) & (spread.T > 0), spread * spread.T, np.nan))
    return {(a, b): float(r[i, j]) if np.isfinite(r[i, j]) else None for i, a in enumerate(columns) for j, b in enumerate(columns) if i != j}


def high_correlation_columns(df: DataFrame, columns: Sequence[str], limit: float) -> list[str]:
    """One pass in column order: a column that is still there takes all that correlate with it above ``limit`` with it, earlier
    survivors included; a missing correlation is none."""
    numbers = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]
    above = {pair for pair, r in correlations(df, numbers).items() if r is not None and r > limit}
    left, dropped = list(numbers), []
    for keeper in numbers:
        if keeper in left:
            dropped += [c for c in left if (keeper, c) in above]
            left = [c for c in left if (keeper, c) not in above]
    return dropped


def detect_delete_cols(tt: TrainTest, escape_col: Iterable[str], threshold: float) -> tuple[list[str], list[str], list[str]]:
    """(constant, duplicated, highly correlated) columns of the train rows; ``escape_col`` is left out of the last.

    A column that is no number is skipped by the correlation scan, which goes on with the others."""
    df, columns = tt.train_rows, tt.columns
    row_id = ROW_ID if ROW_ID in tt.df.columns else None
    escape = {*escape_col, SPLIT, ROW_ID}
    return unique_columns(df, columns), duplicated_columns(df, columns, row_id), high_correlation_columns(df, [c for c in columns if c not in escape], threshold)
