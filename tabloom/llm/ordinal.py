"""Quality classification by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features serves all grades; ordered thresholds turn its value into the cumulative
probabilities P(grade <= k) = sigmoid(threshold_k - value). From these come the expected grade and the tail probability
used for selection.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

DIMENSIONS = 1 << 18
_STRIP = ".,;:!?\"'()[]{}|*#%&"


class _Features(dict):
    """Raw token -> (number of its word, number of its shape); emptied when full."""

    def __missing__(self, token: str) -> tuple[int, int]:
        word = token.strip(_STRIP).lower()
        case = "u" if token.isupper() and len(token) > 1 else "d" if any(c.isdigit() for c in token) else "t" if token[:1].isupper() else "l"
        shape = f"\1{case}{token[-2:] if token and not token[-1].isalnum() else ''}{token[:1] if token and not token[0].isalnum() else ''}"
        out = (zlib.crc32(word.encode("utf-8", "surrogatepass")) % DIMENSIONS, zlib.crc32(shape.encode("utf-8", "surrogatepass")) % DIMENSIONS)
        if len(token) <= 64:
            if len(self) >= 200_000:
                self.clear()
            self[token] = out
        return out


_CACHE = _Features()


def features(text: str | None) -> np.ndarray:
    """Sorted numbers of the features present in the whole text: words, token shapes and the levels of five ratios."""
    tokens = (text or "").split()
    distinct = set(tokens)
    n = max(len(tokens), 1)
    pairs = list(map(_CACHE.__getitem__, distinct))
    out = {p[0] for p in pairs}
    out.update(p[1] for p in pairs)
    odd = sum(t.isupper() and len(t) > 1 for t in distinct) / max(len(distinct), 1)
    marked = sum(not t[-1].isalnum() for t in distinct) / max(len(distinct), 1)
    lone = sum(len(t) == 1 and not t.isalnum() for t in tokens) / n
    level = {"distinct": int(10 * len(distinct) / n), "upper": int(5 * odd), "marked": int(5 * marked), "lone": int(10 * lone), "size": min(n.bit_length(), 16)}
    out.update(zlib.crc32(f"\2{k}{v}".encode()) % DIMENSIONS for k, v in level.items())
    return np.sort(np.fromiter(out, np.int32, len(out)))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than the grades

    def value(self, sets: list[np.ndarray]) -> np.ndarray:
        if not sets:
            return np.zeros(0)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        return np.bincount(owner, self.weights[np.concatenate(sets)], minlength=len(sets))

    def tails(self, value: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1 on, a column for each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - value[:, None], -50, 50)))


def fit(sets: list[np.ndarray], grades: np.ndarray, levels: int, steps: int = 250, ridge: float = 4.0, least_rows: int = 4, rate: float = 0.15) -> Model | None:
    """Penalised maximum likelihood by AdaGrad over all rows at once; features in fewer than ``least_rows`` rows have weight 0.

    Thresholds are a first one and positive gaps (their logarithms are fitted), so they stay ordered. None if fewer than two
    grades occur."""
    grades = np.asarray(grades)
    if len(set(grades.tolist())) < 2:
        return None
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    df = np.bincount(flat, minlength=DIMENSIONS)
    used = np.flatnonzero((df >= least_rows) & (df < len(sets)))
    where = np.full(DIMENSIONS, -1)
    where[used] = np.arange(len(used))
    col = where[flat]
    col, owner = col[col >= 0], owner[col >= 0]
    n, k = len(sets), levels - 1
    share = np.bincount(grades, minlength=levels) + 0.5
    below = np.cumsum(share)[:-1] / share.sum()
    cut = np.log(below / (1 - below))
    free = np.concatenate([cut[:1], np.log(np.maximum(np.diff(cut), 1e-2))])
    w, sw, sf = np.zeros(len(used)), np.zeros(len(used)), np.zeros(k)
    for _ in range(steps):
        cuts = np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])
        value = np.bincount(owner, w[col], minlength=n)
        z = np.concatenate([np.full((n, 1), -50.0), cuts[None, :] - value[:, None], np.full((n, 1), 50.0)], axis=1)
        s = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        hi, lo = s[np.arange(n), grades + 1], s[np.arange(n), grades]
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p  # derivatives of log p by the upper and lower cut
        gw = np.bincount(col, (dhi - dlo)[owner], minlength=len(used)) + ridge * w  # of minus the likelihood
        gc = np.array([dlo[grades == j + 1].sum() - dhi[grades == j].sum() for j in range(k)])
        gf = np.concatenate([[gc.sum()], [gc[j:].sum() * np.exp(free[j]) for j in range(1, k)]])
        sw += gw * gw
        sf += gf * gf
        w -= rate * gw / np.sqrt(sw + 1e-8)
        free = free - rate * gf / np.sqrt(sf + 1e-8)
    weights = np.zeros(DIMENSIONS)
    weights[used] = w
    return Model(weights, np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))]))


def grade(quality: Column, toxic: Column) -> Column:
    """0 toxic, 1 poor, 2 good; null where a needed rating is missing."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when((quality == 1) & (toxic == 0), 2)


def train(docs: DataFrame, ratings: DataFrame, levels: int = 3, most_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text", **how) -> Model | None:
    """Fit on at most ``most_rows`` rated documents (ratings: ``doc_id`` and integer ``grade``), chosen by a hash of the id.

    Their features are made on the executors; only feature numbers reach the driver."""
    ratings = ratings.where(F.col("grade").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("rated"), F.col("grade").cast("int").alias("grade"))
    ratings = ratings.groupBy("rated").agg(F.min("grade").alias("grade"))  # of several ratings of a document the lowest counts
    picked = ratings.orderBy(F.xxhash64(F.lit("rated"), "rated"), "rated").limit(most_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("rated"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "rated")  # at most ``most_rows`` narrow rows

    shared.bounded_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"rated": b.column(0), "grade": b.column(1), "f": pa.array([features(t.as_py()).tobytes() for t in b.column(2)], pa.binary())})

    got = rows.select("rated", "grade", "text").mapInArrow(run, "rated long, grade int, f binary").limit(2 * most_rows).collect()
    got.sort()
    if not got:
        return None
    model = fit([np.frombuffer(r[2], np.int32) for r in got], np.array([r[1] for r in got]), levels, **how)
    del got
    shared.trim(encoders=False)
    return model


def score(docs: DataFrame, model: Model | None, keep_at: float = 0.5, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, expected_grade, tail_1, tail_2, ..., keep; with ``carry`` all columns of ``docs`` and then ``keep`` instead.

    ``tail_k`` is P(grade >= k); ``keep`` says that the last one, P(best grade), is at least ``keep_at``. A null or empty text
    has the features of no words. Without a model (no rated rows, or of one grade alone) the scores are null and all rows
    are kept."""
    from pyspark.sql import types as T

    shared.bounded_batches(docs.sparkSession)
    levels = 1 + (len(model.thresholds) if model is not None else 2)
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = ["expected_grade", *[f"tail_{k}" for k in range(1, levels)], "keep"]
    own = docs if carry else docs.select(F.col(id_col).cast("long").alias("doc_id"))
    held_text = carry and dict(docs.dtypes).get(text_col) == "string"  # then the text is sent to Python once
    at = docs.columns.index(text_col) if held_text else len(own.columns)
    kept = [F.col(f"`{c}`") for c in docs.columns] if carry else [F.col(id_col).cast("long").alias("doc_id")]
    rows = docs if held_text else docs.select(*kept, F.col(text_col).cast("string").alias(shared.fresh("text", docs)))
    made = [shared.fresh("keep", docs)] if carry else names
    columns, width = [*own.columns, *made], len(own.columns)
    schema = T.StructType([*own.schema.fields, *[T.StructField(c, T.BooleanType() if c == made[-1] else T.DoubleType()) for c in made]])

    def run(batches):
        import pyarrow as pa

        model = held.value
        for b in batches:
            n, column = b.num_rows, b.column(at)
            tails = np.zeros((n, levels - 1))
            if model is not None:
                for lo in range(0, n, 500):
                    tails[lo : lo + 500] = model.tails(model.value([features(t.as_py()) for t in column.slice(lo, 500)]))
            keep = pa.array(tails[:, -1] >= keep_at if model is not None else np.ones(n, bool))
            numbers = [pa.array(x) if model is not None else pa.nulls(n, pa.float64()) for x in (tails.sum(1), *tails.T)]
            out = [keep] if carry else [*numbers, keep]
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *out], columns)
        _CACHE.clear()
        shared.trim()

    return rows.mapInArrow(run, schema)


def select(docs: DataFrame, model: Model | None, keep_at: float = 0.5, **cols) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with the columns of ``docs``."""
    scored = score(docs, model, keep_at, carry=True, **cols)
    return scored.where(F.col(scored.columns[-1])).drop(scored.columns[-1])
