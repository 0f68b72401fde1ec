"""Language identification by a string kernel: blended-spectrum presence, Nyström landmarks, kernel ridge regression.

The kernel of two texts is the number of distinct byte n-grams (orders 1 to 3 of the lower-cased UTF-8) that both have,
over the root of the product of their numbers of distinct n-grams. m landmark texts give the features
K(x, landmarks) K(landmarks, landmarks)^-1/2; one-versus-rest ridge regression on them is solved in closed form. For
scoring, landmarks, whitening and weights are multiplied out to one matrix of n-grams by languages, so a batch of texts
is one product of its sparse presence rows with that matrix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

BASES = (0, 1 << 8, (1 << 8) + (1 << 16))  # where the codes of each order begin


def grams(text: str) -> np.ndarray:
    """Sorted codes of the distinct n-grams of the whole text."""
    b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.int32)
    two = (b[:-1] << 8) + b[1:]
    three = (two[:-1] << 8) + b[2:] if len(b) > 2 else b[:0]
    # n-grams present are few, so each order is made distinct by itself
    return np.concatenate([np.unique(b) + BASES[0], np.unique(two) + BASES[1], np.unique(three) + BASES[2]])


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # sorted n-grams of the landmarks
    weights: np.ndarray  # n-grams by languages
    bias: np.ndarray

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        """Regression values, a row for each set of n-grams: one batched sparse product."""
        if not sets:
            return np.zeros((0, len(self.languages)))
        sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        at = np.searchsorted(self.codes, flat)
        known = self.codes[np.minimum(at, len(self.codes) - 1)] == flat
        owner = np.repeat(np.arange(len(sets)), sizes)[known]
        row = at[known]
        # a column at a time: the working memory is that of the batch's n-grams, however many languages there are
        out = np.stack([np.bincount(owner, self.weights[row, k], minlength=len(sets)) for k in range(self.weights.shape[1])], axis=1)
        return out / np.sqrt(np.maximum(sizes, 1))[:, None] + self.bias


def _incidence(sets: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(codes)), np.float32)
    for i, s in enumerate(sets):
        at = np.searchsorted(codes, s)
        ok = codes[np.minimum(at, len(codes) - 1)] == s
        out[i, at[ok]] = 1 / np.sqrt(max(len(s), 1))
    return out


def fit(sets: list[np.ndarray], langs: list[str], landmarks: int = 160, ridge: float = 1e-3, block: int = 256) -> Model | None:
    """None if there is nothing to learn from. Landmarks are taken from each language in turn, at least one from each."""
    if not sets:
        return None
    names = sorted(set(langs))
    by = {x: [i for i, y in enumerate(langs) if y == x] for x in names}
    picked = [by[x][k] for k in range(max(map(len, by.values()))) for x in names if k < len(by[x])][: max(landmarks, len(names))]
    codes = np.unique(np.concatenate([sets[i] for i in picked]))
    base = _incidence([sets[i] for i in picked], codes)
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    keep = values > values[-1] * 1e-6
    white = vectors[:, keep] / np.sqrt(values[keep])
    y = np.array([[1.0 if a == b else -1.0 for b in names] for a in langs])
    phi = np.concatenate([_incidence(sets[i : i + block], codes) @ base.T for i in range(0, len(sets), block)]) @ white
    share = np.array([len(by[a]) for a in langs])
    w = (1 / share / len(names))[:, None]  # each language weighs the same
    mean, centre = (w * phi).sum(0), (w * y).sum(0)
    a = (phi - mean).T @ (w * (phi - mean))
    beta = np.linalg.solve(a + ridge * np.trace(a) / len(a) * np.eye(len(a)), (phi - mean).T @ (w * (y - centre)))
    return Model(names, codes, (base.T @ (white @ beta)).astype(np.float64), centre - mean @ beta)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def training_sets(docs: DataFrame, per_language: int, most_languages: int, id_col: str, text_col: str, lang_col: str) -> tuple[list[np.ndarray], list[str]]:
    """N-gram sets of at most about ``per_language`` rows of each language, by a hash of the id, made on the executors."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~F.coalesce(held_out(F.col(id_col)), F.lit(False)))
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(most_languages).collect()}
    if not counts:
        return [], []
    u = (F.pmod(F.xxhash64(F.lit("sample"), id_col), F.lit(1 << 30)) / float(1 << 30)).alias("u")
    chance = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(per_language / n))])
    picked = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), u).where(F.col("u") < F.element_at(chance, F.col("lang"))).select("lang", "text")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            made = [grams(t.as_py()).astype("<i4").tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_pydict({"lang": b.column(0), "codes": pa.array(made, pa.binary())})

    got = picked.mapInArrow(run, "lang string, codes binary").limit(2 * per_language * len(counts)).collect()
    got.sort(key=lambda r: (r[0], r[1]))
    return [np.frombuffer(r[1], "<i4") for r in got], [r[0] for r in got]


def identify(docs: DataFrame, per_language: int = 400, most_languages: int = 200, landmarks: int = 160, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row.

    The model is fitted on the driver on a bounded sample: about ``per_language`` labelled rows, never held-out ones, of each
    of the ``most_languages`` most frequent languages. Prediction sees the text alone and covers all of it. ``lang_pred`` is
    ``und`` with score 0 where the text is null or has no letters, and everywhere if no labelled row exists; else ``score`` is
    the share of the best language in the softmax of four times the regression values. A null doc_id is not held out."""
    spark = docs.sparkSession
    shared.bounded_batches(spark)
    sets, langs = training_sets(docs, per_language, most_languages, id_col, text_col, lang_col)
    held = spark.sparkContext.broadcast(fit(sets, langs, landmarks))

    def run(batches):
        import pyarrow as pa

        model = held.value
        for b in batches:
            n = b.num_rows
            pred, score = ["und"] * n, np.zeros(n)
            for lo in range(0, n, 200):  # bounded working memory; texts may be long
                texts = [t.as_py() for t in b.column(2).slice(lo, 200)]
                use = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
                if use:
                    s = 4 * model.scores([grams(texts[i]) for i in use])
                    p = np.exp(s - s.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    for i, k, v in zip(use, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                        pred[lo + i], score[lo + i] = model.languages[k], v
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
