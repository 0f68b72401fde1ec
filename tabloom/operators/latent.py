"""Latent features of category pairs: documents of co-occurring values, factorised by topic models or singular values."""

from __future__ import annotations

import itertools
import warnings
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.mllib.linalg import Vectors as OldVectors
from pyspark.mllib.linalg.distributed import IndexedRow, IndexedRowMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import TrainTest
from ..sources import io

Factor = Callable[[DataFrame, int], DataFrame]
SEED = 777
STEPS = 20
SMALL = 1024  # rows of the largest matrix of products that the driver solves: 8 MB


def token_counts(df: DataFrame, c1: str, c2: str) -> DataFrame:
    """doc, token, n: how often the tokens of c2's name and value come with each value of c1; only partial counts are shuffled.

    Tokens are lower-cased runs of two word characters or more."""
    text = F.lower(F.concat(F.lit(c2), F.col(f"`{c2}`").cast("string")))
    tokens = F.regexp_extract_all(text, F.lit(r"\b\w\w+\b"), 0)
    return df.where(F.col(f"`{c1}`").isNotNull()).select(F.col(f"`{c1}`").cast("long").alias("doc"), F.explode(tokens).alias("token")).groupBy("doc", "token").agg(F.count("*").alias("n"))


def counted(tokens: DataFrame) -> DataFrame:
    """doc and its sparse vector of true token counts over all tokens, in the order of their names; nothing is repeated or cut."""
    ranked = tokens.select("token").distinct().sort("token").rdd.map(lambda r: r[0]).zipWithIndex()
    vocabulary = tokens.sparkSession.createDataFrame(ranked, "token string, i long")
    width = vocabulary.count()
    if not width:
        raise ValueError("no tokens")
    cells = tokens.join(vocabulary, "token").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(F.col("i").cast("int").alias("i"), F.col("n").cast("double").alias("x")))).alias("t"))
    # the fields of a sparse vector, read back as one: no document passes through Python, however many tokens it has
    vector = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(width).cast("int").alias("size"), F.col("t.i").alias("indices"), F.col("t.x").alias("values"))
    path = io.scratch(tokens.sparkSession, "counts")
    cells.select("doc", vector.alias("counts")).write.parquet(path)
    return tokens.sparkSession.read.schema(T.StructType([T.StructField("doc", T.LongType()), T.StructField("counts", VectorUDT())])).parquet(path)


def topics_of(docs: DataFrame, k: int) -> LDAModel:
    """A topic model over all documents: each of the STEPS steps draws about as many documents as there are.

    MLlib draws with replacement, so that one step misses a document with a chance of 1/e and all of them with e^-20. Step
    sizes are (10 + step)^-0.7, the usual ones of an online model; MLlib's own are made for thousands of small steps."""
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions())
    docs = docs.repartition(parts, "doc").persist()  # each step reads the documents, which take more work than their bytes say
    model = LDA(k=k, optimizer="online", seed=SEED, featuresCol="counts", maxIter=STEPS, subsamplingRate=1.0, learningOffset=10.0, learningDecay=0.7).fit(docs)
    docs.unpersist()
    return model


def lda(docs: DataFrame, k: int) -> DataFrame:
    """doc and its distribution over k topics, single precision; an empty document has 1/k for each."""
    model = topics_of(docs, k)
    topics = vector_to_array(F.col("topicDistribution"))
    even = F.array(*[F.lit(1.0 / k)] * k)
    found = model.transform(docs).select("doc", F.when(F.aggregate(topics, F.lit(0.0), lambda a, x: a + x) > 0, topics).otherwise(even).alias("v"))
    return found.select("doc", F.col("v").cast("array<float>").alias("v"))


def blocks(indices, values, n: int):
    """(first row, rows of n numbers) of two list columns of an Arrow batch, at most 4 million numbers at a time."""
    ends, at, x = indices.offsets.to_numpy(), indices.values.to_numpy(), values.values.to_numpy()
    skew = values.offsets.to_numpy()[0] - ends[0]
    step = max(1, (1 << 22) // n)
    for lo in range(0, len(indices), step):
        part = ends[lo : lo + step + 1]
        rows = np.zeros((len(part) - 1, n))
        rows[np.repeat(np.arange(len(rows)), np.diff(part)), at[part[0] : part[-1]]] = x[part[0] + skew : part[-1] + skew]
        yield lo, rows


def _products(rows: DataFrame, n: int) -> np.ndarray:
    """The n x n sum of the products of each row with itself; rows hold indices below n and values. Tasks send partial sums, exact for counts."""

    def sums(batches):
        import pyarrow as pa

        total = np.zeros((n, n))
        for b in batches:
            for _, x in blocks(b.column(0), b.column(1), n):
                total += x.T @ x
        p, q = np.nonzero(np.triu(total))
        for lo in range(0, len(p), 10_000):
            at = p[lo : lo + 10_000], q[lo : lo + 10_000]
            yield pa.RecordBatch.from_pydict({"p": pa.array(at[0], pa.int32()), "q": pa.array(at[1], pa.int32()), "x": pa.array(total[at])})

    found = rows.select("indices", "values").mapInArrow(sums, "p int, q int, x double").groupBy("p", "q").agg(F.sum("x").alias("x")).toArrow()
    p, q, x = (found.column(c).to_numpy() for c in ("p", "q", "x"))
    out = np.zeros((n, n))
    out[p, q] = out[q, p] = x
    return out


def _directions(products: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, directions as columns) of the k largest, fewer if the rank is lower."""
    w, u = np.linalg.eigh(products)
    w, u = w[::-1][:k], u[:, ::-1][:, :k]
    real = w > w[0] * len(u) * 4 * np.finfo(float).eps
    return np.sqrt(w[real]), u[:, real]


def _first_largest(at: np.ndarray, v: np.ndarray) -> int:
    """Position of the entry of the lowest index among those that are largest but for rounding."""
    size = np.abs(v)
    top = np.flatnonzero(size >= size.max() * (1 - 1e-9))
    return int(top[at[top].argmin()])


def _signs(columns: DataFrame, n: int, u: np.ndarray) -> np.ndarray:
    """For each column of u the sign of the largest entry of its right vector; ``columns`` hold the counts of each token i."""

    def largest(batches):
        import pyarrow as pa

        for b in batches:
            i = b.column(0).to_numpy()
            for lo, x in blocks(b.column(1), b.column(2), n):
                v, own = x @ u, i[lo : lo + len(x)]
                top = [_first_largest(own, v[:, c]) for c in range(u.shape[1])]
                yield pa.RecordBatch.from_pydict({"c": pa.array(range(len(top)), pa.int32()), "i": pa.array(own[top], pa.int32()), "v": pa.array([float(v[t, c]) for c, t in enumerate(top)])})

    best = columns.select("i", "indices", "values").mapInArrow(largest, "c int, i int, v double").groupBy("c", F.signum("v").alias("sign")).agg(F.max_by(F.struct("i", "v"), F.struct(F.abs("v"), -F.col("i"))).alias("e")).collect()
    out = np.ones(u.shape[1])
    for c in range(u.shape[1]):
        mine = [r.e for r in best if r.c == c]
        out[c] = np.sign(mine[_first_largest(np.array([e.i for e in mine]), np.array([e.v for e in mine]))].v)
    return out


def _of_few_documents(docs: DataFrame, n: int, k: int) -> DataFrame:
    """The same as ``svd`` from the products of the documents with one another, exact with any number of tokens."""
    spark = docs.sparkSession
    names = [r.doc for r in docs.select("doc").sort("doc").collect()]
    place = spark.createDataFrame(list(zip(names, range(n), strict=True)), "doc long, j int")
    cells = docs.select("doc", sparse_parts(F.col("counts")).alias("u")).select("doc", F.explode(F.arrays_zip("u.indices", "u.values")).alias("e"))
    held = cells.join(F.broadcast(place), "doc").groupBy(F.col("e.indices").alias("i")).agg(F.collect_list(F.struct("j", F.col("e.values").alias("x"))).alias("t"))
    path = io.scratch(spark, "columns")
    held.select("i", F.col("t.j").alias("indices"), F.col("t.x").alias("values")).write.parquet(path)
    columns = spark.read.parquet(path)
    s, u = _directions(_products(columns, n), k)
    v = np.pad(u * s * _signs(columns, n, u), ((0, 0), (0, k - len(s))))
    return spark.createDataFrame([(d, list(map(float, x))) for d, x in zip(names, v, strict=True)], "doc long, v array<float>")


def svd(docs: DataFrame, k: int) -> DataFrame:
    """doc and its first k left singular directions times singular values, uncentred, single precision.

    The first of the largest entries of each right vector is made positive, so signs are determined. More components than the rank are 0.
    Where documents or tokens are at most SMALL, their products are summed and solved as they are, which has no steps that may fail to
    converge; otherwise MLlib's iterative solver is asked for more values than needed, as with few it turns in too small a space."""
    n, width = docs.agg(F.count("*"), F.max(sparse_parts(F.col("counts"))["size"])).first()
    if k > width:
        raise ValueError(f"{k} components of {width} tokens")
    if n < width and n <= SMALL:
        return _of_few_documents(docs, n, k)
    arrays = docs.select("doc", sparse_parts(F.col("counts")).alias("u")).select("doc", "u.indices", "u.values")
    if width <= SMALL:
        v = _directions(_products(arrays, width), k)[1]
    else:
        rows = docs.rdd.map(lambda r: IndexedRow(r[0], OldVectors.fromML(r[1]))).persist()  # each step of the solver reads them
        v = IndexedRowMatrix(rows).computeSVD(min(k + 20, width), computeU=False).V.toArray()[:, :k]
        rows.unpersist()
    v = v * np.sign([v[_first_largest(np.arange(width), c), j] for j, c in enumerate(v.T)])
    v = np.pad(v, ((0, 0), (0, k - v.shape[1])))
    right = docs.sparkSession.sparkContext.broadcast(v)  # tokens by k, as large as the vocabulary; computeSVD holds it as well

    def parts(batches):
        import pyarrow as pa

        for b in batches:
            i, x = b.column(1), b.column(2)
            got = np.zeros((b.num_rows, k), dtype=np.float32)
            for row in range(b.num_rows):
                got[row] = x[row].values.to_numpy() @ right.value[i[row].values.to_numpy()]
            yield pa.RecordBatch.from_pydict({"doc": b.column(0), "v": pa.array(list(got), pa.list_(pa.float32()))})

    return arrays.mapInArrow(parts, "doc long, v array<float>")


def sparse_parts(vector):
    """indices and values of a sparse vector column, as arrays."""
    return F.unwrap_udt(vector)


def latent_features(tt: TrainTest, columns: Sequence[str], n: int, factor: Factor, name: str, strict: bool = False) -> tuple[TrainTest, list[str]]:
    """(rows with ``<name><n>_<c1>_<c2>_<i>``, names of the new columns) for each ordered pair of the columns.

    c1 must hold non-negative integer codes. A pair that cannot be factorised is skipped with a warning, or raises if
    ``strict``; rows whose c1 is null have null features."""
    df, made = tt.df, []
    for c1, c2 in itertools.permutations(columns, 2):
        if not isinstance(tt.df.schema[c1].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            raise TypeError(f"{c1} must hold integer codes")
        try:
            found = factor(counted(token_counts(tt.df, c1, c2)), n)
            names = [f"{name}{n}_{c1}_{c2}_{i}" for i in range(n)]
            wide = found.select(F.col("doc").alias("__doc"), *[F.col("v")[i].alias(x) for i, x in enumerate(names)])
            df = df.join(wide, F.col(f"`{c1}`").cast("long") == F.col("__doc"), "left").drop("__doc")
            made += names
        except ValueError as e:  # a pair without tokens or with too few of them; a failed job is not one
            if strict:
                raise
            warnings.warn(f"{c1}, {c2} skipped: {e}", stacklevel=2)
    return TrainTest(df), made


def matrix_factorization(tt: TrainTest, encode_col: Sequence[str], n_components_lda: int = 5, n_components_svd: int = 3, strict: bool = False) -> TrainTest:
    """Topic and singular-value features of the columns, train and test together: first what was there, then SVD, then LDA."""
    with_svd, _ = latent_features(tt, encode_col, n_components_svd, svd, "CountSVD", strict)
    return latent_features(with_svd, encode_col, n_components_lda, lda, "CountLDA", strict)[0]
