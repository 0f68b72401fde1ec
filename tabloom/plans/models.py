"""Model wrappers with one contract: ``train(tr, va)``, ``predict(df)``, ``predicted(df)``, ``save(path)``, ``load(path)``.

Frames have ``_row_id``, ``y`` and the feature columns; predictions are (_row_id, pred), or a column beside the rows. Estimators are Spark's own, so a fit
is distributed. Where the usual library is absent the nearest MLlib estimator stands in, and parameters keep their names.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from typing import Any, ClassVar

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import ROW_ID
from ..functions import metrics
from ..functions.expr import known
from ..sources import io

Y, PRED, VALID, KEPT = "y", "pred", "_valid", "_kept"
ROWS, QUERIES = 512, 128  # rows and queries that a Python worker compares at a time: 0.5 MB of distances
# Parameters about messages, files and machines, which change no result, and names of the usual metric and method.
NO_EFFECT = frozenset({"verbosity", "verbose", "silent", "allow_writing_files", "task_type", "n_jobs", "nthread", "num_threads", "thread_count", "metric", "eval_metric", "boosting", "boosting_type", "booster"})


class Model:
    """Base: feature assembly, saving and loading of a Spark pipeline.

    Numbers are taken as doubles with ``missing`` for nulls; strings and ``categorical`` columns are indexed, unseen values
    getting an index of their own."""

    missing: ClassVar[float] = -999.0

    def __init__(self, name: str, params: dict[str, Any] | None = None, categorical: Sequence[str] = ()):
        self.name, self.params, self.categorical = name, dict(params or {}), tuple(categorical)
        self.features: list[str] = []
        self.model: PipelineModel | None = None

    # what a subclass says
    def estimator(self) -> Any:
        raise NotImplementedError

    def prediction(self, df: DataFrame) -> Column:
        return F.col("prediction")

    uses_validation: ClassVar[bool] = False

    # shared
    def _inputs(self, df: DataFrame) -> tuple[DataFrame, list, list[str]]:
        stages, names, cols = [], [], []
        for c in self.features:
            kind = df.schema[c].dataType
            if isinstance(kind, T.StringType) or c in self.categorical:
                cols.append(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")).alias(f"c_{c}"))
                stages.append(StringIndexer(inputCol=f"c_{c}", outputCol=f"i_{c}", handleInvalid="keep", stringOrderType="alphabetAsc"))
                names.append(f"i_{c}")
            else:
                cols.append(F.coalesce(known(df, c).cast("double"), F.lit(self.missing)).alias(f"n_{c}"))
                names.append(f"n_{c}")
        keep = [x for x in (ROW_ID, Y, VALID, KEPT) if x in df.columns]
        return df.select(*keep, *cols), stages, names

    def _bins(self, df: DataFrame) -> int:
        """Room for the largest category in a tree's split search."""
        cats = [c for c in self.features if isinstance(df.schema[c].dataType, T.StringType) or c in self.categorical]
        if not cats:
            return 32
        return max(32, 2 + max(df.agg(*[F.count_distinct(F.col(f"`{c}`")) for c in cats]).first()))

    def train(self, tr: DataFrame, va: DataFrame | None = None) -> Model:
        self.features = [c for c in tr.columns if c not in (ROW_ID, Y, VALID)]
        rows = tr.withColumn(VALID, F.lit(False))
        if va is not None and self.uses_validation:
            rows = rows.unionByName(va.select(*tr.columns).withColumn(VALID, F.lit(True)))
        self._max_bins = self._bins(rows)
        self._validated = va is not None and self.uses_validation
        inputs, stages, names = self._inputs(rows.withColumn(Y, F.col(Y).cast("double")))
        self.model = Pipeline(stages=[*stages, VectorAssembler(inputCols=names, outputCol="features"), self.estimator()]).fit(inputs)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return self._predicted(df).select(ROW_ID, PRED)

    def predicted(self, df: DataFrame, name: str = PRED) -> DataFrame:
        """``df`` with the predictions as a column of that name; rows stay where they are, nothing is joined."""
        kept = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != name]).alias(KEPT)
        return self._predicted(df.select("*", kept)).select(f"{KEPT}.*", F.col(PRED).alias(name))

    def _predicted(self, df: DataFrame) -> DataFrame:
        """Row id, what is kept, if anything, and the prediction."""
        out = self.model.transform(self._inputs(df)[0])
        return out.select(ROW_ID, *[c for c in (KEPT,) if c in df.columns], self.prediction(out).alias(PRED))

    def save(self, path: str) -> None:
        io.save_model(self.model, f"{path}/model")
        io.write_json(self._spark(), {"features": self.features, "params": self.params, "categorical": self.categorical}, f"{path}/about.json")

    def load(self, path: str) -> Model:
        about = io.read_json(self._spark(), f"{path}/about.json")
        self.features, self.categorical = about["features"], tuple(about["categorical"])
        self.model = PipelineModel.load(f"{path}/model")
        return self

    @staticmethod
    def _spark():
        from pyspark.sql import SparkSession

        return SparkSession.getActiveSession()

    def importance(self) -> dict[str, float] | None:
        """Feature -> importance; None where the model has none."""
        last = self.model.stages[-1]
        values = last.featureImportances if hasattr(last, "featureImportances") else getattr(last, "coefficients", None)
        return None if values is None else dict(zip(self.features, map(float, values.toArray()), strict=True))

    #: Parameters that the model follows, beside those that change no result.
    honoured: ClassVar[frozenset[str]] = frozenset()

    def not_honoured(self) -> list[str]:
        """Parameters given that this model does not follow."""
        return sorted(set(self.params) - self.honoured - NO_EFFECT)

    def _get(self, *names: str, default: Any) -> Any:
        return next((self.params[n] for n in names if n in self.params), default)


def _positive(_: DataFrame) -> Column:
    return vector_to_array(F.col("probability"))[1]


def _depth(depth: int | None, leaves: int = 31) -> int:
    return min(int(depth), 30) if depth is not None and int(depth) > 0 else max(1, min(int(leaves) - 1, 30))


def _share(fraction: float) -> str:
    return "all" if float(fraction) >= 1 else str(float(fraction))


class _Boosted(Model):
    """Gradient-boosted trees. With validation rows training ends at the round that no longer improves on them, without the
    patience of ``early_stopping_rounds``; as many rounds as configured are trained otherwise. A depth of zero or less is
    unlimited elsewhere; here it is what ``num_leaves`` can need, 30 at most, which is the deepest tree there is.
    ``feature_fraction`` is drawn for each node. ``build`` warns of parameters that are not followed."""

    honoured = frozenset({"objective", "loss_function", "num_boost_round", "iterations", "n_estimators", "num_round", "max_depth", "depth", "learning_rate", "eta", "bagging_fraction", "subsample", "seed", "random_seed", "random_state", "feature_fraction", "colsample_bytree", "min_data_in_leaf", "min_child_samples"})
    uses_validation = True
    classify: bool | None = None  # None: by the objective in the parameters

    def _classifies(self) -> bool:
        if self.classify is not None:
            return self.classify
        return str(self._get("objective", "loss_function", default="regression")).lower().startswith(("binary", "logloss", "cross"))

    def estimator(self):
        kind = GBTClassifier if self._classifies() else GBTRegressor
        est = kind(
            featuresCol="features",
            labelCol=Y,
            maxIter=int(self._get("num_boost_round", "iterations", "n_estimators", "num_round", default=20)),
            maxDepth=_depth(self._get("max_depth", "depth", default=5), self._get("num_leaves", default=31)),
            minInstancesPerNode=int(self._get("min_data_in_leaf", "min_child_samples", default=1)),
            featureSubsetStrategy=_share(self._get("feature_fraction", "colsample_bytree", default=1.0)),
            stepSize=float(self._get("learning_rate", "eta", default=0.1)),
            subsamplingRate=float(self._get("bagging_fraction", "subsample", default=1.0)),
            seed=int(self._get("seed", "random_seed", "random_state", default=777)),
            maxBins=self._max_bins,
        )
        return est.setValidationIndicatorCol(VALID) if self._validated else est

    def prediction(self, df: DataFrame) -> Column:
        return _positive(df) if self._classifies() else F.col("prediction")


class ModelLGBM(_Boosted):
    pass


class ModelXGB(_Boosted):
    pass


class ModelCatClassifier(_Boosted):
    classify = True


class ModelCatRegressor(_Boosted):
    classify = False


class ModelOptunaLGBM(_Boosted):
    """Boosting tuned step by step: depth first, then rate, then sampling, each by the metric on the validation rows."""

    steps: ClassVar[dict[str, tuple]] = {"max_depth": (3, 5, 7), "learning_rate": (0.05, 0.1, 0.2), "bagging_fraction": (0.7, 1.0)}

    def train(self, tr: DataFrame, va: DataFrame | None = None) -> Model:
        if va is None:
            raise ValueError("tuning needs validation rows")
        metric = "log_loss" if self._classifies() else "rmse"
        best, trials = None, []
        tr, va = tr.persist(), va.persist()
        for key, values in self.steps.items():
            for v in values:
                trial = _Boosted(self.name, {**self.params, **({} if best is None else best[1]), key: v}, self.categorical)
                trial.classify = self.classify
                trial.train(tr, va)
                score = metrics.evaluate(trial.predict(va).join(va.select(ROW_ID, Y), ROW_ID), metric).first()[0]
                chosen = {**({} if best is None else best[1]), key: v}
                trials.append((score, chosen))
                if best is None or score < best[0]:
                    best = (score, chosen, trial)
        tr.unpersist()
        va.unpersist()
        self.best_params, self.trials = best[1], trials
        self.model, self.features = best[2].model, best[2].features
        return self

    def save_best(self, path: str) -> None:
        io.write_json(self._spark(), self.best_params, path)


class ModelFocalLGBM(Model):
    """Boosting of regression trees on the gradient of the focal loss; predictions are raw margins.

    Each round fits a tree to gradient over hessian of the rows, weighted by the hessian, both in closed form. Margins
    are rewritten to a checkpoint every few rounds, so plans stay short. A callable ``objective`` takes the place of the
    loss: from target and margin columns it gives (loss, first, second derivative by the margin). A callable ``feval`` gives
    an aggregate of both columns, the smaller the better; without one it is the mean loss. With validation rows and
    ``early_stopping_rounds`` training ends after so many rounds without a better value, and the best round's trees stay."""

    honoured = frozenset({"objective", "feval", "early_stopping_rounds", "num_boost_round", "learning_rate", "max_depth", "num_leaves", "seed", "random_state"})
    alpha: ClassVar[float] = 0.25
    gamma: ClassVar[float] = 1.0

    @classmethod
    def loss_gradient(cls, y: Column, m: Column) -> tuple[Column, Column, Column]:
        """(loss, first, second derivative by the margin) with the loss -a_t (1 - p_t)^g log p_t."""
        s = F.when(y == 1, 1.0).otherwise(-1.0)
        a, g = F.when(y == 1, cls.alpha).otherwise(1 - cls.alpha), cls.gamma
        q = F.least(F.greatest(1 / (1 + F.exp(-s * m)), F.lit(1e-12)), F.lit(1 - 1e-12))  # p_t
        r, lq = 1 - q, F.log(q)
        loss = -a * F.pow(r, F.lit(g)) * lq
        # by q: -a (r^g / q - g r^(g-1) log q); dq/dm = s q r
        first = -a * s * (F.pow(r, F.lit(g + 1)) - g * q * F.pow(r, F.lit(g)) * lq)
        second = a * (q * r * (g + 1) * F.pow(r, F.lit(g)) + g * q * r * (F.pow(r, F.lit(g)) * lq - q * g * F.pow(r, F.lit(g - 1)) * lq + F.pow(r, F.lit(g))))
        return loss, first, F.greatest(second, F.lit(1e-6))

    def train(self, tr: DataFrame, va: DataFrame | None = None) -> Model:
        self.features = [c for c in tr.columns if c not in (ROW_ID, Y, VALID)]
        self._max_bins = self._bins(tr)
        inputs, stages, names = self._inputs(tr.withColumn(Y, F.col(Y).cast("double")))
        prep = Pipeline(stages=[*stages, VectorAssembler(inputCols=names, outputCol="features")]).fit(inputs)
        rows = prep.transform(inputs).select(ROW_ID, Y, "features").persist()
        loss = self._get("objective", default=None)
        loss = loss if callable(loss) else self.loss_gradient
        judge = self._get("feval", default=None) or (lambda y, m: F.avg(loss(y, m)[0]))
        patience = int(self._get("early_stopping_rounds", default=0)) if va is not None else 0
        held = prep.transform(self._inputs(va.withColumn(Y, F.col(Y).cast("double")))[0]).select(ROW_ID, Y, "features").withColumn("m", F.lit(0.0)) if patience else None
        best, best_at = None, 0
        self.prep, self.trees, self.rate = prep, [], float(self._get("learning_rate", default=0.1))
        margin = F.lit(0.0)
        work = rows.withColumn("m", margin)
        for k in range(int(self._get("num_boost_round", default=10))):
            _, g, h = loss(F.col(Y), F.col("m"))
            step = work.withColumn("t", -g / h).withColumn("w", h)
            tree = DecisionTreeRegressor(featuresCol="features", labelCol="t", weightCol="w", maxDepth=_depth(self._get("max_depth", default=4), self._get("num_leaves", default=31)), maxBins=self._max_bins, seed=int(self._get("seed", "random_state", default=777)) + k, predictionCol="step").fit(step)
            self.trees.append(tree)
            work = tree.transform(work).withColumn("m", F.col("m") + self.rate * F.col("step")).select(ROW_ID, Y, "features", "m")
            if k % 5 == 4 and self._spark().sparkContext.getCheckpointDir():
                work = work.checkpoint()
            if patience:
                held = tree.transform(held).withColumn("m", F.col("m") + self.rate * F.col("step")).select(ROW_ID, Y, "features", "m")
                if k % 5 == 4 and self._spark().sparkContext.getCheckpointDir():
                    held = held.checkpoint()
                value = held.agg(judge(F.col(Y), F.col("m"))).first()[0]
                if best is None or value < best:
                    best, best_at = value, len(self.trees)
                elif len(self.trees) - best_at >= patience:
                    break
        if patience:
            self.trees = self.trees[:best_at]
        rows.unpersist()
        return self

    def _predicted(self, df: DataFrame) -> DataFrame:
        out = self.prep.transform(self._inputs(df)[0]).withColumn("m", F.lit(0.0))
        for tree in self.trees:
            out = tree.transform(out).withColumn("m", F.col("m") + self.rate * F.col("step")).drop("step")
        return out.select(ROW_ID, *[c for c in (KEPT,) if c in df.columns], F.col("m").alias(PRED))

    def save(self, path: str) -> None:
        io.save_model(self.prep, f"{path}/prep")
        for k, tree in enumerate(self.trees):
            io.save_model(tree, f"{path}/tree{k}")
        io.write_json(self._spark(), {"features": self.features, "trees": len(self.trees), "rate": self.rate, "categorical": self.categorical}, f"{path}/about.json")

    def load(self, path: str) -> Model:
        about = io.read_json(self._spark(), f"{path}/about.json")
        self.features, self.rate, self.categorical = about["features"], about["rate"], tuple(about["categorical"])
        self.prep = PipelineModel.load(f"{path}/prep")
        self.trees = [DecisionTreeRegressionModel.load(f"{path}/tree{k}") for k in range(about["trees"])]
        return self

    def importance(self) -> dict[str, float]:
        total = sum(t.featureImportances.toArray() for t in self.trees)
        return dict(zip(self.features, map(float, total), strict=True))


class _Forest(Model):
    """Random forests. ``max_depth`` None or below 1 means the deepest tree there is, of 30 levels."""

    honoured = frozenset({"n_estimators", "max_depth", "random_state", "seed"})

    def _common(self) -> dict:
        depth = self._get("max_depth", default=5)
        return {"featuresCol": "features", "labelCol": Y, "numTrees": int(self._get("n_estimators", default=20)), "maxDepth": _depth(depth, 31), "seed": int(self._get("random_state", "seed", default=777)), "maxBins": self._max_bins}


class ModelRFClassifier(_Forest):
    def estimator(self):
        return RandomForestClassifier(**self._common())

    def prediction(self, df: DataFrame) -> Column:
        return _positive(df)


class ModelRFRegressor(_Forest):
    def estimator(self):
        return RandomForestRegressor(**self._common())


class ModelRIDGE(Model):
    """Least squares with the penalty alpha * |w|^2, solved in closed form (no random state); importance is the raw coefficients."""

    honoured = frozenset({"alpha", "random_state"})

    missing = 0.0

    def train(self, tr: DataFrame, va: DataFrame | None = None) -> Model:
        n, s = tr.agg(F.count(Y), F.stddev_pop(Y)).first()
        self._reg = float(self._get("alpha", default=1.0)) / max(n, 1) * (s or 1.0)  # the solver scales the target
        return super().train(tr, None)

    def estimator(self):
        return LinearRegression(featuresCol="features", labelCol=Y, elasticNetParam=0.0, standardization=False, solver="normal", regParam=self._reg)


class ModelSVM(Model):
    """Linear support vectors, fitted without randomness; predictions are class labels. The kernel form does not exist here."""

    honoured = frozenset({"C", "max_iter", "random_state"})

    missing = 0.0

    def estimator(self):
        return LinearSVC(featuresCol="features", labelCol=Y, regParam=1.0 / float(self._get("C", default=1.0)) / 100, maxIter=int(self._get("max_iter", default=50)))


class ModelKNN(Model):
    """Share of positives among the k nearest rows by Euclidean distance, ties by row id.

    Queries are taken in blocks of bounded size; the training rows pass by each block once, every task keeps and sends its own
    k nearest, and these meet in a top-k for each query. No pair of rows is ever a row of a table."""

    honoured = frozenset({"n_neighbors"})

    missing = 0.0

    def train(self, tr: DataFrame, va: DataFrame | None = None) -> Model:
        self.features = [c for c in tr.columns if c not in (ROW_ID, Y, VALID)]
        self.rows = tr.select(ROW_ID, Y, F.array(*[F.coalesce(known(tr, c).cast("double"), F.lit(0.0)) for c in self.features]).alias("x"))
        return self

    def predict(self, df: DataFrame, block: int = 2000) -> DataFrame:
        queries = df.select(ROW_ID, F.array(*[F.coalesce(known(df, c).cast("double"), F.lit(0.0)) for c in self.features]).alias("x"))
        near = nearest(self.rows, queries, int(self._get("n_neighbors", default=5)), block)
        return near.join(self.rows.select(F.col(ROW_ID).alias("other"), Y), "other").groupBy(F.col("query").alias(ROW_ID)).agg(F.avg(Y).alias(PRED))

    def predicted(self, df: DataFrame, name: str = PRED) -> DataFrame:
        return df.drop(name).join(self.predict(df).withColumnRenamed(PRED, name), ROW_ID)

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        io.write_json(self._spark(), {"features": self.features}, f"{path}/about.json")

    def load(self, path: str) -> Model:
        self.features = io.read_json(self._spark(), f"{path}/about.json")["features"]
        self.rows = self._spark().read.parquet(f"{path}/rows")
        return self

    def importance(self) -> None:
        return None


def compared(held, k: int, skip_self: bool):
    """For ``mapInArrow``: the k rows of a task that are nearest to each query held, in memory that does not grow with the batches."""

    def run(batches):
        import pyarrow as pa

        ids, q = held.value
        # the k nearest so far of each query: places not taken are infinitely far
        far, who = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        for b in batches:
            ends, numbers = b.column(1).offsets.to_numpy(), b.column(1).values
            other = b.column(0).to_numpy()
            for lo in range(0, b.num_rows, ROWS):
                hi = min(lo + ROWS, b.num_rows)
                if (np.diff(ends[lo : hi + 1]) != q.shape[1]).any():
                    raise ValueError(f"rows must have {q.shape[1]} numbers like the queries")
                x = numbers[ends[lo] : ends[hi]].to_numpy(zero_copy_only=False).astype(np.float64).reshape(hi - lo, -1)
                for at in range(0, len(ids), QUERIES):
                    to = at + QUERIES
                    d = np.stack([((x - v) ** 2).sum(axis=1) for v in q[at:to]])
                    if skip_self:
                        d[ids[at:to, None] == other[None, lo:hi]] = np.inf
                    # distances that do not exist go last; rows as far as the k-th may still come before it by their id
                    close = np.flatnonzero((d <= far[at:to, -1:]).any(axis=1))
                    if len(close):
                        d = np.concatenate([far[at:to][close], d[close]], axis=1)
                        o = np.concatenate([who[at:to][close], np.broadcast_to(other[lo:hi], (len(close), hi - lo))], axis=1)
                        top = np.lexsort((o, d))[:, :k]
                        far[at + close], who[at + close] = np.take_along_axis(d, top, 1), np.take_along_axis(o, top, 1)
        for at in range(0, len(ids), QUERIES):
            ok = np.isfinite(far[at : at + QUERIES])
            yield pa.RecordBatch.from_pydict({"query": pa.array(np.repeat(ids[at : at + QUERIES], k).reshape(ok.shape)[ok]), "other": pa.array(who[at : at + QUERIES][ok]), "distance": pa.array(np.sqrt(far[at : at + QUERIES][ok]))})

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int, block: int = 2000, skip_self: bool = False) -> DataFrame:
    """query, other, distance: the k rows nearest to each query (columns _row_id and x, an array), exact."""
    spark, found = rows.sparkSession, []
    schema = "query long, other long, distance double"

    def of_block(part: list) -> DataFrame:
        held = spark.sparkContext.broadcast((np.array([r[0] for r in part], dtype=np.int64), np.array([r[1] for r in part], dtype=np.float64)))
        return rows.select(ROW_ID, "x").mapInArrow(compared(held, k, skip_self), schema)

    part: list = []
    for r in queries.select(ROW_ID, "x").toLocalIterator():
        part.append(r)
        if len(part) == block:
            found.append(of_block(part))
            part = []
    if part:
        found.append(of_block(part))
    if not found:
        return spark.createDataFrame([], schema)
    every = found[0]
    for f in found[1:]:
        every = every.union(f)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "other"))
    return every.withColumn("r", rank).where(F.col("r") <= k).drop("r")


class ModelNN(Model):
    """A multilayer perceptron for classes; regression and embeddings have no counterpart here and are refused."""

    honoured = frozenset({"objective", "hidden", "epochs", "nb_epoch", "seed"})

    missing = 0.0

    def train(self, tr: DataFrame, va: DataFrame | None = None) -> Model:
        if str(self._get("objective", default="binary")).startswith("regress"):
            raise ValueError("the network classifies only")
        self._classes = int(tr.agg(F.max(Y)).first()[0]) + 1
        self._width = len([c for c in tr.columns if c not in (ROW_ID, Y, VALID)])
        return super().train(tr, None)

    def estimator(self):
        layers = [self._width, *self._get("hidden", default=[16]), max(self._classes, 2)]
        return MultilayerPerceptronClassifier(featuresCol="features", labelCol=Y, layers=layers, maxIter=int(self._get("epochs", "nb_epoch", default=50)), seed=int(self._get("seed", default=777)))

    def prediction(self, df: DataFrame) -> Column:
        return _positive(df)

    def importance(self) -> None:
        return None


MODELS: dict[str, type[Model]] = {c.__name__: c for c in (ModelLGBM, ModelOptunaLGBM, ModelFocalLGBM, ModelXGB, ModelCatClassifier, ModelCatRegressor, ModelRFClassifier, ModelRFRegressor, ModelRIDGE, ModelSVM, ModelKNN, ModelNN)}


def build(model_name: str, run_fold_name: str, params: dict | None = None, categorical: Sequence[str] = ()) -> Model:
    if model_name not in MODELS:
        raise ValueError(f"unknown model {model_name!r}; known: {sorted(MODELS)}")
    made = MODELS[model_name](run_fold_name, params, categorical)
    if odd := made.not_honoured():
        warnings.warn(f"{model_name} does not follow {', '.join(odd)}", stacklevel=2)
    return made


def embedding_sizes(df: DataFrame, columns: Sequence[str], most: int = 50) -> dict[str, tuple[int, int]]:
    """Column -> (distinct values, size of its embedding): half of them, ``most`` at the most; one aggregation."""
    row = df.agg(*[F.count_distinct(F.col(f"`{c}`")) for c in columns]).first()
    return {c: (int(n), min(most, (int(n) + 1) // 2)) for c, n in zip(columns, row, strict=True)}
