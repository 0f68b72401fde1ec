"""Cross-validated training, prediction and submission, driven by a configuration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import ROW_ID
from ..functions import metrics
from ..functions.expr import threshold
from ..operators.folds import stratified_kfold
from ..sources import io
from ..sources.store import FeatureStore
from . import models
from .models import PRED, Y, Model

Splitter = Callable[[DataFrame, str], DataFrame]
# The keys that a configuration may have.
ABOUT = {"description", "exp_name", "fe_name", "data"}
KEYS = ABOUT | {"run_name", "cols_definition", "model_name", "params", "model_params", "evaluation_metric", "advanced", "n_splits", "seed"}
COLUMN_KEYS = {"id_col", "target_col", "categorical_col", "cv_y"}
MODES = {"ResRunner": {"oof", "res_threshold"}, "PseudoRunner": {"y_test_pred", "run", "pl_threshold", "pl_threshold_neg", "pl_threshold_pos"}, "adversarial_validation": None, "predict_exp": None}


def _only(given, known, where: str) -> None:
    if odd := sorted(set(given) - set(known)):
        raise ValueError(f"unknown keys in {where}: {odd}; known: {sorted(known)}")


@dataclass(frozen=True)
class RunConfig:
    """What a run does; built from a dict whose keys are those of the configuration files. Other keys are an error.

    ``advanced`` may hold ResRunner {oof, res_threshold}, PseudoRunner {y_test_pred (or run), pl_threshold or
    pl_threshold_neg and pl_threshold_pos}, adversarial_validation and predict_exp. The last two are on if they are
    there, with or without a value, unless the value is false."""

    run_name: str
    model_name: str
    evaluation_metric: str
    target: str
    id_col: str = ROW_ID
    categorical: tuple[str, ...] = ()
    cv_y: str | None = None
    params: dict[str, Any] = field(default_factory=dict)
    folds: int = 5
    seed: int = 7
    advanced: dict[str, Any] = field(default_factory=dict)
    about: dict[str, Any] = field(default_factory=dict)  # what names the run and its inputs but changes nothing here

    @classmethod
    def of(cls, c: dict[str, Any]) -> RunConfig:
        cols = c.get("cols_definition") or {}
        advanced = dict(c.get("advanced") or {})
        _only(c, KEYS, "the configuration")
        _only(cols, COLUMN_KEYS, "cols_definition")
        _only(advanced, MODES, "advanced")
        for mode, keys in MODES.items():
            if keys:
                _only(advanced.get(mode) or {}, keys, mode)
        if c.get("params") and c.get("model_params"):
            raise ValueError("params and model_params are the same; give one")
        out = cls(c["run_name"], c["model_name"], c["evaluation_metric"], cols.get("target_col", Y), cols.get("id_col", ROW_ID), tuple(cols.get("categorical_col") or ()), cols.get("cv_y"), dict(c.get("params") or c.get("model_params") or {}), int(c.get("n_splits", 5)), int(c.get("seed", 7)), advanced, {k: c[k] for k in ABOUT if k in c})
        out.check()
        return out

    def on(self, mode: str) -> bool:
        return mode in self.advanced and self.advanced[mode] is not False

    def check(self) -> None:
        if self.model_name not in models.MODELS:
            raise ValueError(f"unknown model {self.model_name!r}; known: {sorted(models.MODELS)}")
        if self.evaluation_metric not in metrics.AGGREGATES and self.evaluation_metric not in metrics.RANKINGS:
            raise ValueError(f"unknown metric {self.evaluation_metric!r}")


# ---- plans of the special modes ----------------------------------------------------------------


def residual_filter(train: DataFrame, oof: DataFrame, limit: float) -> DataFrame:
    """Training rows whose earlier out-of-fold prediction is off by less than ``limit``."""
    return train.join(oof.select(ROW_ID, F.col(PRED).alias("_oof")), ROW_ID).where(F.abs(F.col(Y) - F.col("_oof")) < limit).drop("_oof")


def pseudo_labels(test: DataFrame, predicted: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Test rows with predicted targets.

    With ``low`` alone, rows below it or above 1 - low, rounded to 0 or 1; with both, rows below low or above high, rounded;
    with neither, all rows with the predictions as they are."""
    rows = test.join(predicted.select(ROW_ID, F.col(PRED).alias(Y)), ROW_ID)
    if low is None and high is None:
        return rows
    top = 1 - low if high is None else high
    return rows.where((F.col(Y) < low) | (F.col(Y) > top)).withColumn(Y, threshold(F.col(Y)).cast("double"))


def adversarial(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train and test rows together, the target being 1 for test rows."""
    tag = lambda df, v: df.drop(Y).withColumn(Y, F.lit(v))
    return tag(train, 0.0).unionByName(tag(test, 1.0), allowMissingColumns=True)


def average_predictions(parts: list[DataFrame]) -> DataFrame:
    """The mean prediction of each row over the folds."""
    return reduce(DataFrame.unionByName, parts).groupBy(ROW_ID).agg(F.avg(PRED).alias(PRED))


def importances(spark: SparkSession, parts: list[dict[str, float]], top: int = 200) -> DataFrame:
    """Feature and mean importance over the folds, the ``top`` largest first."""
    rows = [(name, float(v)) for p in parts for name, v in p.items()]
    return spark.createDataFrame(rows, "feature string, importance double").groupBy("feature").agg(F.avg("importance").alias("importance")).orderBy(F.desc("importance"), "feature").limit(top)


class Runner:
    """Trains a model for each fold, stitches out-of-fold predictions, predicts the test rows and writes a submission.

    ``features``: a FeatureStore, or frames (x_train, y_train, x_test) with ``_row_id``. All results are tables in ``folder``:
    oof, pred, importance, model/<fold>, submission, runs. ``predictions`` maps names of earlier predictions, as the
    configuration has them, to their tables or paths; a name that is not there is a path to Parquet."""

    def __init__(self, spark: SparkSession, config: RunConfig | dict, features: FeatureStore | tuple[DataFrame, DataFrame, DataFrame], folder: str, splitter: Splitter | None = None, predictions: dict[str, DataFrame | str] | None = None):
        self.spark, self.folder, self.predictions = spark, folder.rstrip("/"), predictions or {}
        self.config = config if isinstance(config, RunConfig) else RunConfig.of(config)
        self.config.check()
        if isinstance(features, FeatureStore):
            table = features.table()
            rename = {features.row_id: ROW_ID, features.target: Y}
            table = table.select(*[F.col(f"`{c}`").alias(rename.get(c, c)) for c in table.columns])
            self.train, self.test = table.where(F.col(Y).isNotNull()), table.where(F.col(Y).isNull()).drop(Y)
        else:
            x, y, self.test = features
            self.train = x.join(y.select(ROW_ID, Y), ROW_ID)
        if self.config.on("adversarial_validation"):
            self.train = adversarial(self.train, self.test)
        self.splitter = splitter or self._stratified
        self._folded: DataFrame | None = None

    # ---- folds
    def _stratified(self, df: DataFrame, by: str) -> DataFrame:
        return stratified_kfold(df, by, ROW_ID, self.config.folds, self.config.seed)

    def folded(self) -> DataFrame:
        """The training rows with a fold column, assigned once and kept whole: every fold sees the same assignment, and none of
        the passes of a fit joins features, targets and folds again."""
        if self._folded is not None:
            return self._folded
        path = f"{self.folder}/folds"
        folds = self.splitter(self.train, self.config.cv_y or Y).select(ROW_ID, "fold")
        self.train.join(folds, ROW_ID).write.mode("overwrite").parquet(path)
        self._folded = self.spark.read.parquet(path)
        return self._folded

    def build_model(self, fold: int) -> Model:
        return models.build(self.config.model_name, f"{self.config.run_name}-{fold}", self.config.params, self.config.categorical)

    # ---- training
    def _training_rows(self, rows: DataFrame) -> DataFrame:
        a = self.config.advanced
        if r := a.get("ResRunner"):
            rows = residual_filter(rows, self._table(r["oof"]), float(r["res_threshold"]))
        if p := a.get("PseudoRunner"):
            low = p.get("pl_threshold", p.get("pl_threshold_neg"))
            extra = pseudo_labels(self.test, self._table(p["y_test_pred"] if "y_test_pred" in p else p["run"]), low, p.get("pl_threshold_pos"))
            rows = rows.unionByName(extra.withColumn(Y, F.col(Y).cast(rows.schema[Y].dataType)).select(*rows.columns))
        return rows

    def _table(self, t: DataFrame | str) -> DataFrame:
        t = self.predictions.get(t, t) if isinstance(t, str) else t
        return self.spark.read.parquet(t) if isinstance(t, str) else t

    def train_fold(self, rows: DataFrame, fold: int) -> tuple[Model, DataFrame, float]:
        """(model, predictions of the validation rows, score). Validation rows are never filtered or added to."""
        tr = self._training_rows(rows.where(F.col("fold") != fold).drop("fold"))
        va = rows.where(F.col("fold") == fold).drop("fold")
        model = self.build_model(fold).train(tr, va)
        path = f"{self.folder}/oof/fold={fold}"
        model.predicted(va).select(ROW_ID, PRED, F.col(Y).cast("double").alias(Y)).write.mode("overwrite").parquet(path)
        pred = self.spark.read.parquet(path)
        score = metrics.evaluate(pred, self.config.evaluation_metric).first()[0]
        return model, pred, score

    def run_train_cv(self) -> dict[str, Any]:
        """{"scores": by fold, "score": over all out-of-fold rows together}; models and predictions are kept."""
        rows, scores, found = self.folded(), [], []
        for fold in range(self.config.folds):
            model, _, score = self.train_fold(rows, fold)
            model.save(f"{self.folder}/model/{fold}")
            scores.append(score)
            if (imp := model.importance()) is not None:
                found.append(imp)
        total = metrics.evaluate(self.oof(), self.config.evaluation_metric).first()[0]
        if found:
            importances(self.spark, found).write.mode("overwrite").parquet(f"{self.folder}/importance")
        io.track(self.spark, f"{self.folder}/runs", self.config.run_name, "param", {"model_name": self.config.model_name, **self.config.params})
        io.track(self.spark, f"{self.folder}/runs", self.config.run_name, "metric", {"score": round(total, 4), **{f"score{i}": s for i, s in enumerate(scores)}})
        return {"scores": scores, "score": total}

    def oof(self) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.folder}/oof/fold={k}" for k in range(self.config.folds)])

    # ---- prediction
    def run_predict_cv(self) -> DataFrame:
        """Mean prediction of the test rows over the stored fold models; kept in ``pred``. The rows are read once and predicted by
        one model after the other, so what is shuffled does not grow with the number of folds."""
        rows, names = self.test, [f"_{PRED}{k}" for k in range(self.config.folds)]
        for k, name in enumerate(names):
            rows = self.build_model(k).load(f"{self.folder}/model/{k}").predicted(rows, name)
        average_predictions([rows.select(ROW_ID, F.explode(F.array(*names)).alias(PRED))]).write.mode("overwrite").parquet(f"{self.folder}/pred")
        return self.spark.read.parquet(f"{self.folder}/pred")

    def submission(self, sample: DataFrame, row_id: str, target: str) -> DataFrame:
        """The sample's rows with predictions in the target column (their exponential if predict_exp is set), as one CSV."""
        pred: Column = F.exp(PRED) if self.config.on("predict_exp") else F.col(PRED)
        made = self.spark.read.parquet(f"{self.folder}/pred").select(F.col(ROW_ID).alias("_id"), pred.alias("_pred"))
        joined = sample.join(made, F.col(row_id) == F.col("_id"), "left")
        out = joined.select(*[F.col("_pred").alias(c) if c == target else F.col(f"`{c}`") for c in sample.columns])
        io.write_csv(out.orderBy(row_id), f"{self.folder}/submission", one_file=True)
        return out
