"""Files in and out: CSV, Feather, Parquet, models, JSON, YAML, logs and run records."""

from __future__ import annotations

import json
import logging
import math
import time
from collections.abc import Callable, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---- paths that only Spark can reach -------------------------------------------------


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _fs(spark, path)
    fs.delete(at, True)


def rename(spark: SparkSession, old: str, new: str) -> bool:
    at, fs = _fs(spark, old)
    to, _ = _fs(spark, new)
    return fs.rename(at, to)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a run's files: in the shared folder the cluster names. Where none is named a temporary one, which is an
    error on a cluster, as each machine would have its own."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---- tables ----------------------------------------------------------------------------


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header. Without a schema types are inferred, which reads the file twice."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_feather(spark: SparkSession, path: str) -> DataFrame:
    """A Feather (Arrow IPC) file, for small tables that exist in that format: it is read on the driver. Store Parquet."""
    from pyarrow import feather

    return spark.createDataFrame(feather.read_table(path))


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header and no index; ``one_file`` for small results such as a submission."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


# ---- objects ----------------------------------------------------------------------------


def save_model(model: Any, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(cls: type, path: str) -> Any:
    return cls.load(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    at, fs = _fs(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    at, fs = _fs(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_json(spark: SparkSession, value: Any, path: str) -> None:
    write_text(spark, json.dumps(value, indent=1, sort_keys=True, default=str), path)


def read_json(spark: SparkSession, path: str) -> Any:
    return json.loads(read_text(spark, path))


def read_yaml(path: str) -> dict:
    import yaml

    with open(path) as f:
        return yaml.safe_load(f)


# ---- logs and run records -----------------------------------------------------------------


def ltsv(values: dict[str, Any]) -> str:
    """One line of labelled values; tabs and line ends inside a value become spaces, so a line stays one record."""
    clean = str.maketrans("\t\r\n", "   ")
    return "\t".join(":".join((str(label).translate(clean), str(value).translate(clean))) for label, value in values.items())


def score_record(scores: Sequence[float]) -> dict[str, float]:
    """The scores of a run as fields: ``score``, their mean (missing if there are none), and ``score0``, ``score1``, ..."""
    record = {"score": math.fsum(scores) / len(scores)} if scores else {}
    record.update((f"score{fold}", value) for fold, value in enumerate(scores))
    return record


class RunLog:
    """Messages to stdout and ``general.log``, results to stdout and ``result.log``; files are opened at first use."""

    def __init__(self, folder: str):
        self.folder, self._made = Path(folder), {}

    def _logger(self, name: str) -> logging.Logger:
        if name not in self._made:
            self.folder.mkdir(parents=True, exist_ok=True)
            logger = logging.getLogger(f"tabloom.{id(self)}.{name}")
            logger.setLevel(logging.INFO)
            logger.propagate = False
            for h in (logging.StreamHandler(), logging.FileHandler(self.folder / f"{name}.log")):
                h.setFormatter(logging.Formatter("%(asctime)s %(message)s"))
                logger.addHandler(h)
            self._made[name] = logger
        return self._made[name]

    def info(self, message: str) -> None:
        self._logger("general").info(message)

    def result(self, message: str) -> None:
        self._logger("result").info(message)

    def result_ltsv(self, values: dict[str, Any]) -> None:
        self.result(ltsv(values))

    def result_scores(self, run: str, scores: list[float]) -> None:
        self.result_ltsv({"name": run, **score_record(scores)})


RUN_SCHEMA = "run string, kind string, key string, value string, at double"


def track(spark: SparkSession, path: str, run: str, kind: str, values: dict[str, Any]) -> None:
    """Append parameters, metrics or artifacts of a run to the table of runs."""
    rows = [(run, kind, str(k), str(v), time.time()) for k, v in values.items()]
    if rows:
        spark.createDataFrame(rows, RUN_SCHEMA).coalesce(1).write.mode("append").parquet(path)


class timer:
    """``with timer("fit", log.result_ltsv) as t: ...`` gives the fields step, seconds and failed to ``sink`` when the block
    ends, by an error too, and keeps ``t.seconds``. Without a sink a line goes to the standard logger."""

    def __init__(self, step: str, sink: Callable[[dict[str, Any]], None] | None = None):
        self.step, self.sink, self.seconds = step, sink or (lambda fields: logging.getLogger("tabloom").info(ltsv(fields))), math.nan

    def __enter__(self) -> timer:
        self._start = time.perf_counter()
        return self

    def __exit__(self, kind, *_) -> None:
        self.seconds = time.perf_counter() - self._start
        self.sink({"step": self.step, "seconds": round(self.seconds, 3), "failed": kind is not None})


def seed_everything(spark: SparkSession, seed: int) -> None:
    """Seed the generators of the driver, and those of Python workers started from now on. Operators here take their randomness
    from seeds of their own and hashes of ids, so they need none of this; it is for functions that callers bring along."""
    import os
    import random

    import numpy as np

    random.seed(seed)
    np.random.seed(seed % (1 << 32))
    os.environ["PYTHONHASHSEED"] = spark.sparkContext.environment["PYTHONHASHSEED"] = str(seed % (1 << 32))
