"""Memoised tables with fingerprints, and features assembled from several tables by row id."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import ROW_ID
from ..operators.encoders import Step, chain, target_encoder
from . import io


def _files(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Name, length and time of change of each file; a folder is listed once."""
    wanted, found = set(paths), []
    for folder in sorted({p.rpartition("/")[0] for p in paths}):
        at, fs = io._fs(spark, folder)
        for status in fs.listStatus(at):
            found.append((str(status.getPath().toString()), status.getLen(), status.getModificationTime()))
    plain = lambda p: re.sub(r"^file:/+", "/", p)
    names = {plain(unquote(p)) for p in wanted} | {plain(p) for p in wanted}
    return sorted(f"{n}:{size}:{at}" for n, size, at in found if plain(n) in names)


def _local_rows(df: DataFrame) -> list[str]:
    """A digest of the rows of every part of the plan that holds rows itself instead of reading files."""
    spark, out = df.sparkSession, []
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.nodeName().split(" ")[0] in ("LocalRelation", "LogicalRDD", "Scan"):
            rows = DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, leaf), spark)
            h = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])))
            out.append(str(rows.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(20,0)"))).first()))
    return out


def fingerprint(df: DataFrame) -> str:
    """A hash of the whole plan, of name, length and time of change of the files it reads, and of rows that it holds itself."""
    spark, key = df.sparkSession, "spark.sql.debug.maxToStringFields"
    held = spark.conf.get(key)
    spark.conf.set(key, "1000000")  # else a printed plan leaves out columns beyond the first
    try:
        # what tells apart the same plan made twice goes: expression ids and object hashes
        plan = re.sub(r"#\d+L?|plan_id=\d+|@[0-9a-f]+", "", df._jdf.queryExecution().analyzed().treeString())
    finally:
        spark.conf.set(key, held)
    parts = [plan, *_files(spark, df.inputFiles()), *_local_rows(df)]
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


def memoised(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, written first if it is missing or was made by another plan, from other files or other rows.

    A new table is written beside the old one and then takes its place, so a failed run leaves no half table."""
    df, mark = make(), f"{path}.plan"
    now = fingerprint(df)
    if not (io.exists(spark, path) and io.exists(spark, mark) and io.read_text(spark, mark) == now):
        df.write.mode("overwrite").parquet(f"{path}.new")
        io.delete(spark, path)
        io.rename(spark, f"{path}.new", path)
        io.write_text(spark, now, mark)
    return spark.read.parquet(path)


def run_pipeline(steps: Sequence[Step], df: DataFrame, path: str, row_id: str | None = None) -> DataFrame:
    """The steps applied to ``df``, kept at ``path``; with ``row_id`` the id is carried beside what the steps return."""
    step = chain(*steps)
    if row_id is None:
        return memoised(df.sparkSession, path, lambda: step(df))
    return memoised(df.sparkSession, path, lambda: step(df.withColumn(ROW_ID, F.col(row_id))))


def run_target_encoding(target: str, df: DataFrame, columns: Sequence[str], row_id: str, path: str, folds: int = 5, seed: int = 111) -> DataFrame:
    """Out-of-fold target encodings of ``columns`` kept at ``path``; the target itself is left out."""
    step = target_encoder(columns, target, row_id, folds, seed, output_suffix="")
    return memoised(df.sparkSession, path, lambda: step(df.select(F.col(row_id).alias(ROW_ID), *columns, target)).drop(target) if row_id == ROW_ID else step(df.select(F.col(row_id), *columns, target)).drop(target))


@dataclass(frozen=True)
class FeatureStore:
    """Tables of features glued by row id.

    ``tables`` maps a name to a frame or path. A column that several tables have keeps its name in the first and becomes
    ``<table>__<column>`` in the others. The target must be in one of them; its nulls are the test rows."""

    spark: SparkSession
    tables: dict[str, DataFrame | str]
    target: str
    row_id: str = ROW_ID

    def table(self) -> DataFrame:
        seen: set[str] = {self.row_id}
        parts = []
        for name, t in self.tables.items():
            df = self.spark.read.parquet(t) if isinstance(t, str) else t
            if self.row_id not in df.columns:
                raise ValueError(f"table {name} has no {self.row_id}")
            names = {c: c if c not in seen else f"{name}__{c}" for c in df.columns if c != self.row_id}
            seen |= set(names.values())
            parts.append(df.select(self.row_id, *[F.col(f"`{c}`").alias(n) for c, n in names.items()]))
        out = reduce(lambda a, b: a.join(b, self.row_id), parts)
        if self.target not in out.columns:
            raise ValueError(f"no table has the target {self.target}")
        return out

    def x_train(self) -> DataFrame:
        return self.table().where(F.col(self.target).isNotNull()).drop(self.target)

    def y_train(self) -> DataFrame:
        return self.table().where(F.col(self.target).isNotNull()).select(self.row_id, F.col(self.target).alias("y"))

    def x_test(self) -> DataFrame:
        return self.table().where(F.col(self.target).isNull()).drop(self.target)
