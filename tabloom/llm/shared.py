"""Helpers that the corpus operators share: written tables, prefix sums, safe columns."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, a folder of our own in local mode (tests), and an error on a
    cluster, whose machines would each have their own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get("dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tabloom-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        _OWN["dir"] = root
    return root.rstrip("/")


def settle(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a lost executor then costs no recomputation.

    With ``by`` the files are bucketed by that column, so that later joins on it do not shuffle them again."""
    spark = df.sparkSession
    name = f"{tag}-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    writer = df.write.option("compression", "zstd")
    if by is None:
        writer.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    else:
        held = name.replace("-", "_")
        writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", path).format("parquet").saveAsTable(held)
        out = spark.table(held)
        out._settled_as = held
    out._settled_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files behind ``settle`` results that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_settled_at", None)
        if path:
            if name := getattr(df, "_settled_as", None):
                df.sparkSession.sql(f"DROP TABLE IF EXISTS `{name}`")
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def bounded_batches(spark: SparkSession, most_bytes: int = 4 << 20) -> None:
    """Let Spark send at most about ``most_bytes`` (or one row) to a Python worker at a time, as texts may be long. A lower
    limit of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = re.match(r"\d+", spark.conf.get(key, None) or "")
    digits, unit = (held[0], spark.conf.get(key)[held.end() :].strip().lower()[:1]) if held else ("0", "")
    now = int(digits) << {"k": 10, "m": 20, "g": 30}.get(unit, 0)
    if not 0 < now <= most_bytes:
        spark.conf.set(key, str(most_bytes))


def trim(encoders: bool = True) -> None:
    """At the end of a task in a Python worker, which may serve other operators next: give memory that was freed back to the
    system, with ``encoders`` that of the token caches too, which only tasks that encode have a use for."""
    import ctypes
    import gc
    import sys

    import pyarrow as pa

    tokens = sys.modules.get(f"{__package__}.tokens")
    if encoders and tokens is not None:
        tokens._ENCODERS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def release(spark: SparkSession) -> None:
    """Between the steps of a long operator: let the driver's JVM collect its garbage.

    Every stage and broadcast leaves blocks of some MB there, and its heap grows by them long before it would collect by itself.
    Spark also drops broadcasts and shuffle files only once their handles have been collected."""
    import gc

    gc.collect()  # handles of frames that only Python still holds
    spark.sparkContext._jvm.System.gc()


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, lengthened until no column of ``frames`` is called so in any case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bitmap(keys: DataFrame, key: str, bits: int = 26) -> DataFrame:
    """A bit for each of 2**bits cells of the hash ``key``, set where a row has it: at most 2**bits / 32768 rows of 4096 bytes,
    whatever the input."""
    cell = F.pmod(F.col(key), F.lit(1 << bits)) + 1  # buckets and positions count from 1
    return keys.groupBy(F.bitmap_bucket_number(cell).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("marks"))


def marked(df: DataFrame, key: str, marks: DataFrame, out: str, bits: int = 26) -> DataFrame:
    """``df`` with a boolean ``out``: false where no row behind the bitmap has ``key``, true where one has it or by chance."""
    bucket, mark = fresh("bucket", df), fresh("marks", df)
    cell = F.pmod(F.col(key), F.lit(1 << bits)) + 1
    at = F.bitmap_bit_position(cell)
    byte = F.conv(F.hex(F.substring(mark, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2.0), at % 8).cast("int")) != 0, F.lit(False))
    held = F.broadcast(marks.withColumnsRenamed({"bucket": bucket, "marks": mark}))  # 2**bits / 8 bytes
    return df.join(held, F.bitmap_bucket_number(cell) == F.col(bucket), "left").withColumn(out, bit).drop(bucket, mark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_base(counts: DataFrame, group: list[str], order: str, n: str = "n", out: str = "base") -> DataFrame:
    """Exclusive prefix sum of ``n`` along ``order`` within ``group``; ``counts`` has one row for each bucket."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn(out, F.sum(n).over(w) - F.col(n))
