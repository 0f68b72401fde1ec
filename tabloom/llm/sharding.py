"""Proportional stratified interleaving of rows into shards, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared


def interleave(docs: DataFrame, shards: int = 24, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot, grown_shard, one row for each input row.

    Rows are shuffled within their source by the md5 of (seed, doc_id), ranked, and sorted over all sources by
    fractional rank (rank - 1/2) / rows of the source. Equal cuts of that order give shards whose row counts differ by
    one at most (the law is ``rows``) and whose mixture of sources matches the whole up to rounding.

    Both ranks are exact and distributed: rows are dealt to buckets by the order itself (leading digits of the hash,
    then the fractional rank), ranked within their bucket, and moved up by the rows of the buckets before. A source with a
    third of all rows is spread over all buckets. A null source is a source of its own; null texts have size 8; rows that
    tie in everything change places freely. An empty table gives no rows."""
    spark = docs.sparkSession
    fan = max(16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).alias("source"),
        F.when(F.col(source_col).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string"))).alias("stratum"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary")).alias("h"),
    ).withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") * fan / float(1 << 32)).cast("int"))
    rows = shared.settle(rows, "shard-rows")
    counts = rows.groupBy("stratum", "bucket").agg(F.count("*").alias("n"))
    base = shared.with_base(counts, ["stratum"], "bucket").select("stratum", "bucket", "base", F.sum("n").over(Window.partitionBy("stratum")).alias("of"))
    k = F.row_number().over(Window.partitionBy("stratum", "bucket").orderBy("h", "doc_id", "size", "text_crc32"))
    ranked = rows.withColumn("k", k).join(base, ["stratum", "bucket"]).withColumn("share", (F.col("base") + F.col("k") - F.lit(0.5)) / F.col("of")).withColumn("bin", F.floor(F.col("share") * fan).cast("int")).drop("bucket", "k", "base", "of")
    ranked = shared.settle(ranked, "shard-ranked")
    shared.discard(rows)
    bins = ranked.groupBy("bin").agg(F.count("*").alias("n"))
    total = ranked.count()
    starts = bins.withColumn("base", F.sum("n").over(Window.orderBy("bin")) - F.col("n")).select("bin", "base")  # at most ``fan`` rows
    at = F.row_number().over(Window.partitionBy("bin").orderBy("share", "h", "doc_id", "stratum"))
    placed = ranked.withColumn("k", at).join(starts, "bin").withColumn("pos", F.col("base") + F.col("k") - 1)
    placed = placed.withColumn("shard", F.expr(f"(pos * {shards}L) div {max(total, 1)}L"))
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return placed.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("pos") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
