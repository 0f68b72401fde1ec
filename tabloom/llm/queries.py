"""The queries of the corpus operators over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boundaries, jaccard, languages, ordinal, packing, privacy, sharding, shared, sql, suffixes, tiff, tokens, urls

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    stored = shared.settle(packing.pieces(docs, tokens.vocabulary("word_bpe_49k.json")), "op1-pieces")
    return packing.pack(stored).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op9_elias_fano_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    stored = shared.settle(boundaries.blocks(docs, tokens.vocabulary("byte_bpe_50k.json")), "op9-ids")
    return boundaries.read(stored)


@query
def op2_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(shared.table(spark, sf_dir, "documents")).drop("source")


@query
def op3_redirect_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(shared.table(spark, sf_dir, "pages")).drop("alias_verdict")


@query
def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels")
    ratings = labels.select("doc_id", ordinal.grade(F.col("quality"), F.col("toxic")).alias("grade"))
    return ordinal.score(docs, ordinal.train(docs, ratings))


@query
def op5_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identify(shared.table(spark, sf_dir, "documents"))


@query
def op6_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = shared.settle(tiff.write_texts(shared.table(spark, sf_dir, "documents")), "op6-media")
    return tiff.read_files(media)


@query
def op8_suffix_array_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark")
    found = suffixes.decontaminate(docs, items, locate=False)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query
def op7_disclosing_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.sanitise(shared.table(spark, sf_dir, "documents"))
    terms = F.array_join(F.expr("transform(terms, x -> concat('term:', x.s, ':', x.e))"), ",")
    both = F.concat("base", F.when((F.col("base") != "") & (F.size("terms") > 0), ",").otherwise(""), terms)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), both.alias("spans"))


@query
def op10_shingle_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_components(shared.table(spark, sf_dir, "documents"))


ORACLE |= {"op2_stratified_shards": sql.SHARDS, "op3_redirect_verdicts": sql.URLS, "op8_suffix_array_leaks": sql.LEAKS, "op10_shingle_components": sql.NEAR}
