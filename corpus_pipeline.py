"""The corpus pipeline: five operators in a row, each over all that the one before has kept.

All stages but the last return the columns of their input, whatever these are called, for any number of rows, none included."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import jaccard, ordinal, packing, privacy, shared, suffixes, tokens


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose predicted chance of the best grade is below one half.

    Null and empty texts are judged as texts without words, long ones whole; equal texts are judged alike, repeated rows each.
    Without labels of two grades, as in an empty table, nothing is dropped."""
    labels = shared.table(spark, sf_dir, "labels")
    model = ordinal.train(docs, labels.select("doc_id", ordinal.grade(F.col("quality"), F.col("toxic")).alias("grade")))
    return ordinal.select(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest doc_id of each group that the Jaccard join links.

    Of repeated rows one stays; a null doc_id comes after all others. Texts that are null, empty or without words link with
    nothing and stay; long ones are compared whole."""
    return jaccard.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents in which a window of ten words of a benchmark item occurs.

    Null and empty texts have no words and stay; an item of fewer words is one window, one without words or id is none; repeated
    rows are judged each."""
    return suffixes.select_clean(docs, shared.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and the terms that disclose it; ``n_chars`` follows the new text.

    All rows stay. Null texts stay null with a null ``n_chars``, empty ones empty; equal texts become equal texts."""
    return privacy.sanitise(docs, carry=True).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the token ids of what is left into sequences of 4096: a row for each piece.

    Null and empty texts are a piece of the end id alone; longer documents than a sequence have several pieces; equal pieces
    may change places; an empty table has no pieces."""
    stored = shared.settle(packing.pieces(docs, tokens.vocabulary("word_bpe_49k.json")), "pipeline-pieces")
    return packing.pack(stored).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("personal_data", personal_data), ("pack", pack)]
#: Trained weights, corpus statistics over hashed shingles and tokenizers are not SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, shared.settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
        shared.discard(before)
    packed = STAGES[-1][1](spark, docs, sf_dir)  # holds its own table of pieces
    shared.discard(docs)
    return packed
