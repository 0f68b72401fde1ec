import zlib
from collections import Counter

import pytest

import corpus_pipeline
from tabloom.llm import ordinal, privacy, tokens
from tabloom.llm.queries import ORACLE, QUERIES

from ..oracle import connect, rows_of_spark, rows_of_sql
from .test_native import brute_spans
from .test_python import brute_components, brute_hits

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, name):
    df = QUERIES[name](spark, SF)
    table = "pages" if name.startswith("op3_") else "documents"
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert df.count() >= n if name.startswith("op1_") else df.count() == n


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_sql(spark, name):
    assert rows_of_spark(QUERIES[name](spark, SF)) == rows_of_sql(connect(SF), ORACLE[name])


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontaminate", "personal_data", "pack"]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    text = {r.doc_id: r.text for r in docs.collect()}

    kept = stages["quality"](spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = ordinal.train(docs, labels.select("doc_id", ordinal.grade(labels.quality, labels.toxic).alias("grade")))
    want = {i for i, t in text.items() if model.tails(model.value([ordinal.features(t)]))[0, -1] >= 0.5}
    assert kept.columns == docs.columns and ids(kept) == want and 0 < len(want) < len(text)

    single = stages["near_duplicates"](spark, kept, SF)
    comp = brute_components([(i, text[i]) for i in want])
    assert single.columns == docs.columns and ids(single) == {i for i, (_, c) in comp.items() if i == c}

    clean = stages["decontaminate"](spark, single, SF)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = sorted(ids(single))
    hits = brute_hits([text[i] for i in left], items, 10)
    assert clean.columns == docs.columns and ids(clean) == {i for i, h in zip(left, hits, strict=True) if not h[1]}

    private = stages["personal_data"](spark, clean, SF)
    assert private.columns == docs.columns and ids(private) == ids(clean)
    for r in private.collect():
        assert r.n_chars == len(r.text) and not any(brute_spans(r.text)[k] for k in ("email", "ip"))
        if not any(brute_spans(text[r.doc_id]).values()):
            assert r.text == text[r.doc_id]

    packed = stages["pack"](spark, private, SF).collect()
    enc = tokens.encoder(tokens.vocabulary("word_bpe_49k.json"))
    for r in private.collect():
        ids_ = enc.ids(r.text) + (1).to_bytes(4, "little")
        mine = sorted((p for p in packed if p.doc_id == r.doc_id), key=lambda p: p.piece)
        assert [p.ids_crc32 for p in mine] == [zlib.crc32(ids_[a : a + 4 * 4096]) for a in range(0, len(ids_), 4 * 4096)]
    assert privacy is not None


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_stage_edges(spark, edges, nothing, stage):
    """Nulls, empty and long texts, repeated rows, clashing names and empty tables go through every stage."""
    f = dict(corpus_pipeline.STAGES)[stage]
    assert f(spark, nothing, SF).count() == 0 and f(spark, nothing, SF).columns == nothing.columns
    out = f(spark, edges, SF)
    assert out.dtypes == edges.dtypes
    have = Counter((r.doc_id, r.text) for r in edges.collect())
    kept = Counter((r.doc_id, r.text) for r in out.collect())
    assert kept <= have and (stage != "personal_data" or kept == have)
    # as does what the other stages make of it
    assert f(spark, dict(corpus_pipeline.STAGES)["personal_data"](spark, edges, SF), SF).columns == edges.columns


def test_pack_edges(spark, edges, nothing):
    assert corpus_pipeline.pack(spark, nothing, SF).count() == 0
    assert corpus_pipeline.pack(spark, edges, SF).where("piece = 0").count() == edges.count()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
