import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.frame import ROW_ID, SPLIT, TrainTest
from tabloom.functions import metrics
from tabloom.functions.expr import clean_nan, ieee_div, safe_corr
from tabloom.operators import columns, encoders, folds, groupby, latent, selection
from tabloom.operators.medians import exact_medians
from tabloom.streaming import fitted

PASSENGERS = [
    # id, pclass, sibsp, age, fare, sex, embarked, adult_male, now
    (1, 1, 0, 22.0, 7.25, "male", "S", True, "2020-01-31 10:05:00"),
    (2, 1, 1, 38.0, 71.28, "female", "C", False, "2020-02-29 23:59:00"),
    (3, 3, 0, None, 7.92, "female", "S", False, "2021-03-01 00:00:00"),
    (4, 3, 1, 35.0, None, "female", None, False, "2021-03-07 12:30:00"),
    (5, 2, 3, float("nan"), 8.05, "male", "Q", True, "2022-12-25 06:45:00"),
    (6, None, 0, 54.0, 51.86, "male", "S", True, "2022-12-26 06:45:00"),
    (7, 4, 0, None, 3.0, "male", "S", True, "2022-12-26 06:45:00"),
]
SCHEMA = "id long, pclass int, sibsp int, age double, fare double, sex string, embarked string, adult_male boolean, now string"


@pytest.fixture(scope="module")
def tt(spark):
    df = spark.createDataFrame(PASSENGERS, SCHEMA)
    return TrainTest.from_pair(df, df.withColumn("id", F.col("id") + 100), "id")


def by_id(out, *names):
    df = out.df if isinstance(out, TrainTest) else out
    return {r[0]: tuple(r)[1:] if len(names) > 1 else r[1] for r in df.select("id", *names).collect()}


def test_standerize(tt):
    out = columns.standerize(tt, ["age", "fare"])
    m, s = out.train.agg(F.avg("age"), F.stddev_pop("age")).first()
    assert abs(m) < 1e-9 and abs(s - 1) < 1e-9
    got = by_id(out, "age")
    assert got[3] is None and got[5] is None and got[101] == got[1]


def test_standerize_constant(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None)], "id long, x double")
    out = by_id(columns.standerize(TrainTest.from_pair(df, df), ["x"]), "x")
    assert out == {1: 0.0, 2: 0.0, 3: None}


def test_fillna(tt):
    got = by_id(columns.fillna(tt, ["age"], "median"), "age")
    assert got[3] == got[105] == 36.5 and got[1] == 22.0
    got = by_id(columns.fillna(tt, ["fare"], "mean"), "fare")
    assert got[4] == pytest.approx((7.25 + 71.28 + 7.92 + 8.05 + 51.86 + 3.0) / 6)
    with pytest.raises(ValueError):
        columns.fillna(tt, ["age"], "mode")


def test_circle(spark):
    df = spark.createDataFrame([(i, i) for i in range(10)], "id long, numbers int")
    out = columns.circle_encoding(TrainTest.from_pair(df, df.withColumn("numbers", F.col("numbers") + 3)), ["numbers"])
    assert set(out.columns) - {"id", "numbers"} == {"numbers_cos", "numbers_sin"}
    for r in out.df.collect():
        assert r.numbers_cos == pytest.approx(math.cos(2 * math.pi * r.numbers / 9)) and r.numbers_cos**2 + r.numbers_sin**2 == pytest.approx(1)


def test_datetime(tt):
    got = by_id(columns.datetime_parser(tt, ["now"]), *[f"now_{x}" for x in ("year", "month", "day", "dow", "hour", "minute")])
    assert got[1] == (2020, 1, 31, 4, 10, 5) and got[4] == (2021, 3, 7, 6, 12, 30)


def test_frequency(tt):
    got = by_id(columns.frequency_encoding(tt, ["embarked", "pclass"]), "fe_embarked", "fe_pclass")
    assert got[1] == (4 / 6, 2 / 6) and got[4][0] is None and got[6][1] is None and len(got) == 14
    values = {"S": got[1][0], "C": got[2][0], "Q": got[5][0]}
    assert sum(values.values()) == pytest.approx(1)


def test_count_null(spark, tt):
    out = columns.count_null(tt, ["age", "embarked", "sex"])
    assert {"count_null", "cn_age", "cn_embarked"} <= set(out.columns) and "cn_sex" not in out.columns
    got = by_id(out, "count_null", "cn_age", "cn_embarked")
    assert got[4] == (2, 0, 1) and got[5] == (1, 1, 0) and got[1] == (0, 0, 0)
    a = spark.createDataFrame([(1, 2.0)], "id long, target double")
    both = columns.count_null(TrainTest.from_pair(a, a.drop("target")), ["target"])
    assert sorted(r.count_null for r in both.df.collect()) == [0, 1]


def test_narrowing(spark):
    df = spark.createDataFrame([(1, 127, 40000, 2**40, 1.5, 1e300, None, "x", True), (2, 3, 5, 6, 2.5, 3.0, None, "y", False)], "a int, b int, c long, d long, e double, f double, g double, h string, i boolean")
    got = dict(columns.reduce_mem_usage(df).dtypes)
    assert got == {"a": "tinyint", "b": "smallint", "c": "int", "d": "bigint", "e": "float", "f": "double", "g": "double", "h": "string", "i": "boolean"}
    assert columns.reduce_mem_usage(df).collect()[1].d == 6


def test_nn_features(tt):
    out = columns.nn_features(tt, first_rows=4)
    assert "sex" not in out.columns and out.train.count() == 3 and out.test.count() == 7
    assert out.df.where("age is null").count() == 0


def test_group_edges(spark, tt):
    spec = {"key": ["pclass"], "var": ["age", "fare"], "agg": ["mean", "sum", "median", "min", "max", "var", "std", "nunique"]}
    out = groupby.groupby_features(tt.train.drop("now"), [spec, spec])
    assert len(out.columns) == 8 + 16 and out.columns[8:10] == ["mean_age_groupby_pclass", "sum_age_groupby_pclass"]
    got = by_id(out, "sum_age_groupby_pclass", "mean_age_groupby_pclass", "var_fare_groupby_pclass", "nunique_age_groupby_pclass")
    assert got[7] == (0.0, None, None, 0)  # no known age, one fare
    assert got[6] == (None, None, None, None)  # null key
    assert got[1][0] == 60.0 and got[1][3] == 2
    with pytest.raises(ValueError):
        groupby.groupby_features(tt.df, [{"key": "pclass", "var": "age", "agg": "nope"}])
    with pytest.raises(ValueError):
        groupby.groupby_features(tt.df, [{"key": ["pclass", "sex"], "var": "age", "agg": "mean", "on": ["pclass"]}])
    with pytest.raises(KeyError):
        groupby.diff_features(tt.df, [{"key": "pclass", "var": "age", "agg": "mean"}])


def test_group_fanout(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0)], "k string, s string, v double")
    spec = groupby.GroupSpec(("k", "s"), ("v",), ("mean",), ("k",), True)
    assert groupby.groupby_features(df, [spec]).count() == 4


def test_pandas_aggregate(spark):
    import pandas as pd

    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    spread.__name__ = "spread"
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 4.0), (3, "b", 2.0)], "id long, k string, v double")
    assert by_id(groupby.groupby_features(df, [groupby.GroupSpec(("k",), ("v",), (spread,))]), "spread_v_groupby_k") == {1: 3.0, 2: 3.0, 3: 0.0}


def test_aggregation(tt):
    spec = [{"key": ["pclass"], "var": ["age"], "agg": ["mean"]}]
    out = groupby.aggregation(tt, spec, [{"key": ["pclass"], "var": ["sibsp"], "agg": ["nunique"]}])
    got = by_id(out, "diff_mean_age_groupby_pclass", "ratio_mean_age_groupby_pclass", "nunique_sibsp_groupby_pclass")
    assert got[1] == (8.0, pytest.approx(22 / 30), 2) and out.train.count() == out.test.count() == 7


def test_division_and_correlation(spark):
    df = spark.createDataFrame([(1.0, 0.0, 5.0), (-1.0, 0.0, 5.0), (0.0, 0.0, None), (6.0, 3.0, 5.0), (None, 1.0, 5.0)], "n double, d double, c double")
    assert [r[0] for r in df.select(ieee_div(F.col("n"), F.col("d"))).collect()] == [math.inf, -math.inf, None, 2.0, None]
    assert df.agg(safe_corr(F.col("n"), F.col("c"))).first()[0] is None
    nan = spark.createDataFrame([(float("nan"), "a"), (1.0, "b")], "x double, s string")
    assert [r.x for r in clean_nan(nan).collect()] == [None, 1.0]


def test_selection(spark):
    rows = [(i, 1, float(i), i, i % 2 == 0, 1 if i % 2 == 0 else 0, -float(i), "c", str(i), None) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, one int, x double, x2 int, b boolean, b2 int, neg double, const string, s string, empty string")
    t = TrainTest.from_pair(df, df, "id")
    unique, duplicated, high = selection.detect_delete_cols(t, ["id"], 0.9)
    assert unique == ["one", "const"] and duplicated == ["x", "x2", "b2"] and high == ["x2"]
    assert selection.distinct_counts(df, ["x", "empty"]).first() == (12, 0)


def test_encoders(spark):
    df = spark.createDataFrame([(1, "b", 1, 11), (2, "a", 11, 1), (3, None, 2, 2), (4, "b", 3, 3)], "id long, k string, p int, q int")
    assert by_id(encoders.label_encoder(["k"])(df), "k") == {1: 1, 2: 0, 3: None, 4: 1}
    assert encoders.label_encoder(["k"])(df).columns == df.columns
    assert by_id(encoders.count_encoder(["k"])(df), "k_ce") == {1: 2, 2: 1, 3: None, 4: 2}
    joined = by_id(encoders.concat_combination(["p", "q"])(df), "pq_combi")
    assert joined[1] == "1|11" and joined[2] == "11|1"
    made = encoders.arithmetic_combinations(["p", "q"], "/", drop_origin=True)(df)
    assert made.columns == ["id", "k", "pq_div"]
    big = encoders._numbered(df.select(F.col("id").alias("__k")), most_in_a_task=1)
    assert sorted(tuple(r) for r in big.collect()) == [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_target_encoder(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2] if i < 9 else None, float(i) if i % 4 else None) for i in range(10)], "id long, k string, y double")
    out = by_id(encoders.target_encoder(["k"], "y", "id", fold=(F.col("id") % 3).cast("int"), output_suffix="")(df), "k")
    rows = [(i, "ab"[i % 2] if i < 9 else None, float(i) if i % 4 else None) for i in range(10)]
    for i, k, y in rows:
        others = [b for j, a, b in rows if a == k and b is not None and (y is None or j % 3 != i % 3)]
        want = sum(others) / len(others) if others and k else None
        assert out[i] == (pytest.approx(want) if want is not None else None)


def test_folds(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    f = folds.stratified_kfold(df, "y", "id")
    sizes = [r["count"] for r in f.groupBy("y", "fold").count().collect()]
    assert len(sizes) == 10 and {s for s in sizes if s < 50} == {20} and {s for s in sizes if s > 50} == {180}
    again = {r.id: r.fold for r in folds.stratified_kfold(df.repartition(7), "y", "id").collect()}
    assert again == {r.id: r.fold for r in f.collect()}


@pytest.mark.parametrize("p", [[0.1, 0.4, 0.35, 0.8], [0.5, 0.5, 0.5, 0.5], [0.9, 0.1, 0.9, 0.1]])
def test_ranking_metrics(spark, p):
    y = [0, 0, 1, 1]
    df = spark.createDataFrame(list(zip(map(float, y), p, strict=True)), "y double, pred double")
    pairs = [(a, b) for a, ya in zip(p, y, strict=True) if ya for b, yb in zip(p, y, strict=True) if not yb]
    auc = sum(1.0 if a > b else 0.5 if a == b else 0 for a, b in pairs) / len(pairs)
    assert metrics.evaluate(df, "auc").first()[0] == pytest.approx(auc)
    ap, seen = 0.0, 0
    for s in sorted(set(p), reverse=True):
        at = [ya for a, ya in zip(p, y, strict=True) if a >= s]
        ap += (sum(at) - seen) * sum(at) / len(at)
        seen = sum(at)
    assert metrics.evaluate(df, "prauc").first()[0] == pytest.approx(ap / 2)
    with pytest.raises(ValueError):
        metrics.evaluate(df, "f1")


def test_latent(spark):
    df = spark.createDataFrame([(i, i % 4, (i * 7) % 5) for i in range(60)], "id long, a int, b int")
    t = TrainTest.from_pair(df.where("id < 40"), df.where("id >= 40"), "id")
    out = latent.matrix_factorization(t, ["a", "b"], 3, 2)
    new = [c for c in out.columns if c not in ("id", "a", "b")]
    assert new == [f"CountSVD2_{x}_{i}" for x in ("a_b", "b_a") for i in range(2)] + [f"CountLDA3_{x}_{i}" for x in ("a_b", "b_a") for i in range(3)]
    for r in out.df.collect():
        assert sum(r[f"CountLDA3_a_b_{i}"] for i in range(3)) == pytest.approx(1, abs=1e-5)
    with pytest.raises(TypeError):
        latent.latent_features(TrainTest.from_pair(df.withColumn("a", F.lit("x")), df.withColumn("a", F.lit("x"))), ["a", "b"], 2, latent.svd, "S")


def test_svd_rebuilds_counts(spark):
    df = spark.createDataFrame([(0, 10), (0, 10), (1, 11), (1, 10), (2, 12)], "a int, b int")
    docs = latent.counted(latent.token_counts(df, "a", "b"))
    counts = {r.doc: r.counts.toArray() for r in docs.collect()}
    parts = {r.doc: r.v for r in latent.svd(docs, 3).collect()}
    for i in counts:
        for j in counts:
            assert float(counts[i] @ counts[j]) == pytest.approx(sum(a * b for a, b in zip(parts[i], parts[j], strict=True)), abs=1e-4)


def test_svd_of_few_documents_with_close_directions(spark):
    """Like days by customers: MLlib's solver ended with an error, as the second and third direction are nearly of one length."""
    cells = spark.range(120_000).select((F.xxhash64("id") % 31).alias("h"), F.col("id"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("r"))
    tokens = cells.select(F.pmod(F.xxhash64("id", "r"), F.lit(31)).alias("doc"), F.format_string("cust%06d", "id").alias("token")).groupBy("doc", "token").agg(F.count("*").alias("n"))
    docs = latent.counted(tokens).persist()
    rows = {r.doc: r.counts for r in docs.collect()}
    parts = {r.doc: np.array(r.v, dtype=float) for r in latent.svd(docs, 2).collect()}
    docs.unpersist()
    names = sorted(rows)
    dense = np.array([rows[d].toArray() for d in names])
    w, u = np.linalg.eigh(dense @ dense.T)
    mine = np.array([parts[d] for d in names])
    assert len(names) == 31 and dense.shape[1] == 120_000
    for c in range(2):
        theirs = u[:, -1 - c] * w[-1 - c] ** 0.5
        right = dense.T @ theirs
        theirs = theirs * np.sign(right[np.abs(right).argmax()])
        assert mine[:, c] == pytest.approx(theirs, rel=1e-4, abs=1e-3 * np.abs(theirs).max())


@pytest.mark.parametrize("small", [0, 1024])
def test_svd_is_the_same_on_either_side(spark, monkeypatch, small):
    monkeypatch.setattr(latent, "SMALL", small)
    for docs_n, tokens_n in ((12, 200), (200, 12), (150, 140)):
        cells = spark.range(docs_n * 8).select((F.col("id") % docs_n).alias("doc"), F.format_string("tok%04d", F.pmod(F.xxhash64("id"), F.lit(tokens_n))).alias("token"), (1 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(9))).alias("n"))
        docs = latent.counted(cells.groupBy("doc", "token").agg(F.sum("n").alias("n")))
        rows, parts = {r.doc: r.counts.toArray() for r in docs.collect()}, {r.doc: r.v for r in latent.svd(docs, 3).collect()}
        dense = np.array([rows[d] for d in sorted(rows)])
        _, _, right = np.linalg.svd(dense, full_matrices=False)
        v = right[:3].T
        v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(3)])
        assert np.array([parts[d] for d in sorted(rows)]) == pytest.approx(dense @ v, abs=1e-3)


def test_svd_of_few_documents_pads_beyond_the_rank(spark):
    cells = spark.createDataFrame([(d, f"t{i}", (d + 1) * (i + 1)) for d in range(2) for i in range(5)], "doc long, token string, n long")
    parts = {r.doc: r.v for r in latent.svd(latent.counted(cells), 3).collect()}
    assert parts[0] == pytest.approx([55**0.5, 0, 0], abs=1e-5) and parts[1] == pytest.approx([2 * 55**0.5, 0, 0], abs=1e-5)


def test_lda_uses_every_document(spark):
    tokens = spark.range(200).select(F.col("id").alias("doc"), F.concat(F.lit("own"), "id").alias("token"), F.lit(50).cast("long").alias("n"))
    weights = latent.topics_of(latent.counted(tokens), 2).topicsMatrix().toArray().sum(axis=1)
    assert len(weights) == 200 and weights.min() > 10  # a token of a document never drawn keeps less than 3


def test_counts_are_not_cut(spark):
    hot = spark.createDataFrame([(0, "a", 3_300_000), (0, "b", 1), (1, "b", 2)], "doc long, token string, n long")
    assert {r.doc: list(r.counts.toArray()) for r in latent.counted(hot).collect()} == {0: [3_300_000, 1], 1: [0, 2]}
    many = spark.range(1_100_000).select((F.col("id") % 100).alias("doc"), F.concat(F.lit("t"), "id").alias("token"), F.lit(1).cast("long").alias("n"))
    vectors = latent.counted(many).collect()
    assert {r.counts.size for r in vectors} == {1_100_000} and sum(r.counts.numNonzeros() for r in vectors) == 1_100_000


def test_frame(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None)], "id long, y double")
    t = TrainTest.from_null_target(df, "y", "id")
    assert t.train.count() == t.test.count() == 1 and t.columns == ["id", "y"] and {SPLIT, ROW_ID} <= set(t.df.columns)


def _statistics_rows(spark, n=60_000):
    """A key of half of all rows, a key without values, null keys, skewed and tied values, nulls and NaN."""
    i = F.col("id")
    u = lambda seed: F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(1_000_003)) / 1_000_003
    df = spark.range(n).withColumn("k", F.when(u(1) < 0.5, 0).when(u(1) < 0.51, None).otherwise((u(2) * 40).cast("int")))
    df = df.withColumn("a", F.when((F.col("k") == 7) | (u(3) < 0.1), None).when(u(3) < 0.12, float("nan")).otherwise(F.pow(u(4) - 0.3, F.lit(5.0)) * 1e6))
    return df.withColumn("b", (u(5) * 4).cast("int")).withColumn("c", F.when(u(6) > 0.2, F.col("a") + 1000 * u(7)))


def test_medians_are_exact(spark):
    df = _statistics_rows(spark)
    values = {"a": F.nanvl("a", F.lit(None)), "b": F.col("b")}
    theirs = {r.k: (r.a, r.b) for r in df.groupBy("k").agg(F.median(values["a"]).alias("a"), F.median("b").alias("b")).collect()}
    assert {r.k: (r.a, r.b) for r in exact_medians(df, {"k": F.col("k")}, values).collect()} == theirs
    assert theirs[7][0] is None and None in theirs
    assert tuple(exact_medians(df, {}, values).first()) == tuple(df.agg(F.median(values["a"]), F.median("b")).first())
    assert {r.k: (r.a, r.b) for r in exact_medians(df, {"k": F.col("k")}, values, accuracy=500).collect()} == theirs


def test_medians_of_nothing_and_of_few(spark):
    none = spark.createDataFrame([], "k int, v double")
    assert exact_medians(none, {}, {"v": F.col("v")}).collect() == [(None,)]
    assert exact_medians(none, {"k": F.col("k")}, {"v": F.col("v")}).collect() == []
    few = spark.createDataFrame([(1, 3.0), (2, 1.0), (2, 2.0), (3, float("inf")), (3, 1.0), (3, 1.0)], "k int, v double")
    assert {r.k: r.v for r in exact_medians(few, {"k": F.col("k")}, {"v": F.col("v")}).collect()} == {1: 3.0, 2: 1.5, 3: 1.0}
    assert fitted.fit(few, ["v"], "fillna").numbers == {"v": (1.5,)}
    with pytest.raises(ValueError):
        fitted.fit(few, ["v"], "fillna", "mode")


def test_correlations_are_those_of_each_pair(spark):
    df = _statistics_rows(spark).withColumns({"one": F.lit(0.1), "none": F.lit(None).cast("double"), "far": F.col("b") + 1e9, "odd": F.when(F.col("a").isNull(), 5.0).otherwise(F.when(F.col("b") > 9, 1.0).otherwise(2.0))})
    names = ["a", "b", "c", "one", "none", "far", "odd"]
    got = selection.correlations(df, names)
    k = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in names}
    for (x, y), r in got.items():
        want = df.agg(safe_corr(k[x], k[y])).first()[0]
        assert (r is None) == (want is None), (x, y, r, want)
        assert r is None or abs(r - want) < 1e-6, (x, y, r, want)
    assert got["a", "odd"] is None and got["one", "b"] is None and abs(got["b", "far"] - 1) < 1e-6
    assert set(selection.correlations(df.limit(0), ["a", "b"]).values()) == {None}
    assert selection.correlations(df, ["a"]) == {}


def test_ranking_metrics_with_an_outlier(spark):
    """One score far from the others must not put them into one range; ties and both ends count."""
    df = spark.range(5000).select((F.col("id") % 3 == 0).cast("double").alias("y"), F.when(F.col("id") == 17, 1e12).otherwise(F.pmod(F.xxhash64("id"), F.lit(700)) / 7).alias("p"))
    rows = [(r.y, r.p) for r in df.collect()]
    pos, neg = sorted(p for y, p in rows if y), [p for y, p in rows if not y]
    import bisect

    wins = sum(len(pos) - bisect.bisect_right(pos, n) + (bisect.bisect_right(pos, n) - bisect.bisect_left(pos, n)) / 2 for n in neg)
    assert abs(metrics.evaluate(df, "auc", "y", "p").first()[0] - wins / len(pos) / len(neg)) < 1e-12
    total = 0.0
    for s in set(p for _, p in rows):
        at, hit = [y for y, p in rows if p >= s], [y for y, p in rows if p == s]
        total += sum(hit) * sum(at) / len(at)
    assert abs(metrics.evaluate(df, "prauc", "y", "p").first()[0] - total / len(pos)) < 1e-12
    assert metrics.evaluate(df.limit(0), "auc", "y", "p").first()[0] is None
