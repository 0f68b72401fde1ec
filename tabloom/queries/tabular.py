"""One query for each operator family. Doubles are rounded in both engines to digits that both compute alike."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import ROW_ID, SPLIT, TrainTest
from ..functions import metrics
from ..functions.expr import threshold
from ..operators import columns as C
from ..operators import encoders as E
from ..operators import folds, groupby, latent, selection
from ..operators.medians import exact_medians
from ..plans import models, runner
from ..sources import io, store
from ..streaming import fitted

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def split(df: DataFrame, key: str) -> TrainTest:
    """Every fifth key is a test row."""
    return TrainTest.marked(df, F.col(key) % 5 != 0, key)


def r(name: str, digits: int = 4, out: str | None = None):
    return F.round(F.col(f"`{name}`").cast("double"), digits).alias(out or name)


def shift(digits: int) -> float:
    """Added before rounding in both engines: averages of amounts in cents often end in an exact half of the last digit."""
    return 0.0314159 * 10.0**-digits


def rs(name: str, digits: int = 4, out: str | None = None):
    return F.round(F.col(f"`{name}`").cast("double") + shift(digits), digits).alias(out or name)


def sql_rs(expr: str, digits: int) -> str:
    return f"ROUND({expr} + {shift(digits):.12f}::DOUBLE, {digits})"


# ---- F: fitted column transforms ------------------------------------------------------------------

CUSTOMER = "(SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS v, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS seg, c_nationkey FROM customer)"


def customers(spark: SparkSession, d: str) -> TrainTest:
    c = t(spark, d, "customer")
    df = c.select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("v"), F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment")).alias("seg"), "c_nationkey")
    return split(df, "c_custkey")


@query(f"SELECT c_custkey, ROUND((v - m) / s, 6) AS v FROM {CUSTOMER} c, (SELECT avg(v) m, stddev_pop(v) s FROM {CUSTOMER} x WHERE c_custkey % 5 <> 0) st")
def F1_standerize(spark, d):
    return C.standerize(customers(spark, d), ["v"]).df.select("c_custkey", r("v", 6))


@query(f"SELECT c_custkey, ROUND(coalesce(v, m), 4) AS v FROM {CUSTOMER} c, (SELECT median(v) m FROM {CUSTOMER} x WHERE c_custkey % 5 <> 0) st")
def F2_fillna_median(spark, d):
    return C.fillna(customers(spark, d), ["v"], "median").df.select("c_custkey", r("v"))


@query(f"SELECT c_custkey, ROUND(coalesce(v, m), 4) AS v FROM {CUSTOMER} c, (SELECT avg(v) m FROM {CUSTOMER} x WHERE c_custkey % 5 <> 0) st")
def F2_fillna_mean(spark, d):
    return C.fillna(customers(spark, d), ["v"], "mean").df.select("c_custkey", r("v"))


@query("SELECT p_partkey, ROUND(cos(2 * pi() * p_size / m), 6) AS p_size_cos, ROUND(sin(2 * pi() * p_size / m), 6) AS p_size_sin FROM part, (SELECT max(p_size) m FROM part WHERE p_partkey % 5 <> 0) st")
def F3_circle(spark, d):
    out = C.circle_encoding(split(t(spark, d, "part"), "p_partkey"), ["p_size"])
    return out.df.select("p_partkey", r("p_size_cos", 6), r("p_size_sin", 6))


@query(f"SELECT c_custkey, CASE WHEN seg IS NULL THEN NULL ELSE ROUND(count(*) OVER (PARTITION BY seg) * 1.0::DOUBLE / count(seg) OVER (), 8) END AS fe_seg FROM {CUSTOMER} c")
def F4_frequency(spark, d):
    return C.frequency_encoding(customers(spark, d), ["seg"]).df.select("c_custkey", r("fe_seg", 8))


@query(f"SELECT c_custkey, ((v IS NULL)::INT + (seg IS NULL)::INT)::INT AS count_null, (v IS NULL)::INT AS cn_v, (seg IS NULL)::INT AS cn_seg FROM {CUSTOMER} c")
def F5_count_null(spark, d):
    out = C.count_null(customers(spark, d), ["v", "seg", "c_nationkey"]).df
    return out.select("c_custkey", F.col("count_null").cast("int").alias("count_null"), "cn_v", "cn_seg")


@query("SELECT o_orderkey::BIGINT AS o_orderkey, o_custkey::BIGINT AS o_custkey, ROUND(o_totalprice::FLOAT::DOUBLE, 2) AS o_totalprice FROM orders")
def F6_downcast(spark, d):
    out = C.reduce_mem_usage(t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"))
    return out.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_custkey").cast("long").alias("o_custkey"), F.round(F.col("o_totalprice").cast("double"), 2).alias("o_totalprice"))


@query(f"SELECT c_custkey, ROUND((coalesce(v, -1) - m) / s, 6) AS v FROM {CUSTOMER} c, (SELECT avg(coalesce(v, -1)) m, stddev_pop(coalesce(v, -1)) s FROM {CUSTOMER} x WHERE c_custkey % 5 <> 0) st WHERE c_custkey % 5 = 0 OR c_custkey < 101")
def F7_nn_features(spark, d):
    out = C.nn_features(customers(spark, d).select("v")).df
    return out.select(F.col(ROW_ID).alias("c_custkey"), r("v", 6))


# ---- S, P: projections and predicates -------------------------------------------------------------


@query("SELECT event_id, year(ts)::INT AS ts_year, month(ts)::INT AS ts_month, day(ts)::INT AS ts_day, (isodow(ts) - 1)::INT AS ts_dow, hour(ts)::INT AS ts_hour, minute(ts)::INT AS ts_minute FROM events")
def S1_datetime(spark, d):
    return C.datetime_parser(split(t(spark, d, "events"), "event_id"), ["ts"]).df.select("event_id", *[f"ts_{x}" for x in ("year", "month", "day", "dow", "hour", "minute")])


@query("SELECT event_id, year(ts)::INT AS s_year, minute(ts)::INT AS s_minute FROM events")
def S2_datetime_from_text(spark, d):
    e = t(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("s"))
    return C.datetime_parser(split(e, "event_id"), ["s"]).df.select("event_id", "s_year", "s_minute")


SCORED = "(SELECT event_id, value, (event_id * 37 % 1000) / 1000.0::DOUBLE AS p, (event_id % 3 = 0)::INT::DOUBLE AS y FROM events)"


def scored(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events")
    return e.select("event_id", "value", (F.col("event_id") * 37 % 1000 / 1000).alias("p"), (F.col("event_id") % 3 == 0).cast("double").alias("y"))


@query(f"SELECT event_id, (p > 0.5)::INT AS label FROM {SCORED} e")
def S8_threshold(spark, d):
    return scored(spark, d).select("event_id", threshold(F.col("p")).alias("label"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 4 <> 0")
def P1_null_target_split(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("target"))
    return TrainTest.from_null_target(o, "target", "o_orderkey").train.drop("target")


@query(f"SELECT event_id, y FROM {SCORED} e WHERE abs(y - p) < 0.4")
def P2_residual_filter(spark, d):
    s = scored(spark, d).withColumnRenamed("event_id", ROW_ID)
    out = runner.residual_filter(s.select(ROW_ID, "y"), s.select(ROW_ID, F.col("p").alias("pred")), 0.4)
    return out.withColumnRenamed(ROW_ID, "event_id")


def _pseudo(spark, d, **how):
    s = scored(spark, d).withColumnRenamed("event_id", ROW_ID)
    out = runner.pseudo_labels(s.select(ROW_ID, "value"), s.select(ROW_ID, F.col("p").alias("pred")), **how)
    return out.select(F.col(ROW_ID).alias("event_id"), "value", "y")


@query(f"SELECT event_id, value, (p > 0.5)::INT::DOUBLE AS y FROM {SCORED} e WHERE p < 0.1 OR p > 0.9")
def P3_pseudo_symmetric(spark, d):
    return _pseudo(spark, d, low=0.1)


@query(f"SELECT event_id, value, (p > 0.5)::INT::DOUBLE AS y FROM {SCORED} e WHERE p < 0.2 OR p > 0.95")
def P4_pseudo_asymmetric(spark, d):
    return _pseudo(spark, d, low=0.2, high=0.95)


@query(f"SELECT event_id, value, p AS y FROM {SCORED} e")
def P5_pseudo_soft(spark, d):
    return _pseudo(spark, d)


# ---- A: grouped aggregates ---------------------------------------------------------------------------

AGGS = ("mean", "sum", "median", "min", "max", "var", "std")
DIGITS = {"sum": 2, "var": 0}


def _sql_aggs(var: str, keys: str) -> str:
    sql = {"mean": f"avg({var})", "sum": f"coalesce(sum({var}), 0)", "median": f"median({var})", "min": f"min({var})", "max": f"max({var})", "var": f"var_samp({var})", "std": f"stddev_samp({var})"}
    return ", ".join(f"{sql[a]} AS {a}_{var}_groupby_{keys}" for a in AGGS)


EVENTS = "(SELECT event_id, CASE WHEN user_id % 50 = 0 THEN NULL ELSE user_id END AS user_id, event_type, CASE WHEN user_id % 40 = 1 THEN NULL ELSE value END AS value FROM events)"


@query(f"SELECT event_id, {', '.join(sql_rs(f'{a}_value_groupby_user_id_event_type', DIGITS.get(a, 4)) + f' AS {a}_value_groupby_user_id_event_type' for a in AGGS)}, n::BIGINT AS nunique_value_groupby_user_id_event_type FROM {EVENTS} e LEFT JOIN (SELECT user_id AS ku, event_type AS ke, {_sql_aggs('value', 'user_id_event_type')}, count(DISTINCT value) AS n FROM {EVENTS} x GROUP BY ALL) g ON user_id = ku AND event_type = ke")
def A1_group_multi(spark, d):
    e = t(spark, d, "events").select("event_id", F.when(F.col("user_id") % 50 != 0, F.col("user_id")).alias("user_id"), "event_type", F.when(F.col("user_id") % 40 != 1, F.col("value")).alias("value"))
    spec = groupby.GroupSpec(("user_id", "event_type"), ("value",), (*AGGS, "nunique"))
    out = groupby.groupby_features(e, [spec])
    return out.select("event_id", *[rs(f"{a}_value_groupby_user_id_event_type", DIGITS.get(a, 4)) for a in AGGS], "nunique_value_groupby_user_id_event_type")


PRICE = {"key": ["o_orderpriority"], "var": ["o_totalprice"], "agg": list(AGGS)}
BUYERS = {"key": ["o_orderpriority"], "var": ["o_custkey"], "agg": ["nunique"]}


def _orders_sql() -> str:
    names = [f"{a}_o_totalprice_groupby_o_orderpriority" for a in AGGS]
    plain = ", ".join(f"{sql_rs(n, DIGITS.get(a, 4))} AS {n}" for a, n in zip(AGGS, names, strict=True))
    diff = ", ".join(f"{sql_rs(f'({n} - o_totalprice)', DIGITS.get(a, 4))} AS diff_{n}" for a, n in zip(AGGS, names, strict=True))
    ratio = ", ".join(f"ROUND(o_totalprice / {n}, 8) AS ratio_{n}" for n in names)
    return f"SELECT o_orderkey, nunique_o_custkey_groupby_o_orderpriority::BIGINT AS nunique_o_custkey_groupby_o_orderpriority, {plain}, {diff}, {ratio} FROM orders LEFT JOIN (SELECT o_orderpriority AS k, count(DISTINCT o_custkey) AS nunique_o_custkey_groupby_o_orderpriority, {_sql_aggs('o_totalprice', 'o_orderpriority')} FROM orders GROUP BY 1) g ON o_orderpriority = k"


@query(_orders_sql())
def A4_aggregation(spark, d):
    out = groupby.aggregation(split(t(spark, d, "orders"), "o_orderkey"), [PRICE], [BUYERS]).df
    names = [f"{a}_o_totalprice_groupby_o_orderpriority" for a in AGGS]
    digits = dict(zip(names, (DIGITS.get(a, 4) for a in AGGS), strict=True))
    return out.select("o_orderkey", "nunique_o_custkey_groupby_o_orderpriority", *[rs(n, digits[n]) for n in names], *[rs(f"diff_{n}", digits[n]) for n in names], *[r(f"ratio_{n}", 8) for n in names])


@query("SELECT o_orderkey, " + sql_rs("(avg(o_totalprice) OVER (PARTITION BY o_custkey) - o_totalprice)", 4) + " AS diff_mean FROM orders")
def A2_diff(spark, d):
    spec = [{"key": ["o_custkey"], "var": ["o_totalprice"], "agg": ["mean"]}]
    out = groupby.diff_features(groupby.groupby_features(t(spark, d, "orders"), spec), spec)
    return out.select("o_orderkey", rs("diff_mean_o_totalprice_groupby_o_custkey", 4, "diff_mean"))


@query("SELECT o_orderkey, ROUND(o_totalprice / max(o_totalprice) OVER (PARTITION BY o_custkey), 8) AS ratio_max FROM orders")
def A3_ratio(spark, d):
    spec = [{"key": ["o_custkey"], "var": ["o_totalprice"], "agg": ["max"]}]
    out = groupby.ratio_features(groupby.groupby_features(t(spark, d, "orders"), spec), spec)
    return out.select("o_orderkey", r("ratio_max_o_totalprice_groupby_o_custkey", 8, "ratio_max"))


@query("SELECT c_custkey, s AS sum_w, m AS mean_w, n::BIGINT AS count_w FROM customer LEFT JOIN (SELECT c_nationkey AS k, ROUND(coalesce(sum(CASE WHEN c_nationkey > 4 THEN c_acctbal END), 0), 2) AS s, ROUND(avg(CASE WHEN c_nationkey > 4 THEN c_acctbal END), 4) AS m, count(CASE WHEN c_nationkey > 4 THEN c_acctbal END) AS n FROM customer GROUP BY 1) g ON c_nationkey = k")
def A5_null_group(spark, d):
    c = t(spark, d, "customer").withColumn("w", F.when(F.col("c_nationkey") > 4, F.col("c_acctbal")))
    out = groupby.groupby_features(c, [{"key": "c_nationkey", "var": "w", "agg": ["sum", "mean", "count"]}])
    return out.select("c_custkey", r("sum_w_groupby_c_nationkey", 2, "sum_w"), r("mean_w_groupby_c_nationkey", 4, "mean_w"), F.col("count_w_groupby_c_nationkey").alias("count_w"))


@query("SELECT c_custkey, ROUND(b - a, 2) AS value_range FROM customer LEFT JOIN (SELECT c_nationkey AS k, max(c_acctbal) AS b, min(c_acctbal) AS a FROM customer GROUP BY 1) g ON c_nationkey = k")
def A7_callable_aggregate(spark, d):
    def value_range(c):
        return F.max(c) - F.min(c)

    out = groupby.groupby_features(t(spark, d, "customer"), [groupby.GroupSpec(("c_nationkey",), ("c_acctbal",), (value_range,))])
    return out.select("c_custkey", r("value_range_c_acctbal_groupby_c_nationkey", 2, "value_range"))


PART_COLS = ("p_name", "p_brand", "p_type", "p_size", "p_retailprice")


@query(f"SELECT {', '.join(f'count(DISTINCT {c})::BIGINT AS {c}' for c in PART_COLS)} FROM part")
def A9_nunique_columns(spark, d):
    return selection.distinct_counts(t(spark, d, "part"), PART_COLS)


@query("SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, ROUND(avg(c_acctbal), 4) AS mean, ROUND(median(c_acctbal), 4) AS median, count(*)::BIGINT AS n FROM customer")
def A10_global(spark, d):
    customer, c = t(spark, d, "customer"), F.col("c_acctbal")
    rest = customer.agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.round(F.avg(c), 4).alias("mean"), F.count("*").alias("n"))
    return rest.crossJoin(F.broadcast(exact_medians(customer, {}, {"median": c}))).withColumn("median", F.round("median", 4))


NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]


@query("SELECT " + ", ".join(f"ROUND(corr({a}, {b}), 8) AS {a}__{b}" for a, b in PAIRS) + " FROM lineitem")
def A11_corr(spark, d):
    found = selection.correlations(t(spark, d, "lineitem"), NUMBERS)
    return spark.createDataFrame([tuple(found[p] for p in PAIRS)], ", ".join(f"{a}__{b} double" for a, b in PAIRS)).select(*[r(f"{a}__{b}", 8) for a, b in PAIRS])


@query("SELECT user_id AS id, " + sql_rs("avg(value)", 6) + " AS pred FROM events GROUP BY user_id")
def A12_fold_mean(spark, d):
    e = t(spark, d, "events")
    parts = [e.where(F.col("event_id") % 2 == k).select(F.col("user_id").alias(ROW_ID), F.col("value").alias("pred")) for k in range(2)]
    return runner.average_predictions(parts).select(F.col(ROW_ID).alias("id"), rs("pred", 6))


@query("SELECT feature, " + sql_rs("v", 6) + " AS importance FROM (SELECT user_id::VARCHAR AS feature, avg(v) AS v FROM (SELECT event_type, user_id, avg(value) AS v FROM events GROUP BY 1, 2) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200)")
def A13_top_importance(spark, d):
    e = t(spark, d, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("v")).orderBy("event_type")
    parts: dict[str, dict[str, float]] = {}
    for r in e.toLocalIterator():
        parts.setdefault(r.event_type, {})[str(r.user_id)] = r.v
    return runner.importances(spark, list(parts.values())).select("feature", rs("importance", 6))


@query("SELECT c_nationkey::BIGINT AS doc, lower('seg' || c_mktsegment) AS token, count(*)::BIGINT AS n FROM customer GROUP BY 1, 2")
def A14_token_counts(spark, d):
    c = t(spark, d, "customer").select("c_nationkey", F.col("c_mktsegment").alias("seg"))
    return latent.token_counts(c, "c_nationkey", "seg")


# ---- D: column selection and latent features ---------------------------------------------------------

PARTS = "(SELECT *, 1 AS one, p_size AS size2, p_size * 1.0::DOUBLE AS size3, p_brand AS brand2 FROM part)"


def _parts(spark, d):
    p = t(spark, d, "part").withColumns({"one": F.lit(1), "size2": F.col("p_size"), "size3": F.col("p_size").cast("double"), "brand2": F.col("p_brand")})
    return TrainTest.marked(p, F.lit(True), "p_partkey")


def _names(spark, names):
    return spark.createDataFrame([(n,) for n in names], "col string")


@query(f"SELECT col FROM (SELECT {', '.join(f'count(DISTINCT {c}) AS {c}' for c in (*PART_COLS, 'p_partkey', 'one', 'size2', 'size3', 'brand2'))} FROM {PARTS} p) UNPIVOT (n FOR col IN ({', '.join((*PART_COLS, 'p_partkey', 'one', 'size2', 'size3', 'brand2'))})) WHERE n = 1")
def D1_unique(spark, d):
    return _names(spark, selection.unique_columns(_parts(spark, d).df, _parts(spark, d).columns))


@query(f"SELECT col FROM (SELECT bool_and(size2 IS NOT DISTINCT FROM p_size) AS size2, bool_and(size3 IS NOT DISTINCT FROM p_size) AS size3, bool_and(brand2 IS NOT DISTINCT FROM p_brand) AS brand2, bool_and(one IS NOT DISTINCT FROM p_size) AS one FROM {PARTS} p) UNPIVOT (same FOR col IN (size2, size3, brand2, one)) WHERE same")
def D1_duplicated(spark, d):
    p = _parts(spark, d)
    return _names(spark, selection.duplicated_columns(p.df, p.columns, ROW_ID))


# a column goes if one before it that is still there correlates with it: a condition for each column in turn
LINES = "(SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_extendedprice * (1 - l_discount) AS net, l_quantity * 2 + l_tax AS twice, -l_quantity AS minus FROM lineitem)"
LINE_COLS = (*NUMBERS, "net", "twice", "minus")


def _greedy_sql() -> str:
    pairs = [(a, b) for i, a in enumerate(LINE_COLS) for b in LINE_COLS[i + 1 :]]
    high = "(SELECT " + ", ".join(f"corr({a}, {b}) AS {a}__{b}" for a, b in pairs) + f" FROM {LINES} x)"
    gone: dict[str, str] = {}
    for j, b in enumerate(LINE_COLS):
        gone[b] = "(" + " OR ".join([f"(NOT {gone[a]} AND {a}__{b} > 0.5)" for a in LINE_COLS[:j]] or ["false"]) + ")"
    return " UNION ALL ".join(f"SELECT '{c}' AS col FROM {high} h WHERE {gone[c]}" for c in LINE_COLS)


@query(_greedy_sql())
def D1_high_corr(spark, d):
    net, twice = F.col("l_extendedprice") * (1 - F.col("l_discount")), F.col("l_quantity") * 2 + F.col("l_tax")
    lines = t(spark, d, "lineitem").select(*NUMBERS, "l_returnflag", net.alias("net"), twice.alias("twice"), (-F.col("l_quantity")).alias("minus"))
    li = TrainTest.marked(lines, F.lit(True))
    return _names(spark, selection.detect_delete_cols(li, [], 0.5)[2])


def latent_rows(spark, d) -> DataFrame:
    """Orders with the latent features of their whole keys, written once as several sums read them."""
    o = t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("cust"), F.dayofmonth("o_orderdate").alias("day"))
    path = io.scratch(spark, "latent")
    latent.matrix_factorization(split(o, "o_orderkey"), ["cust", "day"], 3, 2).df.drop(SPLIT, ROW_ID).write.parquet(path)
    return spark.read.parquet(path)


# what holds for any topic model and any truncated decomposition: shares add up to one, singular directions are orthogonal, the
# first is the longest, and none is longer than the table itself
@query("SELECT o_orderkey, 1 AS shares, 1 AS orthogonal, 1 AS ordered, 1 AS within FROM orders")
def D3_D4_D5_matrix_factorization(spark, d):
    out = latent_rows(spark, d)
    shares, checks = F.lit(True), []
    for a, b in (("cust", "day"), ("day", "cust")):
        topics = [F.col(f"CountLDA3_{a}_{b}_{i}") for i in range(3)]
        shares = shares & (F.abs(topics[0] + topics[1] + topics[2] - 1) < 1e-4) & (F.least(*topics) >= 0)
        x, y = (F.col(f"CountSVD2_{a}_{b}_{i}").cast("double") for i in range(2))
        sums = out.select(a, x.alias("x"), y.alias("y")).distinct().agg(*[F.sum(v).alias(n) for n, v in (("xx", F.expr("x * x")), ("yy", F.expr("y * y")), ("xy", F.expr("x * y")))])
        whole = latent.token_counts(out, a, b).agg(F.sum(F.pow(F.col("n"), F.lit(2.0))).alias("nn"))
        checks.append(sums.crossJoin(F.broadcast(whole)).select((F.abs("xy") < 1e-3 * F.col("xx")).alias("orthogonal"), (F.col("xx") >= F.col("yy")).alias("ordered"), (F.col("xx") + F.col("yy") <= 1.0001 * F.col("nn")).alias("within")))
    both = checks[0].union(checks[1]).agg(*[F.bool_and(c).cast("int").alias(c) for c in ("orthogonal", "ordered", "within")])
    return out.select("o_orderkey", shares.cast("int").alias("shares")).crossJoin(F.broadcast(both))


# ---- E: encoders ----------------------------------------------------------------------------------------


@query("SELECT l_linenumber, l_quantity + l_tax AS l_quantityl_tax_plus, l_quantity + l_discount AS l_quantityl_discount_plus, l_tax + l_discount AS l_taxl_discount_plus FROM lineitem")
def E1_arithmetic(spark, d):
    step = E.arithmetic_combinations(["l_quantity", "l_tax", "l_discount"], drop_origin=True)
    return step(t(spark, d, "lineitem").select("l_linenumber", "l_quantity", "l_tax", "l_discount"))


@query("SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS p_brand, dense_rank() OVER (ORDER BY p_type) - 1 AS p_type FROM part")
def E2_label(spark, d):
    return E.label_encoder(["p_brand", "p_type"])(t(spark, d, "part").select("p_partkey", "p_brand", "p_type"))


@query("SELECT p_partkey, p_brand, count(*) OVER (PARTITION BY p_brand) AS p_brand_ce FROM part")
def E3_count(spark, d):
    return E.count_encoder(["p_brand"])(t(spark, d, "part").select("p_partkey", "p_brand"))


@query("SELECT p_partkey, p_brand || '|' || p_type AS p_brandp_type_combi, p_brand || '|' || p_size AS p_brandp_size_combi, p_type || '|' || p_size AS p_typep_size_combi FROM part")
def E4_concat(spark, d):
    return E.concat_combination(["p_brand", "p_type", "p_size"], drop_origin=True)(t(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size"))


OOF = "(SELECT o_orderkey, o_orderpriority AS k, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS y, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 5 END AS f FROM orders)"


@query(f"SELECT o_orderkey, ROUND((ts - coalesce(s, 0)) / (tn - coalesce(n, 0)), 4) AS te FROM {OOF} o LEFT JOIN (SELECT k AS k1, sum(y) ts, count(y) tn FROM {OOF} a GROUP BY 1) g ON k = k1 LEFT JOIN (SELECT k AS k2, f AS f2, sum(y) s, count(y) n FROM {OOF} b WHERE f IS NOT NULL GROUP BY 1, 2) h ON k = k2 AND f = f2")
def E5_target_oof(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("k"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("y"))
    out = E.target_encoder(["k"], "y", "o_orderkey", fold=(F.col("o_orderkey") % 5).cast("int"))(o)
    return out.select("o_orderkey", r("k_te", 4, "te"))


@query("SELECT p_partkey, (dense_rank() OVER (ORDER BY p_brand) - 1) AS p_brand, count(*) OVER (PARTITION BY p_brand) AS p_brand_ce FROM part")
def E6_pipeline(spark, d):
    steps = E.chain(E.label_encoder(["p_brand"]), E.count_encoder(["p_brand"]))
    return steps(t(spark, d, "part").select("p_partkey", "p_brand"))


# ---- C: folds and experiment frames ----------------------------------------------------------------------


@query("SELECT o_orderstatus, count(*)::BIGINT AS n, 5::BIGINT AS folds, 1::BIGINT AS within_one FROM orders GROUP BY 1")
def C1_stratified_fold(spark, d):
    f = folds.stratified_kfold(t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey")
    by = f.groupBy("o_orderstatus", "fold").agg(F.count("*").alias("n"))
    return by.groupBy("o_orderstatus").agg(F.sum("n").alias("n"), F.count("*").alias("folds"), (F.max("n") - F.min("n") <= 1).cast("long").alias("within_one"))


def sql_hash(key: str, seed: int) -> str:
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 15))::BIGINT"


@query(f"SELECT o_orderkey, ({sql_hash('o_orderkey', 111)} % 5)::INT AS fold FROM orders")
def C3_hash_fold(spark, d):
    return t(spark, d, "orders").select("o_orderkey", folds.kfold(F.col("o_orderkey")).alias("fold"))


@query("SELECT c_custkey AS id, c_acctbal AS bal, 0.0::DOUBLE AS y FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 1.0::DOUBLE FROM supplier")
def C8_adversarial(spark, d):
    a = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), F.lit(9.0).alias("y"))
    b = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"))
    return runner.adversarial(a, b)


@query("SELECT c_custkey AS id, c_acctbal AS bal, c_mktsegment AS seg FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def U1_union_by_name(spark, d):
    a = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    b = t(spark, d, "supplier").select(F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("id"))
    return TrainTest.from_pair(a, b).df.drop(SPLIT)


@query("SELECT o_orderkey, a.o_totalprice AS price, a.o_custkey, b.o_custkey + 1 AS second__o_custkey FROM orders a JOIN orders b USING (o_orderkey)")
def L15_feature_store(spark, d):
    o = t(spark, d, "orders")
    tables = {"first": o.select("o_orderkey", F.col("o_totalprice").alias("price"), "o_custkey"), "second": o.select("o_orderkey", (F.col("o_custkey") + 1).alias("o_custkey"))}
    return store.FeatureStore(spark, tables, "price", "o_orderkey").table()


# ---- M: metrics --------------------------------------------------------------------------------------------

RATED = "(SELECT doc_id, quality::DOUBLE AS y, ((n_chars % 997) + 1) / 1000.0::DOUBLE AS p FROM labels JOIN documents USING (doc_id))"


def rated(spark, d):
    return t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").cast("double").alias("y"), ((F.col("n_chars") % 997 + 1) / 1000).alias("pred"))


for _q, _name, _sql in [
    ("M1_log_loss", "log_loss", f"SELECT ROUND(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 8) AS score FROM {RATED} x"),
    ("M2_mae", "mean_absolute_error", f"SELECT ROUND(avg(abs(y - p)), 8) AS score FROM {RATED} x"),
    ("M3_rmse", "rmse", f"SELECT ROUND(sqrt(avg((y - p) ** 2)), 8) AS score FROM {RATED} x"),
    ("M4_auc", "auc", f"SELECT ROUND((sum(CASE WHEN y = 1 THEN r END) - n1 * (n1 + 1) / 2.0) / (n1 * n0), 8) AS score FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r FROM {RATED} x), (SELECT sum(y) n1, sum(1 - y) n0 FROM {RATED} z) GROUP BY n1, n0"),
    ("M5_average_precision", "prauc", f"SELECT ROUND(sum(pos * cp / cn) / sum(pos), 8) AS score FROM (SELECT pos, sum(pos) OVER (ORDER BY p DESC) cp, sum(n) OVER (ORDER BY p DESC)::DOUBLE cn FROM (SELECT p, sum(y) pos, count(*) n FROM {RATED} x GROUP BY p))"),
    ("M6_focal", "focal", f"SELECT ROUND(avg(CASE WHEN y = 1 THEN -0.25 * (1 - s) * ln(s) ELSE -0.75 * s * ln(1 - s) END), 8) AS score FROM (SELECT y, 1 / (1 + exp(-p)) AS s FROM {RATED} x)"),
]:
    _f = functools.partial(lambda spark, d, n: metrics.evaluate(rated(spark, d), n).select(r("score", 8)), n=_name)
    QUERIES[_q], ORACLE[_q] = _f, _sql

# ---- L: models ---------------------------------------------------------------------------------------------


def _model_rows(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias(ROW_ID), (F.col("o_custkey") % 100).cast("double").alias("a"), F.dayofmonth("o_orderdate").cast("double").alias("b"), F.col("o_orderpriority").alias("c"), F.col("o_totalprice").alias("price"))
    return o.where(F.col(ROW_ID) % 5 != 0), o.where(F.col(ROW_ID) % 5 == 0)


@query("SELECT o_orderkey, ROUND(my + (o_custkey % 100 - mx) * (n * cxy) / (n * vx + 10.0), 3) AS pred FROM orders, (SELECT count(*) n, avg(o_custkey % 100) mx, avg(o_totalprice) my, covar_pop(o_custkey % 100, o_totalprice) cxy, var_pop(o_custkey % 100) vx FROM orders WHERE o_orderkey % 5 <> 0) s WHERE o_orderkey % 5 = 0")
def L9_ridge(spark, d):
    tr, te = _model_rows(spark, d)
    m = models.ModelRIDGE("ridge", {"alpha": 10.0}).train(tr.select(ROW_ID, "a", F.col("price").alias("y")))
    return m.predict(te.select(ROW_ID, "a")).select(F.col(ROW_ID).alias("o_orderkey"), r("pred", 3))


@query("SELECT q AS query, o AS other, ROUND(dist, 5) AS distance FROM (SELECT a.vec_id AS q, b.vec_id AS o, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS rn FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 10 = 0) WHERE rn <= 5")
def L11_knn(spark, d):
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias(ROW_ID), F.col("embedding").alias("x"))
    return models.nearest(e, e.where(F.col(ROW_ID) % 10 == 0), 5, skip_self=True).select("query", "other", r("distance", 5))


@query("SELECT q AS vec_id, ROUND(avg((label = 1)::INT), 5) AS pred FROM (SELECT a.vec_id AS q, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS rn FROM embeddings a, embeddings b WHERE a.vec_id % 10 = 0 AND b.vec_id % 10 <> 0) WHERE rn <= 5 GROUP BY q")
def L11_knn_predict(spark, d):
    e = t(spark, d, "embeddings")
    width = e.agg(F.max(F.size("embedding"))).first()[0]
    e = e.select(F.col("vec_id").alias(ROW_ID), (F.col("label") == 1).cast("double").alias("y"), *[F.col("embedding")[i].alias(f"x{i}") for i in range(width)])
    m = models.ModelKNN("knn", {"n_neighbors": 5}).train(e.where(F.col(ROW_ID) % 10 != 0))
    return m.predict(e.where(F.col(ROW_ID) % 10 == 0).drop("y")).select(F.col(ROW_ID).alias("vec_id"), r("pred", 5))


LEARNT = "SELECT o_orderkey, 1 AS rows, 1 AS in_range, 1 AS beats_constant FROM orders WHERE o_orderkey % 5 = 0"


def _signal_rows(spark, d, classify: bool) -> tuple[DataFrame, DataFrame]:
    """Rows whose target follows from two columns, so that a model that learns must beat the best constant."""
    tr, te = _model_rows(spark, d)
    signal = F.col("a") + 2 * F.col("b")
    y = (signal > 80).cast("double") if classify else signal
    return tr.withColumn("y", y).drop("price"), te.withColumn("y", y).drop("price")


def _judged_model(model, tr: DataFrame, te: DataFrame, classify: bool) -> DataFrame:
    """For each test row: how often it is predicted, whether the prediction is within what training targets span, and whether all
    test predictions together are off by less (mean square) than the mean of the training targets."""
    pred = model.predict(te.drop("y")).join(te.select(ROW_ID, "y"), ROW_ID)
    span = tr.agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.avg("y").alias("mean"))
    wide = pred.crossJoin(F.broadcast(span))
    better = wide.agg((F.avg(F.pow(F.col("y") - F.col("pred"), F.lit(2.0))) < F.avg(F.pow(F.col("y") - F.col("mean"), F.lit(2.0)))).cast("int").alias("beats_constant"))
    slack = F.lit(0.0) if classify else (F.col("hi") - F.col("lo")) / 10
    within = F.col("pred").between(F.col("lo") - slack, F.col("hi") + slack)
    out = wide.withColumn("in_range", F.coalesce(within, F.lit(False)).cast("int")).crossJoin(F.broadcast(better))
    return out.groupBy(F.col(ROW_ID).alias("o_orderkey"), "beats_constant").agg(F.count("*").cast("int").alias("rows"), F.min("in_range").alias("in_range"))


class _Chances:
    """A model of margins as one of probabilities."""

    def __init__(self, model):
        self.model = model

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.predict(df).withColumn("pred", 1 / (1 + F.exp(-F.col("pred"))))


def _fitted(name: str, params: dict, classify: bool, valid: bool = False, margins: bool = False):
    def f(spark, d):
        tr, te = _signal_rows(spark, d, classify)
        model = models.build(name, name, params).train(tr, te if valid else None)
        return _judged_model(_Chances(model) if margins else model, tr, te, classify)

    return f


SMALL = {"num_boost_round": 3, "max_depth": 3}
FITTED = {
    "L1_lgbm": _fitted("ModelLGBM", SMALL, False, True),
    "L3_focal": _fitted("ModelFocalLGBM", {"num_boost_round": 5, "learning_rate": 0.5, "max_depth": 3}, True, margins=True),
    "L4_xgb": _fitted("ModelXGB", {**SMALL, "objective": "binary:logistic"}, True, True),
    "L5_cat_classifier": _fitted("ModelCatClassifier", {"iterations": 3, "depth": 3}, True, True),
    "L6_cat_regressor": _fitted("ModelCatRegressor", {"iterations": 3, "depth": 3}, False, True),
    "L7_rf_classifier": _fitted("ModelRFClassifier", {"n_estimators": 5, "max_depth": 4}, True),
    "L8_rf_regressor": _fitted("ModelRFRegressor", {"n_estimators": 5, "max_depth": 4}, False),
    "L10_svm": _fitted("ModelSVM", {"max_iter": 5}, True),
    "L12_nn": _fitted("ModelNN", {"epochs": 5, "hidden": [4]}, True),
}
QUERIES |= FITTED
ORACLE |= dict.fromkeys(FITTED, LEARNT)

# ---- streaming extension --------------------------------------------------------------------------------------


@query("SELECT p_partkey, ROUND((p_size - m) / s, 6) AS p_size FROM part, (SELECT avg(p_size) m, stddev_pop(p_size) s FROM part WHERE p_partkey % 5 <> 0) st")
def X1_fitted_scaler(spark, d):
    p = t(spark, d, "part")
    return fitted.fit(p.where(F.col("p_partkey") % 5 != 0), ["p_size"], "standerize")(p.select("p_partkey", "p_size")).select("p_partkey", r("p_size", 6))


# ---- sources, sinks and the runner --------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def IO1_IO4_csv(spark, d):
    c = t(spark, d, "customer")
    path = io.scratch(spark, "csv")
    io.write_csv(c, path)
    return io.read_csv(spark, path, c.schema)


@query("SELECT p_partkey, p_brand, count(*) OVER (PARTITION BY p_brand) AS p_brand_ce FROM part")
def IO6_IO7_memoised(spark, d):
    path, part = io.scratch(spark, "memo"), t(spark, d, "part").select("p_partkey", "p_brand")
    store.run_pipeline([E.label_encoder(["p_brand"])], part, path)  # another plan at the same place
    return store.run_pipeline([E.count_encoder(["p_brand"])], part, path)


@query("SELECT event_id, ROUND(abs(value), 6) AS a, ROUND(exp(-value / 100), 8) AS e, ROUND(1 / (1 + exp(-value / 100)), 8) AS s, ROUND(pow(value, 2), 2) AS q, CASE WHEN value > 0 THEN ROUND(ln(value), 8) END AS l FROM events")
def S5_S7_scalars(spark, d):
    v = F.col("value")
    return t(spark, d, "events").select("event_id", F.round(F.abs(v), 6).alias("a"), F.round(F.exp(-v / 100), 8).alias("e"), F.round(1 / (1 + F.exp(-v / 100)), 8).alias("s"), F.round(F.pow(v, F.lit(2.0)), 2).alias("q"), F.when(v > 0, F.round(F.log(v), 8)).alias("l"))


@query("SELECT p_partkey FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 5)")
def P6_isin_top(spark, d):
    p = t(spark, d, "part")
    top = p.groupBy("p_brand").count().orderBy(F.desc("count"), "p_brand").limit(5)
    return p.join(top, "p_brand", "left_semi").select("p_partkey")


@query("SELECT p_brand, count(*)::BIGINT AS n FROM part GROUP BY 1")
def A8_group_size(spark, d):
    return t(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))


def _runner(spark, d, **more):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias(ROW_ID), (F.col("o_custkey") % 100).cast("double").alias("a"), F.dayofmonth("o_orderdate").alias("b"), (F.col("o_totalprice") > 150000).cast("double").alias("y"))
    tr, te = o.where(F.col(ROW_ID) % 5 != 0), o.where(F.col(ROW_ID) % 5 == 0).drop("y")
    config = {"run_name": "orders", "model_name": "ModelRFClassifier", "evaluation_metric": "log_loss", "n_splits": 3, "cols_definition": {"target_col": "y"}, "params": {"n_estimators": 3, "max_depth": 3}, **more}
    return runner.Runner(spark, config, (tr.drop("y"), tr.select(ROW_ID, "y"), te), io.scratch(spark, "run"))


@query(f"SELECT o_orderkey, 1 AS rows, 1 AS in_range, 1 AS score_is_of_oof, ((row_number() OVER (PARTITION BY o_totalprice > 150000 ORDER BY {sql_hash('o_orderkey', 7)}, o_orderkey) - 1) % 3)::INT AS fold FROM orders WHERE o_orderkey % 5 <> 0")
def C4_C5_train_cv(spark, d):
    run = _runner(spark, d)
    score = run.run_train_cv()["score"]
    again = -F.log(F.when(F.col("y") == 1, F.col("pred")).otherwise(1 - F.col("pred")))
    same = run.oof().agg((F.abs(F.avg(again) - score) < 1e-9).cast("int").alias("score_is_of_oof"))
    oof = run.oof().join(run.folded().select(ROW_ID, "fold"), ROW_ID).crossJoin(F.broadcast(same))
    return oof.groupBy(F.col(ROW_ID).alias("o_orderkey"), "fold", "score_is_of_oof").agg(F.count("*").cast("int").alias("rows"), F.max(F.col("pred").between(0, 1).cast("int")).alias("in_range"))


@query("SELECT o_orderkey, 1 AS is_exp_of_mean FROM orders WHERE o_orderkey % 5 = 0")
def C6_C7_predict_and_submit(spark, d):
    run = _runner(spark, d, advanced={"predict_exp": None})
    run.run_train_cv()
    run.run_predict_cv()
    sample = t(spark, d, "orders").where("o_orderkey % 5 = 0").select("o_orderkey", F.lit(0.0).alias("y"))
    run.submission(sample, "o_orderkey", "y")
    back = io.read_csv(spark, f"{run.folder}/submission", "o_orderkey long, y double")
    parts = [run.build_model(k).load(f"{run.folder}/model/{k}").predict(run.test) for k in range(3)]
    mean = parts[0].union(parts[1]).union(parts[2]).groupBy(F.col(ROW_ID).alias("o_orderkey")).agg(F.avg("pred").alias("p"))
    return back.join(mean, "o_orderkey").select("o_orderkey", (F.abs(F.col("y") - F.exp("p")) < 1e-9).cast("int").alias("is_exp_of_mean"))


@query(LEARNT)
def L2_tuned(spark, d):
    tr, te = _signal_rows(spark, d, True)
    m = models.ModelOptunaLGBM("tuned", {"num_boost_round": 2, "objective": "binary"})
    m.steps = {"max_depth": (2, 3)}
    return _judged_model(m.train(tr, te), tr, te, True)
