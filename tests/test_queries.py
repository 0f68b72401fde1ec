import pytest

import __spark_entry__ as entry
from tabloom.queries import ORACLE, QUERIES
from tabloom.queries.tabular import latent_rows

from .oracle import connect, rows_of_spark, rows_of_sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    if name not in ORACLE:
        assert df.count() > 0
        return
    names, mine = rows_of_spark(df)
    theirs_names, theirs = rows_of_sql(connect(SF), ORACLE[name])
    assert names == theirs_names
    assert mine == theirs


def test_latent_query_has_whole_keys(spark):
    out = latent_rows(spark, SF)
    assert out.select("cust").distinct().count() == spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey").distinct().count()


def test_entry(spark):
    assert entry.entry(spark).count() == 1500
