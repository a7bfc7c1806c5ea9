"""Every registered query of the core against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from marginalia.plans import catalog
from marginalia.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def values(frame):
    def one(x):
        if x is None or x != x:
            return "null"
        return repr(round(float(x), 6)) if isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) else str(x)

    return sorted(tuple(one(x) for x in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, sql, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), sql.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and values(got) == values(want)


def test_the_entry_point(spark):
    asked = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 20 = 0").count()
    assert __spark_entry__.entry(spark).count() == 10 * asked > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
