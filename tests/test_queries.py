"""Every registered query of the reference's operators against its SQL."""

import math

import duckdb
import pytest

from lumenpath import queries as Q
from lumenpath.sources import documents

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in ("customer", "nation", "orders", "lineitem", "part", "events", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def same(x):
    return f"{x:.9g}" if isinstance(x, float) and not math.isnan(x) else str(x)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_equals_sql(spark, sql, name):
    df, rel = Q.queries()[name](spark, DIR), sql.sql(Q.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    got = sorted(tuple(same(r[c]) for c in columns) for r in df.collect())
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(tuple(same(r[i]) for i in at) for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_patients_of_many_nations(spark, tmp_path):
    spark.range(1500).selectExpr("id AS n_nationkey", "concat('nation', id) AS n_name").write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(1500).selectExpr("id AS c_custkey", "id AS c_nationkey", "'x' AS c_name", "'y' AS c_mktsegment", "1.0 AS c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    assert documents.patients(spark, str(tmp_path)).where("address[0].country = concat('nation', id)").count() == 1500
