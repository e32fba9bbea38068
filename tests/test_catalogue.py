"""Every catalogue entry with SQL gives the same rows as DuckDB."""

import duckdb
import pytest
from compare import compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as entry
from oracles import ORACLES
from streetflow.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == []


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) == set(ORACLES)


def test_degrees_that_end_in_five_are_rounded_as_the_sql_does(spark, tmp_path):
    keys = [10056, 10136, 10222, 10258, 10057, 10059]
    spark.range(200_000).select(F.col("id").alias("p_partkey")).write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(k, 100.0, "P", "5-LOW") for k in keys], "o_orderkey long, o_totalprice double, o_orderstatus string, "
                          "o_orderpriority string").withColumn("o_orderdate", F.lit("1997-01-01").cast("timestamp_ntz")).write.parquet(
        str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    for t in ("part", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert not compare(QUERIES["route_merge_clean"](spark, str(tmp_path)), con, ORACLES["route_merge_clean"])
