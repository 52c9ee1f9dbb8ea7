"""Registered queries against their SQL in DuckDB on the smallest tables."""

import decimal
import math
from functools import reduce

import duckdb
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.plans import ledger, sequences
from strandlake.plans.views import Views, with_views

from .conftest import SF

PLANS = sequences.QUERIES | ledger.QUERIES
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Several rounds of jobs each; run with the others by the driver.
SLOW = {"k3_clusters", "k4_cluster_consensus", "e3_smallest_radius"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, (int, float, decimal.Decimal)) and not isinstance(x, bool):
        return f"{float(x):.8g}"
    return str(x)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in values], key=str)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in PLANS.items() if sql and n not in SLOW))
def test_query_equals_sql(spark, duck, name):
    fn, sql = PLANS[name]
    df = fn(Views(spark, SF))
    got = duck.execute(with_views(sql))
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, got.fetchall())


def test_neighbours_equal_sql_with_copies(spark, tmp_path):
    """Copies are linked to their first row, and only first rows to others, in both."""
    one = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 60")
    near = F.transform("embedding", lambda x, i: F.when(i < 4, -x).otherwise(x))
    more = [one.select((F.col("vec_id") + 1000 * k).alias("vec_id"), c.alias("embedding"), "label") for k, c in ((1, F.col("embedding")), (2, near), (3, near))]
    one.select("vec_id", "embedding", "label").unionByName(more[0]).unionByName(more[1]).unionByName(more[2]).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    fn, sql = PLANS["k2_neighbours"]
    df = fn(Views(spark, str(tmp_path)))
    got = con.execute(with_views(sql))
    want = rows([c[0] for c in got.description], got.fetchall())
    assert rows(df.columns, df.collect()) == want and len(want) >= 180


def test_near_pairs_are_given_for_all_copies(spark, tmp_path):
    """Three equal rows are three pairs, and each has its own pairs with rows near them."""
    near = F.transform("embedding", lambda x, i: F.when(i < 4, -x).otherwise(x))
    one = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 20").select("vec_id", "label", "embedding", near.alias("near"))
    more = [one.select((F.col("vec_id") + 1000 * k).alias("vec_id"), F.col(c).alias("embedding"), "label") for k, c in enumerate(("embedding", "embedding", "embedding", "near", "near"))]
    reduce(DataFrame.unionByName, more).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    fn, sql = PLANS["k2_neighbours"]
    df = fn(Views(spark, str(tmp_path)))
    got = con.execute(with_views(sql))
    want = rows([c[0] for c in got.description], got.fetchall())
    assert rows(df.columns, df.collect()) == want and len(want) >= 200
