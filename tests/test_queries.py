"""Every registered query against its DuckDB SQL, or its row count where there is none."""

import pytest

import medlark.plans.registry as registry

from .helpers import same


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    if name in registry.ORACLE_SQL:
        same(df, sf_dir, registry.ORACLE_SQL[name])
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", ["op_W09_first_match", "op_W14_preferred_section"])
def test_halves_round_as_in_sql(spark, sf_dir, tmp_path, name):
    """Prices of a half, above and below whole ones: 100.5 counts as 100, 101.5 as 102."""
    for t in ("orders", "lineitem"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(400).write.parquet(f"{tmp_path}/{t}.parquet")
    line = spark.read.parquet(f"{tmp_path}/lineitem.parquet")
    key = spark.read.parquet(f"{tmp_path}/orders.parquet").agg({"o_orderkey": "min"}).first()[0]
    one = line.limit(1).selectExpr(f"{key} AS l_orderkey", *[c for c in line.columns if c != "l_orderkey"])
    half = one.selectExpr("l_orderkey", "l_partkey", "2L AS l_suppkey", "1 AS l_linenumber", *line.columns[4:5], "explode(array(100.5D, 101.5D, 102.5D, 101D)) AS l_extendedprice", *line.columns[6:])
    line.filter(f"l_orderkey != {key}").unionByName(half).write.parquet(f"{tmp_path}/new.parquet")
    (tmp_path / "lineitem.parquet").rename(tmp_path / "old.parquet")
    (tmp_path / "new.parquet").rename(tmp_path / "lineitem.parquet")
    same(registry.QUERIES[name](spark, str(tmp_path)), str(tmp_path), registry.ORACLE_SQL[name])
