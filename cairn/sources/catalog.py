"""Parquet tables of a data directory as scans and as SQL views."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Columns that the engine's queries rely on, by table.
COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


class SchemaMismatch(ValueError):
    """A table lacks a column that it should have, or has it with another type."""


def scan(spark: SparkSession, sf_dir: str, name: str, alias: str | None = None) -> DataFrame:
    """A base table, optionally under an alias."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.alias(alias) if alias else df


def check_schema(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself if it has the columns that table ``name`` should have; others may follow."""
    have = dict(df.dtypes)
    for column in COLUMNS[name].split(", "):
        key, kind = column.split(" ")
        if have.get(key) != kind:
            raise SchemaMismatch(f"{name}.{key} is {have.get(key, 'missing')}, not {kind}")
    return df


def register(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = TABLES) -> list[str]:
    """Temp views for the tables of a directory that exist there; their names."""
    found = []
    for name in tables:
        try:
            df = scan(spark, sf_dir, name)
        except AnalysisException:
            continue
        (check_schema(df, name) if name in COLUMNS else df).createOrReplaceTempView(name)
        found.append(name)
    return found
