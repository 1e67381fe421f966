"""Every registered query of the engine against its oracle in DuckDB."""

import pytest
from pyspark.sql import functions as F

from cairn.plans import catalogue

from .conftest import oracle_rows, rows_of

ORACLES = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_same_rows_as_oracle(spark, tiny, duck, name):
    assert rows_of(catalogue.queries()[name](spark, tiny)) == oracle_rows(duck, ORACLES[name])


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(catalogue.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_join_using_chained_spreads_its_result(spark, tiny):
    """40,000 suppliers and 20,000 customers of 25 nations are small to read, but have 32 million pairs."""
    name = lambda n: F.concat(F.lit(n), F.col("id"))
    key = (F.col("id") % 25).cast("int")
    made = {
        "nation": spark.range(0, 25, 1, 1).select(key.alias("n_nationkey"), name("N").alias("n_name")),
        "supplier": spark.range(0, 40_000, 1, 1).select(key.alias("s_nationkey"), name("S").alias("s_name")),
        "customer": spark.range(0, 40_000, 1, 1).select(key.alias("c_nationkey"), name("C").alias("c_name"), F.when(F.col("id") < 20_000, 9600.0).otherwise(9500.0).alias("c_acctbal")),
    }
    sizes = [r["count"] for r in catalogue.join_using_chained(made.get).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 32_000_000 and max(sizes) <= 10_000_000
