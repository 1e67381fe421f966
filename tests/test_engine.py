"""The statement API and the dialect's spelling."""

import pytest
from pyspark.errors import AnalysisException, ParseException

from cairn.functions import dialect
from cairn.functions.dialect import DialectError, UnsupportedFeature
from cairn.plans.engine import Engine
from cairn.sources import catalog


@pytest.fixture(scope="module")
def engine(spark, tiny):
    catalog.register(spark, tiny)
    return Engine(spark)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("a ~ 'x'", "a RLIKE 'x'"),
        ("a !~ 'x'", "a NOT RLIKE 'x'"),
        ("a ~~ 'x%'", "a LIKE 'x%'"),
        ("a !~~ 'x%'", "a NOT LIKE 'x%'"),
        ("a NOT SIMILAR TO 'x.'", "a NOT RLIKE '^(?:x.)$'"),
        ("a # b", "a ^ b"),
        ("SELECT ~a", "SELECT ~a"),
        ("'a ~ b # c' -- d ~ e", "'a ~ b # c' -- d ~ e"),
        ("rank_dense() OVER ()", "dense_rank() OVER ()"),
        ("regexp_matches(a, 'b')", "regexp_like(a, 'b')"),
        ("generate_series(2, 5)", "range(2, 6)"),
        ("main.region", "region"),
        ("\"main\" ~ 'x'", "\"main\" RLIKE 'x'"),
    ],
)
def test_shims(text, expected):
    assert " ".join(dialect.to_spark(text).split()) == expected


def test_shims_that_are_refused():
    with pytest.raises(UnsupportedFeature):
        dialect.to_spark("a SIMILAR TO 'x' ESCAPE '!'")
    with pytest.raises(UnsupportedFeature):
        dialect.to_spark("generate_series(1, n)")
    with pytest.raises(DialectError):
        dialect.to_spark("SELECT ~~ a")


def test_queries_in_the_dialect(engine):
    assert rows(engine.sql("SELECT r_name FROM main.region WHERE r_name ~ '^A.*A$' ORDER BY r_name")) == [("AFRICA",), ("AMERICA",), ("ASIA",)][:3]
    assert rows(engine.sql("SELECT count(*) FROM region WHERE r_name SIMILAR TO 'A.*' AND r_name !~~ '%F%'")) == [(2,)]
    assert rows(engine.sql("SELECT 5 # 3, 'a' || NULL, id FROM generate_series(3, 4)")) == [(6, None, 3), (6, None, 4)]


def test_distinct_on(engine):
    got = rows(engine.sql("SELECT DISTINCT ON (n_regionkey) n_regionkey, n_nationkey FROM nation ORDER BY n_regionkey, n_nationkey DESC LIMIT 2"))
    best = rows(engine.sql("SELECT n_regionkey, max(n_nationkey) FROM nation GROUP BY 1 ORDER BY 1 LIMIT 2"))
    assert got == best
    with pytest.raises(DialectError):
        engine.sql("SELECT DISTINCT ON (n_regionkey) n_name FROM nation")


def test_values_and_ragged_values(engine):
    assert rows(engine.sql("VALUES (1, 'a'), (2, NULL)")) == [(1, "a"), (2, None)]
    with pytest.raises((AnalysisException, ParseException)):
        engine.sql("VALUES (1, 2), (3)").collect()


def test_parameters(engine):
    assert rows(engine.sql("SELECT r_name FROM region WHERE r_regionkey = ? AND r_name = ?", [0, "AFRICA"])) == [("AFRICA",)]
    assert rows(engine.sql("SELECT $2 - $1", [1, 5])) == [(4,)]
    assert rows(engine.sql("SELECT :x + 1", {"x": 2})) == [(3,)]


def test_prepared_statements(engine):
    engine.sql("PREPARE one AS SELECT n_name FROM nation WHERE n_nationkey = $1")
    assert rows(engine.sql("EXECUTE one (3)")) == [("NATION_3",)]
    with pytest.raises(DialectError):
        engine.prepare("one", "SELECT 1")
    engine.sql("DEALLOCATE one")
    with pytest.raises(DialectError):
        engine.execute("one", 3)
    with pytest.raises(ParseException):
        engine.prepare("bad", "SELEC 1")


def test_batch_checks_all_before_running_any(engine, spark):
    with pytest.raises(ParseException):
        engine.execute_batch("CREATE TABLE never(a INT) USING parquet; SELEC 1")
    assert not spark.catalog.tableExists("never")
    assert [rows(d) for d in engine.execute_batch("SELECT ';' AS a; SELECT 2 /* ; */;")] == [[(";",)], [(2,)]]


def test_tables_inserts_updates_deletes(engine, spark):
    engine.execute_batch("CREATE TABLE t(a INT, b STRING DEFAULT 'none') USING parquet; INSERT INTO t VALUES (1, 'x'), (NULL, 'y'); INSERT INTO t(a) VALUES (3); INSERT INTO t SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 4; INSERT INTO t VALUES (5, DEFAULT)")
    everything = {(1, "x"), (None, "y"), (3, "none"), (4, "NATION_4"), (5, "none")}
    assert set(rows(engine.sql("SELECT * FROM t"))) == everything
    engine.sql("UPDATE t SET b = upper(b), a = a + 10 WHERE a < 4")
    assert set(rows(engine.sql("SELECT * FROM t"))) == {(11, "X"), (None, "y"), (13, "NONE"), (4, "NATION_4"), (5, "none")}
    engine.sql("DELETE FROM t WHERE a > 4")
    assert set(rows(engine.sql("SELECT * FROM t"))) == {(None, "y"), (4, "NATION_4")}
    engine.sql("ALTER TABLE t ADD COLUMNS (c INT)")
    assert engine.table("main.t").columns == ["a", "b", "c"]
    engine.sql("ANALYZE TABLE t COMPUTE STATISTICS")
    engine.sql("DELETE FROM t")
    assert rows(engine.sql("SELECT count(*) FROM t")) == [(0,)]
    engine.sql("DROP TABLE t")
    assert not spark.catalog.tableExists("t")


@pytest.mark.parametrize("fails_at", ["insert", "first rename", "second rename"])
def test_a_failed_change_loses_no_rows(engine, spark, monkeypatch, fails_at):
    engine.execute_batch("DROP TABLE IF EXISTS safe; CREATE TABLE safe(a INT, b STRING) USING parquet PARTITIONED BY (b); INSERT INTO safe VALUES (1, 'x'), (2, 'y'), (3, NULL)")
    before, tables, real = set(rows(engine.sql("SELECT * FROM safe"))), {t.name for t in spark.catalog.listTables()}, type(spark).sql
    renames = []

    def failing(self, text, *args, **kw):
        if "RENAME TO" in text:
            renames.append(text)
            if len(renames) == {"first rename": 1, "second rename": 2}.get(fails_at):
                raise OSError("no more disk")
        return real(self, text, *args, **kw)

    monkeypatch.setattr(type(spark), "sql", failing)
    with pytest.raises(Exception):  # noqa: B017
        engine.sql("UPDATE safe SET a = a + 1" if fails_at != "insert" else "UPDATE safe SET a = CAST(raise_error('no') AS INT) WHERE a = 2")
    monkeypatch.undo()
    assert set(rows(engine.sql("SELECT * FROM safe"))) == before
    assert {t.name for t in spark.catalog.listTables()} == tables
    engine.sql("UPDATE safe SET a = a + 1 WHERE b = 'x'")
    assert set(rows(engine.sql("SELECT * FROM safe"))) == before - {(1, "x")} | {(2, "x")}
    engine.sql("DELETE FROM safe WHERE a = 2")
    assert set(rows(engine.sql("SELECT * FROM safe"))) == {(3, None)}
    engine.sql("DROP TABLE safe")


def test_a_table_at_its_own_place_is_changed_there(engine, spark, tmp_path, monkeypatch):
    engine.execute_batch(f"CREATE TABLE placed(a INT) USING parquet LOCATION '{tmp_path}/placed'; INSERT INTO placed VALUES (1), (2); DELETE FROM placed WHERE a = 1")
    assert rows(spark.read.parquet(f"{tmp_path}/placed")) == rows(engine.sql("SELECT * FROM placed")) == [(2,)]
    from pyspark.sql import DataFrameWriter

    real = DataFrameWriter.insertInto
    monkeypatch.setattr(DataFrameWriter, "insertInto", lambda self, name, *a, **k: real(self, name, *a, **k) if name != "placed" else 1 / 0)
    with pytest.raises(RuntimeError, match="whole in placed_") as failed:
        engine.sql("UPDATE placed SET a = 5")
    monkeypatch.undo()
    beside = str(failed.value).split()[-1]
    assert rows(engine.sql(f"SELECT * FROM {beside}")) == [(5,)]
    engine.execute_batch(f"DROP TABLE {beside}; DROP TABLE placed")


def test_python_functions(engine, spark):
    import pandas as pd
    from pyspark.sql.functions import pandas_udf, udtf

    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    engine.create_function("plus_two", lambda x: None if x is None else x + 2, "int")
    engine.create_function("spread", pandas_udf(spread, "double"))

    class Twice:
        def eval(self, x: int):
            yield x, x
            yield x, -x

    engine.create_function("twice_rows", udtf(Twice, returnType="x int, y int"))
    assert rows(engine.sql("SELECT plus_two(a) FROM VALUES (1), (NULL) AS v(a)")) == [(3,), (None,)]
    assert rows(engine.sql("SELECT spread(a) FROM VALUES (1.0D), (4.5D) AS v(a)")) == [(3.5,)]
    assert rows(engine.sql("SELECT * FROM twice_rows(3)")) == [(3, 3), (3, -3)]


def test_databases_views_functions_settings(engine, spark):
    engine.execute_batch("CREATE DATABASE extra; CREATE SCHEMA other; DROP DATABASE extra; DROP SCHEMA other")
    engine.execute_batch("CREATE TEMP VIEW v AS SELECT 1 AS a; CREATE TEMPORARY FUNCTION twice(x INT) RETURNS INT RETURN 2 * x; SET spark.sql.shuffle.partitions=4")
    assert rows(engine.sql("SELECT twice(a + 1) FROM v")) == [(4,)]
    engine.execute_batch("DROP VIEW v; DROP TEMPORARY FUNCTION twice")


def test_copy(engine, tmp_path):
    engine.sql(f"COPY region TO '{tmp_path}/r'")
    engine.sql(f"COPY (SELECT r_name FROM region) TO '{tmp_path}/c' (FORMAT csv)")
    engine.sql("CREATE TABLE copied(r_regionkey INT, r_name STRING) USING parquet")
    engine.sql(f"COPY copied FROM '{tmp_path}/r'")
    assert sorted(rows(engine.sql("SELECT * FROM copied"))) == sorted(rows(engine.sql("SELECT * FROM region")))
    engine.sql("DROP TABLE copied")


@pytest.mark.parametrize("text", ["BEGIN TRANSACTION", "COMMIT", "CREATE SEQUENCE s", "CREATE INDEX i ON region (r_name)"])
def test_unsupported(engine, text):
    with pytest.raises(UnsupportedFeature):
        engine.sql(text)


def test_strict_mode(spark, engine):
    strict = Engine(spark, strict=True)
    with pytest.raises(DialectError, match="GROUP BY"):
        strict.sql("SELECT count(*) FROM region HAVING count(*) > 1")
    with pytest.raises(DialectError, match="two parts"):
        strict.sql("SELECT a.b.c FROM region")
    assert rows(engine.sql("SELECT count(*) FROM region HAVING count(*) > 1")) == [(5,)]


def test_null_in_not_in_and_scalar_subquery_with_two_rows(engine):
    assert rows(engine.sql("SELECT 1 NOT IN (2, NULL), stddev_samp(x) FROM VALUES (1.0) AS v(x)")) == [(None, None)]
    with pytest.raises(Exception, match="(?i)more than one row|scalar"):
        engine.sql("SELECT (SELECT n_name FROM nation)").collect()


def test_schema_check(spark, tiny):
    with pytest.raises(catalog.SchemaMismatch):
        catalog.check_schema(catalog.scan(spark, tiny, "region"), "nation")


def test_explain(engine):
    assert "Scan parquet" in engine.explain("SELECT n_name FROM nation WHERE n_nationkey = 3")
