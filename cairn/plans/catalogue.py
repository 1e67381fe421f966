"""Registered queries of the engine's operators, each with the DuckDB SQL that gives the same rows.

Sums and means of doubles go through exact decimals, ranks and counts are BIGINT, null order and frames
are explicit, and every computed column is named, so results don't depend on the engine or on row order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import compose
from ..sources import catalog
from .engine import Engine

Tables = Callable[[str], DataFrame]
_QUERIES: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def query(sql: str | None):
    """Registers a function of a table loader under its name, with its oracle."""

    def put(f):
        _QUERIES[f.__name__] = (f, sql)
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(f):
        return lambda spark, sf_dir: f(lambda name: catalog.scan(spark, sf_dir, name))

    return {name: bind(f) for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}


def big(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


# --- scan, projection, filter


@query("SELECT n_nationkey, n_name FROM nation")
def scan_project(t):
    return t("nation").select("n_nationkey", "n_name")


@query("SELECT * FROM region")
def star(t):
    return t("region").select("*")


@query("SELECT r.* FROM region r")
def star_qualified(t):
    return t("region").alias("r").select("r.*")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 30 AND l_quantity < 35 AND l_discount <= 0.05 AND l_tax > 0.02 AND l_returnflag = 'R' AND l_linestatus <> 'F'")
def filter_compare(t):
    c = scalar.compare
    keep = c(">=", F.col("l_quantity"), F.lit(30)) & c("<", F.col("l_quantity"), F.lit(35)) & c("<=", F.col("l_discount"), F.lit(0.05))
    keep &= c(">", F.col("l_tax"), F.lit(0.02)) & c("=", F.col("l_returnflag"), F.lit("R")) & c("<>", F.col("l_linestatus"), F.lit("F"))
    return t("lineitem").where(keep).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'P' OR o_totalprice > 400000) AND NOT (o_orderpriority = '1-URGENT')")
def filter_bool(t):
    return t("orders").where(((F.col("o_orderstatus") == "P") | (F.col("o_totalprice") > 400000)) & ~(F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey")


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 12")
def filter_between(t):
    return t("part").where(F.col("p_size").between(10, 12)).select("p_partkey", "p_size")


@query("SELECT p_partkey, p_size FROM part WHERE p_size NOT BETWEEN 3 AND 48")
def filter_not_between(t):
    return t("part").where(~F.col("p_size").between(3, 48)).select("p_partkey", "p_size")


@query("SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey IN (1, 3)")
def filter_in(t):
    return t("nation").where(F.col("n_regionkey").isin(1, 3)).select("n_nationkey", "n_regionkey")


@query("SELECT n_nationkey, n_regionkey FROM nation WHERE NOT (n_regionkey IN (1, 3))")
def filter_not_in(t):
    return t("nation").where(~F.col("n_regionkey").isin(1, 3)).select("n_nationkey", "n_regionkey")


@query("SELECT n_nationkey, n_regionkey NOT IN (2, NULL) AS not_in FROM nation")
def not_in_null(t):
    return t("nation").select("n_nationkey", (~F.col("n_regionkey").isin(2, None)).alias("not_in"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 's%ring' OR p_name LIKE '_i%'")
def filter_like(t):
    return t("part").where(F.col("p_name").like("s%ring") | F.col("p_name").like("_i%")).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_name NOT LIKE '%i%'")
def filter_not_like(t):
    return t("part").where(~F.col("p_name").like("%i%")).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'r[io]n') AND NOT regexp_matches(p_name, '^s')")
def filter_regex(t):
    return t("part").where(scalar.regexp_matches(F.col("p_name"), "r[io]n") & ~scalar.regexp_matches(F.col("p_name"), "^s")).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_brand, p_brand SIMILAR TO 'Brand#1.' AS one FROM part WHERE p_brand NOT SIMILAR TO '.*5'")
def filter_similar(t):
    return t("part").where(~scalar.similar_to(F.col("p_brand"), ".*5")).select("p_partkey", "p_brand", scalar.similar_to(F.col("p_brand"), "Brand#1.").alias("one"))


@query("SELECT n_nationkey, nullif(n_regionkey, 2) IS NULL AS absent, nullif(n_regionkey, 2) IS NOT NULL AS present FROM nation")
def filter_is_null(t):
    x = scalar.nullif(F.col("n_regionkey"), F.lit(2))
    return t("nation").select("n_nationkey", x.isNull().alias("absent"), x.isNotNull().alias("present"))


@query("SELECT n_nationkey, nullif(n_regionkey, 2) IS DISTINCT FROM nullif(n_nationkey, 3) AS differs, nullif(n_regionkey, 2) IS NOT DISTINCT FROM NULL AS same FROM nation")
def filter_distinct_from(t):
    x = scalar.nullif(F.col("n_regionkey"), F.lit(2))
    return t("nation").select("n_nationkey", scalar.distinct_from(x, scalar.nullif(F.col("n_nationkey"), F.lit(3))).alias("differs"), x.eqNullSafe(F.lit(None)).alias("same"))


# --- scalar expressions


@query("SELECT p_partkey, p_size + 3 AS plus, p_size - 60 AS minus, p_size * 2 AS times, p_size / nullif(p_size % 5, 0) AS ratio, (p_size - 60) % 7 AS modulo, -p_size AS negative, +p_size AS positive FROM part")
def arith(t):
    s = F.col("p_size")
    return t("part").select("p_partkey", (s + 3).alias("plus"), (s - 60).alias("minus"), (s * 2).alias("times"), scalar.divide(s, s % 5).alias("ratio"), ((s - 60) % 7).alias("modulo"), (-s).alias("negative"), s.alias("positive"))


@query("SELECT p_partkey, p_size << 2 AS shl, p_size >> 1 AS shr, p_size & 12 AS conj, p_size | 3 AS disj, xor(p_size, 21) AS excl FROM part")
def bitwise(t):
    s = F.col("p_size")
    return t("part").select("p_partkey", F.shiftleft(s, 2).alias("shl"), F.shiftright(s, 1).alias("shr"), s.bitwiseAND(12).alias("conj"), s.bitwiseOR(3).alias("disj"), s.bitwiseXOR(21).alias("excl"))


@query("SELECT n_nationkey, n_name || '/' || n_regionkey AS joined, n_name || nullif(n_name, 'NATION_3') AS maybe FROM nation")
def concat_op(t):
    n = F.col("n_name")
    return t("nation").select("n_nationkey", scalar.concat_op(n, F.lit("/"), F.col("n_regionkey").cast("string")).alias("joined"), scalar.concat_op(n, scalar.nullif(n, F.lit("NATION_3"))).alias("maybe"))


@query("SELECT n_nationkey, nullif(n_regionkey, 1) AS hole, coalesce(nullif(n_regionkey, 1), -1) AS filled FROM nation")
def nullif_coalesce(t):
    x = scalar.nullif(F.col("n_regionkey"), F.lit(1))
    return t("nation").select("n_nationkey", x.alias("hole"), F.coalesce(x, F.lit(-1)).alias("filled"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS searched, CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS simple FROM part")
def case_expr(t):
    s = F.col("p_size")
    return t("part").select("p_partkey", F.when(s < 10, "small").when(s < 30, "medium").otherwise("large").alias("searched"), F.when(s == 1, "one").when(s == 2, "two").alias("simple"))


@query("SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS whole, CAST(o_orderkey AS VARCHAR) AS txt, CAST(o_orderdate AS DATE) AS day, TRY_CAST(o_orderpriority AS INTEGER) AS bad FROM orders")
def cast_types(t):
    return t("orders").select("o_orderkey", F.floor("o_totalprice").cast("bigint").alias("whole"), F.col("o_orderkey").cast("string").alias("txt"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderpriority").try_cast("int").alias("bad"))


@query("SELECT * FROM (VALUES (1, 'a'), (2, NULL), (-3, 'c')) AS v(x, y)")
def values_rows(t):
    return t("region").sparkSession.sql("SELECT * FROM VALUES (1, 'a'), (2, NULL), (-3, 'c') AS v(x, y)")


@query("SELECT p_partkey, p_size < 5 OR p_size > 45 AND p_name LIKE 's%' AS mixed, (nullif(p_size, 7) > 3) AND (p_size < 9) AS three FROM part")
def logic_three_valued(t):
    s = F.col("p_size")
    return t("part").select("p_partkey", ((s < 5) | ((s > 45) & F.col("p_name").like("s%"))).alias("mixed"), ((scalar.nullif(s, F.lit(7)) > 3) & (s < 9)).alias("three"))


# --- grouping and aggregates


def _star_join(t):
    """Orders with their customers' regions; the small dimension joins are planned by their measured size."""
    return (
        t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )


@query(
    "SELECT r_name AS region, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' GROUP BY r_name"
)
def flagship(t):
    since = F.expr("TIMESTAMP_NTZ '1996-01-01 00:00:00'")
    return _star_join(t).where(F.col("o_orderdate") >= since).groupBy(F.col("r_name").alias("region")).agg(scalar.exact_sum(F.col("o_totalprice")).alias("revenue"))


@query(
    "SELECT l_returnflag, count(*) AS n, count(nullif(l_linenumber, 1)) AS n_some, count(DISTINCT l_partkey) AS n_parts, CAST(sum(l_linenumber) AS BIGINT) AS total, "
    "CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS total_distinct, min(l_quantity) AS least, max(l_quantity) AS most, "
    "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(l_extendedprice) AS mean, round(stddev_samp(l_linenumber), 6) AS spread FROM lineitem GROUP BY l_returnflag"
)
def agg_all(t):
    return t("lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.count(scalar.nullif(F.col("l_linenumber"), F.lit(1))).alias("n_some"), F.count_distinct("l_partkey").alias("n_parts"),
        F.sum("l_linenumber").alias("total"), F.sum_distinct(F.col("l_linenumber")).alias("total_distinct"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"),
        scalar.exact_avg(F.col("l_extendedprice")).alias("mean"), F.round(F.stddev_samp("l_linenumber"), 6).alias("spread"),
    )


@query("SELECT count(*) AS n, CAST(sum(nullif(n_regionkey, n_regionkey)) AS BIGINT) AS nothing, stddev_samp(CASE WHEN n_nationkey = 1 THEN 1.0 END) AS one_row FROM nation")
def agg_empty(t):
    r = F.col("n_regionkey")
    return t("nation").agg(F.count(F.lit(1)).alias("n"), F.sum(scalar.nullif(r, r)).alias("nothing"), F.stddev_samp(F.when(F.col("n_nationkey") == 1, 1.0)).alias("one_row"))


@query("SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS first_price FROM orders GROUP BY o_custkey")
def agg_first(t):
    return t("orders").groupBy("o_custkey").agg(compose.first_by("o_totalprice", "o_orderkey").alias("first_price"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def group_having(t):
    return t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 12")


@query("SELECT count(*) AS n FROM orders HAVING count(*) > 1")
def having_global(t):
    return t("orders").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT p_size % 10 AS bucket, count(*) AS n FROM part GROUP BY p_size % 10")
def group_expression(t):
    return t("part").groupBy((F.col("p_size") % 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def select_distinct(t):
    return t("lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(t):
    return compose.distinct_on(t("orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()]).select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price, "
    "count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"
)
def pricing_summary(t):
    until = F.expr("TIMESTAMP_NTZ '2001-09-02 00:00:00'")
    return t("lineitem").where(F.col("l_shipdate") <= until).groupBy("l_returnflag", "l_linestatus").agg(scalar.exact_sum(F.col("l_quantity")).alias("sum_qty"), scalar.exact_sum(F.col("l_extendedprice")).alias("sum_price"), F.count(F.lit(1)).alias("n"))


# --- joins


def _nations(t):
    return t("nation").select(F.col("n_nationkey").alias("k"), "n_name")


@query("SELECT k, n_name, s_name FROM (SELECT n_nationkey AS k, n_name FROM nation) JOIN (SELECT s_nationkey AS k, s_name FROM supplier) USING (k)")
def join_inner_using(t):
    return _nations(t).join(t("supplier").select(F.col("s_nationkey").alias("k"), "s_name"), ["k"])


@query("SELECT a, b, x, y FROM (SELECT l_orderkey AS a, l_linenumber AS b, l_quantity AS x FROM lineitem WHERE l_quantity > 49) JOIN (SELECT l_orderkey AS a, l_linenumber AS b, l_partkey AS y FROM lineitem WHERE l_quantity > 48) USING (a, b)")
def join_using_multi(t):
    part = lambda least, c, n: t("lineitem").where(F.col("l_quantity") > least).select(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), F.col(c).alias(n))
    return part(49, "l_quantity", "x").join(part(48, "l_partkey", "y"), ["a", "b"])


@query("SELECT k, n_name, s_name, c_name FROM (SELECT n_nationkey AS k, n_name FROM nation) JOIN (SELECT s_nationkey AS k, s_name FROM supplier) USING (k) JOIN (SELECT c_nationkey AS k, c_name FROM customer WHERE c_acctbal > 9500) USING (k)")
def join_using_chained(t):
    # each nation's suppliers meet each of its customers
    return compose.tiled_join(join_inner_using(t), t("customer").where("c_acctbal > 9500").select(F.col("c_nationkey").alias("k"), "c_name"), ["k"])


_RICH = "(SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000)"


def _rich(t):
    return t("orders").where("o_orderstatus = 'P' AND o_totalprice > 300000").select("o_orderkey", "o_custkey")


@query(f"SELECT c_custkey, o_orderkey FROM customer LEFT JOIN {_RICH} r ON c_custkey = o_custkey")
def join_left(t):
    return t("customer").join(_rich(t), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query(f"SELECT c_custkey, o_orderkey FROM {_RICH} r RIGHT JOIN customer ON c_custkey = o_custkey")
def join_right(t):
    return _rich(t).join(t("customer"), F.col("c_custkey") == F.col("o_custkey"), "right").select("c_custkey", "o_orderkey")


@query(f"SELECT c_custkey, o_orderkey FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c FULL JOIN {_RICH} r ON c_custkey = o_custkey")
def join_full(t):
    return t("customer").where("c_acctbal > 0").join(_rich(t), F.col("c_custkey") == F.col("o_custkey"), "full").select("c_custkey", "o_orderkey")


@query(f"SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM {_RICH} r WHERE o_custkey = c_custkey)")
def join_semi(t):
    return t("customer").join(_rich(t), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query(f"SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM {_RICH} r WHERE o_custkey = c_custkey)")
def join_anti(t):
    return t("customer").join(_rich(t), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT n_nationkey, nullif(n_regionkey, 4) IN (SELECT nullif(r_regionkey, 0) FROM region WHERE r_regionkey < 3) AS mark FROM nation")
def join_mark(t):
    left = t("nation").select("n_nationkey", scalar.nullif(F.col("n_regionkey"), F.lit(4)).alias("k"))
    right = t("region").where("r_regionkey < 3").select(scalar.nullif(F.col("r_regionkey"), F.lit(0)).alias("r"))
    return compose.mark_join(left, right, "k", "r").select("n_nationkey", "mark")


@query("SELECT n_nationkey, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000) AS mark FROM nation")
def join_mark_exists(t):
    rich = t("supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey")).distinct().withColumn("hit", F.lit(True))
    return t("nation").join(rich, "n_nationkey", "left").select("n_nationkey", F.coalesce("hit", F.lit(False)).alias("mark"))


@query("SELECT c_custkey, (SELECT n_name FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey < 3) AS n_name FROM customer")
def join_single(t):
    nations = t("nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return compose.single_join(t("customer"), nations, ["c_nationkey"]).select("c_custkey", "n_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey")
def join_single_pick(t):
    orders = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return compose.single_join(t("customer"), orders, ["c_custkey"], order=[F.col("o_orderkey").asc()]).select("c_custkey", "o_orderkey")


@query("SELECT r_name, n_name FROM region, nation WHERE n_nationkey < 2")
def join_cross_comma(t):
    # both sides are dimension tables of fixed size
    return t("region").crossJoin(t("nation").where("n_nationkey < 2")).select("r_name", "n_name")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey")
def join_theta(t):
    a, b = t("nation").alias("a"), t("nation").alias("b")
    return a.join(b, (F.col("a.n_regionkey") < F.col("b.n_regionkey")) & (F.col("a.n_nationkey") > F.col("b.n_nationkey"))).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"))


@query("SELECT k, n_name, s_name FROM (SELECT n_nationkey AS k, n_name FROM nation) NATURAL JOIN (SELECT s_nationkey AS k, s_name FROM supplier)")
def join_natural(t):
    left, right = _nations(t), t("supplier").select(F.col("s_nationkey").alias("k"), "s_name")
    return left.join(right, [c for c in left.columns if c in right.columns])


@query("SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' AND l_quantity > 45")
def join_equi_on(t):
    return t("orders").where("o_orderpriority = '1-URGENT'").join(t("lineitem").where("l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", "l_quantity")


# --- subqueries, CTEs, set operations


@query("SELECT x, y FROM (SELECT n_nationkey, n_name FROM nation) AS s(x, y) WHERE x < 7")
def sub_from_alias(t):
    return t("nation").select("n_nationkey", "n_name").toDF("x", "y").alias("s").where("s.x < 7")


@query("SELECT p_partkey FROM part WHERE p_size = (SELECT max(p_size) FROM part)")
def sub_scalar(t):
    most = t("part").agg(F.max("p_size").alias("m"))
    return t("part").where(F.col("p_size") == most.scalar()).select("p_partkey")


@query("SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')")
def sub_in(t):
    return t("nation").join(t("region").where("r_name LIKE 'A%'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi").select("n_nationkey")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 2000)")
def sub_not_in(t):
    poor = compose.mark_join(t("nation"), t("supplier").where("s_acctbal > 2000"), "n_nationkey", "s_nationkey")
    return poor.where(~F.col("mark")).select("n_nationkey")


@query("SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = s.s_nationkey AND n_regionkey = 2)")
def sub_exists(t):
    return t("supplier").join(t("nation").where("n_regionkey = 2"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey")


@query("SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def sub_correlated(t):
    means = t("orders").groupBy("o_custkey").agg(scalar.exact_sum(F.col("o_totalprice")).alias("s"), F.count(F.lit(1)).alias("n"))
    return t("orders").join(means, "o_custkey").where(F.col("o_totalprice") > 1.5 * F.col("s") / F.col("n")).select("o_orderkey")


@query("WITH big AS (SELECT * FROM orders WHERE o_totalprice > 400000), c AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c_name, n FROM customer JOIN c ON c_custkey = o_custkey")
def cte(t):
    counts = t("orders").where("o_totalprice > 400000").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return t("customer").join(counts, F.col("c_custkey") == F.col("o_custkey")).select("c_name", "n")


def _keys(t, name, key):
    return t(name).select(F.col(key).alias("k"))


@query("SELECT s_nationkey AS k FROM supplier UNION ALL SELECT n_nationkey FROM nation")
def union_all(t):
    return _keys(t, "supplier", "s_nationkey").union(_keys(t, "nation", "n_nationkey"))


@query("SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def union(t):
    return _keys(t, "supplier", "s_nationkey").union(_keys(t, "customer", "c_nationkey")).distinct()


@query("SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000 INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")
def intersect(t):
    return t("supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")).intersect(t("customer").where("c_acctbal > 9000").select("c_nationkey"))


@query("SELECT s_nationkey AS k FROM supplier INTERSECT ALL SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")
def intersect_all(t):
    return _keys(t, "supplier", "s_nationkey").intersectAll(t("customer").where("c_acctbal > 9000").select("c_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000")
def except_(t):
    return _keys(t, "nation", "n_nationkey").subtract(t("supplier").where("s_acctbal > 3000").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(t):
    return _keys(t, "customer", "c_nationkey").exceptAll(t("supplier").select("s_nationkey"))


# --- sort, limit


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey ASC NULLS LAST LIMIT 20 OFFSET 100")
def order_limit_offset(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_orderkey").asc_nulls_last()).offset(100).limit(20)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
def topk(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey")).limit(25)


@query("SELECT x FROM (SELECT nullif(n_regionkey, 2) AS x, n_nationkey AS k FROM nation) ORDER BY x ASC NULLS FIRST, k LIMIT 8")
def order_nulls(t):
    return t("nation").select(scalar.nullif(F.col("n_regionkey"), F.lit(2)).alias("x"), F.col("n_nationkey").alias("k")).orderBy(F.col("x").asc_nulls_first(), "k").limit(8).select("x")


# --- windows


_BY = "PARTITION BY o_custkey ORDER BY o_orderkey"


def _by_customer():
    return Window.partitionBy("o_custkey").orderBy("o_orderkey")


@query(
    "SELECT p_partkey, rank() OVER w AS rnk, dense_rank() OVER w AS dense, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS rn, "
    "ntile(4) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS tile, percent_rank() OVER w AS pr, cume_dist() OVER w AS cd FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)"
)
def win_rank_family(t):
    w, total = Window.partitionBy("p_brand").orderBy("p_size"), Window.partitionBy("p_brand").orderBy("p_size", "p_partkey")
    return t("part").select(
        "p_partkey", big(F.rank().over(w)).alias("rnk"), big(F.dense_rank().over(w)).alias("dense"), big(F.row_number().over(total)).alias("rn"),
        big(F.ntile(4).over(total)).alias("tile"), F.percent_rank().over(w).alias("pr"), F.cume_dist().over(w).alias("cd"),
    )


@query(
    f"SELECT o_orderkey, first_value(o_totalprice) OVER ({_BY}) AS fv, last_value(o_totalprice) OVER ({_BY}) AS lv, "
    f"lead(o_totalprice, 1) OVER ({_BY}) AS ld, lag(o_totalprice, 2, -1.0) OVER ({_BY}) AS lg FROM orders"
)
def win_values(t):
    w, x = _by_customer(), F.col("o_totalprice")
    return t("orders").select("o_orderkey", F.first_value(x).over(w).alias("fv"), F.last_value(x).over(w).alias("lv"), F.lead(x, 1).over(w).alias("ld"), F.lag(x, 2, -1.0).over(w).alias("lg"))


@query(
    f"SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER ({_BY}) AS DOUBLE) AS s, count(*) OVER ({_BY}) AS n, count(nullif(o_orderstatus, 'P')) OVER ({_BY}) AS n_some, "
    f"min(o_totalprice) OVER ({_BY}) AS lo, max(o_totalprice) OVER ({_BY}) AS hi, "
    f"CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER ({_BY}) AS DOUBLE) / count(o_totalprice) OVER ({_BY}) AS mean FROM orders"
)
def win_aggs(t):
    w, x = _by_customer(), F.col("o_totalprice")
    total = F.sum(x.cast("decimal(18,2)")).over(w).cast("double")
    return t("orders").select(
        "o_orderkey", total.alias("s"), F.count(F.lit(1)).over(w).alias("n"), F.count(scalar.nullif(F.col("o_orderstatus"), F.lit("P"))).over(w).alias("n_some"),
        F.min(x).over(w).alias("lo"), F.max(x).over(w).alias("hi"), (total / F.count(x).over(w)).alias("mean"),
    )


@query(
    "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n, "
    "max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS hi, "
    "count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS near FROM orders"
)
def win_frame(t):
    w = _by_customer()
    return t("orders").select(
        "o_orderkey", F.count(F.lit(1)).over(w.rowsBetween(-2, 1)).alias("n"),
        F.max("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("hi"), F.count(F.lit(1)).over(w.rangeBetween(-500, 0)).alias("near"),
    )


@query("SELECT event_id, user_id, date_diff('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS gap FROM events")
def win_event_gap(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    trunc = lambda c: F.date_trunc("second", c)
    return t("events").select("event_id", "user_id", F.timestamp_diff("SECOND", trunc(F.lag("ts").over(w)), trunc(F.col("ts"))).alias("gap"))


# --- table functions


@query("SELECT range AS id FROM range(3, 11)")
def tvf_range(t):
    return t("region").sparkSession.range(3, 11)


@query("SELECT unnest([5, 6, NULL]) AS x")
def tvf_explode(t):
    return t("region").sparkSession.sql("SELECT x FROM explode(array(5, 6, NULL)) AS e(x)")


# --- statements that change a table, seen through a SELECT


def _changed(rows: DataFrame, *statements: str) -> DataFrame:
    """The rows of a new table, at first ``rows``, after statements that name it `{t}`. The table stays in the session's warehouse, as the result reads it."""
    spark, name = rows.sparkSession, f"changed_{uuid.uuid4().hex[:12]}"
    rows.write.saveAsTable(name)
    engine = Engine(spark)
    for s in statements:
        engine.sql(s.format(t=name))
    return engine.table(name)


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 UNION ALL SELECT c_custkey + 1000000, upper(c_mktsegment) FROM customer WHERE c_acctbal > 9000 UNION ALL VALUES (-1, NULL), (-2, 'two')")
def dml_insert(t):
    customers = t("customer")
    customers.createOrReplaceTempView("dml_customer")
    return _changed(customers.where("c_nationkey = 3").select("c_custkey", "c_name"), "INSERT INTO {t} SELECT c_custkey + 1000000, upper(c_mktsegment) FROM dml_customer WHERE c_acctbal > 9000", "INSERT INTO {t} VALUES (-1, NULL), (-2, 'two')")


@query("SELECT o_orderkey, CASE WHEN nullif(o_custkey, 7) < 500 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, CASE WHEN nullif(o_custkey, 7) < 500 THEN lower(o_orderstatus) ELSE o_orderstatus END AS o_orderstatus FROM orders")
def dml_update(t):
    return _changed(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "UPDATE {t} SET o_custkey = o_custkey + 1, o_orderstatus = lower(o_orderstatus) WHERE nullif(o_custkey, 7) < 500")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE NOT coalesce(nullif(o_orderpriority, '1-URGENT') LIKE '2%' OR o_orderkey % 10 = 3, false)")
def dml_delete(t):
    return _changed(t("orders").select("o_orderkey", "o_orderpriority"), "DELETE FROM {t} WHERE nullif(o_orderpriority, '1-URGENT') LIKE '2%' OR o_orderkey % 10 = 3")
