"""Compositions: DISTINCT ON, first by a key, SINGLE, MARK and tiled joins, UPDATE and DELETE by rewriting."""

from __future__ import annotations

import math
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by an order, which must be total to be deterministic.

    Spark runs row_number() <= 1 as a group limit before and after the shuffle, so each map task sends
    at most one row per key and a hot key is no heavier than others.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def first_by(value: str | Column, key: str | Column) -> Column:
    """Aggregate: the value at the least key. A plain first() depends on the order rows arrive in."""
    return F.min_by(value, key)


def single_join(left: DataFrame, right: DataFrame, on: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """LEFT JOIN with at most one partner per left row, nulls if there is none.

    Without ``order`` a second partner is an error, as for a scalar subquery; with it the first
    partner by that order counts.
    """
    if order is not None:
        return left.join(distinct_on(right, on, order), list(on), "left")
    others = [c for c in right.columns if c not in on]
    one = right.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"), *[F.any_value(c).alias(c) for c in others])
    out = left.join(one, list(on), "left")
    fail = F.when(F.col("__n") > 1, F.raise_error(F.lit("more than one partner in a SINGLE join")).cast("boolean")).otherwise(F.lit(True))
    return out.where(fail).drop("__n")


def mark_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, mark: str = "mark") -> DataFrame:
    """``left`` with a boolean: does its key have a partner in ``right``, by the rules of SQL's IN.

    No partner is null rather than false where the left key is null (and ``right`` has rows) or where
    ``right`` holds a null. The right side is reduced to distinct keys and two facts about it (a scalar subquery).
    """
    keys = right.select(F.col(right_key).alias("__k")).where("__k is not null").distinct().withColumn("__hit", F.lit(True))
    facts = right.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(right_key).isNull(), 1)).alias("nulls")).alias("f")).scalar()
    joined = left.join(keys, left[left_key] == F.col("__k"), "left")
    unknown = (facts["nulls"] > 0) | (left[left_key].isNull() & (facts["n"] > 0))
    value = F.when(F.col("__hit"), F.lit(True)).when(unknown, F.lit(None).cast("boolean")).otherwise(F.lit(False))
    return joined.withColumn(mark, value).drop("__k", "__hit")


def tiled_join(left: DataFrame, right: DataFrame, on: Sequence[str], side: int = 1 << 10, rows: int = 1 << 21) -> DataFrame:
    """Inner join USING ``on`` whose tasks make about ``rows`` rows each, however many partners a key has on both sides.

    The result has the product of a key's rows on either side, but Spark deals out work by the bytes it
    reads, so small inputs end in a few tasks that make all of it. Here each side's rows of a key form
    blocks of at most ``side`` rows, each pair of blocks is a tile of the key, and tiles are dealt over as
    many partitions as the counted result needs. Rows are numbered by all their columns, so a task that
    runs again makes the same blocks. A result of at most ``rows`` rows needs no tiles.
    """
    on = list(on)
    count = lambda df, n: df.groupBy(*on).agg(F.count(F.lit(1)).alias(n))
    counts = count(left, "__left").join(count(right, "__right"), on)
    m, n = (F.col(c).cast("double") for c in ("__left", "__right"))
    total, copies = counts.agg(F.sum(m * n), F.sum(F.greatest(m * F.ceil(n / side), n * F.ceil(m / side)))).first()
    if (total or 0) <= rows:
        return left.join(right, on)
    # one column of one type: a constant or cast key in the join's condition would have the tiles dealt anew, by bytes
    counts = counts.withColumn("__key", F.struct(*on))

    def tiles(df, own, other):
        # row i of a key belongs to one block of its own side and meets every block of the other
        number = F.row_number().over(Window.partitionBy(*on).orderBy(*df.columns)) - 1
        blocks = lambda c: F.ceil(F.col(c) / side)
        # rows are dealt out before they are copied, as their copies grow with the result too
        cut = df.join(counts, on).withColumn(own, F.coalesce(number % blocks(own), F.lit(0))).repartition(math.ceil(copies / rows))
        cut = cut.withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), blocks(other) - 1)))
        return cut.select(*df.columns, F.struct("__key", "__left", "__right").alias("__tile")).repartition(math.ceil(total / rows), "__tile")

    # the copies of rows are too many to broadcast
    out = tiles(left, "__left", "__right").join(tiles(right, "__right", "__left").drop(*on).hint("merge"), "__tile")
    return out.select(*on, *[c for df in (left, right) for c in df.columns if c not in on])


def updated(df: DataFrame, assignments: Mapping[str, Column], where: Column | None = None) -> DataFrame:
    """Rows after UPDATE: assigned columns where the predicate is true (null counts as false)."""
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    unknown = set(assignments) - set(df.columns)
    if unknown:
        raise ValueError(f"no such column: {', '.join(sorted(unknown))}")
    kinds = dict(df.dtypes)
    return df.select(*[F.when(hit, assignments[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in assignments else F.col(c) for c in df.columns])


def remaining(df: DataFrame, where: Column | None = None) -> DataFrame:
    """Rows after DELETE: those for which the predicate isn't true."""
    return df.limit(0) if where is None else df.where(~F.coalesce(where, F.lit(False)))


def rewrite_table(spark, table: str, rows: DataFrame) -> None:
    """Replaces a catalog table's rows by ``rows``, which may read the table.

    The new rows are written to a table of their own, of the same schema, format and partitioning, which
    then takes the name: whatever fails, the old rows are whole, under the table's name or (if even
    renaming back fails) the one with ``_old``. A table at a place of its own is overwritten there, and if
    that fails the new rows stay in the table beside it, which the error names.
    """
    mark = uuid.uuid4().hex[:12]
    beside, old = f"{table}_{mark}", f"{table}_{mark}_old"
    spark.sql(f"CREATE TABLE {beside} LIKE {table}")
    try:
        rows.write.insertInto(beside)
    except BaseException:
        spark.sql(f"DROP TABLE {beside}")
        raise
    if spark.catalog.getTable(table).tableType == "EXTERNAL":
        try:
            spark.table(beside).write.mode("overwrite").insertInto(table)
        except BaseException as failed:
            raise RuntimeError(f"{table} could not be overwritten; its new rows are whole in {beside}") from failed
        spark.sql(f"DROP TABLE {beside}")
        return
    moved = False
    try:
        spark.sql(f"ALTER TABLE {table} RENAME TO {old}")
        moved = True
        spark.sql(f"ALTER TABLE {beside} RENAME TO {table}")
    except BaseException:
        if moved:
            spark.sql(f"ALTER TABLE {old} RENAME TO {table}")
        spark.sql(f"DROP TABLE {beside}")
        raise
    spark.sql(f"DROP TABLE {old}")
