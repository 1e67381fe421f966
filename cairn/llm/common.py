"""Shared plumbing of the training-data operators: table access, Arrow batching, scratch tables.

Operators read only the columns they name, so extra columns of the input never clash with theirs:
result columns are always built under their own names, and a kept input column of the same name is
replaced by the result column.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that one numpy working set covers; a longer single text is still taken whole.
BLOCK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory, by any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local one only where that is unset and the session is local (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cairn-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared scratch folder and reads it back.

    This cuts lineage so that a lost executor costs at most the tasks reading it, and keeps a table
    that several later steps read from being computed twice.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes scratch tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def blocks(batch: pa.RecordBatch, text_col: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch whose texts hold about ``limit`` bytes; every row is in exactly one."""
    if batch.num_rows == 0:
        return
    size = np.asarray(pc.binary_length(batch.column(text_col)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    part = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def arrow_schema(struct: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(struct)


def add_columns(
    df: DataFrame,
    added: str,
    compute: Callable[[pa.RecordBatch], Iterable],
    keep: list[str],
    text_col: str = "text",
    limit: int = BLOCK_BYTES,
) -> DataFrame:
    """``keep`` columns of ``df`` plus ``added`` (a DDL string), computed per block of rows in Arrow.

    ``compute`` gets a block (all columns of ``df``) and returns one list or array per added column.
    A kept column whose name is also an added one gives way to it.
    """
    new = T._parse_datatype_string(added)
    names = {f.name.lower() for f in new.fields}
    kept = [c for c in keep if c.lower() not in names]
    out = T.StructType([f for c in kept for f in df.schema.fields if f.name == c] + list(new.fields))
    schema = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text_col, limit):
                values = list(compute(part))
                arrays = [part.column(c).cast(schema.field(c).type) for c in kept]
                arrays += [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, type=schema.field(f.name).type) for v, f in zip(values, new.fields, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)
        release()

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, out)


def texts_of(batch: pa.RecordBatch, col: str = "text") -> list[str]:
    """The texts of a block, null as the empty text."""
    return [t or "" for t in batch.column(col).to_pylist()]


#: Rows and bytes of an Arrow batch, at most, so that long texts don't make it outgrow a worker.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limits of Arrow batches to ``BATCH``; smaller ones stay. Spark reads them when it runs a plan."""
    for key, most in BATCH.items():
        now = spark.conf.get(key).lower().rstrip("b")
        unit = {"k": 10, "m": 20, "g": 30}.get(now[-1:], 0)
        size = int(now.rstrip("kmg") or 0) << unit
        if not 0 < size <= most:
            spark.conf.set(key, str(most))


def release() -> None:
    """Gives back what Arrow and the C library keep of freed memory; a worker lives on between tasks, and two or more share an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def stored_bytes(df: DataFrame) -> int:
    """What Spark takes the input of ``df`` to hold, from file sizes; nothing is read."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def pick(df: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns, however many others there are."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


#: Values of a grouping column that a sample is taken of, at most.
GROUPS = 200


def slot_sample(docs: DataFrame, slots: int, id_col: str = "doc_id", by: list[str] | None = None, groups: int = GROUPS) -> DataFrame:
    """At most ``slots`` rows of ``docs`` for each value of ``by`` (overall if none), chosen by hash.

    Each id falls in a slot by its hash, and each slot keeps its smallest hash. The choice is made by
    a partial aggregate over longs, so a hot value of ``by`` costs no more than a rare one. Of more than
    ``groups`` values those with the most slots are sampled, so at most ``slots * groups`` hashes are broadcast.
    """
    by = by or []
    key = F.xxhash64(F.col(id_col), F.lit(7))
    chosen = docs.select(*by, key.alias("_k")).groupBy(*by, F.pmod("_k", F.lit(slots)).alias("_s")).agg(F.min("_k").alias("_k"))
    if by:
        chosen = materialize(chosen, "slots")
        largest = chosen.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), *by).limit(groups)
        chosen = chosen.join(F.broadcast(largest), by, "left_semi")
    chosen = chosen.select(*by, "_k").distinct()
    return docs.withColumn("_k", key).join(F.broadcast(chosen), [*by, "_k"], "left_semi").dropDuplicates([*by, "_k"]).drop("_k")
