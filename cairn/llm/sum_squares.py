"""Sum-of-squares packing of tokenized documents into fixed-length sequences.

Every document becomes its token ids plus an end id; only one longer than a sequence is cut, into
full pieces and a last shorter one. Pieces are written once, counted, and dealt evenly over shards of at
most ``shard_rows``, and each shard packs its own: a piece goes where the sum of squared counts of open
sequences, by residual gap, becomes smallest. No task ever holds more than a shard's lengths (token ids
stay in the task that made them), however the input is partitioned and however long documents are. A shard
leaves a handful of sequences part filled; measured, it takes one or two sequences more than its tokens
would fill, of some ten thousand, so packing across shards could save no more than that.

Defined cases: null or empty text has only the end id; null doc_id is kept as null; repeated rows
are packed once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .tokens import TOKENIZED_BYTES, word_ids

SEQUENCE = 4096
END_ID = 1
SHARD_PIECES = 50_000
#: Share of a shard's sequences, the emptiest, that are packed a second time.
AGAIN = 0.2
#: Bytes of stored input that a task should have at least.
TASK_BYTES = 4 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, placed in order by the sum-of-squares rule.

    With N(g) open bins of gap g, an item of size s put in a bin of gap g changes the sum of squares
    by 2N(g-s) - 2N(g) + 2, by 1 - 2N(g) if it fills the bin, and by 2N(c-s) + 1 in a new bin (0 if it fills it).
    Ties go to an open bin before a new one, then to the smallest gap; equal gaps to the latest bin.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    never = np.int64(1) << 60
    for k, s in enumerate(lengths.tolist()):
        gap = 0
        if s < capacity:
            here = count[s:capacity]
            change = 2 * (count[: capacity - s] - here) + 2
            change[0] = 1 - 2 * here[0]
            change[here == 0] = never
            j = int(change.argmin())
            if change[j] <= 2 * count[capacity - s] + 1:
                gap = s + j
        if gap:
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            b, gap, made = made, capacity, made + 1
        bins[k], offsets[k] = b, capacity - gap
        if gap > s:
            open_bins[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets


def pack_shard(lengths: np.ndarray, capacity: int, again: float = AGAIN) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: placed in order, then the items of the emptiest bins once more, longest first.

    Both passes follow the sum-of-squares rule; the second one counts only if it saves bins.
    """
    bins, offsets = pack_lengths(lengths, capacity)
    if not len(bins):
        return bins, offsets
    made = int(bins.max()) + 1
    filled = np.bincount(bins, lengths, made)
    weak = np.argsort(filled, kind="stable")[: max(1, int(made * again))]
    is_weak = np.zeros(made, bool)
    is_weak[weak] = True
    items = np.flatnonzero(is_weak[bins])
    items = items[np.argsort(-lengths[items], kind="stable")]
    new_bins, new_offsets = pack_lengths(lengths[items], capacity)
    if new_bins.max() + 1 < len(weak):
        bins[items], offsets[items] = np.sort(weak)[new_bins], new_offsets
    return bins, offsets


def pieces(docs: DataFrame, sequence: int = SEQUENCE, tokenizer: str | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """One row per piece of each document with the crc32 of its ids, and a running number to deal it by.

    Small partitions are joined, as each one writes a file.
    """

    def run(batches):
        from pyspark import TaskContext

        words, row = word_ids(tokenizer), TaskContext.get().partitionId() * 7919
        for batch in batches:
            for part in common.blocks(batch, "text", TOKENIZED_BYTES):
                ids, at = words.encode(common.texts_of(part))
                out: list[tuple] = []
                for doc, a, b in zip(part.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own = np.append(ids[a:b], np.uint32(END_ID)).astype("<u4").tobytes()
                    n = b - a + 1
                    for piece, start in enumerate(range(0, n, sequence)):
                        stop = min(n, start + sequence)
                        out.append((doc, piece, start, stop - start, zlib.crc32(memoryview(own)[4 * start : 4 * stop]), row))
                        row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            common.release()

    common.bound_batches(docs.sparkSession)
    struct = T._parse_datatype_string(PIECES + ", row long")
    schema = common.arrow_schema(struct)
    tasks = -(-common.stored_bytes(docs) // task_bytes)
    picked = common.pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return picked.coalesce(max(1, min(tasks, 1 << 20))).mapInArrow(run, struct)


def pack(docs: DataFrame, sequence: int = SEQUENCE, tokenizer: str | None = None, shard_rows: int = SHARD_PIECES) -> DataFrame:
    """Pieces of all documents with the sequence each lies in and its offset there."""
    struct = T._parse_datatype_string(PIECES + ", sequence_id long, offset long")
    schema = common.arrow_schema(struct)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        # the order of rows after a shuffle may differ between attempts; packing must not
        t = t.sort_by([(c, "ascending") for c in ("ids_crc32", "doc_id", "piece")])
        bins, offsets = pack_shard(t.column("length").to_numpy(), sequence)
        cols = [t.column(n) for n in schema.names[:5]]
        return pa.Table.from_arrays([*cols, pa.array(bins + (key[0].as_py() << 40)), pa.array(offsets)], schema=schema)

    cut = common.materialize(pieces(docs, sequence, tokenizer), "pieces")
    shards = max(1, -(-cut.count() // shard_rows))
    return cut.withColumn("shard", F.col("row") % shards).drop("row").groupBy("shard").applyInArrow(run, struct)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: all documents in sequences of 4096 ids of the public word-level vocabulary."""
    return pack(common.table(spark, sf_dir, "documents"))
