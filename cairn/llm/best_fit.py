"""Token-id output: best-fit-decreasing packing into id matrices with a segment tree over capacities.

Documents are tokenized and packed in blocks of about ``block_tokens`` ids within a task, so ids
never move between machines and memory is bounded by the block, not by the partition. Pieces in rows that
a block leaves short of ``FULL`` are packed again with the next one (the emptiest, up to a quarter of a
block), so only a task's last block leaves part-filled rows; partitions are joined, without a shuffle, until a
task has about ``TASK_BYTES`` of input, so that there are few such blocks for the data. A document
longer than a sequence is split without loss: full pieces, then the rest. Each output row is one row
of the id matrix: ``input_ids`` holds ``sequence`` little-endian unsigned 32-bit ids (padded with
``pad_id`` after ``n_tokens``), ``cu_seqlens`` the cumulative lengths of its segments from 0, and
``position_resets`` the places where position ids start again at 0.

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
PAD_ID = 0
BLOCK_TOKENS = 4 << 20
#: Share of a row from which it counts as full, and bytes of stored input that a task should have at least.
FULL, TASK_BYTES = 0.99, 4 << 20
ROWS = (
    "sequence_id long, n_tokens long, n_segments int, input_ids binary, cu_seqlens array<int>, position_resets array<int>, "
    "doc_ids array<long>, pieces array<int>, starts array<long>, ids_crc32 long"
)


class CapacityTree:
    """Segment tree over residual capacities: which capacities some open bin has.

    Leaf c counts the open bins with residual c; an inner node sums its children. The best fit of an
    item is the smallest non-empty leaf at or above its size, found by one climb and one descent.
    """

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.total = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _change(self, c: int, by: int) -> None:
        node = c + self.size
        while node:
            self.total[node] += by
            node >>= 1

    def put(self, c: int, b: int) -> None:
        self.bins[c].append(b)
        self._change(c, 1)

    def take(self, c: int) -> int:
        self._change(c, -1)
        return self.bins[c].pop()

    def least(self, c: int) -> int:
        """The smallest residual of an open bin that is at least c, or -1."""
        total, node = self.total, c + self.size
        if total[node]:
            return c
        while node > 1:
            if not node & 1 and total[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return -1
        while node < self.size:
            node *= 2
            if not total[node]:
                node += 1
        return node - self.size


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The bin of each item, largest items first (ties in their order), and the number of bins."""
    tree, out, made = CapacityTree(capacity), np.empty(len(lengths), np.int64), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[k])
        c = tree.least(s)
        if c < 0:
            b, c, made = made, capacity, made + 1
        else:
            b = tree.take(c)
        out[k] = b
        if c > s:
            tree.put(c - s, b)
    return out, made


Piece = tuple[int | None, int, int, np.ndarray]


def _pieces(docs: list, parts: list[np.ndarray], sequence: int) -> list[Piece]:
    """(document, piece, start, ids) of each document's pieces."""
    return [(d, p, start, ids[start : start + sequence]) for d, ids in zip(docs, parts, strict=True) for p, start in enumerate(range(0, len(ids), sequence))]


def _matrix_rows(where: list[Piece], sequence: int, pad_id: int, base: int, back: int) -> tuple[list[tuple], list[Piece]]:
    """The packed rows of one block of pieces, and the pieces of its emptiest rows, which hold ``back`` ids at most."""
    lengths = np.fromiter((len(x[3]) for x in where), np.int64, len(where))
    bins, made = best_fit_decreasing(lengths, sequence)
    filled = np.bincount(bins, lengths, made)
    weak = np.argsort(filled, kind="stable")
    weak = set(weak[(filled[weak] < FULL * sequence) & (np.cumsum(filled[weak]) <= back)].tolist())
    order = np.argsort(bins, kind="stable")
    rows, again, cut = [], [], np.searchsorted(bins[order], np.arange(made + 1)).tolist()
    for b in range(made):
        members = [where[k] for k in order[cut[b] : cut[b + 1]].tolist()]
        if b in weak:
            again += members
            continue
        ids = np.concatenate([m[3] for m in members]).astype("<u4")
        ends = np.cumsum([len(m[3]) for m in members]).tolist()
        padded = ids if len(ids) == sequence else np.concatenate([ids, np.full(sequence - len(ids), pad_id, "<u4")])
        rows.append((base + len(rows), len(ids), len(members), padded.tobytes(), [0, *ends], [0, *ends[:-1]], [m[0] for m in members], [m[1] for m in members], [m[2] for m in members], zlib.crc32(ids.tobytes())))
    return rows, again


def pack_matrices(docs: DataFrame, sequence: int = SEQUENCE, tokenizer: str | None = None, pad_id: int = PAD_ID, block_tokens: int = BLOCK_TOKENS, task_bytes: int = TASK_BYTES) -> DataFrame:
    """One row per packed sequence: the id matrix with its segment and position bookkeeping."""
    struct = T._parse_datatype_string(ROWS)
    schema = common.arrow_schema(struct)

    def run(batches):
        from pyspark import TaskContext

        words, base = word_ids(tokenizer), TaskContext.get().partitionId() << 32
        held: list[Piece] = []
        tokens = 0

        def flush(back: int):
            nonlocal base, held
            rows, held = _matrix_rows(held, sequence, pad_id, base, back)
            base += len(rows)
            for k in range(0, len(rows), 512):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 512], strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for part in common.blocks(batch, "text", TOKENIZED_BYTES):
                ids, at = words.encode(common.texts_of(part))
                end = np.array([END_ID], np.uint32)
                own = [np.concatenate([ids[a:b], end]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                held += _pieces(part.column("doc_id").to_pylist(), own, sequence)
                tokens += len(ids) + part.num_rows
                if tokens >= block_tokens:
                    yield from flush(block_tokens // 4)
                    tokens = 0
        if held:
            yield from flush(0)

    common.bound_batches(docs.sparkSession)
    tasks = -(-common.stored_bytes(docs) // task_bytes)
    picked = common.pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return picked.coalesce(max(1, min(tasks, 1 << 20))).mapInArrow(run, struct)


def write_matrices(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet, one binary matrix row per sequence."""
    packed.write.mode("overwrite").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: all documents as packed id matrices of 4096 columns."""
    return pack_matrices(common.table(spark, sf_dir, "documents"))
