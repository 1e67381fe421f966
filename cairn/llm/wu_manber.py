"""Benchmark decontamination: Wu-Manber search for all 8-word windows of the benchmark at once.

Texts and windows are put in one normal form: A-Z in lower case, every run of other characters than
[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] one space, a space before and after. In it a window occurs where its
string occurs. For a set of windows of which the shortest has m bytes, a table indexed by a hash of a
B-byte block tells how far the search may move on when a block is met: the least distance from an
occurrence of that block in some window's first m bytes to byte m. Only where this is 0 may a window
end at byte m; the suffix hash there picks the bucket of windows that are compared directly.

The search advances one place in each of many stretches of text together, each by its own shift.
Every block of benchmark items is a step over the same rows, so the documents are never shuffled. A
block's text is all that the driver holds and sends; each worker makes the block's tables from it. After
``STEPS`` blocks the rows are written and read again, so no task ever holds more tables than that, and
memory has a stated bound whatever the benchmark's size: what grows with it is time.

Defined cases: null and empty texts have no words and no hits; an item without words has no window,
one of fewer words than a window is one window; a null item_id is no item; repeated items count once;
windows that several items share count for each; null doc_id is kept; other columns are ignored or kept.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, hashing

WINDOW = 8
#: Items hit from which a document counts as contaminated.
MIN_ITEMS = 2
#: Bytes of benchmark text whose windows are searched for in one step (about twelve times as much memory in a worker).
TABLE_BYTES = 4 << 20
#: Steps, each with a worker of its own, that a task goes through before its rows are written.
STEPS = 4
#: Bytes of text that one lane of the search covers.
LANE = 2048
#: A shift table has this many entries.
SHIFT_BITS = 20

#: Word bytes become lower case, all others a space; bytes from 0x80 on belong to words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The normal form of all texts in one buffer, a line feed between them, and the place of each text.

    Each text is a space, its words with one space after each, and the line feed.
    """
    raw = [t.encode() for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw)) + 3
    place = np.cumsum(size) - size
    data = np.frombuffer((b" " + b"   ".join(raw) + b"  ").translate(_FOLD), np.uint8).copy() if raw else np.empty(0, np.uint8)
    data[place + size - 1] = 10
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    return data[keep], (np.cumsum(keep) - 1)[place]


class Table:
    """Shift table and suffix buckets of a set of patterns, which are stretches of one buffer."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, numbers: np.ndarray):
        self.starts, self.sizes, self.numbers = starts, sizes, numbers
        self.m = int(sizes.min())
        self.b = max(1, min(8, self.m // 2))
        bits = min(SHIFT_BITS, 8 * self.b)
        self.bits = np.uint64(64 - bits)
        width = self.m - self.b + 1
        self.shift = np.full(1 << bits, width, np.int32)
        keys = None
        for at in range(width):
            keys = self.key(data[(starts + at)[:, None] + np.arange(self.b)])
            np.minimum.at(self.shift, self._slot(keys), width - 1 - at)
        self.which = np.argsort(keys, kind="stable").astype(np.int32)
        self.suffix = keys[self.which]

    def key(self, block: np.ndarray) -> np.ndarray:
        out = np.zeros(len(block), np.uint64)
        for k in range(self.b):
            out = (out << np.uint64(8)) | block[:, k]
        return out

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)

    def search(self, data: np.ndarray, raw: bytes, source: bytes) -> list[tuple[int, int]]:
        """Every (start, number of the pattern) at which a pattern of ``source`` occurs in the buffer ``data``."""
        n, found = len(data), []
        ends = np.arange(self.m - 1, n, LANE, dtype=np.int64)
        stops = np.minimum(ends + LANE, n)
        padded = np.concatenate([data, np.zeros(1, np.uint8)])
        while len(ends):
            keys = np.zeros(len(ends), np.uint64)
            for k in range(self.b):
                keys = (keys << np.uint64(8)) | padded[ends - (self.b - 1 - k)]
            step = self.shift[self._slot(keys)]
            hit = np.flatnonzero(step == 0)
            if len(hit):
                lo, hi = np.searchsorted(self.suffix, keys[hit]), np.searchsorted(self.suffix, keys[hit], "right")
                for k in np.flatnonzero(hi > lo).tolist():
                    start = int(ends[hit[k]]) - self.m + 1
                    for p in self.which[lo[k] : hi[k]].tolist():
                        at, size = int(self.starts[p]), int(self.sizes[p])
                        if raw[start : start + size] == source[at : at + size]:
                            found.append((start, int(self.numbers[p])))
            ends = ends + np.maximum(step, 1)
            on = ends < stops
            if not on.all():
                ends, stops = ends[on], stops[on]
        return found


class Windows:
    """The windows of a block of benchmark items, in tables by length so that short ones don't slow the others.

    Windows are stretches of the items' normal form. Equal ones are found by hash, confirmed by their
    bytes, and kept once, with the items that hold them.
    """

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        self.items = [i for i, _ in items]
        data, place = fold([t or "" for _, t in items])
        self.source = data.tobytes()
        letter = (data != 32) & (data != 10)
        begins, ends = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1, np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
        first = np.searchsorted(begins, place)
        count = np.diff(np.append(first, len(begins)))
        n = np.where(count > 0, np.maximum(count - window + 1, 1), 0)
        item = np.repeat(np.arange(len(items), dtype=np.int32), n)
        word = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(item))
        starts = begins[word] - 1
        stops = ends[word + np.minimum(count, window)[item] - 1] + 1
        h = hashing.word_hashes(data, starts, stops)
        order = np.argsort(h, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = h[order][1:] != h[order][:-1]
        for k in np.flatnonzero(~new).tolist():
            a, b = order[k - 1], order[k]
            new[k] = self.source[starts[a] : stops[a]] != self.source[starts[b] : stops[b]]
        self.owner, self.owned = item[order], np.append(np.flatnonzero(new), len(order))
        own = order[new]
        starts, sizes = starts[own], (stops - starts)[own]
        self.words = np.minimum(count, window)[item[own]]
        kind = np.minimum(np.frexp(sizes)[1], 6)  # bits of the size, all from 32 on together
        self.tables = [Table(data, starts[kind == k], sizes[kind == k], np.flatnonzero(kind == k)) for k in np.unique(kind)]

    def owners(self, p: int) -> set:
        """The items that hold a window."""
        return {self.items[i] for i in self.owner[self.owned[p] : self.owned[p + 1]].tolist()}

    def find(self, data: np.ndarray, place: np.ndarray) -> dict[int, list[tuple[int, int, set]]]:
        """By text: the (first word, word after the last, items) of each occurrence."""
        raw = data.tobytes()
        found = [hit for t in self.tables for hit in t.search(data, raw, self.source)]
        if not found:
            return {}
        begins = np.flatnonzero((data[1:] != 32) & (data[1:] != 10) & (data[:-1] == 32)) + 1
        starts = np.array([s for s, _ in found], np.int64)
        text = np.searchsorted(place, starts, "right") - 1
        first = np.searchsorted(begins, starts) - np.searchsorted(begins, place[text])
        out: dict[int, list] = defaultdict(list)
        for t, w, (_, p) in zip(text.tolist(), first.tolist(), found, strict=True):
            out[t].append((w, w + int(self.words[p]), self.owners(p)))
        return out


#: The windows that this worker has made of the block it was sent last, by the block's name.
_MADE: dict[str, Windows] = {}


def _windows_of(name: str, sent, window: int) -> Windows:
    if name not in _MADE:
        _MADE.clear()
        _MADE[name] = Windows(sent.value, window)
    return _MADE[name]


def item_blocks(benchmark: DataFrame, limit: int = TABLE_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``limit`` bytes of text, which reach the driver one by one (at least one block)."""
    out: list[tuple[int, str]] = []
    size = 0
    items = common.pick(benchmark, "item_id", "text").where("item_id is not null and text is not null")
    for item, text in items.orderBy("item_id", "text").toLocalIterator():
        if size > limit:
            yield out
            out, size = [], 0
        out.append((item, text))
        size += len(text.encode())
    yield out


_VERDICT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_ranges array<long>"


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = WINDOW, min_items: int = MIN_ITEMS, table_bytes: int = TABLE_BYTES, cut: bool = False, steps: int = STEPS) -> DataFrame:
    """Per document its words, the words hit, the items hit, whether it is contaminated, and the hit ranges.

    ``hit_ranges`` lists [first, end) of maximal runs of hit words. ``keep`` are columns of ``docs`` to keep.
    With ``cut``, text and n_chars come back too, without the words hit.
    """
    sc = docs.sparkSession.sparkContext
    keep = keep or ["doc_id"]
    carried = list(dict.fromkeys([*keep, "text"]))
    out, written, sent = common.pick(docs, *carried), [], []
    blocks = item_blocks(benchmark, table_bytes)
    block, k = next(blocks), 0
    while block is not None:
        after = next(blocks, None)
        sent.append(sc.broadcast(block))
        last = after is None
        added = (_VERDICT + ", text string, n_chars long" * cut) if last else "_ranges array<long>, _items array<long>"
        out = common.add_columns(out, added, _scan(uuid.uuid4().hex, sent[-1], window, k > 0, last, min_items, cut), keep if last else carried)
        if not last and len(sent) == steps:
            out = common.materialize(out, "scanned")
            written.append(out)
            common.discard(*written[:-1])
            written = written[-1:]
            for b in sent:
                b.destroy()
            sent = []
        block, k = after, k + 1
    return out


#: A word of a text as it stands, before its letters are folded.
_RAW_WORD = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def without_ranges(text: str, ranges: list[int]) -> str:
    """A text without the words of the given [first, end) ranges and what stands between these words."""
    spans = [m.span() for m in _RAW_WORD.finditer(text)]
    out, at = [], 0
    for a, b in zip(ranges[::2], ranges[1::2], strict=True):
        out.append(text[at : spans[a][0]])
        at = spans[b - 1][1]
    return "".join([*out, text[at:]])


def remove_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_items: int = MIN_ITEMS) -> DataFrame:
    """``docs`` (doc_id, text, lang, source, n_chars) without contaminated documents; others lose the words hit."""
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    return decontaminate(docs, benchmark, cols, window, min_items, cut=True).where("not contaminated").select(*cols)


def _cut(part: pa.RecordBatch, ranges: list[list[int]]) -> list:
    """Texts without their ranges, and their lengths; both as they were where nothing was hit."""
    texts = [without_ranges(t, r) if r else t for t, r in zip(part.column("text").to_pylist(), ranges, strict=True)]
    return [texts, [len(t) if r else n for t, r, n in zip(texts, ranges, part.column("n_chars").to_pylist(), strict=True)]]


def _scan(name: str, sent, window: int, carried: bool, last: bool, min_items: int, cut: bool):
    def compute(part: pa.RecordBatch) -> list:
        data, place = fold(common.texts_of(part))
        found = _windows_of(name, sent, window).find(data, place)
        n = part.num_rows
        before = (part.column("_ranges").to_pylist(), part.column("_items").to_pylist()) if carried else ([[]] * n, [[]] * n)
        ranges, items = [], []
        for k, (old, own) in enumerate(zip(*before, strict=True)):
            hits = found.get(k)
            if hits:
                old = _merge([*zip(old[::2], old[1::2], strict=True), *((a, b) for a, b, _ in hits)])
                own = sorted({*own, *(i for _, _, s in hits for i in s)})
            ranges.append(old)
            items.append(own)
        if not last:
            return [ranges, items]
        begins = (data[1:] != 32) & (data[1:] != 10) & (data[:-1] == 32)
        count = np.concatenate([[0], np.cumsum(begins)])
        words = np.diff(count[np.append(place, len(data) - 1)]) if n else []
        sha = [hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest() for own in items]
        verdict = [words, [sum(r[1::2]) - sum(r[::2]) for r in ranges], [len(own) for own in items], sha, [len(own) >= min_items for own in items], ranges]
        return verdict + (_cut(part, ranges) if cut else [])

    return compute


def _merge(pairs: list[tuple[int, int]]) -> list[int]:
    """Sorted disjoint ranges as a flat list."""
    out: list[int] = []
    for a, b in sorted(pairs):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """op3: every document against every benchmark item."""
    docs, benchmark = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")
    return decontaminate(docs.withColumn("doc_id", F.col("doc_id").cast("long")), benchmark).drop("hit_ranges")


SQL = """
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS k, array_to_string(w[i : i + 7], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT doc_id, dw.k AS k, i, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.k = bw.k),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""
