"""Near-duplicate documents by HyperMinHash.

A document is the set of its distinct 5-word shingles, each a 64-bit hash. A sketch has 384 registers
of 16 bits: the exponent of the least hash value of its bucket (that is, its leading zeros) and the ten
bits that follow. In the *bucketed* form six hashes of a shingle each choose one of 64 buckets by their
top bits; buckets of small sets would be empty, so sets under ``BUCKETED_FROM`` shingles use the *repeated*
form, 384 multiplicative hashes of every shingle. (Empty buckets filled from others would not do: of 1,500 simulated
pairs of 8-shingle sets at similarity 0.75 three shared no band then.) Sets within a factor 4/3 of that limit carry both, so
any two sets similar enough to be linked share a form.

1. Documents with equal sets form a class; from here on only one row per class takes part.
2. Bands of six registers are hashed; classes that share a band are candidates. At similarity 0.75
   a pair shares none of its 64 bands with probability 4e-6 (1.4e-5 in the bucketed form at its smallest).
3. Each class is compared with the least class of each of its buckets (a star, not all pairs): first by
   the Jaccard estimate from registers, corrected for chance collisions, then by the full sets.
   Verified links are contracted to components.
4. Where a bucket still holds several components, members outside its main component meet all members
   of other components in tiles, by all their registers; pairs that these allow are verified in full,
   the likeliest first, as each link found saves the other pairs of its components. While these are
   sought, a bucket with many members outside (documents that share a passage and little else) is split:
   its members must share one more, later band. What is still apart then is compared in whole buckets,
   so the size of a bucket decides nothing; time and tiles grow with the square of the members outside.

Memory of a task is bounded by a block of rows: no step gathers a bucket or a component. Joins on
buckets and components are plain shuffles of both sides, which adaptive execution splits when hot.

Defined cases: null and empty texts, and texts of white space, have no shingles and are linked with
nothing; a text of one to four words is one shingle; rows with a null doc_id count as copies of a
document with their set but are not compared otherwise, and never name a component (where no copy has an
id, component_id is null and the row is kept); repeated rows are copies of each other, and rows that share
a doc_id each carry the verdict of their own text; an empty table
gives no rows; other columns are ignored. Hashes are 64 bits wide: two different sets are taken for one
with a probability of about n*n / 2**65 for n documents.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, hashing

SHINGLE = 5
#: Registers: rounds of hashing times buckets; a band has one register of each round.
ROUNDS, BUCKETS = 6, 64
REGISTERS = ROUNDS * BUCKETS
BAND = ROUNDS
#: Links need 100 * intersection >= LEAST * union.
LEAST = 75
BUCKETED_FROM = 256
#: An estimate lower by this much than the threshold is four standard deviations off.
SLACK = 0.09
#: Most rows of a tile in which members of a bucket meet, about.
TILE_OUTER, TILE_INNER = 256, 1024
#: Members outside a bucket's main component from which the bucket is split by another band, as the likeliest links are sought.
SPLIT_FROM = 256
#: After so many splits all members left together are compared.
MOST_SPLITS = 2

_COMBINE = np.random.default_rng(5).integers(1, 1 << 63, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = np.random.default_rng(6).integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = np.random.default_rng(7).integers(1, 1 << 63, REGISTERS, dtype=np.uint64)
_BITS = 57  # bits of a value, below those that choose a bucket
_BOUNDS = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(58)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, at = hashing.join_texts([t.encode().translate(hashing.LOWER) for t in texts])
    starts, ends = hashing.space_words(data)
    words = hashing.word_hashes(data, starts, ends)
    first = np.searchsorted(starts, at).tolist()
    if len(words) >= SHINGLE:
        n = len(words) - SHINGLE + 1
        whole = words[:n] * _COMBINE[0]
        for k in range(1, SHINGLE):
            whole += words[k : n + k] * _COMBINE[k]
        whole = hashing.mix(whole)
    out = []
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= SHINGLE:
            out.append(np.unique(whole[a : b - SHINGLE + 1]))
        elif b > a:
            parts = np.append(words[a:b] * _COMBINE[: b - a], np.array([b - a], np.uint64) * _COMBINE[SHINGLE])
            out.append(hashing.mix(parts.sum(keepdims=True, dtype=np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _register(least: np.ndarray) -> np.ndarray:
    """16 bits of each least value: its exponent, and the ten bits after the leading one."""
    part, exponent = np.frexp(least.astype(np.float64))
    return (exponent * 1024 + ((part * 2 - 1) * 1024).astype(np.int64) + 1).clip(1, 65535).astype("<u2")


def bucketed(shingles: np.ndarray) -> np.ndarray:
    """Registers from the least value in each 64th of the range of each of six hashes; 0 where there is none."""
    out = np.zeros((BUCKETS, ROUNDS), "<u2")
    for r in range(ROUNDS):
        values = np.sort(shingles * _FACTORS[r])
        at = np.searchsorted(values, _BOUNDS)
        some = np.append(at[1:], len(values)) > at
        out[some, r] = _register((values[at[some]] & np.uint64((1 << 58) - 1)) >> np.uint64(1))
    return out.ravel()


def repeated(shingles: np.ndarray) -> np.ndarray:
    """Registers from the least value of all shingles under each of 384 hashes."""
    return _register((shingles[:, None] * _FACTORS + _OFFSETS).min(0) >> np.uint64(64 - _BITS))


@functools.lru_cache(4096)
def _chance(one: int, two: int, form: str) -> float:
    """Probability that unequal least values of sets of these sizes have equal registers."""
    e = np.arange(1, _BITS + 1)
    share = BUCKETS if form == "bucketed" else 1

    def at(n: int) -> np.ndarray:
        return np.exp(-(n / share) * 2.0 ** (e - 1 - _BITS)) - np.exp(-(n / share) * 2.0 ** (e - _BITS))

    return float((at(one) * at(two)).sum() / 1024)


def estimate(one: np.ndarray, two: np.ndarray, n_one: int, n_two: int, form: str) -> float:
    """Jaccard similarity from the registers of two sketches of a form, corrected for chance collisions."""
    used = (one > 0) | (two > 0)
    equal = float((one == two)[used].mean()) if used.any() else 0.0
    c = _chance(1 << (n_one.bit_length() - 1), 1 << (n_two.bit_length() - 1), form)
    return (equal - c) / (1 - c)


def _node(shingles: np.ndarray) -> int:
    """The hash of a set, which names its class."""
    total, parity = shingles.sum(keepdims=True, dtype=np.uint64), np.bitwise_xor.reduce(shingles, keepdims=True)
    return int(hashing.mix(total ^ parity * _COMBINE[1] + np.uint64(len(shingles))).view(np.int64)[0])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, the hash of the set, and the registers of each form it carries."""

    def compute(part: pa.RecordBatch) -> list:
        sets = shingle_sets(common.texts_of(part))
        small = [repeated(s).tobytes() if 0 < len(s) <= BUCKETED_FROM * 4 // 3 else None for s in sets]
        large = [bucketed(s).tobytes() if len(s) >= BUCKETED_FROM else None for s in sets]
        return [[len(s) for s in sets], [_node(s) for s in sets], small, large]

    return common.add_columns(common.pick(docs, "doc_id", "text"), "n_shingles long, node long, small binary, large binary", compute, ["doc_id"])


def bands(classes: DataFrame) -> DataFrame:
    """(band, node) for each band of each form that a class carries; a band with an empty register is none.

    ``band`` is a hash of form, place and registers, with the place in its last seven bits.
    """

    def keys(form: str, salt: int) -> Column:
        part = lambda k: F.substring(form, k * (2 * BAND) + 1, F.lit(2 * BAND))
        band = lambda k: F.xxhash64(F.lit(salt), k, part(k)).bitwiseAND(F.lit(-2 * BUCKETS)) + k + BUCKETS * salt
        each = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda k: F.when(~F.contains(part(k), F.unhex(F.lit("0000"))), band(k)))
        return F.when(F.col(form).isNotNull(), F.array_compact(each)).otherwise(F.array().cast("array<bigint>"))

    return classes.select(F.explode(F.concat(keys("small", 0), keys("large", 1))).alias("band"), "node")


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose registers don't rule out a link."""
    own = classes.select("node", "n_shingles", "small", "large")
    left = own.select(*[F.col(c).alias(f"{c}_a") for c in own.columns])
    right = own.select(*[F.col(c).alias(f"{c}_b") for c in own.columns])
    # sizes alone rule a pair out before registers are looked at
    sized = 100 * F.least("n_shingles_a", "n_shingles_b") >= LEAST * F.greatest("n_shingles_a", "n_shingles_b")
    both = pairs.join(left, pairs["a"] == left["node_a"]).join(right, F.col("b") == right["node_b"]).where(sized).drop("node_a", "node_b")

    def compute(batches):
        for batch in batches:
            d = batch.to_pydict()
            keep = []
            for na, nb, sa, sb, la, lb in zip(d["n_shingles_a"], d["n_shingles_b"], d["small_a"], d["small_b"], d["large_a"], d["large_b"], strict=True):
                form, x, y = ("repeated", sa, sb) if sa is not None and sb is not None else ("bucketed", la, lb)
                keep.append(x is not None and y is not None and estimate(np.frombuffer(x, "<u2"), np.frombuffer(y, "<u2"), na, nb, form) >= LEAST / 100 - SLACK)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "n_shingles_a", "n_shingles_b", "small_a", "small_b", "large_a", "large_b").mapInArrow(compute, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; ``texts`` has one text per node."""
    left, right = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def compute(batches):
        for batch in batches:
            for part in common.blocks(batch, "ta"):
                keep = []
                for x, y in zip(shingle_sets(common.texts_of(part, "ta")), shingle_sets(common.texts_of(part, "tb")), strict=True):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * shared >= LEAST * (len(x) + len(y) - shared) and shared > 0)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(compute, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of an edge table (a, b): the least node it can reach.

    Each round every node points at the least of its neighbours and itself, pointers are followed once
    more, and the edges are renamed and thinned to those between different nodes that are left. Nodes with
    an edge at least halve, so rounds are few and each is smaller than the one before.
    """
    labels: DataFrame | None = None
    edges = common.materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = common.materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("comp")), "least")
        pointers = common.materialize(_follow(least, least), "pointers")
        left, right = pointers.select(F.col("node").alias("a"), F.col("comp").alias("x")), pointers.select(F.col("node").alias("b"), F.col("comp").alias("y"))
        thinner = edges.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        thinner = common.materialize(thinner, "edges")
        common.discard(edges, least)
        edges = thinner
        if labels is None:
            labels = pointers
        else:
            followed = common.materialize(_follow(labels, pointers), "labels")
            common.discard(labels, pointers)
            labels = followed
        if edges.isEmpty():
            common.discard(edges)
            return labels


def _follow(labels: DataFrame, pointers: DataFrame) -> DataFrame:
    """Labels with each component that has a pointer renamed to where it points."""
    to = pointers.select(F.col("node").alias("comp"), F.col("comp").alias("_next"))
    return labels.join(to, "comp", "left").select("node", F.coalesce("_next", "comp").alias("comp"))


def _extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links: only the components that these join are looked at again."""
    left, right = labels.select(F.col("node").alias("a"), F.col("comp").alias("x")), labels.select(F.col("node").alias("b"), F.col("comp").alias("y"))
    between = links.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    pointers = components(between)
    added = pointers.join(labels.select("node"), "node", "left_anti")
    out = common.materialize(_follow(labels, pointers).unionByName(added), "labels")
    common.discard(labels, pointers)
    return out


def _bucket_pairs(members: DataFrame, classes: DataFrame, best: int | None, split_from: int = SPLIT_FROM, most_splits: int = MOST_SPLITS) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket and whose registers allow a link.

    ``members`` has (band, at, node, comp). In each bucket the rows outside its main component meet
    all its rows, in tiles of bounded size, by their registers; a pair is emitted only in the first bucket
    that it shares. With ``best``, only that many of the most similar pairs of each outer row of a tile.
    Pairs without a second shared band are left out where a bucket is split; ``most_splits`` of 0 compares all.
    """
    members = members.withColumn("path", F.array("at"))
    bands_of, out, temporary = members.select("node", F.col("band").alias("_more"), F.col("at").alias("_more_at")), None, []
    for split in range(most_splits + 1):
        parts = members.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"))
        main = parts.groupBy("band").agg(F.max(F.struct("n", "comp")).alias("_m"), F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_comps")).where("_comps > 1")
        main = main.select("band", F.col("_m.comp").alias("_main"), "_all", (F.col("_all") - F.col("_m.n")).alias("_outside"))
        main = common.materialize(main, "main")
        mixed = common.materialize(members.join(main, "band"), "mixed")
        temporary += [main, mixed]
        last = split == most_splits
        pairs = _compared(mixed if last else mixed.where(F.col("_outside") <= split_from), classes, best)
        out = pairs if out is None else out.union(pairs)
        large = mixed.where(F.col("_outside") > split_from)
        if last or large.isEmpty():
            break
        members = large.select("band", "at", "path", "node", "comp").join(bands_of, "node").where("_more_at > at")
        members = members.select(F.xxhash64("band", "_more").alias("band"), F.col("_more_at").alias("at"), F.concat("path", F.array("_more_at")).alias("path"), "node", "comp")
        sizes = members.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band")
        members = common.materialize(members.join(sizes, "band", "left_semi"), "split")
        temporary.append(members)
    out = common.materialize(out.distinct(), "pairs")
    common.discard(*temporary)
    return out


def _compared(mixed: DataFrame, classes: DataFrame, best: int | None) -> DataFrame:
    """The pairs of buckets with main components, from tiles of outer rows and members."""
    tiles_out, tiles_in = F.ceil(F.col("_outside") / TILE_OUTER), F.ceil(F.col("_all") / TILE_INNER)
    part = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "node"), n)
    other = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    cols = ["band", "path", "node", "comp", (F.col("comp") == F.col("_main")).alias("main")]
    outer = mixed.where("comp <> _main").select(*cols, F.lit(True).alias("outer"), part(tiles_out, 1).alias("o"), other(tiles_in).alias("i"))
    inner = mixed.select(*cols, F.lit(False).alias("outer"), other(tiles_out).alias("o"), part(tiles_in, 2).alias("i"))
    registers = F.when(F.col("path")[0] < BUCKETS, F.col("small")).otherwise(F.col("large")).alias("registers")
    own = classes.select("node", F.col("n_shingles").alias("size"), "small", "large")
    rows = outer.union(inner).join(own, "node").select("band", "o", "i", "path", "node", "size", "comp", "main", "outer", registers)
    rows = rows.repartition("band", "o", "i").sortWithinPartitions("band", "o", "i")

    def run(batches):
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("band", "o", "i")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if key != tuple(keys[:, a]):
                    if held:
                        yield _tile(pa.Table.from_batches(held), best)
                    held, key = [], tuple(keys[:, a])
                held.append(batch.slice(a, b - a))
        if held:
            yield _tile(pa.Table.from_batches(held), best)

    return rows.mapInArrow(run, "a long, b long")


def _tile(rows: pa.Table, best: int | None) -> pa.RecordBatch:
    """The pairs of one tile."""
    outer = rows.column("outer").to_numpy()
    node, size, comp, main = (rows.column(c).to_numpy() for c in ("node", "size", "comp", "main"))
    registers = np.frombuffer(b"".join(rows.column("registers").to_pylist()), "<u2").reshape(len(node), REGISTERS)
    path = np.array(rows.column("path")[0].as_py())
    form = "bucketed" if path[0] >= BUCKETS else "repeated"
    inner = np.flatnonzero(~outer)
    values, sizes, comps, nodes, mains = registers[inner], size[inner], comp[inner], node[inner], main[inner]
    left, right = [], []
    for k in np.flatnonzero(outer).tolist():
        fits = (comps != comp[k]) & (mains | (node[k] < nodes)) & (100 * np.minimum(sizes, size[k]) >= LEAST * np.maximum(sizes, size[k]))
        some = np.flatnonzero(fits)
        if not len(some):
            continue
        equal = values[some] == registers[k]
        c = _chance(1 << (int(size[k]).bit_length() - 1), 1 << (int(size[k]).bit_length() - 1), form)
        similar = (equal.mean(1) - c) / (1 - c)
        close = np.flatnonzero(similar >= LEAST / 100 - SLACK)
        if not len(close):
            continue
        shared = equal[close].reshape(-1, BUCKETS, BAND).all(2) & (registers[k].reshape(BUCKETS, BAND) > 0).all(1)
        before = np.cumsum(shared, 1)
        at = path % BUCKETS
        first = (shared[:, at] & (before[:, at] == np.arange(1, len(at) + 1))).all(1)
        close = close[first]
        if best is not None and len(close) > best:
            close = close[np.lexsort([nodes[some[close]], -similar[close]])[:best]]
        left += [node[k]] * len(close)
        right += nodes[some[close]].tolist()
    a, b = np.array(left, np.int64), np.array(right, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    return _verdicts(docs).drop("node")


def _verdicts(docs: DataFrame) -> DataFrame:
    """The same with the hash of the set, node."""
    docs = common.pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    sketch = common.materialize(sketches(docs), "sketch")
    some = sketch.where("n_shingles > 0")
    # registers follow from the set, so they are grouping keys and not aggregates
    classes = common.materialize(some.groupBy("node", "n_shingles", "small", "large").agg(F.min("doc_id").alias("rep")), "classes")
    full, sketch = sketch, common.materialize(sketch.select("doc_id", "n_shingles", "node"), "sets")
    common.discard(full)
    rows = common.materialize(bands(classes), "bands")
    # only hashes are shuffled to learn which bands are shared; few are
    shared = common.materialize(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band"), "shared")
    # a merge join at every size: what is shared grows with the documents
    members = rows.join(shared.hint("merge"), "band").select("band", F.col("band").bitwiseAND(F.lit(2 * BUCKETS - 1)).cast("short").alias("at"), "node")
    members = common.materialize(members, "members")
    # from here on only classes in some bucket matter, with their registers and texts
    sharing = common.materialize(classes.join(members.select("node").distinct(), "node", "left_semi"), "sharing")
    common.discard(rows, shared)
    centers = common.materialize(members.groupBy("band").agg(F.min("node").alias("center")), "centers")
    stars = members.join(centers, "band").where("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
    candidates = common.materialize(_estimated(stars, sharing), "candidates")
    texts = common.materialize(_texts_of(docs, sharing), "texts")
    links = common.materialize(_verified(candidates, texts), "links")
    labels = components(links)
    tried = candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    temporary = [members, centers, sharing, candidates, texts, links]
    for best in (2, None):
        # first the likeliest links of each row, for these leave far fewer components to compare in full
        placed = members.join(labels, "node", "left").select("band", "at", "node", F.coalesce("comp", "node").alias("comp"))
        pairs = _bucket_pairs(placed, sharing, best) if best else _bucket_pairs(placed, sharing, None, most_splits=0)
        fresh = common.materialize(pairs.join(tried, ["a", "b"], "left_anti"), "fresh")
        more = common.materialize(_verified(fresh, texts), "links")
        if not more.isEmpty():
            labels = _extended(labels, more)
        tried = tried.union(fresh)
        temporary += [pairs, fresh, more]
    common.discard(*temporary)
    # what is joined with a hot component or node is a table of its own, so that adaptive execution can split the other side
    grouped = common.materialize(labels.join(classes.select("node", "rep"), "node"), "grouped")
    least = common.materialize(grouped.groupBy("comp").agg(F.min("rep").alias("component")), "least")
    moved = grouped.join(least, "comp").select("node", "component")
    verdict = classes.select("node", "rep").join(moved, "node", "left").select("node", F.coalesce("component", "rep").alias("component"))
    verdict = common.materialize(verdict, "verdict")
    common.discard(labels, grouped, least, classes)
    alone = F.col("n_shingles") == 0
    out = sketch.select("doc_id", "n_shingles", "node").join(verdict, "node", "left")
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "node", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, each by its own text; repeated rows become one, rows without a doc_id stay.

    Texts are shuffled once, to meet the ids that stay. Only rows that share a doc_id are told apart by
    their sets and compared whole.
    """
    verdicts = common.materialize(_verdicts(docs).where("doc_id is not null").select("doc_id", "node", "kept"), "verdicts")
    ids = common.materialize(verdicts.groupBy("doc_id").agg(F.bool_or("kept").alias("some"), F.count(F.lit(1)).alias("n")).where("some"), "ids")
    # a merge join at every size, as the ids that stay grow with the documents
    clear = docs.join(ids.where("n = 1").hint("merge"), "doc_id", "left_semi").select(*docs.columns)

    def compute(part: pa.RecordBatch) -> list:
        return [[_node(s) for s in shingle_sets(common.texts_of(part))]]

    shared = common.add_columns(docs.join(ids.where("n > 1"), "doc_id", "left_semi").select(*docs.columns), "_set long", compute, docs.columns)
    own = shared.join(verdicts.where("kept").select("doc_id", F.col("node").alias("_set")), ["doc_id", "_set"], "left_semi").select(*docs.columns)
    return clear.unionByName(own.distinct()).unionByName(docs.where("doc_id is null"))


def _texts_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, text) of one document of each class; rows that share its doc_id but not its set are left out."""
    both = docs.join(classes.select(F.col("rep").alias("doc_id"), "node"), "doc_id").select("node", "text")

    def compute(batches):
        for batch in batches:
            for part in common.blocks(batch, "text"):
                own = pa.array([_node(s) for s in shingle_sets(common.texts_of(part))], pa.int64())
                yield part.filter(pc.equal(own, part.column("node")))

    return both.mapInArrow(compute, both.schema).distinct()


def query(spark, sf_dir: str) -> DataFrame:
    """op8: near-duplicate components of all documents."""
    return near_duplicates(common.table(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
k AS (SELECT g, min(doc_id) AS rep FROM s WHERE len(g) > 0 GROUP BY g),
x AS (SELECT rep, len(g) AS n, unnest(g) AS t FROM k),
p AS (
  SELECT a.rep AS a, b.rep AS b FROM x AS a JOIN x AS b ON a.t = b.t AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT rep AS node, rep AS c FROM k UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node),
m AS (SELECT node, min(c) AS component FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(component, s.doc_id) AS component_id, s.doc_id = coalesce(component, s.doc_id) AS kept
FROM s LEFT JOIN k ON k.g = s.g LEFT JOIN m ON m.node = k.rep
"""
