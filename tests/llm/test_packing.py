import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import best_fit, queries, sum_squares, tokens

from .conftest import by_id

ODD = ["", " ", "İstanbul's", "a\x1cb\x1d c", "<|endoftext|>x <|startoftext|>", "DON'T I'll 'D", "ΑΣ ΟΔΟΣ", "x y\xa0z", "½ ² 12a3", "日本語 テスト", "é́ é", "ﬁ ß ẞ", "a" * 300, "﻿a", "🙂 🙂🙂", "!!!? ...", "x​y"]


@pytest.fixture(scope="module")
def words():
    return tokens.WordIds(tokens.tokenizer_path())


def direct(words, text):
    return words.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=20) | st.sampled_from(ODD), max_size=5))
def test_word_cache_gives_the_tokenizers_ids(texts):
    w = tokens.word_ids()
    ids, at = w.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [direct(w, t) for t in texts]


def test_forgetting_words_changes_nothing(words, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    monkeypatch.setattr(tokens, "CACHE_PIECES", 2)
    for text in ["one two three four", "five six, seven one", *ODD]:
        assert words.encode([text])[0].tolist() == direct(words, text)


def test_remembered_ids_are_bounded(words, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_IDS", 1000, raising=False)
    words.clear()
    for k in range(60):
        text = f"{k}x" * 200
        assert words.encode([text])[0].tolist() == direct(words, text)
        assert words.used <= 2000
    words.clear()


def test_small_partitions_are_joined(spark, tmp_path):
    path = str(tmp_path / "docs")
    rows = [(k, f"word{k} and more " * (k % 7)) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(20).write.parquet(path)
    docs = spark.read.parquet(path)
    whole, parts = sum_squares.pieces(docs.repartition(20)), sum_squares.pieces(docs.repartition(20), task_bytes=1)
    assert whole.rdd.getNumPartitions() == 1 and parts.rdd.getNumPartitions() == 20
    keys = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(whole.select(*keys).collect()) == sorted(parts.select(*keys).collect())
    assert [r.doc_id for r in by_id(sum_squares.pack(docs))] == list(range(60))


def slow_sum_of_squares(lengths, capacity):
    """The rule by its definition: try every place and count the squares."""
    gaps, out = [], []
    squares = lambda g: sum(n * n for n in np.unique([x for x in g if x], return_counts=True)[1])
    for s in lengths:
        options = [(squares([*gaps, capacity - s]), 1, 0, len(gaps))]
        options += [(squares([*gaps[:k], g - s, *gaps[k + 1 :]]), 0, g, -k) for k, g in enumerate(gaps) if g >= s]
        cost, new, g, _ = min(options)
        if new:
            gaps.append(capacity - s)
            out.append(("new", capacity))
        else:
            k = max(k for k, x in enumerate(gaps) if x == g)
            gaps[k] -= s
            out.append(("open", g))
    return out, len(gaps)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=40))
def test_sum_of_squares_follows_its_rule(lengths):
    bins, offsets = sum_squares.pack_lengths(np.array(lengths, np.int64), 12)
    chosen = [("new", 12) if o == 0 else ("open", 12 - int(o)) for o in offsets]
    want, count = slow_sum_of_squares(lengths, 12)
    assert chosen == want and (bins.max() + 1 if lengths else 0) == count


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=60))
def test_second_pass_keeps_every_item_and_saves_bins(lengths):
    sizes = np.array(lengths, np.int64)
    bins, offsets = sum_squares.pack_shard(sizes, 12)
    before = sum_squares.pack_lengths(sizes, 12)[0]
    assert len(set(bins.tolist())) <= len(set(before.tolist()))
    for b in set(bins.tolist()):
        end = 0
        for k in sorted(np.flatnonzero(bins == b), key=lambda k: offsets[k]):
            assert offsets[k] == end
            end += lengths[k]
        assert end <= 12


def check_pieces(rows, texts, words, sequence):
    """Every document's ids come back whole from its pieces, and sequences are full without gaps or overlap."""
    ids = {d: direct(words, t or "") + [1] for d, t in texts}
    seen, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        seen[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    assert set(seen) == set(ids)
    for d, own in seen.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == [*range(len(own))] and [r.start for r in own] == [sequence * k for k in range(len(own))]
        assert all(r.length == sequence for r in own[:-1]) and sum(r.length for r in own) == len(ids[d])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[d][r.start : r.start + r.length], "<u4").tobytes())
    for places in seqs.values():
        end = 0
        for o, n in sorted(places):
            assert o == end
            end += n
        assert end <= sequence
    total = sum(map(len, ids.values()))
    return len(seqs), -(-total // sequence)


def test_packing_edge_cases(docs, words):
    texts = [(k, t) for k, t in enumerate([None, *ODD, "word " * 30_000])]
    got = sum_squares.pack(docs(texts)).collect()
    check_pieces(got, texts, words, 4096)
    assert sum_squares.pack(docs([])).count() == 0
    twice = sum_squares.pack(docs([(1, "same"), (1, "same"), (None, "x")])).collect()
    assert sorted((r.doc_id or 0, r.length) for r in twice) == [(0, 2), (1, 2), (1, 2)] and len({(r.sequence_id, r.offset) for r in twice}) == 3


def test_query_packs_all_documents_tightly(spark, tiny, words):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    used, least = check_pieces(queries.queries()["op10_sum_of_squares"](spark, tiny).collect(), texts, words, 4096)
    assert used <= 1.03 * least + 2
    again = sum_squares.pack(spark.read.parquet(f"{tiny}/documents.parquet"), shard_rows=50).collect()
    assert check_pieces(again, texts, words, 4096)[0] <= 1.1 * least + 8


# --- best-fit-decreasing matrices


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit_decreasing_by_definition(lengths):
    gaps, want = [], {}
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        fits = [(g, b) for b, g in enumerate(gaps) if g >= lengths[k]]
        if fits:
            least = min(g for g, _ in fits)
            want[k] = least
            gaps[max(b for g, b in fits if g == least)] -= lengths[k]
        else:
            gaps.append(20 - lengths[k])
            want[k] = 20
    bins, made = best_fit.best_fit_decreasing(np.array(lengths, np.int64), 20)
    assert made == len(gaps)
    assert sorted(np.bincount(bins, lengths, made).tolist()) == sorted(20.0 - g for g in gaps) if lengths else made == 0


def test_capacity_tree_finds_the_least_fit():
    tree = best_fit.CapacityTree(10)
    for c in (3, 7, 7, 10):
        tree.put(c, c)
    assert [tree.least(c) for c in range(1, 11)] == [3, 3, 3, 7, 7, 7, 7, 10, 10, 10]
    tree.take(10)
    assert tree.least(8) == -1


def test_matrices_round_trip(docs, words):
    texts = [(k, t) for k, t in enumerate([None, *ODD, "word " * 300, "x y " * 500])]
    rows = best_fit.pack_matrices(docs(texts), sequence=64, block_tokens=500).collect()
    parts = defaultdict(dict)
    for r in rows:
        ids = np.frombuffer(r.input_ids, "<u4")
        assert len(ids) == 64 and (ids[r.n_tokens :] == 0).all() and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert r.position_resets == r.cu_seqlens[:-1] and r.n_segments == len(r.doc_ids) == len(r.pieces)
        assert r.ids_crc32 == zlib.crc32(ids[: r.n_tokens].tobytes())
        for d, p, s, a, b in zip(r.doc_ids, r.pieces, r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert s == 64 * p
            parts[d][p] = ids[a:b].tolist()
    for d, t in texts:
        assert sum((parts[d][p] for p in range(len(parts[d]))), []) == direct(words, t or "") + [1]
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert best_fit.pack_matrices(docs([])).count() == 0


def test_matrix_query_holds_every_token(spark, tiny, words, tmp_path):
    packed = queries.queries()["op5_best_fit_matrices"](spark, tiny)
    best_fit.write_matrices(packed, str(tmp_path / "m"))
    rows = spark.read.parquet(str(tmp_path / "m")).collect()
    texts = [r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    total = sum(len(direct(words, t)) + 1 for t in texts)
    assert sum(r.n_tokens for r in rows) == total and len(rows) <= 1.03 * total / 4096 + 5
    assert by_id(spark.createDataFrame([(1,)], "doc_id long"))


def test_waste_does_not_depend_on_the_input_partitions(spark, words):
    """All of sf0.01 in 1, 8 and 100 partitions: within a few sequences of what its tokens would fill."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for n in (1, 8, 100):
        parts = docs.repartition(n)
        packed = sum_squares.pack(parts).selectExpr("sequence_id", "length").groupBy("sequence_id").sum("length").collect()
        least = -(-sum(r[1] for r in packed) // 4096)
        assert len(packed) <= least + 3
        tight = best_fit.pack_matrices(parts, task_bytes=4 << 20).select("n_tokens").collect()
        assert sum(r[0] for r in tight) == sum(r[1] for r in packed)
        if n == 1:
            assert len(tight) <= least + 3


def test_pieces_of_emptiest_rows_are_packed_with_the_next_block():
    pieces = [(k, 0, 0, np.arange(n, dtype=np.uint32)) for k, n in enumerate([60, 33, 7, 100, 40, 3])]
    rows, again = best_fit._matrix_rows(pieces, 100, 0, 5, 50)
    assert sorted(r[1] for r in rows) == [100, 100] and [r[0] for r in rows] == [5, 6] and sorted(len(p[3]) for p in again) == [3, 7, 33]
    rows, again = best_fit._matrix_rows(pieces, 100, 0, 0, 0)
    assert sorted(r[1] for r in rows) == [43, 100, 100] and again == []


def test_batches_are_bounded_and_smaller_bounds_stay(spark):
    from cairn.llm import common

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    for given, after in (("64MB", str(16 << 20)), ("1m", "1m"), ("1g", str(16 << 20))):
        spark.conf.set(key, given)
        common.bound_batches(spark)
        assert spark.conf.get(key) == after
