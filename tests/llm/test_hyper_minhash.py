import random
import re
from collections import Counter

import numpy as np

from cairn.llm import hyper_minhash as hm
from cairn.llm import queries

from ..conftest import oracle_rows, rows_of
from .conftest import by_id


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """doc_id -> (set size, least id reachable), for unique ids."""
    sets = {d: shingles(t) for d, t in rows}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= 75 * max(len(x), len(y)) and find(a) != find(b) and 100 * len(x & y) >= 75 * len(x | y):
                up[max(find(a), find(b))] = min(find(a), find(b))
    return {d: (len(sets[d]), find(d)) for d in ids}


def got_of(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def family(rng, size, copies, edits):
    """A text and copies of it with some words replaced: similarity falls from near 1 to below the threshold."""
    base, out = words(rng, size), []
    for k in range(copies):
        t = list(base)
        for _ in range(edits(k)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(t))
    return out


def test_components_match_brute_force(docs):
    rng = random.Random(3)
    texts = [" ".join(words(rng, n)) for n in (1, 2, 4, 5, 6, 40, 400) for _ in range(3)]
    for size in (1, 3, 5, 8, 12, 40, 200, 260, 330, 700, 1500):
        texts += family(rng, size, 8, lambda k, size=size: k * max(1, size // 120))
    texts += ["same text of five words", "SAME text of\tfive words", "", None, " \n ", "Café É"]
    rng.shuffle(texts)
    rows = [*enumerate(texts)]
    out = hm.near_duplicates(docs(rows))
    assert got_of(out) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())


def test_shared_passages_and_split_buckets(docs, monkeypatch):
    """Documents that share a passage make large buckets of several components; links inside are still found."""
    rng = random.Random(5)
    passage = words(rng, 60)
    texts = [" ".join(passage + words(rng, 50)) for _ in range(120)]
    for _ in range(10):
        own = words(rng, 50)
        texts += [" ".join(passage + own), " ".join(passage + own[:-4] + words(rng, 4))]
    texts += family(rng, 120, 150, lambda k: k % 9)
    rows = [*enumerate(texts)]
    want = brute(rows)
    assert got_of(hm.near_duplicates(docs(rows))) == want
    for name, value in {"SPLIT_FROM": 5, "TILE_OUTER": 8, "TILE_INNER": 16}.items():
        monkeypatch.setattr(hm, name, value)
    monkeypatch.setattr(hm._bucket_pairs, "__defaults__", (5, 2))
    assert got_of(hm.near_duplicates(docs(rows))) == want


def test_a_pair_with_one_band_in_a_large_bucket_is_linked(spark, docs, monkeypatch):
    """Registers made so that all documents share the first band, and the two similar ones no other."""
    rng, numbers = random.Random(8), np.random.default_rng(8)
    texts = [" ".join(words(rng, 40)) for _ in range(30)]
    nodes = [hm._node(s) for s in hm.shingle_sets(texts)]
    center = nodes.index(min(nodes))
    texts[center], texts[0] = texts[0], texts[center]
    texts[2] = texts[1] + " x"
    assert min(nodes) < hm._node(hm.shingle_sets(texts[2:3])[0])
    registers = numbers.integers(1, 1 << 16, (len(texts), hm.REGISTERS)).astype("<u2")
    registers[:, : hm.BAND] = 7
    registers[2] = registers[1]
    registers[2, hm.BAND :: hm.BAND] ^= 1
    made = spark.createDataFrame([(k, r.tobytes()) for k, r in enumerate(registers)], "doc_id long, made binary")
    real = hm.sketches
    monkeypatch.setattr(hm, "sketches", lambda d: real(d).join(made, "doc_id").select("doc_id", "n_shingles", "node", made["made"].alias("small"), "large"))
    monkeypatch.setattr(hm._bucket_pairs, "__defaults__", (5, 2))
    rows = [*enumerate(texts)]
    assert got_of(hm.near_duplicates(docs(rows))) == brute(rows)


def test_nulls_repeats_and_empty_tables(docs):
    text = "a b c d e f g h i j"
    rows = [(5, text), (5, text), (3, text + " "), (None, text), (None, "only without an id here"), (7, None), (8, ""), (8, "")]
    got = Counter((r.doc_id, r.component_id, r.kept) for r in hm.near_duplicates(docs(rows)).collect())
    assert got == Counter([(5, 3, False), (5, 3, False), (3, 3, True), (None, 3, True), (None, None, True), (7, 7, True), (8, 8, True), (8, 8, True)])
    assert hm.near_duplicates(docs([])).count() == 0
    kept = by_id(hm.deduplicate(docs(rows)))
    assert Counter(r.doc_id for r in kept) == Counter([3, 7, 8, None, None])


def test_rows_that_share_a_doc_id_are_kept_by_their_own_text(docs):
    one, two = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(1, one), (5, one), (5, two), (5, two), (6, None)]
    assert sorted((r.doc_id, r.text) for r in hm.deduplicate(docs(rows)).where("text is not null").collect()) == [(1, one), (5, two)]
    assert hm.deduplicate(docs(rows)).count() == 3


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(2)
    for n, form in ((40, hm.repeated), (200, hm.repeated), (600, hm.bucketed), (5000, hm.bucketed)):
        pool = np.unique(rng.integers(0, 1 << 64, 2 * n, dtype=np.uint64))
        one, two = np.sort(pool[:n]), np.sort(pool[n // 4 : n + n // 4])
        truth = len(np.intersect1d(one, two)) / len(np.union1d(one, two))
        assert abs(hm.estimate(form(one), form(two), n, n, form.__name__) - truth) < 0.12
        far = np.sort(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        assert abs(hm.estimate(form(one), form(far), n, n, form.__name__)) < 0.03


def test_components_of_a_long_chain(spark):
    n = 200
    edges = spark.createDataFrame([(k, k + 1) for k in random.Random(1).sample(range(n), n)] + [(1000, 1001), (1000, 1001), (7, 7)], "a long, b long")
    got = dict(map(tuple, hm.components(edges).collect()))
    assert got == {**{k: 0 for k in range(n + 1)}, 1000: 1000, 1001: 1000}


def test_query_matches_brute_force_and_oracle(spark, tiny, duck):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    got = queries.queries()["op8_hyper_minhash"](spark, tiny)
    assert got_of(got) == brute(rows)
    assert rows_of(got) == oracle_rows(duck, hm.SQL)


def test_word_hashes_of_stretches_and_long_words(monkeypatch):
    from cairn.llm import hashing

    texts = ["a bc " * 50 + "x" * 300, "", "bc", "y" * 299 + " " + "x" * 300 + " a"]
    data, _ = hashing.join_texts([t.encode() for t in texts])
    starts, ends = hashing.space_words(data)
    whole = hashing.word_hashes(data, starts, ends)
    monkeypatch.setattr(hashing, "STRETCH", 16)
    assert (hashing.word_hashes(data, starts, ends) == whole).all()
    monkeypatch.setattr(hashing, "LONG", 100)
    cut = hashing.word_hashes(data, starts, ends)
    words = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    assert len(set(cut.tolist())) == len(set(words)) and all((x == y) == (len(w) <= 100) for x, y, w in zip(cut, whole, words, strict=True))
