import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import cross_parse as cp
from cairn.llm import queries

from .conftest import by_id


def phrases(text, sample):
    n = i = 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in sample:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


TEXT = st.text("abcé ", min_size=1, max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT.filter(str.strip), min_size=1, max_size=3), st.lists(st.text("abcéz ", max_size=40), max_size=5))
def test_phrases_match_brute_force(samples, texts):
    langs = cp.Languages({f"l{k}": [s] for k, s in enumerate(samples)})
    codes = [cp.letters_of(t) for t in texts]
    got = langs.phrases(codes)
    for row, s in enumerate(samples):
        whole = "".join(map(chr, cp.letters_of(s))) + " "
        assert got[row].tolist() == [phrases("".join(map(chr, c)), whole) for c in codes]


def test_automaton_accepts_exactly_the_substrings():
    text = "abcbcabca"
    table = cp.suffix_automaton(np.array([ord(c) - 96 for c in text]), 5)

    def accepts(s):
        state = 0
        for c in s:
            state = table[state, ord(c) - 96]
            if state < 0:
                return False
        return True

    for n in range(1, 5):
        for k in range(4**n):
            s = "".join("abcd"[k // 4**j % 4] for j in range(n))
            assert accepts(s) == (s in text)


def test_normalised_text():
    assert "".join(map(chr, cp.letters_of("Été, 12 ÀB--c!"))) == "été àb c "


def test_held_out_accuracy(spark, tiny):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = queries.queries()["op9_cross_parse"](spark, tiny).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert sum(held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_cases(docs):
    train = [(k, f"the house of the river and the {w} tree", ("en",)) for k, w in enumerate(["old", "new", "red"] * 4)] + [(k + 100, f"das haus und der fluss mit dem {w} baum", ("de",)) for k, w in enumerate(["alt", "neu"] * 4)]
    rows = [*train, (500, None, ("en",)), (501, "", ("en",)), (502, "12 !? 3", ("en",)), (None, "the river", (None,)), (503, "der fluss " * 50_000, (None,)), (504, "der fluss", ("xx",) if zlib.crc32(b"504") % 4 == 2 else (None,))]
    table = docs(rows)
    got = cp.identify(table, cp.learn(table)).collect()
    found = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert found[500] == found[501] == found[502] == ("und", 0.0)
    assert found[None][0] == "en" and found[503][0] == found[504][0] == "de"
    assert not [r for r in got if r.doc_id is None][0].held_out and len(got) == len(rows)
    empty = docs([])
    assert cp.identify(empty, cp.learn(empty)).count() == 0
    untaught = docs([(1, "words", (None,))])
    assert [(r.lang_pred, r.score) for r in cp.identify(untaught, cp.learn(untaught)).collect()] == [("und", 0.0)]
    assert by_id(cp.identify(table, cp.learn(table), ["doc_id", "score", "kept"]))[0].kept == "no"


def test_samples_are_shared_evenly_and_not_openings(docs):
    assert cp.even_share([10, 5, 100, 100], 75) == 30 and cp.even_share([3, 4], 60) == 4 and cp.even_share([50], 20) == 20
    letters = "abcdefghijklmnopqrstuv"
    trained = [k for k in range(60) if zlib.crc32(str(k).encode()) % 4 != 2][: len(letters)]
    # the same opening, longer than a share, in each; then a letter of its own
    rows = [(k, "1 2 3 " * 500 + "zy " * 100 + f"{c} " * 3000, ("en",)) for k, c in zip(trained, letters, strict=True)]
    learned = cp.learn(docs(rows), slots=4096, most_chars=2000)
    found = set(map(chr, learned.alphabet)) & set(letters)
    assert len(found) >= len(letters) - 4
    few = cp.learn(docs([(k, "abc def", ("en",)) for k in trained[:3]]))
    assert set(map(chr, few.alphabet)) == set("abcdef ")


def test_learning_ignores_held_out_rows(docs):
    rows = [(k, "abc abc abc" if zlib.crc32(str(k).encode()) % 4 != 2 else "xyz xyz", ("en",)) for k in range(200)]
    assert set(map(chr, cp.learn(docs(rows)).alphabet)) == set("abc ")


def test_double_array_holds_exactly_the_transitions():
    rng = np.random.default_rng(5)
    for states, width in ((1, 2), (60, 5), (400, 30), (3, 5000)):
        pairs = np.unique(rng.integers(0, [states, width - 1], (states * 3, 2)) + [0, 1], axis=0)
        to = rng.integers(0, states, len(pairs))
        cells, base = cp.double_array(pairs[:, 0], pairs[:, 1], to, states, width)
        assert len(np.unique(base)) == states and len(cells) < 8 * (len(pairs) + states) + 4 * width
        known = {(s, c): t for (s, c), t in zip(pairs.tolist(), to.tolist(), strict=True)}
        for s in range(states):
            at = cells[base[s] + np.arange(width)]
            got = {c: int(at[c] & 0xFFFFFFFF) for c in np.flatnonzero(at >> 32 == base[s]).tolist()}
            assert got == {c: base[t] for (x, c), t in known.items() if x == s}


def test_all_languages_share_a_bound(docs, monkeypatch):
    rows = [(k, f"{chr(97 + k % 20) * 3} word{chr(97 + k % 20)} text " * 30, (f"l{k % 20:02}",)) for k in range(400)]
    learned = cp.learn(docs(rows), all_chars=2000)
    assert learned.names == [f"l{k:02}" for k in range(20)] and 2.0 ** max(learned.cost) <= 101
    few = cp.common.slot_sample(docs(rows).select("doc_id", "lang"), 8, by=["lang"], groups=5)
    counts = Counter(r.lang for r in few.collect())
    every = Counter(r.lang for r in cp.common.slot_sample(docs(rows).select("doc_id", "lang"), 8, by=["lang"]).collect())
    assert counts == dict(sorted(every.items(), key=lambda x: (-x[1], x[0]))[:5]) and len(every) == 20
    wide = cp.Languages({"x": ["".join(chr(0x4E00 + k * 7 % 3000) for k in range(6000))]})
    assert wide.cells.nbytes < 100 * 6000 + 16 * 3000
