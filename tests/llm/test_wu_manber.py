import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import queries, wu_manber as wm

from ..conftest import oracle_rows, rows_of
from .conftest import by_id

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=8):
    w, hit, own = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        for k in range(max(1, len(iw) - window + 1) if iw else 0):
            p = iw[k : k + window]
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    own.add(item)
    return len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest(), len(own) >= 2


def scored(texts, items, window=8):
    table = wm.Windows(items, window)
    data, place = wm.fold(texts)
    found = table.find(data, place)
    return [sorted({(a, b, i) for a, b, s in found.get(k, []) for i in s}) for k in range(len(texts))]


ALPHABET = st.lists(st.sampled_from(["a", "B", "é", "9", " ", "  ", ",", "\n", "ab", "_"]), max_size=30).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(ALPHABET, min_size=1, max_size=4), st.lists(st.tuples(st.integers(1, 3), ALPHABET), max_size=4))
def test_search_matches_brute_force(texts, items):
    for text, found in zip(texts, scored(texts, items, 3), strict=True):
        n, n_hit, n_items, _, _ = brute(text, items, 3)
        assert (len({w for a, b, _ in found for w in range(a, b)}), len({i for _, _, i in found})) == (n_hit, n_items)


def test_query_matches_oracle(spark, tiny, duck):
    name = "op3_wu_manber"
    assert rows_of(queries.queries()[name](spark, tiny)) == oracle_rows(duck, queries.oracle_sql()[name])


def test_blocks_nulls_ties_and_clashing_columns(docs, table):
    long = " ".join(f"w{k}" for k in range(40))
    items = [(1, long), (2, long), (2, long), (3, "tiny item"), (None, long), (4, None), (5, ""), (6, " ".join(f"v{k}" for k in range(12)))]
    benchmark = table(items, "item_id long, text string")
    filler = "noise, " * 50_000
    rows = [(1, filler + long.upper() + "! end"), (2, "tiny-ITEM"), (3, None), (4, ""), (None, "v0 v1 v2 v3 v4 v5 v6 v7 tiny item"), (5, "clean text"), (5, "clean text"), (6, "xtiny item, tiny itemx")]
    real = [(i, t) for i, t in items if i is not None]
    for limit, steps in ((1, 2), (1, 100), (1 << 20, 4)):
        got = by_id(wm.decontaminate(docs(rows), benchmark, table_bytes=limit, steps=steps))
        want = sorted([(d, *brute(t, real)) for d, t, *_ in rows], key=lambda r: (r[0] is None, r[0] or 0, str(r)))
        assert [tuple(r)[:6] for r in got] == want
    assert wm.decontaminate(docs([]), benchmark).count() == 0
    assert [r.n_items for r in wm.decontaminate(docs([(1, "tiny item")]), table([], "item_id long, text string")).collect()] == [0]


def test_removal_cuts_single_leaks_and_drops_contaminated(docs, table):
    benchmark = table([(1, "one two three four five six seven eight nine"), (2, "alpha beta gamma delta epsilon zeta eta theta")], "item_id long, text string")
    one, two = "One two; three four five six seven eight nine", "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(1, f"Before {one} after."), (2, f"{one} {two}"), (3, "clean"), (4, None)]
    got = {r.doc_id: (r.text, r.n_chars) for r in wm.remove_leaks(docs(rows), benchmark).collect()}
    assert got == {1: ("Before  after.", 14), 3: ("clean", None), 4: (None, None)}


def test_windows_keep_little_beside_their_text():
    """Shared and repeated windows are kept once, with all their items; a block takes about a dozen times its text."""
    shared = " ".join(f"s{k}" for k in range(12))
    items = [(k, f"a{k} {shared} b{k} " + " ".join(f"w{k}x{j}" for j in range(150))) for k in range(1000)] + [(7, shared)]
    made = wm.Windows(items)
    assert made.owners(next(p for p in range(len(made.owned) - 1) if len(made.owners(p)) > 1)) == set(range(1000))
    size = sum(a.nbytes for t in made.tables for a in (t.starts, t.sizes, t.numbers, t.which, t.suffix, t.shift)) + made.owner.nbytes + made.owned.nbytes + made.words.nbytes + len(made.source)
    assert size - sum(t.shift.nbytes for t in made.tables) < 12 * sum(len(t) for _, t in items)
    data, place = wm.fold([f"x {shared} y", "none of it"])
    found = made.find(data, place)
    assert set(found) == {0} and {(a, b) for a, b, _ in found[0]} == {(k, k + 8) for k in range(1, 6)}
