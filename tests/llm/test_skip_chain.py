import hashlib
import itertools
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import queries, skip_chain as sc

from .conftest import by_id

BASE = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m[0])) <= 19 and sc.luhn(re.sub("[^0-9]", "", m[0]))),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
)


def brute(text):
    return [(k, *m.span()) for k, (p, ok) in enumerate(BASE) for m in re.finditer(p, text) if ok(m)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "Z9", "1", "22", "255", "256", "@", ".", "-", "+", " ", "(", ")", "%", "é", "\n", "4111 1111 1111 1111", "x@y.z", "+49 30 12345678"]), max_size=25).map("".join))
def test_base_spans_match_brute_force(text):
    assert sc.base_spans(text) == brute(text)


def test_hard_inputs_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 100_000, "1-" * 100_000, "+1" + " " * 200_000):
        sc.base_spans(text)


def test_beliefs_are_exact_on_a_tree():
    rng = np.random.default_rng(1)
    node, edges = rng.normal(size=(4, 3)), [(0, 1, 1.5), (1, 2, 0.3), (1, 3, 2.0)]
    want = np.zeros((4, 3))
    for labels in itertools.product(range(3), repeat=4):
        p = np.exp(sum(node[k, v] for k, v in enumerate(labels)) + sum(w for i, j, w in edges if labels[i] == labels[j]))
        for k, v in enumerate(labels):
            want[k, v] += p
    want /= want.sum(1, keepdims=True)
    assert np.abs(sc.beliefs(node, edges, 60) - want).max() < 1e-6


SAMPLE = ["call +49 30 1234567", "mail a.b@c.example.com or x@y.org", "host 10.1.2.3 up", "card 4111 1111 1111 1111", "room 12 of 300 in 2024", "pi is 3.14159, e 2.71828", "+1 (555) 010-9999 ext"] * 20


def added(text, weights):
    return [text[a:b] for _, a, b in sc.label(text, sc.base_spans(text), weights)]


def test_the_field_finds_repeats_of_sure_entities_only():
    weights = sc.train(SAMPLE)
    text = "Call +49 30 1234567 today. The office is at 030 1234567, room 12, since 2024."
    assert added(text, weights) == ["030 1234567"]
    assert added("The office has 0301234567 parts in room 12 since 2024, at 3.5 each.", weights) == []
    assert added("write to jo.doe99@mail.example.com; jo.doe99 answers", weights) == ["jo.doe99"]
    assert added("no digits at all", weights) == []


def test_without_sample_the_prior_is_o(docs):
    assert added("x 12345678 y", sc.train([])) == []
    assert (sc.trained(docs([])) == sc.train([])).all()


def test_operator_cases(docs):
    rows = [(1, "a@b.cc"), (1, "a@b.cc"), (2, None), (3, ""), (None, "10.0.0.1"), (4, "z " * 100_000 + "+49 30 1234567")]
    got = by_id(sc.find_personal(docs(rows), sc.train(SAMPLE)))
    assert [(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got] == [(1, 1, 0, 0, 0), (1, 1, 0, 0, 0), (2, 0, 0, 0, 0), (3, 0, 0, 0, 0), (4, 0, 0, 0, 1), (None, 0, 1, 0, 0)]
    assert [r.n_spans for r in got] == [1, 1, 0, 0, 1, 1]
    assert got[2].base_sha256 == hashlib.sha256(b"").hexdigest() and got[4].spans == "phone:200000:200014"
    clean = {r.doc_id: r for r in sc.redact(docs(rows), sc.train(SAMPLE)).collect()}
    assert clean[1].text == "<EMAIL>" and clean[1].n_chars == 7 and clean[2].text is None and clean[None].text == "<IP>" and clean[4].kept == "no"
    assert sc.find_personal(docs([]), sc.train([])).count() == 0


def test_query_covers_all_documents(spark, tiny):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = queries.queries()["op7_skip_chain"](spark, tiny).collect()
    assert len(got) == len(texts)
    for r in got:
        base = [f"{sc.KINDS[k]}:{a}:{b}" for k, a, b in brute(texts[r.doc_id])]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= {*r.spans.split(","), ""}


def test_long_runs_of_digits_are_no_address():
    assert sc.base_spans("9" * 5000 + ".1.2.3 and 10.0.0.1") == [(1, 5011, 5019)]
    for part in ("0" * 5000, "0" * 5000 + "255"):
        text = part + ".1.2.3"
        assert (1, 0, len(text)) in sc.base_spans(text)


PARTS = ["+49 30 1234567", "030 1234567", "301234567", "a1.b@x.example.org", "a1.b", "A1.B@x", "10.0.0.7", "10-0-0-7", "4111 1111 1111 1111", "4111.1111.1111.1111", "2024", "x 3.5", "x"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(PARTS), st.sampled_from([" x ", "\n", "; "])), max_size=7))
def test_decisions_match_exact_inference(parts):
    """The field's marginals by enumeration of all labellings lead to the spans that belief propagation finds."""
    text, weights = "".join(p + gap for p, gap in parts), sc.train(SAMPLE)
    base = sc.base_spans(text)
    spans, kind = sc.candidates(text, base)
    if not 0 < len(spans) <= 7:
        assert spans or not sc.label(text, base, weights)
        return
    node, edges = sc.field(text, spans, kind, weights)
    options = [np.flatnonzero(row > -1e8) for row in node]
    exact = np.zeros(node.shape)
    for labels in itertools.product(*options):
        p = np.exp(sum(node[k, v] for k, v in enumerate(labels)) + sum(w for i, j, w in edges.tolist() if labels[int(i)] == labels[int(j)]))
        exact[range(len(labels)), labels] += p
    exact /= exact.sum(1, keepdims=True)
    best = exact[:, 1:].argmax(1)
    assert sc.label(text, base, weights) == [(int(best[k]), *spans[k]) for k in range(len(spans)) if kind[k] < 0 and exact[k, 1 + best[k]] >= sc.LEAST]


def plant(rng, kind, match):
    """Another mention of a base match, made otherwise than in training."""
    digits = "".join(c for c in match if c.isdigit())
    return {
        0: [match.partition("@")[0].upper(), match.partition("@")[0]],
        1: [match.replace(".", "-")],
        2: [digits[:8] + "." + digits[8:], ".".join(digits[k : k + 4] for k in range(0, len(digits), 4))],
        3: [digits[-10:], ".".join((digits[-10:-7], digits[-7:-4], digits[-4:])), f"{digits[-7:-4]}-{digits[-4:]}"],
    }[kind][rng.randrange(3) % (2 if kind in (0, 2) else 1 if kind == 1 else 3)]


def test_planted_variants_are_added_and_their_likes_are_not():
    """In every document with base matches one more mention is planted, and its like with other digits; both are no base matches."""
    import duckdb

    rng, texts = random.Random(4), [t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE regexp_matches(text, '[0-9@]') ORDER BY doc_id").fetchall()]
    weights = sc.train(texts)
    found = planted = wrong = 0
    for text in texts:
        base = sc.base_spans(text)
        if not base:
            continue
        kind, a, b = rng.choice(base)
        variant = plant(rng, kind, text[a:b])
        if not any(map(str.isdigit, variant)):
            continue
        like = "".join(str((int(c) + rng.randrange(1, 10)) % 10) if c.isdigit() else c for c in variant)
        half = len(text) // 2
        whole = f"{text[:half]} zz {like} qq {text[half:]} see {variant} too"
        spans = sc.label(whole, sc.base_spans(whole), weights)
        planted += 1
        found += any(whole[x:y] == variant and k == kind for k, x, y in spans)
        wrong += sum(whole[x:y] != variant for _, x, y in spans)
    assert planted >= 40 and found >= 0.95 * planted and wrong <= 0.05 * planted
    assert weights[sc.FEATURES, 0] > sc.SKIP


def test_examples_grow_with_shapes_and_not_with_text():
    one = sc.examples("call +49 30 1234567 or a.b1@c.example.com")
    many = sc.examples("call +49 30 1234567 or a.b1@c.example.com, 12 of 300 in 2024; " * 500)
    assert len(many) < 10 * len(one) and sum(many.values()) > 100 * sum(one.values()) / 3
    assert sc.missed("10.1.2.3", 1) == "10-1-2-3" and sc.missed("+1 (286) 555-5136", 3) == "286 555-5136" and sc.missed("jo@x.org", 0) == "jo@x"
    assert sc.train(["9" * 5000 + ".1.2.3 a@b.cc"]).shape == (sc.FEATURES + 2, len(sc.LABELS))



def test_base_columns_match_sql(spark, tiny, duck):
    from ..conftest import oracle_rows, rows_of

    name = "personal_data_base"
    assert rows_of(queries.queries()[name](spark, tiny)) == oracle_rows(duck, queries.oracle_sql()[name])


def test_sql_of_base_columns_on_odd_texts():
    import duckdb

    texts = ["é a@b.cc x@y", "0000255.1.2.3 256.1.1.1 1.2.3.4.5.6.7.8", "4111 1111 1111 1111 4111-1111-1111-1112", "+49 30 1234567 +1 +(5) 1234567", "日本 +1 (286) 555-5136. 1.1.1.1", "9" * 5000 + ".1.2.3", "", "a.b+c%d@e-f.g-h.ij@k.l"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [*enumerate(texts), (99, None)])
    got = {r[0]: r[1:] for r in con.sql(f"SELECT doc_id, n_email, n_ip, n_card, n_phone, base_sha256 FROM ({sc.BASE_SQL})").fetchall()}
    for k, text in [*enumerate(texts), (99, "")]:
        base = sc.base_spans(text)
        digest = hashlib.sha256(",".join(f"{sc.KINDS[c]}:{a}:{b}" for c, a, b in base).encode()).hexdigest()
        assert got[k] == (*(sum(c == x for c, _, _ in base) for x in range(4)), digest), text[:40]


def test_the_graph_has_all_tokens():
    """Documents without base matches, and tokens that no base match is similar to, are decided by the field too."""
    text = "call 030 1234567 at 10:30; 030-1234567 or x7@home, x7"
    spans, kind = sc.candidates(text, [])
    assert [text[a:b] for a, b in spans] == ["030 1234567", "10", "30", "030-1234567", "x7@home", "x7"] and kind.tolist() == [-1] * 6
    assert sc.links(text, spans, kind >= 0).tolist() == [[0, 3], [4, 5]]
    # evidence of shape alone: a plus
    weights = sc.train([])
    weights[32, 4] = 9.0
    assert added("x 2024 y +12345678 z", weights) == [] and sc.base_spans("x +12345678 y") != []
    assert added("x +1234567 y +1234567.", weights) == ["+1234567", "+1234567"]
    # and of a neighbour in the chain, over another token
    weights = sc.train([])
    weights[sc.FEATURES + 1] = 12.0
    assert added("+49 30 1234567\t030 7654321\t5557654", weights) == ["030 7654321", "5557654"]
    assert added("+49 30 1234567 x\t030 7654321\t5557654", weights) == []


def test_sure_neighbours_and_stretches_of_edges_change_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    node = rng.normal(size=(9, 3))
    node[[0, 4, 7], 1:] = sc.NEVER
    edges = [(i, i + 1, float(w)) for i, w in enumerate(rng.normal(size=8))]
    exact = np.zeros((9, 3))
    for labels in itertools.product(range(3), repeat=9):
        p = np.exp(sum(node[k, v] for k, v in enumerate(labels)) + sum(w for i, j, w in edges if labels[i] == labels[j]))
        exact[range(9), labels] += p
    assert np.abs(sc.beliefs(node, edges, 60) - exact / exact.sum(1, keepdims=True)).max() < 1e-6
    whole = sc.beliefs(node, edges, 5)
    monkeypatch.setattr(sc, "EDGES_AT_ONCE", 2)
    assert np.abs(sc.beliefs(node, edges, 5) - whole).max() < 1e-12
