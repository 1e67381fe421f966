import hashlib
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import queries, trigram_index as ti

from ..conftest import oracle_rows, rows_of
from .conftest import by_id

#: The base rules as they are defined, without trigrams or shortcuts.
BRUTE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
)


def brute(text):
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BRUTE) for m in re.finditer(p, text, re.A) if ok(m)]
    return [f"{BRUTE[k][0]}:{a}:{b}" for a, k, b in sorted(found)]


def base_of(text):
    return [f"{ti.RULES[k].kind}:{a}:{b}" for a, k, b in ti.scan([text])[0] if k < 3]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWd", "secret", "toKen", "api_key", "apikey", "AKIA", '"', "'", " ", ":", "=", "abcdef", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRST", "é", "ſ", "K", "\n", "-", "x"]), max_size=25).map("".join))
def test_base_spans_match_brute_force(text):
    assert base_of(text) == brute(text)


def test_queries_are_derived_and_necessary():
    plans = {r.kind: ti.trigram_query(r) for r in ti.RULES}
    assert plans["hex"] is True and plans["access"] == ("and", (b"aki", b"kia"))
    assert ("and", (b"ken", b"oke", b"tok")) in plans["assign"][1]
    assert ti.trigram_query(ti.Rule("x", "ab?cde|xyz+"))[0] == "or"
    assert ti.trigram_query(ti.Rule("x", "(foo|bar)+[0-9]")) == ("or", (b"bar", b"foo"))
    assert ti.trigram_query(ti.Rule("x", "(abc)?[0-9]")) is True and ti.trigram_query(ti.Rule("x", "a.c")) is True


def test_extra_kinds_add_spans_and_clean_prose_has_none(docs):
    rows = [(1, "key AIza" + "Z" * 35 + " and -----BEGIN RSA PRIVATE KEY-----"), (2, "The token of the secret garden was a password to nothing."), (3, None), (4, ""), (None, "token=abcdef"), (1, "token = abcdef"), (1, "token = abcdef")]
    got = by_id(ti.find_secrets(docs(rows)))
    assert len(got) == 7
    spans = {(r.doc_id, r.spans) for r in got}
    assert (1, "google:4:43,private_key:48:79") in spans and (2, "") in spans and (3, "") in spans and (None, "assign:0:12") in spans
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r.base_sha256 == empty for r in got if r.n_assign + r.n_access + r.n_hex == 0)


def test_whole_long_texts_and_empty_tables(docs):
    long = "filler words " * 100_000 + "token=abcdefgh"
    assert by_id(ti.find_secrets(docs([(1, long)])))[0].spans == f"assign:{len(long) - 14}:{len(long)}"
    assert ti.find_secrets(docs([])).count() == 0


def test_query_covers_all_documents(spark, tiny):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = queries.queries()["op2_trigram_index"](spark, tiny).collect()
    assert len(got) == len(texts)
    for r in got:
        base = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in base) for k, _, _ in BRUTE)
        assert set(base) <= set(r.spans.split(",")) or not base


def test_query_matches_oracle(spark, tiny, duck):
    name = "op2_trigram_index"
    assert rows_of(queries.queries()[name](spark, tiny)) == oracle_rows(duck, queries.oracle_sql()[name])


def test_sql_finds_the_spans_of_all_kinds():
    import duckdb

    parts = [
        "é token=abcdef1 token='x' PassWord: \"zz12345\"", "API_KEY=token=secret=abc", "AKIA" + "Z" * 16, "deadbeef" * 4, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20, "xoxb-0123456789-ab",
        "AIza" + "q" * 35, "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12, "xeyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12, "https://user:pass.word@host", "日本 tſken=abcdefgh to\u212aen=abcdefgh",
    ]
    texts = [*parts, " ".join(parts), "\n".join(parts * 3), "".join(parts), ""]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [*enumerate(texts), (99, None)])
    got = {d: spans for d, spans in con.sql(f"SELECT doc_id, spans FROM ({ti.SQL})").fetchall()}
    want = {k: ",".join(f"{ti.RULES[r].kind}:{a}:{b}" for a, r, b in spans) for k, spans in enumerate(ti.scan(texts))}
    assert got == want | {99: ""} and len({s.partition(":")[0] for w in want.values() for s in w.split(",") if s}) == len(ti.RULES)


def test_hard_inputs_take_linear_time():
    hard = ["eyJ" * 300_000 + ".eyJ", "eyJaaaaaaaaaaaa." * 60_000, ".eyJ" * 300_000, "token " * 200_000 + "=", "password" + " " * 1_000_000, "-----BEGIN " * 90_000, "AKIA" * 250_000, "a" * 1_000_000, "://a" * 250_000, "ghp_" * 250_000, "xoxb-" * 200_000 + "@"]
    begun = time.perf_counter()
    for text in hard:
        ti.scan([text])
    assert time.perf_counter() - begun < 30
