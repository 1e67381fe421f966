from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.llm import host_rules, queries

from ..conftest import oracle_rows, rows_of
from .conftest import by_id


def brute(text):
    w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if x]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    n = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {j for k in range(len(w) - 2) if n[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_query_matches_oracle(spark, tiny, duck):
    name = "op4_host_rules"
    assert rows_of(queries.queries()[name](spark, tiny)) == oracle_rows(duck, queries.oracle_sql()[name])


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "ab", "é", " ", "\n", "\t", "#", "<", "\xa0", "\x1c", "　"]), max_size=40).map("".join), min_size=1, max_size=12))
def test_measures_match_brute_force(spark, texts):
    df = spark.createDataFrame([*enumerate([*texts, None, ""])], "doc_id long, text string")
    got = host_rules.measures(df, ["doc_id"]).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in got] == [brute(t) for t in [*texts, None, ""]]


def test_shrinkage_spares_small_hosts_and_fails_bad_ones(docs):
    good = " ".join(f"word{k}" for k in range(60))
    rows = [(k, good, (None, "fine")) for k in range(60)]
    rows += [(100 + k, "bad " * 3, (None, "awful")) for k in range(200)] + [(300, good, (None, "awful"))]
    rows += [(400, "short", (None, "tiny")), (401, good, (None, None)), (402, None, (None, None)), (None, good, (None, "fine")), (401, good, (None, None))]
    for limit in (100, 0):
        got = by_id(host_rules.judge(docs(rows), broadcast_hosts=limit))
        assert len(got) == len(rows)
        kept = [r.doc_id for r in got if r.kept]
        assert sorted(k for k in kept if k is not None) == [*range(60), 401, 401] and kept.count(None) == 1
        assert not [r for r in got if r.doc_id == 300][0].base_failed
    assert host_rules.judge(docs([])).count() == 0


def test_long_text_and_plan_without_python(spark, docs):
    long = " ".join(f"w{k}" for k in range(200_000)) + " x y z x y z"
    got = host_rules.judge(docs([(1, long)])).collect()[0]
    assert (got.n_words, got.n_repeat_words, got.kept) == (200_006, 6, True)
    text = host_rules.measures(docs([(1, "a")]), ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert not any(x in text for x in ("Python", "Pandas", "InArrow"))


def test_host_rate(spark):
    df = spark.createDataFrame([("a", True), ("a", True), ("b", False), (None, False)], "_host string, _failed boolean")
    got = {r["_host"]: r for r in host_rules.host_verdicts(df, "_host").collect()}
    m, v = 1 / 3, 1 / 3
    k = max(m * (1 - m) / v - 1, 1)
    assert abs(got["a"].host_rate - (2 + m * k) / (2 + k)) < 1e-12 and not got[None].host_failed


def test_runs_of_white_space_and_symbols_take_linear_time(spark):
    for run, n_words, n_lines in ((" ", 2, 1), ("\t", 2, 1), ("\n", 2, 2), (" \n", 2, 2), ("#", 1, 1), ("\r ", 2, 1)):
        text = "x" + run * 1_000_000 + "y"
        got = host_rules.measures(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"]).collect()[0]
        assert (got.n_words, got.n_lines, got.n_dup_lines, got.n_symbols) == (n_words, n_lines, 0, 1_000_000 * (run == "#"))


def test_a_host_fails_for_being_worse_than_its_kind(spark):
    """Nine hosts with rates about 0.1 to 0.2 and one with 0.5: that one goes, unless it has too few documents to tell."""

    def hosts(size):
        rows = [(f"h{k}", j < size * (0.1 + 0.1 * (k % 3) / 2)) for k in range(9) for j in range(size)]
        return spark.createDataFrame([*rows, *(("bad", j < size // 2) for j in range(size))], "_host string, _failed boolean")

    def failing(df):
        return {r["_host"] for r in host_rules.host_verdicts(df, "_host").collect() if r.host_failed}

    assert failing(hosts(200)) == {"bad"} and failing(hosts(10)) == set()
    alike = spark.createDataFrame([(f"h{k}", j < 70 + k % 3) for k in range(9) for j in range(100)], "_host string, _failed boolean")
    assert failing(alike) == set()
