import re

from cairn.llm import common, cross_parse, hyper_minhash, skip_chain, sum_squares, wu_manber

from .test_hyper_minhash import brute as components
from .test_packing import check_pieces
from .test_skip_chain import brute as personal
from .test_wu_manber import brute as leaks


def test_stages_against_brute_force(spark, tiny):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["language", "near_duplicates", "benchmark_leaks", "personal_data", "packing"]
    docs = common.table(spark, tiny, "documents")
    items = [(r.item_id, r.text) for r in common.table(spark, tiny, "benchmark").collect()]
    outs = [docs]
    for name, stage in cp.STAGES:
        outs.append(common.materialize(stage(spark, outs[-1], tiny), name))
        if name != "packing":
            assert outs[-1].columns == docs.columns
    start, lang, near, clean, private, packed = [d.collect() for d in outs]
    assert {r.doc_id for r in lang} == {r.doc_id for r in start if any(map(str.isalpha, r.text))}
    comp = components([(r.doc_id, r.text) for r in lang])
    assert sorted(r.doc_id for r in near) == sorted(d for d, (_, c) in comp.items() if c == d)
    verdict = {r.doc_id: leaks(r.text, items) for r in near}
    assert {r.doc_id for r in clean} == {d for d, v in verdict.items() if not v[4]}
    before = {r.doc_id: r.text for r in near}
    for r in clean:
        n_words, n_hit = verdict[r.doc_id][:2]
        assert (r.text == before[r.doc_id]) == (n_hit == 0) and leaks(r.text, [])[0] == n_words - n_hit and r.n_chars == len(r.text)
    before = {r.doc_id: r.text for r in clean}
    for r in private:
        spans = personal(before[r.doc_id])
        assert bool(spans) <= (r.text != before[r.doc_id]) and not personal(re.sub("<[A-Z]+>", "\n", r.text))
    used, least = check_pieces(packed, [(r.doc_id, r.text) for r in private], sum_squares.word_ids(), 4096)
    assert used <= 1.03 * least + 2


def test_stages_on_nulls_and_empty_tables(spark, docs, tiny):
    import corpus_pipeline as cp

    rows = [(1, "the text of a page, with a@b.example.com", ("en", "s")), (1, "the text of a page, with a@b.example.com", ("en", "s")), (2, None), (None, "some more of the text"), (3, ""), (4, "12")]
    for table, expected in ((docs(rows), [None, 1]), (docs([]), [])):
        out = table
        for name, stage in cp.STAGES[:-1]:
            out = common.materialize(stage(spark, out, tiny), name)
        assert sorted((r.doc_id for r in out.collect()), key=str) == sorted(expected, key=str)
        assert cp.STAGES[-1][1](spark, out, tiny).count() == len(expected)
    assert cross_parse and hyper_minhash and skip_chain and wu_manber
