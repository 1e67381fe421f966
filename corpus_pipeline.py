"""Corpus pipeline over documents: language, near duplicates, benchmark leaks, personal data, packing.

Each stage works on all that its predecessor kept, and its decisions take effect: documents without
letters go (any other has the best of the learned languages), one document of each near-duplicate group stays, contaminated documents go and single leaked
passages are cut out, personal data is replaced by its kind, and what remains is packed. Stages carry the
columns of ``documents`` only; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import common, cross_parse, hyper_minhash, skip_chain, sum_squares, wu_manber

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are given a learned language; null texts and texts without letters go, and all do if nothing was learned."""
    docs = common.pick(docs, *COLUMNS)
    found = cross_parse.identify(docs, cross_parse.learn(docs), list(COLUMNS))
    return found.where(found["lang_pred"] != cross_parse.UNKNOWN).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return hyper_minhash.deduplicate(common.pick(docs, *COLUMNS))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated, without the benchmark passages in them."""
    return wu_manber.remove_leaks(common.pick(docs, *COLUMNS), common.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced."""
    docs = common.pick(docs, *COLUMNS)
    return skip_chain.redact(docs, skip_chain.trained(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return sum_squares.pack(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Language models, sketches and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
