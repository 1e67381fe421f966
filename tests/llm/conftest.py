import pytest


@pytest.fixture(scope="session")
def table(spark, tmp_path_factory):
    """Writes rows as Parquet and reads them, as the pipeline and the queries get theirs."""

    def make(rows, schema):
        path = str(tmp_path_factory.mktemp("t") / "x")
        spark.createDataFrame(rows, schema).repartition(2).write.parquet(path)
        return spark.read.parquet(path)

    return make


#: An input with columns that clash with those that operators make.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words int, kept string, node string, spans int, score string, piece string"


@pytest.fixture(scope="session")
def docs(table):
    def make(rows):
        full = [(d, t, *(x[0] if x else ()), *[None] * (3 - len(x[0] if x else ())), 7, "no", "n", 3, "s", "p") for d, t, *x in rows]
        return table(full, DOCS)

    return make


def by_id(df, key="doc_id"):
    return sorted(df.collect(), key=lambda r: (r[key] is None, r[key] or 0, str(r)))
