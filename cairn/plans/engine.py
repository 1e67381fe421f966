"""The engine's statement API over a Spark session."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.udtf import UserDefinedTableFunction

from ..functions import dialect
from ..functions.dialect import DialectError, UnsupportedFeature
from ..operators import compose

#: Statements that Spark has nothing for, by their first words.
_UNSUPPORTED = {
    ("BEGIN",): "transactions", ("START", "TRANSACTION"): "transactions", ("COMMIT",): "transactions", ("ROLLBACK",): "transactions",
    ("CREATE", "SEQUENCE"): "sequences", ("CREATE", "INDEX"): "indexes on Parquet tables", ("CREATE", "UNIQUE", "INDEX"): "indexes on Parquet tables",
}
_MARKER = re.compile(r"\$(\d+)")


class Engine:
    """Runs statements of the dialect; prepared statements belong to the engine object."""

    def __init__(self, spark: SparkSession, strict: bool = False):
        self.spark = spark
        self.strict = strict
        self.prepared: dict[str, str] = {}

    # --- statements

    def sql(self, text: str, args: Sequence | Mapping | None = None) -> DataFrame:
        """One statement; queries come back lazy, commands run at once."""
        return self._plan(text)(args)

    def execute_batch(self, text: str) -> list[DataFrame]:
        """Several statements in order. All are checked and parsed before the first one runs."""
        plans = [self._plan(s) for s in dialect.split_statements(text)]
        return [run(None) for run in plans]

    def explain(self, text: str, mode: str = "formatted") -> str:
        """The plan of a query as text."""
        df = self.sql(text)
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    def prepare(self, name: str, text: str) -> None:
        """Names a statement with markers $1, $2, ... or ?."""
        if name in self.prepared:
            raise DialectError(f"prepared statement {name} exists")
        self._parse(self._named_markers(dialect.to_spark(text)))
        self.prepared[name] = text

    def execute(self, name: str, *values) -> DataFrame:
        if name not in self.prepared:
            raise DialectError(f"no prepared statement {name}")
        return self.sql(self.prepared[name], list(values))

    def deallocate(self, name: str | None = None) -> None:
        if name is None:
            self.prepared.clear()
        elif self.prepared.pop(name, None) is None:
            raise DialectError(f"no prepared statement {name}")

    def create_function(self, name: str, f: Callable, returns: str | None = None) -> None:
        """Names a Python function for this session's statements: a plain one, a pandas UDF (scalar or aggregate), or a table function made by ``udtf``.

        SQL functions are made by CREATE FUNCTION, and are the better choice where they can say the same: Catalyst sees into them.
        """
        if isinstance(f, UserDefinedTableFunction):
            self.spark.udtf.register(name, f)
        else:
            self.spark.udf.register(name, f, returns)

    def table(self, name: str) -> DataFrame:
        """A table or view; the default schema is the current database."""
        return self.spark.table(name.removeprefix("main."))

    # --- planning

    def _plan(self, text: str) -> Callable[[Sequence | Mapping | None], DataFrame]:
        tokens = dialect.words(text)
        first = [t.word for t in tokens[:3]]
        for start, what in _UNSUPPORTED.items():
            if tuple(first[: len(start)]) == start:
                raise UnsupportedFeature(what)
        if self.strict:
            dialect.check_strict(text)
        special = {"UPDATE": self._update, "DELETE": self._delete, "PREPARE": self._prepare, "EXECUTE": self._execute, "DEALLOCATE": self._deallocate, "COPY": self._copy}
        if first and first[0] in special and first[:2] != ["EXECUTE", "IMMEDIATE"]:
            return special[first[0]](text, tokens)
        spark_text = dialect.to_spark(text)
        marked = self._named_markers(spark_text)
        self._parse(marked)

        def run(args):
            if args is None:
                return self.spark.sql(spark_text)
            if isinstance(args, Mapping):
                return self.spark.sql(spark_text, args=dict(args))
            return self.spark.sql(marked, args={f"p{k}": v for k, v in enumerate(args, 1)})

        return run

    def _parse(self, text: str) -> None:
        """Raises ParseException without running or resolving anything."""
        self.spark._jsparkSession.sessionState().sqlParser().parsePlan(text)

    @staticmethod
    def _named_markers(text: str) -> str:
        out, k = [], 0
        for t in dialect.tokenize(text):
            if t.kind == "param" and t.text == "?":
                k += 1
                out.append(f":p{k}")
            else:
                out.append(_MARKER.sub(r":p\1", t.text) if t.kind == "param" else t.text)
        return "".join(out)

    def _empty(self) -> DataFrame:
        return self.spark.range(0).select(F.lit("").alias("result"))

    def _update(self, text: str, tokens) -> Callable:
        body = dialect.to_spark(text)
        m = re.fullmatch(r"\s*UPDATE\s+([\w.`]+)\s+SET\s+(.*)", body, re.I | re.S)
        if not m:
            raise DialectError("UPDATE table SET column = expression, ... [WHERE ...]")
        table, (assigned, where) = m[1], _split_where(m[2])
        assignments = {}
        for item in dialect._split_list(dialect.tokenize(assigned)):
            name, eq, value = item.partition("=")
            if not eq:
                raise DialectError(f"not an assignment: {item}")
            assignments[name.strip().strip("`")] = value.strip()

        def run(_):
            df = self.spark.table(table)
            rows = compose.updated(df, {k: F.expr(v) for k, v in assignments.items()}, F.expr(where) if where else None)
            compose.rewrite_table(self.spark, table, rows)
            return self._empty()

        return run

    def _delete(self, text: str, tokens) -> Callable:
        m = re.fullmatch(r"\s*DELETE\s+FROM\s+([\w.`]+)\s*(.*)", dialect.to_spark(text), re.I | re.S)
        if not m:
            raise DialectError("DELETE FROM table [WHERE ...]")
        table, (rest, where) = m[1], _split_where(m[2])
        if rest.strip():
            raise DialectError(f"unexpected {rest.strip()}")

        def run(_):
            compose.rewrite_table(self.spark, table, compose.remaining(self.spark.table(table), F.expr(where) if where else None))
            return self._empty()

        return run

    def _prepare(self, text: str, tokens) -> Callable:
        m = re.fullmatch(r"\s*PREPARE\s+(\w+)(?:\s*\([^)]*\))?\s+AS\s+(.*)", text, re.I | re.S)
        if not m:
            raise DialectError("PREPARE name AS statement")

        def run(_):
            self.prepare(m[1], m[2])
            return self._empty()

        return run

    def _execute(self, text: str, tokens) -> Callable:
        m = re.fullmatch(r"\s*EXECUTE\s+(\w+)\s*(?:\((.*)\))?\s*", text, re.I | re.S)
        if not m:
            raise DialectError("EXECUTE name (value, ...)")
        values = [v for v in dialect._split_list(dialect.tokenize(m[2] or "")) if v]

        def run(_):
            row = self.spark.sql(f"SELECT {', '.join(values)}").first() if values else ()
            return self.execute(m[1], *row)

        return run

    def _deallocate(self, text: str, tokens) -> Callable:
        names = [t.text for t in tokens[1:] if t.word not in ("PREPARE",)]
        if len(names) != 1:
            raise DialectError("DEALLOCATE name or ALL")

        def run(_):
            self.deallocate(None if names[0].upper() == "ALL" else names[0])
            return self._empty()

        return run

    def _copy(self, text: str, tokens) -> Callable:
        m = re.fullmatch(r"\s*COPY\s+([\w.]+|\(.*\))\s+(TO|FROM)\s+'([^']+)'\s*(?:\(\s*FORMAT\s+(\w+)\s*\))?\s*", text, re.I | re.S)
        if not m:
            raise DialectError("COPY table|(query) TO 'path' or COPY table FROM 'path' [(FORMAT name)]")
        source, way, path, kind = m[1], m[2].upper(), m[3], (m[4] or "parquet").lower()
        options = {"header": "true"} if kind == "csv" else {}

        def run(_):
            if way == "TO":
                df = self.sql(source[1:-1]) if source[0] == "(" else self.table(source)
                df.write.format(kind).options(**options).save(path)
            else:
                into = self.table(source)
                self.spark.read.schema(into.schema).format(kind).options(**options).load(path).write.insertInto(source.removeprefix("main."))
            return self._empty()

        return run


def _split_where(text: str) -> tuple[str, str | None]:
    tokens = dialect.tokenize(text)
    place = dialect._top_level(tokens).get("WHERE")
    if place is None:
        return text, None
    return "".join(t.text for t in tokens[:place]), "".join(t.text for t in tokens[place + 1 :])
