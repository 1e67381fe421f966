"""Scalar expressions with pinned semantics, as Column expressions that stay in code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(a: Column, b: Column) -> Column:
    """Division as a double; null for a zero divisor, on which engines disagree otherwise."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def concat_op(*parts: Column) -> Column:
    """`||`: null if any part is null."""
    return F.concat(*parts)


def regexp_matches(text: Column, pattern: Column | str) -> Column:
    """Whether the pattern matches somewhere in the text."""
    return F.regexp_like(text, F.lit(pattern) if isinstance(pattern, str) else pattern)


def similar_to(text: Column, pattern: str) -> Column:
    """SIMILAR TO with a regular expression that must match the whole text."""
    return text.rlike(f"^(?:{pattern})$")


def distinct_from(a: Column, b: Column) -> Column:
    """IS DISTINCT FROM: nulls are equal to each other and to nothing else."""
    return ~a.eqNullSafe(b)


def nullif(a: Column, b: Column) -> Column:
    """Null where both are equal, else the first."""
    return F.when(a == b, F.lit(None)).otherwise(a)


#: Comparison operators with what their negation and their mirror image are.
NEGATED = {"=": "<>", "<>": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}
FLIPPED = {"=": "=", "<>": "<>", "<": ">", ">": "<", "<=": ">=", ">=": "<="}


def compare(op: str, a: Column, b: Column) -> Column:
    """A comparison by its symbol."""
    ops = {"=": a == b, "<>": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}
    if op not in ops:
        raise ValueError(f"unknown operator {op}")
    return ops[op]


def exact_sum(x: Column, scale: int = 2) -> Column:
    """Sum of doubles that hold decimals: exact whatever the order of rows, as a double."""
    return F.sum(x.cast(f"decimal(18,{scale})")).cast("double")


def exact_avg(x: Column, scale: int = 2) -> Column:
    """Mean by the exact sum."""
    return exact_sum(x, scale) / F.count(x)
