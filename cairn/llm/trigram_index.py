"""Secret scan with a trigram inverted index.

Each rule's regex is turned into a Boolean query over trigrams that any match must contain. Every
block of texts gets an inverted index, trigram -> texts, of the trigrams that some rule asks for;
a rule's postings are intersected and united as its query says, and only the texts that remain are
verified by the regex itself. No rule tries a place of a text more often than a constant, so a scan is
linear in the text. A rule from which no mandatory trigram follows (such as a bare run of
hex digits) scans every text. Index and texts stay in the task, so nothing is shuffled.

Spans are code points of the whole text, end exclusive; matches of a rule are leftmost and don't
overlap; those that fail the rule's condition are dropped without another try.

Defined cases: null and empty texts have no spans; null doc_id is kept; repeated rows are scanned
each; an empty table gives no rows; other columns are ignored or kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from re import _constants as C
from re import _parser as parser

from . import common, hashing


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its regex (ASCII classes and case), and what a match must satisfy to count."""

    kind: str
    pattern: str
    ignore_case: bool = False
    holds: Callable[[re.Match], bool] = lambda m: True

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


#: The base rules in their order, then the rules of well-known credential formats.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?((?-i:[A-Za-z0-9+/_.=-]+))""", True, lambda m: len(m[2]) >= 6),
    Rule("access", r"AKIA[A-Z0-9]+", holds=lambda m: len(m[0]) >= 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
EXTRA = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"),
    Rule("url_password", r"://[A-Za-z0-9._~-]{1,64}:[A-Za-z0-9._~!$&*+=-]{3,64}@"),
)
RULES = BASE + EXTRA

# A query is True (any text may match), or ("and"|"or", parts) over trigrams and queries.


def _both(op: str, parts: list) -> object:
    whole = op == "and"
    if not whole and True in parts:
        return True
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else (op, tuple(parts))


def _of_strings(strings: set[str]) -> object:
    """The trigrams of each string; a string that asks for more than another is left out."""
    sets = [frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings]
    least = {t for t in sets if not any(u < t for u in sets)}
    return _both("or", [_both("and", sorted(t)) for t in sorted(least, key=sorted)])


def _plan(tree, most: int = 64) -> tuple[set[str] | None, object]:
    """The exact strings of a parsed regex if they are few (else None), and its query.

    Parts that stand next to each other and have few strings form a run of exact strings, whose
    trigrams are asked for; any other part ends the run and adds its own query.
    """
    run, ended, asked = {""}, False, []
    for own, query in _parts(tree, most):
        if own is not None and len(own) * len(run) <= most:
            run = {a + b for a in run for b in own}
            continue
        ended = True
        asked.append(_of_strings(run))
        if own is None:
            asked.append(query)
        run = {""} if own is None else own
    return (None, _both("and", [*asked, _of_strings(run)])) if ended else (run, _of_strings(run))


def _parts(tree, most: int):
    """The (exact strings or None, query) of each part of a parsed regex."""
    for op, arg in tree:
        if op is C.LITERAL:
            yield {chr(arg)}, True
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg):
            yield {chr(a) for _, a in arg}, True
        elif op is C.SUBPATTERN:
            yield _plan(arg[3], most)
        elif op is C.BRANCH:
            plans = [_plan(t, most) for t in arg[1]]
            known = all(own is not None for own, _ in plans)
            yield set().union(*(own for own, _ in plans)) if known else None, _both("or", [q for _, q in plans])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, body = arg
            own, query = _plan(body, most)
            if own is not None and (low, high) == (0, 1):
                yield own | {""}, True
            elif own is not None and low == high and len(own) ** low <= most:
                yield from [(own, True)] * low
            elif own is not None and low and len(own) ** min(low, 3) <= most:
                yield from [(own, True)] * min(low, 3)
                yield None, True
            else:
                yield None, query if low else True
        elif op not in (C.ASSERT, C.ASSERT_NOT, C.AT):
            yield None, True


def trigram_query(rule: Rule) -> object:
    """The Boolean trigram query that every text matching the rule satisfies, in lower case."""
    return _fold_query(_plan(parser.parse(rule.pattern, re.ASCII))[1])


def _fold_query(q: object) -> object:
    if q is True:
        return True
    if isinstance(q, str):
        return q.encode().translate(hashing.LOWER)
    return _both(q[0], [_fold_query(p) for p in q[1]])


def _trigrams(q: object) -> set[bytes]:
    return set() if q is True else {q} if isinstance(q, bytes) else set().union(*map(_trigrams, q[1]))


class Index:
    """The inverted index of one block: for each asked trigram the sorted numbers of texts that hold it."""

    def __init__(self, data: np.ndarray, at: np.ndarray, trigrams: list[bytes]):
        n = len(at) - 1
        self.all = np.arange(n)
        codes = np.array([int.from_bytes(t, "big") for t in trigrams], np.int64)
        order = np.argsort(codes)
        wanted = np.zeros(1 << 24, bool)
        wanted[codes] = True
        low = np.frombuffer(data.tobytes().translate(hashing.LOWER), np.uint8).astype(np.int32)
        code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:] if len(low) > 2 else np.empty(0, np.int32)
        place = np.flatnonzero(wanted[code])
        text = np.searchsorted(at, place, "right") - 1
        place, text = place[place + 2 < at[text + 1]], text[place + 2 < at[text + 1]]
        pair = np.unique(np.searchsorted(codes[order], code[place]) * max(n, 1) + text)
        which, text = np.divmod(pair, max(n, 1))
        cut = np.searchsorted(which, np.arange(len(codes) + 1))
        self.postings = {trigrams[order[k]]: text[cut[k] : cut[k + 1]] for k in range(len(codes))}

    def texts(self, query: object) -> np.ndarray:
        if query is True:
            return self.all
        if isinstance(query, bytes):
            return self.postings[query]
        op, parts = query
        out = self.texts(parts[0])
        for p in parts[1:]:
            out = (np.intersect1d if op == "and" else np.union1d)(out, self.texts(p))
        return out


def scan(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """For each text its (start, rule number, end), sorted."""
    plans = [trigram_query(r) for r in rules]
    data, at = hashing.join_texts([t.encode() for t in texts])
    index = Index(data, at, sorted(set().union(*map(_trigrams, plans))))
    out: list[list] = [[] for _ in texts]
    for k, (rule, plan) in enumerate(zip(rules, plans, strict=True)):
        find, holds = rule.compiled().finditer, rule.holds
        for t in index.texts(plan).tolist():
            out[t] += [(m.start(), k, m.end()) for m in find(texts[t]) if holds(m)]
    for spans in out:
        spans.sort()
    return out


def find_secrets(docs: DataFrame, keep: list[str] | None = None, extra: tuple[Rule, ...] = EXTRA) -> DataFrame:
    """Per document the number of spans of each base kind, a digest of the base spans, and all spans."""
    rules = BASE + tuple(extra)

    def compute(part: pa.RecordBatch) -> list:
        found = scan(common.texts_of(part), rules)
        text = [[f"{rules[k].kind}:{a}:{b}" for a, k, b in spans] for spans in found]
        base = [",".join([s for s, (_, k, _) in zip(ts, spans, strict=True) if k < len(BASE)]) for ts, spans in zip(text, found, strict=True)]
        counts = [[sum(x[1] == k for x in spans) for spans in found] for k in range(len(BASE))]
        return [*counts, [hashlib.sha256(b.encode()).hexdigest() for b in base], [",".join(t) for t in text]]

    keep = keep or ["doc_id"]
    return common.add_columns(common.pick(docs, *dict.fromkeys([*keep, "text"])), "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", compute, keep)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: secrets in every document."""
    return find_secrets(common.table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long")))


#: The rules in SQL's regexes: group 1 is what stands before a match, group 2 what has to have so many characters.
_SQL_RULES = (
    ("assign", r"""()(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", "()(AKIA[A-Z0-9]+)", 20),
    ("hex", "()([0-9a-f]+)", 24),
    ("private_key", "()(-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----)", 0),
    ("github", "()(gh[pousr]_[A-Za-z0-9]{36,})", 0),
    ("slack", "()(xox[abprs]-[A-Za-z0-9-]{10,})", 0),
    ("google", "()(AIza[A-Za-z0-9_-]{35})", 0),
    ("jwt", r"(^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})", 0),
    ("url_password", "()(://[A-Za-z0-9._~-]{1,64}:[A-Za-z0-9._~!$&*+=-]{3,64}@)", 0),
)


def _matches_sql(k: int, kind: str, pattern: str, least: int) -> str:
    """The matches of a rule in each text, their groups, and what stands between them, from which places follow."""
    return f"""
  SELECT doc_id, {k} AS k, '{kind}' AS kind, {least} AS least, string_split_regex(t, '{pattern}') AS s, regexp_extract_all(t, '{pattern}') AS m,
         regexp_extract_all(t, '{pattern}', 1) AS b, regexp_extract_all(t, '{pattern}', 2) AS v
  FROM d WHERE regexp_matches(t, '{pattern}')"""


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL".join(_matches_sql(k, *rule) for k, rule in enumerate(_SQL_RULES))}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m),
x AS (
  SELECT doc_id, k, kind, len(b[i]) AS skip, len(m[i]) AS n,
         list_sum(list_transform(s[1 : i], lambda z: len(z))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda z: len(z))), 0) AS a
  FROM i WHERE len(v[i]) >= least),
y AS (SELECT doc_id, k, CAST(a + skip AS BIGINT) AS a, kind || ':' || CAST(a + skip AS BIGINT) || ':' || CAST(a + n AS BIGINT) AS span FROM x),
g AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         string_agg(span, ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY a, k) AS spans FROM y GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""
