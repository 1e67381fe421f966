"""Personal data with a skip-chain conditional random field.

Base patterns find e-mail, IP, card and phone numbers. A CRF over the tokens of each document then
adds spans: tokens that hold a digit or an at sign are labelled O, EMAIL, IP, CARD or PHONE by

- node potentials: a log-linear model over token shape;
- chain potentials between tokens with only spaces between them;
- skip potentials between tokens that are the same or similar (the last seven digits agree, or the four
  parts of an address, or one is the first part of the other's e-mail), however far apart they stand.

All weights are learned together, by the pseudo-likelihood of each token's label given its neighbours', on
a bounded sample of documents. Labels there are the base matches, and to each document that has some are
added, with that label, the same data as the base patterns miss it (without prefix or domain, with other
separators), and as O the like of it with other digits or another name: so shape alone decides nothing
about such tokens, and what a link is worth is learned from them. Texts stay on the executors; what
reaches the driver is how often each combination of shape, label and neighbouring labels occurs.

Loopy belief propagation on log messages runs on each document's graph. A number that a document shows
once as `+49 ...` is also found where it stands without the prefix. The graph has all tokens that hold a
digit or an at sign, in documents without base matches too. Each token is linked to the first base match of
its form (what makes tokens similar) and to the occurrence before it, not to all, so a graph has at most
twice as many skip edges as tokens. Tokens in base matches, and those whose form permits no label but O,
have their label for sure: what they tell their neighbours is added to these at once, which is exact.

Defined cases: null and empty texts have no spans; null doc_id is kept; repeated rows are scanned
each; an empty table gives no rows; without a sample the weights are those of the prior (O, and links
that favour equal labels); other columns are ignored or kept.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
#: Documents with candidate tokens that the field is trained on, at most, and base matches of each that are varied.
SAMPLE, VARIED = 2048, 8
SWEEPS = 8
#: Log-odds that neighbours in a chain, and linked similar tokens, have the same label, before anything is learned.
CHAIN, SKIP = 0.0, 4.0
#: Least marginal probability of a label for a span to be added.
LEAST = 0.6

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[A-Za-z._%+-]*[0-9@][0-9A-Za-z@._%+-]*(?:[ ()-]{1,2}[0-9][0-9()._-]*)*")
_DIGITS = re.compile("[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, from each at sign, in linear time."""
    at, done = text.find("@"), 0
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        if m:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                done = m.end()
        at = text.find("@", max(at + 1, done))


def _octet(part: str) -> bool:
    """Whether a part is at most 255, with any leading zeros; long ones aren't turned into numbers, which Python limits."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base matches, by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    digit = _DIGITS.search(text)
    if digit:
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text, digit.start()) if all(_octet(p) for p in m[0].split("."))] if "." in text else []
        for m in _CARD.finditer(text, digit.start()):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdecimal, m[0])) <= 15]
    return out


# --- the field


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """Spans of candidate tokens: runs with a digit or an at sign, number groups joined over single separators."""
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        while b > a and text[b - 1] in "._-%+ (":
            b -= 1
        yield a, b


#: Shape features; two more rows of a weight table hold the weights of skip and chain neighbours.
FEATURES = 40


def quad(token: str) -> list[str] | None:
    """The four parts of an address, with dots or dashes between them, without leading zeros."""
    parts = re.split("[.-]", token) if token.count(".") + token.count("-") == 3 else ()
    return [q.lstrip("0") or "0" for q in parts] if len(parts) == 4 and all(q.isdecimal() and q.isascii() and _octet(q) for q in parts) else None


def features(token: str) -> list[int]:
    """Numbers of the shape features that hold for a token."""
    plain = "".join(c for c in token if c.isdecimal())
    digits, dots, at, letters = len(plain), token.count("."), "@" in token, any(map(str.isalpha, token))
    out = [0, 1 + min(digits, 20), 22 + min(dots, 4), 27 + at, 29 + letters, 31 + token.startswith("+"), 33 + (quad(token) is not None)]
    out.append(35 + (16 <= digits <= 19 and not letters and luhn(plain)))
    out.append(37 + (at and token.rpartition("@")[2].count(".") > 0))
    return out


def permitted(token: str) -> list[bool]:
    """Which labels a token's form permits: checks that no evidence overrides."""
    digits = "".join(c for c in token if c.isdecimal())
    letters = any(map(str.isalpha, token))
    number = not letters and "@" not in token
    return [True, letters, quad(token) is not None, number and 16 <= len(digits) <= 19 and luhn(digits), number and 7 <= len(digits) <= 15]


def form(token: str) -> str:
    """What tokens that are linked have in common; empty for those that aren't linked to any.

    An address is its four parts; a number of seven digits or more its last seven; a token with an at
    sign or letters what stands before the at sign.
    """
    parts = quad(token)
    if parts:
        return "ip " + ".".join(parts)
    if "@" in token or any(map(str.isalpha, token)):
        return token.partition("@")[0].lower()
    digits = "".join(c for c in token if c.isdecimal())
    return digits[-7:] if len(digits) >= 7 else ""


@functools.lru_cache(1 << 14)
def _seen(token: str) -> tuple[tuple, str]:
    return (tuple(features(token)), tuple(permitted(token))), form(token)


def seen(token: str) -> tuple[tuple, str]:
    """The shape (features and permitted labels) and the form of a token; those of short ones are remembered."""
    return _seen(token) if len(token) < 64 else _seen.__wrapped__(token)


class Spans(Sequence):
    """Pairs of start and end in one array, as a text may have millions."""

    def __init__(self, at: np.ndarray):
        self.at = at

    def __len__(self) -> int:
        return len(self.at)

    def __getitem__(self, k: int) -> tuple[int, int]:
        return tuple(self.at[k].tolist())

    def __iter__(self) -> Iterator[tuple[int, int]]:
        for k in range(0, len(self.at), 4096):
            yield from map(tuple, self.at[k : k + 4096].tolist())


def covering(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """Each token with the kind of the base match that it meets, or -1."""
    by_start = sorted((s, e, k) for k, s, e in base)
    j = 0
    for a, b in tokens(text):
        while j < len(by_start) and by_start[j][1] <= a:
            j += 1
        yield a, b, by_start[j][2] if j < len(by_start) and by_start[j][0] < b else -1


def candidates(text: str, base: list[tuple[int, int, int]]) -> tuple[Spans, np.ndarray]:
    """All tokens of a document, which are its graph, and the kind of base match they meet or -1."""
    found = np.fromiter(itertools.chain.from_iterable(covering(text, base)), np.int64).reshape(-1, 3)
    return Spans(found[:, :2].copy()), found[:, 2].astype(np.int8)


def shapes(text: str, spans: Spans) -> tuple[list[tuple], np.ndarray]:
    """The distinct shapes of some tokens, and which of them each token has."""
    number: dict[tuple, int] = {}
    which = np.fromiter((number.setdefault(seen(text[a:b])[0], len(number)) for a, b in spans), np.int32, len(spans))
    return list(number), which


def links(text: str, spans: Spans, sure: np.ndarray) -> np.ndarray:
    """Skip edges (i, j) of tokens of a form: each to the form's first sure one and to the one before, but for edges between sure ones."""
    last: dict[str, int] = {}
    hub: dict[str, int] = {}
    for k in np.flatnonzero(sure).tolist():
        a, b = spans[k]
        hub.setdefault(seen(text[a:b])[1], k)

    def ends() -> Iterator[int]:
        for k, (a, b) in enumerate(spans):
            own = seen(text[a:b])[1]
            if own:
                for other in {hub.get(own, k), last.get(own, k)}:
                    if other != k and not (sure[k] and sure[other]):
                        yield from (other, k)
                last[own] = k

    return np.fromiter(ends(), np.int32).reshape(-1, 2)


def chains(text: str, spans: Spans, sure: np.ndarray) -> np.ndarray:
    """Edges between tokens with only spaces between them, three at most, but for edges between sure ones."""
    stop, start = spans.at[:-1, 1], spans.at[1:, 0]
    near = np.flatnonzero((start - stop < 4) & ~(sure[:-1] & sure[1:]))
    near = near[[text[a:b].isspace() for a, b in zip(stop[near].tolist(), start[near].tolist(), strict=True)]] if len(near) else near
    return np.column_stack([near, near + 1]).astype(np.int32)


#: An edge of a graph, and edges that are worked on at once.
EDGE = [("i", np.int32), ("j", np.int32), ("weight", np.float64)]
EDGES_AT_ONCE = 1 << 16
#: Log potential of a label that a token can't have.
NEVER = -1e9


def _added(total: np.ndarray, target: np.ndarray, log: np.ndarray) -> None:
    """Adds each row of ``log`` to the target's row of ``total``."""
    states = total.shape[1]
    np.add.at(total.reshape(-1), (target.astype(np.int64)[:, None] * states + np.arange(states)).reshape(-1), log.reshape(-1))


def beliefs(node: np.ndarray, edges: list[tuple[int, int, float]] | np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Marginals by loopy sum-product on log messages; an edge of weight w favours equal labels by exp(w).

    A node with one possible label always sends the same message, so its edges are settled before the sweeps.
    """
    n, states = node.shape
    edges = np.asarray(edges, EDGE)
    node = np.array(node, np.float64)
    sure = (node > NEVER / 2).sum(1) == 1
    for a, b in (("i", "j"), ("j", "i")):
        fixed = edges[sure[edges[a]] & ~sure[edges[b]]]
        np.add.at(node, (fixed[b], node[fixed[a]].argmax(1)), fixed["weight"])
    edges = edges[~sure[edges["i"]] & ~sure[edges["j"]]]
    total = node
    if len(edges):
        message = np.full((2, len(edges), states), 1.0 / states, np.float32)
        for sweep in range(sweeps + 1):
            before, total = total, node.copy()
            for at in range(0, len(edges), EDGES_AT_ONCE):
                part = edges[at : at + EDGES_AT_ONCE]
                ends, own = (part["i"], part["j"]), message[:, at : at + EDGES_AT_ONCE]
                if sweep:
                    # message 0 goes from i to j, message 1 back
                    log = np.log(own, dtype=np.float64)
                    for way in range(2):
                        out = before[ends[way]] - log[1 - way]
                        out = np.exp(out - out.max(1, keepdims=True))
                        new = out.sum(1, keepdims=True) + np.expm1(part["weight"])[:, None] * out
                        own[way] = 0.1 * own[way] + 0.9 * new / new.sum(1, keepdims=True)
                log = np.log(own, dtype=np.float64)
                for way in range(2):
                    _added(total, ends[1 - way], log[way])
    e = np.exp(total - total.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def field(text: str, spans: Spans, kind: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node potentials and edges (i, j, weight) of a document's graph; tokens in a base match have its label for sure."""
    kinds, which = shapes(text, spans)
    node = np.array([np.where(ok, weights[list(shape)].sum(0), NEVER) for shape, ok in kinds]).reshape(-1, len(LABELS))[which]
    sure = kind >= 0
    node[sure] = NEVER
    node[sure, 1 + kind[sure]] = 0.0
    both = [(links(text, spans, sure), weights[FEATURES, 0]), (chains(text, spans, sure), weights[FEATURES + 1, 0])]
    edges = np.empty(sum(len(e) for e, _ in both), EDGE)
    at = 0
    for e, w in both:
        edges["i"][at : at + len(e)], edges["j"][at : at + len(e)], edges["weight"][at : at + len(e)] = e[:, 0], e[:, 1], w
        at += len(e)
    return node, edges


def label(text: str, base: list[tuple[int, int, int]], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans (kind, start, end) that the field adds to the base matches of a text."""
    spans, kind = candidates(text, base)
    if (kind >= 0).all():
        return []
    p = beliefs(*field(text, spans, kind, weights))
    best = p[:, 1:].argmax(1)
    return [(int(best[k]), *spans[k]) for k in np.flatnonzero((kind < 0) & (p[np.arange(len(p)), 1 + best] >= LEAST)).tolist()]


# --- learning


def missed(text: str, kind: int) -> str:
    """A base match as it may stand where the base patterns don't see it."""
    if kind == 0:
        name, _, domain = text.partition("@")
        return name if any(map(str.isdecimal, name)) else f"{name}@{domain.partition('.')[0]}"
    digits = "".join(c for c in text if c.isdecimal())
    return "-".join(text.split(".")) if kind == 1 else ".".join(re.findall(".{1,4}", digits)) if kind == 2 else f"{digits[-10:-7]} {digits[-7:-4]}-{digits[-4:]}".strip()


def another(text: str) -> str:
    """The like of a text with other digits and, of what has letters, another name."""
    return "".join(str((int(c) * 3 + 1) % 10) if c.isdecimal() else c for c in (text[::-1] if any(map(str.isalpha, text)) else text))


def varied(text: str, base: list[tuple[int, int, int]], most: int = VARIED) -> tuple[str, dict[tuple[int, int], int]]:
    """The text with variants of its base matches and their likes added, each on a line, and the label of each such line's token."""
    own, parts, at = {}, [text, "\n"], len(text) + 1
    for k, a, b in base[:most]:
        variant = missed(text[a:b], k)
        for line, gold in ((variant, 1 + k), (another(variant), 0)):
            if not any(c.isdecimal() for c in line) and "@" not in line:
                continue
            own[at, at + len(line)] = gold
            parts += [line, " x\n"]
            at += len(line) + 3
    return "".join(parts), own


def examples(text: str) -> Counter:
    """How often a sample text has each combination of shape features, permitted labels, label, and how many skip and chain neighbours of each label (two at most)."""
    text, own = varied(text, base_spans(text))
    base = base_spans(text)
    starts = {(a, b): 1 + k for k, a, b in base}
    spans, kind = candidates(text, base)
    kinds, which = shapes(text, spans)
    sure, states = kind >= 0, len(LABELS)
    gold = np.fromiter((own.get(s, 1 + k) for s, k in zip(spans, kind.tolist(), strict=True)), np.int64, len(spans))
    near = []
    for edges in (links(text, spans, sure), chains(text, spans, sure)):
        i, j = edges[:, 0].astype(np.int64), edges[:, 1].astype(np.int64)
        count = np.bincount(i * states + gold[j], minlength=len(spans) * states) + np.bincount(j * states + gold[i], minlength=len(spans) * states)
        near.append(count.reshape(-1, states).clip(0, 2).astype(np.int32))
    # a token that is part of a match only is no example itself
    own_row = np.fromiter((s in starts for s in spans), bool, len(spans)) | ~sure
    label_of = np.fromiter((own.get(s, starts.get(s, 0)) for s in spans), np.int32, len(spans))
    rows, number = np.unique(np.column_stack([which, label_of, *near])[own_row], axis=0, return_counts=True)
    return Counter({(*kinds[row[0]], row[1], tuple(row[2:])): n for row, n in zip(rows.tolist(), number.tolist(), strict=True)})


def fit(rows: Counter, rounds: int = 400, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights (features and the two kinds of neighbours x labels) of the greatest penalised pseudo-likelihood; O is the prior."""
    weights = np.zeros((FEATURES + 2, len(LABELS)))
    weights[0, 0], weights[FEATURES], weights[FEATURES + 1] = 3.0, SKIP, CHAIN
    if not rows:
        return weights
    keys = sorted(rows)
    x = np.zeros((len(keys), FEATURES))
    for k, key in enumerate(keys):
        x[k, list(key[0])] = 1
    ok = np.array([key[1] for key in keys])
    gold = np.array([key[2] for key in keys])
    # a label of a neighbour is a feature of that label alone, with one weight for all labels
    near = np.array([key[3] for key in keys], float).reshape(len(keys), 2, len(LABELS)).transpose(1, 0, 2)
    # a base match may be forbidden by the form of its token (cut off at a letter); its own label counts as permitted
    ok[np.arange(len(keys)), gold] = True
    share = np.array([rows[key] for key in keys], float)[:, None] / sum(rows.values())
    y = np.eye(len(LABELS))[gold]
    start, slope, power = weights.copy(), np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, rounds + 1):
        z = np.where(ok, x @ weights[:FEATURES] + np.tensordot(weights[FEATURES:, 0], near, 1), -1e9)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        off = (y - p) * share
        g = np.concatenate([x.T @ off, np.repeat((near * off).sum((1, 2))[:, None], len(LABELS), 1)]) - decay * (weights - start)
        slope, power = 0.9 * slope + 0.1 * g, 0.99 * power + 0.01 * g * g
        weights = weights + rate * (slope / (1 - 0.9**t)) / (np.sqrt(power / (1 - 0.99**t)) + 1e-6)
    return weights


def train(texts: list[str]) -> np.ndarray:
    """The weights learned from some texts."""
    return fit(sum(map(examples, texts), Counter()))


def trained(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The weights learned from at most ``sample`` documents that hold a digit or an at sign, chosen by hash."""
    some = common.slot_sample(common.pick(docs, "doc_id", "text").where(F.col("text").rlike("[0-9@]")), sample)

    def counted(batches):
        rows: Counter = Counter()
        for batch in batches:
            for text in common.texts_of(batch):
                rows.update(examples(text))
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(k) for k in rows], pa.string()), pa.array(rows.values(), pa.int64())], names=["row", "n"])

    common.bound_batches(docs.sparkSession)
    total: Counter = Counter()
    for row, n in some.select("text").mapInArrow(counted, "row string, n long").groupBy("row").agg(F.sum("n").alias("n")).toLocalIterator():
        shape, ok, gold, near = json.loads(row)
        total[tuple(shape), tuple(ok), gold, tuple(near)] = n
    return fit(total)


def find_personal(docs: DataFrame, weights: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """Per document the number of spans of each base kind, a digest of the base spans, all spans, and their number."""

    def compute(part: pa.RecordBatch) -> list:
        base_text, all_text, number, counts = [], [], [], [[], [], [], []]
        for text in common.texts_of(part):
            base = base_spans(text)
            every = sorted(base + label(text, base, weights))
            base_text.append(",".join([f"{KINDS[k]}:{a}:{b}" for k, a, b in base]))
            all_text.append(",".join([f"{KINDS[k]}:{a}:{b}" for k, a, b in every]))
            number.append(len(every))
            for k in range(4):
                counts[k].append(sum(s[0] == k for s in base))
        return [*counts, [hashlib.sha256(b.encode()).hexdigest() for b in base_text], all_text, number]

    keep = keep or ["doc_id"]
    return common.add_columns(common.pick(docs, *dict.fromkeys([*keep, "text"])), "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long", compute, keep)


def redact(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` with every span, base and added, replaced by its kind in angle brackets; n_chars follows the text."""

    def compute(part: pa.RecordBatch) -> list:
        out = []
        for text in part.column("text").to_pylist():
            if text:
                base = base_spans(text)
                pieces, at = [], 0
                for a, b, k in sorted((a, b, k) for k, a, b in base + label(text, base, weights)):
                    if b <= at:
                        continue
                    pieces += [text[at : max(a, at)], f"<{KINDS[k].upper()}>"]
                    at = b
                text = "".join([*pieces, text[at:]])
            out.append(text)
        return [out, [None if t is None else len(t) for t in out]]

    keep = [c for c in docs.columns if c not in ("text", "n_chars")]
    return common.add_columns(docs, "text string, n_chars long", compute, keep).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: personal data in every document, the node model trained on a sample of the same table."""
    docs = common.table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    return find_personal(docs, trained(docs))


def base_query(spark, sf_dir: str) -> DataFrame:
    """The columns of op7 that don't depend on the field, for which there is SQL."""
    return query(spark, sf_dir).drop("spans", "n_spans")


#: The base columns by SQL alone: places follow from what stands between the matches of a kind.
BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p(k, kind, p) AS (VALUES (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'),
                         (2, 'card', '[0-9](?:[ -]?[0-9])+'), (3, 'phone', '\+[0-9][ ().0-9-]+[0-9]')),
m AS (SELECT doc_id, k, kind, string_split_regex(t, p) AS s, regexp_extract_all(t, p) AS m FROM d, p WHERE regexp_matches(t, p)),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m),
x AS (
  SELECT doc_id, k, kind, m[i] AS v, regexp_replace(m[i], '[^0-9]', '', 'g') AS n,
         list_sum(list_transform(s[1 : i], lambda z: len(z))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda z: len(z))), 0) AS a FROM i),
ok AS (
  SELECT *, list_sum(list_transform(range(1, len(n) + 1), lambda j: CASE WHEN j % 2 = 1 THEN CAST(n[len(n) + 1 - j] AS INT)
                 ELSE (2 * CAST(n[len(n) + 1 - j] AS INT)) % 10 + (2 * CAST(n[len(n) + 1 - j] AS INT)) // 10 END)) % 10 = 0 AS luhn FROM x),
y AS (
  SELECT doc_id, k, CAST(a AS BIGINT) AS a, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + len(v) AS BIGINT) AS span FROM ok
  WHERE k = 0 OR (k = 1 AND len(list_filter(string_split(v, '.'), lambda z: len(ltrim(z, '0')) > 3 OR CAST('0' || right(ltrim(z, '0'), 3) AS INT) > 255)) = 0)
     OR (k = 2 AND len(n) BETWEEN 16 AND 19 AND luhn) OR (k = 3 AND len(n) BETWEEN 8 AND 15)),
g AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone,
         string_agg(span, ',' ORDER BY k, a) AS base FROM y GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256 FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""
