"""Language identification by cross-parsing entropy.

For each language a suffix automaton of bounded sample text accepts exactly the substrings of that
text. A document is parsed greedily into the longest phrases that the automaton accepts; a text needs
fewer phrases in its own language. Phrases are counted with weight log2(automaton text length), which
is what naming one costs, and divided by the document's length; the language with the least such
cross-entropy wins, and ties go to the first in alphabetical order.

Documents are parsed whole, in segments of ``SEGMENT`` normalised characters. Many segments step
through all automata together, one character at a time, in numpy. Training rows are those with
crc32(doc_id as text) mod 4 other than 2 and a language; each language's sample takes at most ``SLOTS``
documents chosen by hash and ``SAMPLE_CHARS`` characters in all. Where there are more characters, each
document gives as many as the others, or all it has: an excerpt from a place chosen by hash, so that the
openings that documents share don't fill the sample. The samples of all languages have ``ALL_CHARS`` characters
at most, shared evenly, and of more than ``common.GROUPS`` languages those with the most documents in the
sample are learned; so the model has a bounded size (some 30 bytes a sample character) whatever the number
of languages or the size of their alphabets.

Normalised: lower case, and every run of characters that aren't letters is one space.

Defined cases: null text, or text without letters, is `und` with score 0; so is everything if no
training text exists. A null doc_id is kept and counts as not held out (and its row is not learned
from); repeated rows are each labelled; an empty table gives no rows; other columns are ignored or kept.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SLOTS = 256
SAMPLE_CHARS = 60_000
ALL_CHARS = 2_000_000
SEGMENT = 1024
#: Segments that step together.
AT_ONCE = 2048
UNKNOWN = "und"


@functools.cache
def _fold_table() -> np.ndarray:
    """For each code point, the code point of its lower case if it is a letter, else that of a space."""
    out = np.full(0x110000, 32, np.int32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters_of(text: str) -> np.ndarray:
    """The normalised code points of a text."""
    codes = _fold_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    return codes[keep]


class Automaton:
    """The transitions of an automaton: (state, class) -> state, -1 where there is none; 0 starts."""

    def __init__(self, following: list[dict[int, int]]):
        self.states = len(following)
        degree = np.fromiter(map(len, following), np.int64, self.states)
        self.state = np.repeat(np.arange(self.states), degree)
        self.letter = np.fromiter((c for f in following for c in f), np.int64, len(self.state))
        self.to = np.fromiter((t for f in following for t in f.values()), np.int64, len(self.state))

    def __getitem__(self, at: tuple[int, int]) -> int:
        found = np.flatnonzero((self.state == at[0]) & (self.letter == at[1]))
        return int(self.to[found[0]]) if len(found) else -1


def suffix_automaton(codes: np.ndarray, width: int) -> Automaton:
    """The suffix automaton of a text of classes below ``width``."""
    following: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes.tolist():
        new = len(length)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = new
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(length)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return Automaton(following)


_LOW = np.int64((1 << 32) - 1)


def double_array(state: np.ndarray, letter: np.ndarray, to: np.ndarray, states: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The transitions of ``states`` states in one array of cells, and the base of each state.

    A state is known by its base, which no other has. Cell base + class holds the base in its upper 32 bits
    and the base of the next state in the lower ones if there is such a transition; the cell is another
    state's, or -1, if there is none. Bases are tried at random, states of high degree first.
    """
    rng, cells = np.random.default_rng(3), int(1.4 * max(len(state), states)) + width
    free, unused = np.ones(cells + width, bool), np.ones(cells, bool)
    base = np.full(states, -1, np.int64)
    order = np.argsort(state, kind="stable")
    degree = np.bincount(state, minlength=states)
    first = np.cumsum(degree) - degree
    for d in np.unique(degree)[::-1].tolist():
        todo = np.flatnonzero(degree == d)
        own = letter[order[first[todo][:, None] + np.arange(d)]]
        while len(todo):
            at = rng.integers(0, cells, len(todo))
            fits = unused[at] & free[at[:, None] + own].all(1)
            fits[np.flatnonzero(fits)[~_alone(at[fits], own[fits])]] = False
            base[todo[fits]] = at[fits]
            unused[at[fits]] = False
            free[(at[fits, None] + own[fits]).ravel()] = False
            if 20 * int(fits.sum()) < len(todo):
                cells += cells // 4
                free, unused = (np.concatenate([x, np.ones(cells + more - len(x), bool)]) for x, more in ((free, width), (unused, 0)))
            todo, own = todo[~fits], own[~fits]
    out = np.full(cells + width, -1, np.int64)
    out[base[state] + letter] = (base[state] << np.int64(32)) | base[to]
    return out, base


def _alone(at: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which of several bases meet no earlier one of them, nor a cell of it."""
    ok = np.zeros(len(at), bool)
    ok[np.unique(at, return_index=True)[1]] = True
    if own.shape[1]:
        slots = (at[:, None] + own).ravel()
        won = np.zeros(len(slots), bool)
        won[np.unique(slots, return_index=True)[1]] = True
        ok &= won.reshape(own.shape).all(1)
    return ok


class Languages:
    """The automata of all learned languages over one array of transitions."""

    def __init__(self, samples: dict[str, list[str]], most_chars: int = SAMPLE_CHARS):
        self.names = sorted(samples)
        texts = [np.concatenate([np.append(letters_of(t), 32) for t in samples[n]])[:most_chars] for n in self.names]
        seen = np.unique(np.concatenate(texts)) if texts else np.empty(0, np.int32)
        self.alphabet = seen
        width = len(seen) + 1
        state, letter, to, roots, states = [], [], [], [], 1  # state 0 is the dead one, which goes nowhere
        for t in texts:
            own = suffix_automaton(np.searchsorted(seen, t) + 1, width)
            state.append(own.state + states)
            letter.append(own.letter)
            to.append(own.to + states)
            roots.append(states)
            states += own.states
        none = [np.empty(0, np.int64)]
        self.cells, base = double_array(*(np.concatenate(x or none) for x in (state, letter, to)), states, width)
        #: The state after the first character of a phrase, by language and class; an unseen one is a phrase of its own.
        self.first = np.full((len(texts), width), base[0], np.int64)
        for row, root in enumerate(roots):
            at = base[root] + np.arange(width)
            own = self.cells[at] >> np.int64(32) == base[root]
            self.first[row, own] = self.cells[at[own]] & _LOW
        self.cost = np.log2([max(len(t), 2) for t in texts])
        self.classes = np.zeros(0x110000, np.uint16 if width < 1 << 16 else np.uint32)
        self.classes[seen] = np.arange(1, width)

    def phrases(self, segments: list[np.ndarray]) -> np.ndarray:
        """Phrases of each segment of normalised code points in each language."""
        out = np.zeros((len(self.names), len(segments)), np.int64)
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        order = np.argsort(-size, kind="stable")
        order = order[size[order] > 0]
        if not len(order) or not self.names:
            return out
        steps = int(size[order[0]])
        grid = np.zeros((len(order), steps), self.classes.dtype)
        for row, k in enumerate(order.tolist()):
            grid[row, : size[k]] = self.classes[segments[k]]
        grid = np.ascontiguousarray(grid.T).astype(np.int64)
        active = np.searchsorted(-size[order], -np.arange(steps), "left")
        state = self.first[:, grid[0]]
        count = np.ones((len(self.names), len(order)), np.int32)
        for t in range(1, steps):
            n = int(active[t])
            c, old = grid[t, :n], state[:, :n]
            cell = self.cells[old + c]
            on = cell >> np.int64(32) == old
            count[:, :n] += ~on
            # where a phrase ends, another starts with this character
            state[:, :n] = np.where(on, cell & _LOW, self.first[:, c])
        out[:, order] = count
        return out

    def identify(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language and score of each text: how much cheaper it is than in the second-best language."""
        segments, owner, length = [], [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            codes = letters_of(text) if text else np.empty(0, np.int32)
            if len(codes) and (codes != 32).any():
                length[k] = len(codes)
                for a in range(0, len(codes), SEGMENT):
                    segments.append(codes[a : a + SEGMENT])
                    owner.append(k)
        found = np.concatenate([self.phrases(segments[k : k + AT_ONCE]) for k in range(0, max(len(segments), 1), AT_ONCE)], axis=1)
        bits = np.zeros((len(self.names), len(texts)))
        for row in range(len(self.names)):
            bits[row] = np.bincount(np.array(owner, np.int64), found[row], len(texts)) * self.cost[row]
        names, scores = [], []
        for k in range(len(texts)):
            if not length[k] or not self.names:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            order = np.argsort(bits[:, k], kind="stable")
            names.append(self.names[order[0]])
            scores.append(1.0 if len(order) == 1 else float(1 - bits[order[0], k] / bits[order[1], k]))
        return names, scores


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, slots: int = SLOTS, most_chars: int = SAMPLE_CHARS, all_chars: int = ALL_CHARS) -> Languages:
    """Automata from the bounded sample of each language's training rows."""
    rows = common.pick(docs, "doc_id", "text", "lang").where((F.crc32(F.col("doc_id").cast("string")) % 4 != 2) & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    samples: dict[str, list[str]] = {}
    picked = common.slot_sample(rows, slots, by=["lang"]).select("lang", "doc_id", F.trim(F.regexp_replace("text", "\\P{L}+", " ")).alias("text"))
    whole = common.materialize(picked.withColumn("n", F.length("text") + 1), "picked")
    lengths: dict[str, list[int]] = {}
    for lang, n in whole.select("lang", "n").toLocalIterator():
        lengths.setdefault(lang, []).append(n)
    most_chars = min(most_chars, all_chars // max(len(lengths), 1))
    share = F.create_map(*[F.lit(x) for lang, ns in lengths.items() for x in (lang, even_share(ns, most_chars))]) if lengths else F.create_map().cast("map<string,int>")
    picked = whole.withColumn("share", share[F.col("lang")] - 1)
    at = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.greatest(F.col("n") - F.col("share"), F.lit(1))).cast("int") + 1
    for lang, _, text in picked.select("lang", "doc_id", F.substring("text", at, F.col("share")).alias("text")).orderBy("lang", F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        samples.setdefault(lang, []).append(text)
    common.discard(whole)
    return Languages(samples, most_chars)


def even_share(lengths: list[int], most: int) -> int:
    """The most characters, two at least, that each of these texts may give so that all give at most ``most`` together."""
    left = most
    for k, n in enumerate(sorted(lengths)):
        if n * (len(lengths) - k) > left:
            return max(2, left // (len(lengths) - k))
        left -= n
    return max(2, *lengths)


def identify(docs: DataFrame, languages: Languages, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of each document with held_out, lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(languages)
    keep = keep or ["doc_id"]
    ready = common.pick(docs, *dict.fromkeys([*keep, "doc_id", "text"])).withColumn("held_out", held_out(F.col("doc_id")))

    def compute(part: pa.RecordBatch) -> list:
        names, scores = sent.value.identify(part.column("text").to_pylist())
        return [part.column("held_out"), names, scores]

    return common.add_columns(ready, "held_out boolean, lang_pred string, score double", compute, keep)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the language of every document."""
    docs = common.table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))
