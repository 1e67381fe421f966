"""Words of many texts at once: boundaries and 64-bit hashes over one byte buffer, in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte; fixed by the seed, so all workers agree.
_BYTE = _rng.integers(1, 1 << 64, 256, dtype=np.uint64)
_R = np.uint64(0x9E3779B97F4A7C15 | 3)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}
#: Bytes of a buffer that are hashed at once, and of the longest word that is hashed as a polynomial.
STRETCH, LONG = 1 << 18, 1 << 16

#: Bytes of the space class [\x20\x09-\x0D].
SPACES = (9, 10, 11, 12, 13, 32)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
#: A-Z to a-z, every other byte as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        step = np.full(size, base, np.uint64)
        step[0] = 1
        have = _powers[kind] = np.cumprod(step, dtype=np.uint64)
    return have[:n]


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a line feed after each text, and the place where each text starts (and the end)."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return data, at


def space_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in a buffer that ends in a space."""
    space = _IS_SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edge = np.concatenate([[0], edge])
    return edge[0::2], edge[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in random byte values, from prefix sums, finalised with the length.

    Words come by their starts. Prefix sums are made of stretches of the buffer, so memory beside the
    result doesn't grow with it; words of over ``LONG`` bytes have a cryptographic hash.
    """
    out = np.empty(len(starts), np.uint64)
    size = ends - starts
    for a, b in _stretches(starts):
        lo = int(starts[a])
        s, e = starts[a:b] - lo, np.minimum(ends[a:b], starts[a:b] + LONG) - lo
        values = _BYTE[data[lo : lo + int(e.max())]]
        n = len(values)
        values *= _power("up", _R, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        out[a:b] = (sums[e] - sums[s]) * _power("down", _R_INV, n)[s]
    out = mix(out + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def _stretches(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of words whose starts lie in the same ``STRETCH`` bytes."""
    cuts = np.flatnonzero(np.diff(starts // STRETCH)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(starts)], strict=True) if len(starts) else ()
