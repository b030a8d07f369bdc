"""Hashed word shingles of whole texts, a batch at a time in numpy.

Words are runs of bytes other than space and tab to carriage return, A-Z lower-cased. A shingle is the 64-bit hash of
five words in order; the whole sequence if there are fewer words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

WIDTH = 5
LONG = 256  # bytes of a word from which on hashlib takes it
U = np.uint64
_rng = np.random.default_rng(20240229)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))  # A-Z count as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_KEY, _STEP = _rng.integers(1, 2**63, 2, dtype=U) * U(2) + U(1)
_PLACE = _rng.integers(1, 2**63, WIDTH, dtype=U) * U(2) + U(1)
_COUNT = _rng.integers(1, 2**63, WIDTH, dtype=U)
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of bytes that end in white space.

    Eight bytes at a time are mixed into a word's state, which begins with its length: unlike a polynomial, this has no
    inputs that meet whatever the constants are.
    """
    raw = raw.translate(_LOWER)
    byte = np.frombuffer(raw, dtype=np.uint8)
    space = _SPACE[byte]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(raw) and not space[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    size = end - start
    h = mix(size.astype(U) ^ _KEY)
    padded = np.frombuffer(raw + bytes(8), dtype=np.uint8)
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    at = np.flatnonzero(size <= LONG)
    for k in range(0, LONG, 8):
        at = at[size[at] > k]
        if not len(at):
            break
        left = np.minimum(size[at] - k, 8).astype(U)
        part = eight[start[at] + k] & (U(0xFFFFFFFFFFFFFFFF) >> (U(64) - U(8) * left))
        h[at] = mix((h[at] ^ part) * _STEP + _KEY)
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]], digest_size=8).digest(), "little")
    return start, h


def lowered(text: str | None) -> bytes:
    """A text with A-Z lower-cased; null: empty."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)


def words(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased."""
    return lowered(text).split()


def link(x: list[bytes], y: list[bytes], num: int, den: int) -> bool:
    """Whether the shingle sets of two lists of words have den * intersection >= num * union, compared word by word."""
    if len(x) < WIDTH or len(y) < WIDTH:
        if len(x) < WIDTH and len(y) < WIDTH:
            return x == y and bool(x)
        return False  # a sequence of fewer words is no shingle of a longer text
    number: dict[bytes, int] = {}
    code = np.array([number.setdefault(w, len(number)) for w in (*x, *y)], dtype=np.int64)
    run = code
    for k in range(1, WIDTH):  # equal runs of k + 1 words get equal numbers
        run = np.unique(run[:-1] * len(number) + code[k:], return_inverse=True)[1]
    first, second = np.unique(run[: len(x) - WIDTH + 1]), np.unique(run[len(x) :])
    both = len(np.intersect1d(first, second, assume_unique=True))
    return den * both >= num * (len(first) + len(second) - both)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text; none for null or no words."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    lo = 0
    while lo < len(raw):
        hi, size = lo, 0
        while hi < len(raw) and (hi == lo or size + len(raw[hi]) < CHUNK):
            size += len(raw[hi]) + 1
            hi += 1
        yield from _sets(raw[lo:hi])
        lo = hi


def _sets(raw: list[bytes]) -> Iterator[np.ndarray]:
    ends = np.cumsum([len(x) + 1 for x in raw])
    start, h = word_hashes(b"\n".join(raw) + b"\n")
    cut = np.searchsorted(start, ends)
    n = len(h)
    m = max(0, n - WIDTH + 1)
    full = np.zeros(m, dtype=U)
    for k in range(WIDTH):
        full += h[k : k + m] * _PLACE[k]
    full = mix(full)
    lo = 0
    for hi in cut.tolist():
        if hi - lo >= WIDTH:
            s = np.sort(full[lo : hi - WIDTH + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif hi > lo:
            yield mix((h[lo:hi] * _PLACE[: hi - lo]).sum(dtype=U, keepdims=True) + _COUNT[hi - lo : hi - lo + 1])
        else:
            yield np.zeros(0, dtype=U)
        lo = hi
