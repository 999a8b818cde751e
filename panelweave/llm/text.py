"""Shared parts: the word pattern, projections that avoid name clashes, word hashes of whole texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

# fixed: a word is a run of characters other than space and U+0009..U+000D
GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"

BLOCK = 1 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15


def columns(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast: other columns of the input cannot clash with those made on the way."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in kinds.items()])


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


class Remembered:
    """Results by word, bounded: two generations of at most ``limit`` words, of which the older is dropped."""

    def __init__(self, solve, limit: int):
        self.solve, self.limit = solve, limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def all_joined(self, texts: list[list[str]]) -> list[bytes]:
        """For every text the results of its words, one after the other. ``solve`` maps a list of new words to results."""
        missing = set().union(*texts).difference(self.young)
        if missing:
            if len(self.young) + len(missing) > self.limit:
                self.old, self.young, missing = self.young, {}, set().union(*texts)
            self._learn(missing)
        get = self.young.__getitem__
        return [b"".join(map(get, words)) for words in texts]

    def each(self, words: list[str]) -> list[bytes]:
        """The result of every one of different words."""
        missing = [w for w in words if w not in self.young]
        if missing:
            if len(self.young) + len(missing) > self.limit:
                self.old, self.young, missing = self.young, {}, words
            self._learn(missing)
        return list(map(self.young.__getitem__, words))

    def _learn(self, missing: Iterable[str]) -> None:
        young, old = self.young, self.old
        new = [w for w in missing if w not in old]
        young.update((w, old[w]) for w in missing if w in old)
        young.update(zip(new, self.solve(new), strict=True))

    def joined(self, words: list[str]) -> bytes:
        return self.all_joined([words])[0]


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOW_BYTES = _BYTES[_LOWER]
_IS_GAP = np.zeros(256, bool)
_IS_GAP[[32, *range(9, 14)]] = True
_powers: list[np.ndarray] = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def _pieces(raw: bytes) -> Iterator[np.ndarray]:
    """Blocks of about BLOCK bytes that end at a gap, so that no word is cut."""
    b, at = np.frombuffer(raw, np.uint8), 0
    while at < len(b):
        end = min(at + BLOCK, len(b))
        while end < len(b) and not _IS_GAP[b[end]]:
            gaps = np.flatnonzero(_IS_GAP[b[end : end + BLOCK]])
            end = end + int(gaps[0]) if len(gaps) else min(end + BLOCK, len(b))
        yield b[at:end]
        at = end


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of every word of the text, A-Z lower-cased, in order. Memory: one block, and 8 bytes a word."""
    out = []
    for b in _pieces((text or "").encode("utf-8", "surrogatepass")):
        inside = np.zeros(len(b) + 2, bool)
        inside[1:-1] = ~_IS_GAP[b]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        if not len(edges):
            continue
        starts, ends = edges[::2], edges[1::2]
        power, inverse = _power_tables(max(len(b), 4096))
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_LOW_BYTES[b] * power[: len(b)], out=sums[1:])
        out.append(_mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


_PLACE = _mix(np.arange(11, 11 + 64, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles of ``width`` words as sorted 63-bit hashes; a shorter text is one shingle, an empty one none."""
    w = word_hashes(text)
    if not len(w):
        return np.zeros(0, np.int64)
    size = min(width, len(w))
    rows = len(w) - size + 1
    total = np.full(rows, np.uint64(size), np.uint64)
    for k in range(size):
        total += w[k : k + rows] * _PLACE[k]
    return np.unique((_mix(total) >> np.uint64(1)).astype(np.int64))


def digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()
