"""Words of texts as 64-bit hashes, vectorised over whole batches of texts.

A word is a longest run of letters and digits of any script, compared without
case. Texts are decoded once into code points; word borders, lengths and a
polynomial rolling hash per word come from array operations, so no Python code
runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points handled at once, which bounds the memory of a worker; a longer text is a batch of its own.
BATCH_CHARS = 2_000_000
_CODES = 0x110000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Which code points belong to words, and a random value for each lower-case one."""
    in_word = np.zeros(_CODES, bool)
    lower = np.arange(_CODES, dtype=np.uint64)
    for code in range(_CODES):
        char = chr(code)
        if char.isalnum():
            in_word[code] = True
            small = char.lower()
            if small != char:
                lower[code] = ord(small[0])
    with np.errstate(over="ignore"):
        return in_word, mix64(lower * _BASE + np.uint64(1))


class _Powers:
    """Powers of the odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            size = max(n, BATCH_CHARS + 1)
            for name, factor in (("up", _BASE), ("down", inverse)):
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_POWERS = _Powers()


def joined(texts: pa.Array) -> bytes:
    """The UTF-8 bytes of a large_string array without nulls, one text after the other."""
    _, offsets, data = texts.buffers()
    spots = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return bytes(memoryview(data)[spots[0] : spots[-1]]) if data and len(texts) else b""


class Words(NamedTuple):
    """Words of consecutive texts: those of text t are ``bounds[t]`` to ``bounds[t + 1]``."""

    hashes: np.ndarray
    lengths: np.ndarray
    bounds: np.ndarray


def word_hash(word: str) -> np.uint64:
    return words_of(pa.array([word])).hashes[0]


def words_of(texts: pa.Array) -> Words:
    """Null texts have no words."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False)).astype(np.int64)
    raw = joined(texts).decode("utf-8", "surrogatepass")
    codes = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)
    in_word, values = _tables()
    inside = in_word[codes]
    n = len(codes)
    starts_at = np.zeros(n + 1, bool)
    starts_at[ends[ends < n]] = True  # a text begins: no word goes across
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    start = np.nonzero(inside & (~before | starts_at[:n]))[0]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    stop = np.nonzero(inside & (~after | starts_at[1:] | (np.arange(n) == n - 1)))[0] + 1
    up, down = _POWERS.get(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(np.where(inside, values[codes] * up[:n], np.uint64(0)), out=sums[1:])
        hashes = mix64((sums[stop] - sums[start]) * down[start])
    bounds = np.concatenate([[0], np.searchsorted(start, ends)]).astype(np.int64)
    return Words(hashes, stop - start, bounds)


def batches(texts: pa.Array, most: int = BATCH_CHARS) -> Iterator[tuple[int, pa.Array]]:
    """Runs of whole texts of at most ``most`` characters together, with their first index."""
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield first, texts.slice(first, i - first)
            first, total = i, 0
        total += int(size)
    if first < len(texts):
        yield first, texts.slice(first)
