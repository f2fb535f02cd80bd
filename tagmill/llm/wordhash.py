"""64-bit hashes of all words of many texts at once, in numpy, without a Python loop over words.

The texts of a chunk stand in one byte array. Prefix sums of byte code times P^position give the hash of any span as
a difference times P^-start, so every word costs a few array operations. What separates words is a translation table that
maps separators to a space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Separators: ASCII white space; A-Z become a-z, all other bytes stay.
BLANK_WORDS = bytes(0x20 if c == 0x20 or 0x09 <= c <= 0x0D else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
#: Separators: all ASCII but digits and letters; A-Z become a-z.
PLAIN_WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
CHUNK_BYTES = 1 << 19


def splitmix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.ones(n, np.uint64)
    done, step = 1, np.uint64(base)
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * step
        done, step = done + more, step * step
    return out


class Hasher:
    def __init__(self, separators: bytes, seed: int = 1):
        self.separators = separators
        with np.errstate(over="ignore"):
            self.codes = splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        self.base = 0xD6E8FEB86659FD93
        self.inverse = pow(self.base, -1, 1 << 64)
        self.ahead = self.back = np.ones(1, np.uint64)

    def words(self, texts: list[bytes], heads: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray] | tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Hashes of the words of all texts in order; counts of words per text.

        With heads, also for each length in bytes: the hashes of the first so many bytes of the words that are longer, and which words these are."""
        data = np.frombuffer(b" ".join(texts).translate(self.separators), np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.last = data, np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(data):
            none = np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
            return (*none, [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * len(heads)) if heads else none
        if len(self.ahead) < len(data) + 1:
            with np.errstate(over="ignore"):
                self.ahead, self.back = powers(self.base, len(data) + 1), powers(self.inverse, len(data) + 1)
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = data != 0x20
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(self.codes[data] * self.ahead[: len(data)], out=sums[1:])
            hashes = splitmix((sums[ends] - sums[starts]) * self.back[starts])
            begun = []
            for n in heads:
                longer = np.flatnonzero(ends - starts > n)
                at = starts[longer]
                begun.append((splitmix((sums[at + n] - sums[at]) * self.back[at] + np.uint64(n)), longer))
        # text k starts after the texts before it and as many joining blanks
        begins = np.concatenate([[0], np.cumsum(lengths + 1)])
        counts = np.diff(np.searchsorted(starts, begins))
        self.last = data, starts, ends
        return (hashes, counts, begun) if heads else (hashes, counts)

    def last_bytes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the words hashed last: their last n bytes in order (an array (n, words), right-aligned), and how many there are."""
        data, starts, ends = self.last
        held = np.minimum(ends - starts, n)
        return np.stack([data[np.maximum(ends - n + k, starts)] for k in range(n)]), held


def utf8(values: pa.Array) -> list[bytes]:
    """Null as the empty text."""
    return [x or b"" for x in values.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts): of about most bytes together, a longer text alone."""
    at, held, size = 0, [], 0
    for k, t in enumerate(texts):
        if held and size + len(t) > most:
            yield at, held
            at, held, size = k, [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield at, held


def grams(hashes: np.ndarray, counts: np.ndarray, n: int, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n words that stand step apart, for all places where they stand in one text; the text of each."""
    owner = np.repeat(np.arange(len(counts)), counts)
    reach = (n - 1) * step
    size = len(hashes) - reach
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        out = np.full(size, np.uint64(n * 131 + step))
        for k in range(n):
            out = splitmix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k * step : k * step + size])
    same = owner[:size] == owner[reach:]
    return out[same], owner[:size][same]
