"""Words of whole texts as 64-bit hashes, in numpy, straight from Arrow's buffers."""
from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time.
CHUNK = 1 << 20
_ONE = np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """base**i and base**-i modulo 2**64, as far as asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            for name, b in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                a = np.full(size, b, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


_BYTE, _WORD = _Powers(0x9E3779B97F4A7C15), _Powers(0xD1342543DE82EF95)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_RANDOM = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWER = _RANDOM.copy()
_LOWER[65:91] = _RANDOM[97:123]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: empty) and each text's end in them, with 0 in front."""
    c = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
    data = np.frombuffer(c.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def bounds(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words' first bytes, the bytes after their last, and each text's first word with the number of words behind."""
    word = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[ends] = True
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1] | first[1:-1]
    end[:-1] &= ~word[1:] | first[1:-1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, ends)


def hashes(data: np.ndarray, ends: np.ndarray, lower: bool = False, tail: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, index of each text's first word and the count behind, hash of its last `tail` bytes)."""
    found, tails, count, at = [], [], [np.zeros(1, np.int64)], 0
    table = _LOWER if lower else _RANDOM
    while at < len(ends) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, side="right")) - 1)
        d = data[ends[at] : ends[to]]
        starts, stops, index = bounds(d, ends[at : to + 1] - ends[at])
        up, down = _BYTE.to(len(d) + 1)
        total = np.zeros(len(d) + 1, np.uint64)
        np.cumsum(table[d] * up[: len(d)], out=total[1:])
        found.append(mix((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64)))
        if tail:
            near = np.maximum(starts, stops - tail)
            tails.append(mix((total[stops] - total[near]) * down[near]))
        count.append(index[1:] + count[-1][-1])
        at = to
    h = np.concatenate(found) if found else np.zeros(0, np.uint64)
    return h, np.concatenate(count), np.concatenate(tails) if tails else h


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n words in a row; the caller drops those that cross texts."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    up, down = _WORD.to(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(h) - n + 1])


def inside(index: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts with their first words at `index`: starts of all n words in a row within one text, and whose they are."""
    size = np.maximum(0, np.diff(index) - n + 1)
    own = np.repeat(np.arange(len(size)), size)
    first = np.concatenate([[0], np.cumsum(size)])[:-1]
    return np.arange(size.sum()) - first[own] + index[:-1][own], own


def by(*keys: np.ndarray) -> np.ndarray:
    """The order by the last key, then by the ones before it, as np.lexsort; later keys are small numbers, which numpy's
    stable sort takes in linear time where they have two bytes."""
    order = np.argsort(keys[0])
    for k in keys[1:]:
        k = k.astype(np.uint16) if len(k) and k.max() < 1 << 16 else k
        order = order[np.argsort(k[order], kind="stable")]
    return order
