"""Token ids of many short byte strings at once: texts stay the bytes of their Arrow column, strings are places in it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

U = np.uint64
#: Bytes of a string up to which it is a key of two words; longer ones are remembered one by one.
SHORT = 15
#: Slots of a table (a power of two), ids that it holds, and longer strings that are remembered: they bound its memory.
SLOT_BITS, POOL, LONG_ONES = 19, 3_000_000, 20_000
#: Zero bytes behind a text, so that words can be read at its last places.
PAD = 16
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], U)


def utf8_column(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow column of strings without a copy of them; nulls are empty."""
    import pyarrow as pa

    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), at


def padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate([data, np.zeros(PAD, np.uint8)])


def spread(offset: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places offset[k], offset[k] + 1, .. of each k, ``count[k]`` of them."""
    before = np.cumsum(count) - count
    return np.repeat(offset - before, count) + np.arange(int(count.sum()))


def blocks(data: np.ndarray, a: int, b: int, size: int) -> Iterator[tuple[int, int]]:
    """A long text [a, b) in parts of about ``size`` bytes, which end before white space behind an ASCII character that
    is none: there the pieces and words of every splitting pattern end."""
    while b - a > size:
        look, fit = size, ()
        while not len(fit):
            window = data[a : min(b, a + look)]
            blank = (window == 32) | ((window >= 9) & (window <= 13))
            fit = np.flatnonzero(blank[1:] & ~blank[:-1] & (window[:-1] < 127) & (window[:-1] > 32)) + 1
            if a + look >= b:
                break
            look *= 2
        if not len(fit):
            break
        yield a, a + int(fit[-1])
        a += int(fit[-1])
    if b > a:
        yield a, b


def code_points(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, bytes of each) of the characters beyond ASCII whose first bytes are at ``at``."""
    a, b, c, d = (data[at + k].astype(np.int32) for k in range(4))
    size = 2 + (a >= 0xE0) + (a >= 0xF0)
    b, c, d = b & 63, c & 63, d & 63
    two, three, four = (a & 31) << 6 | b, (a & 15) << 12 | b << 6 | c, (a & 7) << 18 | b << 12 | c << 6 | d
    return np.where(size == 2, two, np.where(size == 3, three, four)), size


def contractions(data: np.ndarray, start: np.ndarray, begins: np.ndarray) -> None:
    """Piece starts of 's 't 'm 'd 're 've 'll, the suffixes that a split takes whole where they begin a piece. In place.

    ``start``: where pieces begin, of which an apostrophe and the letter behind it are two. ``begins``: where texts do.
    """
    at = np.flatnonzero((data[: len(start)] == 0x27) & start)
    at = at[at + 1 < len(start)]
    at = at[~begins[at + 1]]
    one, two = data[at + 1], data[at + 2]
    size = np.where(np.isin(one, [*b"stmd"]), 2, 0)
    pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    inside = at + 2 < len(start)
    inside[inside] &= ~begins[at[inside] + 2]
    size = np.where(pair & inside, 3, size)
    at, size = at[size > 0], size[size > 0]
    start[at + 1] = False
    end = at + size
    start[end[end < len(start)]] = True


class PieceTable:
    """Ids by string, for ``encode(bytes) -> ids``. A string of up to 15 bytes is two words, looked up for all places at
    once in a table of one slot a hash; what the table doesn't hold is encoded once for each distinct string and takes
    the slot. Full pools begin anew. ``encode_all`` encodes a list of strings at once."""

    def __init__(self, encode: Callable[[bytes], list[int]], slot_bits: int = SLOT_BITS, pool: int = POOL, encode_all: Callable[[list[bytes]], list[list[int]]] | None = None):
        self.encode, self.bits, self.most = encode, slot_bits, pool
        self.encode_all = encode_all or (lambda strings: [encode(s) for s in strings])
        self.lo, self.hi = np.zeros(1 << slot_bits, U), np.zeros(1 << slot_bits, U)
        self.offset, self.count = np.zeros(1 << slot_bits, np.int32), np.zeros(1 << slot_bits, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.long: dict[bytes, tuple[int, int]] = {}

    def _store(self, ids: list[int]) -> tuple[int, int]:
        a, b = self.used, self.used + len(ids)
        if b > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        self.pool[a:b] = ids
        self.used = b
        return a, len(ids)

    def look_up(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all strings in turn, number of ids of each). ``data`` is padded."""
        if self.used > self.most or len(self.long) > LONG_ONES:
            self.hi[:] = 0
            self.used, self.long = 0, {}
        offset, count = np.zeros(len(start), np.int32), np.zeros(len(start), np.int32)
        short = size <= SHORT
        whole = bool(short.all())
        at, n = (start, size) if whole else (start[short], size[short])
        words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        lo = words[at] & _FIRST_BYTES[np.minimum(n, 8)]
        hi = (words[at + 8] & _FIRST_BYTES[np.maximum(n - 8, 0)]) | (n.astype(U) << U(56))
        slot = (((lo ^ (hi * U(0x9E3779B97F4A7C15))) * U(0xBF58476D1CE4E5B9)) >> U(64 - self.bits)).astype(np.int64)
        known = (self.lo[slot] == lo) & (self.hi[slot] == hi)
        o, c = self.offset[slot], self.count[slot]
        new = np.flatnonzero(~known)
        if len(new):
            new = new[np.lexsort((lo[new], hi[new]))]
            first = np.ones(len(new), bool)
            first[1:] = (lo[new][1:] != lo[new][:-1]) | (hi[new][1:] != hi[new][:-1])
            one = new[first]
            strings = self.encode_all([data[a : a + k].tobytes() for a, k in zip(at[one].tolist(), n[one].tolist(), strict=True)])
            found = np.array([self._store(ids) for ids in strings], np.int32).reshape(-1, 2)
            self.lo[slot[one]], self.hi[slot[one]] = lo[one], hi[one]
            self.offset[slot[one]], self.count[slot[one]] = found[:, 0], found[:, 1]
            group = np.cumsum(first) - 1
            o[new], c[new] = found[group, 0], found[group, 1]
        if whole:
            offset, count = o, c
        else:
            offset[short], count[short] = o, c
            for k in np.flatnonzero(~short).tolist():
                key = data[start[k] : start[k] + size[k]].tobytes()
                if key not in self.long:
                    self.long[key] = self._store(self.encode(key))
                offset[k], count[k] = self.long[key]
        return self.pool[spread(offset, count)], count
