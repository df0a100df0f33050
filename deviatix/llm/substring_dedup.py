"""Substring dedup: every word that a repeated window of words covers goes. A count-min sketch says which windows may
repeat; only those are grouped exactly."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import PAD, spread
from .units import REQUEST, UNIT_BYTES, Answers, Unit, answered, answers, cuts, documents, each_unit, pack_ascending, packed, requests, unpack_ascending

U = np.uint64
#: Rows of the sketch, each with hashes of its own.
SKETCH_ROWS = 2
#: Cells of a sketch row that one task merges at most, and exact keys that it groups on average.
BLOCK_CELL_BITS, BLOCK_KEYS = 24, 1 << 20
#: A text of so many bytes has at least one cell of each row, which are 8 to 16 cells a window of usual words.
BYTES_A_CELL = 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(32)
    return x


@lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each word, its bytes, words of each text) where texts begin and end at ``at``."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = (data != 32) & ((data < 9) | (data > 13))
    begins = np.zeros(n + 1, bool)
    begins[at] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | begins[1:]
    stop = np.zeros(n + 1, bool)
    stop[1:] = inside[:-1] & (~inside[1:] | begins[1:])
    first = np.flatnonzero(start)
    return first, np.flatnonzero(stop) - first, np.diff(np.searchsorted(first, at))


def word_hashes(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word's bytes."""
    padded = np.concatenate([data, np.zeros(PAD, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    one, two = mixed(size.astype(U) + U(1)), mixed(size.astype(U) + U(0x5851F42D4C957F2D))
    own, k = np.arange(len(first)), 0
    while len(own):
        left = size[own] - 8 * k
        chunk = eight[first[own] + 8 * k]
        short = left < 8
        chunk[short] &= (U(1) << (U(8) * left[short].astype(U))) - U(1)
        one[own] = mixed(one[own] ^ chunk)
        two[own] = mixed((two[own] + chunk) * U(0x9E3779B97F4A7C15))
        own, k = own[left > 8], k + 1
    return one, two


def window_hashes(words: tuple[np.ndarray, np.ndarray], counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each window that lies within one text, two independent hashes of its words in order)."""
    n = len(words[0])
    text = np.repeat(np.arange(len(counts)), counts)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U)
    first = np.flatnonzero(text[: n - window + 1] == text[window - 1 :])
    out = []
    for w, base in zip(words, (0x2545F4914F6CDD1D, 0xDA942042E4DD58B5), strict=True):
        inverse = pow(base, -1, 1 << 64)
        sums = np.concatenate([[U(0)], np.cumsum(w * _powers(base, n))])
        out.append(mixed((sums[first + window] - sums[first]) * _powers(inverse, n)[first]))
    return first, *out


class Windows:
    """The windows of a unit, and what it asks about them."""

    def __init__(self, unit: Unit, window: int):
        self.first_byte, self.size, self.counts = words_of(unit.data, unit.at)
        self.first, self.one, self.two = window_hashes(word_hashes(unit.data, self.first_byte, self.size), self.counts, window)

    def cells(self, row: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct cells of a sketch row, place of each window's cell among them, windows in each)."""
        return _distinct(((self.one, self.two)[row % 2] * U(2 * (row // 2) + 1)) >> U(64 - bits))

    def keys(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(the two parts of the distinct 128-bit keys of the windows ``own``, place of each window's key, windows of each)."""
        one, two = self.one[own], self.two[own]
        order = np.argsort(one, kind="stable")
        a, b = one[order], two[order]
        tied = np.flatnonzero(a[1:] == a[:-1])
        if len(tied) and (b[tied] != b[tied + 1]).any():
            order = np.lexsort((two, one))
            a, b = one[order], two[order]
        new = np.ones(len(own), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        place = np.empty(len(own), np.int64)
        place[order] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        return a[at], b[at], place, np.diff(at, append=len(own))


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(values)
    ranked = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    place = np.empty(len(values), np.int64)
    place[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return ranked[at], place, np.diff(at, append=len(values))


def _bits(found) -> dict[int, np.ndarray]:
    """block -> whether each entry that the unit asked about there is held elsewhere too."""
    if found is None:
        return {}
    blocks, bodies = found
    return {b: np.unpackbits(np.frombuffer(body, np.uint8)).astype(bool) for b, body in zip(blocks.to_pylist(), bodies.to_pylist(), strict=True)}


def _asked(blocks: np.ndarray, bits: dict[int, np.ndarray], offset: int = 0) -> np.ndarray:
    """The answers to entries whose (sorted) blocks these are."""
    out = np.zeros(len(blocks), bool)
    for a, b in cuts(blocks):
        out[a:b] = bits[int(blocks[a]) + offset][: b - a]
    return out


class Repeats:
    """What all passes over the units share: parameters, and the answers so far."""

    def __init__(self, window: int, total_bytes: int, rows: int):
        self.window, self.rows = window, rows
        self.bits = min(60, max(8, (total_bytes // BYTES_A_CELL).bit_length()))
        self.block_bits = max(0, self.bits - BLOCK_CELL_BITS)

    def cell_requests(self, unit: Unit) -> Iterator[tuple[int, int, int, bytes]]:
        """(block, unit, entries, body): the cells that the unit's windows meet, of each sketch row and range of cells."""
        w = Windows(unit, self.window)
        shift = U(self.bits - self.block_bits)
        for row in range(self.rows if len(w.first) else 0):
            cells, _, _ = w.cells(row, self.bits)
            blocks = (cells >> shift).astype(np.int64)
            within = cells & ((U(1) << shift) - U(1))
            for a, b in cuts(blocks):
                yield (row << self.block_bits) + int(blocks[a]), unit.number, b - a, pack_ascending(within[a:b])

    def repeated_cells(self, bodies: list[bytes]) -> list[bytes]:
        """Merges the units' parts of a block of cells: counts that end at two, and for each part which are there."""
        count = np.zeros(1 << (self.bits - self.block_bits), np.uint8)
        for body in bodies:
            own = unpack_ascending(body)
            count[own] += count[own] < 2
        return [np.packbits(count[unpack_ascending(body)] > 1).tobytes() for body in bodies]

    def candidates(self, w: Windows, found) -> np.ndarray:
        """The windows whose count the sketch estimates at two or more: no repeated one is missing."""
        likely = np.ones(len(w.first), bool)
        bits, shift = _bits(found), U(self.bits - self.block_bits)
        for row in range(self.rows if len(w.first) else 0):
            cells, place, count = w.cells(row, self.bits)
            twice = _asked((cells >> shift).astype(np.int64), bits, row << self.block_bits) | (count > 1)
            likely &= twice[place]
        return np.flatnonzero(likely)

    def key_requests(self, unit: Unit, found, key_bits: int) -> Iterator[tuple[int, int, int, bytes]]:
        """(block, unit, entries, body): the exact keys of the candidates, 96 bits each, by their leading bits."""
        w = Windows(unit, self.window)
        one, two, _, _ = w.keys(self.candidates(w, found))
        blocks = (one >> U(64 - key_bits)).astype(np.int64) if key_bits else np.zeros(len(one), np.int64)
        for a, b in cuts(blocks):
            yield int(blocks[a]), unit.number, b - a, one[a:b].astype("<u8").tobytes() + (two[a:b] >> U(32)).astype("<u4").tobytes()

    @staticmethod
    def repeated_keys(bodies: list[bytes]) -> list[bytes]:
        """Which keys of each part are in another part too."""
        sizes = [len(body) // 12 for body in bodies]
        one = np.concatenate([np.frombuffer(body, "<u8", n) for body, n in zip(bodies, sizes, strict=True)])
        two = np.concatenate([np.frombuffer(body, "<u4", n, 8 * n) for body, n in zip(bodies, sizes, strict=True)])
        order = np.lexsort((two, one))
        same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
        twice = np.zeros(len(one), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        ends = np.cumsum(sizes)
        return [np.packbits(twice[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)]

    def removed(self, unit: Unit, found_cells, found_keys, key_bits: int) -> tuple[Windows, np.ndarray]:
        """(the unit's windows, which of its words a repeated window covers)."""
        w = Windows(unit, self.window)
        own = self.candidates(w, found_cells)
        one, _, place, count = w.keys(own)
        blocks = (one >> U(64 - key_bits)).astype(np.int64) if key_bits else np.zeros(len(one), np.int64)
        twice = _asked(blocks, _bits(found_keys)) | (count > 1)
        at = w.first[own[twice[place]]]
        edge = np.zeros(len(w.size) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.window, -1)
        return w, np.cumsum(edge[:-1]) > 0


def kept_texts(unit: Unit, w: Windows, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets of the kept words joined by one space, removed words) of each text."""
    ends = np.concatenate([[0], np.cumsum(w.counts)])
    before = np.concatenate([[0], np.cumsum(gone)])
    removed = before[ends[1:]] - before[ends[:-1]]
    stay = ~gone
    text = np.repeat(np.arange(len(w.counts)), w.counts)[stay]
    size, first = w.size[stay], w.first_byte[stay]
    last = np.ones(len(text), bool)
    last[:-1] = text[1:] != text[:-1]
    step = size + ~last
    place = np.cumsum(step) - step
    out = np.full(int(step.sum()), 32, np.uint8)
    out[spread(place, size)] = unit.data[spread(first, size)]
    per_text = np.bincount(text, weights=step, minlength=len(w.counts)).astype(np.int64)
    return out, np.concatenate([[0], np.cumsum(per_text)]), removed


def drop_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, unit_bytes: int = UNIT_BYTES, rows: int = SKETCH_ROWS) -> DataFrame:
    """One row per input row: ``id``, ``n_words``, ``n_removed``, ``kept`` (the other words, joined by one space).

    A window is ``window`` consecutive words of a text; one whose words start in order anywhere else too loses all of
    them. Three passes over the texts, which are packed to units and stay where they are:

    1. Each unit's count-min sketch (``rows`` rows of about a cell for each byte of all texts) is cut by ranges of
       cells and travels as ascending cell numbers, some two bytes a window and row. The task of a range merges the
       units' parts to counts that end at two, and answers each with a bit for each of its cells. Counts are
       overestimates, so a repeated window is never missed.
    2. Of the windows estimated repeated, and only those, the exact keys (the leading 96 of 128 hash bits) are sent
       likewise and grouped; the answer says which are in another unit too. The width of the sketch grows with the texts,
       so the share of windows sent for nothing doesn't.
    3. Repeated windows mark their words.

    A key is sent once by each unit, however often it stands there: what a task gets of a hot window is a row for
    each unit. Null or empty texts have no words. Repeated rows and ids are documents of their own, which repeat each
    other; null ids get their rows; other columns are ignored; an empty table gives no rows.
    """
    import pyarrow as pa

    units = packed(docs, id_col, text_col, unit_bytes)
    total = units.agg(F.sum("bytes")).first()[0] or 0
    own = Repeats(window, total, rows)
    flat = documents(units)
    cells = answers(answered(flat.mapInArrow(lambda batches: requests(own.cell_requests, batches), REQUEST), own.repeated_cells))

    def exact(key_bits: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = Answers(cells, ["block", "body"])
            yield from requests(lambda unit: own.key_requests(unit, found.of(unit.number), key_bits), batches)

        return run

    # keys are a tenth of the bytes at most, and as many as there are bytes at worst
    key_bits = max(0, (total // 8 // BLOCK_KEYS).bit_length())
    keys = answers(answered(flat.mapInArrow(exact(key_bits), REQUEST), own.repeated_keys))

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_cells, found_keys = Answers(cells, ["block", "body"]), Answers(keys, ["block", "body"])
        for unit in each_unit(batches):
            w, gone = own.removed(unit, found_cells.of(unit.number), found_keys.of(unit.number), key_bits)
            data, ends, removed = kept_texts(unit, w, gone)
            texts = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)]).view(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([unit.ids, pa.array(w.counts, pa.int64()), pa.array(removed, pa.int64()), texts], names=["id", "n_words", "n_removed", "kept"])

    return flat.mapInArrow(result, "id long, n_words long, n_removed long, kept string")
