"""Alignment of two tokenizers' tokens by products of sparse incidence matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import ForcedBoundaryCodec, shipped
from .pieces import PieceTable, padded, spread
from .units import REQUEST, UNIT_BYTES, Answers, Unit, answered, answers, cuts, documents, each_unit, pack_ascending, pack_numbers, packed, reports, requests, unpack_numbers

#: Bytes of text that are aligned at a time, and terms of a matrix product that are held at a time.
RUN_BYTES, TERMS = 1 << 18, 1 << 21
#: Each codec remembers up to so many fragments (a power of two) and ids: some 60 MB a worker process and codec.
SLOT_BITS, POOL = 21, 6_000_000
#: Bytes of text whose distinct pairs one task adds up, about.
BLOCK_BYTES = 1 << 25
#: The sign that stands for a space in sentencepiece's pieces. Fixed value.
BLANK = "▁"


@dataclass
class Csr:
    """A sparse matrix: the columns and values of row i stand in [start[i], start[i + 1])."""

    start: np.ndarray
    column: np.ndarray
    value: np.ndarray
    columns: int

    @classmethod
    def of(cls, row: np.ndarray, column: np.ndarray, rows: int, columns: int) -> Csr:
        """Counts of (row, column) places."""
        place = row.astype(np.int64) * columns + column
        if (place[1:] < place[:-1]).any():
            place.sort()
        at = np.flatnonzero(np.diff(place, prepend=-1))
        return cls.at(place[at], np.diff(at, append=len(place)), rows, columns)

    @classmethod
    def at(cls, place: np.ndarray, value: np.ndarray, rows: int, columns: int) -> Csr:
        """Values at ascending places, row by row."""
        row = place // max(columns, 1)
        start = np.zeros(rows + 1, np.int64)
        np.cumsum(np.bincount(row, minlength=rows), out=start[1:])
        return cls(start, place - row * columns, value, columns)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))


def _counted(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, sums of their values)."""
    if len(key) and (key[1:] < key[:-1]).any():
        order = np.argsort(key)
        key, value = key[order], value[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return key[at], np.add.reduceat(value, at) if len(at) else value[:0]


def product(a: Csr, b: Csr) -> Csr:
    """a times b by Gustavson's rows: row i is the sum of the rows of b that row i of a has, times its values. A bounded
    number of terms is held at a time; sums of a row that two parts share are added at the end."""
    terms = np.diff(b.start)[a.column]
    before = np.concatenate([[0], np.cumsum(terms)])
    row, parts, k = a.row, [], 0
    while k < len(terms):
        j = max(k + 1, int(np.searchsorted(before, before[k] + TERMS, "right")) - 1)
        part, rows, value = terms[k:j], row[k:j], a.value[k:j]
        if (part == 1).all():
            own = b.start[a.column[k:j]]
        else:
            own, rows, value = spread(b.start[a.column[k:j]], part), np.repeat(rows, part), np.repeat(value, part)
        parts.append(_counted(rows * b.columns + b.column[own], value * b.value[own]))
        k = j
    place, value = parts[0] if len(parts) == 1 else _counted(*(np.concatenate([x[i] for x in parts] or [np.zeros(0, np.int64)]) for i in (0, 1)))
    return Csr.at(place, value, len(a.start) - 1, b.columns)


class Tokens:
    """What both codecs share: a token's bytes, and one more id, ``lost``, for fragments that their tokens don't spell."""

    def _spelled(self, ids: list[int], fragment: bytes) -> list[int]:
        return ids if b"".join(map(self.bytes_of.__getitem__, ids)) == fragment else [self.lost]

    def _sizes(self, bytes_of: list[bytes]) -> None:
        self.bytes_of, self.lost = bytes_of, len(bytes_of)
        self.size = np.array([*map(len, bytes_of), 0], np.int64)


class PlainByteCodec(ForcedBoundaryCodec, Tokens):
    """Byte-level BPE to which special tokens' strings are ordinary text."""

    def __init__(self, model_json: str):
        super().__init__(model_json)
        self.at_special = None
        self._sizes([self.token_bytes[a : a + n].tobytes() for a, n in zip(self.token_at.tolist(), self.token_size.tolist(), strict=True)])
        self.table = PieceTable(self._merged, SLOT_BITS, POOL)

    def _merged(self, fragment: bytes) -> list[int]:
        return self._spelled(super()._merged(fragment), fragment)


class PieceCodec(Tokens):
    """A sentencepiece model of BPE with byte fallback, by fragments: where no piece has a byte pair inside, all texts
    are cut for certain, and each distinct fragment is encoded once by the library."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.sp = SentencePieceProcessor(model_proto=model)
        n = self.sp.get_piece_size()
        pieces = [self.sp.id_to_piece(i) for i in range(n)]
        self._sizes([bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)])
        self.inside = np.zeros((256, 256), bool)
        for i, b in enumerate(self.bytes_of):
            if len(b) > 1 and not (self.sp.is_control(i) or self.sp.is_unknown(i)):
                x = np.frombuffer(b, np.uint8)
                self.inside[x[:-1], x[1:]] = True
        blank, line = ord(" "), ord("\n")
        self.blank = self.sp.piece_to_id(BLANK)
        if self.inside[:blank, blank].any() or self.inside[blank + 1 :, blank].any() or self.inside[line].any() or self.inside[:, line].any():
            raise ValueError("a sentencepiece model whose pieces have spaces in front only and no line ends")
        self.head = self.sp.encode("\n")
        if [self.bytes_of[i] for i in self.head] != [b" ", b"\n"]:
            raise ValueError("a sentencepiece model that puts a space in front and falls back to bytes")
        self.table = PieceTable(lambda fragment: self._encoded([fragment])[0], SLOT_BITS, POOL, self._encoded)

    def _encoded(self, fragments: list[bytes]) -> list[list[int]]:
        # the library puts a space in front; what has none goes behind a line end, with which no piece goes on
        behind = [f[:1] != b" " for f in fragments]
        found = self.sp.encode(["\n" + f.decode() if b else f[1:].decode() for f, b in zip(fragments, behind, strict=True)])
        ids = [x[len(self.head) :] if b else x for x, b in zip(found, behind, strict=True)]
        return [self._spelled(x or [self.blank], f) for x, f in zip(ids, fragments, strict=True)]

    def encode_block(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of the texts between the places ``at``."""
        n = int(at[-1])
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        data = padded(data[:n])
        start = np.zeros(n, bool)
        start[1:] = ~self.inside[data[: n - 1], data[1:n]] & ((data[1:n] & 0xC0) != 0x80)
        start[at[:-1][at[:-1] < n]] = True
        place = np.flatnonzero(start)
        ids, count = self.table.look_up(data, place, np.diff(place, append=n))
        before = np.concatenate([[0], np.cumsum(count)])
        return ids, np.diff(before[np.searchsorted(place, at)])


@lru_cache(1)
def _codecs(model_a: str, model_b: bytes) -> tuple[PlainByteCodec, PieceCodec]:
    """One pair per worker process."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return PlainByteCodec(model_a), PieceCodec(model_b)


def spaced(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space before each that isn't empty."""
    size = np.diff(at)
    ends = np.concatenate([[0], np.cumsum(size + (size > 0))])
    out, own = np.full(int(ends[-1]), 32, np.uint8), np.ones(int(ends[-1]), bool)
    own[ends[:-1][size > 0]] = False
    out[own] = data[at[0] : at[-1]]
    return out, ends


def parts_of(data: np.ndarray, at: np.ndarray, most: int = RUN_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(ends of parts, text of each): long texts are cut before spaces behind visible ASCII characters, where both
    tokenizers begin a token. A text without such a place is one part."""
    cut, text = [0], []
    for k in np.flatnonzero(np.diff(at)).tolist():
        a, b = int(at[k]), int(at[k + 1])
        while b - a > most:
            look, found = most, ()
            while not len(found):
                window = data[a : min(b, a + look)]
                found = np.flatnonzero((window[1:] == 32) & (window[:-1] > 32) & (window[:-1] < 127)) + 1
                if a + look >= b:
                    break
                look *= 2
            if not len(found):
                break
            a += int(found[-1])
            cut.append(a)
            text.append(k)
        cut.append(b)
        text.append(k)
    return np.array(cut), np.array(text, np.int64)


@dataclass
class Run:
    """The tokens of some parts of a unit's texts: ids, text and group of each token, which parts open their text, and the
    links: text, pair of ids, and how many pairs of tokens."""

    ids: tuple[np.ndarray, np.ndarray]
    text: tuple[np.ndarray, np.ndarray]
    group: tuple[np.ndarray, np.ndarray]
    opens: np.ndarray
    links: tuple[np.ndarray, np.ndarray, np.ndarray]


def groups_of(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of two tokenizations of the same bytes, from their overlaps.

    The product of one side's token-byte incidence with the other's byte-token incidence has the tokens that share
    bytes. A group ends where a token's last partner isn't the next one's first.
    """
    n = int(size_a.sum())
    ones = np.ones(n, np.int64)
    tokens_bytes = Csr(np.concatenate([[0], np.cumsum(size_a)]), np.arange(n), ones, n)
    bytes_tokens = Csr(np.arange(n + 1), np.repeat(np.arange(len(size_b)), size_b), ones, len(size_b))
    overlap = product(tokens_bytes, bytes_tokens)
    new = np.ones(len(size_a), bool)
    new[1:] = overlap.column[overlap.start[1:-1]] != overlap.column[overlap.start[1:-1] - 1]
    group_a = np.cumsum(new) - 1
    group_b = np.zeros(len(size_b), np.int64)
    group_b[overlap.column] = group_a[overlap.row]
    return group_a, group_b


def links_of(ids: tuple[np.ndarray, np.ndarray], text: tuple[np.ndarray, np.ndarray], group: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, id of one side, id of the other, pairs of tokens that share a group): the product of the incidence of a text's
    distinct ids in groups, one side by the other's transpose."""
    distinct, index = zip(*(np.unique(t.astype(np.int64) << 32 | i.astype(np.int64), return_inverse=True) for t, i in zip(text, ids, strict=True)), strict=True)
    groups = int(group[0][-1]) + 1 if len(group[0]) else 0
    shared = product(Csr.of(index[0], group[0], len(distinct[0]), groups), Csr.of(group[1], index[1], groups, len(distinct[1])))
    one, two = distinct[0][shared.row], distinct[1][shared.column]
    return one >> 32, one & 0xFFFFFFFF, two & 0xFFFFFFFF, shared.value


class Aligner:
    def __init__(self, model_a: str, model_b: bytes):
        self.a, self.b = _codecs(model_a, model_b)
        self.low = max(1, (self.b.lost).bit_length())

    def runs(self, unit: Unit) -> Iterator[Run | np.ndarray]:
        """Runs of the unit's parts; before each, the texts in it whose tokens don't spell them."""
        data, at = spaced(unit.data, unit.at)
        ends, text = parts_of(data, at)
        first = 0
        while first < len(text):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + RUN_BYTES, "right")) - 1)
            own, places = text[first:last], ends[first : last + 1] - ends[first]
            block = data[ends[first] : ends[last]]
            (ids_a, count_a), (ids_b, count_b) = (c.encode_block(block, places) for c in (self.a, self.b))
            part_a, part_b = (np.repeat(np.arange(len(own)), c) for c in (count_a, count_b))
            lost = np.zeros(len(own), bool)
            lost[part_a[ids_a == self.a.lost]] = True
            lost[part_b[ids_b == self.b.lost]] = True
            yield own[lost]
            if lost.any():
                keep_a, keep_b = ~lost[part_a], ~lost[part_b]
                ids_a, ids_b, part_a, part_b = ids_a[keep_a], ids_b[keep_b], part_a[keep_a], part_b[keep_b]
            if len(ids_a):
                ids, texts = (ids_a, ids_b), (own[part_a], own[part_b])
                group = groups_of(self.a.size[ids_a], self.b.size[ids_b])
                opens = np.ones(len(ids_a), bool)
                opens[1:] = texts[0][1:] != texts[0][:-1]
                opens[0] = first == 0 or text[first - 1] != texts[0][0]
                linked, one, two, many = links_of(ids, texts, group)
                yield Run(ids, texts, group, opens, (linked, one << self.low | two, many))
            first = last

    def unit_links(self, unit: Unit, take: Callable[[Run], None] = lambda run: None) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """(which texts have tokens, their links). ``take`` gets each run; but for its links, none is held."""
        spelled, whole = np.diff(unit.at) > 0, True
        parts: tuple[list[np.ndarray], ...] = ([], [], [])
        for x in self.runs(unit):
            if isinstance(x, Run):
                for part, column in zip(parts, x.links, strict=True):
                    part.append(column)
                whole &= bool(x.opens[0])
                take(x)
            else:
                spelled[x] = False
        texts, pairs, many = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in parts)
        keep = spelled[texts]
        texts, pairs, many = texts[keep], pairs[keep], many[keep]
        if whole:
            return spelled, (texts, pairs, many)
        # a long text's parts have links in common
        order = np.lexsort((pairs, texts))
        texts, pairs, many = texts[order], pairs[order], many[order]
        new = np.ones(len(texts), bool)
        new[1:] = (texts[1:] != texts[:-1]) | (pairs[1:] != pairs[:-1])
        place = np.flatnonzero(new)
        return spelled, (texts[place], pairs[place], np.add.reduceat(many, place) if len(place) else many)

    def blocks(self, pairs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(order, blocks in that order) of ascending pairs dealt by a hash."""
        block = (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(pairs), np.int64)
        order = np.argsort(block, kind="stable")
        return order, block[order]

    def pair_requests(self, unit: Unit, bits: int) -> Iterator[tuple[int, int, int, bytes]]:
        """(block, unit, entries, body): the unit's distinct pairs and in how many of its texts each is."""
        pairs, texts = np.unique(self.unit_links(unit)[1][1], return_counts=True)
        order, block = self.blocks(pairs, bits)
        pairs, texts = pairs[order], texts[order]
        for a, b in cuts(block):
            yield int(block[a]), unit.number, b - a, pack_ascending(pairs[a:b]) + pack_numbers(texts[a:b])

    def results(self, unit: Unit, found, bits: int, best: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, n_links, n_best, count_sum), and (bytes, offsets) of the groups' texts."""
        n = len(unit.at) - 1
        sums = lambda at, weights=None: _whole_sums(at, n, weights)
        counts, written = [np.zeros(n, np.int64) for _ in range(3)], []

        def take(run: Run) -> None:
            for count, own in zip(counts, (run.text[0], run.text[1], run.text[0][np.diff(run.group[0], prepend=-1) > 0]), strict=True):
                count += sums(own)
            written.append(_group_text(run, n))

        spelled, (texts, pairs, many) = self.unit_links(unit, take)
        distinct, index = np.unique(pairs, return_inverse=True)
        order, block = self.blocks(distinct, bits)
        total = np.zeros(len(distinct), np.int64)
        bodies = dict(zip(found[0].to_pylist(), found[1].to_pylist(), strict=True)) if found else {}
        for a, b in cuts(block):
            total[order[a:b]] = unpack_numbers(bodies[int(block[a])]).astype(np.int64)
        top = total == best[distinct >> self.low] if len(distinct) else total > 0
        links = [sums(texts, x) for x in (many, many * top[index], many * total[index])] if len(texts) else [np.zeros(n, np.int64)] * 3
        # a long text whose later part isn't spelled has groups of the earlier ones
        data = [x if spelled[size > 0].all() else x[np.repeat(spelled, size)] for x, size in written]
        size = np.where(spelled, sum((size for _, size in written), np.zeros(n, np.int64)), 0)
        return [*(np.where(spelled, x, 0) for x in counts), *links], np.concatenate(data or [np.zeros(0, np.uint8)]), np.concatenate([[0], np.cumsum(size)])


def _whole_sums(at: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Sums of whole numbers by place; ``at`` ascends."""
    before = np.concatenate([[0], np.cumsum(np.ones(len(at), np.int64) if weights is None else weights)])
    edges = np.searchsorted(at, np.arange(n + 1))
    return before[edges[1:]] - before[edges[:-1]]


@lru_cache(4)
def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(a row for each of 0 .. n - 1: a byte to be set and the digits, with zero bytes behind them; how many digits)."""
    rows = np.array([b"-%d" % i for i in range(n)])
    return rows.view(np.uint8).reshape(n, -1), np.char.str_len(rows) - 1


def _group_text(run: Run, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bytes of each text): ids joined by commas, the sides of a group by |, groups by ;."""
    (ids_a, ids_b), (group_a, group_b) = run.ids, run.group
    opens_a, opens_b = np.diff(group_a, prepend=-1) > 0, np.diff(group_b, prepend=-1) > 0
    # a token comes behind those of its side, and behind the other side's of earlier groups (b: of its own too)
    until_a, until_b = (np.concatenate([[0], np.cumsum(np.bincount(g))]) for g in (group_a, group_b))
    at_a = np.arange(len(ids_a)) + until_b[group_a]
    at_b = np.arange(len(ids_b)) + until_a[group_b + 1]
    total = len(ids_a) + len(ids_b)
    ids, text, mark = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total, np.uint8)
    ids[at_a], ids[at_b] = ids_a, ids_b
    text[at_a], text[at_b] = run.text
    mark[at_a] = np.where(run.opens, 0, np.where(opens_a, ord(";"), ord(",")))
    mark[at_b] = np.where(opens_b, ord("|"), ord(","))
    digits, size = _digits(1 << int(ids.max(initial=0)).bit_length())
    letters = digits.take(ids, axis=0)
    letters[:, 0] = mark
    letters = letters.ravel()
    return letters[np.flatnonzero(letters)], _whole_sums(text, n, size[ids] + (mark > 0))


def _merged(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(all distinct pairs of a block, their totals, place of each entry's pair, entries of each body)."""
    halves = [np.split(x, 2) for x in map(unpack_numbers, bodies)]
    pairs = np.concatenate([np.cumsum(a, dtype=np.uint64) for a, _ in halves]).astype(np.int64)
    distinct, index = np.unique(pairs, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, index, np.concatenate([b for _, b in halves]).astype(np.int64))
    return distinct, total, index, [len(a) for a, _ in halves]


def pair_totals(bodies: list[bytes]) -> list[bytes]:
    _, total, index, sizes = _merged(bodies)
    return [pack_numbers(x) for x in np.split(total[index], np.cumsum(sizes)[:-1])]


def highest(bodies: list[bytes], low: int) -> bytes:
    """The ids of the first side and the highest total of each in this block."""
    distinct, total, _, _ = _merged(bodies)
    one = distinct >> low
    first = np.array([a for a, _ in cuts(one)])
    return pack_ascending(one[first]) + pack_numbers(np.maximum.reduceat(total, first))


def _best_totals(reported: DataFrame, most: int) -> np.ndarray:
    """The highest total by id of the first side; 0 where it is never linked. At most ``most`` rows meet on the driver."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0).to_pylist():
                ids, top = np.split(unpack_numbers(body), 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.cumsum(ids, dtype=np.uint64).astype(np.int64)), pa.array(top.astype(np.int64))], names=["id", "top"])

    out = np.zeros(most, np.int64)
    for r in reported.select("body").mapInArrow(run, "id long, top long").groupBy("id").agg(F.max("top").alias("top")).collect():
        out[r.id] = r.top
    return out


def align(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, id_col: str = "doc_id", text_col: str = "text", unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """One row per input row: ``id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups``.

    Each text, with a space before it, is encoded by a byte-level BPE (``tokenizer_a``, a file of the tokenizers library)
    and by a sentencepiece model (``tokenizer_b``). Tokens of both sides that overlap, directly or over others, are a
    group; all pairs of a group's tokens are linked. A pair of ids counts for how many texts of the corpus have it linked:
    the units send their distinct pairs with numbers of texts to tasks that add them up, dealt by a hash of the pair, and
    get the totals back. The highest total of each id of the first side, at most one for each id of the vocabulary, is
    broadcast. ``n_best`` has the links whose pair reaches it, ``count_sum`` the totals of all links, ``groups`` the ids as
    `1,2|3;4|5,6`.

    Null and empty texts, and texts that either side's tokens don't spell (as with the sign for a space in them), have no
    tokens: zeros and an empty string. Repeated rows and ids are texts of their own; null ids get their rows; other
    columns are ignored; an empty table gives no rows. A very long text is encoded in parts.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    model_a, model_b = shipped(spark, tokenizer_a), _shipped_bytes(spark, tokenizer_b)
    units = packed(docs, id_col, text_col, unit_bytes)
    total = units.agg(F.sum("bytes")).first()[0] or 0
    bits = max(0, (total // BLOCK_BYTES).bit_length())
    flat = documents(units)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Aligner(model_a.value, model_b.value)
        yield from requests(lambda unit: own.pair_requests(unit, bits), batches)

    known = Aligner(model_a.value, model_b.value)
    low, most = known.low, known.a.lost
    totals = answers(answered(flat.mapInArrow(ask, REQUEST), pair_totals, lambda bodies: highest(bodies, low)))
    best = spark.sparkContext.broadcast(_best_totals(reports(spark, totals), most))

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, found = Aligner(model_a.value, model_b.value), Answers(totals, ["block", "body"])
        for unit in each_unit(batches):
            columns, data, ends = own.results(unit, found.of(unit.number), bits, best.value)
            texts = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)]).view(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([unit.ids, *[pa.array(c, pa.int64()) for c in columns], texts], names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    return flat.mapInArrow(result, "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")


def _shipped_bytes(spark: SparkSession, path: str):
    """The model file (some hundred KB) as a broadcast variable."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())
