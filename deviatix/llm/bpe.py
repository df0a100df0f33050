"""BPE encoding and decoding by forced-boundary splitting, exact with the tokenizers library."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import PieceTable, blocks, code_points, contractions, padded, spread, utf8_column

#: Bytes of texts that are cut and looked up at once; longer texts are worked on in parts of about this size.
BLOCK = 1 << 20
#: Pieces that each of a cache's two generations holds at most, and bytes from which one is not remembered.
CACHE, LONG = 80_000, 64

_WORDS = re.compile(r"[^ \t-\r]+")
#: Classes of characters that the pre-tokenizer's pattern tells apart.
LETTER, NUMBER, SPACE, OTHER, UNKNOWN = 0, 1, 2, 3, 255


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes for themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryCodec:
    """Encodes and decodes as a byte-level BPE tokenizer of the tokenizers library does.

    ``inside[a, b]`` says whether byte b follows byte a within any vocabulary token. Where it doesn't, no token can
    span the place: a certain cut. Texts are cut at every forced pair and where the pre-tokenizer's pattern begins a
    piece, for a block of texts at once; each fragment is encoded by itself with the vocabulary's merges (once, then
    looked up), and the ids of a text are those of its fragments in turn.

    The pattern's pieces follow from classes of characters (letter, number, white space, other), which the library's
    own pre-tokenizer tells, once for each code point met. Only tokenizers of that pattern, without normaliser.
    """

    def __init__(self, model_json: str):
        from tokenizers import Tokenizer

        form = json.loads(model_json)
        pre = form.get("pre_tokenizer") or {}
        if form.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space"):
            raise ValueError("byte-level BPE with the pattern of its pre-tokenizer, without normaliser or prefix space")
        self.tok = Tokenizer.from_str(model_json)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.letters = _byte_letters()
        self.letter_of = {b: c for c, b in self.letters.items()}
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.at_special = re.compile(b"|".join(re.escape(s.encode()) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        vocab = {i: t for t, i in self.tok.get_vocab(with_added_tokens=True).items()}
        bytes_of = [bytes(self.letters[c] for c in t) if (t := vocab.get(i, "")) not in self.special and all(c in self.letters for c in t) else t.encode() for i in range(max(vocab) + 1)]
        self.inside = np.zeros((256, 256), bool)
        for i, b in enumerate(bytes_of):
            if len(b) > 1 and vocab.get(i) not in self.special:
                a = np.frombuffer(b, np.uint8)
                self.inside[a[:-1], a[1:]] = True
        self.token_bytes = np.frombuffer(b"".join(bytes_of), np.uint8)
        self.token_size = np.array(list(map(len, bytes_of)), np.int64)
        self.token_at = np.cumsum(self.token_size) - self.token_size
        self.class_of = np.full(0x110000, UNKNOWN, np.uint8)
        self._learn_classes(np.arange(128))
        self.table = PieceTable(self._merged)

    def _learn_classes(self, points: np.ndarray) -> None:
        """A letter goes on with the piece of a letter, a number with that of a number, and so on."""
        split = self.tok.pre_tokenizer.pre_tokenize_str
        for p in points.tolist():
            kinds = [kind for kind, with_ in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(split(with_ + chr(p))) == 1]
            self.class_of[p] = kinds[0] if kinds else SPACE

    def _merged(self, fragment: bytes) -> list[int]:
        return [t.id for t in self.tok.model.tokenize("".join([self.letter_of[b] for b in fragment]))]

    def classes(self, data: np.ndarray, n: int) -> np.ndarray:
        """The class of each byte's character."""
        out = np.where(data[:n] < 128, self.class_of[data[:n]], np.uint8(UNKNOWN))
        at = np.flatnonzero(data[:n] >= 0xC0)
        if len(at):
            points, size = code_points(data, at)
            kind = self.class_of[points]
            if (kind == UNKNOWN).any():
                self._learn_classes(np.unique(points[kind == UNKNOWN]))
                kind = self.class_of[points]
            for k in range(4):
                own = size > k
                out[at[own] + k] = kind[own]
        return out

    def piece_starts(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where the pre-tokenizer's pieces begin. Of white space before something else the last character is a piece of
        its own, or the first of what follows if it is a blank."""
        n = len(begins)
        kind = self.classes(data, n)
        start = begins.copy()
        start[1:] |= kind[1:] != kind[:-1]
        behind = np.flatnonzero(start & ~begins & (kind != SPACE))
        behind = behind[kind[behind - 1] == SPACE]
        last = behind - 1
        while (inner := (data[last] & 0xC0) == 0x80).any():
            last = last - inner
        start[last] = True
        start[behind] = data[last] != 0x20
        contractions(data, start, begins)
        return start

    def fragments(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where fragments begin: pieces, and every forced pair."""
        start = self.piece_starts(data, begins)
        start[1:] |= ~self.inside[data[: len(begins) - 1], data[1 : len(begins)]]
        return np.flatnonzero(start)

    def encode_block(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of the texts that begin at ``at`` (their last end included)."""
        n = int(at[-1] - at[0])
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        data, at = padded(data[at[0] : at[-1]]), at - at[0]
        begins = np.zeros(n, bool)
        begins[at[:-1][at[:-1] < n]] = True
        start = self.fragments(data, begins)
        ids, count = self.table.look_up(data, start, np.diff(start, append=n))
        before = np.concatenate([[0], np.cumsum(count)])
        return ids, np.diff(before[np.searchsorted(start, at)])

    def _parts(self, data: np.ndarray, a: int, b: int) -> Iterator[tuple[int, int, int]]:
        """(start, end, special id or -1) of a text's parts: special tokens, and the blocks of what lies between."""
        ends = [] if self.at_special is None else [(m.start() + a, m.end() + a, self.special[m.group().decode()]) for m in self.at_special.finditer(data[a:b].tobytes())]
        for c, d, special in [*ends, (b, b, -1)]:
            for x, y in blocks(data, a, c, BLOCK):
                yield x, y, -1
            if d > c:
                yield c, d, special
            a = d

    def encode(self, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, one behind the last, ids, number of ids of each) for runs of texts of about a block."""
        odd = np.zeros(len(at) - 1, bool)
        odd[np.diff(at) > BLOCK] = True
        if self.at_special is not None:
            for m in self.at_special.finditer(memoryview(data)[at[0] : at[-1]]):
                odd[np.searchsorted(at, at[0] + m.start(), "right") - 1] = True
        stops = np.flatnonzero(odd)
        a, last = 0, len(at) - 1
        while a < last:
            if odd[a]:
                ids = [np.array([s], np.uint32) if s >= 0 else self.encode_block(data, np.array([x, y]))[0] for x, y, s in self._parts(data, int(at[a]), int(at[a + 1]))]
                ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
                yield a, a + 1, ids, np.array([len(ids)])
                a += 1
            else:
                k = np.searchsorted(stops, a)
                b = min(int(stops[k]) if k < len(stops) else last, max(a + 1, int(np.searchsorted(at, at[a] + BLOCK, "right")) - 1))
                yield a, b, *self.encode_block(data, at[a : b + 1])
                a = b

    def decode(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the decoded texts, offsets)."""
        size = self.token_size[ids]
        parts = [self.token_bytes[spread(self.token_at[ids[a : a + BLOCK]], size[a : a + BLOCK])] for a in range(0, len(ids), BLOCK)]
        ends = np.concatenate([[0], np.cumsum(size)])
        return np.concatenate([np.zeros(0, np.uint8), *parts]), ends[np.concatenate([[0], np.cumsum(count)])]

    def round_trip(self, text: str) -> tuple[bytes, str]:
        """(ids as little-endian unsigned 32-bit integers, the text decoded from them)."""
        data = np.frombuffer(text.encode(), np.uint8)
        ids = [x for _, _, x, _ in self.encode(data, np.array([0, len(data)]))]
        ids = np.concatenate([np.zeros(0, np.uint32), *ids])
        return ids.astype("<u4").tobytes(), self.decode(ids, np.array([len(ids)]))[0].tobytes().decode("utf-8", "replace")


class Remembered:
    """A bounded map in two generations: when the young one is full it becomes the old one, and what is still asked for
    moves back to the young."""

    def __init__(self):
        self.young: dict = {}
        self.old: dict = {}

    def look_up(self, keys: list) -> tuple[list, list]:
        """(values, None where unknown; the distinct unknown keys)."""
        found, unknown = list(map(self.young.get, keys)), {}
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    key = keys[i]
                    if (y := self.old.get(key)) is None:
                        unknown[key] = None
                    else:
                        found[i] = self.young[key] = y
        return found, list(unknown)

    def put(self, items: dict) -> None:
        if len(self.young) + len(items) > CACHE:
            self.old, self.young = self.young, {}
        self.young.update((k, x) for k, x in items.items() if len(k) < LONG)


#: The split of lower-cased text that one family of tokenizers states (as their files write it). Fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Latin letters end before this code point; below it that split and lower-casing treat texts letter by letter.
LATIN = 0x180


class WordCodec:
    """Encodes with any tokenizer of the library whose pre-tokenizer drops white space: words between ASCII spaces are
    independent, so each distinct one is encoded once and remembered in a bounded cache. Where the tokenizer lower-cases
    and splits as ``SPLIT`` says, texts of Latin letters are cut into its pieces, a block of texts at once."""

    def __init__(self, model_json: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(model_json)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.latin = SPLIT in model_json and '"Lowercase"' in model_json
        kinds = {"L": LETTER, "N": NUMBER}
        self.class_of = np.array([SPACE if chr(p) in " \t\n\r\x0b\x0c" else kinds.get(unicodedata.category(chr(p))[0], OTHER) for p in range(LATIN)], np.uint8)
        self.lower = np.array([ord(x) if len(x := chr(p).lower()) == 1 else 0 for p in range(LATIN)], np.int32)
        # characters that normalisation or white space treats by rules of its own: texts with them go word by word
        self.plain = np.ones(LATIN, bool)
        self.plain[[0x130, 0x85, 0xA0, *range(0x1C, 0x20)]] = False
        self.letter_of = {b: c for c, b in _byte_letters().items()}
        self.seen = Remembered()
        self.table = PieceTable(self._merged)

    def _merged(self, piece: bytes) -> list[int]:
        # pieces are normalised and split already: byte letters go straight to the merges
        return [t.id for t in self.tok.model.tokenize("".join([self.letter_of[b] for b in piece]))]

    def _by_words(self, text: str) -> np.ndarray:
        words = _WORDS.findall(text)
        found, unknown = self.seen.look_up(words)
        if unknown:
            new = {w: np.array(e.ids, np.uint32).tobytes() for w, e in zip(unknown, self.tok.encode_batch(unknown, add_special_tokens=False), strict=True)}
            self.seen.put(new)
            found = [new[w] if x is None else x for w, x in zip(words, found, strict=True)]
        return np.frombuffer(b"".join(found), np.uint32)

    def _latin_block(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, number of ids of each text, which texts are Latin: others get none)."""
        n = int(at[-1] - at[0])
        data, at = padded(data[at[0] : at[-1]]), at - at[0]
        odd = np.zeros(n + 1, bool)
        kind = self.class_of[np.minimum(data[:n], 127)]
        odd[:n] = (data[:n] >= 0x1C) & (data[:n] < 0x20) | (data[:n] >= 0xC6) | ((data[:n] == ord("<")) & (data[1 : n + 1] == ord("|")))
        small = self.lower[np.minimum(data, 127)].astype(np.uint8)
        first = np.flatnonzero((data[:n] >= 0xC2) & (data[:n] < 0xC6))
        small[data >= 128] = data[data >= 128]
        if len(first):
            points, _ = code_points(data, first)
            odd[first] |= ~self.plain[points]
            kind[first] = kind[first + 1] = self.class_of[points]
            low = self.lower[points]
            small[first], small[first + 1] = 0xC0 | low >> 6, 0x80 | low & 63
        before = np.concatenate([[0], np.cumsum(odd)])
        latin = before[at[1:]] == before[at[:-1]]
        begins = np.zeros(n, bool)
        begins[at[:-1][at[:-1] < n]] = True
        start = begins.copy()
        start[1:] |= (kind[1:] != kind[:-1]) | ((kind[1:] == NUMBER) & ((data[1:n] & 0xC0) != 0x80))
        contractions(small, start, begins)
        place = np.flatnonzero(start)
        size = np.diff(place, append=n)
        keep = (kind[place] != SPACE) & latin[np.searchsorted(at, place, "right") - 1]
        place, size = place[keep], size[keep]
        ids, count = self.table.look_up(small, place, size)
        before = np.concatenate([[0], np.cumsum(count)])
        return ids, np.diff(before[np.searchsorted(place, at)]), latin

    def encode_texts(self, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, one behind the last, ids, number of ids of each) for runs of texts of about a block."""
        a, last = 0, len(at) - 1
        while a < last:
            b = max(a + 1, int(np.searchsorted(at, at[a] + BLOCK, "right")) - 1)
            # a longer text is the ids of its blocks in turn
            cuts = at[a : b + 1] if at[b] - at[a] <= BLOCK else np.array([at[a], *[y for _, y in blocks(data, int(at[a]), int(at[b]), BLOCK)]])
            parts = []
            for lo, hi in [(0, len(cuts) - 1)] if len(cuts) == b - a + 1 else [(k, k + 1) for k in range(len(cuts) - 1)]:
                ids, count, latin = self._latin_block(data, cuts[lo : hi + 1]) if self.latin and cuts[hi] > cuts[lo] else (np.zeros(0, np.uint32), np.zeros(hi - lo, np.int64), np.zeros(hi - lo, bool))
                ends = np.concatenate([[0], np.cumsum(count)])
                if latin.all():
                    parts.append((ids, count))
                    continue
                own = [ids[ends[k] : ends[k + 1]] if latin[k] else self._by_words(data[cuts[lo + k] : cuts[lo + k + 1]].tobytes().decode("utf-8", "replace")) for k in range(hi - lo)]
                parts.append((np.concatenate(own), np.array(list(map(len, own)))))
            ids, count = np.concatenate([x for x, _ in parts]), parts[0][1] if len(parts) == 1 else np.array([sum(len(x) for x, _ in parts)])
            yield a, b, ids, count
            a = b

    def encode(self, text: str) -> bytes:
        data = np.frombuffer(text.encode(), np.uint8)
        return b"".join(ids.astype("<u4").tobytes() for _, _, ids, _ in self.encode_texts(data, np.array([0, len(data)])))


@lru_cache(2)
def codec(kind: type, model_json: str):
    """One per worker process."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return kind(model_json)


def shipped(spark: SparkSession, path: str):
    """The tokenizer file (a few MB at most) as a broadcast variable: executors need no file of their own."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id``, ``n_tokens``, ``ids`` (binary: little-endian unsigned 32-bit), ``decoded``.

    No shuffle. Null text: as empty, no ids. Special tokens' strings in a text become their ids, as in the library.
    A very long text is encoded whole, chunk by chunk. Repeated rows and null ids each get their row.
    """
    import pyarrow as pa

    model = shipped(docs.sparkSession, tokenizer_path)
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ForcedBoundaryCodec, model.value)
        for batch in batches:
            data, at = utf8_column(batch.column(1))
            for a, b, ids, count in own.encode(data, at):
                text, ends = own.decode(ids, count)
                places = np.concatenate([[0], np.cumsum(4 * count)])
                columns = [
                    batch.column(0).slice(a, b - a),
                    pa.array(count, pa.int64()),
                    _binary(places, ids.astype("<u4")),
                    _text(ends, text, lossless=len(text) == at[b] - at[a] and bool((text == data[at[a] : at[b]]).all())),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def _binary(ends: np.ndarray, values: np.ndarray):
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])

    def _text(ends: np.ndarray, text: np.ndarray, lossless: bool):
        out = _binary(ends, text)
        # bytes that are no UTF-8 decode to the replacement character
        return out.view(pa.string()) if lossless else pa.array([x.as_py().decode("utf-8", "replace") for x in out], pa.string())

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n_tokens long, ids binary, decoded string")
