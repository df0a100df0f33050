"""Token-id files of directly addressable codes: any token can be read without decoding a block.

A shard is a run of segments and a footer. A segment holds whole documents: their ids and token starts, and the
tokens' ids split into chunks of 8 bits. Level l has the (l+1)th chunk of each id that has more than l chunks, in
order, a bitmap of which of them continue on the next level, and a directory with the count of set bits before each
block of 512. The place of token i on the next level is rank(bitmap, i), so a token costs one byte, one bit and one
rank for each of its levels. A run of tokens is a contiguous run on every level.

Segment: header (magic, documents, tokens, levels), int64 document ids, uint8 nulls, uint64 starts (documents + 1),
and per level uint64 n, n bytes of chunks, bitmap padded to whole blocks of 64 bytes, uint64 rank directory.
Footer: per segment int64 (offset, tokens before it); then count and magic.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import WordCodec, codec, shipped
from .common import hf_path, new_dir, written
from .pieces import spread, utf8_column

MAGIC = b"DACT"
HEADER, HEADER_SIZE = "<4sQQI", 24
FOOTER, FOOTER_SIZE = "<I4s", 8
BLOCK = 512
#: Tokens from which a segment is closed, at the end of a document: bounds the writer's memory.
SEGMENT = 1 << 21
#: Bytes of rows that a task hands back at a time.
OUT_BYTES = 4 << 20


def pack_segment(doc_ids: list, counts: list[int], ids: np.ndarray) -> bytes:
    """Bytes of one segment."""
    starts = np.zeros(len(counts) + 1, "<u8")
    np.cumsum(counts, out=starts[1:])
    out = [np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(), starts.tobytes()]
    levels, rest = 0, ids.astype("<u4")
    while levels == 0 or len(rest):
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % (BLOCK // 8)))
        per_block = np.unpackbits(bits).reshape(-1, BLOCK).sum(1, dtype=np.uint64) if len(bits) else np.zeros(0, np.uint64)
        ranks = np.concatenate([[0], np.cumsum(per_block)]).astype("<u8")
        out += [np.uint64(len(rest)).tobytes(), rest.astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()]
        rest, levels = rest[more] >> 8, levels + 1
    return b"".join([struct.pack(HEADER, MAGIC, len(doc_ids), len(ids), levels), *out])


class SegmentReader:
    """Random access to a segment at ``base`` of an open file with seek and read."""

    def __init__(self, file, base: int = 0):
        self.file = file
        file.seek(base)
        magic, self.n_docs, self.n_tokens, levels = struct.unpack(HEADER, file.read(HEADER_SIZE))
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = base + HEADER_SIZE
        self.doc_ids, self.nulls, self.starts = (np.frombuffer(self._at(a, n * w), t) for a, n, w, t in ((at, self.n_docs, 8, "<i8"), (at + 8 * self.n_docs, self.n_docs, 1, np.uint8), (at + 9 * self.n_docs, self.n_docs + 1, 8, "<u8")))
        at += 9 * self.n_docs + 8 * (self.n_docs + 1)
        self.levels: list[tuple[int, int, int]] = []  # where chunks, bitmap and directory begin
        for _ in range(levels):
            n = int(np.frombuffer(self._at(at, 8), "<u8")[0])
            bitmap = at + 8 + n
            blocks = -(-n // BLOCK)
            self.levels.append((at + 8, bitmap, bitmap + blocks * BLOCK // 8))
            at = bitmap + blocks * BLOCK // 8 + 8 * (blocks + 1)

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _rank(self, level: int, i: int) -> int:
        """Set bits before i: one directory entry and at most one block."""
        _, bitmap, directory = self.levels[level]
        block = i // BLOCK
        before = int(np.frombuffer(self._at(directory + 8 * block, 8), "<u8")[0])
        first = np.frombuffer(self._at(bitmap + block * BLOCK // 8, -(-(i % BLOCK) // 8)), np.uint8)
        return before + int(np.unpackbits(first, bitorder="little")[: i % BLOCK].sum())

    def token(self, i: int) -> int:
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            value |= self._at(chunks + i, 1)[0] << 8 * level
            if not self._at(bitmap + i // 8, 1)[0] >> i % 8 & 1:
                break
            i = self._rank(level, i)
        return value

    def tokens(self, a: int, b: int) -> np.ndarray:
        """ids of [a, b): on each level a contiguous run, found by one rank."""
        value = np.zeros(max(0, b - a), "<u4")
        rows = np.arange(len(value))
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            if a >= b:
                break
            value[rows] |= np.frombuffer(self._at(chunks + a, b - a), np.uint8).astype(np.uint32) << np.uint32(8 * level)
            bits = np.unpackbits(np.frombuffer(self._at(bitmap + a // 8, -(-b // 8) - a // 8), np.uint8), bitorder="little")[a % 8 :][: b - a].astype(bool)
            rows, n = rows[bits], int(bits.sum())
            if n:
                a = self._rank(level, a)
            b = a + n if n else a
        return value


def segments(file, size: int) -> list[tuple[int, int]]:
    """(offset, tokens before it) of a shard's segments, from its footer."""
    file.seek(size - FOOTER_SIZE)
    n, magic = struct.unpack(FOOTER, file.read(FOOTER_SIZE))
    if magic != MAGIC:
        raise ValueError("not a token shard")
    file.seek(size - FOOTER_SIZE - 16 * n)
    return [tuple(map(int, x)) for x in np.frombuffer(file.read(16 * n), "<i8").reshape(n, 2)]


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes all texts and writes shards in ascending id order; returns the manifest: part, path, n_docs, n_tokens.

    Range partitions by id are the shards: one streaming pass each, a segment of ids in memory. Every attempt writes a
    file of its own name and only files of committed tasks are in the manifest, so lost executors do no harm. Nulls
    come first, repeated ids are ordered by their texts' hash. Null text: the end id alone.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    model, folder = shipped(spark, tokenizer_path), new_dir(spark, "token-shards")
    fs, path = hf_path(folder)
    fs.create_dir(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part = codec(WordCodec, model.value), TaskContext.get().partitionId()
        name = f"{folder}/{part:06d}-{uuid.uuid4().hex}.dac"
        out, index, n_docs, n_tokens, size = None, [], 0, 0, 0
        ids, counts, doc_ids, held = [], [], [], 0

        def close() -> None:
            nonlocal out, size, n_docs, n_tokens, ids, counts, doc_ids, held
            if out is None:
                fs, path = hf_path(name)
                out = fs.open_output_stream(path)
            data = pack_segment(doc_ids, counts, np.concatenate(ids))
            out.write(data)
            index.append((size, n_tokens))
            size, n_docs, n_tokens = size + len(data), n_docs + len(counts), n_tokens + held
            ids, counts, doc_ids, held = [], [], [], 0
            pa.default_memory_pool().release_unused()

        for batch in batches:
            names = batch.column(0).to_pylist()
            data, at = utf8_column(batch.column(1))
            for a, b, code, count in own.encode_texts(data, at):
                ids.append(np.insert(code, np.cumsum(count), end_id))
                counts += (count + 1).tolist()
                doc_ids += names[a:b]
                held += len(ids[-1])
                if held >= SEGMENT:
                    close()
        if held:
            close()
        if out is not None:
            out.write(np.array(index, "<i8").tobytes() + struct.pack(FOOTER, len(index), MAGIC))
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [name], "n_docs": [n_docs], "n_tokens": [n_tokens]}, pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = own.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"))
    return written(ordered.mapInArrow(run, "part long, path string, n_docs long, n_tokens long"), "token-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: ``id``, ``start`` (tokens of all documents before it), ``n_tokens``, ``ids``
    (binary: little-endian unsigned 32-bit). The running sum is over the manifest's few rows, one per shard."""
    import pyarrow as pa

    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shards = manifest.select("path", F.coalesce(before, F.lit(0)).alias("before"))
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = hf_path(name)
                with fs.open_input_file(path) as file:
                    rows, held = [], 0
                    index = segments(file, file.size())
                    ends = [offset for offset, _ in index[1:]] + [file.size() - FOOTER_SIZE - 16 * len(index)]
                    for (offset, tokens_before), end in zip(index, ends, strict=True):
                        file.seek(offset)
                        seg = SegmentReader(io.BytesIO(file.read(end - offset)))  # all of its documents are asked for
                        for k in range(seg.n_docs):
                            a, b = int(seg.starts[k]), int(seg.starts[k + 1])
                            rows.append((None if seg.nulls[k] else int(seg.doc_ids[k]), first + tokens_before + a, b - a, seg.tokens(a, b).tobytes()))
                            held += 4 * (b - a)
                            if held > OUT_BYTES:
                                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                                rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    spread = shards.repartition(max(1, manifest.count()))  # a shard a task
    return spread.mapInArrow(run, "id long, start long, n_tokens long, ids binary")
