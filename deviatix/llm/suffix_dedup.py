"""Suffix-array dedup: bytes covered by a long string that also starts earlier in the corpus are removed.

A sparse suffix array, exact for strings of ``span`` bytes. Of all windows of ``span`` bytes each has one anchor: the
leftmost of its least-hashed 36-byte grams, which depends on the window's bytes alone. Neighbouring windows share
anchors (one per 33 bytes in prose), and equal windows have equal anchors at the same offset. So only the suffixes at
anchors are sorted: a row has a word of the suffix's leading 4 bytes and 32 bits of its gram's hash, a hash of the whole
stretch that the anchor's windows cover, and its place.

Sampled splitters range-partition the rows by that whole key, place included, so that even the copies of one string are
split evenly over buckets. Each bucket is sorted by multikey quicksort: word by word, ties alone going on to the next.
A stretch equal to its predecessor is a repeat. First stretches whose gram meets another stretch, and those at a
bucket's ends, whose neighbours lie in the next bucket, are compared window by window in a second round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

GRAM = 36
#: Rows of a bucket, about: a task holds one, in some hundred MB.
BUCKET = 2_000_000
U = np.uint64
#: Odd multipliers, one per 8-byte word of a gram. Any will do.
_MULTIPLIERS = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_WORDS_AT = (0, 8, 16, 24, 28)
NULL_ID = -(1 << 63)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def gram_hashes(data: bytes) -> np.ndarray:
    """Hashes of the 36 bytes from each place on, from unaligned 8-byte words of the text."""
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    n = len(data) - GRAM + 1
    h = words[:n] * _MULTIPLIERS[0]
    for at, m in zip(_WORDS_AT[1:], _MULTIPLIERS[1:], strict=True):
        h += words[at : at + n] * m
    return _mixed(h)


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over each ``width`` neighbours, by doubling."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = op(out[: len(out) - step], out[step:])
        have += step
    return out


def anchored_stretches(h: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor) of each maximal run of windows with one anchor."""
    per = span - GRAM + 1
    least = _sliding(h, per, np.minimum)
    n = len(least)
    # places that are the least of some window
    pad = np.zeros(per - 1, U)
    places = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), per, np.maximum)[: len(h)] == h)
    # a run of windows ends where the least hash changes, or where its leftmost place drops out and an equal one follows
    ties = places[places + 1 < n] + 1
    ties = ties[least[ties] == h[ties - 1]]
    starts = np.union1d(np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1]), ties)
    at = np.searchsorted(places, starts)
    while (wrong := h[places[at]] != least[starts]).any():
        at[wrong] += 1
    return starts, np.diff(np.append(starts, n)), places[at]


def _stretch_hash(h: np.ndarray, start: np.ndarray, count: np.ndarray, anchor: np.ndarray, span: int) -> np.ndarray:
    """Of the bytes from ``start`` on that ``count`` windows cover (their grams overlap and cover all), and the offset."""
    end = start + count - 1 + span
    out = (count.astype(U) << U(32)) + (anchor - start).astype(U)
    at = [*range(0, span - GRAM, GRAM), span - GRAM]
    for k in at:
        out = _mixed(out * U(0x9E3779B97F4A7C15) + h[start + k])
    for k in at:
        out = _mixed(out * U(0x9E3779B97F4A7C15) + h[end - span + k])
    return out


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """The sorting order of rows of words: sorted by the first word; only rows that tie go on to the next."""
    order = np.argsort(columns[0], kind="quicksort")
    tied = np.arange(len(order))
    run = np.zeros(len(order), np.int64)
    for k in range(1, len(columns)):
        before = columns[k - 1][order[tied]]
        new = np.ones(len(tied), bool)
        new[1:] = (before[1:] != before[:-1]) | (run[1:] != run[:-1])
        run = np.cumsum(new)
        size = np.bincount(run)[run]
        tied, run = tied[size > 1], run[size > 1]
        if not len(tied):
            break
        rows = order[tied]
        order[tied] = rows[np.lexsort((columns[k][rows], run))]
    return order


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(all rows; the rows to analyse) with id, tie, text. Ties, texts' hashes, are made only if ids repeat."""
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text_col).cast("string").alias("text"))
    repeated = own.groupBy("id").count().where(F.col("count") > 1).limit(1).count()
    own = own.select("id", (F.xxhash64("text") if repeated else F.lit(0).cast("long")).alias("tie"), "text")
    return own, own.dropDuplicates(["id", "tie"]) if repeated else own


def anchor_rows(docs: DataFrame, span: int) -> DataFrame:
    """lead, stretch, id, tie, place: a row per anchored stretch; place is start * span + windows (fewer than span)."""
    import pyarrow as pa

    names = ["lead", "stretch", "id", "tie", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = []
            held = 0

            def out():
                rows = [pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)]
                parts.clear()
                return pa.RecordBatch.from_arrays(rows, names=names)

            for i, tie, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if len(data) < span:
                    continue
                h = gram_hashes(data)
                start, count, anchor = anchored_stretches(h, span)
                head = np.ndarray((len(data) - 3,), ">u4", data, strides=(1,))[anchor].astype(U)
                lead = ((head << U(32)) | (h[anchor] >> U(32))) ^ U(1 << 63)  # in the order of the bytes, as signed
                n = len(start)
                parts.append([lead.view(np.int64), _stretch_hash(h, start, count, anchor, span).view(np.int64), np.full(n, i), np.full(n, tie), start.astype(np.int64) * span + count])
                held += n
                if held > 50_000:
                    yield out()
                    held = 0
            if parts:
                yield out()

    return docs.select("id", "tie", "text").mapInArrow(run, "lead long, stretch long, id long, tie long, place long")


def bucket_count(docs: DataFrame, span: int) -> int:
    """Buckets for the anchors of all texts: random windows have one anchor in half their grams' number of bytes."""
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(2 * n_bytes / (span - GRAM + 1) / BUCKET))


def sorted_buckets(rows: DataFrame, span: int, buckets: int) -> DataFrame:
    """id, tie, start, windows, again: repeats of an earlier stretch (again), and first ones to compare by windows."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = list(batches)  # bounded: the splitters part even equal suffixes
        if not bucket:
            return
        lead, stretch, ids, tie, place = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in bucket]) for k in range(5))
        bucket.clear()
        order = multikey_order([lead, stretch, ids, tie, place])
        lead, stretch = lead[order], stretch[order]
        new_gram = np.ones(len(order), bool)
        new_gram[1:] = lead[1:] != lead[:-1]
        again = ~new_gram
        again[1:] &= stretch[1:] == stretch[:-1]
        group = np.cumsum(new_gram) - 1
        firsts = np.bincount(group, ~again)
        open_end = (group == 0) | (group == group[-1])  # may go on in the next bucket
        keep = again | (firsts[group] > 1) | open_end
        rows = order[keep]
        for a in range(0, len(rows), 50_000):
            r = rows[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[r], tie[r], place[r] // span, (place[r] % span).astype(np.int32), again[keep][a : a + 50_000])], names=["id", "tie", "start", "windows", "again"])

    spread = rows.repartitionByRange(buckets, "lead", "stretch", "id", "tie", "place")
    return spread.mapInArrow(run, "id long, tie long, start long, windows int, again boolean")


def _by_document(spans: DataFrame) -> DataFrame:
    """Spans, at most a document's own, in one row for it; each in a long: start * 65536 + length (some hundred bytes)."""
    packed = F.col("start") * 65536 + (F.col("end") - F.col("start"))
    return spans.groupBy(F.col("id").alias("s_id"), F.col("tie").alias("s_tie")).agg(F.collect_list(packed).alias("spans"))


def _unpacked(spans) -> tuple[np.ndarray, np.ndarray]:
    packed = spans.values.to_numpy()
    return packed >> 16, (packed >> 16) + (packed & 65535)


def _with_spans(texts: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    same = (F.col("id") == F.col("s_id")) & (F.col("tie") == F.col("s_tie"))
    return texts.join(_by_document(spans).hint("shuffle_hash"), same, how).select("id", "tie", "text", "spans")


def repeated_windows(texts: DataFrame, firsts: DataFrame, span: int) -> DataFrame:
    """id, tie, start, end of the windows in ``firsts`` that are equal to an earlier one there, by 96-bit hashes.

    A row is kept small: g1, and 32 more bits of hash, a flag and the start in one long. Within a batch all but the
    first of equal windows are known as repeats at once; they are flagged and go on under keys of their own, so a
    window that a third of all documents hold meets once per batch.
    """
    import pyarrow as pa

    names = ["g1", "rest", "id", "tie"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for i, tie, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                h = gram_hashes(text.as_py().encode("utf-8", "surrogatepass"))
                a, b = _unpacked(spans)
                at = np.concatenate([np.arange(x, y - span + 1) for x, y in zip(a, b, strict=True)])
                g1, g2 = np.full(len(at), 1, U), np.full(len(at), 2, U)
                for k in [*range(0, span - GRAM, GRAM), span - GRAM]:
                    x = h[at + k]
                    g1, g2 = _mixed(g1 * U(0x9E3779B97F4A7C15) + x), _mixed((g2 + x) * U(0xC2B2AE3D27D4EB4F))
                parts.append([g1, g2 >> U(32), np.full(len(at), i), np.full(len(at), tie), at.astype(U)])
            if not parts:
                continue
            g1, g2, ids, ties, at = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((at, ties, ids, g2, g1))
            g1, g2, ids, ties, at = (x[order] for x in (g1, g2, ids, ties, at))
            again = np.zeros(len(order), bool)
            again[1:] = (g1[1:] == g1[:-1]) & (g2[1:] == g2[:-1])
            g1 = np.where(again, _mixed(ids.astype(U) * U(0x9E3779B97F4A7C15) + at), g1)
            rest = (g2 << U(32)) | (again.astype(U) << U(31)) | at
            for a in range(0, len(order), 50_000):
                c = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g1[c].view(np.int64), rest[c].view(np.int64), ids[c], ties[c])], names=names)

    hashed = _with_spans(texts, firsts, "inner").mapInArrow(run, "g1 long, rest long, id long, tie long").repartition("g1")
    again = F.shiftrightunsigned("rest", 31).bitwiseAND(F.lit(1)) == 1
    hashed = hashed.withColumns({"g2": F.shiftright("rest", 32), "again": again, "start": F.col("rest").bitwiseAND(F.lit((1 << 31) - 1))})
    # flagged rows are repeats already and no one's predecessors
    same = F.lag("g2").over(Window.partitionBy("g1").orderBy("again", "g2", "id", "tie", "start")) == F.col("g2")
    return hashed.withColumn("same", same).where(F.col("again") | F.col("same")).select("id", "tie", "start", (F.col("start") + span).alias("end"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 100) -> DataFrame:
    """One row per input row: ``id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (the remaining bytes).

    Each byte goes that is covered by ``span`` bytes which also start earlier (smaller id, or same document and
    earlier place); all strings are judged on the input. ``span`` is 72 or more.

    Null text: as empty. A null id comes before all others. Rows that repeat an id are documents in the order of their
    texts' hashes; identical rows are one document, and each gets its result. Other columns are not read.
    """
    import pyarrow as pa

    if not 2 * GRAM <= span < 1 << 14:
        raise ValueError(f"spans of {2 * GRAM} bytes or more, and less than 16384")
    texts, analysed = _keyed(docs, id_col, text_col)
    found = written(sorted_buckets(anchor_rows(analysed, span), span, bucket_count(analysed, span)), "stretches")
    found = found.select("id", "tie", "start", (F.col("start") + F.col("windows") - 1 + span).alias("end"), "again")
    windows = repeated_windows(texts if texts is analysed else analysed, found.where(~F.col("again")).drop("again"), span)
    spans = found.where("again").drop("again").unionByName(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for i, text, spans in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                removed, runs, kept = 0, 0, data
                if spans.is_valid:
                    edge = np.zeros(len(data) + 1, np.int32)
                    start, end = _unpacked(spans)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, end, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed, runs = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                rows.append((None if i == NULL_ID else i, len(data), removed, runs, kept))
                held += len(kept)
                if held > 4 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    def _batch(rows: list[tuple]):
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return _with_spans(texts, spans, "left").mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
