"""Benchmark decontamination by winnowing. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORD, folded_bytes, let, sized_join_hint, written

#: Benchmark rows (fingerprints or windows) up to which they are broadcast: counted, at most some 100 bytes each.
BROADCAST_ROWS = 200_000


def _words(text: Column) -> Column:
    return F.regexp_extract_all(folded_bytes(F.coalesce(text, F.lit(""))), F.lit(ALNUM_WORD), F.lit(0))


def _over_runs(items: Column, n: int, make) -> Column:
    """``make([run's items], first index)`` for every run of n consecutive items."""
    empty = F.transform(F.slice(items, 1, 0), lambda x: make([x] * n, F.lit(0)))
    return F.when(F.size(items) >= n, F.transform(F.sequence(F.lit(0), F.size(items) - n), lambda i: make([F.get(items, i + j) for j in range(n)], i))).otherwise(empty)


def _window_prints(hashes: Column, window: int, gram: int) -> Column:
    """For each run of ``window`` words the least hash of its runs of ``gram`` words: the winnowing fingerprint.

    It depends on the window's words alone, so equal windows have equal fingerprints wherever they stand; one
    fingerprint serves most neighbouring windows.
    """
    grams = _over_runs(hashes, gram, lambda x, i: F.xxhash64(F.lit(window), *x))
    per = window - gram + 1
    return grams if per == 1 else let(grams, lambda g: _over_runs(g, per, lambda x, i: F.least(*x)))


def _prints_by_length(words: Column, lengths: dict[int, int], only: Column | None = None) -> Column:
    """Distinct fingerprints of all window lengths."""
    each = lambda h: F.array_distinct(F.concat(*[_window_prints(h, n, k) for n, k in lengths.items()]))
    return let(F.transform(words, lambda w: F.xxhash64(w)), each)


def _windows(words: Column, hashes: Column, prints: Column, length: int, gram: int) -> Column:
    """(length, start, words joined) of the windows whose fingerprint is among ``prints``."""
    tagged = F.transform(_window_prints(hashes, length, gram), lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    near = F.filter(tagged, lambda x: F.array_contains(prints, x["p"]))
    return F.transform(near, lambda x: F.struct(F.lit(length).alias("length"), x["i"].alias("start"), F.array_join(F.slice(words, x["i"] + 1, length), " ").alias("run")))


def gram_of(length: int, full: int = 10) -> int:
    """k-gram length for a window of so many words: 6 of 10; items shorter than a window are one gram."""
    return max(1, length * 6 // 10) if length >= full else length


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``text_hash``, ``n_words``, ``n_hit``, ``items`` (array of ids, sorted as strings).

    A document word is hit if it stands in ``window`` consecutive words that also stand in a benchmark item (or, for
    an item of fewer words, in all of its words). Fingerprints: the least 6-word hash of each window of 10 words, so
    every shared run of 10 words shares one. Documents' distinct fingerprints are joined with the benchmark's; in the
    documents found, the windows around matching fingerprints are extended to their full words and compared exactly
    as text. The benchmark's tables are broadcast while their counted rows are at most ``BROADCAST_ROWS``, else
    merge-joined.

    Null or empty texts have no words and no hits; items without words are none. Rows that repeat both id and text
    get a row each; a null id is a document like any other; null item ids hit words but are not listed.
    """
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), _words(F.col(item_text_col)).alias("words")).where(F.size("words") > 0)
    items = written(items.withColumn("length", F.least(F.size("words"), F.lit(window))), "bench-items")
    # at most `window` small numbers
    lengths = {n: gram_of(n, window) for n in sorted(r[0] for r in items.select("length").distinct().collect())}
    if not lengths:
        out = own.select("id", "text_hash", F.size(_words(F.col("text"))).cast("long").alias("n_words"))
        return out.select("*", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))

    def of_item(make) -> Column:
        """An item has windows of its own length only."""
        out = None
        for n in lengths:
            out = (F.when if out is None else out.when)(F.col("length") == n, make(n))
        return out

    hashes = F.transform("words", lambda w: F.xxhash64(w))
    prints = written(items.select(F.explode(F.array_distinct(of_item(lambda n: let(hashes, lambda h: _window_prints(h, n, lengths[n]))))).alias("print")).distinct(), "bench-prints")
    runs = F.transform(F.sequence(F.lit(0), F.size("words") - F.col("length")), lambda i: F.array_join(F.slice("words", i + 1, F.col("length")), " "))
    windows = written(items.select("item", "length", F.explode(F.array_distinct(runs)).alias("run")).distinct(), "bench-windows")
    n_prints, n_windows = prints.count(), windows.count()

    # one row per document (print null), and one per distinct fingerprint of it; only those that match stay
    seen = own.select("id", "text_hash", _words(F.col("text")).alias("words"))
    seen = seen.select("id", "text_hash", F.size("words").cast("long").alias("n_words"), F.explode(F.concat(F.array(F.lit(None).cast("long")), _prints_by_length(F.col("words"), lengths))).alias("own_print"))
    # the documents' own rows have no print: their key spreads them over the partitions of a merge join
    key = F.coalesce("own_print", F.xxhash64("id", "text_hash"))
    seen = seen.join(sized_join_hint(prints, n_prints, BROADCAST_ROWS), (key == F.col("print")) & F.col("own_print").isNotNull(), "left").where(F.col("own_print").isNull() | F.col("print").isNotNull())
    seen = seen.groupBy("id", "text_hash").agg(F.max("n_words").alias("n_words"), F.sum(F.when(F.col("own_print").isNull(), 1).otherwise(0)).alias("copies"), F.collect_set("print").alias("prints"))
    seen = written(seen, "doc-prints")

    found = seen.where(F.size("prints") > 0).select(F.col("id").alias("f_id"), F.col("text_hash").alias("f_hash"), "prints")
    near = own.join(found.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("f_id")) & (F.col("text_hash") == F.col("f_hash")))
    near = near.select("id", "text_hash", "prints", _words(F.col("text")).alias("words"))
    all_windows = let(F.transform("words", lambda w: F.xxhash64(w)), lambda h: F.concat(*[_windows(F.col("words"), h, F.col("prints"), n, k) for n, k in lengths.items()]))
    near = near.select("id", "text_hash", F.explode(all_windows).alias("w")).select("id", "text_hash", "w.length", "w.start", "w.run")
    near = near.join(sized_join_hint(windows, n_windows, BROADCAST_ROWS), ["length", "run"])
    near = near.groupBy(F.col("id").alias("f_id"), F.col("text_hash").alias("f_hash")).agg(F.collect_set(F.struct("start", "length")).alias("spans"), F.sort_array(F.collect_set("item")).alias("hit_items"))
    hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))))
    near = near.select("f_id", "f_hash", hit.cast("long").alias("n_hit"), "hit_items")
    out = seen.join(near.hint("merge"), F.col("id").eqNullSafe(F.col("f_id")) & (F.col("text_hash") == F.col("f_hash")), "left")
    return out.select("id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("hit_items", F.array().cast("array<string>")).alias("items"), F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).drop("copy")
