"""Substring dedup against a plain version that groups every window's words."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from deviatix.llm import queries, substring_dedup
from deviatix.llm.units import pack_ascending, unpack_ascending

from .test_operators import corpus, docs, empty, odd  # noqa: F401


def brute(texts: list[str | None], window: int) -> list[tuple[int, int, str]]:
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {k for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def rows_of(df) -> list[tuple]:
    return sorted(((r.id is None, r.id or 0, r.n_words, r.n_removed, r.kept) for r in df.collect()))


def expected(rows: list, window: int) -> list[tuple]:
    return sorted((i is None, i or 0, *x) for (i, _), x in zip(rows, brute([t for _, t in rows], window), strict=True))


def test_ascending_numbers():
    r = np.random.default_rng(5)
    for values in ([], [0], [5, 6, 200, 20_000, 3_000_000, 2**40, 2**63], np.unique(r.integers(0, 1 << 31, 5000)).tolist()):
        assert unpack_ascending(pack_ascending(np.array(values, np.uint64))).tolist() == values


@pytest.mark.parametrize(("window", "unit_bytes"), [(3, 200), (7, 3000), (35, 1 << 22)])
def test_against_brute_force(spark, docs, window, unit_bytes):  # noqa: F811
    got = substring_dedup.drop_repeated_windows(docs, window=window, unit_bytes=unit_bytes)
    assert rows_of(got) == expected([(i, t) for i, t, *_ in corpus()], window)


def test_odd_rows(spark, odd, empty):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert rows_of(substring_dedup.drop_repeated_windows(odd, window=5, unit_bytes=500)) == expected(rows, 5)
    assert substring_dedup.drop_repeated_windows(empty).collect() == []


def test_periodic_and_long_texts(spark):
    r = random.Random(8)
    long_words = ["w" * k for k in range(1, 60)]
    rows = [(0, "a " * 100), (1, "a b " * 40), (2, " ".join(r.choices("ab", k=3000))), (3, "x " * 4), (4, "x " * 5), (5, " ".join(long_words)), (6, " ".join(long_words[:40] + ["end"])), (7, "  　 é 漢字 " * 3), (8, " ".join(str(k) for k in range(60_000)))]
    rows.append((9, " ".join(str(k) for k in range(59_990, 60_020))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for window in (4, 12):
        assert rows_of(substring_dedup.drop_repeated_windows(df, window=window, unit_bytes=1000)) == expected(rows, window)


def test_narrow_sketches_lose_nothing(spark, docs, monkeypatch):  # noqa: F811
    """Cells that many windows share send more windows to the exact pass, and the result stays."""
    own = substring_dedup.Repeats(5, 1 << 20, 2)
    own.bits, own.block_bits = 8, 2
    seen = {}
    monkeypatch.setattr(substring_dedup, "Repeats", lambda *a: seen.setdefault("own", own))
    got = substring_dedup.drop_repeated_windows(docs, window=5, unit_bytes=400)
    assert rows_of(got) == expected([(i, t) for i, t, *_ in corpus()], 5)
    assert seen


def test_op13(spark):
    data = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    want = {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for (i, _), (n, gone, kept) in zip(rows, brute([t for _, t in rows], 35), strict=True)}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.queries()["op13_substring_dedup"](spark, data).collect()}
    assert got == want
    assert any(gone for _, gone, _ in want.values()) and any(not gone for _, gone, _ in want.values())
