"""Cross-tokenizer alignment against the libraries' own tokens and plain loops."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from deviatix.llm import alignment, queries

from .test_operators import corpus, docs, empty, odd  # noqa: F401

FILES = [queries.tokenizer_file(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    a.no_truncation()
    return a, SentencePieceProcessor(model_file=FILES[1])


def byte_of() -> dict[str, int]:
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


def brute(texts: list[str | None], libraries) -> list[tuple]:
    a, b = libraries
    letters, out = byte_of(), []
    for t in texts:
        if not t:
            out.append([])
            continue
        ids_a, ids_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(bytes_a) != (" " + t).encode() or b"".join(bytes_b) != (" " + t).encode():
            out.append([])
            continue
        groups, x, y, end_a, end_b = [([], [])], 0, 0, 0, 0
        while x < len(ids_a) or y < len(ids_b):
            if end_a == end_b and end_a:
                groups.append(([], []))
            if end_a <= end_b and x < len(ids_a):
                groups[-1][0].append(ids_a[x])
                end_a, x = end_a + len(bytes_a[x]), x + 1
                if end_b < end_a:
                    groups[-1][1].append(ids_b[y])
                    end_b, y = end_b + len(bytes_b[y]), y + 1
            else:
                groups[-1][1].append(ids_b[y])
                end_b, y = end_b + len(bytes_b[y]), y + 1
        out.append(groups)
    count = Counter(p for g in out for p in {(i, j) for x, y in g for i in x for j in y})
    best: dict = {}
    for (i, _), n in count.items():
        best[i] = max(best.get(i, 0), n)
    rows = []
    for g in out:
        links = [(i, j) for x, y in g for i in x for j in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        rows.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), text))
    return rows


def rows_of(df) -> list[tuple]:
    return sorted((r.id is None, r.id or 0, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in df.collect())


def expected(rows: list, libraries) -> list[tuple]:
    return sorted((i is None, i or 0, *x) for (i, _), x in zip(rows, brute([t for _, t in rows], libraries), strict=True))


HARD = [
    "plain words", "<|endoftext|> and <s> <0x41> </s>", "a▁b", "▁", " ", "  two  spaces   three", "\n", "x\r\ny;\r\n\tz", "漢字かな交じり文 und Ärger", "👩‍👩‍👧 emoji \U0001f600\U0001f601",
    "é combining ﬁ ½ 　 wide ﻿ mark", "it's 12345 don't we'll", "=" * 300, "aGVsbG8gd29ybGQhISE" * 40, "\x00\x01\x7f", "nb\xa0sp", "x" * 5000, " lead", "trail ", "word " * 2000,
]


def test_products():
    r = np.random.default_rng(3)
    a, b = r.integers(0, 3, (20, 30)) * (r.random((20, 30)) < 0.2), r.integers(0, 3, (30, 9)) * (r.random((30, 9)) < 0.3)
    for terms in (1, 7, 1 << 20):
        alignment.TERMS, before = terms, alignment.TERMS
        try:
            sparse = [alignment.Csr.of(np.repeat(np.nonzero(m)[0], m[m > 0]), np.repeat(np.nonzero(m)[1], m[m > 0]), *m.shape) for m in (a, b)]
            got = alignment.product(*sparse)
        finally:
            alignment.TERMS = before
        dense = np.zeros((20, 9), int)
        dense[got.row, got.column] = got.value
        assert (dense == a @ b).all()


@pytest.mark.parametrize("unit_bytes", [200, 1 << 22])
def test_against_the_libraries(spark, libraries, unit_bytes):
    rows = [(i, t) for i, t, *_ in corpus()] + [(100 + k, t) for k, t in enumerate(HARD)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(alignment.align(df, *FILES, unit_bytes=unit_bytes)) == expected(rows, libraries)


def test_odd_rows(spark, libraries, odd, empty):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert rows_of(alignment.align(odd, *FILES)) == expected(rows, libraries)
    assert alignment.align(empty, *FILES).collect() == []


def test_long_texts_go_in_parts(spark, libraries):
    r = random.Random(4)
    words = ["stream", "wörter", "12", "x▁y", "((", "\n", "end.", "漢字"]
    rows = [(1, " ".join(r.choices([w for w in words if "▁" not in w], k=150_000))), (2, " ".join(r.choices(words[:3], k=120_000)) + " a▁b"), (3, "y" * 700_000), (4, "short words"), (5, "\n".join(r.choices(words[:3], k=3000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    assert rows_of(alignment.align(df, *FILES)) == expected(rows, libraries)


def test_op11(spark, libraries):
    data = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    want = {i: (*x[:6], hashlib.sha256(x[6].encode()).hexdigest() if x[0] else "") for (i, _), x in zip(rows, brute([t for _, t in rows], libraries), strict=True)}
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {r.doc_id: tuple(r[c] for c in names) for r in queries.queries()["op11_alignment"](spark, data).collect()} == want
