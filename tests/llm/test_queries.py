"""The opN_ queries, digest columns included, against brute force over the whole tables of the smallest scale."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest

from deviatix.llm import licenses, queries

from .test_operators import brute_components, brute_hits, brute_lines, brute_repeats, brute_stats, lower_az

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    return [(r.doc_id, r.text, r.lang, r.source) for r in rows]


def result(spark, name: str) -> dict:
    rows = queries.queries()[name](spark, DATA).collect()
    out = {r[0]: r for r in rows}
    assert len(out) == len(rows)
    return out


def sha256(x) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def test_op1(spark, documents):
    got = result(spark, "op1_license_scan")
    assert got.keys() == {i for i, *_ in documents}
    for i, text, *_ in documents:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_az(text or ""))
        phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
        places = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        base = {x for _, x in places}
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted(base))
        labels = r.labels.split(",") if r.labels else []
        assert base <= set(labels) and labels == sorted(set(labels)) and 0 <= r.score <= 1
        # the method's labels: of phrases found word by word, and of the expressions behind tags
        own = {x for p, x in (licenses.BASE_PHRASES | licenses.NOTICES).items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()}
        tagged = {x for m in re.finditer(r"(?i)SPDX-License-Identifier:[ \t]*([^\n]*)", text or "") for x in licenses.evaluate(m[1])[0]}
        assert own <= set(labels) and set(labels) <= own | tagged | {"unknown"}


def test_op2(spark, documents):
    got = result(spark, "op2_quality_rules")
    broken: dict = {}
    for i, text, _, source in documents:
        n, chars, symbols, dup, rep = brute_stats(text)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n)
        lines = len(text.split("\n")) if text else 0
        broken.setdefault(source, []).append((r.base_failed, symbols > chars / 10, dup > 0.3 * lines, chars < 2.5 * n or chars > 15 * n))
    assert all(not (r.kept and r.base_failed) for r in got.values())
    # a beta prior of the hosts' rates by moments for each rule; bad hosts lie two posterior deviations above four times its mean
    bad, rates = {}, {}
    for k, name in enumerate(("failed", "symbol_heavy", "line_heavy", "odd_words")):
        hosts = {h: (len(x), sum(y[k] for y in x)) for h, x in broken.items() if h is not None}
        n, f = (sum(x) for x in zip(*hosts.values(), strict=True))
        mean = min(max(f / n, 1e-6), 1 - 1e-6)
        spread = sum(d * (c / d) ** 2 for d, c in hosts.values()) / n - mean**2 - mean * (1 - mean) * len(hosts) / n
        strength = min(max(mean * (1 - mean) / max(spread, 1e-6) - 1, 1), 1e6)
        for h, (d, c) in hosts.items():
            post = (c + mean * strength) / (d + strength)
            if not k:
                rates[h] = post
            if post - 2 * (post * (1 - post) / (d + strength + 1)) ** 0.5 > (min(max(4 * mean, 0.25), 0.5) if not k else max(4 * mean, 0.25)):
                bad.setdefault(h, []).append(name)
    for i, _, _, source in documents:
        if source is not None:
            assert got[i].host_rate == pytest.approx(rates[source])
            assert got[i].host_broken == ",".join(bad.get(source, []))
        assert got[i].kept == (not got[i].base_failed and source not in bad)


def test_op3(spark):
    rows = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html").collect()
    got = result(spark, "op3_warc")
    last: dict = {}
    for i, html in rows:
        last[html or ""] = max(i, last.get(html or "", i))
    for i, html in rows:
        data, lead = (html or "").encode(), last[html or ""]
        again = len(data) >= 1000 and lead != i
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", lead if again else None)


def test_op4(spark, documents):
    got = result(spark, "op4_suffix_dedup")
    for i, (n, removed, spans, kept) in brute_repeats(documents).items():
        assert tuple(got[i])[1:5] == (n, removed, spans, sha256(kept))


def test_op5(spark, documents):
    from tokenizers import Tokenizer

    tok, got, at = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json")), result(spark, "op5_token_files"), 0
    for i, text, *_ in sorted(documents):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert tuple(got[i])[:4] == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_op6(spark, documents):
    got = result(spark, "op6_near_dup")
    for i, (n, component) in brute_components(documents, 3, 85).items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, component, i == component)


def test_op7(spark, documents):
    got = result(spark, "op7_language")
    learned = {lang for i, _, lang, _ in documents if lang and zlib.crc32(str(i).encode()) % 3 != 1}
    right = []
    for i, text, lang, _ in documents:
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or "")) and 0 <= r.score <= 1
        assert r.lang_pred in learned | {"und"}
        if r.held_out and lang and r.lang_pred != "und":
            right.append(r.lang_pred == lang)
    assert np.mean(right) > 0.9


def test_op8(spark, documents):
    from tokenizers import Tokenizer

    tok, got = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json")), result(spark, "op8_bpe")
    for i, text, *_ in documents:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        assert tuple(got[i])[:4] == (i, len(ids), sha256(np.array(ids, "<u4").tobytes()), sha256(tok.decode(ids, skip_special_tokens=False)))


def test_op9(spark, documents):
    got = result(spark, "op9_line_dedup")
    for i, (lines, dropped, kept) in brute_lines(documents).items():
        assert tuple(got[i])[1:4] == (lines, dropped, sha256(kept))


def test_op10(spark, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    got = result(spark, "op10_decontaminate")
    # the brute force compares every pair of windows: of documents whose words meet an item's at all
    grams = {tuple(w[k : k + min(10, len(w))]) for _, t in items for w in [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_az(t or ""))] for k in range(max(0, len(w) - 9) or min(1, len(w)))}
    sizes = {len(g) for g in grams}
    for i, text, *_ in documents:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_az(text or ""))
        hit = {p for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in grams for p in range(k, k + n)}
        r = got[i]
        assert (r.n_words, r.n_hit, r.contaminated) == (len(w), len(hit), bool(hit))
    hits = [d for d in documents if got[d[0]].n_hit][:3]
    for i, (_, _, names) in brute_hits(hits, items).items():
        assert (got[i].n_items, got[i].items_sha256) == (len(names), sha256(",".join(names)))
