"""The operators against brute force on small documents: copies, near copies, nulls, empties, ties, repeated rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from deviatix.llm import archives, bpe, decontaminate, language, licenses, line_dedup, near_dup, quality_rules, suffix_dedup, token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 string, row string"
SYLLABLES = ["an", "the", "re", "on", "ti", "ver", "lo", "é", "ß", "ka", "mi", "su", "or", "ed", "na"]


def words(r: random.Random, n: int) -> list[str]:
    return ["".join(r.choices(SYLLABLES, k=r.randint(1, 4))) for _ in range(n)]


def corpus() -> list[tuple]:
    r = random.Random(3)
    shared = " ".join(words(r, 14))
    base = words(r, 120)
    texts: list[str | None] = [None, "", "  \n\t", "123 456 !!", "Word", "two words", "aaaa " * 300, "x" * 700, "no\xa0break \x1c separated"]
    for k in range(24):
        own = base.copy() if k % 3 == 0 else words(r, r.randint(5, 150))
        for _ in range(k // 2 if k % 3 == 0 else 0):
            own[r.randrange(len(own))] = "Changed"
        lines = [" ".join(own[i : i + 25]) for i in range(0, len(own), 25)]
        if k % 2 == 0:
            lines.insert(r.randint(0, len(lines)), f" {shared.upper() if k % 4 else shared}\t")
        texts.append("\n".join(lines) + ("\n" if k % 5 == 0 else ""))
    texts += [texts[-1], texts[-2], texts[-1]]
    return [(i, t, "en" if i % 2 else "de", ["a", "b", None][i % 3], len(t or ""), "clash", "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, a repeated id with another text, null ids, all-null rows."""
    rows = corpus()
    return spark.createDataFrame([*rows, rows[12], rows[12], (12, "another text of this id", "en", "a", 1, None, None), (None, rows[12][1], None, None, None, None, None), (None, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower_az(s: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


# ---- line dedup -------------------------------------------------------------------------------------------------


def brute_lines(rows, least=5):
    held: dict[str, set] = {}
    strip = " \t\n\x0b\x0c\r"
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            held.setdefault(lower_az(x.strip(strip)), set()).add(i)
    out = {}
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(k := lower_az(x.strip(strip))) >= 40 and len(held[k]) >= least and max(held[k]) != i)]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_line_dedup(docs):
    got = {r.row.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.drop_common_lines(docs).collect()}
    assert got == brute_lines(corpus())
    assert sum(v[1] for v in got.values()) > 5


def test_line_dedup_odd(odd, empty):
    assert line_dedup.drop_common_lines(odd).count() == odd.count()
    assert line_dedup.drop_common_lines(empty).count() == 0


# ---- decontamination --------------------------------------------------------------------------------------------


def brute_hits(rows, items, n=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_az(t or ""))
    out = {}
    for i, t, *_ in rows:
        w, hit, names = find(t), set(), set()
        for name, text in items:
            b = find(text)
            size = min(n, len(b))
            for k in range(len(b) - size + 1 if b else 0):
                for a in range(len(w) - size + 1):
                    if w[a : a + size] == b[k : k + size]:
                        hit |= set(range(a, a + size))
                        names.add(str(name))
        out[i] = (len(w), len(hit), sorted(names))
    return out


def items():
    texts = [t for _, t, *_ in corpus() if t and len(t) > 300]
    return [(7, " ".join(texts[1].split()[3:30])), (11, "Two, WORDS!"), (2, ""), (3, None), (4, "nothing of that kind"), (5, " ".join(texts[4].split()[:9])), (6, "word")]


def test_decontamination(spark, docs):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    got = {r.id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == brute_hits(corpus(), items())
    assert sum(v[1] > 0 for v in got.values()) >= 3


def test_decontamination_odd(spark, odd, empty):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    assert decontaminate.contamination(odd, bench).count() == odd.count()
    assert decontaminate.contamination(empty, bench).count() == 0
    none = bench.where("false")
    assert {r.n_hit for r in decontaminate.contamination(odd, none).collect()} == {0}


# ---- near duplicates --------------------------------------------------------------------------------------------


def brute_components(rows, n, percent):
    sets = {}
    for i, t, *_ in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower_az(t or "")) if x]
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                up[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, n, percent):
    got = {r.id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, shingle=n, percent=percent).collect()}
    assert got == brute_components(corpus(), n, percent)


def test_near_duplicates_large_group(spark):
    """A group of which many are too far from the first to be linked with it."""
    r = random.Random(9)
    base, rows = words(r, 150), []
    for i in range(120):
        own = base.copy()
        for _ in range(i % 9):
            own[r.randrange(len(own))] = f"edit{r.randrange(40)}"
        rows.append((i, " ".join(own)))
    got = {x.id: (x.n_shingles, x.component_id) for x in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85).collect()}
    want = brute_components(rows, 3, 85)
    assert got == want
    assert len({c for _, c in want.values()}) > 3


def test_near_duplicates_odd(odd, empty):
    out = near_dup.near_duplicates(odd, shingle=3, percent=85).collect()
    assert len(out) == odd.count()
    assert all(r.component_id is None and r.kept for r in out if r.id is None)
    assert near_dup.near_duplicates(empty).count() == 0


# ---- suffix dedup -----------------------------------------------------------------------------------------------


def brute_repeats(rows, span=100):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for s in range(len(b) - span + 1):
            w = b[s : s + span]
            if w in seen:
                gone[s] += 1
                gone[s + span] -= 1
            seen.add(w)
        m = np.cumsum(gone[:-1]) > 0
        out[i] = (len(b), int(m.sum()), int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum()), np.frombuffer(b, np.uint8)[~m].tobytes())
    return out


def test_suffix_dedup(docs):
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == brute_repeats(corpus())
    assert sum(v[1] for v in got.values()) > 1000


def test_suffix_dedup_odd(odd, empty):
    out = suffix_dedup.remove_repeats(odd).collect()
    assert len(out) == odd.count()
    same = [r for r in out if r.id == 12 and r.n_bytes == len(corpus()[12][1].encode())]
    assert len({(r.n_removed, bytes(r.kept)) for r in same}) == 1
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_multikey_order():
    r = np.random.default_rng(1)
    cols = [r.integers(0, 3, 500), r.integers(0, 3, 500), r.integers(0, 9, 500), r.permutation(500)]
    assert (suffix_dedup.multikey_order(cols) == np.lexsort(cols[::-1])).all()


# ---- licences, quality, language --------------------------------------------------------------------------------


def test_license_scan(spark, odd, empty):
    text = "Foo. CC-BY cc by CC BY 4.0\nSPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0\nAll rights reserved. gnu general public license"
    n, base, first, last, base_labels, labels, score = licenses.scan(text)
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_az(text))
    places = [k for p in licenses.BASE_PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    assert (n, base, first, last) == (len(w), len(places), min(places), max(places))
    assert base_labels == "cc-by,gpl,reserved"
    assert labels == "apache,cc-by,gpl,mit,reserved"
    assert score == 1.0
    assert licenses.evaluate("MIT OR GPL-3.0-or-later") == ({"mit", "gpl"}, 0.1)
    assert licenses.evaluate("MIT AND (GPL-2.0 WITH x)")[1] == pytest.approx(0.49)
    assert licenses.evaluate("MIT AND OR") == ({"mit", "unknown"}, licenses.UNKNOWN)
    assert licenses.evaluate("GPL-2.0-only WITH") == ({"gpl", "unknown"}, 0.7)
    assert licenses.evaluate("(MIT OR Apache-2.0") == ({"mit", "apache", "unknown"}, licenses.UNKNOWN)
    assert licenses.evaluate("MIT WITH x OR OR") == ({"mit", "unknown"}, licenses.UNKNOWN)
    assert licenses.evaluate(")") == ({"unknown"}, licenses.UNKNOWN) == licenses.evaluate("")
    assert licenses.scan(None) == (0, 0, None, None, "", "", 0.0)
    assert licenses.scan_licenses(odd).count() == odd.count()
    assert licenses.scan_licenses(empty).count() == 0


def drawn(r: random.Random, depth: int) -> tuple[str, set, float, int]:
    """A random expression with its labels, its obligation and how tightly its last operator binds, made from the tree down."""
    if not depth or r.random() < 0.3:
        name, label, weight = r.choice([("MIT", "mit", 0.1), ("Apache-2.0", "apache", 0.2), ("GPL-3.0-only", "gpl", 0.7), ("CC0-1.0", "cc0", 0.05), ("Own-1", "own-1", 0.6)])
        return (f"{name} With Some-exception", {label}, weight * 0.7, 3) if r.random() < 0.2 else (name, {label}, weight, 4)
    op, binds, join = r.choice([("or", 1, min), ("AND", 2, max)])
    sides = [drawn(r, depth - 1) for _ in range(2)]
    texts = [f"( {t} )" if b < binds or r.random() < 0.1 else t for t, _, _, b in sides]
    return f"{texts[0]} {op} {texts[1]}", sides[0][1] | sides[1][1], join(sides[0][2], sides[1][2]), binds


def test_license_expressions():
    r = random.Random(8)
    for _ in range(300):
        text, labels, weight, _ = drawn(r, 4)
        got = licenses.evaluate(text)
        assert got[0] == labels and got[1] == pytest.approx(weight), text
        cut, unknown = licenses.evaluate(f"{text} and")
        assert cut == labels | {"unknown"} and unknown >= licenses.UNKNOWN


def test_license_notices():
    known = {
        "Creative Commons Attribution 4.0 International License": "cc-by", "Creative Commons Attribution-ShareAlike 3.0": "cc-by,cc-by-sa", "you can redistribute it and/or modify it under the terms of the GNU GPL": "gpl",
        "https://www.apache.org/licenses/LICENSE-2.0": "apache", "GNU LGPL version 2.1": "lgpl", "see https://creativecommons.org/licenses/by/4.0/": "cc-by", "Licensed under the MIT licence": "mit", "a plain sentence of no licence": "",
    }
    assert {t: licenses.scan(t)[5] for t in known} == known


def brute_stats(t):
    t = t or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    wins: dict[tuple, list[int]] = {}
    for k in range(len(w) - 7):
        wins.setdefault(tuple(w[k : k + 8]), []).append(k)
    rep = {p for v in wins.values() if len(v) > 1 for k in v for p in range(k, k + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), sum(x in lines[:k] for k, x in enumerate(lines)), len(rep)


def test_quality_rules(spark, docs, odd, empty):
    for _, t, *_ in corpus():
        assert quality_rules.text_stats(t) == brute_stats(t)
    out = quality_rules.quality(odd).collect()
    assert len(out) == odd.count()
    assert all(r.kept == (not r.failed) for r in out if r.host is None)
    assert quality_rules.quality(empty).count() == 0
    bad = spark.createDataFrame([(i, "short" if i < 300 else "good words " * 3 + " ".join(map(str, range(40))), "bad" if i < 310 else f"h{i % 7}") for i in range(600)], "doc_id long, text string, source string")
    kept = {r.id: r.kept for r in quality_rules.quality(bad).collect()}
    assert not any(kept[i] for i in range(310))  # the host condemns its last ten documents, too
    assert all(kept[i] for i in range(310, 600))


def test_hosts_by_each_rule(spark):
    """A host is condemned by the rule that its documents break, and by no other; few documents condemn none."""
    good = lambda i: " ".join(f"word{(i * 31 + k * k) % 997}" for k in range(40))
    text = {"symbols": lambda i: good(i).replace(" ", "## "), "lines": lambda i: good(i) + "\nagain and again" * 5, "words": lambda i: " ".join("x" * 30 + str(k) for k in range(30)), "few": lambda i: good(i).replace(" ", "## ")}
    rows = [(i, text[h](i) if h in text and i % 10 < 7 else good(i), h) for i, h in enumerate([*["symbols", "lines", "words"] * 60, *["few"] * 2, *[f"h{k % 9}" for k in range(900)], None])]
    out = {r.id: r for r in quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    broken = {h: {tuple(out[i].broken or []) for i, _, g in rows if g == h} for h in ("symbols", "lines", "words", "few", "h0", None)}
    assert broken == {"symbols": {("symbol_heavy",)}, "lines": {("line_heavy",)}, "words": {("odd_words",)}, "few": {()}, "h0": {()}, None: {()}}
    assert not any(r.failed for r in out.values())
    assert {h for i, _, h in rows if not out[i].kept} == {"symbols", "lines", "words"}


def test_language(spark, odd, empty):
    r = random.Random(4)
    sets = {"aa": ["the", "ing", "and", "wh"], "bb": ["que", "lle", "eau", "é"], "cc": ["sch", "ung", "der", "ß"]}
    rows = [(i, " ".join("".join(r.choices(sets[lang], k=2)) for _ in range(r.choice([30, 120]))), lang) for i in range(300) for lang in [r.choice(sorted(sets))]]
    df = spark.createDataFrame([*rows, (900, "123 !", "aa"), (901, None, "bb")], "doc_id long, text string, lang string")
    model = language.train(df)
    pred = {x.id: (x.lang_pred, x.score) for x in language.predict(df, model).collect()}
    test = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(pred[i][0] == lang for i, lang in test) >= 0.97 * len(test)
    assert pred[900] == ("und", 0.0) == pred[901]
    assert language.train(empty) is None
    assert {x.lang_pred for x in language.predict(odd, None).collect()} == {"und"}
    assert language.predict(odd, model, keep_row=True).select("row.*").columns == odd.columns


# ---- archives ---------------------------------------------------------------------------------------------------


def pages():
    long = "<p>" + "é" * 700 + "</p>"
    return [(1, "http://a/x y", long), (5, None, long), (3, "u", long), (4, "v", "short"), (6, "w", "short"), (7, "", None), (8, "z", ""), (None, "n", long), (9, "q", long + "!\r\n\r\nWARC/1.1\r\n"), (9, "q", long + "!\r\n\r\nWARC/1.1\r\n")]


def test_archives(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").repartition(3)
    out = archives.archive_round_trip(df).collect()
    got = sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in out)
    want, nines = [], 0
    for i, _, h in pages():
        b = (h or "").encode()
        same = [p for p, _, x in pages() if (x or "").encode() == b and p is not None]
        lead = max(same)
        first = i == lead and not (i == 9 and nines)
        nines += i == 9
        want.append((i or -1, len(b), hashlib.sha1(b).hexdigest(), "response" if len(b) < 1000 or first else "revisit", 0 if len(b) < 1000 or first else lead))
    assert got == sorted(want)
    ids = {r.record_id: r.page_id for r in out if r.record_type == "response"}
    assert all(ids[r.refers_to_id] == r.refers_to for r in out if r.record_type == "revisit")
    assert archives.archive_round_trip(df.where("false")).count() == 0


def test_arc_versions():
    import io

    for v in (1, 2):
        blocks = [b"HTTP/1.1 200 OK\r\n\r\nhello\n\n2 0 crawl\n", b"", archives.http_block(b"x" * 10, 3)]
        data = archives.arc_head(v, "n.arc", "20200102030405") + b"".join(archives.arc_record(v, f"http://h/{k} a", "20200102030405", "text/html", b) for k, b in enumerate(blocks))
        got = list(archives.parse_arc(io.BytesIO(data)))
        assert [b for _, b in got] == blocks
        assert got[1][0]["URL"] == "http://h/1 a"
    assert archives.warc_date("20200102030405") == "2020-01-02T03:04:05Z"


# ---- tokens -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizers():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return {n: (P.path(n), Tokenizer.from_file(P.path(n))) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def strange(n: int) -> list[str]:
    r = random.Random(6)
    letters = [*"ab cd  \n\n\t'stlld!?.,éßΣσς́中日 \x1c\x85\xa0 　à 123 ÉxIJ", "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "à b", "İ"]
    return ["".join(r.choices(letters, k=r.randint(0, 50))) for _ in range(n)]


def test_codecs(tokenizers):
    path, tok = tokenizers["byte_bpe_50k.json"]
    codec = bpe.ForcedBoundaryCodec(open(path, encoding="utf-8").read())
    path, word_tok = tokenizers["word_bpe_49k.json"]
    word_codec = bpe.WordCodec(open(path, encoding="utf-8").read())
    for t in strange(3000) + [t for _, t, *_ in corpus() if t]:
        ids = tok.encode(t, add_special_tokens=False).ids
        got, decoded = codec.round_trip(t)
        assert np.frombuffer(got, "<u4").tolist() == ids, t
        assert decoded == tok.decode(ids, skip_special_tokens=False)
        assert np.frombuffer(word_codec.encode(t), "<u4").tolist() == word_tok.encode(t, add_special_tokens=False).ids, t


def test_encode_decode(tokenizers, odd, empty):
    path, _ = tokenizers["byte_bpe_50k.json"]
    out = bpe.encode_decode(odd, path).collect()
    assert sorted(r.decoded for r in out) == sorted(r.text or "" for r in odd.collect())
    assert bpe.encode_decode(empty, path).count() == 0


def test_token_files(tokenizers, docs, odd, empty):
    path, tok = tokenizers["word_bpe_49k.json"]
    got = {r.id: (r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in token_files.read_shards(token_files.write_shards(docs, path)).collect()}
    at = 0
    for i, t, *_ in corpus():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        assert got[i] == (at, ids)
        at += len(ids)
    assert token_files.read_shards(token_files.write_shards(odd, path)).count() == odd.count()
    assert token_files.read_shards(token_files.write_shards(empty, path)).count() == 0


def test_segment_random_access():
    import io

    r = np.random.default_rng(2)
    ids = np.concatenate([r.integers(0, 60000, 3000), r.integers(0, 200, 1500), [0, 255, 256, 65535, 65536, 2**32 - 1]]).astype("<u4")
    seg = token_files.SegmentReader(io.BytesIO(b"pad" + token_files.pack_segment([1, None], [7, len(ids) - 7], ids)), 3)
    assert (seg.tokens(0, len(ids)) == ids).all()
    for i in [*range(0, len(ids), 37), *range(len(ids) - 6, len(ids))]:
        assert seg.token(i) == ids[i]
    for a, b in r.integers(0, len(ids), (200, 2)):
        assert (seg.tokens(min(a, b), max(a, b)) == ids[min(a, b) : max(a, b)]).all()
