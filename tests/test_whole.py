"""Queries whose SQL covers a part of their rows only: the whole result by brute force, that part against the SQL."""

from __future__ import annotations

import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from deviatix.functions import scalars
from deviatix.functions import text as T
from deviatix.operators import aggregates, learning
from deviatix.plans import library

from .test_oracles import DATA, duck  # noqa: F401

needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

TEXTS = [
    "plain 12/11/2020 at 10:30, id 123456. Dr. Smith", "né le 12/11/2020 à 10:30:05", "é123456 123456é ٣٤٥٦٧٨", "straße 99999 – Mrs Weber  ging",
    "a b　 c\x85d", "  lead and trail  ", "日本 2020-01-02 語", "xDr Smith, éDr Smith, Mr  Brown", "", "_12345 12345",
]


def brute_scrub(t):
    t = re.sub(r"\b\d{1,4}[/-]\d{1,2}[/-]\d{1,4}\b|\b\d{1,2}:\d{2}(:\d{2})?\b", "[date]", t)
    t = re.sub(r"\b(Dr|Mr|Mrs|Ms)\.? +[A-Z][a-z]+", "[name]", re.sub(r"\b\d{5,}\b", "[number]", t))
    return re.sub(r"\s+", " ", t).strip(" ")


def brute_snippet(t, keyword, clip):
    spaces = "".join(map(chr, [32, 160, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
    joined = ". ".join([s.strip(spaces) for s in re.split(r"[.;\n]", t) if keyword in s][:2])
    return joined if len(joined) <= clip else re.sub(r"\s+\S*\Z", "", joined[:clip])


def test_scrubbed_texts(spark):
    got = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", T.scrubbed(F.col("t")).alias("s")).collect()
    assert [r.s for r in got] == [brute_scrub(r.t) for r in got]


def test_snippets_of_wide_spaces(spark):
    texts = [" A tion here  ; none; 　next tion", "tion" + " word" * 12, "tion" + "　語" * 30, "tion " * 20, "no"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.snippet(F.col("t"), "tion", clip=40).alias("s")).collect()
    assert [r.s for r in got] == [brute_snippet(r.t, "tion", 40) for r in got]


def test_no_text_is_left_out(spark, tmp_path):
    rows = [*enumerate([*TEXTS, "a tion b"]), (99, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: hashlib.md5(brute_scrub(t).encode()).hexdigest() for i, t in rows if t is not None}
    assert dict(library.QUERIES["tx13_scrub"](spark, str(tmp_path)).collect()) == want
    got = {r.doc_id: r.snippet for r in library.QUERIES["tx14_tx15_snippet"](spark, str(tmp_path)).collect()}
    assert got == {i: brute_snippet(t, "tion", 120) for i, t in rows if t is not None}


#: RE2 has words and digits of ASCII only, so SQL can say it for texts of ASCII.
ASCII_SCRUB = r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\b\d{1,4}[/-]\d{1,2}[/-]\d{1,4}\b|\b\d{1,2}:\d{2}(:\d{2})?\b', '[date]', 'g'), '\b\d{5,}\b', '[number]', 'g'), '\b(Dr|Mr|Mrs|Ms)\.? +[A-Z][a-z]+', '[name]', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'))) AS scrubbed
  FROM documents WHERE text IS NOT NULL AND regexp_full_match(text, '[\x00-\x7F]*')"""


@needs_tables
def test_scrub_of_the_tables(spark, duck):  # noqa: F811
    texts = dict(duck.sql("SELECT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall())
    got = dict(library.QUERIES["tx13_scrub"](spark, DATA).collect())
    assert got == {i: hashlib.md5(brute_scrub(t).encode()).hexdigest() for i, t in texts.items()}
    part = dict(duck.sql(ASCII_SCRUB).fetchall())
    assert part and part == {i: got[i] for i in part}


@needs_tables
def test_feature_vector_of_all_rows(spark, duck):  # noqa: F811
    key = lambda eeg, channel, powers: (eeg, channel, *(round(float(x), 5) for x in powers))
    out = library.QUERIES["p02_feature_vector"](spark, DATA).collect()
    got = {key(r.eeg_id, r.channel, [r[b] for b in scalars.BANDS]): r for r in out}
    rows = duck.sql("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice / 1000, l_discount * 100, l_tax * 100, l_linenumber FROM lineitem").fetchall()
    assert len(out) == len(rows)
    for order, line, *values in rows:
        p = dict(zip(scalars.BANDS, map(float, values), strict=True))
        total, r = sum(p.values()), got[key(order, line, values)]
        for a, x in p.items():
            assert r[a] == pytest.approx(x, abs=1e-6) and r[f"rel_{a}"] == pytest.approx(x / (total + 1e-12), abs=1e-6)
            assert all(r[f"{a}_{b}"] == pytest.approx(x / (y + 1e-12), rel=1e-6, abs=6e-4) for b, y in p.items() if a != b)
    part = duck.sql(library.ORACLES["p02_feature_vector"])
    for values in part.fetchall():
        r = dict(zip(part.columns, values, strict=True))
        own = got[key(r["eeg_id"], r["channel"], [r[b] for b in scalars.BANDS])]
        assert all(own[k] == pytest.approx(v, abs=2e-3) for k, v in r.items())


@pytest.mark.parametrize("name", ["n04_robust_curves", "n11_deviation"])
def test_curves_are_trimmed(spark, tmp_path, name):
    r = random.Random(5)
    rows = [(i, i % 90, i, ("click", "view", "error", "signup")[i // 90 % 4], r.choice([1e-6, 140.0]) if r.random() < 0.01 else r.lognormvariate(2, 0.6)) for i in range(3600)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    clean = "cl AS (SELECT stage, age, y FROM seg WHERE NOT artifact)"
    edges = "(SELECT stage, quantile_cont(y, 0.002) AS lo, quantile_cont(y, 0.998) AS hi FROM seg WHERE NOT artifact GROUP BY 1)"
    # the SQL trims as well; here it is said once more, and left out
    sql, n = re.subn(r"cl AS \(SELECT stage, age, y FROM seg JOIN .*? BETWEEN lo AND hi\)", clean, library.ORACLES[name])
    assert n == 1 and sql.count(clean) == 1
    trimmed = sql.replace(clean, f"cl AS (SELECT stage, age, y FROM seg JOIN {edges} USING (stage) WHERE NOT artifact AND y BETWEEN lo AND hi)")
    assert sorted(c.sql(trimmed).fetchall()) == sorted(c.sql(library.ORACLES[name]).fetchall())
    got = sorted(tuple(x) for x in library.QUERIES[name](spark, str(tmp_path)).collect())
    want = sorted(c.sql(trimmed).fetchall())
    assert len(got) == len(want) > 60
    assert all(u == pytest.approx(v, abs=2e-4) if isinstance(v, float) else u == v for a, b in zip(got, want, strict=True) for u, v in zip(a, b, strict=True))
    assert sorted(c.sql(sql).fetchall()) != want


def test_modal_share(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, None), (2, "c"), (3, "d"), (3, "e")], "r long, peak string")
    assert {r.r: (r.n, r.share) for r in aggregates.modal_share(df, ["r"], "peak").collect()} == {1: (3, 2 / 3), 2: (1, 1.0), 3: (2, 0.5)}


def irls(x, y, ridge):
    a = np.column_stack([np.ones(len(x)), x])
    b, penalty = np.zeros(a.shape[1]), np.diag([0.0, *[ridge] * x.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ b))
        b += np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (y - p) - penalty @ b)
    return b


def test_folds_are_fitted_without_gathering_rows(spark):
    r = np.random.default_rng(1)
    rows = [(i, int(i % 3 == 0), float((i % 3 == 0) + r.normal()), float(r.normal())) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double")
    out = learning.folded_scores(df, ["a", "b"], "y", "id", 3, ridge=2.0)
    assert "InPandas" not in out._jdf.queryExecution().toString()
    got = {x.id: x.p for x in out.collect()}
    own = np.array([int(hashlib.md5(f"0|{i}".encode()).hexdigest()[:8], 16) % 3 for i, *_ in rows])
    x, y = np.array([v[2:] for v in rows]), np.array([v[1] for v in rows])
    assert sorted(got) == list(range(300))
    for k in range(3):
        mu, sd = x[own != k].mean(0), x[own != k].std(0, ddof=1)
        b = irls((x[own != k] - mu) / sd, y[own != k], 2.0)
        want = 1 / (1 + np.exp(-(b[0] + (x[own == k] - mu) / sd @ b[1:])))
        assert [got[i] for i in np.flatnonzero(own == k)] == pytest.approx(list(want), abs=1e-4)
