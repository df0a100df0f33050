"""Filters, offsets, parametric curves, logistic fits and recording heads against plain versions."""

from __future__ import annotations

import hashlib
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from deviatix.operators import filters, norms, stats
from deviatix.operators import signal as G
from deviatix.plans import library, model_queries
from deviatix.plans.tables import table

from .test_oracles import DATA

needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def response(sections, f, fs):
    z = np.exp(2j * np.pi * f / fs)
    return abs(math.prod(np.polyval(b, z) / np.polyval(a, z) for b, a in sections))


def one_way(x, b, a):
    """The recursion sample by sample, as if the first sample had always been there."""
    past, before = [x[0]] * (len(b) - 1), [x[0] * sum(b) / sum(a)] * (len(a) - 1)
    out = []
    for v in x:
        y = (b[0] * v + sum(c * u for c, u in zip(b[1:], past, strict=True)) - sum(c * u for c, u in zip(a[1:], before, strict=True))) / a[0]
        past, before = [v, *past[:-1]], [y, *before[:-1]]
        out.append(y)
    return np.array(out)


def both_ways(x, sections):
    b, a = (np.array([1.0]) for _ in range(2))
    for c, d in sections:
        b, a = np.convolve(b, c), np.convolve(a, d)
    n = min(3 * len(b), len(x) - 1)
    x = np.concatenate([2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2 : -n - 2 : -1]]) if n else x
    y = one_way(one_way(x, b, a)[::-1], b, a)[::-1]
    return y[n : len(y) - n]


def test_filter_coefficients():
    (b, a), = filters.butterworth(2, 2.0, high=0.5)
    assert b == pytest.approx([0.29289322, 0.58578644, 0.29289322]) and a == pytest.approx([1, 0, 0.17157288])
    half = 1 / math.sqrt(2)
    for order in (1, 3, 4):
        assert response(filters.butterworth(order, 200, 0.5), 0.5, 200) == pytest.approx(half, abs=1e-6)
        assert response(filters.butterworth(order, 200, 0.5), 99, 200) == pytest.approx(1, abs=1e-3)
        band = filters.butterworth(order, 200, 11, 16)
        assert [response(band, f, 200) for f in (11, 16)] == pytest.approx([half, half], abs=1e-6)
        assert max(response(band, f, 200) for f in np.linspace(1, 99, 981)) <= 1 + 1e-9
    assert response(filters.notch(60, 200), 60, 200) < 1e-9 and response(filters.notch(60, 200), 60 - 1, 200) == pytest.approx(half, abs=0.01)


@pytest.mark.parametrize("n", [1, 2, 9, 64, 700])
def test_filters_are_the_recursion(n):
    x = np.random.default_rng(n).normal(size=(3, n)).cumsum(1)
    for sections in (filters.butterworth(4, 200, 0.5), filters.butterworth(4, 64, 11, 16), filters.notch(60, 200)):
        want = np.array([both_ways(r, sections) for r in x])
        assert filters.forward_backward(x, sections) == pytest.approx(want, abs=1e-5)


def test_line_noise_and_drift_go(spark):
    t = np.arange(12000) / 200
    wave = np.sin(2 * np.pi * 10 * t)
    rows = [(1, (wave + 5 * np.sin(2 * np.pi * 60 * t) + 3 * t).tolist()), (2, None), (3, [1.0, None, 2.0]), (4, []), (5, [7.0])]
    got = {r.k: r.s for r in filters.cleaned(spark.createDataFrame(rows, "k int, s array<double>"), ["k"], "s", 200.0).collect()}
    assert np.array(got[1])[3000:-3000] == pytest.approx(wave[3000:-3000], abs=0.02)
    assert got[2] is None and got[3] is None and got[4] == [] and got[5] == pytest.approx([0], abs=1e-9)


def test_envelope_of_a_burst():
    t = np.arange(512) / 64
    x = np.sin(2 * np.pi * 13 * t) * (1 + 0.5 * np.sin(2 * np.pi * t))
    y = filters.magnitude(x[None])[0]
    assert y[64:-64] == pytest.approx((1 + 0.5 * np.sin(2 * np.pi * t))[64:-64], abs=0.02)


@needs_tables
def test_filter_queries(spark):
    e = {r.vec_id: np.array(r.embedding, float) for r in table(spark, DATA, "embeddings").select("vec_id", "embedding").collect()}
    high, lines = filters.butterworth(4, 128, 0.5), [filters.notch(f, 128) for f in (60, 50)]
    got = {r.vec_id: r for r in library.QUERIES["dsp04_cleaned_signals"](spark, DATA).collect()}
    assert sorted(got) == sorted(e)
    for k, x in list(e.items()):
        y = both_ways(both_ways(both_ways(x, high), lines[0]), lines[1])
        assert (got[k].total, got[k].energy, got[k].line_length) == pytest.approx((y.sum(), (y * y).sum(), np.abs(np.diff(y)).sum()), abs=2e-5)
    band = filters.butterworth(4, 64, 11, 16)
    env = {k: filters.magnitude(both_ways(10 * x, band)[None])[0] for k, x in e.items() if k % 18 in (2, 3)}
    of = {}
    for k, x in env.items():
        of.setdefault(k // 72, []).extend(x)
    longest = {}
    for k, x in env.items():
        runs = "".join("1" if v > 1.5 * np.median(of[k // 72]) else "0" for v in x).split("0")
        longest[k // 18] = max(longest.get(k // 18, 0), max(map(len, runs)))
    assert {r.seg: (r.longest, r.burst) for r in library.QUERIES["dsp16_sigma_bursts"](spark, DATA).collect()} == {k: (n, n >= 0.15 * 64) for k, n in longest.items()}


def test_offsets_of_odd_series(spark):
    x = [float(math.sin(i * i / 50)) for i in range(300)]
    rows = [(1, x, x[40:150:10]), (2, x[:105], x[:110:10]), (3, [1.0] * 300, x[40:150:10]), (4, None, [1.0, 2.0]), (5, [], [1.0, 2.0])]
    df = spark.createDataFrame(rows, "k int, x array<double>, p array<double>")
    got = {}
    for r in sorted(G.candidate_offsets(df, ["k"], "x", "p", 10, top=3).collect()):
        got.setdefault(r.k, []).append((r.at, r.r))
    assert got[1][0] == (40, pytest.approx(1)) and len(got[1]) == 3
    assert all(abs(a - b) > 30 for i, (a, _) in enumerate(got[1]) for b, _ in got[1][:i])
    assert [a for a, _ in got[2]] == [0] or len(got[2]) <= 1  # a series of about the profile's length
    assert [a for a, _ in got[3]] == [0, 31, 62] and got.get(4) is None and got.get(5) is None  # ties: the least first
    same = spark.createDataFrame([(x, x[40:55], 40), (x, x[40:55], 299)], "x array<double>, s array<double>, at int")
    assert [r[0] for r in same.select(G.offset_mismatch(F.col("x"), F.col("s"), F.col("at"), 1, 1)).collect()] == [0.0, None]


def test_rhythm_and_coherence(spark):
    t = np.arange(128)
    rows = [(1, np.sin(2 * np.pi * t / 16).tolist()), (2, [1.0, 2.0]), (3, [])]
    got = {r.k: r for r in G.rhythmicity(spark.createDataFrame(rows, "k int, s array<double>"), "s", 10, 20).collect()}
    assert got[1].lag == 16 and got[1].rhythmicity == pytest.approx(0.875, abs=0.01) and got[2].rhythmicity is None and got[3].lag is None
    r = np.random.default_rng(3)
    noise = r.normal(size=(40, 2, 64))
    rows = [(0, s, c, (noise[s, 0] if c < 2 else noise[s, 1]).tolist()) for s in range(40) for c in (0, 1, 2)]
    out = G.coherence(spark.createDataFrame(rows, "k int, s int, c int, x array<double>"), ["k"], "s", "c", "x", [(0, 1), (2, 9)], [3, 7]).collect()
    assert [(o.pair, pytest.approx(1)) for o in out] == [(o.pair, o.coherence) for o in out] and [o.pair for o in out] == [0]


def test_parametric_curve(spark):
    r = np.random.default_rng(2)
    z = r.normal(size=4000)
    value = 20 * (1 + 0.5 * 0.3 * z) ** 2  # l = 0.5, m = 20, s = 0.3
    rows = [("a", 30.0, float(v)) for v in value] + [("a", 30.0, v) for v in (0.0, -1.0, None)] + [("b", 30.0, 4.0)] * 50 + [("c", 30.0, 4.0), (None, 30.0, 5.0)]
    df = spark.createDataFrame(rows, "cell string, x double, v double")
    out = {o.cell: o for o in norms.lms_curve(df, ["cell"], "x", "v", [30.0, 90.0], 5.0, [-0.5, 0.0, 0.5, 1.0]).collect()}
    assert sorted(out) == ["a", "b"] and out["a"].weight == 4000 and out["a"].l == 0.5
    assert (out["a"].m, out["a"].s) == (pytest.approx(20, rel=0.02), pytest.approx(0.3, rel=0.05)) and out["b"].m is None
    got = df.where("cell = 'a'").select("v", norms.lms_z(F.col("v"), F.lit(0.5), F.lit(20.0), F.lit(0.3)).alias("z")).collect()
    assert [g.z for g in got[:4000]] == pytest.approx(list(z), abs=1e-6) and [g.z for g in got[4000:]] == [None] * 3


def newton(a, y, weight=None, ridge=0.0):
    w = np.ones(len(y)) if weight is None else weight
    b, penalty = np.zeros(a.shape[1]), np.diag([0.0, *[ridge] * (a.shape[1] - 1)])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ b))
        h = a.T @ (a * (w * p * (1 - p))[:, None]) + penalty
        b = b + np.linalg.solve(h, a.T @ (w * (y - p)) - penalty @ b)
    return b, np.sqrt(np.diag(np.linalg.inv(h)))


@needs_tables
def test_conditional_fits(spark):
    rows = [(r.case, r.sleep, r.wake) for r in model_queries.states(spark, DATA).collect() if r.sleep is not None and r.wake is not None]
    d = np.array(rows, float)
    got = {(r.model, r.term): r for r in library.QUERIES["st_a18_conditional"](spark, DATA).collect()}
    for model, columns in (("sleep", [1]), ("sleep+wake", [1, 2])):
        b, error = newton(np.column_stack([np.ones(len(d)), d[:, columns]]), d[:, 0])
        for term, v, e in zip(["intercept", "sleep", "wake"], b, error, strict=False):
            assert (got[model, term].coefficient, got[model, term].error) == pytest.approx((v, e), abs=2e-5)
            assert got[model, term].p == pytest.approx(math.erfc(abs(v / e) / math.sqrt(2)), abs=1e-4)


def test_fits_that_do_not_exist(spark):
    kinds = "y int, x double"
    for rows in ([], [(1, 1.0), (1, 2.0)], [(0, 1.0), (0, 2.0), (1, 3.0), (1, 4.0)], [(0, 1.0), (1, 1.0)], [(None, 1.0), (1, None)]):
        assert [r.coefficient for r in stats.logit(spark.createDataFrame(rows, kinds), "y", ["x"]).collect()] == [None, None]


def head_scores(train, y, every):
    """The standardised, balanced head with a penalty of 1 / 0.3."""
    mu, sd = train.mean(0), train.std(0, ddof=1)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    b, _ = newton(np.column_stack([np.ones(len(y)), (train - mu) / sd]), y, w, 1 / 0.3)
    return 1 / (1 + np.exp(-(b[0] + (every - mu) / sd @ b[1:])))


@needs_tables
def test_panels_are_scored_and_not_learned(spark):
    a = {r.eeg_id: r for r in model_queries.amounts(spark, DATA).collect()}
    s = {r.eeg_id: r for r in model_queries.states(spark, DATA).collect()}
    ids = sorted(a)
    x = np.array([[a[i].mean, a[i].p90, a[i].top, a[i].prev] for i in ids])
    y = np.array([s[i].case for i in ids])
    own = np.array(ids) % 4 != 0
    got = dict(library.QUERIES["ml04_panel_scores"](spark, DATA).collect())
    assert sorted(got) == ids
    assert [got[i] for i in ids] == pytest.approx(list(head_scores(x[own], y[own], x)), abs=2e-4)
    x = np.array([[a[i].mean, a[i].top, s[i].sleep - s[i].wake] for i in ids])
    drawn = {i for c in (0, 1) for i in sorted((i for i in ids if s[i].case == c), key=lambda i: (hashlib.md5(f"0|{i}".encode()).hexdigest(), i))[:60]}
    own = np.array([i in drawn for i in ids])
    got = dict(library.QUERIES["ml05_focal_scores"](spark, DATA).collect())
    assert [got[i] for i in ids] == pytest.approx(list(head_scores(x[own], y[own], x)), abs=2e-4)


def test_cycles(spark):
    steady = [math.sin(2 * math.pi * (i + 0.5) / 10) for i in range(100)]
    broken = [v * (3 if 40 <= i < 60 else 1) for i, v in enumerate(steady)]  # two cycles of thrice the range
    rows = [(1, steady), (2, broken), (3, []), (4, None), (5, [1.0]), (6, [2.0, 2.0, 2.0])]
    d = spark.createDataFrame(rows, "id int, s array<double>")
    rms, spread = G.amplitude(F.col("s"))
    out = {r.id: r for r in G.cycles(d.withColumns({"rms": rms, "spread": spread}), "s").collect()}
    one = out[1]
    assert (one.cycles, one.longest_run) == (8, 8)  # nine upward crossings, at 10, 20, ..., 90
    assert one.period_cv == pytest.approx(0, abs=1e-9) and one.amplitude_cv == pytest.approx(0, abs=1e-9)
    assert one.above == pytest.approx(0.5) and one.rms == pytest.approx(math.sqrt(0.5))
    assert one.spread == pytest.approx(np.quantile(steady, 0.95) - np.quantile(steady, 0.05))
    assert out[2].cycles == one.cycles and out[2].longest_run < one.longest_run and out[2].amplitude_cv > 0.3
    for k in (3, 5, 6):
        assert (out[k].cycles, out[k].longest_run, out[k].period_cv, out[k].above) == (0, 0, None, None)
    assert out[3].rms is None and out[3].spread is None and out[6].rms == pytest.approx(2)
    assert out[4].rms is None and out[4].period_cv is None
