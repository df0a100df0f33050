"""Widths, waves, bursts and fields of known shapes."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from deviatix.operators import morphology as M


def test_peak_shape(spark):
    f = np.arange(0, 20.5, 0.5)
    p = np.exp(-0.5 * ((f - 6) / 1.5) ** 2) * 4
    edge = np.where(f >= 10, 20 - f, 0.0)
    rows = [("bell", [(float(a), float(b)) for a, b in zip(f, p, strict=True)]), ("edge", [(float(a), float(b)) for a, b in zip(f, edge, strict=True) if a >= 10]), ("flat", [(float(a), 1.0) for a in f]), ("none", [])]
    df = spark.createDataFrame(rows, "k string, s array<struct<f: double, p: double>>")
    got = {r.k: r.x for r in df.select("k", M.peak_shape(F.col("s"), 2.0, 15.0).alias("x")).collect()}
    assert got["bell"].peak == 6.0 and got["bell"].width == pytest.approx(2.355 * 1.5, abs=0.05) and got["bell"].q == pytest.approx(6 / 3.53, abs=0.05)
    assert got["edge"].peak == 10.0 and got["edge"].width == pytest.approx(10.0)  # falls to half in 5, twice that
    assert got["flat"].peak == 2.0 and got["flat"].width is None and got["flat"].q is None and got["none"] is None


def test_waves(spark):
    t = np.arange(400)
    sine = np.sin(2 * np.pi * (t - 3.3) / 40) + 2
    saw = ((t - 5) % 40) / 40.0  # rises for 39 samples, falls in one
    rows = [("sine", sine.tolist()), ("saw", saw.tolist()), ("flat", [1.0] * 50), ("none", []), ("null", None)]
    got = {r.k: r.x for r in spark.createDataFrame(rows, "k string, s array<double>").select("k", M.waves(F.col("s")).alias("x")).collect()}
    assert got["sine"].cycles in (8, 9) and got["sine"].rise_share == pytest.approx(0.5, abs=0.02)
    assert got["sine"].peak_sharpness == pytest.approx((2 * np.pi / 40) ** 2, rel=0.02) == got["sine"].trough_sharpness
    assert got["saw"].rise_share == pytest.approx(39 / 40) and got["saw"].peak_sharpness == pytest.approx(1.0)
    assert got["flat"].cycles == 0 and got["flat"].rise_share is None and got["flat"].peak_sharpness is None


def test_bursts(spark):
    e = [0.0, 2.0, 2.0, 0.0, 2.0, 0.0, 0.0, 2.0]
    got = spark.createDataFrame([(e,), ([],), ([0.0, 0.0],)], "e array<double>").select(M.bursts(F.col("e"), 1.0, 4.0).alias("x")).collect()
    assert (got[0].x.duty, got[0].x.burst_rate, got[0].x.cv) == pytest.approx((0.5, 1.5, 1.0))
    assert got[1].x is None and (got[2].x.duty, got[2].x.burst_rate, got[2].x.cv) == (0.0, 0.0, None)


def test_field_size(spark):
    ring = {k: [(k - 1) % 8, (k + 1) % 8] for k in range(8)}
    rows = [([0, 1, 7, 4],), ([],), ([0, 2, 4, 6],), (list(range(8)),), ([3, 3, 99],), ([6, 2, 4, 3, 5],)]
    got = [(r.x.extent, r.x.largest) for r in spark.createDataFrame(rows, "a array<int>").select(M.field_size(F.col("a"), ring).alias("x")).collect()]
    assert got == [(4, 3), (0, 0), (4, 1), (8, 8), (2, 1), (5, 5)]
