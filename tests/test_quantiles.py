"""Order statistics and kernel quantiles without a task that holds a group."""

from __future__ import annotations

import glob
import json
import subprocess
import sys

import numpy as np
import pytest

from deviatix.operators import norms, quantiles


def weighted_quantile(v: np.ndarray, w: np.ndarray, q: float) -> float:
    """Midpoint shares of distinct values, linear between them."""
    at, index = np.unique(v, return_inverse=True)
    share = np.bincount(index, w)
    c = (np.cumsum(share) - share / 2) / share.sum()
    return float(np.interp(q, c, at))


def rows(n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    cell, age = r.integers(0, 3, n), r.uniform(0, 20, n)
    value = np.select([cell == 0, cell == 1], [np.exp(r.normal(0, 6, n)), r.integers(-4, 5, n).astype(float)], r.normal(0, 1, n))
    value[::97] = -1e300
    return cell, age, value


@pytest.mark.parametrize(("few", "held"), [(4, 0), (4096, 0), (4096, quantiles.HELD)])
def test_percentiles(spark, monkeypatch, few, held):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "BRANCHES", 16 if few == 4 else 512)
    cell, _, value = rows(4000)
    data = [(None if c == 2 else int(c), float(v)) for c, v in zip(cell, value, strict=True)] + [(0, None), (0, float("nan")), (9, None), (7, 5.0)]
    df = spark.createDataFrame(data, "cell int, v double").repartition(5)
    shares = {"a": 0.0, "b": 0.002, "c": 0.37, "d": 0.5, "e": 1.0}
    got = {r.cell: r for r in quantiles.percentiles(df, ["cell"], "v", shares, held).collect()}
    assert set(got) == {None, 0, 1, 7}
    for c in (0, 1, 2):
        own = value[cell == c]
        r = got[None if c == 2 else c]
        assert r.n == len(own)
        for k, q in shares.items():
            assert r[k] == pytest.approx(np.quantile(own, q), rel=1e-12, abs=1e-12)
    assert [got[7][k] for k in shares] == [5.0] * 5
    whole = quantiles.percentiles(df.where("v > -1e200"), [], "v", {"m": 0.9}, held).first()
    assert whole.m == pytest.approx(np.quantile([v for _, v in data if v is not None and v > -1e200], 0.9), rel=1e-12)
    assert quantiles.percentiles(df.where("cell = 99"), ["cell"], "v", shares, held).count() == 0


@pytest.mark.parametrize("few", [8, 4096])
def test_kernel_quantiles(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    cell, age, value = rows(1500, 4)
    df = spark.createDataFrame([(int(c), float(a), float(v)) for c, a, v in zip(cell, age, value, strict=True)], "cell int, age double, v double").repartition(3)
    grid, shares = [0.0, 6.0, 13.5, 40.0], {"a": 0.001, "b": 0.25, "c": 0.5, "d": 0.995}
    got = {(r.cell, r.g): r for r in norms.quantile_curve(df, ["cell"], "age", "v", grid, 1.5, shares, reach=2.0).collect()}
    assert set(got) == {(c, g) for c in range(3) for g in grid[:3]}
    for (c, g), r in got.items():
        own = (cell == c) & (np.abs(age - g) <= 3.0)
        w = np.exp(-0.5 * ((age[own] - g) / 1.5) ** 2)
        assert r.weight == pytest.approx(w.sum()) and r.n_eff == pytest.approx(w.sum() ** 2 / (w * w).sum())
        for k, q in shares.items():
            want = weighted_quantile(value[own], w, q)
            assert r[k] == pytest.approx(want, rel=1e-9, abs=1e-9 * np.ptp(np.sort(value[own])[1:]))


MILLION = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
from deviatix.operators import norms
s = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "16").config("spark.eventLog.enabled", "true").config("spark.eventLog.rolling.enabled", "false").config("spark.eventLog.compress", "false")
     .config("spark.sql.adaptive.coalescePartitions.enabled", "false").config("spark.eventLog.dir", "file://{log}").config("spark.checkpoint.dir", "file://{log}/shared").getOrCreate())
d = s.range(0, 1_000_000, 1, 16).select(F.lit("one").alias("cell"), (F.col("id") % 90).cast("double").alias("age"), (F.pmod(F.col("id") * 7919, F.lit(1_000_003)) / 1000).alias("v"))
for r in norms.robust_curve(d, ["cell"], "age", "v", [float(g) for g in range(0, 91, 5)], 5.0).collect():
    print("ROW", r.g, r.mu, r.sigma)
s.stop()
"""


def test_largest_task_of_a_cell_of_a_million_values(tmp_path):
    """One cell, 10^6 distinct values: no task reads over an eighth of them by a shuffle (they are dealt to 16 tasks)."""
    root = str(__import__("pathlib").Path(__file__).resolve().parent.parent)
    (tmp_path / "shared").mkdir()
    out = subprocess.run([sys.executable, "-c", MILLION.format(root=root, log=tmp_path)], capture_output=True, text=True, timeout=900, check=True).stdout
    curve = [tuple(map(float, x.split()[1:])) for x in out.splitlines() if x.startswith("ROW")]
    assert len(curve) == 19
    # values are spread evenly over each age: median and quartiles of the whole range
    assert all(mu == pytest.approx(500, abs=3) and sigma == pytest.approx(500 / 1.349, rel=0.01) for _, mu, sigma in curve)
    most = 0
    for path in glob.glob(f"{tmp_path}/*"):
        try:
            events = [json.loads(x) for x in open(path)]
        except (OSError, ValueError):
            continue
        reads = [e["Task Metrics"]["Shuffle Read Metrics"]["Total Records Read"] for e in events if e["Event"] == "SparkListenerTaskEnd" and e.get("Task Metrics")]
        most = max([most, *reads])
    assert 0 < most < 125_000, most


def test_stored_tables_are_discarded(spark):
    import os

    from deviatix.sources import shared

    shared.discard_stored(spark)
    df = shared.stored(spark.range(5), "t")
    path = shared._WRITTEN[-1].removeprefix("file://")
    assert df.count() == 5 and os.path.isdir(path)
    assert shared.discard_stored(spark) == 1 and not os.path.exists(path) and shared.discard_stored(spark) == 0
