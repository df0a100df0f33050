"""Channel quality, context windows and raters under a curve, on known inputs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from deviatix.operators import descriptors as D


def test_liveness_codes_and_duplicates(spark):
    r = np.random.default_rng(1)
    real = r.normal(0, 20, 400)
    part = np.concatenate([np.full(300, 5.0), r.normal(0, 20, 100)])
    channels = {
        "Fp1": real, "dead_nan": np.full(400, np.nan), "few": np.concatenate([np.full(397, np.nan), [1, 2, 3]]), "flat": np.full(400, 3.0), "weak": r.normal(0, 0.1, 400),
        "railed": np.where(np.arange(400) % 3 == 0, 900.0, r.normal(0, 20, 400)), "late": part, "copy": -3 * real + 7, "near": real + r.normal(0, 5, 400), "Fp2": 2 * real, "other": r.normal(0, 20, 400),
    }
    data = [("a", k, [float(x) for x in v]) for k, v in channels.items()] + [("b", "copy", [float(x) for x in real]), ("a", "none", None), ("a", "empty", [])]
    df = spark.createDataFrame(data, "rec string, ch string, x array<double>")
    got = {(q.rec, q.ch): q for q in D.channel_liveness(df, ["rec", "ch"], "x", rate=10.0).collect()}
    codes = {k[1]: (q.alive, q.codes, q.n_windows, q.n_alive) for k, q in got.items() if k[0] == "a"}
    assert codes["Fp1"] == (True, [], 4, 4) and codes["late"] == (True, [], 4, 1) and codes["copy"][0]
    assert codes["dead_nan"] == (False, ["D1"], 4, 0) and codes["few"] == (False, ["D1"], 4, 0)
    assert codes["flat"] == (False, ["D2", "D3"], 4, 0) and codes["weak"] == (False, ["D3"], 4, 0) and codes["railed"] == (False, ["D4"], 4, 0)
    assert codes["none"] == (False, ["D1"], 0, 0) and codes["empty"] == (False, ["D1"], 0, 0)
    dup = {(x.rec, x.ch): x.duplicate_of for x in D.duplicate_channels(df, "rec", "ch", "x", F.col("ch").startswith("Fp"), rate=10.0).collect()}
    # a listed channel stays even where it repeats; "late" has too few common samples to be judged by
    assert dup == {("a", "copy"): "Fp1"}


@pytest.mark.parametrize("width", [1, 2, 9, 30, 60, 120])
def test_context_means(spark, width):
    r = np.random.default_rng(2)
    data = [(k, i, None if r.random() < 0.1 else float(r.normal())) for k, n in (("a", 45), ("b", 200), ("c", 9), ("d", 1)) for i in range(0, 2 * n, 2)]
    got = {(x.k, x.i): (x.mean, x.padded) for x in D.context_means(spark.createDataFrame(data, "k string, i int, v double"), "k", "i", "v", width).collect()}
    assert len(got) == len(data)
    for k in "abcd":
        own = [(i, v) for key, i, v in data if key == k]
        for place, (i, _) in enumerate(own):
            low = max(min(place - width // 2, len(own) - width), 0)
            near = [v for _, v in own[low : low + width] if v is not None]
            mean, padded = got[k, i]
            assert padded == (len(own) < width)
            assert mean is None if not near else mean == pytest.approx(np.mean(near), abs=1e-9)


def test_under_curve(spark):
    r = np.random.default_rng(3)
    x, y = np.round(r.random(300), 2), r.random(300)
    raters = [(i, float(round(r.random(), 2)), float(r.random())) for i in range(200)] + [(900, -1.0, 0.5), (901, 2.0, 0.5), (902, None, 0.5), (903, 0.5, None), (900, -1.0, 0.5)]
    points = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0), (0.3, None)], "fpr double, tpr double").repartition(5)
    got = D.under_curve(points, spark.createDataFrame(raters, "id int, fpr double, tpr double"), "fpr", "tpr").collect()
    gx = np.unique(x)
    gy = np.array([y[x == g].max() for g in gx])
    assert sorted((g.id, g.under is None, bool(g.under)) for g in got) == sorted((i, a is None or b is None, False if a is None or b is None else bool(b <= np.interp(a, gx, gy))) for i, a, b in raters)
    nothing = D.under_curve(points.where("fpr > 5"), spark.createDataFrame(raters[:3], "id int, fpr double, tpr double"), "fpr", "tpr").collect()
    assert len(nothing) == 3 and all(g.under is None for g in nothing)
