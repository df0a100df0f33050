"""Rules of text, labels, places, birth dates and local quantiles on known inputs."""

from __future__ import annotations

import datetime

import numpy as np
from pyspark.sql import functions as F

from deviatix.functions import text as T
from deviatix.operators import aggregates as A
from deviatix.operators import descriptors as D
from deviatix.operators import norms as N


def test_base_labels(spark):
    texts = [
        (0, "Left temporal slowing. Theta slow on the right frontal side."), (1, "Frontal delta. Diffuse slowing with delta and theta; left."),
        (2, "No change. Alpha left."), (3, None), (4, ""), (5, "slowing\nright occipital"), (6, "Right SLOW delta, frontocentral"), (7, "bilaterally slow occipital"),
    ]
    got = {r[0]: tuple(r)[1:] for r in spark.createDataFrame(texts, "i int, t string").select("i", *[c.alias(k) for k, c in T.base_labels(F.col("t")).items()]).collect()}
    none = (None, None, None)
    assert got == {0: (True, "theta", "left", "temporal"), 1: (True, "mixed", "bilateral", None), 2: (False, *none), 3: (False, *none), 4: (False, *none), 5: (True, *none), 6: (True, "delta", "right", "central"), 7: (True, None, "bilateral", "occipital")}


def test_section(spark):
    long = "x" * 5000
    d = spark.createDataFrame([(f"History. IMPRESSION: {long}\nend",)], "t string")
    whole, _ = T.conclusion(F.lit(None).cast("string"), F.col("t"))
    part, _ = T.conclusion(F.lit(None).cast("string"), F.col("t"), T.section_pattern(limit=1200))
    r = d.select(whole.alias("whole"), part.alias("part")).first()
    assert r.whole == f"{long}\nend" and r.part == long[:1200]


def test_labels(spark):
    raw = {"EEG T7-Ref": "T3", " fp1 ": "FP1", "POL-Fz": "FZ", "C3-A1": "C3", "C3A1": "C3", "A1": "A1", "eeg ref-p8": "T6", "E.K.G": "EKG", "Chin 1": "CHIN1", "LAH3": "LAH3", "": "", "EEG": "EEG", "M2": "M2"}
    kinds = {"T3": "scalp_eeg", "FP1": "scalp_eeg", "FZ": "scalp_eeg", "C3": "scalp_eeg", "A1": "scalp_eeg", "T6": "scalp_eeg", "M2": "scalp_eeg", "EKG": "ecg", "CHIN1": "emg"}
    d = spark.createDataFrame([(x,) for x in [*raw, None]], "x string").withColumn("label", T.channel_label(F.col("x"))).withColumn("kind", T.label_kind(F.col("label")))
    assert {r.x: (r.label, r.kind) for r in d.collect()} == {**{x: (y, kinds.get(y)) for x, y in raw.items()}, None: (None, None)}


def test_place(spark):
    # signed, temporal, frontal, posterior, gradient, region, z, left and right temporal
    rows = [
        (0, 0.1, 1.0, 1.0, 1.0, 2.0, "L_temporal", 3.0, 1.0, 1.0), (1, 0.8, 2.0, 1.0, 1.0, 0.0, "L_temporal", 3.0, 2.5, 1.5), (2, 0.8, 2.0, 1.0, 1.0, 0.0, "R_frontal", 3.0, 2.5, 1.5),
        (3, 0.1, 2.0, 1.0, 1.0, 0.0, "L_temporal", 0.5, 1.5, 1.5), (4, 0.1, 2.0, 1.0, 1.0, 0.0, "L_temporal", 2.0, 0.5, 1.5), (5, -0.3, 1.0, 2.0, 1.0, 0.0, "midline", 2.0, None, None), (6, 0.8, 2.0, 1.0, 1.0, 0.0, None, None, 2.5, 1.5),
        (7, None, 2.0, 1.0, 1.0, 0.0, "L_temporal", 2.0, 0.5, 1.5),
    ]
    d = spark.createDataFrame(rows, "i int, s double, t double, f double, p double, g double, r string, z double, lt double, rt double")
    lobes = {"temporal": F.col("t"), "frontal": F.col("f"), "posterior": F.col("p")}
    found = D.finding_place(F.col("s"), lobes, F.col("g"), F.col("r"), F.col("z"), F.col("lt"), F.col("rt"))
    got = {r[0]: tuple(r)[1:] for r in d.select("i", *[c.alias(k) for k, c in found.items()]).collect()}
    assert got == {
        0: ("frontally predominant", None, True), 1: ("left temporal", "left temporal region", True), 2: ("left temporal", None, True), 3: ("bilateral independent temporal", "both temporal regions", False),
        4: ("bilateral temporal", "the temporal region on both sides", True), 5: ("right frontal", "midline region", True), 6: ("left temporal", None, False), 7: (None, None, True),
    }
    m = spark.createDataFrame([(True, 3.0, 1.0, 2.0), (True, None, 1.0, 2.0), (False, 3.0, 1.0, None), (False, 3.0, None, None)], "f boolean, z double, a double, b double")
    assert [r.m for r in m.select(D.magnitude(F.col("f"), F.col("z"), F.col("a"), F.col("b")).alias("m")).collect()] == [3.0, 2.0, 1.0, None]


def test_birth_dates(spark):
    born, day = datetime.datetime(1990, 5, 17), datetime.timedelta(days=1)
    at = [datetime.datetime(2010, 1, 1), datetime.datetime(2015, 7, 1), datetime.datetime(2020, 3, 9)]
    age = lambda t, off=0.0: (t - born) / day / 365.25 + off
    rows = [(1, at[0], age(at[0])), (1, at[1], age(at[1])), (1, at[2], None), (2, at[0], None), (3, at[0], age(at[0])), (3, at[1], age(at[1], 1.0)), (3, at[1], age(at[1])), (None, at[0], 5.0), (4, None, 5.0), (5, at[0], float("nan"))]
    d = spark.createDataFrame(rows, "p int, t timestamp, age double")
    got = {r.p: r for r in A.birth_dates(d, "p", "t", "age").collect()}
    assert set(got) == {1, 3} and got[1].exams == 2 and got[3].exams == 3
    second = (born - datetime.datetime(1970, 1, 1)).total_seconds()
    assert abs(got[1].birth - second) < 1e-3 and got[1].spread_days < 1e-6
    assert abs(got[3].birth - second) < 1e-3 and abs(got[3].spread_days - 365.25) < 1e-6
    ages = [(r.p, r.recovered_age) for r in A.recovered_ages(d, "p", "t", "age").collect()]
    assert len(ages) == len(rows)
    known = [a for p, a in ages if p == 1]
    assert any(abs(a - age(at[2])) < 1e-9 for a in known) and all(a is None for p, a in ages if p in (2, 5))


def test_local_quantiles_count_each_row(spark):
    rng = np.random.default_rng(3)
    x, v = rng.uniform(0, 20, 400).round(1), rng.integers(0, 12, 400) / 4  # many equal values
    d = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, v, strict=True)], "c string, x double, v double")
    grid, width = [3.0, 10.0, 40.0], 3.0
    got = {r.g: r for r in N.local_quantile_curve(d, ["c"], "x", "v", grid, width, {"low": 0.1, "mid": 0.5, "high": 0.93}).collect()}
    order = np.lexsort((x, v))
    for g in grid:
        w = np.exp(-0.5 * ((x[order] - g) / width) ** 2)
        near = w >= 1e-4
        if near.sum() < 25:
            assert g not in got
            continue
        share = np.cumsum(w[near]) / w[near].sum()
        assert got[g].rows == near.sum()
        assert np.allclose([got[g].low, got[g].mid, got[g].high], np.interp([0.1, 0.5, 0.93], share, v[order][near]), atol=1e-9)
