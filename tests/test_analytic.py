"""Operators on inputs whose results are known."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from deviatix.functions import scalars, special
from deviatix.functions import text as T
from deviatix.operators import aggregates, contracts, joins, learning, norms, signal, stats, windows
from deviatix.sources import readers, sinks


def one(df):
    return df.collect()[0]


def test_flat_spectrum_band_powers(spark):
    """A flat density of 2: power is height times width, less the bin at the open end."""
    df = spark.createDataFrame([(1, [2.0] * 1001)], "id long, psd array<double>")
    r = one(signal.band_powers(df, "psd", 0.05))
    for band, width in (("delta", 3), ("theta", 4), ("alpha", 5)):
        assert r[band] == pytest.approx(2 * width, rel=0.04)
    r = one(signal.band_powers(df, "psd", 0.05).select(*[v.alias(k) for k, v in signal.slowing_ratios({b: F.col(b) for b in signal.BANDS}).items()]))
    assert r.dar == pytest.approx(3 / 5, rel=0.02)
    assert r.dtabr == pytest.approx(7 / 22, rel=0.02)


def test_symmetry(spark):
    rows = [(c, [3.0 if c in (1, 3) else 1.0] * 40) for c in range(4)]
    long = signal.long_spectrum(spark.createDataFrame(rows, "channel long, psd array<double>").withColumn("k", F.lit(0)), ["k", "channel"], "psd", 1.0)
    r = one(signal.hemisphere_index(long, ["k"], "channel", [0, 2], [1, 3]))
    assert r.r_sbsi == pytest.approx(0.5)
    assert r.pdbsi == pytest.approx(0.5)
    r = one(signal.hemisphere_index(long, ["k"], "channel", [0, 1], [2, 3]))
    assert r.r_sbsi == pytest.approx(0.0)
    r = one(signal.edge_and_peak(long, ["k"], 0.5, 1.0, 39.0))
    assert r.edge == pytest.approx(20.0)


def test_artifacts(spark):
    t = np.arange(3000) / 200
    rows = [(0, [0.0] * 3000), (1, [0.3] * 1500 + [0.0] * 1500), (2, (600 * np.sin(2 * np.pi * 10 * t)).tolist()), (3, (30 * np.sin(2 * np.pi * 10 * t)).tolist())]
    got = {r.seg: r.reason for r in signal.artifacts(spark.createDataFrame(rows, "seg long, samples array<double>"), ["seg"]).collect()}
    assert got == {0: "flat", 1: "flat", 2: "high_amplitude", 3: "ok"}


def test_tapers_and_multitaper(spark):
    t = signal.tapers(128)
    assert np.allclose(t @ t.T, np.eye(7), atol=1e-8)
    x = np.sin(2 * np.pi * 10 * np.arange(256) / 64)
    psd = one(signal.multitaper(spark.createDataFrame([(1, x.tolist())], "id long, samples array<double>"), ["id"], "samples", 64.0)).psd
    assert abs(np.argmax(psd) * 64 / 256 - 10) <= 1
    kept = one(signal.bandpass(spark.createDataFrame([(1, (x + 5).tolist())], "id long, samples array<double>"), ["id"], "samples", 64.0, 1, 20)).samples
    assert np.allclose(kept, x, atol=1e-6)


def test_segments_have_no_partial_end(spark):
    df = spark.createDataFrame([(1, [0.0] * 50)], "id long, samples array<double>")
    assert [r.start for r in signal.cut_segments(df, 15, 14).collect()] == [0, 14, 28]
    assert [r.start for r in signal.cut_segments(df, 15, 14, most=30).collect()] == [0, 14]


def test_special_functions():
    assert special.norm_ppf_np(special.norm_cdf_np(np.array([-3.0, -0.5, 0, 2]))) == pytest.approx([-3, -0.5, 0, 2])
    assert special.t_cdf_np([1.0, -2.0, 0.0], [1.0, 5.0, 3.0]) == pytest.approx([0.75, 0.0509697, 0.5], abs=1e-6)
    assert special.gamma_sf_np(np.array([0.5, 1.0]), np.array([3.841459 / 2, 2.0])) == pytest.approx([0.05, np.exp(-2)], abs=1e-6)
    y = np.array([1.0, 2.0, 3.0])
    assert special.bct_z_np(y, 2.0, 0.2, 1.0, 1e6) == pytest.approx((y / 2 - 1) / 0.2, abs=1e-3)
    assert special.bct_z_np(y, 2.0, 0.3, 0.0, 1e6) == pytest.approx(np.log(y / 2) / 0.3, abs=1e-6)


def test_burden(spark):
    df = spark.createDataFrame([(float(z),) for z in (0, 1, 3, 4, 0, 5)], "z double")
    r = one(df.agg(aggregates.prevalence(F.col("z"), 2.0).alias("p"), aggregates.severity(F.col("z"), 2.0).alias("s"), aggregates.burden(F.col("z"), 2.0).alias("b")))
    assert (r.p, r.s, r.b) == (0.5, 4.0, 1.0)


def test_runs(spark):
    flags = [0, 1, 1, 0, 1, 1, 1, 0, 0, 1]
    df = spark.createDataFrame([(1, i if i < 6 else i + 1, bool(f)) for i, f in enumerate(flags)] + [(2, 0, False)], "k long, i long, f boolean")
    got = {r.k: (r.longest, r.episodes, r["median"]) for r in windows.persistence(df, "k", "i", F.col("f")).collect()}
    assert got[1] == (pytest.approx(43 / 60), 3, pytest.approx(29 / 60))
    assert got[2] == (0.0, 0, 0.0)
    assert windows.islands(df, "k", "i", F.col("f"), require_contiguous=True).count() == 4


def test_weighted_quantiles_are_of_midpoints(spark):
    df = spark.createDataFrame([("a", 10.0, float(v)) for v in (1, 2, 3, 4)], "cell string, age double, v double")
    r = one(norms.quantile_curve(df, ["cell"], "age", "v", [10.0], 5.0, {"m": 0.5, "lo": 0.0, "hi": 1.0}))
    assert (r.m, r.lo, r.hi, r.weight, r.n_eff) == (2.5, 1.0, 4.0, 4.0, 4.0)


def test_deviation_clamps_and_interpolates(spark):
    curve = spark.createDataFrame([("a", 0.0, 0.0, 1.0), ("a", 10.0, 10.0, 3.0)], "cell string, g double, mu double, sigma double")
    rows = spark.createDataFrame([("a", 5.0, 9.0), ("a", -3.0, 2.0), ("a", 99.0, 16.0), ("b", 1.0, 1.0)], "cell string, x double, y double")
    got = {r.y: r.z for r in norms.deviation(rows, curve, ["cell"], "x", "y").collect()}
    assert got == {9.0: 2.0, 2.0: 2.0, 16.0: 2.0, 1.0: None}


def test_nearest_ties_and_one_sided(spark):
    a = spark.createDataFrame([(1, 10.0, 1), (1, 0.0, 2), (2, 5.0, 3)], "k long, t double, id long")
    b = spark.createDataFrame([(1, 8.0, 7), (1, 12.0, 5), (1, 12.0, 6)], "k long, u double, rid long")
    got = {r.id: (r.rid, r.gap) for r in joins.nearest(a, b, "k", "t", "u", "id", "rid").collect()}
    assert got == {1: (5, 2.0), 2: (7, 8.0)}


def test_auroc_and_folds(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "t int, s double")
    assert one(stats.auroc(df, "t", "s")).auroc == pytest.approx(0.875)
    r = np.random.default_rng(0)
    rows = [(i, int(i % 2), float(i % 2 + r.normal() / 2), float(r.normal())) for i in range(200)]
    p = learning.folded_scores(spark.createDataFrame(rows, "id long, y int, a double, b double"), ["a", "b"], "y", "id", 5)
    assert p.count() == 200
    assert one(stats.auroc(p, "y", "p")).auroc > 0.9


def test_text(spark):
    t = "Intermittent left temporal delta slowing (F7). No focal theta slowing on the right; slowing related to drowsiness. Theta slowing in T3."
    df = spark.createDataFrame([(t,)], "t string").select("t", T.clauses(F.col("t"), "slow").alias("c"))
    r = one(df.select(T.document_side(F.col("c")).alias("side"), T.band_word(F.col("c")).alias("band"), T.most_mentioned(F.col("c")).alias("region"), T.named_as_abnormal(F.col("t"), "(?i)slow").alias("named"), T.physiologic(F.col("t"), "(?i)slow").alias("physiologic")))
    assert (r.side, r.band, r.region, r.named, r.physiologic) == ("bilateral", "mixed", "temporal", True, True)
    assert one(spark.createDataFrame([("EEG T7-Ref",)], "x string").select(T.channel_label(F.col("x")).alias("x"))).x == "T3"


def test_scalars(spark):
    df = spark.createDataFrame([("01:02:03",), ("02:03",), ("7.5",), ("x",), (None,)], "d string")
    assert [r[0] for r in df.select(scalars.duration_seconds(F.col("d"))).collect()] == [3723.0, 123.0, 7.5, None, None]
    df = spark.createDataFrame([(0.9995,), (0.0005,), (0.21,), (0.115,)], "p double")
    assert [r[0] for r in df.select(scalars.centile_text(F.col("p"))).collect()] == [">99.9th", "<0.1st", "21st", "12th"]


def test_contract_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "W"), (1, "W"), (2, "Q"), (None, "W")], "id long, stage string")
    got = {r["check"]: r["rows"] for r in contracts.violations(df, ["id", "stage", "x"], {"stage": ["W"]}, ["id", "stage"]).collect()}
    assert got == {"null:id": 1, "value:stage": 1, "repeated_key": 1, "missing:x": 1}
    for n in (2, 0):
        assert sinks.append_new(df.where("id IS NOT NULL"), spark, f"{tmp_path}/data", f"{tmp_path}/ledger", "id") == n
    assert spark.read.parquet(f"{tmp_path}/data").count() == 3
    meta = one(sinks.freeze(df, f"{tmp_path}/frozen", "v1", "id", "stage"))
    assert (meta.rows, meta["keys"], meta.per_source) == (4, 2, {"W": 3, "Q": 1})
    sinks.write_bucketed(df, f"{tmp_path}/facts", "id", 4)
    assert readers.recordings(spark, f"{tmp_path}/facts", "id", [1]).count() == 2


def test_incremental_stream(spark, tmp_path):
    from deviatix.streaming import jobs

    for k, ids in enumerate(([1, 2], [2, 3])):
        spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        s = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
        jobs.incremental(s, f"{tmp_path}/out", f"{tmp_path}/ledger", "id", f"{tmp_path}/state").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").count() == [2, 3][k]


def test_arms_and_split(spark):
    df = spark.range(1000).select((F.col("id") % 100).alias("patient"), F.col("id").alias("rec"), (F.col("id") % 3).alias("s"))
    out = windows.patient_split(df, "patient", "s", "rec")
    assert out.groupBy("patient").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert 0.2 < out.where("split = 'test'").count() / 1000 < 0.4
