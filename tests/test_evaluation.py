"""Cohort top-up, clustered intervals, adoption and rater agreement on known inputs."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from deviatix.operators import joins, stats


def test_matched_controls_top_up(spark):
    cases = spark.createDataFrame([("20s", i) for i in range(5)] + [("30s", i) for i in range(4)] + [("40s", 1), (None, 2)], "dec string, id int")
    data = [("20s", i) for i in range(100, 102)] + [("30s", i) for i in range(200, 230)] + [("50s", i) for i in range(300, 303)] + [(None, 400)]
    got = joins.matched_controls(spark.createDataFrame(data, "dec string, id int"), cases, "dec", "id").collect()
    order = lambda seed: lambda x: hashlib.md5(f"{seed}{x[1]}".encode()).hexdigest()
    first = [x for d, n in (("20s", 5), ("30s", 4), ("40s", 1)) for x in sorted((x for x in data if x[0] == d), key=order("0"))[:n]]
    more = sorted((x for x in data if x not in first), key=order("0+"))[: 11 - len(first)]
    assert sorted((x.id, x.picked_as) for x in got) == sorted([(i, "stratum") for _, i in first] + [(i, "top_up") for _, i in more])
    few = joins.matched_controls(spark.createDataFrame(data[:3], "dec string, id int"), cases, "dec", "id").collect()
    assert sorted(x.id for x in few) == [100, 101, 200]


def test_clustered_intervals(spark):
    r = np.random.default_rng(4)
    unit = r.integers(0, 40, 400)
    truth = (r.random(400) < 0.4).astype(int)
    good, poor = truth + r.normal(0, 1.0, 400), truth * 0.1 + r.normal(0, 1.0, 400)
    df = spark.createDataFrame([(int(u), int(t), float(a), float(b), float(-a)) for u, t, a, b in zip(unit, truth, good, poor, strict=True)], "u int, t int, good double, poor double, worse double")
    one = stats.auroc_interval(df, "t", "good", "u", 60).first()
    turned = stats.auroc_interval(df, "t", "worse", "u", 60).first()
    exact = np.mean([[(x > y) + (x == y) / 2 for y in good[truth == 0]] for x in good[truth == 1]])
    assert one.n == 400 and one.auroc == pytest.approx(exact) and one.low < exact < one.high and 0.02 < one.high - one.low < 0.2
    assert (turned.auroc, turned.low, turned.high) == pytest.approx((one.auroc, one.low, one.high))
    few = stats.auroc_interval(df.limit(10), "t", "good", "u", 5).first()
    assert few.n == 10 and few.auroc is None and few.low is None
    yes, no, same = (stats.adoption(df, "t", a, b, "u", 60).first() for a, b in (("poor", "good"), ("good", "poor"), ("good", "good")))
    assert yes.adopted and yes.low > 0 and yes.difference > 0.02
    assert not no.adopted and no.high < 0
    assert not same.adopted and (same.difference, same.low, same.high) == (0, 0, 0)
    # weights on counted rows equal weights on rows
    rows = df.withColumn("replicate", F.lit(3)).withColumn("_w", stats.poisson_weight(F.lit(3), F.col("u")).cast("double")).where("_w > 0")
    assert stats.bootstrap_auroc(df, "t", "good", "u", 5).where("replicate = 3").first().auroc == pytest.approx(stats.auroc(rows, "t", "good", ["replicate"], F.col("_w")).first().auroc)


def kappa(pairs):
    a, b = np.array(pairs).T
    po, pe = np.mean(a == b), np.mean(a) * np.mean(b) + (1 - np.mean(a)) * (1 - np.mean(b))
    return (po - pe) / (1 - pe)


def test_rater_agreement(spark):
    r = np.random.default_rng(5)
    votes = [(i, f"r{k}", int(r.random() < 0.3 + 0.4 * (i % 2)), o) for k in range(5) for i in range(40) for o in (1, 2) if r.random() < 0.8]
    df = spark.createDataFrame(votes, "item int, rater string, vote int, occasion int")
    first: dict = {}
    for i, k, v, o in sorted(votes, key=lambda x: x[3]):
        first.setdefault(k, {}).setdefault(i, []).append(v)
    got = {x.rater: x for x in stats.within_rater(df, "item", "rater", "vote", "occasion", 5).collect()}
    for k, own in first.items():
        pairs = [v[:2] for v in own.values() if len(v) > 1]
        assert got[k].n == len(pairs) and got[k].kappa == pytest.approx(kappa(pairs))
    once = df.where("occasion = 1")
    own = {k: {i: v for i, q, v, o in votes if q == k and o == 1} for k in first}
    each = [kappa([(own[a][i], own[b][i]) for i in own[a].keys() & own[b].keys()]) for a in own for b in own if a < b]
    one = stats.median_agreement(once, "item", "rater", "vote", min_votes=20, min_items=10).first()
    assert one.pairs == 10 and one.kappa == pytest.approx(np.median(each))
    assert stats.median_agreement(once, "item", "rater", "vote").first().pairs == 0


def test_contracts_and_cells(spark, tmp_path):
    from deviatix.operators import contracts, descriptors
    from deviatix.sources import sinks

    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("a", "x", 4.0), ("b", "x", None), (None, "x", 3.0), ("b", None, 0.0)], "g string, k string, v double")
    assert [(r.g, r.n) for r in contracts.crowded(df, ["g"], "k", 1).collect()] == [("a", 2)]
    assert sorted((r.g, r.k, r.n) for r in descriptors.thin_cells(df, "g", "k", 2).collect()) == [("a", "y", 1), ("b", "x", 1), ("b", "y", 0)]
    other = spark.createDataFrame([(2.0,), (4.0,), (0.0,)], "v double")
    got = {r.statistic: (r.a, r.b, r.relative) for r in contracts.summary_differences(df, other, ["v"]).collect()}
    assert got["n"] == (5, 3, 0.4) and got["median"] == (2.0, 2.0, 0.0) and got["min"] == (0.0, 0.0, 0.0) and got["max"] == (4.0, 4.0, 0.0)
    assert contracts.summary_differences(df, other.limit(0), ["v"]).where("statistic = 'median'").first().relative is None
    one = sinks.freeze(df, str(tmp_path / "t"), "v1", "g", "k").first()
    two = sinks.freeze(df.orderBy("v"), str(tmp_path / "t"), "v2", "g", "k").first()
    three = sinks.freeze(df.withColumn("v", F.col("v") + 1), str(tmp_path / "t"), "v3", "g", "k").first()
    assert one.content == two.content != three.content and one.per_source == {"x": 4, "y": 1, "": 1} and (one.rows, one["keys"]) == (6, 2)
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.freeze(df, str(tmp_path / "t"), "v1", "g", "k")


def test_laterality_and_crosswalk(spark):
    from deviatix.operators import descriptors

    rows = [("r", s, c, v) for s, vs in ((0, (3.0, 1.0, 5.0, 4.0)), (1, (1.0, 2.0, 9.0, None)), (2, (4.0, None, 1.0, 3.0))) for c, v in zip("LRAP", vs, strict=True)]
    rows += [("one", 0, "L", 1.0), ("one", 0, "R", 0.5), ("none", 0, "L", 1.0)]
    df = spark.createDataFrame(rows, "k string, s int, c string, z double")
    got = {r.k: (r.laterality, r.gradient, r.dominant) for r in descriptors.laterality(df, "k", "s", "c", "z", ["L"], ["R"], ["A"], ["P"]).collect()}
    assert got == {"r": (0.5, -0.5, "laterality"), "one": (0.5, None, "laterality"), "none": (None, None, None)}
    walk = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, None)], "p int, e string")
    both = joins.through(walk, spark.createDataFrame([(1, 0.1), (2, 0.2), (9, 0.9)], "p int, s double"), spark.createDataFrame([("a", 1), ("c", 0), ("d", 1)], "e string, v int"), "p", "e")
    assert sorted((r.p, r.e, r.s, r.v) for r in both.collect()) == [(1, "a", 0.1, 1), (2, "c", 0.2, 0)]
