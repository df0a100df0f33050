"""Box-Cox-t curves: known parameters come back, fallbacks are taken, deviations are standard normal."""

from __future__ import annotations

import numpy as np
import pytest

from deviatix.functions.special import bct_z_np
from deviatix.operators import parametric as P

GRID = [0.0, 0.5, 1.0]


def draw(r, n, mu, sigma, nu, tau):
    """Values of a Box-Cox-t by inverting the power transform of t draws within its cut."""
    out = np.zeros(0)
    while len(out) < n:
        t = r.standard_t(tau, n) if tau else r.normal(0, 1, n)
        base = 1 + nu * sigma * t
        out = np.concatenate([out, mu * base[base > 0] ** (1 / nu)])
    return out[:n]


def test_fit_finds_its_parameters():
    r = np.random.default_rng(1)
    at = np.arange(1, 100) / 100
    for mu, sigma, nu, tau in ((12.0, 0.3, 0.5, 5.0), (2.0, 0.15, -0.8, 8.0)):
        y = draw(r, 400_000, mu, sigma, nu, tau)
        got = P.fit_quantiles(np.quantile(y, at), at, False)
        assert got == pytest.approx((mu, sigma, nu, tau), rel=0.12)
    y = draw(r, 200_000, 5.0, 0.2, 1.5, None)
    assert P.fit_quantiles(np.quantile(y, at), at, True)[:3] == pytest.approx((5.0, 0.2, 1.5), rel=0.05)
    assert P.fit_quantiles(np.full(99, 3.0), at, False) is None
    assert P.fit_quantiles(np.linspace(-1, 1, 99), at, False) is None


def test_cdf_is_that_of_z():
    y = np.array([0.5, 1.0, 3.0, 9.0])
    from deviatix.functions.special import norm_cdf_np

    for pars in ((2.0, 0.4, 0.7, 6.0), (2.0, 0.4, -0.7, 6.0), (2.0, 0.4, 0.0, 6.0), (2.0, 0.4, 0.5, 1e6)):
        assert P.bct_cdf(y, *pars) == pytest.approx(norm_cdf_np(bct_z_np(y, *[np.full(4, p) for p in pars])), abs=1e-8)


def test_curves_fall_back_by_cell(spark):
    r = np.random.default_rng(2)
    n = 6000
    age = r.random(n)
    t_like = draw(r, n, 10.0, 0.25, 0.5, 4.0) * (1 + age)
    normal = draw(r, n, 10.0, 0.2, 1.0, None)
    mixed = np.where(r.random(n) < 0.9, 2.0, -1.0)
    rows = [(k, float(a), float(v)) for k, values in (("t", t_like), ("normal", normal), ("steps", mixed)) for a, v in zip(age, values, strict=True)]
    rows += [("few", 0.5, float(v)) for v in r.normal(10, 1, 120)] + [(None, 0.5, 1.0), ("t", None, 1.0), ("t", 0.5, None)]
    df = spark.createDataFrame(rows, "cell string, age double, v double")
    curve = P.bct_curve(df, ["cell"], "age", "v", GRID, 0.15, ranks=29).cache()
    fam = {x.cell: x.fam for x in curve.collect()}
    assert fam["t"] == "BCT" and fam["normal"] in ("BCCG", "BCT") and fam["steps"] == "NO"
    t = {x.g: x for x in curve.where("cell = 't'").collect()}
    assert set(t) == set(GRID) and t[0.5].mu == pytest.approx(15, rel=0.06) and 2.5 < t[0.5].tau < 9
    z = P.bct_deviation(df, curve, ["cell"], "age", "v")
    assert z.count() == len(rows)
    own = np.array([x.z for x in z.where("cell = 't' AND z IS NOT NULL").collect()])
    assert len(own) == n and abs(own.mean()) < 0.06 and own.std() == pytest.approx(1, abs=0.06)
    assert all(x.z is None for x in z.where("cell IS NULL OR v IS NULL OR age IS NULL").collect())
    # halfway between two grid points the numbers are the means of theirs
    half = P.bct_deviation(spark.createDataFrame([("t", 0.25, 12.0), ("t", 9.0, 12.0), ("t", 0.25, -1.0)], "cell string, age double, v double"), curve, ["cell"], "age", "v").collect()
    pars = [np.array([(getattr(t[0.0], k) + getattr(t[0.5], k)) / 2]) for k in ("mu", "sigma", "nu", "tau")]
    assert half[0].z == pytest.approx(bct_z_np(np.array([12.0]), *pars)[0]) and half[2].z is None
    assert half[1].z == pytest.approx(bct_z_np(np.array([12.0]), *[np.array([getattr(t[1.0], k)]) for k in ("mu", "sigma", "nu", "tau")])[0])
