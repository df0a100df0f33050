"""Box-Cox-t curves by age: bounded fits over exact kernel quantiles, with fallbacks, and deviations from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import bct_z, norm_cdf_np, t_cdf_np
from ..sources.shared import stored
from .norms import quantile_curve, robust_curve
from .quantiles import same, sized

#: Degrees of freedom that count as infinite, and those beyond which the t curve says no more than the normal one.
NORMAL, MOST_DF = 1e6, 200.0
#: Steps of a fit.
STEPS = 1500


def simplex(f: Callable[[np.ndarray], float], start: np.ndarray, step: np.ndarray, steps: int = STEPS, tolerance: float = 1e-9) -> tuple[np.ndarray, bool]:
    """(least point, whether it converged) of a function of a few numbers, by reflected, expanded and shrunk simplexes."""
    points = np.vstack([start, *[start + step * e for e in np.eye(len(start))]])
    values = np.array([f(p) for p in points])
    for _ in range(steps):
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if not np.isfinite(values[0]):
            return points[0], False
        if np.isfinite(values[-1]) and values[-1] - values[0] < tolerance * (1 + abs(values[0])) and np.abs(points - points[0]).max() < 1e-4:
            return points[0], True
        centre = points[:-1].mean(axis=0)
        away = centre + (centre - points[-1])
        at_away = f(away)
        if at_away < values[0]:
            far = centre + 2 * (centre - points[-1])
            at_far = f(far)
            points[-1], values[-1] = (far, at_far) if at_far < at_away else (away, at_away)
        elif at_away < values[-2]:
            points[-1], values[-1] = away, at_away
        else:
            near = centre + 0.5 * ((away if at_away < values[-1] else points[-1]) - centre)
            at_near = f(near)
            if at_near < min(at_away, values[-1]):
                points[-1], values[-1] = near, at_near
            else:
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = [f(p) for p in points[1:]]
    return points[0], False


def bct_cdf(y: np.ndarray, mu: float, sigma: float, nu: float, tau: float) -> np.ndarray:
    """The share below each positive y, of a t (or normal) that is cut where the power transform ends."""
    below = (lambda t: norm_cdf_np(t)) if tau >= NORMAL else (lambda t: t_cdf_np(t, tau))
    with np.errstate(over="ignore"):
        t = np.log(y / mu) / sigma if abs(nu) < 1e-8 else ((y / mu) ** nu - 1) / (nu * sigma)
    edge = np.array([1 / (sigma * abs(nu))]) if abs(nu) > 1e-8 else np.array([np.inf])
    low = below(-edge)[0] if nu > 1e-8 and np.isfinite(edge[0]) else 0.0
    high = below(edge)[0] if nu < -1e-8 and np.isfinite(edge[0]) else 1.0
    return (below(t) - low) / (high - low)


def fit_quantiles(edges: np.ndarray, shares: np.ndarray, normal: bool) -> tuple[float, float, float, float] | None:
    """mu, sigma, nu, tau by the likelihood of the shares between the quantiles ``edges``; None where it doesn't converge, the
    quantiles don't vary or the degrees of freedom run off."""
    edges, first = np.unique(edges, return_index=True)
    if len(edges) < 5 or not edges[0] > 0:
        return None
    # equal quantiles are one, at the greatest share below it
    ends = np.append(first[1:] - 1, len(shares) - 1)
    weight = np.diff(np.concatenate([[0.0], shares[ends], [1.0]]))

    def cost(p: np.ndarray) -> float:
        mu, sigma, nu, tau = np.exp(p[0]), np.exp(p[1]), p[2], NORMAL if normal else np.exp(p[3])
        if not (1e-6 < sigma < 20 and abs(nu) < 20 and (normal or 1 < tau < 1e5)):
            return np.inf
        mass = np.diff(np.concatenate([[0.0], bct_cdf(edges, mu, sigma, nu, tau), [1.0]]))
        return np.inf if not (mass > 0).all() else float(-(weight * np.log(mass)).sum())

    middle = np.interp([0.25, 0.5, 0.75], shares[ends], edges)
    spread = max(np.log(middle[2] / middle[0]) / 1.349, 1e-3)
    best = None
    for nu in (1.0, 0.0, -1.0):
        start = np.array([np.log(middle[1]), np.log(spread), nu] + ([] if normal else [np.log(8.0)]))
        found, ok = simplex(cost, start, np.array([0.1, 0.2, 0.5, 0.5])[: len(start)])
        if ok and (best is None or cost(found) < cost(best) - 1e-9):
            best = found
    if best is None or not normal and np.exp(best[3]) > MOST_DF:
        return None
    return float(np.exp(best[0])), float(np.exp(best[1])), float(best[2]), NORMAL if normal else float(np.exp(best[3]))


def bct_curve(df: DataFrame, cell: list[str], x: str, value: str, grid: list[float], bandwidth: float, reach: float = 4.0, min_weight: float = 20.0, min_rows: int = 200, ranks: int = 49) -> DataFrame:
    """cell, g, mu, sigma, nu, tau, fam: curves of a positive value.

    The rows are reduced to ``ranks`` exact kernel quantiles of each grid point; each point's four numbers are those that make the
    shares between its quantiles likeliest, so a cell's fit reads (grid points) x (ranks + 2) numbers whatever its rows. A
    cell takes the first family that all its points converge in: BCT, BCCG (a normal kernel: tau of 10^6), else NO, the robust
    curve of the value with null nu and tau, as have cells of under ``min_rows`` rows. Values of 0 or less, nulls and NaN are
    left out of the first two.
    """
    shares = {f"_q{k:03d}": k / (ranks + 1) for k in range(1, ranks + 1)}
    positive = df.where(F.col(value) > 0).select(*cell, x, value)
    enough = stored(positive.where(F.col(x).isNotNull()).groupBy(*cell).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= min_rows), "cells")
    points = quantile_curve(same(positive, enough.drop("_rows"), cell, hint=sized(enough)), cell, x, value, grid, bandwidth, shares, reach, min_weight=min_weight, effective=False)
    first = F.col("g") == F.min("g").over(Window.partitionBy(*cell))  # a cell has no more points than the grid
    points = stored(points.select(*cell, "g", F.array(*shares).alias("_edges"), first.alias("_first")), "points")
    types = dict(df.select(*cell).dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in cell], "g double, mu double, sigma double, nu double, tau double"])
    at, names = np.array(list(shares.values())), ["mu", "sigma", "nu", "tau"]

    def fits(rows: DataFrame, fam: str) -> DataFrame:
        def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                found = [fit_quantiles(np.asarray(edges, float), at, fam == "BCCG") or [None] * 4 for edges in part["_edges"]]
                yield pd.concat([part[[*cell, "g"]].reset_index(drop=True), pd.DataFrame(found, columns=names, dtype=float)], axis=1)

        # dealt out by number: a fit takes seconds, and tables so small would be one task's
        tasks = max(min(rows.count(), 4 * rows.sparkSession.sparkContext.defaultParallelism), 1)
        return stored(rows.repartition(tasks).mapInPandas(fit, schema), "fits")

    def family(rows: DataFrame, fam: str) -> DataFrame:
        """The fits of the cells all of whose points converge. A cell's first point is tried alone: where it fails, the others needn't be."""
        tried = fits(rows.where("_first"), fam)
        open_ = stored(tried.where("mu IS NOT NULL").select(*cell), "cells")
        both = tried.unionByName(fits(stored(same(rows.where("NOT _first"), open_, cell, hint=sized(open_)), "points"), fam))
        whole = stored(both.groupBy(*cell).agg(F.count_if(F.col("mu").isNull()).alias("_none")).where("_none = 0").select(*cell), "cells")
        return same(both, whole, cell, hint=sized(whole)).withColumn("fam", F.lit(fam))

    fitted = family(points, "BCT")
    others = stored(same(points, stored(fitted.select(*cell).distinct(), "cells"), cell, "left_anti"), "points")
    fitted = fitted.unionByName(family(others, "BCCG"))
    known = stored(fitted.select(*cell).distinct(), "cells")
    # only the cells that are left are searched for their robust curve
    robust = robust_curve(same(df, known, cell, "left_anti", hint=sized(known)), cell, x, value, grid, bandwidth, min_points=min(10, len(grid)))
    nothing = F.lit(None).cast("double")
    return fitted.unionByName(robust.select(*cell, "g", "mu", "sigma", nothing.alias("nu"), nothing.alias("tau"), F.lit("NO").alias("fam")))


def bct_deviation(df: DataFrame, curve: DataFrame, cell: list[str], x: str, value: str) -> DataFrame:
    """Adds z and fam: each row against its cell's curve, whose numbers are linear in x between grid points and its end points'
    beyond them. Null without a cell, without x or value, and for values of 0 or less but in a robust curve."""
    names = ["mu", "sigma", "nu", "tau"]
    points = stored(curve.groupBy(*cell).agg(F.array_sort(F.collect_list(F.struct("g", *names))).alias("_p"), F.min("fam").alias("fam")), "points")
    out = same(df, points, cell, "left", hint=sized(points))
    xs = F.least(F.greatest(F.col(x), F.get("_p", F.lit(0))["g"]), F.element_at("_p", -1)["g"])
    xs = F.when(F.col(x).isNotNull(), xs)
    out = out.withColumn("_x", xs).withColumns({"_l": F.try_element_at(F.filter("_p", lambda p: p["g"] <= F.col("_x")), F.lit(-1)), "_r": F.get(F.filter("_p", lambda p: p["g"] >= F.col("_x")), F.lit(0))})
    share = F.when(F.col("_l.g") < F.col("_r.g"), (F.col("_x") - F.col("_l.g")) / (F.col("_r.g") - F.col("_l.g"))).otherwise(0.0)
    out = out.withColumns({f"_{k}": F.col(f"_l.{k}") + (F.col(f"_r.{k}") - F.col(f"_l.{k}")) * share for k in names})
    t = bct_z(F.col(value).cast("double"), F.col("_mu"), F.col("_sigma"), F.col("_nu"), F.col("_tau"))
    known = (F.col(value) > 0) & F.col("_mu").isNotNull()
    z = F.when(F.col("fam") == "NO", (F.col(value) - F.col("_mu")) / F.col("_sigma")).when(known, F.nanvl(t, F.lit(None).cast("double")))
    return out.withColumn("z", z).drop("_p", "_l", "_r", "_x", *[f"_{k}" for k in names])
