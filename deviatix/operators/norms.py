"""Reference curves by age and state, and deviations from them.

A kernel curve weighs the rows within reach of every grid point. Rows are first counted by (cell, age, value). Quantiles
come from the histogram search of ``quantiles``, in which a grid point is a column of sums: no row is repeated for it, and
no task sorts or holds a cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .quantiles import Series, first_reaching, percentiles, same, sized


def kernel(distance: Column, bandwidth: float) -> Column:
    return F.exp(-0.5 * (distance / bandwidth) * (distance / bandwidth))


def grid_weights(points: DataFrame, grid: list[float], x: str, bandwidth: float, reach: float = 4.0) -> DataFrame:
    """(x, g, w) for the distinct x of ``points`` and the grid points within ``reach`` bandwidths. One row per distinct
    x is exploded over the grid's array, a parameter of some hundred values at most."""
    near = F.filter(F.array(*[F.lit(float(g)) for g in grid]), lambda g: F.abs(g - F.col(x)) <= reach * bandwidth)
    out = points.select(x).where(F.col(x).isNotNull()).distinct().select(x, F.explode(near).alias("g"))
    return out.withColumn("w", kernel(F.col("g") - F.col(x), bandwidth))


def _counts(df: DataFrame, cell: list[str], x: str, value: str) -> DataFrame:
    """cell, _x, _v, _n: the written counts of distinct ages and values; nulls and NaN are left out."""
    rows = df.select(*cell, F.col(x).cast("double").alias("_x"), F.col(value).cast("double").alias("_v"))
    rows = rows.where(F.col("_x").isNotNull() & F.col("_v").isNotNull() & ~F.isnan("_x") & ~F.isnan("_v"))
    return stored(rows.groupBy(*cell, "_x", "_v").agg(F.count(F.lit(1)).alias("_n")), "counts")


def _series(grid: list[float], bandwidth: float, reach: float) -> list[Series]:
    far = lambda g: f"abs(_x - CAST({float(g)!r} AS DOUBLE))"
    width = f"CAST({float(bandwidth)!r} AS DOUBLE)"
    return [Series(float(g), f"{far(g)} <= {float(reach * bandwidth)!r}", f"_n * exp(-0.5D * ({far(g)} / {width}) * ({far(g)} / {width}))") for g in grid]


def _points(counts: DataFrame, cell: list[str], grid: list[float], bandwidth: float, reach: float) -> DataFrame:
    """cell, g, weight, w2 (sum of squared weights) and rows of the grid points that have any."""
    ages = counts.groupBy(*cell, "_x").agg(F.sum("_n").alias("_n"))
    series = _series(grid, bandwidth, reach)
    kinds = [("weight", "{w}"), ("w2", "{w} * {w} / _n"), ("rows", "CAST(_n AS DOUBLE)")]
    weighed = ages.selectExpr(*[f"`{c}`" for c in cell], "_n", *[f"CASE WHEN {s.where} THEN {s.weight} END AS _k{i}" for i, s in enumerate(series)])
    sums = [f"sum(CASE WHEN _k{i} IS NOT NULL THEN {e.format(w=f'_k{i}')} END)" for i in range(len(series)) for _, e in kinds]
    wide = weighed.groupBy(*cell).agg(F.expr(f"array({', '.join(sums)}) AS _all"))
    labels = ", ".join(f"CAST({s.label!r} AS DOUBLE)" for s in series)
    return wide.selectExpr(*[f"`{c}`" for c in cell], f"inline(transform(array({labels}), (g, i) -> struct(g AS g, _all[3 * i] AS weight, _all[3 * i + 1] AS w2, CAST(_all[3 * i + 2] AS BIGINT) AS rows)))").where("rows > 0")


def _at_quantiles(counts: DataFrame, cell: list[str], grid: list[float], bandwidth: float, reach: float, quantiles: dict[str, float], points: DataFrame | None = None, min_weight: float = 0.0) -> DataFrame:
    """The values of ``first_reaching`` at the quantiles of each point of ``points`` (else of those of ``min_weight``),
    with q, weight and the points' columns."""
    each = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(q)).alias("q")) for k, q in quantiles.items()])

    def ranks(totals: DataFrame) -> DataFrame:
        own = totals.withColumnRenamed("w", "weight").where(F.col("weight") >= min_weight)
        if points is not None:
            own = same(own, points.drop("weight", "w2"), [*cell, "g"])
        return own.select("*", F.inline(each)).withColumn("need", F.col("q") * F.col("weight"))

    return first_reaching(counts, cell, "_v", _series(grid, bandwidth, reach), ranks)


def mean_sd_curve(df: DataFrame, cell: list[str], x: str, value: str, grid: list[float], bandwidth: float, reach: float = 4.0, min_weight: float = 0.0) -> DataFrame:
    """Kernel mean and population SD at each grid point: sums only."""
    rows = df.where(F.col(x).isNotNull() & F.col(value).isNotNull()).groupBy(*cell, x).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    rows = rows.join(grid_weights(df, grid, x, bandwidth, reach).hint("merge"), x)
    w = F.sum(F.col("w") * F.col("n"))
    mu = F.sum(F.col("w") * F.col("s")) / w
    out = rows.groupBy(*cell, "g").agg(w.alias("weight"), mu.alias("mu"), (F.sum(F.col("w") * F.col("q")) / w).alias("q"))
    return out.where(F.col("weight") >= min_weight).select(*cell, "g", "weight", "mu", F.sqrt(F.greatest(F.col("q") - F.col("mu") * F.col("mu"), F.lit(0.0))).alias("sd"))


def quantile_curve(df: DataFrame, cell: list[str], x: str, value: str, grid: list[float], bandwidth: float, quantiles: dict[str, float], reach: float = 4.0, min_effective: float = 0.0, min_weight: float = 0.0, midpoint: bool = True, effective: bool = True) -> DataFrame:
    """Kernel-weighted quantiles at each grid point: cell, g, weight, n_eff and a column per quantile.

    With ``midpoint`` the share of a value is that of the weights before it and half of its own; quantiles are linear
    between the values on either side, and the end values beyond the ends. Else the first value whose cumulative
    share reaches the quantile. Equal values count as one with their common weight. Without ``effective``, n_eff is
    not asked for and null.
    """
    counts = _counts(df, cell, x, value)
    points = _points(counts, cell, grid, bandwidth, reach).withColumn("n_eff", F.col("weight") * F.col("weight") / F.col("w2")).where(F.col("n_eff") >= min_effective)
    found = _at_quantiles(counts, cell, grid, bandwidth, reach, quantiles, points if effective else None, min_weight)
    found = found if effective else found.withColumn("n_eff", F.lit(None).cast("double"))
    v, total, q = F.col("v"), F.col("weight"), F.col("q")
    own, before, after = ((F.col("below") + F.col("w") / 2) / total, (F.col("below") - F.col("w_previous") / 2) / total, (F.col("below") + F.col("w") + F.col("w_next") / 2) / total)
    lower = F.when(F.col("previous").isNull(), v).otherwise(F.col("previous") + (v - F.col("previous")) * (q - before) / (own - before))
    upper = F.when(F.col("next").isNull(), v).otherwise(v + (F.col("next") - v) * (q - own) / (after - own))
    found = found.withColumn("_at", F.when(own >= q, lower).otherwise(upper) if midpoint else v)
    return found.groupBy(*cell, "g").agg(F.first("weight").alias("weight"), F.first("n_eff").alias("n_eff"), *[F.max(F.when(F.col("name") == k, F.col("_at"))).alias(k) for k in quantiles])


def robust_curve(df: DataFrame, cell: list[str], x: str, value: str, grid: list[float], bandwidth: float = 0.08, trim: tuple[float, float] = (0.002, 0.998), min_rows: int = 50, min_weight: float = 20.0, min_points: int = 10) -> DataFrame:
    """Location (kernel median) and scale (kernel IQR / 1.349) per cell, after trimming the cell's extremes."""
    edges = stored(percentiles(df, cell, value, {"_lo": trim[0], "_hi": trim[1]}).where(F.col("n") >= min_rows), "edges")
    kept = same(df.select(*cell, x, value), edges, cell, hint=sized(edges)).where((F.col(value) >= F.col("_lo")) & (F.col(value) <= F.col("_hi")))
    out = quantile_curve(kept, cell, x, value, grid, bandwidth, {"mu": 0.5, "q1": 0.25, "q3": 0.75}, min_weight=min_weight, effective=False)
    out = out.select(*cell, "g", "mu", F.greatest((F.col("q3") - F.col("q1")) / 1.349, F.lit(1e-6)).alias("sigma"))
    return out.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*cell))).where(F.col("_n") >= min_points).drop("_n")


def deviation(df: DataFrame, curve: DataFrame, cell: list[str], x: str, value: str) -> DataFrame:
    """z of each row from its cell's curve (g, mu, sigma) at x, linear between grid points; null without a cell."""
    points = stored(curve.groupBy(*cell).agg(F.array_sort(F.collect_list(F.struct("g", "mu", "sigma"))).alias("_p")), "points")
    out = df.join(points.hint(sized(points)), cell, "left")
    xs = F.least(F.greatest(F.col(x), F.get("_p", 0)["g"]), F.element_at("_p", -1)["g"])
    left = F.try_element_at(F.filter("_p", lambda p: p["g"] <= xs), F.lit(-1))
    right = F.get(F.filter("_p", lambda p: p["g"] >= xs), 0)
    out = out.withColumns({"_l": left, "_r": right, "_x": xs})
    share = F.when(F.col("_l.g") == F.col("_r.g"), 0.0).otherwise((F.col("_x") - F.col("_l.g")) / (F.col("_r.g") - F.col("_l.g")))
    line = lambda f: F.col(f"_l.{f}") + (F.col(f"_r.{f}") - F.col(f"_l.{f}")) * share
    return out.withColumn("z", (F.col(value) - line("mu")) / line("sigma")).drop("_p", "_l", "_r", "_x")


def pair_norms(df: DataFrame, cell: list[str], difference: str) -> DataFrame:
    sd = F.coalesce(F.nullif(F.stddev_pop(difference), F.lit(0.0)), F.lit(1.0))
    return df.groupBy(*cell).agg(F.avg(difference).alias("mu"), sd.alias("sd"))


def empirical_share(rows: DataFrame, null: DataFrame, cell: list[str], value: str) -> DataFrame:
    """share = (null values <= own) / (n + 1), held within 1/(n+1) and n/(n+1): from one merged ordering, no pairs."""
    # values are counted first, so a window orders a cell's distinct values; the counts meet the rows by a merge join
    every = rows.select(*cell, value).withColumn("_null", F.lit(0)).unionByName(null.select(*cell, value).withColumn("_null", F.lit(1)))
    counts = every.groupBy(*cell, value).agg(F.sum("_null").alias("_c"))
    w = Window.partitionBy(*cell)
    counts = counts.withColumns({"_b": F.sum("_c").over(w.orderBy(value)), "_n": F.sum("_c").over(w)}).select(*[F.col(c).alias(f"_k_{c}") for c in [*cell, value]], "_b", "_n")
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*cell, value]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    out = rows.join(counts.hint("merge"), on)
    return out.withColumn("share", F.least(F.greatest(F.col("_b"), F.lit(1)), F.col("_n")) / (F.col("_n") + 1)).select(*rows.columns, "share")


def out_of_fold(df: DataFrame, fold: str, folds: int, fit) -> DataFrame:
    """``fit`` over the rows of all other folds, with ``fold`` as part of the cell: each row is repeated for the folds
    that it is not in, so one pass fits all."""
    others = df.withColumn("_fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where(F.col("_fold") != F.col(fold)).drop(fold)
    return fit(others.withColumnRenamed("_fold", fold))


def _first_rows(counts: DataFrame, cell: list[str], found: DataFrame, series: list[Series]) -> DataFrame:
    """cell, g, v, first: the weight of one row of a found value, of the least x that the series weighs."""
    values = stored(found.select(*cell, "v").distinct(), "values")
    near = same(counts.withColumnRenamed("_v", "v"), values, [*cell, "v"], hint=sized(values))
    firsts = ", ".join(f"min(CASE WHEN {s.where} THEN struct(_x, ({s.weight}) / _n AS w) END).w" for s in series)
    labels = ", ".join(f"CAST({s.label!r} AS DOUBLE)" for s in series)
    wide = near.groupBy(*cell, "v").agg(F.expr(f"array({firsts}) AS _all"))
    return wide.selectExpr(*[f"`{c}`" for c in cell], "v", f"inline(transform(array({labels}), (g, i) -> struct(g AS g, _all[i] AS first)))").where("first IS NOT NULL")


def local_quantile_curve(df: DataFrame, cell: list[str], x: str, value: str, grid: list[float], bandwidth: float, quantiles: dict[str, float], min_rows: int = 25, least_weight: float = 1e-4) -> DataFrame:
    """Kernel quantiles at grid points with ``min_rows`` rows of a weight above ``least_weight``: linear between rows at their
    cumulative shares (no midpoints), the first value below the first share.

    Each row has its own share. Of rows of equal values, in the order of x, the first one ends the line from the value
    before, and shares between the first and the last of them give the value itself.
    """
    reach = math.sqrt(-2 * math.log(least_weight))
    counts = _counts(df, cell, x, value)
    points = _points(counts, cell, grid, bandwidth, reach).where(F.col("rows") >= min_rows)
    found = stored(_at_quantiles(counts, cell, grid, bandwidth, reach, quantiles, points), "found")
    found = same(found, _first_rows(counts, cell, found, _series(grid, bandwidth, reach)), [*cell, "g", "v"])
    v, q, before = F.col("v"), F.col("q"), F.col("below") / F.col("weight")
    last, first = (F.col("below") + F.col("w")) / F.col("weight"), F.col("first") / F.col("weight")
    line = F.col("previous") + (v - F.col("previous")) * F.least((q - before) / first, F.lit(1.0))
    found = found.withColumn("_at", F.when(F.col("previous").isNull() | (last < q), v).otherwise(line))
    return found.groupBy(*cell, "g").agg(F.first("rows").alias("rows"), *[F.max(F.when(F.col("name") == k, F.col("_at"))).alias(k) for k in quantiles])


def reference_sample(df: DataFrame, recording: str, segment: str, recordings: int = 3000, per_recording: int = 250, seed: str = "0") -> DataFrame:
    """Segments of a reference: up to so many recordings and segments of each, by hash order. A sample by design."""
    from .windows import capped, hash_order

    ids = df.select(recording).distinct().orderBy(hash_order(recording, seed=seed), recording).limit(recordings)  # a parameter's rows
    return capped(df.join(F.broadcast(ids), recording, "left_semi"), [recording], [segment], per_recording, seed)


def side_differences(df: DataFrame, keys: list[str], region: str, value: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """keys, pair, difference (left less right) of each pair of regions that a segment has."""
    sides = df.groupBy(*keys).agg(*[F.max(F.when(F.col(region) == r, F.col(value))).alias(f"_{i}_{j}") for i, pair in enumerate(pairs) for j, r in enumerate(pair)])
    parts = [F.struct(F.lit(f"{a}|{b}").alias("pair"), (F.col(f"_{i}_0") - F.col(f"_{i}_1")).alias("difference")) for i, (a, b) in enumerate(pairs)]
    return sides.select(*keys, F.explode(F.array(*parts)).alias("d")).select(*keys, "d.*").where("difference IS NOT NULL")


def burden_profile(df: DataFrame, key: str, order: str, z: str, tau: float = 1.0, seconds: float = 15, step: float = 14) -> DataFrame:
    """Per recording: prevalence, severity (median above tau, 0 without any), burden and longest run in minutes, over the
    segments whose z is known; all null where none is. Windows and aggregates share one exchange by recording."""
    own = Window.partitionBy(key).orderBy(order)
    c = F.col(z)
    hit = F.coalesce(c > tau, F.lit(False))
    rows = df.select(key, order, c).withColumn("_hit", hit).withColumn("_off", F.sum((~F.col("_hit")).cast("long")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.sum(F.col("_hit").cast("long")).over(Window.partitionBy(key, "_off"))
    out = rows.withColumn("_run", F.when(F.col("_hit"), run).otherwise(0)).groupBy(key).agg(
        F.avg(F.when(c.isNotNull(), F.col("_hit").cast("double"))).alias("prevalence"), F.coalesce(F.percentile(F.when(F.col("_hit"), c), F.lit(0.5)), F.lit(0.0)).alias("severity"),
        F.avg(F.greatest(c - tau, F.when(c.isNotNull(), F.lit(0.0)))).alias("burden"), F.max("_run").alias("_run"), F.count(z).alias("known"))
    minutes = F.when(F.col("_run") > 0, (seconds + (F.col("_run") - 1) * step) / 60).otherwise(0.0)
    known = F.col("known") > 0
    return out.select(key, "prevalence", F.when(known, F.col("severity")).alias("severity"), F.when(known, F.col("burden")).alias("burden"), F.when(known, minutes).alias("longest"))


def lms_curve(df: DataFrame, cell: list[str], x: str, value: str, grid: list[float], bandwidth: float, powers: list[float], reach: float = 4.0, min_weight: float = 20.0) -> DataFrame:
    """Box-Cox normal curves of a positive value: cell, g, weight, l, m, s, by weighted maximum likelihood over ``powers``.

    Rows are summed once by cell and x: their number, mean log, and mean and variance of each power of the value. Kernel
    weights then apply to these few rows, so no row of the input is repeated. Values of 0 or less, nulls and points of
    less weight than ``min_weight`` are left out; of equally likely powers the lowest is taken. A value that never
    varies has no likelihood: null l, m, s.
    """
    own = df.where((F.col(value) > 0) & F.col(x).isNotNull()).select(*cell, F.col(x).cast("double").alias("_x"), F.log(value).alias("_ln"))
    power = lambda p: F.exp(F.col("_ln") * p) if p else F.col("_ln")
    sums = own.groupBy(*cell, "_x").agg(F.count(F.lit(1)).cast("double").alias("_n"), F.avg("_ln").alias("_ln"), F.array(*[F.struct(F.lit(float(p)).alias("l"), F.avg(power(p)).alias("mean"), F.var_pop(power(p)).alias("var")) for p in powers]).alias("_p"))
    near = F.filter(F.array(*[F.lit(float(g)) for g in grid]), lambda g: F.abs(F.col("_x") - g) <= reach * bandwidth)
    rows = sums.withColumn("g", F.explode(near)).withColumn("_w", F.col("_n") * kernel(F.col("_x") - F.col("g"), bandwidth)).select(*cell, "g", "_w", "_ln", F.inline("_p"))
    w, mean, var = F.col("_w"), F.col("mean"), F.col("var")
    total = F.sum(w)
    fit = rows.groupBy(*cell, "g", "l").agg(total.alias("weight"), (F.sum(w * F.col("_ln")) / total).alias("_ln"), (F.sum(w * mean) / total).alias("_mean"), (F.sum(w * (var + mean * mean)) / total - (F.sum(w * mean) / total) ** 2).alias("_var"))
    fit = fit.where(F.col("weight") >= min_weight)
    p, scale = F.col("l"), F.sqrt(F.greatest("_var", F.lit(0.0)))
    m = F.when(p == 0, F.exp("_mean")).otherwise(F.exp(F.log("_mean") / p))
    s = F.when(p == 0, scale).otherwise(scale / F.abs(p) / F.col("_mean"))
    likely = p * F.col("_ln") - F.log(F.when(p == 0, scale).otherwise(scale / F.abs(p)))
    best = F.max(F.when(scale > 0, F.struct(F.round(likely, 10).alias("k"), (-p).alias("n"), m.alias("m"), s.alias("s"))))
    return fit.groupBy(*cell, "g").agg(F.max("weight").alias("weight"), best.alias("_b")).select(*cell, "g", "weight", (-F.col("_b.n")).alias("l"), F.col("_b.m").alias("m"), F.col("_b.s").alias("s"))


def lms_z(value: Column, power: Column, m: Column, s: Column) -> Column:
    """z of a positive value in a Box-Cox normal curve."""
    return F.when(value > 0, F.when(power == 0, F.log(value / m) / s).otherwise((F.exp(power * F.log(value / m)) - 1) / (power * s)))
