"""Joins: interval, point-in-window, as-of, exact resolution, ownership, curve lookup, matching, fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import epoch
from ..sources.shared import stored
from .quantiles import sized
from .windows import hash_rank


def in_buckets(df: DataFrame, start: Column, end: Column, width: float) -> DataFrame:
    """A row per bucket of ``width`` that [start, end) meets, so that overlap joins become equi joins."""
    first, last = F.floor(start / width), F.floor(F.greatest(start, end - 1e-9) / width)
    return df.withColumn("bucket", F.explode(F.sequence(first, last)))


def majority_state(segments: DataFrame, labels: DataFrame, key: str, start: str, end: str, at: str, state: str, width: float) -> DataFrame:
    """The state of most labels with ``at`` in [start, end); ties go to the least state; null without a label."""
    points = labels.select(key, F.col(at).alias("_at"), F.col(state).alias("_state"), F.floor(F.col(at) / width).alias("bucket"))
    hits = in_buckets(segments, F.col(start), F.col(end), width).join(points.hint("merge"), [key, "bucket"]).where((F.col("_at") >= F.col(start)) & (F.col("_at") < F.col(end)))
    n = hits.groupBy(key, start, "_state").agg(F.count(F.lit(1)).alias("_n"))
    best = n.groupBy(key, start).agg(F.min(F.struct(-F.col("_n"), F.col("_state"))).getField("_state").alias(state))
    return segments.join(best.hint("merge"), [key, start], "left")


def state_at_centre(segments: DataFrame, labels: DataFrame, key: str, centre: Column, index: str, state: str, step: float, default: str) -> DataFrame:
    """The label of the window that holds the centre: index = floor(centre / step), an equi join."""
    lab = labels.select(key, F.col(index).alias("_index"), F.col(state).alias("_state"))
    return segments.withColumn("_index", F.floor(centre / step)).join(lab, [key, "_index"], "left").withColumn(state, F.coalesce("_state", F.lit(default))).drop("_index", "_state")


def nearest(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, left_id: str, right_id: str, cap: float | None = None) -> DataFrame:
    """For every left row the right row of its key that is nearest in time (seconds), in both directions; ties go to the
    least right id. The two neighbours come from one merged ordering by time: no pairs within a key are made, so a key
    with many rows costs a sort of them."""
    is_time = lambda df, c: dict(df.dtypes)[c].startswith("timestamp")
    seconds = lambda df, c: epoch(F.col(c)) if is_time(df, c) else F.col(c).cast("double")
    a = left.select(F.col(key).alias("k"), seconds(left, left_time).alias("t"), F.lit(1).alias("side"), F.col(left_id).cast("long").alias("lid"), F.lit(None).cast("long").alias("rid"))
    b = right.select(F.col(key).alias("k"), seconds(right, right_time).alias("t"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("lid"), F.col(right_id).cast("long").alias("rid"))
    b = b.groupBy("k", "t", "side").agg(F.first("lid").cast("long").alias("lid"), F.min("rid").alias("rid"))
    both = a.unionByName(b)
    point = F.when(F.col("side") == 0, F.struct("t", "rid"))
    w = Window.partitionBy("k").orderBy("t", "side", "lid")
    before = F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(point, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    c = both.withColumns({"p": before, "n": after}).where(F.col("side") == 1)
    dp, dn = F.col("t") - F.col("p.t"), F.col("n.t") - F.col("t")
    use_p = F.col("n").isNull() | (dp < dn) | ((dp == dn) & (F.col("p.rid") <= F.col("n.rid")))
    gap = F.when(F.col("p").isNotNull() & use_p, dp).otherwise(dn)
    rid = F.when(F.col("p").isNotNull() & use_p, F.col("p.rid")).otherwise(F.col("n.rid"))
    out = c.select(F.col("lid").alias(left_id), rid.alias(right_id), gap.alias("gap"))
    return out.where(F.col(right_id).isNotNull()) if cap is None else out.where(F.col("gap") <= cap)


def resolved(candidates: DataFrame, key: str, exact: Column, same_day: Column, target: str) -> DataFrame:
    """One target per key or a reason: the only candidate, the only exact one, the only one of the day; else refused."""
    n, e, d = F.count(F.lit(1)), F.count_if(exact), F.count_if(same_day)
    pick = lambda c: F.max(F.when(c, F.col(target)))
    g = candidates.groupBy(key).agg(n.alias("n"), e.alias("e"), d.alias("d"), F.max(target).alias("any"), pick(exact).alias("by_e"), pick(same_day).alias("by_d"))
    found = F.when(F.col("n") == 1, F.col("any")).when(F.col("e") == 1, F.col("by_e")).when((F.col("e") == 0) & (F.col("d") == 1), F.col("by_d"))
    why = F.when(F.col("n") == 1, "single").when(F.col("e") == 1, "exact").when((F.col("e") == 0) & (F.col("d") == 1), "day").when((F.col("e") > 1) | (F.col("d") > 1), "ambiguous").otherwise("no_match")
    return g.select(key, found.alias(target), why.alias("reason"))


def owned(pairs: DataFrame, report: str, date: str, gap: str) -> DataFrame:
    """Adds dates (distinct dates of the report) and clean: true for the nearest date of the report."""
    w = Window.partitionBy(report)
    n = F.size(F.collect_set(date).over(w))
    first = F.first(date).over(w.orderBy(gap, date))
    return pairs.withColumns({"dates": n.cast("long"), "clean": F.col(date) == first})


def interpolated(df: DataFrame, curve: DataFrame, cell: list[str], x: str, grid: str, value: str, clamp: bool = True) -> DataFrame:
    """Adds ``value`` at ``x`` from curve points (cell, grid, value), linear between them; outside, the end's or null.

    Each cell's points are one sorted array, joined by the cell (an equi join); the bracket is found in the array.
    """
    points = curve.groupBy(*cell).agg(F.array_sort(F.collect_list(F.struct(F.col(grid).alias("g"), F.col(value).alias("v")))).alias("_pts"))
    out = df.join(points, cell, "left")
    xs = F.col(x)
    left = F.element_at(F.filter("_pts", lambda p: p["g"] <= xs), -1)
    right = F.get(F.filter("_pts", lambda p: p["g"] >= xs), 0)
    inside = F.when(left["g"] == right["g"], left["v"]).otherwise(left["v"] + (right["v"] - left["v"]) * (xs - left["g"]) / (right["g"] - left["g"]))
    edges = F.coalesce(inside, left["v"], right["v"]) if clamp else inside
    safe = F.when(F.size(F.filter("_pts", lambda p: p["g"] <= xs)) > 0, F.lit(True))
    value_at = F.when(xs.isNull() | F.col("_pts").isNull(), None).when(safe.isNull(), F.get("_pts", 0)["v"] if clamp else None).otherwise(edges)
    return out.withColumn(value, value_at).drop("_pts")


def quota_match(pool: DataFrame, cases: DataFrame, stratum: str, pool_id: str, seed: str = "0") -> DataFrame:
    """As many rows of the pool per stratum as there are cases, by hash order."""
    quota = cases.groupBy(stratum).agg(F.count(F.lit(1)).alias("_quota"))
    order = _md5(seed, pool_id)
    return _first_of_each(pool, [stratum], quota, pool_id, order)


def through(crosswalk: DataFrame, left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of ``left`` and ``right`` that the crosswalk (left_key, right_key) brings together. Null keys and crosswalk rows that
    repeat count once or not at all; an unmatched row of either side drops out."""
    pairs = crosswalk.select(left_key, right_key).where(F.col(left_key).isNotNull() & F.col(right_key).isNotNull()).distinct()
    return pairs.join(left.hint("merge"), left_key).join(right.hint("merge"), right_key)


def _first_of_each(pool: DataFrame, keys: list[str], quota: DataFrame, unit: str, order: Column) -> DataFrame:
    """Of each group of the pool the first rows in hash order, as many as ``quota`` (keys, _quota) says."""
    quota = stored(quota, "quota")
    return hash_rank(pool, keys, order, unit).join(quota.hint(sized(quota)), keys).where(F.col("_rank") <= F.col("_quota")).select(*pool.columns)


def _md5(seed: str, unit: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.col(unit).cast("string")).cast("binary"))


def matched_controls(pool: DataFrame, cases: DataFrame, stratum: str, pool_id: str, seed: str = "0") -> DataFrame:
    """As many rows of the pool as there are cases: first up to the number of cases of each stratum, then, for what strata of
    the pool lack, others of any stratum. Adds picked_as: stratum or top_up. Both in hash order; fewer rows only if the pool
    is smaller than the cases. A null stratum takes and gives nothing in the first pass.
    """
    quota = cases.where(F.col(stratum).isNotNull()).groupBy(stratum).agg(F.count(F.lit(1)).alias("_quota"))
    own = stored(_first_of_each(pool.where(F.col(stratum).isNotNull()), [stratum], quota, pool_id, _md5(seed, pool_id)), "matched")
    need = cases.count() - own.count()
    rest = pool.join(own.select(pool_id).hint("merge"), pool_id, "left_anti").select(*pool.columns).withColumn("_all", F.lit(0))
    one = rest.limit(1).select("_all", F.lit(need).alias("_quota"))
    more = _first_of_each(rest, ["_all"], one, pool_id, _md5(f"{seed}+", pool_id)).drop("_all")
    return own.withColumn("picked_as", F.lit("stratum")).unionByName(more.withColumn("picked_as", F.lit("top_up")))


def bridge_pairs(df: DataFrame, keys: list[str], region: str, left: str, right: str, value: str) -> DataFrame:
    """Left less right of a pair by conditional aggregates: one grouping, no self join."""
    pick = lambda side: F.max(F.when(F.col(region) == side, F.col(value)))
    return df.groupBy(*keys).agg((pick(left) - pick(right)).alias("difference"))


def majority_or_nearest(segments: DataFrame, labels: DataFrame, key: str, start: str, end: str, at: str, state: str, width: float, segment_id: str, label_id: str) -> DataFrame:
    """``majority_state``; where no label lies in a segment, the state of the label nearest to its centre (of equally near
    ones that of the least id); null for keys without labels."""
    inside = majority_state(segments, labels, key, start, end, at, state, width)
    centre = inside.where(F.col(state).isNull()).withColumn("_centre", (F.col(start) + F.col(end)) / 2)
    near = nearest(centre, labels, key, "_centre", at, segment_id, label_id).select(segment_id, label_id)
    near = near.join(labels.select(label_id, F.col(state).alias("_near")).hint("merge"), label_id).select(segment_id, "_near")
    return inside.join(near.hint("merge"), segment_id, "left").withColumn(state, F.coalesce(state, "_near")).drop("_near")
