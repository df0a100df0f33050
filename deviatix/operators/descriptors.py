"""Descriptors of recordings: pair grids, context windows, focus, localisation, liveness, rater comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import gradient_word, is_focal, leading_lobe, let, lobe_excess, side_call
from ..sources.shared import stored

EPS = 1e-12


def pair_grid(df: DataFrame, keys: list[str], z: str, thresholds: list[float]) -> DataFrame:
    """share of |z| above each threshold, and the mean sign among those (null if none)."""
    out = df.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    fires = F.abs(F.col(z)) > F.col("threshold")
    return out.groupBy(*keys, "threshold").agg(F.avg(fires.cast("double")).alias("share"), F.avg(F.when(fires, F.signum(z))).alias("sign"))


def weighted_composition(df: DataFrame, keys: list[str], fraction: str, n: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(F.col(fraction) * F.col(n)) / F.sum(n)).alias("share"))


def context_means(df: DataFrame, key: str, order: str, value: str, width: int) -> DataFrame:
    """mean over ``width`` rows around each row, shifted to fit at the ends; padded if the whole is shorter, and then over
    all of it. A null value counts for neither sum nor number; a frame of nulls has a null mean.

    Three frames over the ordered rows cover all cases: the first rows of the recording, the last ones, and the rows around
    in between. Each row keeps two numbers for a frame and none of its neighbours.
    """
    own = Window.partitionBy(key)
    w = own.orderBy(order)
    r = df.select(key, order, F.col(value).cast("double").alias("_v")).withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(own)})
    half = width // 2
    i, n, v = F.col("_i"), F.col("_n"), F.col("_v")
    first, last = i < width, i >= n - width
    around = w.rowsBetween(-half, width - half - 1)
    case = lambda start, end, middle: F.when((n <= width) | (i < half), start).when(i - half > n - width, end).otherwise(middle)
    sums = lambda c: case(F.sum(F.when(first, c)).over(own), F.sum(F.when(last, c)).over(own), F.sum(c).over(around))
    return r.select(key, order, (sums(v) / F.nullif(sums(v.isNotNull().cast("long")), F.lit(0))).alias("mean"), (n < width).alias("padded"))


def focus(df: DataFrame, key: str, value: str) -> DataFrame:
    """max, contrast (max - median) and mean of a recording's pair values."""
    return df.groupBy(key).agg(F.max(value).alias("max"), (F.max(value) - F.percentile(value, F.lit(0.5))).alias("contrast"), F.avg(value).alias("mean"))


def accent(df: DataFrame, key: str, state: str, amount: str, order: list[str]) -> DataFrame:
    """State of the greatest mean amount among those present; ties go to the first in the order."""
    m = df.groupBy(key, state).agg(F.avg(amount).alias("_m"))
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(state))
    return m.groupBy(key).agg(F.max_by(state, F.struct("_m", -rank)).alias("accent"), F.count(F.lit(1)).alias("states"))


def laterality(df: DataFrame, key: str, segment: str, region: str, z: str, left: list, right: list, anterior: list, posterior: list) -> DataFrame:
    """key, laterality (left less right), gradient (anterior less posterior), dominant: means over segments of the differences of
    a segment's region means, where both sides are known; the axis of the greater size, laterality if they are equal or the
    other is not known; null if neither is."""
    side = lambda names: F.avg(F.when(F.col(region).isin(names), F.col(z)))
    per = df.groupBy(key, segment).agg((side(left) - side(right)).alias("_l"), (side(anterior) - side(posterior)).alias("_g"))
    out = per.groupBy(key).agg(F.avg("_l").alias("laterality"), F.avg("_g").alias("gradient"))
    l, g = F.abs("laterality"), F.abs("gradient")  # noqa: E741
    return out.withColumn("dominant", F.when(l.isNull() & g.isNull(), F.lit(None).cast("string")).when(l.isNull() | (g > l), "gradient").otherwise("laterality"))


def thin_cells(df: DataFrame, a: str, b: str, target: int) -> DataFrame:
    """a, b, n: combinations of the values of two columns with fewer rows than ``target``, those without any included. The
    second column's values, a vocabulary, are one array beside each of the first's."""
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    counts = known.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    words = known.agg(F.collect_set(b).alias("_b"), F.lit(0).alias("_k"))
    every = known.select(a).distinct().withColumn("_k", F.lit(0)).join(F.broadcast(words), "_k").select(a, F.explode("_b").alias(b))
    return every.join(counts.hint("merge"), [a, b], "left").select(a, b, F.coalesce("n", F.lit(0)).cast("long").alias("n")).where(F.col("n") < target)


def peak_pair(df: DataFrame, keys: list[str], pairs: DataFrame, channel: str, value: str, side: Column, least: float = 0.5) -> DataFrame:
    """The pair with the greatest difference in the asserted direction, if over ``least``. Pairs: pair, left, right."""
    p = F.broadcast(pairs)
    l = df.join(p, F.col(channel) == F.col("left")).select(*keys, "pair", F.col(value).alias("_l"))  # noqa: E741
    r = df.join(p, F.col(channel) == F.col("right")).select(*keys, "pair", F.col(value).alias("_r"))
    d = l.unionByName(r, allowMissingColumns=True).groupBy(*keys, "pair").agg((F.max("_l") - F.max("_r")).alias("_d"))
    d = d.withColumn("_d", F.when(side == "right", -F.col("_d")).otherwise(F.col("_d"))).where(F.col("_d") > least)
    return d.groupBy(*keys).agg(F.max_by("pair", F.struct("_d", -F.col("pair"))).alias("pair"), F.max("_d").alias("difference"))


def localisation(side: Column, lobe: Column, focal: Column, general: Column, left_temporal: Column, right_temporal: Column) -> Column:
    """diffuse; bilateral independent temporal; bilateral lobe; or side and lobe: the first that applies."""
    return (
        F.when(~focal & general, "diffuse").when((left_temporal >= 1) & (right_temporal >= 1) & (lobe == "temporal"), "bilateral independent temporal")
        .when(side == "bilateral", F.concat(F.lit("bilateral "), lobe)).otherwise(F.concat_ws(" ", side, lobe))
    )


#: Of a finding's place: the least signed difference and excess of a lobe that stand by themselves, the peak that confirms
#: them, what both temporal regions exceed and the difference that they stay below. Fixed values.
CLEAR_SIDE, CLEAR_LOBE, CONFIRMED, BOTH_TEMPORAL, EVEN_SIDES = 0.5, 0.6, 1.0, 1.0, 0.4


def finding_place(signed: Column, lobes: dict[str, Column], gradient: Column, peak_region: Column, peak_z: Column, left_temporal: Column, right_temporal: Column) -> dict[str, Column]:
    """place, region, confident of a recording's finding.

    Without a focus the place is the word of the front-to-back gradient, and nothing needs confirming. A focus lies in both
    temporal regions independently, in a lobe on both sides, or in a lobe of a side. The region of the peak ("L_..", "R_..",
    else the midline) is named only where its hemisphere is the asserted one. A focus is confident if the side or a lobe
    is clear and the peak confirms it. Unknown z count as 0; an unknown difference or lobe leaves the place null.
    """
    z = lambda c: F.coalesce(c, F.lit(0.0))
    focal, lobe, side = is_focal(signed, lobes), leading_lobe(lobes), side_call(signed)
    both = (F.least(z(left_temporal), z(right_temporal)) > BOTH_TEMPORAL) & (F.abs(signed) < EVEN_SIDES) & (lobe == "temporal")
    own = F.when(peak_region.startswith("L_"), "left").when(peak_region.startswith("R_"), "right")
    name = F.concat_ws(" ", own, F.regexp_replace(peak_region, "^[LR]_", ""), F.lit("region"))
    known = signed.isNotNull() & lobe.isNotNull()
    place = F.when(~focal, gradient_word(gradient)).when(both, "bilateral independent temporal").when(known, F.concat_ws(" ", side, lobe))
    region = (
        F.when(~known | ~focal | peak_region.isNull() & ~both & (side != "bilateral"), F.lit(None)).when(both, "both temporal regions")
        .when(side == "bilateral", F.concat(F.lit("the "), lobe, F.lit(" region on both sides"))).when(own.isNull() | (own == side), name)
    )
    clear = (F.abs(signed) >= CLEAR_SIDE) | (F.greatest(*lobe_excess(lobes).values()) >= CLEAR_LOBE)
    return {"place": place, "region": region, "confident": F.when(focal, clear & (z(peak_z) >= CONFIRMED)).otherwise(F.lit(True))}


def magnitude(focal: Column, peak_z: Column, *whole: Column) -> Column:
    """The peak of a focus; without a focus, or where its peak is not known, the greatest of the whole recording's z."""
    return F.when(focal & peak_z.isNotNull(), peak_z).otherwise(F.greatest(*whole))


#: Rules of dead channels, in microvolts and shares. Fixed values.
RAILED, STILL, LEAST_SPREAD, MAD_SCALE, MISSING, LEAST_SAMPLES = 0.20, 0.999, 0.5, 1.4826, 0.99, 8


def _sample_stats(samples: Column) -> Column:
    """The numbers that the rules ask of an array's finite samples: n, low, high, shares at either, of equal neighbours, MAD, SD."""
    n = lambda x: F.greatest(F.size(x), F.lit(1)).cast("double")
    share = lambda x, v: F.size(F.filter(x, lambda y: y == v)) / n(x)
    steps = lambda x: F.zip_with(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), lambda a, b: a - b)
    middle = lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda t, y: t + y) / n(x)

    def all_of(x: Column) -> Column:
        mad = let(let(F.sort_array(x), middle), lambda m: let(F.sort_array(F.transform(x, lambda y: F.abs(y - m))), middle))
        sd = let(mean(x), lambda m: F.sqrt(F.aggregate(x, F.lit(0.0), lambda t, y: t + (y - m) * (y - m)) / n(x)))
        still = F.size(F.filter(steps(x), lambda d: d == 0)) / F.greatest(n(x) - 1, F.lit(1.0))
        return F.struct(F.size(x).alias("n"), F.array_min(x).alias("low"), F.array_max(x).alias("high"), F.greatest(share(x, F.array_max(x)), share(x, F.array_min(x))).alias("railed"), still.alias("still"), (MAD_SCALE * mad).alias("mad"), sd.alias("sd"))

    return let(F.filter(samples, _finite), all_of)


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def channel_liveness(df: DataFrame, keys: list[str], samples: str, rate: float, seconds: float = 10.0) -> DataFrame:
    """keys, alive, codes, n_windows, n_alive, live: a channel is alive if any of its windows carries a signal.

    A window is dead if it has too few finite samples (half a second, 8 at least), if it is constant, if a fifth of it stands at its
    highest or lowest value, if it doesn't move, or if MAD and SD are both below 0.5. ``codes`` of a dead channel, from all of its
    finite samples: D1 nearly all missing, D2 still, D3 hardly any spread, D4 railed; D3 where no other applies. ``live`` says of each
    window whether it is alive. A null array is a channel without samples.
    """
    width, least = max(1, round(seconds * rate)), max(LEAST_SAMPLES, int(0.5 * rate))
    alive = lambda w: (w["n"] >= least) & (w["high"] > w["low"]) & (w["railed"] < RAILED) & (w["still"] < STILL) & ~((w["mad"] < LEAST_SPREAD) & (w["sd"] < LEAST_SPREAD))

    def codes(x: Column, a: Column) -> Column:
        missing = (F.size(x) == 0) | (1 - a["n"] / F.greatest(F.size(x), F.lit(1)) >= MISSING) | (a["n"] < LEAST_SAMPLES)
        rules = {"D2": (a["n"] > 1) & (a["still"] >= STILL), "D3": (a["mad"] < LEAST_SPREAD) & (a["sd"] < LEAST_SPREAD), "D4": (a["high"] > a["low"]) & (a["railed"] >= RAILED)}
        found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda c: c.isNotNull())
        return F.when(missing, F.array(F.lit("D1"))).otherwise(let(found, lambda f: F.when(F.size(f) == 0, F.array(F.lit("D3"))).otherwise(f)))

    def verdict(x: Column) -> Column:
        starts = F.when(F.size(x) > 0, F.sequence(F.lit(0), F.size(x) - 1, F.lit(width))).otherwise(F.array().cast("array<int>"))
        live = F.transform(starts, lambda s: let(_sample_stats(F.slice(x, s + 1, width)), lambda w: F.coalesce(alive(w), F.lit(False))))

        def of(v: Column) -> Column:
            is_alive = F.exists(v, lambda y: y)
            dead = F.when(is_alive, F.array().cast("array<string>")).otherwise(let(_sample_stats(x), lambda a: codes(x, a)))
            return F.struct(is_alive.alias("alive"), dead.alias("codes"), F.size(v).alias("n_windows"), F.size(F.filter(v, lambda y: y)).alias("n_alive"), v.alias("live"))

        return let(live, of)

    # one expression, so that no step of it is evaluated again for each of its uses
    x = F.coalesce(F.transform(samples, lambda x: x.cast("double")), F.array().cast("array<double>"))
    return df.select(*keys, let(x, verdict).alias("_q")).select(*keys, *[F.col(f"_q.{c}").alias(c) for c in ("alive", "codes", "n_windows", "n_alive", "live")])


def duplicate_channels(df: DataFrame, recording: str, channel: str, samples: str, listed: Column, rate: float, seconds: float = 10.0, least: float = 0.999) -> DataFrame:
    """recording, channel, duplicate_of: channels that repeat another one of their recording, which may be dropped.

    Two live channels repeat each other if they correlate by ``least`` or more (of either sign) over the samples in windows in which
    both are alive, ten seconds at least. Of a pair the listed channel stays, else the one of the lower name; a listed channel is never
    a duplicate. A channel that repeats several names the first. Pairs are within a recording, whose channels are few.
    """
    width = max(1, round(seconds * rate))
    # written, as a condition on the verdict would be evaluated apart from its other uses
    live = stored(channel_liveness(df.select(recording, channel, samples, listed.alias("_listed")), [recording, channel, samples, "_listed"], samples, rate, seconds), "live").where("alive")
    side = lambda s: live.select(F.col(recording).alias(recording), F.col(channel).alias(f"_c{s}"), F.transform(samples, lambda x: x.cast("double")).alias(f"_x{s}"), F.col("live").alias(f"_l{s}"), F.coalesce("_listed", F.lit(False)).alias(f"_k{s}"))
    pairs = side(1).join(side(2).hint("merge"), recording).where(~F.col("_k2") & (F.col("_k1") | (F.col("_c1") < F.col("_c2"))))
    both = F.zip_with("_x1", "_x2", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    kept = F.filter(both, lambda p, i: F.get("_l1", F.floor(i / width).cast("int")) & F.get("_l2", F.floor(i / width).cast("int")) & _finite(p["a"]) & _finite(p["b"]))
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("a", "b", "aa", "bb", "ab")])

    def add(t: Column, a: Column, b: Column) -> Column:
        return F.struct((t["a"] + a).alias("a"), (t["b"] + b).alias("b"), (t["aa"] + a * a).alias("aa"), (t["bb"] + b * b).alias("bb"), (t["ab"] + a * b).alias("ab"))

    def strength(s: Column, n: Column) -> Column:
        va, vb = s["aa"] - s["a"] * s["a"] / n, s["bb"] - s["b"] * s["b"] / n
        return F.when((va > 0) & (vb > 0), F.abs(s["ab"] - s["a"] * s["b"] / n) / F.sqrt(va * vb))

    def related(p: Column) -> Column:
        # sums of both channels about their first common sample, in one pass over the pair
        sums = let(F.get(p, 0), lambda o: F.aggregate(p, zero, lambda t, y: add(t, y["a"] - o["a"], y["b"] - o["b"])))
        return F.when(F.size(p) >= int(10 * rate), let(sums, lambda s: strength(s, F.size(p))))

    return pairs.where(let(kept, related) >= least).groupBy(recording, F.col("_c2").alias(channel)).agg(F.min("_c1").alias("duplicate_of"))


def liveness(samples: Column, window: int, flat: float = 1e-6, rail: float = 1e3) -> Column:
    """A channel is alive if any window is: it moves and isn't railed (fixed levels; ``channel_liveness`` has the whole rule)."""
    starts = F.sequence(F.lit(0), F.size(samples) - window, F.lit(window))
    part = lambda s: F.slice(samples, s + 1, window)
    return F.exists(starts, lambda s: ((F.array_max(part(s)) - F.array_min(part(s))) > flat) & (F.array_max(F.transform(part(s), lambda x: F.abs(x))) < rail))


def under_curve(points: DataFrame, raters: DataFrame, x: str, y: str) -> DataFrame:
    """Adds under: a rater's y is at or below the curve, linear between its points, at the rater's x. Beyond the ends the
    curve is its end point's; of points with one x the greatest y counts. Null where x, y or the curve is missing.

    Points and raters are put in one order of x. It is dealt over ranges; in each range a rater finds its neighbours by
    a window, and a range's first and last points (a row per range) stand for those that lie in other ranges.
    """
    c = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("_x")).agg(F.max(F.col(y).cast("double")).alias("_y"))
    every = c.select("_x", "_y", F.lit(None).cast(raters.schema.simpleString()).alias("_r")).unionByName(raters.select(F.col(x).cast("double").alias("_x"), F.lit(None).cast("double").alias("_y"), F.struct(*raters.columns).alias("_r")))
    # equal x stay in one range, as ranges are of x; a point comes before the raters at its x
    dealt = stored(every.repartitionByRange("_x").withColumn("_range", F.spark_partition_id()), "ordered")
    point = F.when(F.col("_r").isNull(), F.struct("_x", "_y"))
    ends = dealt.where("_r IS NULL").groupBy("_range").agg(F.min(F.struct("_x", "_y")).alias("_first"), F.max(F.struct("_x", "_y")).alias("_last"))  # a row per range
    ranges = dealt.select("_range").distinct().join(ends.hint("merge"), "_range", "left")
    over = Window.orderBy("_range")
    ranges = ranges.select("_range", F.last("_last", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_first", True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    w = Window.partitionBy("_range").orderBy("_x", F.col("_r").isNotNull())
    near = dealt.withColumns({"_l": F.last(point, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_u": F.first(point, True).over(w.rowsBetween(0, Window.unboundedFollowing))}).where("_r IS NOT NULL")
    near = near.join(F.broadcast(ranges), "_range").withColumns({"_l": F.coalesce("_l", "_before"), "_u": F.coalesce("_u", "_after")})
    exact = F.col("_l._x") == F.col("_x")
    line = F.col("_l._y") + (F.col("_u._y") - F.col("_l._y")) * (F.col("_x") - F.col("_l._x")) / (F.col("_u._x") - F.col("_l._x"))
    value = F.when(F.col("_x").isNull(), F.lit(None).cast("double")).when(exact | F.col("_u").isNull(), F.col("_l._y")).when(F.col("_l").isNull(), F.col("_u._y")).otherwise(line)
    return near.select("_r.*", (F.col(f"_r.{y}") <= value).alias("under"))
