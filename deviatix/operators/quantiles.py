"""Exact order statistics of large groups: a search over mergeable histograms, then the one value that holds each rank.

Rows are counted by value first. A round sums the weights of a group's values in ``BRANCHES`` ranges (partial sums before
the shuffle, as many numbers as ranges), finds the range that holds each rank, and the next round splits only those.
When no range has over ``FEW`` counted rows left, the last round sums value by value. No task holds a group.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Ranges that a round splits each range into.
BRANCHES = 512
#: Counted rows of a range that are summed value by value.
FEW = 4096
#: Rounds split a range by turns evenly and by the logarithm of the distance from its low end, down to this share of it.
FINEST = 1e-12
#: Ranges still searched (a number of groups, series and ranks) up to which they are broadcast.
BROADCAST_ROWS = 50_000
#: Distinct values of a group up to which one task may hold them (some 10 MB): its percentiles then need no search.
HELD = 100_000
#: Doubles have so many bits that more rounds mean a fault.
MOST_ROUNDS = 300


@dataclass(frozen=True)
class Series:
    """Weights of a group's rows under a label: those of the rows that ``where`` takes. Both are SQL expressions."""

    label: float
    where: str
    weight: str


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hint: str = "merge") -> DataFrame:
    """A join by ``keys`` to which nulls are equal; the keys stay once."""
    renamed = right.select(*[F.col(k).alias(f"_same_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_same_{k}"))
    return left.join(renamed.hint(hint), on, how).drop(*[f"_same_{k}" for k in keys])


def sized(small: DataFrame) -> str:
    """The join hint of a written table: broadcast while its rows are few."""
    return "broadcast" if small.count() <= BROADCAST_ROWS else "merge"


def summed(rows: DataFrame, keys: list[str], value: str, series: list[Series]) -> DataFrame:
    """keys, rows, g, w, least, most: of each group its number of rows, and each series' weight and end values. One
    aggregate with columns for each series, so that no row is repeated for them."""
    kept = [f"`{c}`" for c in dict.fromkeys([*keys, value])]
    weighed = rows.selectExpr(*kept, *[f"CASE WHEN {s.where} THEN {s.weight} END AS _k{i}" for i, s in enumerate(series)])
    ends = [e for i in range(len(series)) for e in (f"sum(_k{i})", f"min(CASE WHEN _k{i} IS NOT NULL THEN `{value}` END)", f"max(CASE WHEN _k{i} IS NOT NULL THEN `{value}` END)")]
    wide = weighed.groupBy(*keys).agg(F.expr("count(1) AS rows"), F.expr(f"array({', '.join(ends)}) AS _all"))
    labels = ", ".join(f"CAST({s.label!r} AS DOUBLE)" for s in series)
    each = f"inline(transform(array({labels}), (g, i) -> struct(g AS g, CAST(_all[3 * i] AS DOUBLE) AS w, _all[3 * i + 1] AS least, _all[3 * i + 2] AS most)))"
    return wide.selectExpr(*[f"`{k}`" for k in keys], "rows", each).where("w > 0")


def _branch(value: Column, least: Column, most: Column, turn: int) -> Column:
    share = (value - least) / (most - least)
    if turn % 2:
        share = F.log(1 + share / FINEST) / F.log(F.lit(1 + 1 / FINEST))
    return F.least(F.floor(share * BRANCHES), F.lit(BRANCHES - 1)).cast("long")


def first_reaching(counts: DataFrame, cell: list[str], value: str, series: list[Series], ranks_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The first value of a group up to which a series' weights sum to a rank (the last if none does).

    ``ranks_of`` gets the series' totals (cell, g, w) and gives the ranks asked for: cell, g, name, need and columns to
    keep. Adds v, w (its weight), below (the weight of smaller values), and the values of the series on either side with
    their weights: previous, w_previous, next, w_next (null beyond the ends). ``counts`` has a row per distinct value and
    whatever else the weights are of; the values are doubles without NaN or infinities.
    """
    key, state = [*cell, "g", "name"], ["need", "below", "w", "least", "most", "rows", "previous", "next", "_at"]
    ends = stored(counts.groupBy(*cell).agg(F.min(value).alias("_least"), F.max(value).alias("_most")), "ends")
    rows = same(counts, ends, cell, hint=sized(ends))
    single = F.col("_least") == F.col("_most")
    rows = rows.withColumn("_at", F.lit(0).cast("long")).withColumn("_to", F.when(single, 0).otherwise(_branch(F.col(value), F.col("_least"), F.col("_most"), 0)).cast("double")).drop("_least", "_most")
    parts = stored(summed(rows, [*cell, "_at", "_to"], value, series).withColumnRenamed("w", "_w"), "parts")
    asked = stored(ranks_of(parts.groupBy(*cell, "g").agg(F.sum("_w").alias("w"))), "ranks")
    nothing = F.lit(None).cast("double")
    left = asked.select(*key, "need", F.lit(0.0).alias("below"), nothing.alias("previous"), nothing.alias("next"), F.lit(0).cast("long").alias("_at"))
    done = []
    for turn in range(1, MOST_ROUNDS):
        found = same(left.select(*key, "_at", "need", "below", "previous", "next"), parts, [*cell, "_at", "g"])
        order = Window.partitionBy(*key).orderBy("_to")  # BRANCHES rows at most, or FEW in the last round
        upto = F.sum("_w").over(order.rowsBetween(Window.unboundedPreceding, 0))
        found = found.withColumns({"_upto": upto, "_last": F.lead("_to").over(order).isNull(), "previous": F.coalesce(F.lag("most").over(order), "previous"), "next": F.coalesce(F.lead("least").over(order), "next")})
        found = found.withColumn("_hit", (F.col("below") + F.col("_upto") >= F.col("need")) | F.col("_last"))
        first = F.min(F.when(F.col("_hit"), F.struct("_to", "_w", "_upto", "rows", "least", "most", "previous", "next"))).alias("_f")
        found = found.groupBy(*key).agg(F.first("need").alias("need"), F.first("below").alias("_b"), F.first("_at").alias("_p"), first)
        found = found.select(*key, "need", (F.col("_b") + F.col("_f._upto") - F.col("_f._w")).alias("below"), F.col("_f._w").alias("w"), *[F.col(f"_f.{c}").alias(c) for c in ("least", "most", "rows", "previous", "next")], F.xxhash64("_p", "_f._to").alias("_at"))
        open_ = stored(found.select(*key, *state), "ranks")
        done.append(open_.where("least = most"))
        left = open_.where("least < most")
        n, most = left.agg(F.count(F.lit(1)), F.max("rows")).first()
        if not n:
            break
        # ranges that two ranks share are one; a series' own ends may be narrower than the range's
        ranges = left.groupBy(*cell, "_at").agg(F.min("least").alias("_least"), F.max("most").alias("_most"))
        rows = same(rows.withColumn("_at", F.xxhash64("_at", "_to")), ranges, [*cell, "_at"], hint="broadcast" if n <= BROADCAST_ROWS else "merge")
        rows = rows.where((F.col(value) >= F.col("_least")) & (F.col(value) <= F.col("_most")))
        to = F.col(value) if most <= FEW else _branch(F.col(value), F.col("_least"), F.col("_most"), turn).cast("double")
        rows = stored(rows.withColumn("_to", to).drop("_least", "_most"), "ranges")
        parts = summed(rows, [*cell, "_at", "_to"], value, series).withColumnRenamed("w", "_w")
    else:
        raise ArithmeticError("the search for a rank does not end")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = stored(out.select(*key, F.col("least").alias("v"), "w", "below", "previous", "next"), "found")
    # the weights of the neighbours
    sides = stored(out.select(*cell, F.explode(F.array("previous", "next")).alias("_v")).where("_v IS NOT NULL").distinct(), "sides")
    near = same(counts.withColumnRenamed(value, "_v"), sides, [*cell, "_v"], hint=sized(sides))
    weights = stored(summed(near, [*cell, "_v"], "_v", series).select(*cell, "g", "_v", F.col("w").alias("_w")), "weights")
    for side in ("previous", "next"):
        out = same(out, weights.withColumnRenamed("_v", side).withColumnRenamed("_w", f"w_{side}"), [*cell, "g", side], "left")
    return same(asked.drop("w"), out, key)


def percentiles(df: DataFrame, cell: list[str], value: str, shares: dict[str, float], held: int = HELD) -> DataFrame:
    """cell, n and a column for each share: exact percentiles, linear between the two values beside a rank, as
    ``F.percentile`` gives them, for groups of any size. Nulls and NaN are left out; a group without values has no row.
    Where no group has over ``held`` distinct values, an aggregate takes them from the counts; else they are searched for."""
    v = F.col(value).cast("double")
    rows = df.select(*cell, v.alias("_value")).where(F.col("_value").isNotNull() & ~F.isnan("_value"))
    counts = stored(rows.groupBy(*cell, "_value").agg(F.count(F.lit(1)).alias("_n")), "counts")
    most = counts.groupBy(*cell).count().agg(F.max("count")).first()[0]
    if (most or 0) <= held:
        return counts.groupBy(*cell).agg(F.sum("_n").alias("n"), *[F.percentile("_value", F.lit(float(q)), F.col("_n")).alias(k) for k, q in shares.items()]).where("n > 0")
    place = lambda q: (F.col("w") - 1) * F.lit(float(q))
    each = F.array(*[F.struct(F.lit(k).alias("name"), place(q).alias("_place")) for k, q in shares.items()])
    ranks = lambda totals: totals.select(*cell, "g", F.col("w").alias("_total"), F.inline(each)).withColumn("need", F.floor("_place") + 1.0)
    found = first_reaching(counts, cell, "_value", [Series(0.0, "true", "CAST(_n AS DOUBLE)")], ranks)
    above = F.when((F.ceil("_place") + 1 <= F.col("below") + F.col("w")) | F.col("next").isNull(), F.col("v")).otherwise(F.col("next"))
    at = F.col("v") + (above - F.col("v")) * (F.col("_place") - F.floor("_place"))
    return found.withColumn("_x", at).groupBy(*cell).agg(F.first("_total").cast("long").alias("n"), *[F.max(F.when(F.col("name") == k, F.col("_x"))).alias(k) for k in shares])
