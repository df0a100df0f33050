"""Table contracts and data-quality checks: each is one aggregate pass that gives rows of violations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, required: list[str], allowed: dict[str, list], key: list[str]) -> DataFrame:
    """check, rows: missing columns, nulls, values beyond the vocabulary, repeated keys. Only checks that fail."""
    missing = [c for c in required if c not in df.columns]
    present = [c for c in required if c in df.columns]
    tests = {f"null:{c}": F.col(c).isNull() for c in present} | {f"value:{c}": ~F.col(c).isin(v) for c, v in allowed.items() if c in df.columns}
    counts = df.agg(*[F.count_if(t).alias(k) for k, t in tests.items()])
    out = counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(f"`{k}`").alias("rows")) for k in tests])).alias("c")).select("c.*")
    repeated = df.groupBy(*key).count().where("count > 1").agg(F.lit("repeated_key").alias("check"), F.count(F.lit(1)).alias("rows"))
    out = out.unionByName(repeated)
    if missing:
        out = out.unionByName(df.sparkSession.createDataFrame([(f"missing:{c}", 1) for c in missing], "check string, rows long"))
    return out.where("rows > 0")


def crowded(df: DataFrame, group: list[str], value: str, most: int) -> DataFrame:
    """group, n: groups with more than ``most`` distinct values. Values are made distinct first, so a hot group is counted from
    partial sums."""
    return df.where(F.col(value).isNotNull()).select(*group, value).distinct().groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)


def summary_differences(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """column, statistic, a, b, relative: number of values, mean, SD, minimum, maximum and exact median of two copies, and their
    difference by the size of a's (the difference itself where that is 0; null where a side has no values)."""
    from functools import reduce

    from .quantiles import percentiles

    def side(df: DataFrame, c: str, name: str) -> DataFrame:
        v = F.col(c).cast("double")
        one = df.agg(F.count(v).cast("double").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
        rows = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("statistic"), F.col(k).alias(name)) for k in one.columns])).alias("s")).select("s.*")
        middle = percentiles(df, [], c, {"m": 0.5}).agg(F.max("m").alias(name)).select(F.lit("median").alias("statistic"), name)
        return rows.unionByName(middle).withColumn("column", F.lit(c))

    both = lambda name, df: reduce(DataFrame.unionByName, [side(df, c, name) for c in columns])
    out = both("a", a).join(both("b", b).hint("merge"), ["column", "statistic"])
    gap = F.abs(F.col("b") - F.col("a"))
    return out.select("column", "statistic", "a", "b", F.when(F.col("a") == 0, gap).otherwise(gap / F.nullif(F.abs("a"), F.lit(0.0))).alias("relative"))


def contiguous(df: DataFrame, key: str, index: str) -> DataFrame:
    """Keys whose index has gaps or repeats."""
    g = df.groupBy(key).agg((F.max(index) - F.min(index) + 1).alias("span"), F.count(F.lit(1)).alias("n"), F.count_distinct(index).alias("d"))
    return g.where("span <> n OR d <> n")


def differences(a: DataFrame, b: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """column, only_a, only_b, max_abs, mse of two copies of a table."""
    x = a.select(*key, *[F.col(c).alias(f"_a_{c}") for c in columns], F.lit(1).alias("_in_a"))
    y = b.select(*key, *[F.col(c).alias(f"_b_{c}") for c in columns], F.lit(1).alias("_in_b"))
    j = x.join(y, key, "full")
    d = lambda c: F.col(f"_a_{c}") - F.col(f"_b_{c}")
    parts = [F.struct(F.lit(c).alias("column"), F.count_if(F.col("_in_b").isNull()).alias("only_a"), F.count_if(F.col("_in_a").isNull()).alias("only_b"), F.max(F.abs(d(c))).cast("double").alias("max_abs"), F.avg(d(c) * d(c)).cast("double").alias("mse")) for c in columns]
    return j.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("c")).select("c.*")


def guards(df: DataFrame, tests: dict[str, tuple[Column, Callable[[Column], Column]]]) -> DataFrame:
    """name, value, ok: aggregates of one pass over the table, and whether each holds what it must (false if null)."""
    values = df.agg(*[value.cast("double").alias(k) for k, (value, _) in tests.items()])
    parts = [F.struct(F.lit(k).alias("name"), F.col(k).alias("value"), F.coalesce(holds(F.col(k)), F.lit(False)).alias("ok")) for k, (_, holds) in tests.items()]
    return values.select(F.explode(F.array(*parts)).alias("c")).select("c.*")


def probability_guards(df: DataFrame, classes: list[str], heads: list[str], zero_cap: float = 0.02) -> DataFrame:
    """Class probabilities that sum to 1 in each row (to float32's rounding) and on average, no class that is zero
    throughout, few exact zeros in each independent head, and heads that exceed 1 together, as independent ones do."""
    total = sum((F.col(c) for c in classes[1:]), F.col(classes[0]))
    tests = {"worst_sum": (F.max(F.abs(total - 1)), lambda v: v < 3e-3), "mean_sum": (F.avg(total), lambda v: F.abs(v - 1) < 1e-4)}
    tests |= {f"top_{c}": (F.max(F.abs(F.col(c))), lambda v: v > 0) for c in classes}
    tests |= {f"zeros_{h}": (F.avg((F.col(h) == 0).cast("double")), lambda v: v < zero_cap) for h in heads}
    tests["heads_above_1"] = (F.count_if(sum((F.col(h) for h in heads[1:]), F.col(heads[0])) > 1), lambda v: v > 0)
    return guards(df, tests)


def paired_guards(a: DataFrame, b: DataFrame, key: list[str], time: str, most: float = 1e-3) -> DataFrame:
    """Two tables that must pair one to one with equal times: rows without a partner, and pairs whose times differ."""
    j = a.select(*key, F.col(time).alias("_a")).join(b.select(*key, F.col(time).alias("_b")), key, "full")
    return guards(j, {"unpaired": (F.count_if(F.col("_a").isNull() | F.col("_b").isNull()), lambda v: v == 0), "times_differ": (F.count_if(F.abs(F.col("_a") - F.col("_b")) > most), lambda v: v == 0)})


def launch_guards(new: DataFrame, origin: str, required: list[str], path: str, least: int) -> DataFrame:
    """What must hold before a table is frozen: as many rows as before, replacements with all required fields, and a
    resolved path in every row."""
    tests = {"held": (F.count(F.lit(1)), lambda v: v >= least)}
    tests |= {f"null_{c}": (F.count_if((F.col(origin) == "replacement") & F.col(c).isNull()), lambda v: v == 0) for c in required}
    tests["unresolved"] = (F.count_if(F.col(path).isNull()), lambda v: v == 0)
    return guards(new, tests)


def age_guards(df: DataFrame, age: str, exact: Column, top: float = 90.0) -> DataFrame:
    """Ages are fractions (infants' too), neither negative nor beyond the top code, and mostly exact."""
    a = F.col(age)
    whole = (a % 1 != 0).cast("double")
    return guards(df, {
        "fractional": (F.avg(whole), lambda v: v > 0.8), "negative": (F.count_if(a < 0), lambda v: v == 0), "above_top": (F.count_if(a > top), lambda v: v == 0),
        "fractional_infants": (F.avg(F.when(a < 2, whole)), lambda v: v > 0.9), "exact": (F.avg(exact.cast("double")), lambda v: v > 0.95),
    })


def contradictions(df: DataFrame, flags: list[str]) -> DataFrame:
    """a, b, rows: how often each two flags, which exclude each other, are set together."""
    pairs = [(a, b) for i, a in enumerate(flags) for b in flags[i + 1 :]]
    counts = df.agg(*[F.count_if(F.col(a) & F.col(b)).alias(f"{a}|{b}") for a, b in pairs])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("rows")) for a, b in pairs])).alias("c")).select("c.*")
