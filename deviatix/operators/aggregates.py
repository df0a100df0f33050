"""Aggregates over segments and channels; columns are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import epoch


def winsorised(df: DataFrame, groups: list[str], value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values held within their group's exact percentiles. The few group rows are joined back by a merge join."""
    edges = df.groupBy(*groups).agg(F.percentile(value, F.lit(low)).alias("_lo"), F.percentile(value, F.lit(high)).alias("_hi"))
    return df.join(edges, groups).withColumn(value, F.least(F.greatest(value, "_lo"), "_hi")).drop("_lo", "_hi")


def prevalence(z: Column, tau: Column | float, weight: Column | None = None) -> Column:
    w = F.lit(1.0) if weight is None else weight
    return F.sum(w * F.when(z > tau, 1.0).otherwise(0.0)) / F.sum(w)


def severity(z: Column, tau: Column | float) -> Column:
    """Median of the values above tau, 0 if there is none."""
    return F.coalesce(F.percentile(F.when(z > tau, z), F.lit(0.5)), F.lit(0.0))


def burden(z: Column, tau: Column | float, weight: Column | None = None) -> Column:
    w = F.lit(1.0) if weight is None else weight
    return F.sum(w * F.greatest(z - tau, F.lit(0.0))) / F.sum(w)


def amounts(x: str) -> list[Column]:
    """Amount of a feature in a recording: 90th percentile, mean, share above 1.5, maximum."""
    c = F.col(x)
    return [F.percentile(x, F.lit(0.9)).alias(f"{x}_p90"), F.avg(x).alias(f"{x}_mean"), F.avg(F.when(c.isNotNull(), F.when(c > 1.5, 1.0).otherwise(0.0))).alias(f"{x}_share"), F.max(x).alias(f"{x}_max")]


def median(x: Column | str) -> Column:
    return F.percentile(x, F.lit(0.5))


def by_region(df: DataFrame, bridge: DataFrame, keys: list[str], values: list[str], channel: str = "channel", region: str = "region") -> DataFrame:
    """Mean of the values over the channels of each region. The bridge is a dimension of a few dozen rows."""
    return df.join(F.broadcast(bridge), channel).groupBy(*keys, region).agg(*[F.avg(v).alias(v) for v in values])


def threshold_grid(df: DataFrame, keys: list[str], z: str, thresholds: list[float]) -> DataFrame:
    """prev and sev for every threshold in one pass: the thresholds are exploded beside each row."""
    out = df.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    c = F.col(z)
    return out.groupBy(*keys, "threshold").agg(F.avg(F.when(c > F.col("threshold"), 1.0).otherwise(0.0)).alias("prev"), severity(c, F.col("threshold")).alias("sev"))


def composition(df: DataFrame, state: str, keys: list[str]) -> DataFrame:
    """Map of state -> share of rows, per key."""
    n = df.groupBy(*keys, state).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(*keys).agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(state, "n")))).alias("counts"))
    return total.select(*keys, F.transform_values("counts", lambda k, v: v / F.col("total")).alias("fractions"))


def leave_one_out(votes: DataFrame, item: str, vote: str) -> DataFrame:
    """Consensus of the other raters of an item: (sum - own) / (n - 1), null for a single rater."""
    from pyspark.sql import Window

    w = Window.partitionBy(item)
    n = F.count(vote).over(w)
    return votes.withColumn("others", F.when(n > 1, (F.sum(vote).over(w) - F.col(vote)) / (n - 1)))


def confusion(truth: Column, call: Column) -> list[Column]:
    return [F.count_if(truth & call).alias("tp"), F.count_if(~truth & call).alias("fp"), F.count_if(truth & ~call).alias("fn"), F.count_if(~truth & ~call).alias("tn")]


def rates(df: DataFrame) -> DataFrame:
    """tpr, fpr, precision from confusion counts."""
    safe = lambda a, b: F.when(b > 0, a / b)
    return df.withColumns({"tpr": safe(F.col("tp"), F.col("tp") + F.col("fn")), "fpr": safe(F.col("fp"), F.col("fp") + F.col("tn")), "precision": safe(F.col("tp"), F.col("tp") + F.col("fp"))})


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts with margins (null labels are margins where the grouping flag is set)."""
    return df.cube(a, b).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("margin"))


def modal_share(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Rows with a value, and the share of them that have the group's most frequent one: counts, then max / sum."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*group).agg(F.sum("_n").alias("n"), (F.max("_n") / F.sum("_n")).alias("share"))


def region_features(df: DataFrame, bridge: DataFrame, keys: list[str], valid: Column, features, powers: list[str], channel: str = "channel", region: str = "region") -> DataFrame:
    """Features of region powers: mean of the linear powers over the valid member channels (nulls and NaN left out),
    then ``features`` of them. The bridge has a few dozen rows."""
    clean = lambda c: F.when(valid & ~F.isnan(c.cast("double")), c)
    rows = df.join(F.broadcast(bridge), channel).groupBy(*keys, region).agg(*[F.avg(clean(F.col(p))).alias(p) for p in powers])
    return rows.select(*keys, region, *[c.alias(k) for k, c in features({p: F.col(p) for p in powers}).items()])


def joined_scans(a: DataFrame, b: DataFrame, keys: list[str], of_a: list[Column], of_b: list[Column]) -> DataFrame:
    """Aggregates of two tables by the same keys, side by side; keys of either."""
    return a.groupBy(*keys).agg(*of_a).join(b.groupBy(*keys).agg(*of_b), keys, "full")


def by_condition(df: DataFrame, keys: list[str], value: str, conditions: dict[str, Column]) -> DataFrame:
    """Median of a value under each condition, and its rows."""
    return df.groupBy(*keys).agg(*[F.percentile(F.when(c, F.col(value)), F.lit(0.5)).alias(f"{k}_median") for k, c in conditions.items()], *[F.count_if(c & F.col(value).isNotNull()).alias(f"{k}_n") for k, c in conditions.items()])


def birth_dates(exams: DataFrame, patient: str, day: str, age: str, days_per_year: float = 365.25) -> DataFrame:
    """patient, birth (seconds since 1970), exams, spread_days: the median of exam day less age, and how far the exams are apart on it.

    Exams without a day, an age or a patient don't count; a patient without any other has no row. A patient's exams are
    few; repeated rows each count.
    """
    born = epoch(F.col(day)) - F.col(age) * (days_per_year * 86400)
    own = exams.select(patient, born.alias("_born")).where(F.col(patient).isNotNull() & F.col("_born").isNotNull() & ~F.isnan("_born"))
    return own.groupBy(patient).agg(median("_born").alias("birth"), F.count(F.lit(1)).alias("exams"), ((F.max("_born") - F.min("_born")) / 86400).alias("spread_days"))


def recovered_ages(exams: DataFrame, patient: str, day: str, age: str, days_per_year: float = 365.25) -> DataFrame:
    """``exams`` with ``recovered_age``: the exam's own age, else the time since its patient's birth date; null without either."""
    births = birth_dates(exams, patient, day, age, days_per_year).select(F.col(patient).alias("_patient"), "birth")
    own = exams.join(births.hint("merge"), F.col(patient) == F.col("_patient"), "left")
    since = (epoch(F.col(day)) - F.col("birth")) / (days_per_year * 86400)
    return own.withColumn("recovered_age", F.coalesce(F.nanvl(F.col(age), F.lit(None).cast("double")), since)).drop("_patient", "birth")
