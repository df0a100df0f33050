"""Runs, ordering, top-k, sampling by hash, splits and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .quantiles import same, sized


def hash_order(*columns: str, seed: str = "0") -> Column:
    """An order that any engine can repeat: md5 text of the seed and the columns."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in columns]).cast("binary"))


def hash_rank(df: DataFrame, keys: list[str], order: Column, unit: str, name: str = "_rank") -> DataFrame:
    """Adds the place (from 1) of each row within its keys, in the order of a hex hash, then of ``unit``. It is the number of rows
    in smaller hash prefixes (4096 counts for each key at most) and the place within the prefix, so no task ranks a whole
    group. Null keys are a group."""
    own = df.withColumn("_h", order).withColumn("_p", F.substring("_h", 1, 3))
    counts = own.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    before = stored(counts.select(*keys, "_p", (F.sum("_n").over(upto) - F.col("_n")).alias("_before")), "prefixes")
    inside = own.withColumn("_place", F.row_number().over(Window.partitionBy(*keys, "_p").orderBy("_h", unit)))
    return same(inside, before, [*keys, "_p"], hint=sized(before)).withColumn(name, F.col("_before") + F.col("_place")).drop("_h", "_p", "_place", "_before")


def islands(df: DataFrame, key: str, order: str, flag: Column, require_contiguous: bool = False) -> DataFrame:
    """key, run, n: the maximal runs of rows with the flag. With ``require_contiguous`` a gap in ``order`` ends a run."""
    w = Window.partitionBy(key).orderBy(order)
    f = df.select(key, F.col(order).alias("_o"), F.coalesce(flag, F.lit(False)).alias("_f"))
    w = Window.partitionBy(key).orderBy("_o")
    starts = F.col("_f") & (~F.coalesce(F.lag("_f").over(w), F.lit(False)) | (F.lit(require_contiguous) & (F.col("_o") != F.coalesce(F.lag("_o").over(w), F.lit(-1)) + 1)))
    runs = f.withColumn("_s", starts.cast("long")).withColumn("run", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.where("_f").groupBy(key, "run").agg(F.count(F.lit(1)).alias("n"))


def persistence(df: DataFrame, key: str, order: str, flag: Column, seconds: float = 15, step: float = 14, require_contiguous: bool = False) -> DataFrame:
    """Longest run and median run in minutes, number of runs; zeros for keys without any."""
    runs = islands(df, key, order, flag, require_contiguous).withColumn("minutes", (F.lit(float(seconds)) + (F.col("n") - 1) * float(step)) / 60)
    got = runs.groupBy(key).agg(F.max("minutes").alias("longest"), F.count(F.lit(1)).alias("episodes"), F.percentile("minutes", F.lit(0.5)).alias("median"))
    return df.select(key).distinct().join(got, key, "left").fillna({"longest": 0.0, "episodes": 0, "median": 0.0})


def run_flags(df: DataFrame, key: str, order: str, state: str, least: int) -> DataFrame:
    """Adds in_run: the row is in a run of at least ``least`` rows of one state without a gap in the order."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.coalesce((F.lag(state).over(w) != F.col(state)) | (F.lag(order).over(w) + 1 != F.col(order)), F.lit(True))
    out = df.withColumn("_new", new.cast("long")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("in_run", F.count(F.lit(1)).over(Window.partitionBy(key, "_run")) >= least).drop("_new", "_run")


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One row per key, the first in a total order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def top_mean(df: DataFrame, keys: list[str], score: str, tie: str, k: int) -> DataFrame:
    """Mean of the k greatest scores of a key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).groupBy(*keys).agg(F.avg(score).alias("top_mean"))


def capped(df: DataFrame, keys: list[str], unit: list[str], cap: int, seed: str = "0") -> DataFrame:
    """At most ``cap`` rows per key, by hash order: an operator that samples by design."""
    w = Window.partitionBy(*keys).orderBy(hash_order(*unit, seed=seed), *unit)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= cap).drop("_rank")


def proportional_sample(df: DataFrame, stratum: str, unit: str, n: int, seed: str = "0") -> DataFrame:
    """About n rows, each stratum with its share (rounded)."""
    total = Window.partitionBy(F.lit(0))
    per = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    quota = per.withColumn("_quota", F.round(F.col("_n") * n / F.sum("_n").over(total))).select(stratum, "_quota")
    quota = stored(quota, "quota")
    return hash_rank(df, [stratum], hash_order(unit, seed=seed), unit).join(quota.hint(sized(quota)), stratum).where(F.col("_rank") <= F.col("_quota")).drop("_rank", "_quota")


def deficit_fill(have: DataFrame, pool: DataFrame, cell: list[str], unit: str, target: int, seed: str = "0") -> DataFrame:
    """Rows of the pool that bring each cell up to the target."""
    got = have.groupBy(*cell).agg(F.count(F.lit(1)).alias("_have"))
    got = stored(got, "have")
    ranked = hash_rank(pool, cell, hash_order(unit, seed=seed), unit).join(got.hint(sized(got)), cell, "left")
    return ranked.where(F.col("_rank") <= target - F.coalesce("_have", F.lit(0))).drop("_rank", "_have")


def interleaved(df: DataFrame, stratum: str, unit: str, seed: str = "0") -> DataFrame:
    """Adds place: the first of each stratum, then the second of each, and so on; (turn, stratum) sort the rows."""
    return hash_rank(df, [stratum], hash_order(unit, seed=seed), unit, "turn").withColumn("turn", F.col("turn").cast("long"))


def patient_split(df: DataFrame, patient: str, stratum: str, recording: str, test_share: float = 0.3, seed: str = "0") -> DataFrame:
    """Adds split, the same for all rows of a patient; stratified on the stratum of the patient's first recording."""
    one = df.groupBy(patient).agg(F.min_by(stratum, recording).alias("_stratum"))
    share = F.percent_rank().over(Window.partitionBy("_stratum").orderBy(hash_order(patient, seed=seed), patient))
    split = one.withColumn("split", F.when(share < test_share, "test").otherwise("train")).select(patient, "split")
    return df.join(split, patient)


def shard(df: DataFrame, unit: str, n: int) -> DataFrame:
    return df.withColumn("shard", F.conv(F.substring(F.md5(F.col(unit).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % n)


def sliding_variance(df: DataFrame, key: str, second: str, n: str, s: str, q: str, seconds: int) -> DataFrame:
    """log variance over the last ``seconds`` rows, from per-second counts, sums and sums of squares."""
    w = Window.partitionBy(key).orderBy(second).rowsBetween(-(seconds - 1), 0)
    m = F.sum(n).over(w)
    var = F.sum(q).over(w) / m - (F.sum(s).over(w) / m) ** 2
    return df.withColumn("log_var", F.log(F.greatest(var, F.lit(0.0)) + 1e-12))


def union_first(parts: list[DataFrame], key: str, tie: str) -> DataFrame:
    """Union of parts of different columns; of rows with one key that of the earliest part stays."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return first_by(out, [key], "_part", tie).drop("_part")


def replacement_fill(kept: DataFrame, dropped: DataFrame, pool: DataFrame, key: str, seed: str = "0") -> DataFrame:
    """``kept`` (origin "kept") and, for each dropped row, one row of the pool (origin "replacement"): keys that are not
    kept already, one row each, in hash order. A count of the dropped rows is all that is read.

    The place in the order is the number of keys in smaller hash prefixes (counted, 4096 of them) and the place within
    the prefix, so no task sees the whole pool."""
    need = dropped.count()
    own = hash_order(key, seed=seed)
    fresh = first_by(pool.join(kept.select(key).hint("merge"), key, "left_anti").withColumn("_h", own), [key], "_h").withColumn("_p", F.substring("_h", 1, 3))
    per = fresh.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # 4096 rows at most
    before = per.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy("_h", key))
    taken = fresh.withColumn("_place", place).join(F.broadcast(before), "_p").where(F.col("_before") + F.col("_place") <= need)
    return kept.withColumn("origin", F.lit("kept")).unionByName(taken.drop("_h", "_p", "_place", "_before").withColumn("origin", F.lit("replacement")), allowMissingColumns=True)


def partitioned(df: DataFrame, resolved: Column, panel: Column) -> DataFrame:
    """Adds part: panel, keeper or drop. Null conditions are false, so the three parts make up the table."""
    return df.withColumn("part", F.when(F.coalesce(panel, F.lit(False)), "panel").when(F.coalesce(resolved, F.lit(False)), "keeper").otherwise("drop"))


def selected(df: DataFrame, key: str, selections: list[DataFrame]) -> DataFrame:
    """The rows whose key any selection has."""
    ids = selections[0].select(key)
    for s in selections[1:]:
        ids = ids.unionByName(s.select(key))
    return df.join(ids.distinct().hint("merge"), key, "left_semi")


def best_segment(df: DataFrame, key: str, start: str, stage: str, preferred: str, amount: str, within: float = 3600.0) -> DataFrame:
    """The segment of the greatest amount in the first hour, in the preferred stage if it occurs there, else in any."""
    fit = df.where((F.col(start) < within) & F.col(amount).isNotNull())
    return first_by(fit, [key], (F.col(stage) == F.col(preferred)).desc_nulls_last(), F.desc(amount), start)


def halves(df: DataFrame, unit: str, seed: str = "0") -> DataFrame:
    """Adds half: reference or held_out, the same for all rows of a unit, by the parity of its hash's first digits."""
    return df.withColumn("half", F.when(F.conv(F.substring(hash_order(unit, seed=seed), 1, 8), 16, 10).cast("long") % 2 == 0, "reference").otherwise("held_out"))


def balanced_selection(df: DataFrame, positive: Column, priority: Column, unit: str, each: int, priority_cap: int, seed: str = "0") -> DataFrame:
    """Priority rows first, up to their cap, then ``each`` rows of either class: in hash order. Adds picked_as. The caps
    are the feature: this samples by design."""
    kind = F.when(F.coalesce(priority, F.lit(False)), "priority").when(F.coalesce(positive, F.lit(False)), "positive").otherwise("negative")
    ranked = capped(df.withColumn("picked_as", kind), ["picked_as"], [unit], max(each, priority_cap), seed)
    place = F.row_number().over(Window.partitionBy("picked_as").orderBy(hash_order(unit, seed=seed), unit))
    return ranked.withColumn("_place", place).where(F.col("_place") <= F.when(F.col("picked_as") == "priority", priority_cap).otherwise(each)).drop("_place")


def exemplars(df: DataFrame, band: str, prefer: list[str], tie: str) -> DataFrame:
    """One row per band: the first by the preferences (higher first) in turn."""
    return first_by(df, [band], *[F.desc_nulls_last(c) for c in prefer], tie)


def peaks(df: DataFrame, keys: list[str], name: str, z: str, tau: float = 1.0) -> DataFrame:
    """Per segment: the channel or region of the greatest deviation (of equal ones the last by name), and max, median, min and extent over them."""
    c = F.col(z)
    top = F.max_by(name, F.struct(c, F.col(name))).alias("argmax")
    return df.where(c.isNotNull()).groupBy(*keys).agg(top, F.max(c).alias("top"), F.percentile(z, F.lit(0.5)).alias("mid"), F.min(c).alias("low"), F.avg((c > tau).cast("double")).alias("extent"))
