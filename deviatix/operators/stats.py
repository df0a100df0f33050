"""Evaluation: ranks, AUROC, agreement, tests, bootstrap by hashed weights. Groupings and windows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import let
from ..sources.shared import stored
from .quantiles import same
from .ranks import running


def midranks(df: DataFrame, value: str, by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """Value table (by, value, n, rank): rows are counted by value first, so the ordering is over distinct values."""
    by = by or []
    n = F.sum(weight if weight is not None else F.lit(1.0))
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(n.alias("n"))
    return running(counts, by, value, "n", "_upto").withColumn("rank", F.col("_upto") - F.col("n") / 2 + 0.5).drop("_upto")


def auroc(df: DataFrame, truth: str, score: str, by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """by, positives, negatives, auroc: share of pairs in order, ties half, from counts by distinct score."""
    by = by or []
    wt = weight if weight is not None else F.lit(1.0)
    t = F.col(truth).cast("int")
    c = df.where(F.col(score).isNotNull() & F.col(truth).isNotNull()).groupBy(*by, score).agg(F.sum(wt * t).alias("_p"), F.sum(wt * (1 - t)).alias("_q"))
    c = running(c, by, score, "_q", "_upto").withColumn("_below", F.col("_upto") - F.col("_q"))
    area = F.sum(F.col("_p") * (F.col("_below") + F.col("_q") / 2))
    g = c.groupBy(*by).agg(F.sum("_p").alias("positives"), F.sum("_q").alias("negatives"), area.alias("area"))
    return g.select(*by, "positives", "negatives", F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.col("area") / (F.col("positives") * F.col("negatives"))).alias("auroc"))


def operating_points(df: DataFrame, truth: str, score: str) -> DataFrame:
    """score, tpr, fpr, precision at each distinct score taken as the threshold."""
    t = F.col(truth).cast("int")
    c = df.groupBy(score).agg(F.sum(t).alias("p"), F.sum(1 - t).alias("q"))
    c = running(c, [], score, "p", "_tp", descending=True)
    c = running(c, [], score, "q", "_fp", descending=True)
    every = c.agg(F.sum("p").alias("_np"), F.sum("q").alias("_nq"), F.lit(0).alias("_k"))  # one row
    c = c.withColumn("_k", F.lit(0)).join(F.broadcast(every), "_k")
    return c.select(score, "p", (F.col("_tp") / F.col("_np")).alias("tpr"), (F.col("_fp") / F.col("_nq")).alias("fpr"), (F.col("_tp") / (F.col("_tp") + F.col("_fp"))).alias("precision"))


def average_precision(points: DataFrame) -> DataFrame:
    return points.agg((F.sum(F.col("p") * F.col("precision")) / F.sum("p")).alias("average_precision"))


def _uniform(replicate: Column, unit: Column, seed: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), replicate.cast("string"), unit.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def poisson_weight(replicate: Column, unit: Column, seed: str = "0") -> Column:
    """A Poisson(1) draw that any engine can repeat: from the first 32 bits of an md5."""
    return _poisson(_uniform(replicate, unit, seed))


def _poisson(u: Column) -> Column:
    # cumulative Poisson(1): fixed values
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]
    return sum((F.when(u >= s, 1).otherwise(0) for s in steps), F.lit(0))


def bootstrap_auroc(df: DataFrame, truth: str, score: str, unit: str, replicates: int) -> DataFrame:
    """AUROC of each replicate; a unit (recording or patient) has one weight in a replicate, so clusters stay whole. Rows
    are counted by unit, score and truth first; the weights apply to the counts."""
    counts = df.where(F.col(score).isNotNull() & F.col(truth).isNotNull()).groupBy(unit, score, truth).agg(F.count(F.lit(1)).alias("_n"))
    drawn = counts.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = drawn.withColumn("_w", poisson_weight(F.col("replicate"), F.col(unit)).cast("double") * F.col("_n")).where("_w > 0")
    return auroc(drawn, truth, score, ["replicate"], F.col("_w"))


def _beside(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two frames of one row each as one row."""
    return a.withColumn("_k", F.lit(0)).join(F.broadcast(b.withColumn("_k", F.lit(0))), "_k").drop("_k")


#: Rows, of both classes, from which an AUROC gets an interval, and the gain from which another score is adopted. Fixed values.
LEAST_ROWS, LEAST_GAIN = 20, 0.02


def auroc_interval(df: DataFrame, truth: str, score: str, unit: str, replicates: int = 300, level: float = 0.95) -> DataFrame:
    """n, auroc, low, high: the AUROC turned to 0.5 or more, with the middle ``level`` of its replicates, whose units (patients)
    are drawn whole. One row; nulls but for n below 20 rows or with one class."""
    own = auroc(df, truth, score).select((F.col("positives") + F.col("negatives")).cast("long").alias("n"), F.col("auroc").alias("_a"))
    turned = F.col("_a") < 0.5
    ends = interval(bootstrap_auroc(df, truth, score, unit, replicates), "auroc", level)
    ok = (F.col("n") >= LEAST_ROWS) & F.col("_a").isNotNull()
    one = _beside(own, ends)
    side = lambda a, b: F.when(ok, F.when(turned, 1 - F.col(b)).otherwise(F.col(a)))
    return one.select("n", F.when(ok, F.greatest("_a", 1 - F.col("_a"))).alias("auroc"), side("low", "high").alias("low"), side("high", "low").alias("high"))


def adoption(df: DataFrame, truth: str, ours: str, other: str, unit: str, replicates: int = 300, level: float = 0.95) -> DataFrame:
    """difference (AUROC of the other score less ours), low, high, adopted: the other one is adopted if it gains over 0.02 and
    the interval of the paired difference lies above 0. Both scores share each replicate's weights. Rows that lack a score or
    the truth drop out of both. One row."""
    own = df.where(F.col(truth).isNotNull() & F.col(ours).isNotNull() & F.col(other).isNotNull())
    a, b = (auroc(own, truth, c).select(F.col("auroc").alias(k)) for c, k in ((ours, "_a"), (other, "_b")))
    x, y = (bootstrap_auroc(own, truth, c, unit, replicates).select("replicate", F.col("auroc").alias(k)) for c, k in ((ours, "_x"), (other, "_y")))
    ends = interval(x.join(y.hint("merge"), "replicate").select((F.col("_y") - F.col("_x")).alias("d")), "d", level)
    gain = F.col("_b") - F.col("_a")
    one = _beside(_beside(a, b), ends)
    return one.select(gain.alias("difference"), "low", "high", F.coalesce((gain > LEAST_GAIN) & (F.col("low") > 0), F.lit(False)).alias("adopted"))


def median_agreement(votes: DataFrame, item: str, rater: str, vote: str, min_votes: int = 200, min_items: int = 100) -> DataFrame:
    """pairs, kappa, ac1: medians over the pairs of raters with enough common items, of raters with enough votes. One row."""
    busy = votes.where(F.col(vote).isNotNull()).groupBy(rater).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_votes).select(rater)
    pairs = rater_pairs(votes.where(F.col(vote).isNotNull()).join(busy.hint("merge"), rater, "left_semi"), item, rater, vote, min_items)
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.percentile("kappa", F.lit(0.5)).alias("kappa"), F.percentile("ac1", F.lit(0.5)).alias("ac1"))


def within_rater(votes: DataFrame, item: str, rater: str, vote: str, occasion: str, min_items: int = 1) -> DataFrame:
    """rater, n, accuracy, kappa, ac1 of a rater's first and second reading of the same items (the two least occasions)."""
    from pyspark.sql import Window as W

    w = W.partitionBy(item, rater).orderBy(occasion)
    read = votes.where(F.col(vote).isNotNull()).withColumn("_k", F.row_number().over(w)).where("_k <= 2")
    both = read.groupBy(item, rater).agg(F.max(F.when(F.col("_k") == 1, F.col(vote))).alias("_first"), F.max(F.when(F.col("_k") == 2, F.col(vote))).alias("_second"))
    return agreement(both, "_first", "_second", [rater]).where(F.col("n") >= min_items)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    ok = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    ra = midranks(ok, a).select(a, F.col("rank").alias("ra"))
    rb = midranks(ok, b).select(b, F.col("rank").alias("rb"))
    return ok.join(ra.hint("merge"), a).join(rb.hint("merge"), b).agg(F.corr("ra", "rb").alias("rho"), F.count(F.lit(1)).alias("n"))


def mann_whitney(df: DataFrame, group: str, value: str, by: list[str] | None = None) -> DataFrame:
    """u (of group 1), z with tie and continuity correction, rank_biserial; p = erfc(|z| / sqrt 2) by ``two_sided``."""
    by = by or []
    g = F.col(group).cast("int")
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(g).cast("double").alias("p"), F.count(F.lit(1)).cast("double").alias("n"))
    c = running(c, by, value, "n", "_upto").withColumn("rank", F.col("_upto") - F.col("n") / 2 + 0.5)
    s = c.groupBy(*by).agg(F.sum("p").alias("n1"), F.sum("n").alias("n"), F.sum(F.col("p") * F.col("rank")).alias("r"), F.sum(F.col("n") ** 3 - F.col("n")).alias("ties"))
    n1, n, n2 = F.col("n1"), F.col("n"), F.col("n") - F.col("n1")
    u = F.col("r") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    dev = u - n1 * n2 / 2
    z = F.signum(dev) * F.greatest(F.abs(dev) - 0.5, F.lit(0.0)) / sd
    return s.select(*by, n1.alias("n1"), n2.alias("n2"), u.alias("u"), z.alias("z"), (2 * u / (n1 * n2) - 1).alias("rank_biserial"))


def two_sided(z: Column) -> Column:
    from ..functions.special import norm_cdf

    return 2 * norm_cdf(-F.abs(z))


def signed_rank(df: DataFrame, difference: str) -> DataFrame:
    """Wilcoxon: w_plus, n without zeros, share positive."""
    d = df.where(F.col(difference).isNotNull() & (F.col(difference) != 0)).select(F.abs(difference).alias("m"), (F.col(difference) > 0).cast("int").alias("pos"))
    c = d.groupBy("m").agg(F.sum("pos").alias("p"), F.count(F.lit(1)).alias("n"))
    c = running(c, [], "m", "n", "_upto").withColumn("rank", F.col("_upto") - F.col("n") / 2 + 0.5)
    return c.agg(F.sum(F.col("p") * F.col("rank")).alias("w_plus"), F.sum("n").alias("n"), (F.sum("p") / F.sum("n")).alias("share_positive"))


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """h with tie correction, and its degrees of freedom."""
    c = midranks(df, value)
    ties = c.agg(F.sum(F.col("n") ** 3 - F.col("n")).alias("ties"), F.sum("n").alias("n"))
    g = df.where(F.col(value).isNotNull()).join(c.select(value, "rank").hint("merge"), value).groupBy(group).agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("m"))
    s = g.agg(F.sum(F.col("r") * F.col("r") / F.col("m")).alias("s"), (F.count(F.lit(1)) - 1).alias("df"))
    one = s.withColumn("k", F.lit(0)).join(F.broadcast(ties.withColumn("k", F.lit(0))), "k")  # one row each
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("ties") / (n**3 - n))
    return one.select(h.alias("h"), "df")


def cohen_d(df: DataFrame, group: str, value: str) -> DataFrame:
    g = F.col(group).cast("boolean")
    pick = lambda f, c: f(F.when(c, F.col(value)))
    s = df.agg(pick(F.avg, g).alias("m1"), pick(F.avg, ~g).alias("m0"), pick(F.var_samp, g).alias("v1"), pick(F.var_samp, ~g).alias("v0"), pick(F.count, g).alias("n1"), pick(F.count, ~g).alias("n0"))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
    return s.select(((F.col("m1") - F.col("m0")) / pooled).alias("d"))


def fleiss(votes: DataFrame, item: str, vote: str) -> DataFrame:
    """Kappa of yes/no votes over items with more than one."""
    i = votes.groupBy(item).agg(F.count(vote).cast("double").alias("n"), F.sum(vote).cast("double").alias("y")).where("n > 1")
    y, n = F.col("y"), F.col("n")
    agree = F.avg((y * (y - 1) + (n - y) * (n - y - 1)) / (n * (n - 1)))
    p = F.sum("y") / F.sum("n")
    s = i.agg(agree.alias("po"), p.alias("p"), F.count(F.lit(1)).alias("items"))
    pe = F.col("p") * F.col("p") + (1 - F.col("p")) * (1 - F.col("p"))
    return s.select("items", ((F.col("po") - pe) / (1 - pe)).alias("kappa"))


def agreement(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Cohen's kappa, accuracy and Gwet's AC1 of two class columns."""
    by = by or []
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    sides = cells.select(*by, F.col("_a").alias("_c"), F.col("n").alias("_x"), F.lit(0.0).alias("_y")).unionByName(cells.select(*by, F.col("_b").alias("_c"), F.lit(0.0).alias("_x"), F.col("n").alias("_y")))
    m = sides.groupBy(*by, "_c").agg(F.sum("_x").alias("_x"), F.sum("_y").alias("_y"))
    key = by or [F.lit(0).alias("k")]
    total = cells.groupBy(*key).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("n")).otherwise(0.0)).alias("same"))
    mm = m.groupBy(*key).agg(F.sum(F.col("_x") * F.col("_y")).alias("xy"), F.count(F.lit(1)).alias("q"), F.sum(((F.col("_x") + F.col("_y")) / 2)).alias("s1"), F.sum(((F.col("_x") + F.col("_y")) / 2) ** 2).alias("s2"))
    j = total.join(mm.hint("merge"), by or ["k"])
    t = F.col("total")
    po, pe, ge = F.col("same") / t, F.col("xy") / (t * t), (F.col("s1") / t - F.col("s2") / (t * t)) / (F.col("q") - 1)
    return j.select(*by, t.cast("long").alias("n"), po.alias("accuracy"), ((po - pe) / (1 - pe)).alias("kappa"), ((po - ge) / (1 - ge)).alias("ac1"))


def rater_pairs(votes: DataFrame, item: str, rater: str, vote: str, min_items: int = 5) -> DataFrame:
    """Kappa of each pair of raters on their common items, from a join on the item (raters of an item are few)."""
    other = votes.select(item, F.col(rater).alias("rater_b"), F.col(vote).alias("vote_b"))
    pairs = votes.select(item, F.col(rater).alias("rater_a"), F.col(vote).alias("vote_a")).join(other.hint("merge"), item).where("rater_a < rater_b")
    return agreement(pairs, "vote_a", "vote_b", ["rater_a", "rater_b"]).where(F.col("n") >= min_items)


def two_threshold(df: DataFrame, recording: str, truth: str, z: str, xs: list[float], ys: list[float]) -> DataFrame:
    """Kappa of the rule "share of segments above X is over Y" for every X and Y."""
    shares = df.withColumn("x", F.explode(F.array(*[F.lit(float(v)) for v in xs]))).groupBy(recording, truth, "x").agg(F.avg((F.col(z) > F.col("x")).cast("double")).alias("share"))
    called = shares.withColumn("y", F.explode(F.array(*[F.lit(float(v)) for v in ys]))).withColumn("call", (F.col("share") > F.col("y")).cast("int")).withColumn("truth", F.col(truth).cast("int"))
    return agreement(called, "truth", "call", ["x", "y"]).select("x", "y", "kappa", "accuracy")


def matched_thresholds(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """Cut points of ``value`` that reproduce given shares of labels from below (least value whose rank reaches each)."""
    c = midranks(df, value)
    total = c.agg(F.sum("n").alias("_total"), F.lit(0).alias("_k"))  # one row
    c = c.withColumn("_k", F.lit(0)).join(F.broadcast(total), "_k").withColumn("share", (F.col("rank") + F.col("n") / 2 - 0.5) / F.col("_total"))
    return c.agg(*[F.min(F.when(F.col("share") >= s, F.col(value))).alias(k) for k, s in shares.items()])


def fdr(df: DataFrame, family: str, p: str, tie: str) -> DataFrame:
    """Adds q: Benjamini-Hochberg within a family."""
    w = Window.partitionBy(family)
    rank = F.row_number().over(w.orderBy(p, tie))
    raw = df.withColumn("_k", rank).withColumn("_raw", F.col(p) * F.count(p).over(w) / F.col("_k"))
    return raw.withColumn("q", F.least(F.lit(1.0), F.min("_raw").over(w.orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)))).drop("_k", "_raw")


def split_half(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Correlation of even and odd rows' means over keys, and the ICC(1) of the two halves."""
    odd = F.col(order) % 2 == 1
    h = df.groupBy(key).agg(F.avg(F.when(odd, F.col(value))).alias("a"), F.avg(F.when(~odd, F.col(value))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    between, within = 2 * F.var_samp((F.col("a") + F.col("b")) / 2), F.avg((F.col("a") - F.col("b")) ** 2 / 2)
    return h.agg(F.corr("a", "b").alias("r"), ((between - within) / (between + within)).alias("icc"), F.count(F.lit(1)).alias("n"))


def residual(df: DataFrame, y: str, x: str) -> DataFrame:
    """Adds residual of y on x by least squares over all rows (one row of coefficients, joined by a constant key)."""
    fit = df.agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a")).withColumn("_k", F.lit(0))
    return df.withColumn("_k", F.lit(0)).join(F.broadcast(fit), "_k").withColumn("residual", F.col(y) - F.col("_a") - F.col("_b") * F.col(x)).drop("_a", "_b", "_k")


def bootstrap_median(df: DataFrame, value: str, unit: str, replicates: int) -> DataFrame:
    """replicate, median: lower weighted medians, a unit having one weight in a replicate. Replicates without a weight have no row.

    Weights are drawn once for a unit and summed by value, as an array with a number for each replicate. The values are dealt
    over ranges; a range's sums (a row each) say in which one a replicate has its median, and only those ranges are read again.
    """
    rows = df.where(F.col(value).isNotNull()).groupBy(unit, value).agg(F.count(F.lit(1)).alias("_n"))
    draws = F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda r: let(_uniform(r, F.col(unit), "0"), _poisson))
    drawn = same(rows, df.select(unit).distinct().withColumn("_w", draws), [unit])
    every = lambda n: F.array(*[F.sum(F.get("_w", F.lit(r)) * n) for r in range(replicates)]).alias("_w")
    values = drawn.groupBy(value).agg(every(F.col("_n")))
    dealt = stored(values.repartitionByRange(value).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_range").agg(every(F.lit(1))).select("_range", F.posexplode("_w").alias("replicate", "_own"))
    w = Window.partitionBy("replicate")  # a row per range
    upto = F.sum("_own").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumns({"_before": upto - F.col("_own"), "_all": F.sum("_own").over(w)})
    hit = sums.where((F.col("_all") > 0) & (2 * F.col("_before") < F.col("_all")) & (2 * (F.col("_before") + F.col("_own")) >= F.col("_all")))
    c = dealt.join(F.broadcast(hit), "_range").select("replicate", value, "_before", "_all", F.get("_w", F.col("replicate")).alias("_w")).where("_w > 0")
    c = c.withColumn("_upto", F.col("_before") + F.sum("_w").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    return c.where(2 * F.col("_upto") >= F.col("_all")).groupBy("replicate").agg(F.min(value).alias("median"))


def interval(replicates: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    """low and high of the middle ``level`` of the replicates' values, and their number."""
    tail = (1 - level) / 2
    return replicates.agg(F.percentile(value, F.lit(tail)).alias("low"), F.percentile(value, F.lit(1 - tail)).alias("high"), F.count(value).alias("replicates"))


def dose_response(df: DataFrame, category: str, value: str, reference: str) -> DataFrame:
    """Per category: n, mean and median; against the reference category, Cohen's d, the rank-biserial correlation and z
    of the Mann-Whitney test. Categories are few; each but the reference meets the reference's rows once."""
    d = df.where(F.col(value).isNotNull())
    summary = d.groupBy(category).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.var_samp(value).alias("_v"))
    others = [r[0] for r in d.select(category).distinct().where(F.col(category) != reference).collect()]
    spread = d.withColumn("_for", F.when(F.col(category) == reference, F.array(*map(F.lit, others))).otherwise(F.array(category)))
    pairs = spread.select(F.explode("_for").alias("_for"), (F.col(category) != reference).alias("_g"), value)
    tests = mann_whitney(pairs, "_g", value, ["_for"]).select(F.col("_for").alias(category), "rank_biserial", "z")
    own = summary.where(F.col(category) == reference).select(F.col("n").alias("_n0"), F.col("mean").alias("_m0"), F.col("_v").alias("_v0"), F.lit(0).alias("_k"))
    out = summary.withColumn("_k", F.lit(0)).join(F.broadcast(own), "_k").join(tests.hint("merge"), category, "left")
    pooled = F.sqrt(((F.col("n") - 1) * F.col("_v") + (F.col("_n0") - 1) * F.col("_v0")) / (F.col("n") + F.col("_n0") - 2))
    return out.select(category, "n", "mean", "median", F.when(F.col(category) != reference, (F.col("mean") - F.col("_m0")) / pooled).alias("d"), "rank_biserial", "z")


def chosen_thresholds(df: DataFrame, recording: str, truth: str, z: str, xs: list[float], ys: list[float], seed: str = "0") -> DataFrame:
    """x, y, kappa_train, kappa_test: the rule of ``two_threshold`` of greatest kappa on one half of the recordings (drawn by
    hash; of equal ones the least x, then y), and its kappa on the other half. One row."""
    from .windows import halves

    half = halves(df, recording, seed)
    train = two_threshold(half.where("half = 'reference'"), recording, truth, z, xs, ys)
    best = train.agg(F.max(F.struct(F.round("kappa", 9).alias("k"), (-F.col("x")).alias("x"), (-F.col("y")).alias("y"))).alias("b"))
    best = best.select((-F.col("b.x")).alias("x"), (-F.col("b.y")).alias("y"), F.col("b.k").alias("kappa_train"))
    test = two_threshold(half.where("half = 'held_out'"), recording, truth, z, xs, ys).select("x", "y", F.col("kappa").alias("kappa_test"))
    return best.join(test.hint("merge"), ["x", "y"], "left")


def logit(df: DataFrame, truth: str, features: list[str], rounds: int = 30, tolerance: float = 1e-10) -> DataFrame:
    """term, coefficient, error, z, p of an unpenalised logistic regression, by Newton steps: each is one aggregate over the
    rows, and only its sums, a number per pair of features, reach the driver. Rows with a null drop out. Nulls where the
    fit doesn't exist: one class, no rows, collinear features or perfectly separated classes.
    """
    import numpy as np

    from ..sources.shared import stored

    spark, terms = df.sparkSession, ["intercept", *features]
    rows = stored(df.select(F.col(truth).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in features]).dropna(), "logit")
    x = [F.lit(1.0), *[F.col(c) for c in features]]
    size = len(x)
    upper = [(i, j) for i in range(size) for j in range(i, size)]
    b, information = np.zeros(size), None
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-sum((float(v) * c for v, c in zip(b[1:], x[1:], strict=True)), F.lit(float(b[0])))))
        d = rows.withColumn("_p", p)
        sums = d.agg(*[F.sum(c * (F.col("_y") - F.col("_p"))) for c in x], *[F.sum(x[i] * x[j] * F.col("_p") * (1 - F.col("_p"))) for i, j in upper]).first()
        if sums[0] is None:
            break
        matrix = np.zeros((size, size))
        for (i, j), v in zip(upper, sums[size:], strict=True):
            matrix[i, j] = matrix[j, i] = v
        if not np.isfinite(matrix).all() or np.linalg.cond(matrix) > 1e13:
            break
        step = np.linalg.solve(matrix, np.array(sums[:size]))
        b = b + step
        if np.abs(step).max() < tolerance * max(1.0, np.abs(b).max()):
            information = matrix
            break
    error = [None] * size if information is None else [float(v) for v in np.sqrt(np.diag(np.linalg.inv(information)))]
    out = spark.createDataFrame([(t, None if e is None else float(v), e) for t, v, e in zip(terms, b, error, strict=True)], "term string, coefficient double, error double")
    z = F.col("coefficient") / F.col("error")
    return out.withColumn("z", z).withColumn("p", two_sided(F.col("z")))
