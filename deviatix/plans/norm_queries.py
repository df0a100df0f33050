"""Queries of reference curves, deviations and evaluation statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import special
from ..operators import aggregates as A
from ..operators import norms as N
from ..operators import stats as S
from ..operators import windows as W
from ..registry import query
from ..sources.shared import stored
from .relational_queries import _VOTE, votes
from .tables import POW, SEG, powers, rounded, segments, table

GRID = [float(a) for a in range(5, 91, 5)]
_GRID = "gr AS (SELECT CAST(unnest(range(5, 91, 5)) AS DOUBLE) AS g)"
_CLEAN = "cl AS (SELECT stage, age, y FROM seg WHERE NOT artifact)"
_WQ = f"""{_GRID}, {_CLEAN}, c AS (SELECT stage, age, y, count(*) AS n FROM cl GROUP BY ALL),
  w AS (SELECT stage, g, y, sum(n * exp(-0.5 * ((age - g) / 5) ** 2)) AS w, sum(n * exp(-0.5 * ((age - g) / 5) ** 2) ** 2) AS w2 FROM c JOIN gr ON abs(age - g) <= 20 GROUP BY ALL),
  cw AS (SELECT *, sum(w) OVER (PARTITION BY stage, g) AS total, sum(w) OVER (PARTITION BY stage, g) ** 2 / sum(w2) OVER (PARTITION BY stage, g) AS n_eff, (sum(w) OVER (PARTITION BY stage, g ORDER BY y) - w / 2) / sum(w) OVER (PARTITION BY stage, g) AS c FROM w),
  b AS (SELECT *, lag(c) OVER (PARTITION BY stage, g ORDER BY y) AS c0, lag(y) OVER (PARTITION BY stage, g ORDER BY y) AS v0 FROM cw)"""

#: The same of the trimmed rows: 0.2 to 99.8 % of each cell of 50 rows or more.
_WQT = _WQ.replace(_CLEAN, "cl AS (SELECT stage, age, y FROM seg JOIN (SELECT stage, quantile_cont(y, 0.002) AS lo, quantile_cont(y, 0.998) AS hi FROM seg WHERE NOT artifact GROUP BY 1 HAVING count(y) >= 50) USING (stage) WHERE NOT artifact AND y BETWEEN lo AND hi)")


def _q(q):
    return f"coalesce(arg_min(CASE WHEN c0 IS NULL THEN y ELSE v0 + (y - v0) * ({q} - c0) / (c - c0) END, c) FILTER (c >= {q}), max(y))"


def clean(spark, sf):
    return segments(spark, sf).where(~F.col("artifact")).select("eeg_id", "segment", "stage", "age", "y")


@query("n01_n02_percentile_curves", f"WITH {SEG}, {_WQ} SELECT stage, g, round(any_value(total), 5) AS weight, round({_q(0.05)}, 5) AS p5, round({_q(0.5)}, 5) AS p50, round({_q(0.95)}, 5) AS p95 FROM b WHERE n_eff >= 25 GROUP BY 1, 2")
def n02(spark, sf):
    out = N.quantile_curve(clean(spark, sf), ["stage"], "age", "y", GRID, 5.0, {"p5": 0.05, "p50": 0.5, "p95": 0.95}, min_effective=25)
    return rounded(out.drop("n_eff"), 5)


#: The robust curve with its trimming and gates: weight 20 a point, 10 points a cell.
_KT = f"{_WQT}, k AS (SELECT stage, g, {_q(0.5)} AS mu, greatest(({_q(0.75)} - {_q(0.25)}) / 1.349, 1e-6) AS sigma FROM b WHERE total >= 20 GROUP BY 1, 2 QUALIFY count(*) OVER (PARTITION BY stage) >= 10)"


@query("n04_robust_curves", f"WITH {SEG}, {_KT} SELECT stage, g, round(mu, 5) AS mu, round(sigma, 5) AS sigma FROM k")
def n04(spark, sf):
    return rounded(N.robust_curve(clean(spark, sf), ["stage"], "age", "y", GRID, 5.0), 5)


@query("n05_mean_sd_curves", f"WITH {SEG}, {_GRID}, {_CLEAN} SELECT stage, g, round(sum(w), 5) AS weight, round(sum(w * y) / sum(w), 5) AS mu, round(sqrt(greatest(sum(w * y * y) / sum(w) - (sum(w * y) / sum(w)) ** 2, 0)), 5) AS sd FROM (SELECT stage, g, y, exp(-0.5 * ((age - g) / 8) ** 2) AS w FROM cl JOIN gr ON abs(age - g) <= 32) GROUP BY 1, 2")
def n05(spark, sf):
    return rounded(N.mean_sd_curve(clean(spark, sf), ["stage"], "age", "y", GRID, 8.0), 5)


@query("n08_n12_pair_norms", f"WITH {POW} SELECT stage, round(avg(delta - theta), 6) AS mu, round(coalesce(nullif(stddev_pop(delta - theta), 0), 1), 6) AS sd FROM pw GROUP BY 1")
def n08(spark, sf):
    return rounded(N.pair_norms(powers(spark, sf).withColumn("d", F.col("delta") - F.col("theta")), ["stage"], "d"))


_DEV = f"""{_KT},
  kk AS (SELECT *, lead(g) OVER w AS g1, lead(mu) OVER w AS mu1, lead(sigma) OVER w AS s1, min(g) OVER (PARTITION BY stage) AS gmin, max(g) OVER (PARTITION BY stage) AS gmax FROM k WINDOW w AS (PARTITION BY stage ORDER BY g)),
  x AS (SELECT s.*, least(greatest(age, gmin), gmax) AS xa FROM seg s LEFT JOIN (SELECT DISTINCT stage, gmin, gmax FROM kk) USING (stage)),
  dev AS (SELECT x.eeg_id, x.segment, x.stage, x.artifact, (y - (mu + coalesce((mu1 - mu) * (xa - g) / (g1 - g), 0))) / (sigma + coalesce((s1 - sigma) * (xa - g) / (g1 - g), 0)) AS z FROM x LEFT JOIN kk ON kk.stage = x.stage AND xa >= g AND (xa < g1 OR g1 IS NULL))"""


def deviations(spark, sf):
    """z of each segment; the curve is written once, as every use of the deviations reads it."""
    curve = stored(N.robust_curve(clean(spark, sf), ["stage"], "age", "y", GRID, 5.0), "curve")
    return N.deviation(segments(spark, sf), curve, ["stage"], "age", "y")


@query("n11_deviation", f"WITH {SEG}, {_DEV} SELECT eeg_id, segment, stage, round(z, 4) AS z FROM dev")
def n11(spark, sf):
    return rounded(deviations(spark, sf).select("eeg_id", "segment", "stage", "z"), 4)


@query("flagship_burden", f"""WITH {SEG}, {_DEV}, u AS (SELECT * FROM dev WHERE NOT artifact),
  a AS (SELECT eeg_id, avg(CASE WHEN z > 1 THEN 1.0 ELSE 0.0 END) AS prevalence, coalesce(quantile_cont(CASE WHEN z > 1 THEN z END, 0.5), 0) AS severity, avg(greatest(z - 1, 0)) AS burden FROM u GROUP BY 1),
  f AS (SELECT eeg_id, segment, z > 1 AS f, CASE WHEN z > 1 AND NOT coalesce(lag(z) OVER (PARTITION BY eeg_id ORDER BY segment) > 1, false) THEN 1 ELSE 0 END AS s FROM u),
  r AS (SELECT *, sum(s) OVER (PARTITION BY eeg_id ORDER BY segment) AS run FROM f), n AS (SELECT eeg_id, max((15 + (m - 1) * 14) / 60) AS longest FROM (SELECT eeg_id, run, count(*) AS m FROM r WHERE f GROUP BY 1, 2) GROUP BY 1)
  SELECT eeg_id, round(prevalence, 4) AS prevalence, round(severity, 4) AS severity, round(burden, 4) AS burden, round(coalesce(longest, 0), 4) AS longest FROM a LEFT JOIN n USING (eeg_id) ORDER BY round(burden, 4) DESC, eeg_id LIMIT 20""")
def flagship(spark, sf):
    """Which recordings deviate most from the norm of their age and state, and for how long (a top-20 report)."""
    u = deviations(spark, sf).where(~F.col("artifact"))
    z = F.col("z")
    a = u.groupBy("eeg_id").agg(A.prevalence(z, 1.0).alias("prevalence"), A.severity(z, 1.0).alias("severity"), A.burden(z, 1.0).alias("burden"))
    runs = W.persistence(u.select("eeg_id", "segment", "z"), "eeg_id", "segment", z > 1).select("eeg_id", "longest")
    return rounded(a.join(runs, "eeg_id"), 4).orderBy(F.desc("burden"), "eeg_id").limit(20)


@query("n14_a12_descriptors", f"""WITH {SEG}, {_DEV} SELECT eeg_id, round(avg(CASE WHEN stage IN ('click', 'view') THEN z END) - avg(CASE WHEN stage IN ('purchase', 'signup') THEN z END), 4) AS lat_signed, round(quantile_cont(z, 0.9), 4) AS p90, round(max(z), 4) AS top FROM dev WHERE NOT artifact GROUP BY 1""")
def n14(spark, sf):
    u = deviations(spark, sf).where(~F.col("artifact"))
    side = lambda *s: F.avg(F.when(F.col("stage").isin(*s), F.col("z")))
    return rounded(u.groupBy("eeg_id").agg((side("click", "view") - side("purchase", "signup")).alias("lat_signed"), F.percentile("z", F.lit(0.9)).alias("p90"), F.max("z").alias("top")), 4)


@query("n15_empirical_z", """WITH nl AS (SELECT event_type, value FROM events WHERE user_id % 3 = 0), r AS (SELECT event_id, event_type, value FROM events WHERE user_id % 3 <> 0), n AS (SELECT event_type, count(*) AS n FROM nl GROUP BY 1),
  b AS (SELECT event_id, r.event_type, (SELECT count(*) FROM nl WHERE nl.event_type = r.event_type AND nl.value <= r.value) AS b FROM r) SELECT event_id, round(least(greatest(b, 1), n) / (n + 1), 6) AS share FROM b JOIN n USING (event_type)""")
def n15(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return rounded(N.empirical_share(e.where("user_id % 3 <> 0"), e.where("user_id % 3 = 0"), ["event_type"], "value").select("event_id", "share"))


@query("n16_out_of_fold", f"WITH {SEG}, {_GRID}, cl AS (SELECT stage, age, y, eeg_id % 3 AS fold FROM seg WHERE NOT artifact), f AS (SELECT unnest([0, 1, 2]) AS fold) SELECT CAST(fold AS BIGINT) AS fold, stage, g, round(sum(w * y) / sum(w), 5) AS mu FROM (SELECT f.fold, stage, g, y, exp(-0.5 * ((age - g) / 8) ** 2) AS w FROM cl JOIN f ON cl.fold <> f.fold JOIN gr ON abs(age - g) <= 32) GROUP BY 1, 2, 3")
def n16(spark, sf):
    d = clean(spark, sf).withColumn("fold", (F.col("eeg_id") % 3).cast("int"))
    out = N.out_of_fold(d, "fold", 3, lambda x: N.mean_sd_curve(x, ["fold", "stage"], "age", "y", GRID, 8.0))
    return rounded(out.select(F.col("fold").cast("long").alias("fold"), "stage", "g", "mu"), 5)


@query("n10_n15_z_udfs")
def n10(spark, sf):
    """Box-Cox-t z and normal quantiles: numpy UDFs, tested against tabulated values."""
    p = powers(spark, sf)
    z = special.bct_z(F.col("theta"), F.lit(30.0), F.lit(0.5), F.lit(0.7), F.lit(8.0))
    return p.select("eeg_id", "channel", F.round(z, 6).alias("z"), F.round(special.norm_cdf(z), 6).alias("share"))


_LAB = "lb AS (SELECT l.doc_id, quality, toxic, CAST(n_chars AS DOUBLE) AS score, source FROM labels l JOIN documents d USING (doc_id))"


def labelled(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"), "source")
    return table(spark, sf, "labels").join(d, "doc_id")


def _auc(by=""):
    key = f"PARTITION BY {by}" if by else ""
    sel = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"SELECT {sel}CAST(sum(quality) AS DOUBLE) AS positives, CAST(sum(1 - quality) AS DOUBLE) AS negatives, round((sum(r) FILTER (quality = 1) - sum(quality) * (sum(quality) + 1) / 2) / (sum(quality) * sum(1 - quality)), 6) AS auroc FROM (SELECT *, rank() OVER ({key} ORDER BY score) + (count(*) OVER ({key}{' ' if key else ''}{', score' if key else 'PARTITION BY score'}) - 1) / 2.0 AS r FROM lb) {grp}"


@query("st_a1_auroc", f"WITH {_LAB} " + _auc())
def a1(spark, sf):
    return rounded(S.auroc(labelled(spark, sf), "quality", "score"))


@query("st_a6_auroc_by_group", f"WITH {_LAB} " + _auc("source"))
def a6(spark, sf):
    return rounded(S.auroc(labelled(spark, sf), "quality", "score", ["source"]))


@query("st_a2_operating_points", f"WITH {_LAB}, c AS (SELECT score, sum(quality) AS p, sum(1 - quality) AS q FROM lb GROUP BY 1), t AS (SELECT score, p, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS np, sum(q) OVER () AS nq FROM c WINDOW w AS (ORDER BY score DESC)) SELECT score, CAST(p AS BIGINT) AS p, round(tp / np, 6) AS tpr, round(fp / nq, 6) AS fpr, round(tp / (tp + fp), 6) AS precision FROM t")
def a2(spark, sf):
    return rounded(S.operating_points(labelled(spark, sf), "quality", "score"))


@query("st_a2_average_precision", f"WITH {_LAB}, c AS (SELECT score, sum(quality) AS p, sum(1 - quality) AS q FROM lb GROUP BY 1), t AS (SELECT p, sum(p) OVER w / (sum(p) OVER w + sum(q) OVER w) AS pr FROM c WINDOW w AS (ORDER BY score DESC)) SELECT round(sum(p * pr) / sum(p), 6) AS average_precision FROM t")
def a2b(spark, sf):
    return rounded(S.average_precision(S.operating_points(labelled(spark, sf), "quality", "score")))


_PW = "(" + " + ".join(f"CAST(u >= {s} AS INTEGER)" for s in ("0.36787944117144233", "0.7357588823428847", "0.9196986029286058", "0.9810118431238462", "0.9963401531726563", "0.9994058151824183", "0.9999167588507119")) + ")"


@query("st_a4_a5_bootstrap", f"""WITH {_LAB}, r AS (SELECT unnest(range(0, 20)) AS replicate), d AS (SELECT replicate, quality, score, CAST('0x' || substr(md5('0|' || replicate || '|' || source), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM lb, r),
  w AS (SELECT replicate, quality, score, CAST({_PW} AS DOUBLE) AS w FROM d), c AS (SELECT replicate, score, sum(w * quality) AS p, sum(w * (1 - quality)) AS q FROM w WHERE w > 0 GROUP BY 1, 2),
  b AS (SELECT *, sum(q) OVER (PARTITION BY replicate ORDER BY score) - q AS below FROM c) SELECT CAST(replicate AS BIGINT) AS replicate, sum(p) AS positives, sum(q) AS negatives, round(sum(p * (below + q / 2)) / (sum(p) * sum(q)), 6) AS auroc FROM b GROUP BY 1""")
def a4(spark, sf):
    out = S.bootstrap_auroc(labelled(spark, sf), "quality", "score", "source", 20)
    return rounded(out.withColumn("replicate", F.col("replicate").cast("long")))


def _rank(c):
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query("st_a7_spearman", f"SELECT round(corr(ra, rb), 6) AS rho, count(*) AS n FROM (SELECT {_rank('l_quantity')} AS ra, {_rank('l_extendedprice')} AS rb FROM lineitem)")
def a7(spark, sf):
    return rounded(S.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"))


@query("st_a8_mann_whitney", f"""WITH {_LAB}, t AS (SELECT quality, {_rank('score')} AS r, count(*) OVER (PARTITION BY score) AS m FROM lb), s AS (SELECT CAST(sum(quality) AS DOUBLE) AS n1, CAST(count(*) AS DOUBLE) AS n, sum(r) FILTER (quality = 1) AS r, sum(m * m - 1) AS ties FROM t),
  u AS (SELECT n1, n - n1 AS n2, n, r - n1 * (n1 + 1) / 2 AS u, ties FROM s) SELECT n1, n2, round(u, 6) AS u, round(sign(u - n1 * n2 / 2) * greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))), 6) AS z, round(2 * u / (n1 * n2) - 1, 6) AS rank_biserial FROM u""")
def a8(spark, sf):
    return rounded(S.mann_whitney(labelled(spark, sf), "quality", "score"))


@query("st_a9_signed_rank", f"SELECT round(sum(r) FILTER (d > 0), 6) AS w_plus, count(*) AS n, round(avg(CAST(d > 0 AS DOUBLE)), 6) AS share_positive FROM (SELECT d, {_rank('abs(d)')} AS r FROM (SELECT l_quantity - 25 AS d FROM lineitem) WHERE d <> 0)")
def a9(spark, sf):
    return rounded(S.signed_rank(table(spark, sf, "lineitem").select((F.col("l_quantity") - 25).alias("d")), "d"))


@query("st_a10_kruskal", f"""WITH t AS (SELECT o_orderpriority AS g, {_rank('x')} AS r, count(*) OVER (PARTITION BY x) AS m FROM (SELECT o_orderpriority, round(o_totalprice / 1000) AS x FROM orders)), s AS (SELECT sum(r) AS r, count(*) AS m FROM t GROUP BY g),
  n AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(m * m - 1) AS ties FROM t) SELECT round((12 / (n * (n + 1)) * (SELECT sum(r * r / m) FROM s) - 3 * (n + 1)) / (1 - ties / (n ** 3 - n)), 5) AS h, (SELECT count(*) - 1 FROM s) AS df FROM n""")
def a10(spark, sf):
    return rounded(S.kruskal(table(spark, sf, "orders").withColumn("x", F.round(F.col("o_totalprice") / 1000)), "o_orderpriority", "x"), 5)


@query("st_a11_cohen_d", f"WITH {_LAB} SELECT round((avg(score) FILTER (quality = 1) - avg(score) FILTER (quality = 0)) / sqrt(((count(*) FILTER (quality = 1) - 1) * var_samp(score) FILTER (quality = 1) + (count(*) FILTER (quality = 0) - 1) * var_samp(score) FILTER (quality = 0)) / (count(*) - 2)), 6) AS d FROM lb")
def a11(spark, sf):
    return rounded(S.cohen_d(labelled(spark, sf), "quality", "score"))


@query("st_a12_fleiss", f"WITH {_VOTE}, i AS (SELECT item, CAST(count(*) AS DOUBLE) AS n, CAST(sum(vote) AS DOUBLE) AS y FROM v GROUP BY 1 HAVING count(*) > 1), s AS (SELECT count(*) AS items, avg((y * (y - 1) + (n - y) * (n - y - 1)) / (n * (n - 1))) AS po, sum(y) / sum(n) AS p FROM i) SELECT items, round((po - (p * p + (1 - p) * (1 - p))) / (1 - (p * p + (1 - p) * (1 - p))), 6) AS kappa FROM s")
def a12(spark, sf):
    return rounded(S.fleiss(votes(spark, sf), "item", "vote"))


_KAPPA = "round((po - pe) / (1 - pe), 6) AS kappa"


@query("st_a13_kappa", f"WITH {_LAB}, c AS (SELECT quality AS a, CAST(score > 1500 AS INTEGER) AS b FROM lb), s AS (SELECT count(*) AS n, avg(CAST(a = b AS DOUBLE)) AS po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe, ((avg(a) + avg(b)) / 2) * (1 - (avg(a) + avg(b)) / 2) * 2 AS ge FROM c) SELECT n, round(po, 6) AS accuracy, {_KAPPA}, round((po - ge) / (1 - ge), 6) AS ac1 FROM s")
def a13(spark, sf):
    return rounded(S.agreement(labelled(spark, sf).withColumn("call", (F.col("score") > 1500).cast("int")), "quality", "call"))


@query("st_a14_rater_pairs", f"WITH {_VOTE}, p AS (SELECT x.rater AS rater_a, y.rater AS rater_b, x.vote AS a, y.vote AS b FROM v x JOIN v y ON x.item = y.item AND x.rater < y.rater), s AS (SELECT rater_a, rater_b, count(*) AS n, avg(CAST(a = b AS DOUBLE)) AS po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe, ((avg(a) + avg(b)) / 2) * (1 - (avg(a) + avg(b)) / 2) * 2 AS ge FROM p GROUP BY 1, 2) SELECT rater_a, rater_b, n, round(po, 6) AS accuracy, {_KAPPA}, round((po - ge) / (1 - ge), 6) AS ac1 FROM s WHERE n >= 5")
def a14(spark, sf):
    return rounded(S.rater_pairs(votes(spark, sf), "item", "rater", "vote"))


@query("st_a16_two_thresholds", f"""WITH {SEG}, xs AS (SELECT CAST(unnest([3, 3.5, 4]) AS DOUBLE) AS x), ys AS (SELECT CAST(unnest([0.2, 0.4, 0.5]) AS DOUBLE) AS y0), sh AS (SELECT eeg_id, CAST(eeg_id % 3 = 0 AS INTEGER) AS a, x, avg(CAST(y > x AS DOUBLE)) AS share FROM seg, xs GROUP BY 1, 2, 3),
  c AS (SELECT x, y0 AS y, a, CAST(share > y0 AS INTEGER) AS b FROM sh, ys), s AS (SELECT x, y, avg(CAST(a = b AS DOUBLE)) AS po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe FROM c GROUP BY 1, 2) SELECT x, y, {_KAPPA}, round(po, 6) AS accuracy FROM s""")
def a16(spark, sf):
    d = segments(spark, sf).withColumn("truth", F.col("eeg_id") % 3 == 0).select("eeg_id", "truth", F.col("y").alias("z"))
    return rounded(S.two_threshold(d, "eeg_id", "truth", "z", [3, 3.5, 4], [0.2, 0.4, 0.5]))


@query("st_a17_matched_thresholds", "WITH r AS (SELECT l_extendedprice AS v, CAST(rank() OVER (ORDER BY l_extendedprice) + count(*) OVER (PARTITION BY l_extendedprice) - 1 AS DOUBLE) / count(*) OVER () AS s FROM lineitem) SELECT round(min(v) FILTER (s >= 0.2), 6) AS low, round(min(v) FILTER (s >= 0.7), 6) AS high FROM r")
def a17(spark, sf):
    return rounded(S.matched_thresholds(table(spark, sf, "lineitem"), "l_extendedprice", {"low": 0.2, "high": 0.7}))


@query("st_a18_residual_auroc", "WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem), x AS (SELECT l_returnflag, l_linestatus, l_extendedprice - a - b * l_quantity AS r FROM lineitem, f) SELECT l_returnflag, round(avg(r), 3) AS mean, round(stddev_samp(r), 3) AS sd FROM x GROUP BY 1")
def a18(spark, sf):
    r = S.residual(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity")
    return rounded(r.groupBy("l_returnflag").agg(F.avg("residual").alias("mean"), F.stddev_samp("residual").alias("sd")), 3)


@query("st_a21_fdr", "WITH p AS (SELECT p_brand AS family, p_partkey AS id, (p_partkey * 37 % 997 + 1) / 1000.0 AS p FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, id) AS k, count(*) OVER (PARTITION BY family) AS m FROM p) SELECT id, round(least(1, min(p * m / k) OVER (PARTITION BY family ORDER BY k DESC)), 6) AS q FROM r")
def a21(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("family"), F.col("p_partkey").alias("id"), ((F.col("p_partkey") * 37 % 997 + 1) / 1000).alias("p"))
    return rounded(S.fdr(p, "family", "p", "id").select("id", "q"))


@query("st_a22_split_half", f"WITH {SEG}, h AS (SELECT eeg_id, avg(y) FILTER (segment % 2 = 1) AS a, avg(y) FILTER (segment % 2 = 0) AS b FROM seg GROUP BY 1) SELECT round(corr(a, b), 6) AS r, round((2 * var_samp((a + b) / 2) - avg((a - b) ** 2 / 2)) / (2 * var_samp((a + b) / 2) + avg((a - b) ** 2 / 2)), 6) AS icc, count(*) AS n FROM h WHERE a IS NOT NULL AND b IS NOT NULL")
def a22(spark, sf):
    return rounded(S.split_half(segments(spark, sf), "eeg_id", "segment", "y"))
