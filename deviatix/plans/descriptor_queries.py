"""Queries of descriptors and the remaining relational operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as SC
from ..operators import aggregates as A
from ..operators import descriptors as D
from ..operators import stats as S
from ..operators import windows as W
from ..registry import query
from .norm_queries import _PW, deviations, _DEV, labelled, _LAB
from .relational_queries import _VOTE, votes
from .signal_queries import _LONG, _PSD, long
from .tables import POW, SEG, powers, rounded, segments, table


@query("a11_pair_grid", f"WITH {POW}, t AS (SELECT CAST(unnest([0.5, 1, 2, 4]) AS DOUBLE) AS threshold) SELECT stage, threshold, round(avg(CAST(abs(alpha - beta) > threshold AS DOUBLE)), 6) AS share, round(avg(sign(alpha - beta)) FILTER (abs(alpha - beta) > threshold), 6) AS sign FROM pw, t GROUP BY 1, 2")
def a11(spark, sf):
    return rounded(D.pair_grid(powers(spark, sf).withColumn("d", F.col("alpha") - F.col("beta")), ["stage"], "d", [0.5, 1, 2, 4]))


@query("a17_weighted_composition", "SELECT c_mktsegment, round(sum(c_acctbal * (c_custkey % 7)) / sum(c_custkey % 7), 6) AS share FROM customer GROUP BY 1")
def a17(spark, sf):
    return rounded(D.weighted_composition(table(spark, sf, "customer").withColumn("n", F.col("c_custkey") % 7), ["c_mktsegment"], "c_acctbal", "n"))


@query("a20_a30_two_scans", f"WITH {SEG}, a AS (SELECT eeg_id, quantile_cont(y, 0.5) AS med FROM seg WHERE NOT artifact GROUP BY 1), b AS (SELECT eeg_id, quantile_cont(value, 0.9) AS p90 FROM seg WHERE stage = 'click' GROUP BY 1) SELECT eeg_id, round(med, 6) AS med, round(p90, 6) AS p90 FROM a FULL JOIN b USING (eeg_id)")
def a20(spark, sf):
    s = segments(spark, sf)
    a = s.where(~F.col("artifact")).groupBy("eeg_id").agg(A.median("y").alias("med"))
    return rounded(a.join(s.where("stage = 'click'").groupBy("eeg_id").agg(F.percentile("value", F.lit(0.9)).alias("p90")), "eeg_id", "full"))


@query("a25_window_to_segment", f"WITH {SEG} SELECT eeg_id, CAST(floor((segment + 0.5) / 4) AS BIGINT) AS seg4, round(avg(value), 6) AS mean, round(max(value), 6) AS top FROM seg GROUP BY 1, 2")
def a25(spark, sf):
    return rounded(segments(spark, sf).groupBy("eeg_id", F.floor((F.col("segment") + 0.5) / 4).alias("seg4")).agg(F.avg("value").alias("mean"), F.max("value").alias("top")))


@query("a26_context_windows", f"WITH {SEG}, n AS (SELECT *, count(*) OVER (PARTITION BY eeg_id) AS n FROM seg), b AS (SELECT eeg_id, segment, n < 9 AS padded, greatest(least(segment - 4, n - 9), 0) AS lo FROM n) SELECT b.eeg_id, b.segment, round(avg(s.y), 6) AS mean, any_value(padded) AS padded FROM b JOIN seg s ON s.eeg_id = b.eeg_id AND s.segment >= lo AND s.segment < lo + 9 GROUP BY 1, 2")
def a26(spark, sf):
    return rounded(D.context_means(segments(spark, sf), "eeg_id", "segment", "y", 9))


@query("a28_electrode_means", f"WITH {POW}, m AS (SELECT stage, channel, quantile_cont(delta, 0.5) AS v FROM pw GROUP BY 1, 2), i AS (SELECT unnest([1, 1, 2, 2, 3, 3]) AS electrode, unnest([1, 2, 2, 3, 3, 4]) AS channel) SELECT stage, CAST(electrode AS BIGINT) AS electrode, round(avg(v), 6) AS v FROM m JOIN i USING (channel) GROUP BY 1, 2")
def a28(spark, sf):
    bridge = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3), (3, 3), (3, 4)], "electrode long, channel long")
    m = powers(spark, sf).groupBy("stage", "channel").agg(A.median("delta").alias("v"))
    return rounded(m.join(F.broadcast(bridge), "channel").groupBy("stage", "electrode").agg(F.avg("v").alias("v")))


@query("a31_n17_cells", f"WITH {SEG}, {_DEV}, cells AS (SELECT eeg_id, stage, avg(abs(z)) AS v FROM dev GROUP BY 1, 2) SELECT eeg_id, round(max(v), 4) AS top, round(quantile_cont(v, 0.95), 4) AS p95 FROM cells GROUP BY 1")
def a31(spark, sf):
    c = deviations(spark, sf).groupBy("eeg_id", "stage").agg(F.avg(F.abs("z")).alias("v"))
    return rounded(c.groupBy("eeg_id").agg(F.max("v").alias("top"), F.percentile("v", F.lit(0.95)).alias("p95")), 4)


@query("a32_ml06_focus", f"WITH {POW} SELECT eeg_id, round(max(abs(alpha - beta)), 6) AS max, round(max(abs(alpha - beta)) - quantile_cont(abs(alpha - beta), 0.5), 6) AS contrast, round(avg(abs(alpha - beta)), 6) AS mean FROM pw GROUP BY 1")
def a32(spark, sf):
    return rounded(D.focus(powers(spark, sf).withColumn("d", F.abs(F.col("alpha") - F.col("beta"))), "eeg_id", "d"))


@query("a35_st_a19_naming_rates", f"WITH {SEG}, r AS (SELECT eeg_id, max(y) FILTER (stage = 'click') > 4.5 AS wake, max(y) FILTER (stage = 'view') > 4.5 AS sleep, eeg_id % 2 = 0 AS named FROM seg GROUP BY 1) SELECT CASE WHEN wake THEN 'wake' WHEN sleep THEN 'sleep only' ELSE 'neither' END AS visible, count(*) AS n, round(avg(CAST(named AS DOUBLE)), 6) AS rate FROM r GROUP BY 1")
def a35(spark, sf):
    top = lambda s: F.max(F.when(F.col("stage") == s, F.col("y"))) > 4.5
    r = segments(spark, sf).groupBy("eeg_id").agg(top("click").alias("wake"), top("view").alias("sleep"))
    v = F.when(F.col("wake"), "wake").when(F.col("sleep"), "sleep only").otherwise("neither")
    return rounded(r.groupBy(v.alias("visible")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("eeg_id") % 2 == 0).cast("double")).alias("rate")))


@query("w18_accent", f"WITH {SEG}, m AS (SELECT eeg_id, stage, avg(y) AS m FROM seg GROUP BY 1, 2) SELECT eeg_id, arg_max(stage, m) AS accent, count(*) AS states FROM m GROUP BY 1")
def w18(spark, sf):
    return D.accent(segments(spark, sf), "eeg_id", "stage", "y", ["click", "view", "purchase", "signup", "error"])


@query("w05_w22_quota_selection", "WITH p AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderkey) = 1) SELECT o_orderkey, o_orderpriority FROM p QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('0|' || CAST(o_orderkey AS VARCHAR)), o_orderkey) <= 50")
def w05(spark, sf):
    one = W.first_by(table(spark, sf, "orders"), ["o_custkey"], F.when(F.col("o_orderstatus") == "F", 0).otherwise(1), "o_orderkey")
    return W.capped(one, ["o_orderpriority"], ["o_orderkey"], 50).select("o_orderkey", "o_orderpriority")


@query("w14_w15_shards", "SELECT c_custkey, CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8) AS BIGINT) % 16 AS shard FROM customer")
def w14(spark, sf):
    return W.shard(table(spark, sf, "customer"), "c_custkey", 16).select("c_custkey", "shard")


@query("j17_assigned_probability", f"WITH {POW} SELECT eeg_id, channel, round([delta, theta, alpha][channel % 3 + 1] / (delta + theta + alpha), 6) AS p FROM pw")
def j17(spark, sf):
    p = F.element_at(F.array("delta", "theta", "alpha"), (F.col("channel") % 3 + 1).cast("int")) / (F.col("delta") + F.col("theta") + F.col("alpha"))
    return rounded(powers(spark, sf).select("eeg_id", "channel", p.alias("p")))


@query("j18_j19_crosswalk", "SELECT DISTINCT o_custkey AS patient, CAST(o_custkey AS VARCHAR) || '_' || strftime(o_orderdate, '%Y%m%d') AS eeg_id, c_mktsegment AS grp FROM orders JOIN customer ON o_custkey = c_custkey")
def j18(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("o_custkey").alias("patient"), F.concat_ws("_", F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyyMMdd")).alias("eeg_id"), F.col("c_mktsegment").alias("grp")).distinct()


@query("n13_peak_focality", f"WITH {POW} SELECT eeg_id, round(max(delta), 6) AS peak, round(max(delta) - quantile_cont(delta, 0.5), 6) AS focality, round(max(abs(alpha - beta)), 6) AS asym FROM pw GROUP BY 1")
def n13(spark, sf):
    return rounded(powers(spark, sf).groupBy("eeg_id").agg(F.max("delta").alias("peak"), (F.max("delta") - A.median("delta")).alias("focality"), F.max(F.abs(F.col("alpha") - F.col("beta"))).alias("asym")))


@query("n18_above_normal", f"WITH {SEG}, c AS (SELECT stage, quantile_cont(y, 0.95) AS cut FROM seg WHERE NOT artifact AND eeg_id % 3 = 0 GROUP BY 1) SELECT eeg_id, round(avg(CAST(y > cut AS DOUBLE)), 6) AS share FROM seg JOIN c USING (stage) GROUP BY 1")
def n18(spark, sf):
    s = segments(spark, sf)
    cut = s.where(~F.col("artifact") & (F.col("eeg_id") % 3 == 0)).groupBy("stage").agg(F.percentile("y", F.lit(0.95)).alias("cut"))
    return rounded(s.join(cut, "stage").groupBy("eeg_id").agg(F.avg((F.col("y") > F.col("cut")).cast("double")).alias("share")))


@query("p27_peak_pair", f"WITH {POW}, p AS (SELECT unnest([1, 2, 3]) AS pair, unnest([1, 2, 3]) AS l, unnest([4, 5, 6]) AS r), d AS (SELECT eeg_id, pair, (max(delta) FILTER (channel = l) - max(delta) FILTER (channel = r)) AS d FROM pw, p WHERE channel IN (l, r) GROUP BY 1, 2), s AS (SELECT eeg_id, pair, CASE WHEN eeg_id % 2 = 0 THEN d ELSE -d END AS d FROM d) SELECT eeg_id, CAST(arg_max(pair, struct_pack(d := d, p := -pair)) AS BIGINT) AS pair, round(max(d), 6) AS difference FROM s WHERE d > 0.5 GROUP BY 1")
def p27(spark, sf):
    pairs = spark.createDataFrame([(1, 1, 4), (2, 2, 5), (3, 3, 6)], "pair long, left long, right long")
    return rounded(D.peak_pair(powers(spark, sf), ["eeg_id"], pairs, "channel", "delta", F.when(F.col("eeg_id") % 2 == 0, "left").otherwise("right")))


@query("p28_localisation", "SELECT p_partkey, CASE WHEN NOT p_size % 2 = 0 AND p_size % 3 = 0 THEN 'diffuse' WHEN p_size % 5 >= 1 AND p_size % 7 >= 1 AND p_size % 4 = 0 THEN 'bilateral independent temporal' WHEN p_size % 11 = 0 THEN 'bilateral ' || CASE WHEN p_size % 4 = 0 THEN 'temporal' ELSE 'frontal' END ELSE 'left ' || CASE WHEN p_size % 4 = 0 THEN 'temporal' ELSE 'frontal' END END AS place FROM part")
def p28(spark, sf):
    s = F.col("p_size")
    place = D.localisation(F.when(s % 11 == 0, "bilateral").otherwise("left"), F.when(s % 4 == 0, "temporal").otherwise("frontal"), s % 2 == 0, s % 3 == 0, s % 5, s % 7)
    return table(spark, sf, "part").select("p_partkey", place.alias("place"))


_REGIONS = {1: "L_temporal", 2: "R_temporal", 3: "L_frontal", 4: "R_frontal", 5: "L_posterior", 6: "R_posterior"}
_SIDES = "((coalesce(lt, 0) + coalesce(lf, 0) + coalesce(lp, 0)) - (coalesce(rt, 0) + coalesce(rf, 0) + coalesce(rp, 0))) / 3"


@query("p28_place_of_finding", f"""WITH {POW}, r AS (SELECT eeg_id, {', '.join(f"max((theta - 36) / 19.7) FILTER (channel = {k}) AS {v[0].lower() + v[2]}" for k, v in _REGIONS.items())}, quantile_cont((delta - 25) / 15, 0.9) AS d90, quantile_cont((theta - 36) / 19.7, 0.9) AS t90 FROM pw GROUP BY 1),
  l AS (SELECT *, {_SIDES} AS lat, (coalesce(lt, 0) + coalesce(rt, 0)) / 2 AS temporal, (coalesce(lf, 0) + coalesce(rf, 0)) / 2 AS frontal, (coalesce(lp, 0) + coalesce(rp, 0)) / 2 AS posterior, greatest(lt, rt, lf, rf, lp, rp) AS peak FROM r),
  x AS (SELECT *, temporal - (frontal + posterior) / 2 AS xt, frontal - (temporal + posterior) / 2 AS xf, posterior - (temporal + frontal) / 2 AS xp, CASE peak WHEN rt THEN 'right temporal' WHEN rp THEN 'right posterior' WHEN rf THEN 'right frontal' WHEN lt THEN 'left temporal' WHEN lp THEN 'left posterior' WHEN lf THEN 'left frontal' END AS pr FROM l),
  y AS (SELECT *, abs(lat) >= 0.5 OR greatest(xt, xf, xp) >= 0.6 AS focal, CASE greatest(xt, xf, xp) WHEN xt THEN 'temporal' WHEN xf THEN 'frontal' ELSE 'posterior' END AS lobe, CASE WHEN lat > 0.25 THEN 'left' WHEN lat < -0.25 THEN 'right' ELSE 'bilateral' END AS side FROM x),
  b AS (SELECT *, least(coalesce(lt, 0), coalesce(rt, 0)) > 1 AND abs(lat) < 0.4 AND lobe = 'temporal' AS both_sides FROM y)
  SELECT eeg_id, CASE WHEN NOT focal THEN CASE WHEN frontal - posterior > 1.645 THEN 'frontally predominant' WHEN frontal - posterior < -1.645 THEN 'posteriorly predominant' ELSE 'diffuse' END WHEN both_sides THEN 'bilateral independent temporal' ELSE side || ' ' || lobe END AS place,
  CASE WHEN NOT focal THEN NULL WHEN both_sides THEN 'both temporal regions' WHEN side = 'bilateral' THEN 'the ' || lobe || ' region on both sides' WHEN starts_with(pr, side) THEN pr || ' region' END AS region,
  NOT focal OR coalesce(peak, 0) >= 1 AS confident, round(CASE WHEN focal AND peak IS NOT NULL THEN peak ELSE greatest(d90, t90) END, 5) AS magnitude FROM b""")
def p28_place(spark, sf):
    """Channels as regions of both sides: z by region, lobes and difference of sides from these, the peak and the place."""
    z, d = (F.col("theta") - 36) / 19.7, (F.col("delta") - 25) / 15
    parts = [F.max(F.when(F.col("channel") == k, z)).alias(v) for k, v in _REGIONS.items()]
    r = powers(spark, sf).groupBy("eeg_id").agg(*parts, F.percentile(d, F.lit(0.9)).alias("d90"), F.percentile(z, F.lit(0.9)).alias("t90"))
    v = {name: F.coalesce(F.col(name), F.lit(0.0)) for name in _REGIONS.values()}
    lobes = {k: (v[f"L_{k}"] + v[f"R_{k}"]) / 2 for k in ("temporal", "frontal", "posterior")}
    signed = (v["L_temporal"] + v["L_frontal"] + v["L_posterior"] - (v["R_temporal"] + v["R_frontal"] + v["R_posterior"])) / 3
    peak = F.array_max(F.array(*[F.when(F.col(name).isNotNull(), F.struct(F.col(name).alias("z"), F.lit(name).alias("name"))) for name in _REGIONS.values()]))
    r = r.select("*", signed.alias("signed"), peak.alias("peak"), *[c.alias(k) for k, c in lobes.items()])
    own = {k: F.col(k) for k in lobes}
    found = D.finding_place(F.col("signed"), own, own["frontal"] - own["posterior"], F.col("peak.name"), F.col("peak.z"), F.col("L_temporal"), F.col("R_temporal"))
    size = D.magnitude(SC.is_focal(F.col("signed"), own), F.col("peak.z"), F.col("d90"), F.col("t90"))
    return rounded(r.select("eeg_id", *[c.alias(k) for k, c in found.items()], size.alias("magnitude")), 5)


@query("dsp09_dsp11_alpha_share", f"WITH {_PSD}, {_LONG} SELECT seg, round(avg(p) FILTER (channel IN (0,1,4,5,8,9,12,13,16) AND f >= 8 AND f < 13) / (avg(p) FILTER (channel IN (0,1,4,5,8,9,12,13,16) AND f >= 8 AND f < 13) + avg(p) FILTER (channel IN (2,3,6,7,10,11,14,15,17) AND f >= 8 AND f < 13) + 1e-12), 6) AS q_apg FROM lg GROUP BY 1")
def dsp09(spark, sf):
    x = long(spark, sf).where("f >= 8 AND f < 13")
    side = lambda c: F.avg(F.when(F.col("channel").isin(c), F.col("p")))
    a, p = side([0, 1, 4, 5, 8, 9, 12, 13, 16]), side([2, 3, 6, 7, 10, 11, 14, 15, 17])
    return rounded(x.groupBy("seg").agg((a / (a + p + 1e-12)).alias("q_apg")))


@query("dsp14_liveness", "SELECT vec_id, len(list_filter([0, 16, 32, 48], lambda s: list_max(embedding[s + 1:s + 16]) - list_min(embedding[s + 1:s + 16]) > 0.6 AND list_max(list_transform(embedding[s + 1:s + 16], lambda x: abs(x))) < 0.35)) > 0 AS alive FROM embeddings")
def dsp14(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", D.liveness(F.col("embedding"), 16, flat=0.6, rail=0.35).alias("alive"))


@query("st_a15_balanced_accuracy", f"WITH {_VOTE}, o AS (SELECT *, (sum(vote) OVER w - vote) / nullif(count(vote) OVER w - 1, 0) AS others FROM v WINDOW w AS (PARTITION BY item)) SELECT rater, round((avg(vote) FILTER (others >= 0.5) + avg(1 - vote) FILTER (others < 0.5)) / 2, 6) AS balanced FROM o GROUP BY 1")
def st15(spark, sf):
    v = A.leave_one_out(votes(spark, sf), "item", "vote").where(F.col("others").isNotNull())
    yes = F.col("others") >= 0.5
    return rounded(v.groupBy("rater").agg(((F.avg(F.when(yes, F.col("vote"))) + F.avg(F.when(~yes, 1 - F.col("vote")))) / 2).alias("balanced")))


@query("st_a23_paired_difference", f"""WITH {_LAB}, r AS (SELECT unnest(range(0, 20)) AS replicate), d AS (SELECT replicate, quality, score, CAST(doc_id % 97 AS DOUBLE) AS other, CAST('0x' || substr(md5('0|' || replicate || '|' || source), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM lb, r),
  w AS (SELECT *, CAST({_PW} AS DOUBLE) AS w FROM d), c AS (SELECT replicate, 'a' AS k, score AS s, sum(w * quality) AS p, sum(w * (1 - quality)) AS q FROM w WHERE w > 0 GROUP BY 1, 3 UNION ALL SELECT replicate, 'b', other, sum(w * quality), sum(w * (1 - quality)) FROM w WHERE w > 0 GROUP BY 1, 3),
  b AS (SELECT *, sum(q) OVER (PARTITION BY replicate, k ORDER BY s) - q AS below FROM c), a AS (SELECT replicate, k, sum(p * (below + q / 2)) / (sum(p) * sum(q)) AS auroc FROM b GROUP BY 1, 2)
  SELECT CAST(x.replicate AS BIGINT) AS replicate, round(x.auroc - y.auroc, 6) AS difference FROM a x JOIN a y ON x.replicate = y.replicate AND x.k = 'a' AND y.k = 'b'""")
def st23(spark, sf):
    d = labelled(spark, sf).withColumn("other", (F.col("doc_id") % 97).cast("double"))
    a = S.bootstrap_auroc(d, "quality", "score", "source", 20).select("replicate", F.col("auroc").alias("a"))
    b = S.bootstrap_auroc(d, "quality", "other", "source", 20).select("replicate", F.col("auroc").alias("b"))
    return rounded(a.join(b.hint("merge"), "replicate").select(F.col("replicate").cast("long").alias("replicate"), (F.col("a") - F.col("b")).alias("difference")))


@query("st_a3_raters_under_curve")
def st3(spark, sf):
    """Raters' points against the curve of the raw agreement share of their items."""
    v = A.leave_one_out(votes(spark, sf), "item", "vote").where(F.col("others").isNotNull())
    points = S.operating_points(v.withColumn("truth", (F.col("others") >= 0.5).cast("int")), "truth", "others")
    raters = A.rates(v.groupBy("rater").agg(*A.confusion(F.col("others") >= 0.5, F.col("vote") == 1)))
    return D.under_curve(points, raters, "fpr", "tpr").select("rater", "under")
