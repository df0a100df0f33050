"""Queries of joins, aggregates, windows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import epoch
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import windows as W
from ..operators.quantiles import percentiles
from ..registry import query
from .tables import POW, SEG, powers, rounded, segments, table


@query("j01_j04_label_joins", """SELECT o_orderpriority, c_mktsegment, count(*) AS n, count(l.l_orderkey) AS with_lines, round(avg(o_totalprice), 4) AS price FROM orders LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') l ON o_orderkey = l.l_orderkey GROUP BY 1, 2""")
def j01(spark, sf):
    r = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey").distinct()
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(r, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rounded(o.groupBy("o_orderpriority", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count("l_orderkey").alias("with_lines"), F.avg("o_totalprice").alias("price")), 4)


@query("j03_anti_semi", """SELECT c_mktsegment, count(*) FILTER (NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')) AS unused, count(*) FILTER (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')) AS used FROM customer GROUP BY 1""")
def j03(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    anti = c.join(o, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("unused"))
    return anti.join(c.join(o, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("used")), "c_mktsegment", "full").fillna(0)


@query("j05_ledger", """WITH s AS (SELECT l_orderkey, count(*) AS n_segments, sum(CAST(l_returnflag = 'R' AS BIGINT)) AS n_bad FROM lineitem GROUP BY 1)
  SELECT o_orderkey, n_segments, n_segments - n_bad AS n_usable, n_segments >= 3 AND (n_segments - n_bad) / n_segments >= 0.5 AS included, CASE WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'other' END AS status FROM orders LEFT JOIN s ON o_orderkey = l_orderkey""")
def j05(spark, sf):
    s = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_segments"), F.count_if(F.col("l_returnflag") == "R").alias("bad"))
    o = table(spark, sf, "orders").join(s, "o_orderkey", "left")
    usable = F.col("n_segments") - F.col("bad")
    return o.select("o_orderkey", "n_segments", usable.alias("n_usable"), ((F.col("n_segments") >= 3) & (usable / F.col("n_segments") >= 0.5)).alias("included"), F.when(F.col("o_orderstatus") == "F", "finished").otherwise("other").alias("status"))


@query("j06_full_outer", """WITH a AS (SELECT l_suppkey AS k, round(avg(l_quantity), 6) AS q FROM lineitem WHERE l_quantity > 49 GROUP BY 1), b AS (SELECT l_suppkey AS k, round(avg(l_discount), 6) AS d FROM lineitem WHERE l_tax > 0.079 GROUP BY 1) SELECT k, q, d FROM a FULL JOIN b USING (k)""")
def j06(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "k")
    a = li.where("l_quantity > 49").groupBy("k").agg(F.avg("l_quantity").alias("q"))
    return rounded(a.join(li.where("l_tax > 0.079").groupBy("k").agg(F.avg("l_discount").alias("d")), "k", "full"))


@query("j07_resolution", """WITH g AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS e, count(*) FILTER (o_orderstatus = 'F') AS d, max(o_orderkey) AS a, max(o_orderkey) FILTER (o_orderpriority = '1-URGENT') AS be, max(o_orderkey) FILTER (o_orderstatus = 'F') AS bd FROM orders GROUP BY 1)
  SELECT o_custkey, CASE WHEN n = 1 THEN a WHEN e = 1 THEN be WHEN e = 0 AND d = 1 THEN bd END AS o_orderkey, CASE WHEN n = 1 THEN 'single' WHEN e = 1 THEN 'exact' WHEN e = 0 AND d = 1 THEN 'day' WHEN e > 1 OR d > 1 THEN 'ambiguous' ELSE 'no_match' END AS reason FROM g""")
def j07(spark, sf):
    return J.resolved(table(spark, sf, "orders"), "o_custkey", F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "F", "o_orderkey")


_BRIDGE = "br AS (SELECT unnest(['A', 'A', 'A', 'B', 'B', 'B', 'W', 'W', 'W', 'W', 'W', 'W', 'W']) AS region, unnest([1, 2, 3, 4, 5, 6, 1, 2, 3, 4, 5, 6, 7]) AS channel)"


def bridge(spark):
    rows = [("A", c) for c in (1, 2, 3)] + [("B", c) for c in (4, 5, 6)] + [("W", c) for c in range(1, 8)]
    return spark.createDataFrame(rows, "region string, channel long")


@query("j08_a02_regions", f"WITH {POW}, {_BRIDGE} SELECT eeg_id, region, round(avg(delta), 8) AS delta, round(avg(theta), 8) AS theta FROM pw JOIN br USING (channel) GROUP BY 1, 2")
def j08(spark, sf):
    return rounded(A.by_region(powers(spark, sf), bridge(spark), ["eeg_id"], ["delta", "theta"]), 8)


@query("j14_a04_asymmetry", f"WITH {POW}, {_BRIDGE}, r AS (SELECT eeg_id, region, avg(delta) AS v FROM pw JOIN br USING (channel) GROUP BY 1, 2) SELECT eeg_id, round(ln((max(v) FILTER (region = 'A') + 1e-12)/(max(v) FILTER (region = 'B') + 1e-12)), 6) AS asym FROM r GROUP BY 1")
def j14(spark, sf):
    r = A.by_region(powers(spark, sf), bridge(spark), ["eeg_id"], ["delta"]).withColumn("delta", F.log(F.col("delta") + 1e-12))
    return rounded(J.bridge_pairs(r, ["eeg_id"], "region", "A", "B", "delta").withColumnRenamed("difference", "asym"))


@query("j09_interval_majority", """WITH p AS (SELECT user_id, CAST(epoch(ts) AS DOUBLE) - 1 AS a, CAST(epoch(ts) AS DOUBLE) + 7200 AS b, event_id FROM events WHERE event_type = 'signup'),
  h AS (SELECT p.user_id, p.event_id, e.event_type, count(*) AS n FROM p JOIN events e ON e.user_id = p.user_id AND epoch(e.ts) >= a AND epoch(e.ts) < b WHERE e.event_type <> 'signup' GROUP BY ALL),
  m AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY user_id, event_id ORDER BY n DESC, event_type) = 1) SELECT p.event_id, m.event_type AS state FROM p LEFT JOIN m USING (event_id)""")
def j09(spark, sf):
    e = table(spark, sf, "events").withColumn("at", epoch(F.col("ts")))
    seg = e.where("event_type = 'signup'").select("user_id", "event_id", (F.col("at") - 1 + F.col("event_id") * 0).alias("a"), (F.col("at") + 7200).alias("b"))
    lab = e.where("event_type <> 'signup'").select("user_id", "at", F.col("event_type").alias("state"))
    return J.majority_state(seg, lab, "user_id", "a", "b", "at", "state", 3600.0).select("event_id", "state").dropDuplicates(["event_id"])


@query("j10_point_in_window", f"WITH {SEG} SELECT s.eeg_id, s.segment, coalesce(w.stage, 'none') AS state FROM seg s LEFT JOIN seg w ON w.eeg_id = s.eeg_id AND w.segment = CAST(floor((s.segment * 14 + 7.5) / 20) AS BIGINT)")
def j10(spark, sf):
    s = segments(spark, sf)
    lab = s.select("eeg_id", F.col("segment").alias("idx"), F.col("stage").alias("state"))
    return J.state_at_centre(s.select("eeg_id", "segment"), lab, "eeg_id", F.col("segment") * 14 + 7.5, "idx", "state", 20.0, "none")


@query("j11_nearest", """WITH a AS (SELECT user_id, event_id, epoch(ts) AS t FROM events WHERE event_type = 'purchase'), b AS (SELECT user_id, event_id AS rid, epoch(ts) AS t FROM events WHERE event_type = 'error')
  SELECT event_id, rid AS report_id, CAST(round(gap, 3) AS DOUBLE) AS gap FROM (SELECT a.event_id, b.rid, abs(a.t - b.t) AS gap FROM a JOIN b USING (user_id)) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY gap, rid) = 1""")
def j11(spark, sf):
    e = table(spark, sf, "events")
    b = e.where("event_type = 'error'").select("user_id", F.col("ts").alias("rts"), F.col("event_id").alias("report_id"))
    return rounded(J.nearest(e.where("event_type = 'purchase'"), b, "user_id", "ts", "rts", "event_id", "report_id"), 3)


@query("j12_ownership", """WITH p AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS d, abs(o_totalprice - 100000) AS gap FROM orders),
  f AS (SELECT *, first_value(d) OVER (PARTITION BY o_custkey ORDER BY gap, d) AS owner FROM p), n AS (SELECT o_custkey, count(DISTINCT d) AS dates FROM p GROUP BY 1) SELECT o_orderkey, dates, d = owner AS clean FROM f JOIN n USING (o_custkey)""")
def j12(spark, sf):
    p = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("d"), F.abs(F.col("o_totalprice") - 100000).alias("gap"))
    return J.owned(p, "o_custkey", "d", "gap").select("o_orderkey", "dates", "clean")


@query("j13_interpolation", """WITH g AS (SELECT CAST(p_size AS DOUBLE) AS g, avg(p_retailprice) AS v FROM part WHERE p_size % 5 = 0 GROUP BY 1),
  x AS (SELECT l_orderkey, l_linenumber, l_quantity AS x FROM lineitem),
  b AS (SELECT g AS g0, v AS v0, lead(g) OVER (ORDER BY g) AS g1, lead(v) OVER (ORDER BY g) AS v1 FROM g)
  SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(CASE WHEN x < (SELECT min(g) FROM g) THEN (SELECT arg_min(v, g) FROM g) WHEN x >= (SELECT max(g) FROM g) THEN (SELECT arg_max(v, g) FROM g) ELSE v0 + (v1 - v0) * (x - g0) / (g1 - g0) END, 4) AS v FROM x LEFT JOIN b ON x >= g0 AND x < g1""")
def j13(spark, sf):
    curve = table(spark, sf, "part").where("p_size % 5 = 0").groupBy(F.lit(1).alias("cell"), F.col("p_size").cast("double").alias("g")).agg(F.avg("p_retailprice").alias("v"))
    x = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("l_quantity").alias("x"), F.lit(1).alias("cell"))
    return rounded(J.interpolated(x, curve, ["cell"], "x", "g", "v").select("l_orderkey", "l_linenumber", "v"), 4)


@query("j15_j16_matching", """WITH q AS (SELECT o_orderpriority AS s, count(*) AS quota FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000 GROUP BY 1),
  r AS (SELECT o_orderkey, o_orderpriority AS s, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('0' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS k FROM orders WHERE o_orderstatus <> 'F') SELECT o_orderkey, s FROM r JOIN q USING (s) WHERE k <= quota""")
def j15(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("s"), "o_orderstatus", "o_totalprice")
    return J.quota_match(o.where("o_orderstatus <> 'F'"), o.where("o_orderstatus = 'F' AND o_totalprice > 200000"), "s", "o_orderkey").select("o_orderkey", "s")


@query("j20_a14_birth_dates", """WITH b AS (SELECT o_custkey, quantile_cont(epoch(o_orderdate) - o_totalprice * 10, 0.5) AS dob FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT o_orderkey, round((epoch(o_orderdate) - dob) / 31557600, 6) AS age FROM orders LEFT JOIN b USING (o_custkey)""")
def j20(spark, sf):
    o = table(spark, sf, "orders").withColumn("t", epoch(F.col("o_orderdate")))
    dob = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(A.median(F.col("t") - F.col("o_totalprice") * 10).alias("dob"))
    return rounded(o.join(dob, "o_custkey", "left").select("o_orderkey", ((F.col("t") - F.col("dob")) / 31557600).alias("age")))


_EXAMS = "ex AS (SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN o_orderstatus <> 'O' THEN floor(o_totalprice) / 5000 END AS age FROM orders)"
_BIRTHS = "bd AS (SELECT o_custkey, quantile_cont(b, 0.5) AS birth, count(*) AS exams, (max(b) - min(b)) / 86400 AS spread_days FROM (SELECT o_custkey, epoch(o_orderdate) - age * 31557600 AS b FROM ex WHERE age IS NOT NULL) GROUP BY 1)"


def exams(spark, sf):
    age = F.when(F.col("o_orderstatus") != "O", F.floor("o_totalprice") / 5000)
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", age.alias("age"))


@query("a14_birth_dates", f"WITH {_EXAMS}, {_BIRTHS} SELECT o_custkey, round(birth, 5) AS birth, exams, round(spread_days, 5) AS spread_days FROM bd")
def a14(spark, sf):
    return rounded(A.birth_dates(exams(spark, sf), "o_custkey", "o_orderdate", "age"), 5)


@query("a14_recovered_ages", f"WITH {_EXAMS}, {_BIRTHS} SELECT o_orderkey, round(coalesce(age, (epoch(o_orderdate) - birth) / 31557600), 6) AS recovered_age FROM ex LEFT JOIN bd USING (o_custkey)")
def a14_ages(spark, sf):
    return rounded(A.recovered_ages(exams(spark, sf), "o_custkey", "o_orderdate", "age").select("o_orderkey", "recovered_age"))


@query("a03_a05_medians", f"WITH {POW}, {_BRIDGE} SELECT stage, region, round(quantile_cont(delta, 0.5), 6) AS delta, round(quantile_cont(theta, 0.5), 6) AS theta, count(*) AS n FROM pw JOIN br USING (channel) GROUP BY 1, 2")
def a03(spark, sf):
    return rounded(powers(spark, sf).join(F.broadcast(bridge(spark)), "channel").groupBy("stage", "region").agg(A.median("delta").alias("delta"), A.median("theta").alias("theta"), F.count(F.lit(1)).alias("n")))


@query("a06_recording_summary", f"""WITH {SEG} SELECT eeg_id, count(*) AS n, count(*) FILTER (NOT artifact) AS n_usable, round(avg(CAST(artifact AS DOUBLE)), 6) AS frac_artifact, CAST(max(segment) * 14 + 15 AS BIGINT) AS seconds, round(avg(CAST(stage = 'click' AS DOUBLE)), 6) AS click_share, round(avg(value) FILTER (NOT artifact), 6) AS mean FROM seg GROUP BY 1""")
def a06(spark, sf):
    s = segments(spark, sf)
    share = A.composition(s, "stage", ["eeg_id"]).select("eeg_id", F.coalesce(F.element_at("fractions", F.lit("click")), F.lit(0.0)).alias("click_share"))
    g = s.groupBy("eeg_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("artifact")).alias("n_usable"), F.avg(F.col("artifact").cast("double")).alias("frac_artifact"), (F.max("segment") * 14 + 15).alias("seconds"), F.avg(F.when(~F.col("artifact"), F.col("value"))).alias("mean"))
    return rounded(g.join(share, "eeg_id"))


@query("a07_burden", f"""WITH {SEG} SELECT eeg_id, round(sum(age * CAST(y > 4 AS DOUBLE)) / sum(age), 6) AS prevalence, round(coalesce(quantile_cont(CASE WHEN y > 4 THEN y END, 0.5), 0), 6) AS severity, round(avg(greatest(y - 4, 0)), 6) AS burden FROM seg GROUP BY 1""")
def a07(spark, sf):
    y = F.col("y")
    return rounded(segments(spark, sf).groupBy("eeg_id").agg(A.prevalence(y, 4.0, F.col("age")).alias("prevalence"), A.severity(y, 4.0).alias("severity"), A.burden(y, 4.0).alias("burden")))


@query("a08_a09_amounts", f"""WITH {SEG} SELECT eeg_id, stage, round(quantile_cont(y, 0.9), 6) AS y_p90, round(avg(y), 6) AS y_mean, round(avg(CAST(y > 1.5 AS DOUBLE)), 6) AS y_share, round(max(y), 6) AS y_max FROM seg GROUP BY 1, 2 HAVING count(*) >= 3""")
def a08(spark, sf):
    return rounded(segments(spark, sf).groupBy("eeg_id", "stage").agg(*A.amounts("y"), F.count(F.lit(1)).alias("c")).where("c >= 3").drop("c"))


@query("a10_threshold_grid", f"""WITH {SEG}, t AS (SELECT CAST(unnest([1, 1.5, 2, 2.5, 3, 3.5, 4, 4.5, 5]) AS DOUBLE) AS threshold) SELECT eeg_id, threshold, round(avg(CAST(y > threshold AS DOUBLE)), 6) AS prev, round(coalesce(quantile_cont(CASE WHEN y > threshold THEN y END, 0.5), 0), 6) AS sev FROM seg, t GROUP BY 1, 2""")
def a10(spark, sf):
    return rounded(A.threshold_grid(segments(spark, sf), ["eeg_id"], "y", [1, 1.5, 2, 2.5, 3, 3.5, 4, 4.5, 5]))


@query("a12_a13_peaks", f"""WITH {POW}, p AS (SELECT eeg_id, arg_max(channel, struct_pack(d := delta, c := -channel)) AS peak, max(delta) AS top FROM pw GROUP BY 1) SELECT peak, count(*) AS n, round(max(top), 6) AS top FROM p GROUP BY 1""")
def a12(spark, sf):
    p = powers(spark, sf).groupBy("eeg_id").agg(F.max_by("channel", F.struct("delta", -F.col("channel"))).alias("peak"), F.max("delta").alias("top"))
    return rounded(p.groupBy("peak").agg(F.count(F.lit(1)).alias("n"), F.max("top").alias("top")))


@query("a13_w20_modal_share", f"""WITH {POW}, p AS (SELECT eeg_id, arg_max(channel, struct_pack(d := delta, c := -channel)) AS peak FROM pw GROUP BY 1), c AS (SELECT eeg_id % 100 AS recording, peak, count(*) AS n FROM p GROUP BY 1, 2)
  SELECT recording, CAST(sum(n) AS BIGINT) AS n, round(max(n) / sum(n), 6) AS share FROM c GROUP BY 1""")
def a13(spark, sf):
    """Orders as the segments of a recording: the share of them whose peak channel is the recording's modal one."""
    p = powers(spark, sf).groupBy("eeg_id").agg(F.max_by("channel", F.struct("delta", -F.col("channel"))).alias("peak"))
    return rounded(A.modal_share(p.withColumn("recording", F.col("eeg_id") % 100), ["recording"], "peak"))


@query("a15_a19_strata", """SELECT o_orderpriority, o_orderstatus, count(DISTINCT o_custkey) AS patients, count(*) AS n FROM orders GROUP BY 1, 2""")
def a15(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count_distinct("o_custkey").alias("patients"), F.count(F.lit(1)).alias("n"))


@query("a16_table_one", """WITH s AS (SELECT unnest(['all'] || CASE WHEN o_orderstatus = 'F' THEN ['finished'] ELSE [] END || CASE WHEN o_totalprice > 150000 THEN ['large'] ELSE [] END) AS stratum, o_totalprice AS x, o_orderpriority = '1-URGENT' AS u FROM orders)
  SELECT stratum, count(*) AS n, round(quantile_cont(x, 0.5), 4) AS median, round(quantile_cont(x, 0.25), 4) AS q1, round(quantile_cont(x, 0.75), 4) AS q3, round(100 * avg(CAST(u AS DOUBLE)), 4) AS urgent FROM s GROUP BY 1""")
def a16(spark, sf):
    strata = F.array_compact(F.array(F.lit("all"), F.when(F.col("o_orderstatus") == "F", "finished"), F.when(F.col("o_totalprice") > 150000, "large")))
    o = table(spark, sf, "orders").withColumn("stratum", F.explode(strata))
    shares = o.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), (100 * F.avg((F.col("o_orderpriority") == "1-URGENT").cast("double"))).alias("urgent"))
    q = percentiles(o, ["stratum"], "o_totalprice", {"median": 0.5, "q1": 0.25, "q3": 0.75}).drop("n")
    return rounded(shares.join(q.hint("merge"), "stratum", "left").select("stratum", "n", "median", "q1", "q3", "urgent"), 4)


@query("a18_crosstab", """SELECT o_orderpriority, o_orderstatus, count(*) AS n, CAST(grouping(o_orderpriority) * 2 + grouping(o_orderstatus) AS BIGINT) AS margin FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)""")
def a18(spark, sf):
    return A.crosstab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")


_VOTE = "v AS (SELECT l_partkey AS item, l_suppkey % 18 AS rater, max(CAST(l_returnflag = 'R' AS INTEGER)) AS vote FROM lineitem GROUP BY 1, 2)"


def votes(spark, sf):
    """Vote matrix in long form: OR over reads; a rater who never read an item has no row."""
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("item"), (F.col("l_suppkey") % 18).alias("rater")).agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("vote"))


@query("a21_a22_majority", f"WITH {_VOTE} SELECT item, count(*) AS raters, round(avg(vote), 6) AS share, avg(vote) > 0.5 AS majority FROM v GROUP BY 1")
def a21(spark, sf):
    return rounded(votes(spark, sf).groupBy("item").agg(F.count(F.lit(1)).alias("raters"), F.avg("vote").alias("share"), (F.avg("vote") > 0.5).alias("majority")))


@query("a23_a24_rater_points", f"""WITH {_VOTE}, o AS (SELECT *, CASE WHEN count(vote) OVER w > 1 THEN (sum(vote) OVER w - vote) / (count(vote) OVER w - 1) END AS others FROM v WINDOW w AS (PARTITION BY item)),
  c AS (SELECT rater, count(*) FILTER (others >= 0.5 AND vote = 1) AS tp, count(*) FILTER (others < 0.5 AND vote = 1) AS fp, count(*) FILTER (others >= 0.5 AND vote = 0) AS fn, count(*) FILTER (others < 0.5 AND vote = 0) AS tn FROM o GROUP BY 1)
  SELECT *, round(tp / (tp + fn), 6) AS tpr, round(fp / (fp + tn), 6) AS fpr, round(tp / (tp + fp), 6) AS precision FROM c""")
def a23(spark, sf):
    v = A.leave_one_out(votes(spark, sf), "item", "vote").where(F.col("others").isNotNull())
    return rounded(A.rates(v.groupBy("rater").agg(*A.confusion(F.col("others") >= 0.5, F.col("vote") == 1))))


@query("a27_a29_group_calibration", f"""WITH {SEG} SELECT stage, CAST(floor(age / 30) AS BIGINT) AS grp, round(quantile_cont(y, 0.25), 6) AS q1, round(quantile_cont(y, 0.5), 6) AS q2, round(quantile_cont(y, 0.75), 6) AS q3, round(quantile_cont(y, 0.95), 6) AS p95, count(*) AS n FROM seg GROUP BY 1, 2""")
def a29(spark, sf):
    q = lambda p: F.percentile("y", F.lit(p))
    return rounded(segments(spark, sf).groupBy("stage", F.floor(F.col("age") / 30).alias("grp")).agg(q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"), q(0.95).alias("p95"), F.count(F.lit(1)).alias("n")))


@query("a33_a34_concordance", """SELECT o_orderstatus, count(*) AS n, round(avg(CAST(o_orderpriority = pr AS DOUBLE)), 6) AS agree FROM orders JOIN (SELECT c_custkey, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][c_custkey % 5 + 1] AS pr FROM customer) ON o_custkey = c_custkey GROUP BY 1""")
def a33(spark, sf):
    pr = F.element_at(F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rounded(o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("o_orderpriority") == pr).cast("double")).alias("agree")))


@query("a36_histogram", f"WITH {SEG} SELECT stage, CAST(least(greatest(floor(y * 4), 0), 24) AS BIGINT) AS bin, count(*) AS n FROM seg GROUP BY 1, 2")
def a36(spark, sf):
    return segments(spark, sf).groupBy("stage", F.least(F.greatest(F.floor(F.col("y") * 4), F.lit(0)), F.lit(24)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


_RUNS = """f AS (SELECT eeg_id, segment, y > 4 AS f FROM seg), s AS (SELECT *, CASE WHEN f AND NOT coalesce(lag(f) OVER (PARTITION BY eeg_id ORDER BY segment), false) THEN 1 ELSE 0 END AS s FROM f),
  r AS (SELECT *, sum(s) OVER (PARTITION BY eeg_id ORDER BY segment) AS run FROM s), n AS (SELECT eeg_id, run, (15 + (count(*) - 1) * 14) / 60 AS m FROM r WHERE f GROUP BY 1, 2)"""


@query("w01_persistence", f"WITH {SEG}, {_RUNS} SELECT eeg_id, coalesce(round(max(m), 6), 0) AS longest, count(m) AS episodes, coalesce(round(quantile_cont(m, 0.5), 6), 0) AS median FROM (SELECT DISTINCT eeg_id FROM seg) LEFT JOIN n USING (eeg_id) GROUP BY 1")
def w01(spark, sf):
    return rounded(W.persistence(segments(spark, sf), "eeg_id", "segment", F.col("y") > 4))


@query("w02_run_flags", f"""WITH {SEG}, s AS (SELECT eeg_id, segment, stage, CASE WHEN lag(stage) OVER w = stage AND lag(segment) OVER w + 1 = segment THEN 0 ELSE 1 END AS s FROM seg WHERE NOT artifact WINDOW w AS (PARTITION BY eeg_id ORDER BY segment)),
  r AS (SELECT *, sum(s) OVER (PARTITION BY eeg_id ORDER BY segment) AS run FROM s) SELECT eeg_id, segment, count(*) OVER (PARTITION BY eeg_id, run) >= 2 AS in_run FROM r""")
def w02(spark, sf):
    return W.run_flags(segments(spark, sf).where(~F.col("artifact")), "eeg_id", "segment", "stage", 2).select("eeg_id", "segment", "in_run")


@query("w03_w06_dedupe", """SELECT o_custkey, o_orderkey, n FROM (SELECT *, count(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey) AS n FROM orders) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""")
def w03(spark, sf):
    from pyspark.sql import Window

    o = table(spark, sf, "orders").withColumn("n", F.size(F.collect_set("o_orderpriority").over(Window.partitionBy("o_custkey"))).cast("long"))
    return W.first_by(o, ["o_custkey"], F.desc("o_totalprice"), "o_orderkey").select("o_custkey", "o_orderkey", "n")


@query("w07_top_k_mean", f"WITH {SEG} SELECT eeg_id, round(avg(y), 6) AS top_mean FROM (SELECT eeg_id, y FROM seg QUALIFY row_number() OVER (PARTITION BY eeg_id ORDER BY y DESC, segment) <= 5) GROUP BY 1")
def w07(spark, sf):
    return rounded(W.top_mean(segments(spark, sf), ["eeg_id"], "y", "segment", 5))


@query("w08_best_segment", f"WITH {SEG} SELECT eeg_id, segment, stage FROM seg QUALIFY row_number() OVER (PARTITION BY eeg_id ORDER BY CASE WHEN stage = 'click' THEN 0 ELSE 1 END, y DESC, segment) = 1")
def w08(spark, sf):
    return W.first_by(segments(spark, sf), ["eeg_id"], F.when(F.col("stage") == "click", 0).otherwise(1), F.desc("y"), "segment").select("eeg_id", "segment", "stage")


@query("w09_stratified_cap", f"WITH {SEG} SELECT eeg_id, stage, segment FROM seg QUALIFY row_number() OVER (PARTITION BY eeg_id, stage ORDER BY md5('0|' || CAST(eeg_id AS VARCHAR) || '|' || CAST(segment AS VARCHAR)), eeg_id, segment) <= 4")
def w09(spark, sf):
    return W.capped(segments(spark, sf), ["eeg_id", "stage"], ["eeg_id", "segment"], 4).select("eeg_id", "stage", "segment")


@query("w10_proportional_sample", """WITH q AS (SELECT c_mktsegment, round(count(*) * 200 / (SELECT count(*) FROM customer)) AS quota FROM customer GROUP BY 1),
  r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('0|' || CAST(c_custkey AS VARCHAR)), c_custkey) AS k FROM customer) SELECT c_custkey, c_mktsegment FROM r JOIN q USING (c_mktsegment) WHERE k <= quota""")
def w10(spark, sf):
    return W.proportional_sample(table(spark, sf, "customer"), "c_mktsegment", "c_custkey", 200).select("c_custkey", "c_mktsegment")


@query("w11_deficit_fill", """WITH h AS (SELECT o_orderpriority, o_orderstatus, count(*) AS have FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1, 2),
  r AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY md5('0|' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS k FROM orders WHERE o_orderkey % 3 <> 0)
  SELECT o_orderkey FROM r LEFT JOIN h USING (o_orderpriority, o_orderstatus) WHERE k <= 400 - coalesce(have, 0)""")
def w11(spark, sf):
    o = table(spark, sf, "orders")
    return W.deficit_fill(o.where("o_orderkey % 3 = 0"), o.where("o_orderkey % 3 <> 0"), ["o_orderpriority", "o_orderstatus"], "o_orderkey", 400).select("o_orderkey")


@query("w12_interleave", """SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('0|' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS turn FROM orders""")
def w12(spark, sf):
    return W.interleaved(table(spark, sf, "orders"), "o_orderpriority", "o_orderkey").select("o_orderkey", "o_orderpriority", "turn")


@query("w13_patient_split", """WITH o AS (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS s FROM orders GROUP BY 1), p AS (SELECT o_custkey, CASE WHEN percent_rank() OVER (PARTITION BY s ORDER BY md5('0|' || CAST(o_custkey AS VARCHAR)), o_custkey) < 0.3 THEN 'test' ELSE 'train' END AS split FROM o)
  SELECT o_orderkey, split FROM orders JOIN p USING (o_custkey)""")
def w13(spark, sf):
    return W.patient_split(table(spark, sf, "orders"), "o_custkey", "o_orderpriority", "o_orderkey").select("o_orderkey", "split")


@query("w17_sliding_variance", f"""WITH {SEG}, p AS (SELECT eeg_id, segment // 3 AS sec, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM seg GROUP BY 1, 2) SELECT eeg_id, sec, round(ln(greatest(sum(q) OVER w / sum(n) OVER w - (sum(s) OVER w / sum(n) OVER w) ** 2, 0) + 1e-12), 4) AS log_var FROM p WINDOW w AS (PARTITION BY eeg_id ORDER BY sec ROWS 14 PRECEDING)""")
def w17(spark, sf):
    p = segments(spark, sf).groupBy("eeg_id", F.floor(F.col("segment") / 3).alias("sec")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
    return rounded(W.sliding_variance(p, "eeg_id", "sec", "n", "s", "q", 15).select("eeg_id", "sec", "log_var"), 4)


@query("w19_w20_peak_dominance", f"""WITH {POW}, g AS (SELECT eeg_id, round(max(delta) - quantile_cont(delta, 0.5), 6) AS excess, round(min(delta), 6) AS low, round(avg(CAST(delta > 25 AS DOUBLE)), 6) AS extent FROM pw GROUP BY 1) SELECT * FROM g""")
def w19(spark, sf):
    d = F.col("delta")
    return rounded(powers(spark, sf).groupBy("eeg_id").agg((F.max(d) - A.median("delta")).alias("excess"), F.min(d).alias("low"), F.avg((d > 25).cast("double")).alias("extent")))


@query("set01_set04", """WITH u AS (SELECT o_orderkey, o_custkey, 0 AS part FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_custkey, 1 FROM orders WHERE o_totalprice > 100000) SELECT o_custkey, o_orderkey FROM u WHERE NOT starts_with(CAST(o_custkey AS VARCHAR), '7') QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY part, o_orderkey) = 1""")
def set01(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    out = W.union_first([o.where("o_orderstatus = 'F'").drop("o_totalprice"), o.where("o_totalprice > 100000").drop("o_orderstatus")], "o_custkey", "o_orderkey")
    return out.where(~F.col("o_custkey").cast("string").startswith("7")).select("o_custkey", "o_orderkey")
