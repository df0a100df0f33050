"""Queries of curves with all gates, their deviations and burdens, further signal operators, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import norms as N
from ..operators import signal as G
from ..registry import query
from ..sources import readers as R
from ..sources import shared
from ..sources import sinks as K
from ..streaming import jobs as J
from .norm_queries import clean
from .signal_queries import _LONG, _PSD, long
from .tables import POW, SEG, powers, rounded, segments, table

FINE = [float(a) for a in range(2, 91, 2)]
_FINE = "gr AS (SELECT CAST(unnest(range(2, 91, 2)) AS DOUBLE) AS g)"


def _curve_sql(cell: str, rows: str, width: float, reach: float) -> str:
    """Weights by value and their cumulative shares, of ``rows`` (cell, age, y)."""
    w = f"exp(-0.5 * ((age - g) / {width}) ** 2)"
    p = f"PARTITION BY {cell}, g"
    return f"""{_FINE}, cl AS ({rows}), w AS (SELECT {cell}, g, y, sum({w}) AS w, count(*) AS n FROM cl JOIN gr ON abs(age - g) <= {reach} GROUP BY ALL),
  cw AS (SELECT *, sum(w) OVER ({p}) AS total, sum(n) OVER ({p}) AS rows, sum(w) OVER ({p} ORDER BY y) AS upto FROM w)"""


def _at(q: float) -> str:
    return f"coalesce(arg_min(CASE WHEN c0 IS NULL THEN y ELSE v0 + (y - v0) * ({q} - c0) / (c - c0) END, c) FILTER (c >= {q}), max(y))"


_TRIM = """SELECT stage, age, y FROM seg JOIN (SELECT stage, quantile_cont(y, 0.002) AS lo, quantile_cont(y, 0.998) AS hi FROM seg WHERE NOT artifact GROUP BY 1 HAVING count(y) >= 50) USING (stage) WHERE NOT artifact AND y BETWEEN lo AND hi"""
#: The robust curve with its trimming and all three gates: 50 rows a cell, weight 20 a point, 10 points a cell.
_ROBUST = f"""{_curve_sql("stage", _TRIM, 5, 20)}, b AS (SELECT *, lag(c) OVER (PARTITION BY stage, g ORDER BY y) AS c0, lag(y) OVER (PARTITION BY stage, g ORDER BY y) AS v0 FROM (SELECT *, (upto - w / 2) / total AS c FROM cw WHERE total >= 20)),
  k0 AS (SELECT stage, g, {_at(0.5)} AS mu, greatest(({_at(0.75)} - {_at(0.25)}) / 1.349, 1e-6) AS sigma FROM b GROUP BY 1, 2), k AS (SELECT * FROM k0 QUALIFY count(*) OVER (PARTITION BY stage) >= 10)"""
_Z = f"""{_ROBUST}, kk AS (SELECT *, lead(g) OVER w AS g1, lead(mu) OVER w AS mu1, lead(sigma) OVER w AS s1, min(g) OVER (PARTITION BY stage) AS gmin, max(g) OVER (PARTITION BY stage) AS gmax FROM k WINDOW w AS (PARTITION BY stage ORDER BY g)),
  x AS (SELECT s.*, least(greatest(age, gmin), gmax) AS xa FROM seg s LEFT JOIN (SELECT DISTINCT stage, gmin, gmax FROM kk) USING (stage)),
  dev AS (SELECT x.eeg_id, x.segment, x.stage, x.artifact, (y - (mu + coalesce((mu1 - mu) * (xa - g) / (g1 - g), 0))) / (sigma + coalesce((s1 - sigma) * (xa - g) / (g1 - g), 0)) AS z FROM x LEFT JOIN kk ON kk.stage = x.stage AND xa >= g AND (xa < g1 OR g1 IS NULL))"""


def gated_curve(spark, sf):
    return N.robust_curve(clean(spark, sf), ["stage"], "age", "y", FINE, 5.0)


def gated_deviations(spark, sf):
    """z of each segment, of the fine curve, which is written once: it is small, and every use reads it."""
    return N.deviation(segments(spark, sf), shared.stored(gated_curve(spark, sf), "curve"), ["stage"], "age", "y")


@query("n04_gated_curves", f"WITH {SEG}, {_ROBUST} SELECT stage, g, round(mu, 5) AS mu, round(sigma, 5) AS sigma FROM k")
def n04(spark, sf):
    return rounded(gated_curve(spark, sf), 5)


@query("n11_gated_deviation", f"WITH {SEG}, {_Z} SELECT eeg_id, segment, stage, round(z, 4) AS z FROM dev")
def n11(spark, sf):
    return rounded(gated_deviations(spark, sf).select("eeg_id", "segment", "stage", "z"), 4)


@query("n14_gated_descriptors", f"""WITH {SEG}, {_Z} SELECT eeg_id, round(avg(z) FILTER (stage IN ('click', 'view')) - avg(z) FILTER (stage IN ('purchase', 'signup')), 4) AS lat_signed, round(quantile_cont(z, 0.9), 4) AS p90, round(max(z), 4) AS top FROM dev WHERE NOT artifact GROUP BY 1""")
def n14(spark, sf):
    side = lambda *s: F.avg(F.when(F.col("stage").isin(*s), F.col("z")))
    u = gated_deviations(spark, sf).where(~F.col("artifact"))
    return rounded(u.groupBy("eeg_id").agg((side("click", "view") - side("purchase", "signup")).alias("lat_signed"), F.percentile("z", F.lit(0.9)).alias("p90"), F.max("z").alias("top")), 4)


@query("a31_gated_cells", f"WITH {SEG}, {_Z} SELECT stage, CAST(eeg_id % 2 AS BIGINT) AS arm, count(z) AS n, round(avg(z), 4) AS mean, round(avg(CASE WHEN z IS NOT NULL THEN CAST(z > 1 AS DOUBLE) END), 4) AS above FROM dev WHERE NOT artifact GROUP BY ALL")
def a31(spark, sf):
    """Cells of state and arm: known deviations, their mean and the share above one."""
    z = F.col("z")
    u = gated_deviations(spark, sf).where(~F.col("artifact")).withColumn("arm", F.col("eeg_id") % 2)
    return rounded(u.groupBy("stage", "arm").agg(F.count("z").alias("n"), F.avg("z").alias("mean"), F.avg((z > 1).cast("double")).alias("above")), 4)


@query("flagship_deviation_burden", f"""WITH {SEG}, {_Z}, u AS (SELECT * FROM dev WHERE NOT artifact),
  a AS (SELECT eeg_id, avg(CAST(z > 1 AS DOUBLE)) AS prevalence, CASE WHEN count(z) > 0 THEN coalesce(quantile_cont(z, 0.5) FILTER (z > 1), 0) END AS severity, avg(CASE WHEN z IS NOT NULL THEN greatest(z - 1, 0) END) AS burden, count(z) AS known FROM u GROUP BY 1),
  f AS (SELECT eeg_id, segment, coalesce(z > 1, false) AS f, CASE WHEN coalesce(z > 1, false) AND NOT coalesce(lag(z) OVER (PARTITION BY eeg_id ORDER BY segment) > 1, false) THEN 1 ELSE 0 END AS s FROM u),
  r AS (SELECT *, sum(s) OVER (PARTITION BY eeg_id ORDER BY segment) AS run FROM f), n AS (SELECT eeg_id, max((15 + (m - 1) * 14) / 60) AS longest FROM (SELECT eeg_id, run, count(*) AS m FROM r WHERE f GROUP BY 1, 2) GROUP BY 1)
  SELECT eeg_id, round(prevalence, 4) AS prevalence, round(severity, 4) AS severity, round(burden, 4) AS burden, CASE WHEN known > 0 THEN round(coalesce(longest, 0), 4) END AS longest FROM a LEFT JOIN n USING (eeg_id)""")
def flagship(spark, sf):
    """How far, how often and how long each recording deviates from the norm of its age and state."""
    u = gated_deviations(spark, sf).where(~F.col("artifact"))
    return rounded(N.burden_profile(u, "eeg_id", "segment", "z"), 4)


@query("n03_curves_by_sex", f"""WITH {SEG}, {_curve_sql("sex, stage", "SELECT eeg_id % 2 AS sex, stage, age, y FROM seg WHERE NOT artifact", 5, 20)}, b AS (SELECT *, lag(c) OVER (PARTITION BY sex, stage, g ORDER BY y) AS c0, lag(y) OVER (PARTITION BY sex, stage, g ORDER BY y) AS v0 FROM (SELECT *, (upto - w / 2) / total AS c FROM cw))
  SELECT sex, stage, g, round({_at(0.1)}, 5) AS p10, round({_at(0.5)}, 5) AS p50, round({_at(0.9)}, 5) AS p90 FROM b GROUP BY 1, 2, 3""")
def n03(spark, sf):
    d = clean(spark, sf).withColumn("sex", F.col("eeg_id") % 2)
    return rounded(N.quantile_curve(d, ["sex", "stage"], "age", "y", FINE, 5.0, {"p10": 0.1, "p50": 0.5, "p90": 0.9}).drop("weight", "n_eff"), 5)


_N06 = _curve_sql("stage", "SELECT stage, age, y FROM seg WHERE NOT artifact", 3, "3 * sqrt(-2 * ln(1e-4))").replace("count(*) AS n FROM cl", "count(*) AS n, arg_min(exp(-0.5 * ((age - g) / 3) ** 2), age) AS first FROM cl")
_LOCAL = "coalesce(arg_min(CASE WHEN c0 IS NULL THEN y ELSE v0 + (y - v0) * least(({0} - c0) / (first / total), 1) END, c) FILTER (c >= {0}), max(y))"


@query("n06_local_quantiles", f"""WITH {SEG}, {_N06}, b AS (SELECT *, lag(c) OVER (PARTITION BY stage, g ORDER BY y) AS c0, lag(y) OVER (PARTITION BY stage, g ORDER BY y) AS v0 FROM (SELECT *, upto / total AS c FROM cw WHERE rows >= 25))
  SELECT stage, g, CAST(any_value(rows) AS BIGINT) AS rows, round({_LOCAL.format(0.25)}, 5) AS p25, round({_LOCAL.format(0.5)}, 5) AS p50 FROM b GROUP BY 1, 2""")
def n06(spark, sf):
    return rounded(N.local_quantile_curve(clean(spark, sf), ["stage"], "age", "y", FINE, 3.0, {"p25": 0.25, "p50": 0.5}), 5)


@query("n07_reference_sample", f"""WITH {SEG}, c AS (SELECT * FROM seg WHERE NOT artifact AND eeg_id % 3 <> 1), i AS (SELECT DISTINCT eeg_id FROM c QUALIFY row_number() OVER (ORDER BY md5('0|' || eeg_id), eeg_id) <= 8),
  s AS (SELECT eeg_id, segment, stage, y FROM c WHERE eeg_id IN (SELECT eeg_id FROM i) QUALIFY row_number() OVER (PARTITION BY eeg_id ORDER BY md5('0|' || segment), segment) <= 25) SELECT eeg_id, segment, stage, round(y, 6) AS y FROM s""".replace("SELECT DISTINCT eeg_id FROM c QUALIFY", "SELECT eeg_id FROM (SELECT DISTINCT eeg_id FROM c) QUALIFY"))
def n07(spark, sf):
    c = segments(spark, sf).where("NOT artifact AND eeg_id % 3 <> 1")
    return rounded(N.reference_sample(c, "eeg_id", "segment", recordings=8, per_recording=25).select("eeg_id", "segment", "stage", "y"))


@query("n07_side_differences", f"WITH {POW}, v AS (SELECT eeg_id, max(theta) FILTER (channel = 1) AS a, max(theta) FILTER (channel = 2) AS b, max(theta) FILTER (channel = 3) AS c, max(theta) FILTER (channel = 4) AS d FROM pw GROUP BY 1) SELECT eeg_id, '1|2' AS pair, round(a - b, 6) AS difference FROM v WHERE a - b IS NOT NULL UNION ALL SELECT eeg_id, '3|4', round(c - d, 6) FROM v WHERE c - d IS NOT NULL")
def n07_sides(spark, sf):
    p = powers(spark, sf).withColumn("region", F.col("channel").cast("string"))
    return rounded(N.side_differences(p, ["eeg_id"], "region", "theta", [("1", "2"), ("3", "4")]))


@query("p02_feature_logs", "WITH " + POW + " SELECT eeg_id, channel, " + ", ".join(f"round(log10({a}/({b}+1e-12)+1e-15),5) AS {a}_{b}" for a in S.BANDS for b in S.BANDS if a != b) + ", " + ", ".join(f"round({b}/(total+1e-12),6) AS rel_{b}" for b in S.BANDS) + " FROM pw")
def p02(spark, sf):
    """All rows: ratios to a power of 0 are huge, so ratios are compared as logs."""
    v = S.feature_vector({k: F.col(k) for k in [*S.BANDS, "total"]})
    ratio = {k: F.log10(c + 1e-15) for k, c in v.items() if "_" in k and not k.startswith("rel_")}
    return powers(spark, sf).select("eeg_id", "channel", *[F.round(c, 5).alias(k) for k, c in ratio.items()], *[F.round(c, 6).alias(k) for k, c in v.items() if k.startswith("rel_")])


_SIG = "sg AS (SELECT vec_id // 18 AS seg, vec_id % 18 AS channel, list_transform(embedding, lambda x: 10 * CAST(x AS DOUBLE)) AS s FROM embeddings)"


def signals(spark, sf):
    return table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 18).alias("seg"), (F.col("vec_id") % 18).alias("channel"), F.transform("embedding", lambda x: x.cast("double") * 10).alias("samples"))


@query("dsp02_filled_channels", f"""WITH {_SIG}, p AS (SELECT * FROM sg WHERE channel NOT IN (5, 11) OR seg % 3 <> 0), k AS (SELECT seg, list(channel) AS have FROM p GROUP BY 1 HAVING count(*) >= 15),
  m AS (SELECT seg, sum(a) AS total FROM (SELECT seg, i, avg(x) AS a FROM (SELECT seg, generate_subscripts(s, 1) AS i, unnest(s) AS x FROM p) GROUP BY 1, 2) GROUP BY 1)
  SELECT seg, channel, false AS filled, round(list_sum(s), 4) AS total FROM p WHERE seg IN (SELECT seg FROM k) UNION ALL SELECT seg, c, true, round(total, 4) FROM k JOIN m USING (seg), (SELECT unnest(range(18)) AS c) WHERE NOT list_contains(have, c)""")
def dsp02(spark, sf):
    present = signals(spark, sf).where("channel NOT IN (5, 11) OR seg % 3 <> 0")
    out = G.filled_channels(present, ["seg"], list(range(18)), 15)
    return rounded(out.select("seg", "channel", "filled", F.aggregate("samples", F.lit(0.0), lambda a, x: a + x).alias("total")), 4)


@query("dsp11_pair_asymmetry", f"""WITH {_PSD}, {_LONG}, q AS (SELECT seg, channel % 4 AS pair, f, max(p) FILTER (channel < 4) AS l, max(p) FILTER (channel >= 4) AS r FROM lg WHERE channel < 8 AND f >= 0.5 AND f < 25 GROUP BY ALL),
  a AS (SELECT seg, pair, avg(abs(r - l) / (r + l + 1e-12)) AS a FROM q GROUP BY 1, 2) SELECT seg, round(max(a), 6) AS q_asym, max(pair) FILTER (round(a, 9) = round(top, 9)) AS pair FROM (SELECT *, max(a) OVER (PARTITION BY seg) AS top FROM a) GROUP BY 1""")
def dsp11(spark, sf):
    return rounded(G.pair_asymmetry(long(spark, sf), ["seg"], "channel", [(k, k + 4) for k in range(4)]))


_P2P = "SELECT seg, list_max(s) - list_min(s) AS p, list_stddev_pop(s) AS sd FROM sg"


@query("dsp12_usable_segments", f"""WITH {_SIG}, {_PSD}, {_LONG}, c AS ({_P2P}), g AS (SELECT seg, avg(CAST(p < 5.2 OR sd < 0.5 AS DOUBLE)) AS share, quantile_cont(p, 0.5) AS mp, quantile_cont(sd, 0.5) AS ms, max(p) AS top FROM c GROUP BY 1),
  e AS (SELECT seg, quantile_cont(m, 0.5) AS m FROM (SELECT seg, channel, coalesce(sum(p) FILTER (f >= 20 AND f < 45), 0) / (coalesce(sum(p) FILTER (f >= 1 AND f < 45), 0) + 1e-12) AS m FROM lg GROUP BY 1, 2) GROUP BY 1),
  r AS (SELECT seg, CASE WHEN share > 0.12 OR mp < 5.2 OR ms < 0.5 THEN 'flat' WHEN top > 7.3 THEN 'high_amplitude' WHEN m > 0.58 THEN 'emg' ELSE 'ok' END AS reason FROM g JOIN e USING (seg)) SELECT seg, reason = 'ok' AS usable, reason FROM r""")
def dsp12(spark, sf):
    reasons = G.artifacts(signals(spark, sf), ["seg"], flat=5.2, high=7.3, flat_share=0.12)
    return G.usable_segments(reasons, G.muscle_share(long(spark, sf), ["seg"], "channel"), ["seg"], most=0.58)


@query("dsp15_file_class", """WITH g AS (SELECT o_custkey, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS n_canonical, count(*) FILTER (regexp_matches(o_orderpriority, '^[34]-')) AS n_contact, bool_or(o_orderpriority = '5-LOW') AS token FROM orders GROUP BY 1)
  SELECT o_custkey, n_canonical, n_contact, CASE WHEN n_canonical >= 4 AND n_contact < n_canonical THEN 'scalp' WHEN coalesce(token, false) OR (n_contact >= 6 AND n_canonical < 4) THEN 'intracranial' ELSE 'ambiguous' END AS kind FROM g""")
def dsp15(spark, sf):
    return G.file_class(table(spark, sf, "orders"), "o_custkey", "o_orderpriority", ["1-URGENT", "2-HIGH"], "^[34]-", "^5-LOW$", least=4, contacts=6)


@query("dsp16_bursts", f"""WITH {_SIG}, e AS (SELECT seg // 4 AS rec, seg, list_transform(s, lambda x: abs(x)) AS e FROM sg WHERE channel IN (2, 3)), m AS (SELECT rec, quantile_cont(x, 0.5) AS m FROM (SELECT rec, unnest(e) AS x FROM e) GROUP BY 1),
  r AS (SELECT rec, seg, list_max(list_transform(string_split(array_to_string(list_transform(e, lambda x: CASE WHEN x > 1.6 * m THEN '1' ELSE '0' END), ''), '0'), lambda t: length(t))) AS n FROM e JOIN m USING (rec))
  SELECT rec, seg, CAST(max(n) AS INT) AS longest, max(n) >= 4 AS burst FROM r GROUP BY 1, 2""")
def dsp16(spark, sf):
    """Rectified samples of two channels as envelopes; four segments are a recording."""
    e = signals(spark, sf).where("channel IN (2, 3)").select(F.floor(F.col("seg") / 4).alias("rec"), "seg", F.transform("samples", lambda x: F.abs(x)).alias("e"))
    return G.bursts(e, "rec", ["seg"], "e", 10.0, 1.6, 0.4).select("rec", "seg", "longest", "burst")


@query("dsp18_spectral_entropy", f"WITH {_PSD}, {_LONG} SELECT vec_id, round((ln(sum(p)) - sum(p * ln(p)) / sum(p)) / ln(count(*)), 5) AS entropy FROM lg WHERE f >= 0.5 AND f <= 45 AND p > 0 GROUP BY 1")
def dsp18(spark, sf):
    return rounded(G.spectral_entropy(long(spark, sf), ["vec_id"]), 5)


@query("src02_src03_csv", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_mktsegment FROM customer")
def src02(spark, sf):
    """The customers as CSV files in three folders, read back by a pattern in one scan, all text; two columns of them."""
    place = shared.new_dir(spark, "csv")
    c = table(spark, sf, "customer")
    for k in range(3):
        c.where(F.col("c_custkey") % 3 == k).write.option("header", True).csv(f"{place}/part{k}")
    return R.csv_glob(spark, f"{place}/part*", c.columns).select("c_custkey", "c_mktsegment")


@query("src05_sidecars", "SELECT DISTINCT user_id, 15 AS seconds FROM events WHERE value > 20")
def src05(spark, sf):
    """A JSON sidecar per event: markers without a length go, one stays per key, and all agree on the length."""
    place = shared.new_dir(spark, "json")
    e = table(spark, sf, "events").select("user_id", F.when(F.col("value") > 20, 15).alias("seconds"))
    e.write.json(place)
    return R.one_constant(R.sidecars(spark, place, "user_id long, seconds int", "seconds", "user_id"), "seconds")


@query("snk01_bucketed", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_totalprice END AS o_totalprice FROM orders")
def snk01(spark, sf):
    """Written by bucket, then some buckets' rows again with new values: only those buckets are replaced."""
    place = shared.new_dir(spark, "facts")
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    K.write_bucketed(o, place, "o_orderkey", 16)
    new = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, 0.0).otherwise(F.col("o_totalprice")))
    K.write_bucketed(new, place, "o_orderkey", 16)
    return spark.read.parquet(place).select("o_orderkey", "o_totalprice")


@query("snk03_incremental", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def snk03(spark, sf):
    """Two overlapping runs, the second one twice: each key's rows are there once."""
    place = shared.new_dir(spark, "increments")
    e = table(spark, sf, "events").select("event_id", "user_id")
    for name, part in (("a", e.where("user_id % 5 < 3")), ("b", e.where("user_id % 5 > 0")), ("b", e.where("user_id % 5 > 0"))):
        K.append_new(part, spark, f"{place}/data", f"{place}/ledger", "user_id", name)
    return K.appended(spark, f"{place}/data", f"{place}/ledger").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("str01_arrivals", "SELECT event_id, user_id FROM events")
def str01(spark, sf):
    """The events as a stream of files, twice: a key that has arrived is not appended again."""
    place = shared.new_dir(spark, "arrivals")
    stream = lambda: J.stream_of(spark, sf, "events.parquet").select("event_id", "user_id")
    for k in range(2):
        J.incremental(stream(), f"{place}/data", f"{place}/ledger", "event_id", f"{place}/state{k}").awaitTermination()
    return K.appended(spark, f"{place}/data", f"{place}/ledger")
