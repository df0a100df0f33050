"""Queries of filters, envelopes, offsets, parametric curves, chosen thresholds, conditional fits and recording heads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import filters
from ..operators import joins as J
from ..operators import learning as L
from ..operators import norms as N
from ..operators import signal as G
from ..operators import stats as S
from ..registry import ORACLES, query
from ..sources import shared
from .curve_queries import _FINE, _SIG, _Z, FINE, gated_deviations, signals
from .norm_queries import labelled
from .tables import SEG, rounded, segments, table

FS = 64.0


@query("dsp04_cleaned_signals")
def dsp04(spark, sf):
    """Signals of 128 Hz without drift and line noise: size, sum and the sum of sizes of steps."""
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("samples"))
    x = filters.cleaned(e, ["vec_id"], "samples", 128.0)
    return rounded(x.select("vec_id", F.aggregate("samples", F.lit(0.0), lambda a, v: a + v).alias("total"), F.aggregate("samples", F.lit(0.0), lambda a, v: a + v * v).alias("energy"), G.line_length(F.col("samples")).alias("line_length")))


@query("dsp16_sigma_bursts")
def dsp16(spark, sf):
    """Envelopes of 11 to 16 Hz of two channels, written once; four segments are a recording."""
    s = signals(spark, sf).where("channel IN (2, 3)").withColumn("rec", F.floor(F.col("seg") / 4))
    e = shared.stored(filters.band_envelope(s, ["rec", "seg", "channel"], "samples", FS, 11.0, 16.0), "envelopes")
    return G.bursts(e, "rec", ["seg"], "samples", FS, factor=1.5, seconds=0.15)


_SERIES = """sr AS (SELECT vec_id // 18 AS seg, list_transform(flatten(list(embedding ORDER BY vec_id)), lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings GROUP BY 1 HAVING count(*) = 18),
  pf AS (SELECT seg, x, list_transform(range(18), lambda k: x[seg * 37 % 200 + 14 * k + 1] + 0.02 * x[k + 1]) AS p, list_transform(range(18), lambda k: list_avg(x[seg * 37 % 200 + 14 * k + 1:seg * 37 % 200 + 14 * k + 15])) AS st FROM sr)"""


@query("dsp17_offsets", f"""WITH {_SERIES}, xs AS (SELECT seg, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS v FROM pf), ks AS (SELECT seg, generate_subscripts(p, 1) - 1 AS k, unnest(p) AS p FROM pf),
  ps AS (SELECT seg, k, (p - avg(p) OVER (PARTITION BY seg)) / (stddev_pop(p) OVER (PARTITION BY seg) + 1e-9) AS z FROM ks),
  sc AS (SELECT seg, i - 14 * k AS "at", round(sum(v * z) / 18 / (sqrt(greatest(sum(v * v) / 18 - (sum(v) / 18) ** 2, 0)) + 1e-9), 9) AS r FROM xs JOIN ps USING (seg) WHERE i - 14 * k BETWEEN 0 AND 913 GROUP BY 1, 2),
  p1 AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY seg ORDER BY r DESC, "at") = 1), p2 AS (SELECT sc.* FROM sc JOIN p1 USING (seg) WHERE abs(sc."at" - p1."at") > 30 QUALIFY row_number() OVER (PARTITION BY seg ORDER BY sc.r DESC, sc."at") = 1),
  p3 AS (SELECT sc.* FROM sc JOIN p1 USING (seg) JOIN p2 USING (seg) WHERE abs(sc."at" - p1."at") > 30 AND abs(sc."at" - p2."at") > 30 QUALIFY row_number() OVER (PARTITION BY seg ORDER BY sc.r DESC, sc."at") = 1),
  c AS (SELECT *, 0 AS place FROM p1 UNION ALL SELECT *, 1 FROM p2 UNION ALL SELECT *, 2 FROM p3)
  SELECT seg, place, "at", round(r, 6) AS r, coalesce(CASE WHEN "at" + 253 <= 1152 THEN list_max(list_transform(range(18), lambda k: abs(list_avg(x[c."at" + 14 * k + 1:c."at" + 14 * k + 15]) - st[k + 1]))) END < 1e-6, false) AS verified FROM c JOIN pf USING (seg)""")
def dsp17(spark, sf):
    """Eighteen channels in a row as one series; its profile is taken from a known offset and disturbed, the stored means of
    segments are those of that offset."""
    e = table(spark, sf, "embeddings").groupBy(F.floor(F.col("vec_id") / 18).alias("seg")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("c")).where(F.size("c") == 18)
    e = e.withColumn("x", F.transform(F.flatten(F.col("c.embedding")), lambda v: v.cast("double"))).withColumn("t0", (F.col("seg") * 37 % 200).cast("int"))
    k = F.sequence(F.lit(0), F.lit(17))
    e = e.select("seg", "x", F.transform(k, lambda i: F.get("x", F.col("t0") + i * 14) + F.get("x", i) * 0.02).alias("p"), F.transform(k, lambda i: F.aggregate(F.slice("x", F.col("t0") + i * 14 + 1, 15), F.lit(0.0), lambda a, v: a + v) / 15).alias("stored"))
    found = G.candidate_offsets(e, ["seg"], "x", "p", 14, top=3)
    out = found.join(e.select("seg", "x", "stored").hint("merge"), "seg")
    return rounded(out.select("seg", "place", F.col("at").cast("long").alias("at"), "r", F.coalesce(G.offset_mismatch(F.col("x"), F.col("stored"), F.col("at"), 14, 15) < 1e-6, F.lit(False)).alias("verified")))



@query("dsp18_complexity_rhythm", f"""WITH d AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS s FROM embeddings), t AS (SELECT vec_id, s, list_transform(range(2, 65), lambda i: s[i] - s[i - 1]) AS u FROM d), t2 AS (SELECT *, list_transform(range(2, 64), lambda i: u[i] - u[i - 1]) AS v, list_transform(s, lambda x: x - list_avg(s)) AS c FROM t),
  l AS (SELECT vec_id, lag, r FROM (SELECT vec_id, c, unnest(range(4, 21)) AS lag FROM t2), LATERAL (SELECT list_sum(list_transform(range(1, 65 - lag), lambda i: c[i] * c[i + lag])) / (list_sum(list_transform(c, lambda x: x * x)) + 1e-12) AS r)), b AS (SELECT vec_id, lag, r FROM l QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY r DESC, lag) = 1)
  SELECT vec_id, round(list_stddev_pop(v) / (list_stddev_pop(u) + 1e-12) / (list_stddev_pop(u) / (list_stddev_pop(s) + 1e-12) + 1e-12), 5) AS complexity, round(len(list_filter(s, lambda x: abs(x) > 0.1)) / 64, 5) AS duty, round(r, 5) AS rhythmicity, CAST(lag AS INTEGER) AS lag FROM t2 JOIN b USING (vec_id)""")
def dsp18(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("s"))
    return rounded(G.rhythmicity(e, "s", 4, 20).select("vec_id", G.complexity(F.col("s")).alias("complexity"), G.duty_cycle(F.col("s"), 0.1).alias("duty"), "rhythmicity", "lag"), 5)


@query("dsp18_cycles", """WITH d AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS s FROM embeddings), c AS (SELECT vec_id, s, list_transform(s, lambda x: x - list_avg(s)) AS c FROM d),
  u AS (SELECT *, list_filter(range(2, len(c) + 1), lambda i: c[i - 1] < 0 AND c[i] >= 0) AS u FROM c), y AS (SELECT *, list_transform(range(1, len(u)), lambda k: c[u[k]:u[k + 1] - 1]) AS y FROM u),
  p AS (SELECT *, list_transform(y, lambda v: CAST(len(v) AS DOUBLE)) AS p, list_transform(y, lambda v: list_max(v) - list_min(v)) AS r FROM y), m AS (SELECT *, list_aggregate(p, 'quantile_cont', 0.5) AS mp, list_aggregate(r, 'quantile_cont', 0.5) AS mr FROM p),
  f AS (SELECT *, list_transform(range(1, len(p) + 1), lambda i: CASE WHEN abs(p[i] - mp) <= 0.25 * mp AND abs(r[i] - mr) <= 0.25 * mr THEN '1' ELSE '0' END) AS f FROM m)
  SELECT vec_id, round(sqrt(list_sum(list_transform(s, lambda x: x * x)) / len(s)), 6) AS rms, round(list_aggregate(s, 'quantile_cont', 0.95) - list_aggregate(s, 'quantile_cont', 0.05), 6) AS robust_range, CAST(len(p) AS INTEGER) AS cycles,
  round(CASE WHEN len(p) > 1 THEN list_stddev_pop(p) / list_avg(p) END, 6) AS period_cv, round(CASE WHEN len(p) > 1 THEN list_stddev_pop(r) / list_avg(r) END, 6) AS amplitude_cv,
  round(list_sum(list_transform(y, lambda v: len(list_filter(v, lambda x: x > 0)))) / list_sum(p), 6) AS above, CAST(coalesce(list_max(list_transform(string_split(array_to_string(f, ''), '0'), lambda x: len(x))), 0) AS INTEGER) AS longest_run FROM f""")
def dsp18_cycles(spark, sf):
    """Amplitude, and the regularity of the cycles between upward crossings."""
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("s"))
    rms, spread = G.amplitude(F.col("s"))
    return rounded(G.cycles(e.withColumns({"rms": rms, "robust_range": spread}), "s").drop("s"))


@query("dsp18_coherence", f"""WITH {_SIG}, l AS (SELECT seg // 4 AS rec, seg, channel, generate_subscripts(s, 1) - 1 AS i, unnest(s) AS v FROM sg WHERE channel IN (0, 1, 4, 5)), k AS (SELECT unnest([2, 5, 9]) AS bin),
  f AS (SELECT rec, seg, channel, bin, sum(v * cos(2 * pi() * i * bin / 64)) AS re, sum(v * sin(2 * pi() * i * bin / 64)) AS im FROM l, k GROUP BY ALL), p AS (SELECT x.rec, x.seg, x.channel AS pair, x.bin, x.re AS a, x.im AS b, y.re AS c, y.im AS d FROM f x JOIN f y ON x.seg = y.seg AND x.bin = y.bin AND y.channel = x.channel + 4 WHERE x.channel < 2),
  v AS (SELECT rec, pair, bin, (sum(a * c + b * d) ** 2 + sum(b * c - a * d) ** 2) / (sum(a * a + b * b) * sum(c * c + d * d) + 1e-12) AS v FROM p GROUP BY 1, 2, 3) SELECT rec, pair, round(avg(v), 5) AS coherence FROM v GROUP BY 1, 2""")
def dsp18_coherence(spark, sf):
    s = signals(spark, sf).withColumn("rec", F.floor(F.col("seg") / 4))
    return rounded(G.coherence(s, ["rec"], "seg", "channel", "samples", [(0, 4), (1, 5)], [2, 5, 9]), 5)


POWERS = [-1.0, -0.5, 0.0, 0.25, 0.5, 1.0]
_LMS = f"""{_FINE}, pw AS (SELECT CAST(unnest({POWERS}) AS DOUBLE) AS l), rw AS (SELECT stage, age, l, ln(value) AS ln, CASE WHEN l = 0 THEN ln(value) ELSE exp(ln(value) * l) END AS v FROM seg, pw WHERE NOT artifact AND value > 0),
  ft AS (SELECT stage, g, l, sum(w) AS weight, sum(w * ln) / sum(w) AS ln, sum(w * v) / sum(w) AS mean, sum(w * v * v) / sum(w) - (sum(w * v) / sum(w)) ** 2 AS var FROM (SELECT rw.*, g, exp(-0.5 * ((age - g) / 5) ** 2) AS w FROM rw JOIN gr ON abs(age - g) <= 20) GROUP BY 1, 2, 3),
  f2 AS (SELECT *, sqrt(greatest(var, 0)) / CASE WHEN l = 0 THEN 1 ELSE abs(l) END AS sd FROM ft WHERE weight >= 20), lms AS (SELECT stage, g, weight, l, CASE WHEN l = 0 THEN exp(mean) ELSE exp(ln(mean) / l) END AS m, CASE WHEN l = 0 THEN sd ELSE sd / mean END AS s FROM f2 WHERE sd > 0 QUALIFY row_number() OVER (PARTITION BY stage, g ORDER BY round(l * ln - ln(sd), 10) DESC, l) = 1)"""


def lms(spark, sf):
    return N.lms_curve(segments(spark, sf).where(~F.col("artifact")), ["stage"], "age", "value", FINE, 5.0, POWERS)


@query("n09_parametric_curves", f"WITH {SEG}, {_LMS} SELECT stage, g, round(weight, 4) AS weight, l, round(m, 4) AS m, round(s, 4) AS s FROM lms")
def n09(spark, sf):
    return rounded(lms(spark, sf), 4)


@query("n09_parametric_deviation", f"""WITH {SEG}, {_LMS}, {_Z.replace(_FINE + ", ", "")}
  SELECT q.eeg_id, q.segment, round(coalesce(CASE WHEN q.value > 0 THEN CASE WHEN l = 0 THEN ln(q.value / m) / s ELSE (exp(l * ln(q.value / m)) - 1) / (l * s) END END, dev.z), 3) AS z FROM seg q LEFT JOIN lms ON lms.stage = q.stage AND lms.g = floor(q.age / 2) * 2 JOIN dev ON dev.eeg_id = q.eeg_id AND dev.segment = q.segment""")
def n09_z(spark, sf):
    """z in the parametric curve at the grid point at or below the age; where there is none, in the robust curve."""
    d = gated_deviations(spark, sf).select("eeg_id", "segment", "stage", "value", (F.floor(F.col("age") / 2) * 2).cast("double").alias("g"), F.col("z").alias("robust"))
    z = d.join(lms(spark, sf).hint("merge"), ["stage", "g"], "left")
    return rounded(z.select("eeg_id", "segment", F.coalesce(N.lms_z(F.col("value"), F.col("l"), F.col("m"), F.col("s")), "robust").alias("z")), 3)


@query("j09_majority_or_nearest", """WITH p AS (SELECT user_id, epoch(ts) - 1 AS a, epoch(ts) + 600 AS b, event_id FROM events WHERE event_type = 'signup'), l AS (SELECT user_id, event_id AS lid, epoch(ts) AS t, event_type AS state FROM events WHERE event_type <> 'signup'),
  h AS (SELECT p.event_id, l.state, count(*) AS n FROM p JOIN l ON l.user_id = p.user_id AND t >= a AND t < b GROUP BY ALL), m AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY n DESC, state) = 1),
  n AS (SELECT p.event_id, l.state FROM p JOIN l USING (user_id) QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY abs(t - (a + b) / 2), lid) = 1) SELECT p.event_id, coalesce(m.state, n.state) AS state FROM p LEFT JOIN m USING (event_id) LEFT JOIN n USING (event_id)""")
def j09(spark, sf):
    from ..functions.scalars import epoch

    e = table(spark, sf, "events").withColumn("at", epoch(F.col("ts")))
    s = e.where("event_type = 'signup'").select("user_id", "event_id", (F.col("at") - 1).alias("a"), (F.col("at") + 600).alias("b"))
    labels = e.where("event_type <> 'signup'").select("user_id", "at", F.col("event_id").alias("label_id"), F.col("event_type").alias("state"))
    return J.majority_or_nearest(s, labels, "user_id", "a", "b", "at", "state", 600.0, "event_id", "label_id").select("event_id", "state")


@query("st_a4_interval", "SELECT round(quantile_cont(auroc, 0.025), 5) AS low, round(quantile_cont(auroc, 0.975), 5) AS high, count(auroc) AS replicates FROM (" + ORACLES["st_a4_a5_bootstrap"].replace(", 6) AS auroc", ", 15) AS auroc") + ")")
def st_a4(spark, sf):
    return rounded(S.interval(S.bootstrap_auroc(labelled(spark, sf), "quality", "score", "source", 20), "auroc"), 5)


_HALF = "CASE WHEN CAST('0x' || md5('0|' || eeg_id)[1:8] AS BIGINT) % 2 = 0 THEN 'train' ELSE 'test' END"


@query("st_a16_chosen_thresholds", f"""WITH {SEG}, xs AS (SELECT CAST(unnest([3, 3.5, 4]) AS DOUBLE) AS x), ys AS (SELECT CAST(unnest([0.2, 0.4, 0.5]) AS DOUBLE) AS y0), sh AS (SELECT eeg_id, {_HALF} AS half, CAST(eeg_id % 3 = 0 AS INTEGER) AS a, x, avg(CAST(y > x AS DOUBLE)) AS share FROM seg, xs GROUP BY ALL),
  c AS (SELECT half, x, y0 AS y, a, CAST(share > y0 AS INTEGER) AS b FROM sh, ys), s AS (SELECT half, x, y, avg(CAST(a = b AS DOUBLE)) AS po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe FROM c GROUP BY ALL), k AS (SELECT half, x, y, CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END AS kappa FROM s),
  t AS (SELECT * FROM k WHERE half = 'train' ORDER BY round(kappa, 9) DESC NULLS LAST, x, y LIMIT 1) SELECT t.x, t.y, round(t.kappa, 6) AS kappa_train, round(u.kappa, 6) AS kappa_test FROM t LEFT JOIN k u ON u.half = 'test' AND u.x = t.x AND u.y = t.y""")
def st_a16(spark, sf):
    d = segments(spark, sf).withColumn("truth", F.col("eeg_id") % 3 == 0).select("eeg_id", "truth", F.col("y").alias("z"))
    return rounded(S.chosen_thresholds(d, "eeg_id", "truth", "z", [3, 3.5, 4], [0.2, 0.4, 0.5]))


def states(spark, sf):
    """Per recording: mean log amount in two states, and whether one in five of its segments or more is of a third."""
    of = lambda s: F.avg(F.when(F.col("stage") == s, F.col("y")))
    return segments(spark, sf).groupBy("eeg_id").agg(of("view").alias("wake"), of("click").alias("sleep"), (5 * F.count_if(F.col("stage") == "purchase") >= F.count(F.lit(1))).cast("int").alias("case"))


@query("st_a18_conditional")
def st_a18(spark, sf):
    """Does the difference in one state outlast adjustment for the other? Logistic fits with and without it."""
    d = shared.stored(states(spark, sf), "states")
    fits = [S.logit(d, "case", f).withColumn("model", F.lit("+".join(f))) for f in (["sleep"], ["sleep", "wake"])]
    return rounded(fits[0].unionByName(fits[1]).select("model", "term", "coefficient", "error", "p"), 5)


def amounts(spark, sf):
    return segments(spark, sf).groupBy("eeg_id").agg(F.avg("y").alias("mean"), F.percentile("y", F.lit(0.9)).alias("p90"), F.max("y").alias("top"), A.prevalence(F.col("y"), 3.0).alias("prev"))


@query("ml04_panel_scores")
def ml04(spark, sf):
    """A head on amounts of recordings; those whose id is a multiple of 4 are the panel, scored and never learned from."""
    d = amounts(spark, sf).join(states(spark, sf).hint("merge"), "eeg_id")
    return rounded(L.panel_scores(d, ["mean", "p90", "top", "prev"], "case", F.col("eeg_id") % 4 == 0).select("eeg_id", "p"), 5)


@query("ml05_focal_scores")
def ml05(spark, sf):
    """Focal: mostly one state's; normal: low amounts; general: the rest. Features: amounts and states."""
    s = states(spark, sf)
    low = F.col("sleep") + F.col("wake") < 4.2
    blocks = [amounts(spark, sf).select("eeg_id", "mean", "top"), s.select("eeg_id", (F.col("sleep") - F.col("wake")).alias("difference"))]
    return rounded(L.focal_scores(s, "eeg_id", F.col("case") == 1, low, ~low, blocks, each=60), 5)
