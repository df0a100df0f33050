"""Queries of channel quality, context windows, cohort top-up, rater agreement and further evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts as C
from ..operators import descriptors as D
from ..operators import joins as J
from ..operators import morphology as M
from ..operators import parametric as P
from ..operators import stats as S
from ..registry import ORACLES, query
from ..sources import sinks as K
from ..sources.shared import new_dir, stored
from ..streaming import jobs
from .curve_queries import _SIG, signals
from .norm_queries import _LAB, _auc, labelled
from .relational_queries import votes
from .signal_queries import _LONG, _PSD, long
from .tables import SEG, rounded, segments, table

#: Channels of which some are clipped, weak, still, missing or another one's mirror.
_FAULTY = f"""{_SIG}, ch AS (SELECT seg, channel, CASE channel WHEN 1 THEN list_transform(s, lambda x: greatest(least(x, 0.5), -0.5)) WHEN 2 THEN list_transform(s, lambda x: x * 0.05) WHEN 3 THEN list_transform(s, lambda x: 7.0) WHEN 4 THEN NULL ELSE s END AS s FROM sg WHERE channel < 17
  UNION ALL SELECT seg, 17, list_transform(s, lambda x: -2 * x) FROM sg WHERE channel = 0)"""


def faulty(spark, sf):
    s = signals(spark, sf)
    each = lambda f: F.transform("samples", f)
    c = F.col("channel")
    spoiled = F.when(c == 1, each(lambda x: F.greatest(F.least(x, F.lit(0.5)), F.lit(-0.5)))).when(c == 2, each(lambda x: x * 0.05)).when(c == 3, each(lambda x: F.lit(7.0))).when(c != 4, F.col("samples"))
    return s.where("channel < 17").withColumn("samples", spoiled).unionByName(s.where("channel = 0").select("seg", F.lit(17).cast("long").alias("channel"), each(lambda x: -2 * x).alias("samples")))


@query("dsp14_channel_quality", f"""WITH {_FAULTY}, u AS (SELECT seg, channel, i, (i - 1) // 16 AS w, s[i] AS x FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM ch)),
  d AS (SELECT *, x - lag(x) OVER (PARTITION BY seg, channel, w ORDER BY i) AS dw, x - lag(x) OVER (PARTITION BY seg, channel ORDER BY i) AS da, max(x) OVER (PARTITION BY seg, channel, w) AS hi, min(x) OVER (PARTITION BY seg, channel, w) AS lo, max(x) OVER (PARTITION BY seg, channel) AS top, min(x) OVER (PARTITION BY seg, channel) AS low FROM u),
  g AS (SELECT seg, channel, w, count(*) >= 8 AND max(x) > min(x) AND greatest(avg(CAST(x = hi AS DOUBLE)), avg(CAST(x = lo AS DOUBLE))) < 0.2 AND avg(CAST(dw = 0 AS DOUBLE)) < 0.999 AND NOT (1.4826 * mad(x) < 0.5 AND stddev_pop(x) < 0.5) AS alive FROM d GROUP BY 1, 2, 3),
  a AS (SELECT seg, channel, bool_or(alive) AS alive, count(*) AS n_windows, count(*) FILTER (alive) AS n_alive FROM g GROUP BY 1, 2),
  k AS (SELECT seg, channel, avg(CAST(da = 0 AS DOUBLE)) >= 0.999 AS d2, 1.4826 * mad(x) < 0.5 AND stddev_pop(x) < 0.5 AS d3, max(x) > min(x) AND greatest(avg(CAST(x = top AS DOUBLE)), avg(CAST(x = low AS DOUBLE))) >= 0.2 AS d4 FROM d GROUP BY 1, 2),
  live AS (SELECT d.seg, d.channel, i, x FROM d JOIN g USING (seg, channel, w) WHERE g.alive),
  dup AS (SELECT p.seg, q.channel, min(p.channel) AS duplicate_of FROM (SELECT p.seg, p.channel AS a, q.channel AS b FROM live p JOIN live q ON p.seg = q.seg AND p.i = q.i AND p.channel < q.channel AND q.channel >= 9 GROUP BY 1, 2, 3 HAVING count(*) >= 64 AND abs(corr(p.x, q.x)) >= 0.999) m JOIN (SELECT DISTINCT seg, channel FROM live) p ON p.seg = m.seg AND p.channel = m.a JOIN (SELECT DISTINCT seg, channel FROM live) q ON q.seg = m.seg AND q.channel = m.b GROUP BY 1, 2)
  SELECT ch.seg, ch.channel, coalesce(alive, false) AS alive, CASE WHEN coalesce(alive, false) THEN '' WHEN k.seg IS NULL THEN 'D1' WHEN NOT (d2 OR d3 OR d4) THEN 'D3' ELSE array_to_string(list_filter([CASE WHEN d2 THEN 'D2' END, CASE WHEN d3 THEN 'D3' END, CASE WHEN d4 THEN 'D4' END], lambda x: x IS NOT NULL), '+') END AS codes,
  coalesce(n_windows, 0) AS n_windows, coalesce(n_alive, 0) AS n_alive, duplicate_of FROM ch LEFT JOIN a USING (seg, channel) LEFT JOIN k USING (seg, channel) LEFT JOIN dup USING (seg, channel)""")
def dsp14(spark, sf):
    """Alive or dead with codes, and what another channel of the recording repeats; channels below 9 are listed ones."""
    c = faulty(spark, sf)
    q = D.channel_liveness(c, ["seg", "channel"], "samples", rate=6.4, seconds=2.5)
    d = D.duplicate_channels(c, "seg", "channel", "samples", F.col("channel") < 9, rate=6.4, seconds=2.5)
    out = q.join(d.hint("merge"), ["seg", "channel"], "left")
    return out.select("seg", "channel", "alive", F.array_join("codes", "+").alias("codes"), F.col("n_windows").cast("long").alias("n_windows"), F.col("n_alive").cast("long").alias("n_alive"), "duplicate_of")


@query("a26_context_widths", "WITH " + SEG + ", n AS (SELECT *, count(*) OVER (PARTITION BY eeg_id) AS n FROM seg), " + ", ".join(f"b{k} AS (SELECT eeg_id, segment, n < {k} AS padded, greatest(least(segment - {k // 2}, n - {k}), 0) AS lo FROM n), m{k} AS (SELECT b.eeg_id, b.segment, avg(s.y) AS mean, any_value(padded) AS padded FROM b{k} b JOIN seg s ON s.eeg_id = b.eeg_id AND s.segment >= lo AND s.segment < lo + {k} GROUP BY 1, 2)" for k in (30, 60, 120)) + " SELECT eeg_id, segment, " + ", ".join(f"round(m{k}.mean, 6) AS mean_{k}, m{k}.padded AS padded_{k}" for k in (30, 60, 120)) + " FROM m30 JOIN m60 USING (eeg_id, segment) JOIN m120 USING (eeg_id, segment)")
def a26(spark, sf):
    s = segments(spark, sf)
    out = None
    for k in (30, 60, 120):
        m = D.context_means(s, "eeg_id", "segment", "y", k).withColumnRenamed("mean", f"mean_{k}").withColumnRenamed("padded", f"padded_{k}")
        out = m if out is None else out.join(m.hint("merge"), ["eeg_id", "segment"])
    return rounded(out)


#: The replicates before they are rounded.
_REPLICATES = ORACLES["st_a4_a5_bootstrap"].replace(", 6) AS auroc", ", 15) AS auroc")
_DIFFERENCES = ORACLES["st_a23_paired_difference"].replace(", 6) AS difference", ", 15) AS difference")
_AREA = _auc().replace(", 6) AS auroc", ", 15) AS auroc")
_CLUSTERED = f"p AS ({_REPLICATES}), a AS (WITH {_LAB} {_AREA})"


@query("st_a5_clustered_interval", f"WITH {_CLUSTERED} SELECT CAST(a.positives + a.negatives AS BIGINT) AS n, round(greatest(a.auroc, 1 - a.auroc), 4) AS auroc, round(CASE WHEN any_value(a.auroc) < 0.5 THEN 1 - quantile_cont(p.auroc, 0.975) ELSE quantile_cont(p.auroc, 0.025) END, 4) AS low, round(CASE WHEN any_value(a.auroc) < 0.5 THEN 1 - quantile_cont(p.auroc, 0.025) ELSE quantile_cont(p.auroc, 0.975) END, 4) AS high FROM a, p GROUP BY ALL")
def st5(spark, sf):
    return rounded(S.auroc_interval(labelled(spark, sf), "quality", "score", "source", 20), 4)


@query("st_a23_adoption", f"WITH p AS ({_DIFFERENCES}), x AS (WITH {_LAB} {_AREA}), y AS (WITH {_LAB.replace('CAST(n_chars AS DOUBLE) AS score', 'CAST(doc_id % 97 AS DOUBLE) AS score')} {_AREA}) SELECT round(x.auroc - y.auroc, 4) AS difference, round(quantile_cont(p.difference, 0.025), 4) AS low, round(quantile_cont(p.difference, 0.975), 4) AS high, x.auroc - y.auroc > 0.02 AND quantile_cont(p.difference, 0.025) > 0 AS adopted FROM x, y, p GROUP BY x.auroc, y.auroc")
def st23(spark, sf):
    d = labelled(spark, sf).withColumn("ours", (F.col("doc_id") % 97).cast("double"))
    return rounded(S.adoption(d, "quality", "ours", "score", "source", 20), 4)


@query("st_a14_median_pairs", f"WITH p AS ({ORACLES['st_a14_rater_pairs']}) SELECT count(*) AS pairs, round(quantile_cont(kappa, 0.5), 4) AS kappa, round(quantile_cont(ac1, 0.5), 4) AS ac1 FROM p")
def st14(spark, sf):
    return rounded(S.median_agreement(votes(spark, sf), "item", "rater", "vote", min_votes=1, min_items=5), 4)


@query("st_a14_within_rater", """WITH r AS (SELECT user_id, event_type, CAST(value > 50 AS INT) AS vote, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events), b AS (SELECT event_type AS rater, max(vote) FILTER (k = 1) AS a, max(vote) FILTER (k = 2) AS b FROM r WHERE k <= 2 GROUP BY event_type, user_id HAVING count(*) = 2),
  s AS (SELECT rater, count(*) AS n, avg(CAST(a = b AS DOUBLE)) AS po, avg(a) AS pa, avg(b) AS pb FROM b GROUP BY 1) SELECT rater, n, round(po, 5) AS accuracy, round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 5) AS kappa FROM s""")
def st14_within(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("item"), F.col("event_type").alias("rater"), (F.col("value") > 50).cast("int").alias("vote"), "event_id")
    return rounded(S.within_rater(e, "item", "rater", "vote", "event_id").select("rater", "n", "accuracy", "kappa"), 5)


@query("j16_matched_controls", """WITH c AS (SELECT o_orderpriority AS s, count(*) AS quota FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0 GROUP BY 1), p AS (SELECT o_orderkey, o_orderpriority AS s FROM orders WHERE o_orderstatus <> 'F' AND (o_orderpriority > '2' OR o_orderkey % 50 = 0)),
  m AS (SELECT o_orderkey, s FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY md5('0' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS k FROM p) JOIN c USING (s) WHERE k <= quota),
  t AS (SELECT o_orderkey, s FROM p WHERE o_orderkey NOT IN (SELECT o_orderkey FROM m) QUALIFY row_number() OVER (ORDER BY md5('0+' || CAST(o_orderkey AS VARCHAR)), o_orderkey) <= (SELECT sum(quota) FROM c) - (SELECT count(*) FROM m)) SELECT o_orderkey, s, 'stratum' AS picked_as FROM m UNION ALL SELECT o_orderkey, s, 'top_up' FROM t""")
def j16(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("s"), "o_orderstatus")
    pool = o.where("o_orderstatus <> 'F' AND (s > '2' OR o_orderkey % 50 = 0)").drop("o_orderstatus")
    return J.matched_controls(pool, o.where("o_orderstatus = 'F' AND o_orderkey % 3 = 0"), "s", "o_orderkey")


def _events(spark, sf):
    return jobs.stream_of(spark, sf, "events.parquet")


@query("str04_longest_runs", """WITH f AS (SELECT user_id, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS slot, coalesce(arg_min(value, ts) > 60, false) AS f FROM events GROUP BY 1, 2), r AS (SELECT user_id, slot - row_number() OVER (PARTITION BY user_id ORDER BY slot) AS run FROM f WHERE f), n AS (SELECT user_id, run, count(*) AS n FROM r GROUP BY 1, 2)
  SELECT user_id, any_value(rows) AS rows, any_value(seen) AS seen, coalesce(max(n), 0) AS longest, count(n) AS episodes FROM (SELECT user_id, count(*) AS rows, max(slot) AS seen FROM f GROUP BY 1) LEFT JOIN n USING (user_id) GROUP BY 1""")
def str04(spark, sf):
    e = _events(spark, sf).withColumn("slot", F.floor(F.unix_timestamp("ts") / 21600))
    return jobs.run_updates(jobs.episode_runs(e, "user_id", "ts", "slot", F.col("value") > 60), ["user_id"], "seen")


@query("str05_eta", """WITH b AS (SELECT user_id, CAST(floor(epoch(ts) / 600) * 600 AS BIGINT) AS step FROM events), l AS (SELECT user_id, max(step) AS last, count(*) AS done FROM b GROUP BY 1), h AS (SELECT user_id, max(step) AS h FROM b JOIN l USING (user_id) WHERE step <= last - 86400 GROUP BY 1),
  s AS (SELECT user_id, count(*) AS since FROM b JOIN h USING (user_id) WHERE step > h GROUP BY 1) SELECT user_id, last AS "at", done, round(since * 60 / (last - h), 6) AS rate, round((done * 2 - done) / (since * 60 / (last - h)), 4) AS eta FROM l LEFT JOIN h USING (user_id) LEFT JOIN s USING (user_id)""")
def str05(spark, sf):
    totals = table(spark, sf, "events").groupBy("user_id").agg((F.count(F.lit(1)) * 2).alias("total"))
    out = jobs.run_updates(jobs.progress(_events(spark, sf).select("user_id", "ts"), totals, "user_id", "ts", "total", history=86400, step=600), ["user_id"], "at")
    return out.select("user_id", "at", "done", (F.round("rate", 6) + 0.0).alias("rate"), (F.round("eta", 4) + 0.0).alias("eta"))


@query("str06_latest_within", "SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def str06(spark, sf):
    keys = ["user_id", "event_type"]
    return jobs.run_updates(jobs.latest_within(_events(spark, sf), keys, "ts", "event_id", "value", keep="7 days"), keys, "event_id").drop("start")


def _bct(spark, sf):
    """Segments' values by state over log-age, and their Box-Cox-t curve."""
    s = segments(spark, sf).withColumn("t", F.log10(F.col("age") + 1 / 12))
    return s, P.bct_curve(s.where(~F.col("artifact")), ["stage"], "t", "value", [0.5, 0.9, 1.3, 1.6, 1.9], 0.15)


@query("n09_bct_curves")
def n09_curves(spark, sf):
    """A numerical fit: tests hold it against known parameters."""
    return _bct(spark, sf)[1]


@query("n09_bct_deviation")
def n09_deviation(spark, sf):
    """z of every segment in the curve at its log-age."""
    s, curve = _bct(spark, sf)
    return P.bct_deviation(s, stored(curve, "curve"), ["stage"], "t", "value").select("eeg_id", "segment", "fam", F.round("z", 4).alias("z"))


@query("dsp18_peak_width", f"WITH {_PSD}, {_LONG}, t AS (SELECT seg, channel, arg_min(f, (-p, f)) AS f0, max(p) AS p0 FROM lg WHERE f >= 2 AND f < 20 GROUP BY 1, 2), n AS (SELECT seg, channel, f, p, lead(f) OVER w AS f1, lead(p) OVER w AS p1 FROM lg WINDOW w AS (PARTITION BY seg, channel ORDER BY f)), l AS (SELECT n.seg, n.channel, max(f + (p0 / 2 - p) * (f1 - f) / (p1 - p)) AS l FROM n JOIN t USING (seg, channel) WHERE f1 <= f0 AND p <= p0 / 2 AND p1 > p0 / 2 GROUP BY 1, 2), r AS (SELECT n.seg, n.channel, min(f + (p0 / 2 - p) * (f1 - f) / (p1 - p)) AS r FROM n JOIN t USING (seg, channel) WHERE f >= f0 AND p > p0 / 2 AND p1 <= p0 / 2 GROUP BY 1, 2) SELECT seg, channel, f0 AS peak, round(coalesce(r - l, 2 * (f0 - l), 2 * (r - f0)), 5) AS width, round(f0 / coalesce(r - l, 2 * (f0 - l), 2 * (r - f0)), 5) AS q FROM t LEFT JOIN l USING (seg, channel) LEFT JOIN r USING (seg, channel)")
def dsp18_width(spark, sf):
    spectra = long(spark, sf).groupBy("seg", "channel").agg(F.array_sort(F.collect_list(F.struct("f", "p"))).alias("s"))  # a channel's bins
    out = spectra.select("seg", "channel", M.peak_shape(F.col("s"), 2.0, 20.0).alias("x"))
    return rounded(out.select("seg", "channel", "x.peak", "x.width", "x.q"), 5)


_ENVELOPE = "SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS e FROM embeddings"


@query("dsp18_bursts", f"WITH d AS ({_ENVELOPE}) SELECT vec_id, round(len(list_filter(e, lambda x: x > 0.1)) / len(e), 6) AS duty, round(len(list_filter(range(1, len(e) + 1), lambda i: e[i] > 0.1 AND (i = 1 OR e[i - 1] <= 0.1))) * 16.0 / len(e), 6) AS burst_rate, round(list_stddev_pop(e) / list_avg(e), 5) AS cv FROM d")
def dsp18_bursts(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("e"))
    out = e.select("vec_id", M.bursts(F.col("e"), 0.1, 16.0).alias("x")).select("vec_id", "x.*")
    return out.select("vec_id", (F.round("duty", 6) + 0.0).alias("duty"), (F.round("burst_rate", 6) + 0.0).alias("burst_rate"), (F.round("cv", 5) + 0.0).alias("cv"))


@query("dsp18_waves", """WITH d AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS s FROM embeddings), c AS (SELECT vec_id, list_transform(s, lambda x: x - list_sum(s) / len(s)) AS c FROM d), u AS (SELECT vec_id, c, list_filter(range(2, len(c) + 1), lambda i: c[i - 1] < 0 AND c[i] >= 0) AS u FROM c),
  y AS (SELECT vec_id, c, k, u[k] AS a, u[k + 1] AS b FROM (SELECT *, unnest(range(1, len(u))) AS k FROM u)), p AS (SELECT *, a + list_position(c[a:b - 1], list_max(c[a:b - 1])) - 1 AS p FROM y), t AS (SELECT *, p + list_position(c[p:b - 1], list_min(c[p:b - 1])) - 1 AS t FROM p),
  n AS (SELECT *, lead(p) OVER (PARTITION BY vec_id ORDER BY k) AS q FROM t) SELECT c.vec_id, CAST(count(n.k) AS INTEGER) AS cycles, round(avg(abs(n.c[p - 1] - 2 * n.c[p] + n.c[p + 1])), 6) AS peak_sharpness, round(avg(abs(n.c[t - 1] - 2 * n.c[t] + n.c[t + 1])), 6) AS trough_sharpness, round(avg((q - t) * 1.0 / (q - p)), 6) AS rise_share FROM c LEFT JOIN n USING (vec_id) GROUP BY 1""")
def dsp18_waves(spark, sf):
    s = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("s"))
    return rounded(s.select("vec_id", M.waves(F.col("s")).alias("x")).select("vec_id", "x.*"))


#: Channels of three rows of six, beside those left, right, above and below.
MONTAGE = {c: [n for n in (c - 1 if c % 6 else -1, c + 1 if c % 6 < 5 else -1, c - 6, c + 6) if 0 <= n < 18] for c in range(18)}
_MONTAGE = "adj AS (SELECT a.c AS a, b.c AS b FROM (SELECT unnest(range(18)) AS c) a, (SELECT unnest(range(18)) AS c) b WHERE a.c // 6 = b.c // 6 AND abs(a.c - b.c) = 1 OR abs(a.c - b.c) = 6)"


@query("dsp18_field_size", f"WITH RECURSIVE {_MONTAGE}, act AS (SELECT vec_id // 18 AS seg, vec_id % 18 AS c FROM embeddings WHERE list_max(embedding) > 0.3), grow AS (SELECT seg, c AS root, c FROM act UNION SELECT g.seg, root, x.c FROM grow g JOIN adj ON adj.a = g.c JOIN act x ON x.seg = g.seg AND x.c = adj.b) SELECT s.seg, CAST(coalesce(max(m), 0) AS INTEGER) AS largest, CAST(count(DISTINCT root) AS INTEGER) AS extent FROM (SELECT DISTINCT vec_id // 18 AS seg FROM embeddings) s LEFT JOIN (SELECT seg, root, count(*) AS m FROM grow GROUP BY 1, 2) g USING (seg) GROUP BY 1")
def dsp18_field(spark, sf):
    on = F.when(F.array_max("samples") > 3.0, F.col("channel"))
    active = signals(spark, sf).groupBy("seg").agg(F.array_sort(F.collect_list(on)).alias("a"))  # a segment's channels
    return active.select("seg", M.field_size(F.col("a"), MONTAGE).alias("x")).select("seg", "x.largest", "x.extent")


@query("qc01_distinct_per_group", "SELECT o_custkey, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 2")
def qc01(spark, sf):
    return C.crowded(table(spark, sf, "orders"), ["o_custkey"], "o_orderstatus", 2)


_SIDE = "SELECT unnest(['n', 'mean', 'std', 'min', 'max', 'median']) AS statistic, unnest([CAST(count(x) AS DOUBLE), avg(x), stddev_pop(x), min(x), max(x), quantile_cont(x, 0.5)]) AS v"


@query("qc05_summary_diff", f"WITH a AS ({_SIDE} FROM (SELECT CAST(o_totalprice AS DOUBLE) AS x FROM orders WHERE o_orderkey % 10 <> 0)), b AS ({_SIDE} FROM (SELECT CAST(o_totalprice + o_orderkey % 3 AS DOUBLE) AS x FROM orders WHERE o_orderkey % 10 <> 1)) SELECT 'o_totalprice' AS \"column\", statistic, round(a.v, 4) AS a, round(b.v, 4) AS b, round(abs(b.v - a.v) / abs(a.v), 6) AS relative FROM a JOIN b USING (statistic)")
def qc05(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    d = C.summary_differences(o.where("o_orderkey % 10 <> 0"), o.where("o_orderkey % 10 <> 1").withColumn("o_totalprice", F.col("o_totalprice") + F.col("o_orderkey") % 3), ["o_totalprice"])
    return d.select("column", "statistic", (F.round("a", 4) + 0.0).alias("a"), (F.round("b", 4) + 0.0).alias("b"), (F.round("relative", 6) + 0.0).alias("relative"))


@query("snk02_frozen_version", """SELECT 'v1' AS version, o_orderstatus AS source, count(*) AS n, (SELECT count(*) FROM orders) AS "rows", (SELECT count(DISTINCT o_custkey) FROM orders) AS "keys", 'o_orderkey,o_custkey,o_orderstatus' AS columns FROM orders GROUP BY 2""")
def snk02(spark, sf):
    """A version written with its metadata, of which the counts by source are read back; tests hold its content hash."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    meta = K.freeze(o, new_dir(spark, "frozen"), "v1", "o_custkey", "o_orderstatus")
    return meta.select("version", F.explode("per_source").alias("source", "n"), "rows", "keys", "columns")


@query("a18_thin_cells", "WITH a AS (SELECT DISTINCT p_brand FROM part), b AS (SELECT DISTINCT p_type FROM part), n AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_brand, p_type, coalesce(n, 0) AS n FROM a CROSS JOIN b LEFT JOIN n USING (p_brand, p_type) WHERE coalesce(n, 0) < 3")
def a18(spark, sf):
    return D.thin_cells(table(spark, sf, "part"), "p_brand", "p_type", 3)


@query("n14_laterality_gradient", f"WITH {_SIG}, w AS (SELECT seg, channel, unnest([0, 1, 2, 3]) AS w, s FROM sg), z AS (SELECT seg, channel, w, list_avg(s[16 * w + 1:16 * w + 16]) AS z FROM w), p AS (SELECT seg, w, avg(z) FILTER (channel < 5) - avg(z) FILTER (channel BETWEEN 5 AND 8) AS l, avg(z) FILTER (channel BETWEEN 9 AND 12) - avg(z) FILTER (channel > 12) AS g FROM z GROUP BY 1, 2), m AS (SELECT seg, avg(l) AS l, avg(g) AS g FROM p GROUP BY 1) SELECT seg, round(l, 6) AS laterality, round(g, 6) AS gradient, CASE WHEN l IS NULL AND g IS NULL THEN NULL WHEN l IS NULL OR abs(g) > abs(l) THEN 'gradient' ELSE 'laterality' END AS dominant FROM m")
def n14(spark, sf):
    w = signals(spark, sf).select("seg", "channel", "samples", F.explode(F.array(*map(F.lit, range(4)))).alias("w"))
    z = w.select("seg", "channel", "w", (F.aggregate(F.slice("samples", 16 * F.col("w") + 1, 16), F.lit(0.0), lambda t, x: t + x) / 16).alias("z"))
    out = D.laterality(z, "seg", "w", "channel", "z", [*range(5)], [*range(5, 9)], [*range(9, 13)], [*range(13, 18)])
    return out.select("seg", (F.round("laterality", 6) + 0.0).alias("laterality"), (F.round("gradient", 6) + 0.0).alias("gradient"), "dominant")


@query("j02_two_columns", "SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem JOIN (SELECT o_orderkey, CAST(o_orderkey % 5 AS BIGINT) AS line, o_orderpriority FROM orders) o ON l_orderkey = o_orderkey AND l_linenumber = line")
def j02(spark, sf):
    """Labels joined on recording and segment."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 5).cast("long").alias("l_linenumber"), "o_orderpriority")
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))
    return li.join(o.hint("merge"), ["l_orderkey", "l_linenumber"])


@query("j18_scores_and_votes", "WITH v AS (SELECT l_orderkey, avg(CAST(l_returnflag = 'R' AS DOUBLE)) AS share FROM lineitem GROUP BY 1) SELECT o_custkey, o_orderkey, round(c_acctbal, 2) AS score, round(share, 6) AS share FROM orders JOIN customer ON c_custkey = o_custkey JOIN v ON l_orderkey = o_orderkey")
def j18(spark, sf):
    """Scores by patient and votes by recording, through the crosswalk of recordings."""
    scores = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.round(F.col("c_acctbal").cast("double"), 2) + 0.0).alias("score"))
    shares = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.round(F.avg((F.col("l_returnflag") == "R").cast("double")), 6) + 0.0).alias("share"))
    return J.through(table(spark, sf, "orders"), scores, shares, "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "score", "share")
