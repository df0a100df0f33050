"""Queries of signals, sources, contracts, learning and streaming. Embeddings play signals (64 samples) and spectra
(squares, 0.75 Hz apart)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts as C
from ..operators import learning as L
from ..operators import signal as G
from ..registry import query
from ..sources import readers as R
from ..sources import sinks as K
from ..streaming import jobs as J
from .norm_queries import labelled
from .tables import SEG, rounded, segments, table

HZ = 0.75
_PSD = "ps AS (SELECT vec_id, vec_id // 18 AS seg, vec_id % 18 AS channel, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)) AS psd FROM embeddings)"
_LONG = "lg AS (SELECT vec_id, seg, channel, (generate_subscripts(psd, 1) - 1) * 0.75 AS f, unnest(psd) AS p FROM ps)"


def spectra(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.floor(F.col("vec_id") / 18).alias("seg"), (F.col("vec_id") % 18).alias("channel"), F.transform("embedding", lambda x: x.cast("double") * x.cast("double")).alias("psd"))


def long(spark, sf):
    return G.long_spectrum(spectra(spark, sf), ["vec_id", "seg", "channel"], "psd", HZ)


_BP = ", ".join(f"(sum(p) FILTER (f >= {lo} AND f < {hi}) - (arg_min(p, f) FILTER (f >= {lo} AND f < {hi}) + arg_max(p, f) FILTER (f >= {lo} AND f < {hi})) / 2) * 0.75 AS {b}" for b, (lo, hi) in G.BANDS.items())


@query("dsp06_dsp07_bands", f"WITH {_PSD}, {_LONG}, bp AS (SELECT vec_id, {_BP} FROM lg GROUP BY 1) SELECT vec_id, {', '.join(f'round({b}, 6) AS {b}' for b in G.BANDS)}, round(delta / (alpha + 1e-12), 4) AS dar, round(alpha / (delta + 1e-12), 4) AS adr, round((delta + theta) / (alpha + beta + 1e-12), 4) AS dtabr FROM bp")
def dsp06(spark, sf):
    p = G.band_powers(spectra(spark, sf), "psd", HZ)
    return p.select("vec_id", *[F.round(b, 6).alias(b) for b in G.BANDS], *[F.round(v, 4).alias(k) for k, v in G.slowing_ratios({b: F.col(b) for b in G.BANDS}).items()])


@query("dsp08_edge_peak", f"WITH {_PSD}, {_LONG}, m AS (SELECT seg, f, avg(p) AS p FROM lg WHERE f >= 0.5 AND f <= 45 GROUP BY 1, 2), c AS (SELECT seg, f, p, sum(p) OVER (PARTITION BY seg ORDER BY f) / (sum(p) OVER (PARTITION BY seg) + 1e-12) AS c FROM m) SELECT seg, coalesce(min(f) FILTER (c >= 0.95), max(f)) AS edge, arg_max(f, p) AS peak FROM c GROUP BY 1")
def dsp08(spark, sf):
    return rounded(G.edge_and_peak(long(spark, sf), ["seg"]))


@query("dsp10_hemispheres", f"WITH {_PSD}, {_LONG}, m AS (SELECT seg, f, avg(p) FILTER (channel IN (4,5,6,7,12,13,14,15)) AS r, avg(p) FILTER (channel IN (0,1,2,3,8,9,10,11)) AS l FROM lg WHERE f >= 0.5 AND f < 25 GROUP BY 1, 2) SELECT seg, round(avg(abs((r - l) / (r + l + 1e-12))), 6) AS r_sbsi, round(avg((r - l) / (r + l + 1e-12)), 6) AS pdbsi FROM m GROUP BY 1")
def dsp10(spark, sf):
    return rounded(G.hemisphere_index(long(spark, sf), ["seg"], "channel", [0, 1, 2, 3, 8, 9, 10, 11], [4, 5, 6, 7, 12, 13, 14, 15]))


@query("dsp13_slow_shape", f"WITH {_PSD}, {_LONG}, s AS (SELECT vec_id, sum(f * p) / (sum(p) + 1e-12) AS c, sum(f * f * p) / (sum(p) + 1e-12) AS q, arg_max(f, p) AS peak FROM lg WHERE f >= 0.5 AND f < 8 GROUP BY 1) SELECT vec_id, round(c, 6) AS centroid, round(sqrt(greatest(q - c * c, 0)), 6) AS spread, peak FROM s")
def dsp13(spark, sf):
    return rounded(G.slow_shape(long(spark, sf), ["vec_id"]))


@query("dsp01_dsp03_montage_segments", """WITH b AS (SELECT a.vec_id // 18 AS seg, a.vec_id % 18 AS channel, list_transform(list_zip(a.embedding, c.embedding), lambda z: CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) AS s FROM embeddings a JOIN embeddings c ON a.vec_id // 18 = c.vec_id // 18 AND c.vec_id % 18 = a.vec_id % 18 + 1),
  w AS (SELECT seg, channel, s, unnest(range(0, 49, 14)) AS start FROM b) SELECT seg, channel, CAST(start AS BIGINT) AS start, round(list_sum(s[start + 1:start + 16]), 4) AS total FROM w""")
def dsp01(spark, sf):
    e = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 18).alias("seg"), (F.col("vec_id") % 18).alias("channel"), F.transform("embedding", lambda x: x.cast("double")).alias("samples"))
    montage = spark.createDataFrame([(k, k, k + 1) for k in range(17)], "channel_out long, anode long, cathode long")
    cut = G.cut_segments(G.bipolar(e, montage, ["seg"]), 16, 14)
    return rounded(cut.select("seg", "channel", F.col("start").cast("long").alias("start"), F.aggregate("samples", F.lit(0.0), lambda a, x: a + x).alias("total")), 4)


_RD = "list_max(embedding) - list_min(embedding)"


@query("dsp12_artifacts", f"""WITH c AS (SELECT vec_id // 18 AS seg, CAST({_RD} AS DOUBLE) AS p, list_aggregate(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), 'stddev_pop') AS s FROM embeddings), g AS (SELECT seg, avg(CAST(p < 0.45 OR s < 0.1 AS DOUBLE)) AS share, quantile_cont(p, 0.5) AS mp, quantile_cont(s, 0.5) AS ms, max(p) AS top FROM c GROUP BY 1)
  SELECT seg, NOT (share > 0.5 OR mp < 0.45 OR ms < 0.1) AND NOT top > 0.75 AS usable, CASE WHEN share > 0.5 OR mp < 0.45 OR ms < 0.1 THEN 'flat' WHEN top > 0.75 THEN 'high_amplitude' ELSE 'ok' END AS reason FROM g""")
def dsp12(spark, sf):
    e = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 18).alias("seg"), F.col("embedding").alias("samples"))
    return G.artifacts(e, ["seg"], flat=0.45, flat_sd=0.1, high=0.75)


@query("dsp18_line_length_mobility", """WITH d AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS s FROM embeddings), t AS (SELECT vec_id, s, list_transform(list_zip(s[2:64], s[1:63]), lambda z: z[1] - z[2]) AS u FROM d)
  SELECT vec_id, round(list_sum(list_transform(u, lambda x: abs(x))), 6) AS line_length, round(list_aggregate(u, 'stddev_pop') / (list_aggregate(s, 'stddev_pop') + 1e-12), 6) AS mobility FROM t""")
def dsp18(spark, sf):
    return rounded(table(spark, sf, "embeddings").select("vec_id", G.line_length(F.col("embedding")).alias("line_length"), G.mobility(F.col("embedding")).alias("mobility")))


@query("dsp04_dsp05_filtered_spectra")
def dsp05(spark, sf):
    """Band-passed signals, multitaper spectra, and the powers of their bands."""
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("samples"))
    psd = G.multitaper(G.bandpass(e, ["vec_id"], "samples", 64.0, 0.5, 30.0, 16.0), ["vec_id"], "samples", 64.0)
    return rounded(psd.select("vec_id", *[G.band_power(F.col("psd"), 1.0, lo, hi).alias(b) for b, (lo, hi) in {"slow": (1.0, 8.0), "fast": (8.0, 30.0)}.items()]))


@query("src01_src06_src07_sources", """SELECT page_id, nullif(regexp_extract(url, '^https?://([^/]+)/([a-z]{2})/(\\d+)', 1), '') AS host, nullif(regexp_extract(url, '^https?://([^/]+)/([a-z]{2})/(\\d+)', 2), '') AS lang, nullif(regexp_extract(url, '^https?://([^/]+)/([a-z]{2})/(\\d+)', 3), '') AS number FROM pages WHERE page_id IN (SELECT doc_id FROM labels)""")
def src01(spark, sf):
    ids = table(spark, sf, "labels").select(F.col("doc_id").alias("page_id"))
    p = R.recordings(spark, f"{sf}/pages.parquet", "page_id", ids, ["page_id", "url"])
    return R.from_names(p, F.col("url"), r"^https?://([^/]+)/([a-z]{2})/(\d+)", ["host", "lang", "number"]).drop("url")


@query("src04_json_props", """SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2""")
def src04(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.from_json("props", "k long")["k"])
    return e.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


@query("src07_tidy_arrays", """SELECT label, CAST(i AS BIGINT) AS i, round(avg(x), 5) AS mean FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS x FROM embeddings) GROUP BY 1, 2""")
def src07(spark, sf):
    t = R.tidy_array(table(spark, sf, "embeddings"), ["label"], "embedding", "i", "x")
    return rounded(t.groupBy("label", F.col("i").cast("long").alias("i")).agg(F.avg(F.col("x").cast("double")).alias("mean")), 5)


@query("src08_age_lookup", """SELECT o_orderkey, round((epoch(o_orderdate) - epoch(first)) / 31557600.0, 6) AS age FROM orders JOIN (SELECT o_custkey, min(o_orderdate) AS first FROM orders GROUP BY 1) USING (o_custkey)""")
def src08(spark, sf):
    o = table(spark, sf, "orders")
    return rounded(R.age_at(o.select("o_orderkey", "o_custkey", "o_orderdate"), o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("birth")), "o_custkey", "o_orderdate", "birth").select("o_orderkey", "age"))


@query("qc01_contract", """SELECT * FROM (SELECT 'value:l_returnflag' AS "check", count(*) FILTER (l_returnflag NOT IN ('A', 'N')) AS "rows" FROM lineitem UNION ALL SELECT 'repeated_key', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'missing:stage', 1) WHERE "rows" > 0""")
def qc01(spark, sf):
    return C.violations(table(spark, sf, "lineitem"), ["l_orderkey", "stage"], {"l_returnflag": ["A", "N"]}, ["l_orderkey", "l_linenumber"])


@query("qc02_contiguous", """SELECT l_orderkey, span, n, d FROM (SELECT l_orderkey, CAST(max(l_linenumber) - min(l_linenumber) + 1 AS BIGINT) AS span, count(*) AS n, count(DISTINCT l_linenumber) AS d FROM lineitem GROUP BY 1) WHERE span <> n OR d <> n""")
def qc02(spark, sf):
    return C.contiguous(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber").withColumn("span", F.col("span").cast("long"))


@query("qc05_table_diff", """WITH a AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 10 <> 0), b AS (SELECT o_orderkey, o_totalprice + o_orderkey % 3 AS o_totalprice FROM orders WHERE o_orderkey % 10 <> 1)
  SELECT 'o_totalprice' AS "column", count(*) FILTER (b.o_orderkey IS NULL) AS only_a, count(*) FILTER (a.o_orderkey IS NULL) AS only_b, round(max(abs(a.o_totalprice - b.o_totalprice)), 4) AS max_abs, round(avg((a.o_totalprice - b.o_totalprice) ** 2), 4) AS mse FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""")
def qc05(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return rounded(C.differences(o.where("o_orderkey % 10 <> 0"), o.where("o_orderkey % 10 <> 1").withColumn("o_totalprice", F.col("o_totalprice") + F.col("o_orderkey") % 3), ["o_orderkey"], ["o_totalprice"]), 4)


@query("snk02_metadata", """SELECT count(*) AS "rows", count(DISTINCT o_custkey) AS "keys", 'o_orderkey,o_custkey,o_orderstatus' AS columns FROM orders""")
def snk02(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return K.metadata(o, "o_custkey", "o_orderstatus").select("rows", "keys", "columns")


@query("ml01_logistic_head")
def ml01(spark, sf):
    """A head on document features, scored on all labelled documents."""
    d = labelled(spark, sf).withColumn("log_score", F.log(F.col("score") + 1))
    return rounded(L.scored(L.head(d, ["score", "log_score"], "quality"), d).select("doc_id", "quality", "p"), 6)


@query("ml02_multiple_instance")
def ml02(spark, sf):
    """Segments of recordings whose id is a multiple of 3 are weak positives."""
    s = segments(spark, sf).withColumns({"label": (F.col("eeg_id") % 3 == 0).cast("int"), "k": F.pmod(F.col("segment"), F.lit(7)).cast("double")})
    return rounded(L.scored(L.multiple_instance(s, ["y", "k", "age"], "eeg_id", "segment", "label"), s).select("eeg_id", "segment", "p"), 5)


@query("ml03_folded_scores")
def ml03(spark, sf):
    """Panel items scored by fits on the other folds."""
    s = segments(spark, sf).groupBy("eeg_id").agg(F.avg("y").alias("mean"), F.max("y").alias("top"), F.first((F.col("eeg_id") % 2 == 0).cast("int")).alias("label"))
    return rounded(L.folded_scores(s, ["mean", "top"], "label", "eeg_id", 5), 5)


@query("ml07_calibration")
def ml07(spark, sf):
    d = labelled(spark, sf).select("doc_id", "score", "quality")
    from pyspark.ml.feature import VectorAssembler

    model = L.calibrated(d, "score", "quality")
    return model.transform(VectorAssembler(inputCols=["score"], outputCol="_s").transform(d)).select("doc_id", F.round("prediction", 6).alias("p"))


@query("ml08_operating_point", f"WITH {SEG} SELECT round(quantile_cont(y, 0.99), 6) AS tau FROM seg WHERE NOT artifact")
def ml08(spark, sf):
    return rounded(L.operating_point(segments(spark, sf).where(~F.col("artifact")), "y"))


@query("str02_sliding_segments", """WITH e AS (SELECT user_id, value, epoch(ts) AS t FROM events), w AS (SELECT user_id, value, t, unnest([0, 1]) AS k FROM e), s AS (SELECT user_id, value, (floor(t / 14) - k) * 14 AS start, t FROM w) SELECT user_id, CAST(start AS BIGINT) AS start, count(*) AS n, round(avg(value), 6) AS mean FROM s WHERE t >= start AND t < start + 15 GROUP BY 1, 2""")
def str02(spark, sf):
    return rounded(J.run_available(J.sliding_segments(J.stream_of(spark, sf, "events.parquet"), "user_id", "ts", "value")))


@query("str03_live_deviation", """SELECT event_id, round((value - mu) / sigma, 6) AS z FROM events JOIN (SELECT event_type, avg(value) AS mu, stddev_pop(value) AS sigma FROM events WHERE user_id % 3 = 0 GROUP BY 1) USING (event_type)""")
def str03(spark, sf):
    norms = table(spark, sf, "events").where("user_id % 3 = 0").groupBy("event_type").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sigma"))
    s = J.live_deviation(J.stream_of(spark, sf, "events.parquet").select("event_id", "event_type", "value"), norms, ["event_type"], "value")
    return rounded(J.run_available(s.select("event_id", "z"), "append"))


@query("str04_episodes", """WITH e AS (SELECT user_id, epoch(ts) AS t FROM events WHERE value > 30), s AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 3600 THEN 0 ELSE 1 END AS s FROM e), r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM s)
  SELECT user_id, CAST(floor(min(t)) AS BIGINT) AS start, CAST(floor(max(t) + 3600) AS BIGINT) AS "end", count(*) AS n FROM r GROUP BY user_id, run""")
def str04(spark, sf):
    return J.run_available(J.episodes(J.stream_of(spark, sf, "events.parquet"), "user_id", "ts", F.col("value") > 30, "1 hour"))


@query("str05_rates", "SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS start, count(*) AS n FROM events GROUP BY 1")
def str05(spark, sf):
    return J.run_available(J.rates(J.stream_of(spark, sf, "events.parquet"), "ts"))


@query("str06_latest", "SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def str06(spark, sf):
    return J.run_available(J.latest(J.stream_of(spark, sf, "events.parquet"), ["user_id", "event_type"], "event_id", "value"))
