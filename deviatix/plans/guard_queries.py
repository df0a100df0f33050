"""Queries of guards, selections, report texts and recording tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import contracts as C
from ..operators import norms as N
from ..operators import stats as ST
from ..operators import windows as W
from ..registry import query
from .tables import POW, SEG, powers, rounded, segments, table


def guard_sql(ctes: str, source: str, tests: dict[str, tuple[str, str]]) -> str:
    """name, value, ok in SQL, of aggregates and of conditions on ``v``."""
    values = ", ".join(f"CAST({e} AS DOUBLE) AS {k}" for k, (e, _) in tests.items())
    rows = " UNION ALL ".join(f"SELECT '{k}' AS name, round({k}, 6) AS value, coalesce({ok.replace('v', k, 1)}, false) AS ok FROM a" for k, (_, ok) in tests.items())
    return f"WITH {ctes}, a AS (SELECT {values} FROM {source}) {rows}"


_PROB = f"{POW}, pr AS (SELECT eeg_id, channel, delta / (delta + theta + alpha) AS p0, theta / (delta + theta + alpha) AS p1, alpha / (delta + theta + alpha) AS p2, delta / 50 AS h1, alpha / 10 AS h2 FROM pw)"


@query("qc02_probability_guards", guard_sql(_PROB, "pr", {
    "worst_sum": ("max(abs(p0 + p1 + p2 - 1))", "v < 3e-3"), "mean_sum": ("avg(p0 + p1 + p2)", "abs(v - 1) < 1e-4"), "top_p0": ("max(abs(p0))", "v > 0"), "top_p1": ("max(abs(p1))", "v > 0"), "top_p2": ("max(abs(p2))", "v > 0"),
    "zeros_h1": ("avg(CAST(h1 = 0 AS INT))", "v < 0.02"), "zeros_h2": ("avg(CAST(h2 = 0 AS INT))", "v < 0.02"), "heads_above_1": ("count(*) FILTER (h1 + h2 > 1)", "v > 0")}))
def qc02(spark, sf):
    total = F.col("delta") + F.col("theta") + F.col("alpha")
    p = powers(spark, sf).select(*[(F.col(b) / total).alias(f"p{i}") for i, b in enumerate(("delta", "theta", "alpha"))], (F.col("delta") / 50).alias("h1"), (F.col("alpha") / 10).alias("h2"))
    return rounded(C.probability_guards(p, ["p0", "p1", "p2"], ["h1", "h2"]))


@query("qc02_paired_guards", guard_sql("j AS (SELECT epoch(l_shipdate) AS a, epoch(o_orderdate) AS b FROM (SELECT l_orderkey AS k, l_shipdate FROM lineitem WHERE l_linenumber = 1) FULL JOIN (SELECT o_orderkey AS k, o_orderdate FROM orders) USING (k))", "j", {
    "unpaired": ("count(*) FILTER (a IS NULL OR b IS NULL)", "v = 0"), "times_differ": ("count(*) FILTER (abs(a - b) > 1e-3)", "v = 0")}))
def qc02_paired(spark, sf):
    line = table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("k"), S.epoch(F.col("l_shipdate")).alias("t"))
    return rounded(C.paired_guards(line, table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), S.epoch(F.col("o_orderdate")).alias("t")), ["k"], "t"))


_FILL = """kept AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderstatus <> 'P'), dropped AS (SELECT * FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderstatus = 'P'),
  pool AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 8 = 1),
  fill AS (SELECT *, 'kept' AS origin FROM kept UNION ALL SELECT *, 'replacement' AS origin FROM (SELECT * FROM pool WHERE o_orderkey NOT IN (SELECT o_orderkey FROM kept) ORDER BY md5('0|' || o_orderkey) LIMIT (SELECT count(*) FROM dropped)))"""


def filled(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    old = o.where("o_orderkey % 4 <> 0")
    out = W.replacement_fill(old.where("o_orderstatus <> 'P'"), old.where("o_orderstatus = 'P'"), o.where("o_orderkey % 4 = 0 OR o_orderkey % 8 = 1"), "o_orderkey")
    return out, old.count()


@query("j15_replacement_fill", f"WITH {_FILL} SELECT o_orderkey, origin FROM fill")
def j15(spark, sf):
    return filled(spark, sf)[0].select("o_orderkey", "origin")


@query("qc03_launch_guards", guard_sql(_FILL, "fill", {"held": ("count(*)", "v >= (SELECT count(*) FROM orders WHERE o_orderkey % 4 <> 0)"), "null_o_custkey": ("count(*) FILTER (origin = 'replacement' AND o_custkey IS NULL)", "v = 0"), "unresolved": ("count(*) FILTER (o_orderstatus IS NULL)", "v = 0")}))
def qc03(spark, sf):
    new, least = filled(spark, sf)
    return rounded(C.launch_guards(new, "origin", ["o_custkey"], "o_orderstatus", least))


@query("qc04_age_guards", guard_sql("ag AS (SELECT (c_acctbal + 1000) / 120 AS age, c_nationkey < 24 AS exact FROM customer)", "ag", {
    "fractional": ("avg(CAST(age % 1 <> 0 AS INT))", "v > 0.8"), "negative": ("count(*) FILTER (age < 0)", "v = 0"), "above_top": ("count(*) FILTER (age > 90)", "v = 0"), "fractional_infants": ("avg(CAST(age % 1 <> 0 AS INT)) FILTER (age < 2)", "v > 0.9"), "exact": ("avg(CAST(exact AS INT))", "v > 0.95")}))
def qc04(spark, sf):
    c = table(spark, sf, "customer").select(((F.col("c_acctbal") + 1000) / 120).alias("age"), (F.col("c_nationkey") < 24).alias("exact"))
    return rounded(C.age_guards(c, "age", F.col("exact")))


@query("qc06_contradictions", """WITH f AS (SELECT coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic, coalesce(lang <> 'en', false) AS abroad FROM labels JOIN documents USING (doc_id))
  SELECT 'good' AS a, 'toxic' AS b, count(*) FILTER (good AND toxic) AS rows FROM f UNION ALL SELECT 'good', 'abroad', count(*) FILTER (good AND abroad) FROM f UNION ALL SELECT 'toxic', 'abroad', count(*) FILTER (toxic AND abroad) FROM f""")
def qc06(spark, sf):
    f = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return C.contradictions(f.select((F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"), (F.col("lang") != "en").alias("abroad")), ["good", "toxic", "abroad"])


@query("p17_centile_words", """WITH nl AS (SELECT event_type, value FROM events WHERE user_id % 3 = 0), n AS (SELECT event_type, count(*) AS n FROM nl GROUP BY 1),
  b AS (SELECT event_id, r.event_type, (SELECT count(*) FROM nl WHERE nl.event_type = r.event_type AND nl.value <= r.value) AS b FROM events r WHERE user_id % 3 <> 0),
  s AS (SELECT event_id, 100.0 * least(greatest(b, 1), n) / (n + 1) AS c FROM b JOIN n USING (event_type)), w AS (SELECT event_id, c, CAST(round_even(least(greatest(c, 1), 99), 0) AS INT) AS k FROM s)
  SELECT event_id, CASE WHEN c >= 99.9 THEN '>99.9th' WHEN c <= 0.1 THEN '<0.1st' ELSE k || CASE WHEN k BETWEEN 10 AND 20 THEN 'th' WHEN k % 10 = 1 THEN 'st' WHEN k % 10 = 2 THEN 'nd' WHEN k % 10 = 3 THEN 'rd' ELSE 'th' END END AS words FROM w""")
def p17(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    share = N.empirical_share(e.where("user_id % 3 <> 0"), e.where("user_id % 3 = 0"), ["event_type"], "value")
    return share.select("event_id", S.centile_text(F.col("share")).alias("words"))


@query("tx01_list_clauses", r"""WITH c AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[.;\n)]|\d\)'), lambda c: regexp_matches(c, 'tion')) AS k FROM documents)
  SELECT doc_id, CAST(len(k) AS INT) AS clauses, CAST(list_sum(list_transform(k, lambda c: length(c))) AS BIGINT) AS characters FROM c""")
def tx01(spark, sf):
    k = T.clauses(F.col("text"), "tion", T.LIST_CLAUSES)
    total = F.aggregate(k, F.lit(0).cast("long"), lambda a, c: a + F.length(c))
    return table(spark, sf, "documents").select("doc_id", F.size(k).alias("clauses"), F.when(F.size(k) > 0, total).alias("characters"))


_SENT = "list_filter(string_split_regex({0}, '[.;\\n]'), lambda s: trim(s) <> '')"
_NAMED = "(len(list_filter(" + _SENT + ", lambda s: regexp_matches(s, 'tion') AND NOT regexp_matches(s, ' (of|le) ') AND NOT regexp_matches(s, 'sch|ing'))) > 0)"


@query("tx10_tx11_label_algebra", rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS body, regexp_extract(coalesce(text, ''), '(?is)(?:thatand|ention)\s*:?\s*(.*)', 1) AS found, quality = 0 AS abn, contains(text, 'ung') AS foc, contains(text, 'ent') AS gen FROM documents LEFT JOIN labels USING (doc_id)),
  n AS (SELECT doc_id, coalesce(abn, false) AS abn, coalesce(foc, false) AS foc, coalesce(gen, false) AS gen, CASE WHEN trim(found) = '' AND coalesce(abn, false) THEN regexp_matches(body, '(?i)the[^.]{{0,60}}?(?:and|of)') AND {_NAMED.format("body")} ELSE {_NAMED.format("found")} END AS named FROM d)
  SELECT doc_id, named, foc AND abn AS focal, gen AND abn AND named AS gen_pathologic, gen AND NOT (gen AND abn AND named) AS gen_physiologic, (foc AND abn) OR (gen AND abn AND named) AS positive, abn AND NOT ((foc AND abn) OR (gen AND abn AND named)) AS abnormal_without FROM n""")
def tx10(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    body, abn = F.coalesce("text", F.lit("")), F.coalesce(F.col("quality") == 0, F.lit(False))
    found, source = T.conclusion(F.lit(None).cast("string"), body, T.section_pattern("thatand|ention"))
    named = T.named_with_fallback(F.coalesce(found, F.lit("")), source, body, abn, "tion", r"(?i)the[^.]{0,60}?(?:and|of)", negated=" (of|le) ", normal_state="sch|ing")
    d = d.select("doc_id", named.alias("named"), abn.alias("abn"), F.contains("text", F.lit("ung")).alias("foc"), F.contains("text", F.lit("ent")).alias("gen"))
    return d.select("doc_id", "named", *[c.alias(k) for k, c in T.label_algebra(F.col("foc"), F.col("gen"), F.col("abn"), F.col("named")).items()])


#: Descriptors of a recording from its events: shares and peaks by stage. Of stages with the greatest value the last by name is the peak (events without a stage have none); sides
#: are equal if they are to nine digits, as sums depend on the order of rows.
_DESC = """de AS (SELECT user_id, count(*) AS n, avg(CAST(value > 60 AS DOUBLE)) AS share, max(value) / 50 AS top, quantile_cont(value, 0.5) / 50 AS whole, count(*) FILTER (value > 60) AS episodes,
  avg(value) FILTER (event_type IN ('click', 'view')) AS l, avg(value) FILTER (event_type IN ('purchase', 'signup')) AS r, arg_max(event_type, (value, event_type)) FILTER (value IS NOT NULL) AS peak FROM events GROUP BY 1),
  dd AS (SELECT *, CASE WHEN round(l - r, 9) > 0 THEN 'left' WHEN round(l - r, 9) < 0 THEN 'right' END AS side, top > 5 AS focal, share > 0.15 AS general, whole > 1 AS confident FROM de)"""


def descriptors(spark, sf):
    v, t = F.col("value"), F.col("event_type")
    e = table(spark, sf, "events").groupBy("user_id").agg(
        F.avg((v > 60).cast("double")).alias("share"), (F.max(v) / 50).alias("top"), (F.percentile("value", F.lit(0.5)) / 50).alias("whole"), F.count_if(v > 60).alias("episodes"),
        F.avg(F.when(t.isin("click", "view"), v)).alias("l"), F.avg(F.when(t.isin("purchase", "signup"), v)).alias("r"), F.max_by("event_type", F.when(v.isNotNull() & t.isNotNull(), F.struct(v, t))).alias("peak"), F.count(F.lit(1)).alias("n"))
    ahead = F.round(F.col("l") - F.col("r"), 9)
    side = F.when(ahead > 0, "left").when(ahead < 0, "right")
    return e.withColumns({"side": side, "focal": F.col("top") > 5, "general": F.col("share") > 0.15, "confident": F.col("whole") > 1})


@query("tx17_structured_report", f"""WITH {_DESC} SELECT user_id, CASE WHEN focal OR general THEN concat_ws(' / ', CASE WHEN focal THEN 'focus: ' || concat_ws(' ', side, peak) || ', theta' END, CASE WHEN general THEN 'general' || CASE WHEN share > 0.2 THEN ': diffuse' ELSE '' END END) ELSE 'kind not stated' END AS report FROM dd""")
def tx17(spark, sf):
    topography = F.when(F.col("share") > 0.2, "diffuse").otherwise("unspec")
    return descriptors(spark, sf).select("user_id", T.structured_report(F.col("focal"), F.col("side"), F.col("peak"), F.lit("theta"), F.col("general"), topography, F.lit("nan")).alias("report"))


@query("tx16_paragraph", f"""WITH {_DESC}, s AS (SELECT user_id, focal, general, confident, episodes, concat_ws(' ', side, 'region') AS sp, printf('%.1f', round(whole, 1) + 0.0) AS w, printf('%.1f', round(top, 1)) AS f, printf('%.0f', round(share * 100, 0)) AS pc, printf('%.1f', round(n / 10.0, 1)) AS lo, peak, coalesce(' (top region ' || peak || ')', '') AS rg FROM dd)
  SELECT user_id, concat_ws(' ', CASE WHEN focal AND general THEN 'Diffuse theta slowing, strongest in a focus: ' || sp || rg || '.' WHEN focal THEN 'Focus of theta slowing: ' || sp || rg || '.' WHEN NOT focal THEN 'Diffuse theta slowing: ' || sp || '.' END,
    'Deviation from the norm of age and state: ' || CASE WHEN focal AND general THEN w || ' SD overall, ' || f || ' SD in the focus.' WHEN focal THEN f || ' SD in the focus.' ELSE w || ' SD.' END, 'Segments above it: ' || pc || ' %, some.',
    CASE WHEN episodes > 0 THEN 'Runs: ' || episodes || ', at most ' || lo || ' min.' END, 'States: ' || nullif(peak, '') || '.', CASE WHEN focal AND NOT general AND NOT confident THEN 'Nothing localises the focus beyond the normal range.' END) AS paragraph FROM s""")
def tx16(spark, sf):
    """Of a recording without a known value nothing is said, nor a region or states where no stage is known; -0 is written as 0."""
    d = descriptors(spark, sf)
    r = lambda c, k: F.round(F.col(c), k) if isinstance(c, str) else F.round(c, k)
    spatial = F.concat_ws(" ", "side", F.lit("region"))
    p = T.report_paragraph(spatial, F.lit("theta"), F.col("focal"), F.col("general"), F.col("peak"), r("whole", 1), r("top", 1), F.lit(None).cast("string"), r(F.col("share") * 100, 0) / 100, F.lit("some"), F.col("episodes"), r(F.col("n") / 10, 1), F.col("peak"), F.col("confident"))
    return d.select("user_id", p.alias("paragraph"))


@query("j17_assigned_class", """SELECT l_orderkey AS eeg_id, CAST(l_linenumber AS BIGINT) AS segment, CAST(k AS INT) AS predicted, round(CASE k WHEN 0 THEN l_quantity WHEN 1 THEN l_discount * 100 ELSE l_tax * 100 END / 60, 6) AS p_assigned FROM lineitem JOIN (SELECT o_orderkey, o_custkey % 3 AS k FROM orders) ON l_orderkey = o_orderkey""")
def j17(spark, sf):
    """Class probabilities by (recording, segment) joined with the class that the recording was given."""
    probs = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("eeg_id"), F.col("l_linenumber").cast("long").alias("segment"), F.array(F.col("l_quantity") / 60, F.col("l_discount") * 100 / 60, F.col("l_tax") * 100 / 60).alias("p"))
    given = table(spark, sf, "orders").select(F.col("o_orderkey").alias("eeg_id"), (F.col("o_custkey") % 3).cast("int").alias("predicted"))
    return rounded(probs.join(given, "eeg_id").select("eeg_id", "segment", "predicted", F.element_at("p", F.col("predicted") + 1).alias("p_assigned")))


@query("a01_region_features", f"""WITH {POW}, r AS (SELECT eeg_id, CASE WHEN channel <= 2 THEN 'front' WHEN channel <= 4 THEN 'middle' ELSE 'back' END AS region, avg(CASE WHEN alpha > 0 THEN delta END) AS delta, avg(CASE WHEN alpha > 0 THEN theta END) AS theta, avg(CASE WHEN alpha > 0 THEN alpha END) AS alpha,
  avg(CASE WHEN alpha > 0 THEN beta END) AS beta, avg(CASE WHEN alpha > 0 THEN gamma END) AS gamma, avg(CASE WHEN alpha > 0 THEN total END) AS total FROM pw GROUP BY ALL)
  SELECT eeg_id, region, round(ln(delta+1e-12),6) AS log_delta, round(ln(theta+1e-12),6) AS log_theta, round(ln(alpha+1e-12),6) AS log_alpha, round(ln(beta+1e-12),6) AS log_beta, round(ln(gamma+1e-12),6) AS log_gamma, round(ln(total+1e-12),6) AS log_total,
  round(delta/(total+1e-12),6) AS rel_delta, round(theta/(total+1e-12),6) AS rel_theta, round(alpha/(total+1e-12),6) AS rel_alpha, round(ln((delta+1e-12)/(alpha+1e-12)),6) AS log_dar, round(ln((theta+1e-12)/(alpha+1e-12)),6) AS log_tar, round(ln((delta+1e-12)/(theta+1e-12)),6) AS log_dtr, round((delta+theta)/(total+1e-12),6) AS low_freq_rel FROM r""")
def a01(spark, sf):
    bridge = spark.createDataFrame([(c, "front" if c <= 2 else "middle" if c <= 4 else "back") for c in range(1, 8)], "channel long, region string")
    return rounded(A.region_features(powers(spark, sf), bridge, ["eeg_id"], F.col("alpha") > 0, S.band_features, [*S.BANDS, "total"]))


@query("a20_recording_table", f"WITH {SEG}, a AS (SELECT eeg_id, quantile_cont(y, 0.5) AS y, count(*) AS usable FROM seg WHERE NOT artifact GROUP BY 1), b AS (SELECT eeg_id, quantile_cont(value / 200, 0.9) AS gate, count(*) AS rows FROM seg GROUP BY 1) SELECT eeg_id, round(y, 6) AS y, usable, round(gate, 6) AS gate, rows FROM a FULL JOIN b USING (eeg_id)")
def a20(spark, sf):
    s = segments(spark, sf)
    of_a = [F.percentile("y", F.lit(0.5)).alias("y"), F.count(F.lit(1)).alias("usable")]
    return rounded(A.joined_scans(s.where(~F.col("artifact")), s, ["eeg_id"], of_a, [F.percentile(F.col("value") / 200, F.lit(0.9)).alias("gate"), F.count(F.lit(1)).alias("rows")]))


@query("a27_stage_group_medians", f"WITH {SEG} SELECT eeg_id, round(quantile_cont(y, 0.5) FILTER (stage IN ('click', 'view')), 6) AS awake_median, round(quantile_cont(y, 0.5) FILTER (stage IN ('purchase', 'signup')), 6) AS asleep_median, count(*) FILTER (stage IN ('click', 'view')) AS awake_n, count(*) FILTER (stage IN ('purchase', 'signup')) AS asleep_n, eeg_id % 2 = 0 AS is_case FROM seg GROUP BY 1")
def a27(spark, sf):
    groups = {"awake": F.col("stage").isin("click", "view"), "asleep": F.col("stage").isin("purchase", "signup")}
    return rounded(A.by_condition(segments(spark, sf), ["eeg_id"], "y", groups).withColumn("is_case", F.col("eeg_id") % 2 == 0))


@query("a30_stage_summary", f"WITH {SEG}, a AS (SELECT eeg_id, stage, avg(y) AS y FROM seg WHERE NOT artifact GROUP BY ALL), b AS (SELECT eeg_id, stage, avg(value) AS value, count(*) AS n FROM seg GROUP BY ALL) SELECT eeg_id, stage, round(y, 6) AS y, round(value, 6) AS value, n FROM a FULL JOIN b USING (eeg_id, stage)")
def a30(spark, sf):
    s = segments(spark, sf)
    return rounded(A.joined_scans(s.where(~F.col("artifact")), s, ["eeg_id", "stage"], [F.avg("y").alias("y")], [F.avg("value").alias("value"), F.count(F.lit(1)).alias("n")]))


@query("a37_dose_response", """WITH d AS (SELECT o_orderpriority AS category, o_totalprice AS v FROM orders), s AS (SELECT category, count(*) AS n, avg(v) AS mean, quantile_cont(v, 0.5) AS median, var_samp(v) AS vr FROM d GROUP BY 1), z AS (SELECT * FROM s WHERE category = '5-LOW'),
  p AS (SELECT o.category AS f, true AS g, o.v FROM d o WHERE category <> '5-LOW' UNION ALL SELECT s.category, false, d.v FROM d JOIN s ON s.category <> '5-LOW' WHERE d.category = '5-LOW'),
  r AS (SELECT f, g, v, rank() OVER (PARTITION BY f ORDER BY v) + (count(*) OVER (PARTITION BY f, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY f, v) AS t FROM p),
  u AS (SELECT f, CAST(count(*) FILTER (g) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT g) AS DOUBLE) AS n2, sum(r) FILTER (g) AS r1, sum(t * t - 1.0) AS ties FROM r GROUP BY 1),
  w AS (SELECT f, n1, n2, r1 - n1 * (n1 + 1) / 2 AS u, sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS sd FROM u)
  SELECT s.category, s.n, round(s.mean, 4) AS mean, round(s.median, 4) AS median, round(CASE WHEN s.category <> '5-LOW' THEN (s.mean - z.mean) / sqrt(((s.n - 1) * s.vr + (z.n - 1) * z.vr) / (s.n + z.n - 2)) END, 4) AS d, round(2 * u / (n1 * n2) - 1, 4) AS rank_biserial, round(sign(u - n1 * n2 / 2) * greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sd, 4) AS z
  FROM s, z LEFT JOIN w ON w.f = s.category""")
def a37(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("category"), F.col("o_totalprice").alias("v"))
    return rounded(ST.dose_response(o, "category", "v", "5-LOW"), 4)


@query("w08_first_hour_pick", f"WITH {SEG}, m AS (SELECT eeg_id, min(stage) AS preferred FROM seg GROUP BY 1) SELECT eeg_id, segment, stage, round(y, 6) AS y FROM seg JOIN m USING (eeg_id) WHERE segment * 14 < 140 QUALIFY row_number() OVER (PARTITION BY eeg_id ORDER BY CAST(stage = preferred AS INT) DESC, y DESC, segment) = 1")
def w08(spark, sf):
    s = segments(spark, sf)
    s = s.join(s.groupBy("eeg_id").agg(F.min("stage").alias("preferred")), "eeg_id").withColumn("start", F.col("segment") * 14)
    return rounded(W.best_segment(s, "eeg_id", "start", "stage", "preferred", "y", within=140).select("eeg_id", "segment", "stage", "y"))


@query("w14_halves", "SELECT c_custkey, CASE WHEN CAST('0x' || md5('0|' || c_nationkey)[1:8] AS BIGINT) % 2 = 0 THEN 'reference' ELSE 'held_out' END AS half FROM customer WHERE c_acctbal > 0")
def w14(spark, sf):
    return W.halves(table(spark, sf, "customer").where("c_acctbal > 0"), "c_nationkey").select("c_custkey", "half")


@query("w16_balanced_selection", """WITH k AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'priority' WHEN c_acctbal > 5000 THEN 'positive' ELSE 'negative' END AS picked_as FROM customer)
  SELECT c_custkey, picked_as FROM k QUALIFY row_number() OVER (PARTITION BY picked_as ORDER BY md5('0|' || c_custkey), c_custkey) <= CASE WHEN picked_as = 'priority' THEN 10 ELSE 40 END""")
def w16(spark, sf):
    return W.balanced_selection(table(spark, sf, "customer"), F.col("c_acctbal") > 5000, F.col("c_mktsegment") == "MACHINERY", "c_custkey", 40, 10).select("c_custkey", "picked_as")


@query("w19_argmax", f"WITH {POW}, z AS (SELECT eeg_id, channel, (theta - 36) / 19.7 AS z FROM pw) SELECT eeg_id, arg_max(channel, (z, channel)) FILTER (z IS NOT NULL) AS argmax, round(max(z), 6) AS top, round(quantile_cont(z, 0.5), 6) AS mid, round(min(z), 6) AS low, round(avg(CAST(z > 0.5 AS DOUBLE)), 6) AS extent FROM z GROUP BY 1")
def w19(spark, sf):
    z = powers(spark, sf).select("eeg_id", "channel", ((F.col("theta") - 36) / 19.7).alias("z"))
    return rounded(W.peaks(z, ["eeg_id"], "channel", "z", 0.5))


@query("w21_exemplars", """SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY CAST(p_type LIKE 'S%' AS INT) DESC, p_size DESC, p_partkey) = 1""")
def w21(spark, sf):
    p = table(spark, sf, "part").withColumn("small", F.col("p_type").startswith("S").cast("int"))
    return W.exemplars(p, "p_brand", ["small", "p_size"], "p_partkey").select("p_brand", "p_partkey")


@query("set02_set03_selection", """WITH ids AS (SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0)
  SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'panel' WHEN nullif(c_acctbal, 0) > 1000 THEN 'keeper' ELSE 'drop' END AS part FROM customer WHERE c_custkey IN (SELECT k FROM ids)""")
def set02(spark, sf):
    c = table(spark, sf, "customer")
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    some = W.selected(c, "c_custkey", [urgent, c.where("c_acctbal < 0")])
    return W.partitioned(some, F.nullif(F.col("c_acctbal"), F.lit(0.0)) > 1000, F.col("c_mktsegment") == "BUILDING").select("c_custkey", "part")


_LB = "lb AS (SELECT doc_id, quality, CAST(n_chars AS DOUBLE) AS x, toxic * 500.0 + n_chars AS y FROM labels JOIN documents USING (doc_id))"


@query("st_a18_residual_ranking", f"""WITH {_LB}, c AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM lb), r AS (SELECT quality, round(y - a - b * x, 6) AS r FROM lb, c), k AS (SELECT quality, rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2.0 AS k FROM r)
  SELECT CAST(sum(quality) AS DOUBLE) AS positives, CAST(sum(1 - quality) AS DOUBLE) AS negatives, round((sum(k) FILTER (quality = 1) - sum(quality) * (sum(quality) + 1) / 2) / (sum(quality) * sum(1 - quality)), 3) AS auroc FROM k""")
def st_a18(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("x"))
    lb = table(spark, sf, "labels").join(d, "doc_id").withColumn("y", F.col("toxic") * 500.0 + F.col("x"))
    out = ST.residual(lb, "y", "x").withColumn("residual", F.round("residual", 6))
    return rounded(ST.auroc(out, "quality", "residual"), 3)


@query("st_a20_median_interval", f"""WITH b AS (SELECT unnest(range(40)) AS r), d AS (SELECT r, value, CAST('0x' || md5('0|' || r || '|' || user_id)[1:8] AS BIGINT) / 4294967296.0 AS u FROM events, b),
  w AS (SELECT r, value, sum({' + '.join(f'CAST(u >= {s} AS INT)' for s in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119))}) AS w FROM d GROUP BY 1, 2),
  c AS (SELECT r, value, sum(w) OVER (PARTITION BY r ORDER BY value) AS c, sum(w) OVER (PARTITION BY r) AS t FROM w WHERE w > 0), m AS (SELECT r, min(value) AS m FROM c WHERE 2 * c >= t GROUP BY 1)
  SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, count(*) AS replicates FROM m""")
def st_a20(spark, sf):
    return rounded(ST.interval(ST.bootstrap_median(table(spark, sf, "events").select("user_id", "value"), "value", "user_id", 40), "median"))
