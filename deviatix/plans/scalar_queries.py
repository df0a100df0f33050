"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..registry import query
from .tables import POW, powers, rounded, table



def _cols():
    return {k: F.col(k) for k in [*S.BANDS, "total"]}


@query("p01_band_features", f"""WITH {POW} SELECT eeg_id, channel, round(ln(delta+1e-12),6) AS log_delta, round(ln(theta+1e-12),6) AS log_theta, round(ln(alpha+1e-12),6) AS log_alpha,
  round(ln(beta+1e-12),6) AS log_beta, round(ln(gamma+1e-12),6) AS log_gamma, round(ln(total+1e-12),6) AS log_total, round(delta/(total+1e-12),6) AS rel_delta, round(theta/(total+1e-12),6) AS rel_theta,
  round(alpha/(total+1e-12),6) AS rel_alpha, round(ln((delta+1e-12)/(alpha+1e-12)),6) AS log_dar, round(ln((theta+1e-12)/(alpha+1e-12)),6) AS log_tar, round(ln((delta+1e-12)/(theta+1e-12)),6) AS log_dtr,
  round((delta+theta)/(total+1e-12),6) AS low_freq_rel FROM pw""")
def p01(spark, sf):
    return rounded(powers(spark, sf).select("eeg_id", "channel", *[c.alias(k) for k, c in S.band_features(_cols()).items()]))


def _shown(v: str, digits: int) -> str:
    """Rounded, but for the huge ratios to a power of 0."""
    return f"CASE WHEN abs({v}) < 1e6 THEN round({v}, {digits}) ELSE {v} END"


@query("p02_feature_vector", "WITH " + POW + " SELECT eeg_id, channel, " + ", ".join(f"round({b},6) AS {b}" for b in [*S.BANDS, "total"]) + ", " + ", ".join(f"round({b}/(total+1e-12),6) AS rel_{b}" for b in S.BANDS) + ", " + ", ".join(f"{_shown(f'({a}/({b}+1e-12))', 3)} AS {a}_{b}" for a in S.BANDS for b in S.BANDS if a != b) + " FROM pw")
def p02(spark, sf):
    """All rows; ratios to a power of 0 are huge and not rounded."""
    v = S.feature_vector(_cols())
    digits = lambda k: 3 if "_" in k and not k.startswith("rel_") else 6
    return powers(spark, sf).select("eeg_id", "channel", *[F.when(F.abs(c) < 1e6, F.round(c, digits(k))).otherwise(c).alias(k) for k, c in v.items()])


@query("p03_p04_back_transform_log_age", """SELECT c_custkey, round(log10(c_custkey % 90 + 1.0/12), 6) AS t, round(exp(ln(c_custkey % 90 + 1)), 6) AS back FROM customer""")
def p03(spark, sf):
    age = (F.col("c_custkey") % 90).cast("double")
    return rounded(table(spark, sf, "customer").select("c_custkey", S.log_age(age).alias("t"), F.exp(F.log(age + 1)).alias("back")))


@query("p05_age_bands", """SELECT band, count(*) AS n FROM (SELECT CASE WHEN a < 1 THEN '0-1' WHEN a < 6 THEN '1-5' WHEN a < 13 THEN '6-12' WHEN a < 18 THEN '13-17' WHEN a < 45 THEN '18-44' WHEN a < 60 THEN '45-59' WHEN a < 75 THEN '60-74' ELSE '75+' END AS band
  FROM (SELECT c_custkey % 100 AS a FROM customer)) GROUP BY band""")
def p05(spark, sf):
    return table(spark, sf, "customer").groupBy(S.banded(F.col("c_custkey") % 100, S.AGE_EDGES, S.AGE_LABELS).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("p06_p07_valid_usable", f"WITH {POW} SELECT eeg_id, channel, CASE WHEN least(delta,theta,alpha,beta,gamma,total) > 0 THEN round(delta,6) END AS value FROM pw WHERE NOT (stage = 'R')")
def p06(spark, sf):
    p = powers(spark, sf).where(~(F.col("stage") == "R"))
    return rounded(p.select("eeg_id", "channel", S.only_if_positive(F.col("delta"), [F.col(k) for k in [*S.BANDS, "total"]]).alias("value")))


@query("p08_p09_p11_identity", """SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'F' WHEN o_custkey % 3 = 1 THEN 'M' ELSE 'unknown' END AS sex,
  CAST(o_custkey AS VARCHAR) || '_' || strftime(o_orderdate, '%Y%m%d%H%M%S') AS eeg_id FROM orders""")
def p08(spark, sf):
    o = table(spark, sf, "orders")
    code = F.element_at(F.array(F.lit("female "), F.lit("8507"), F.lit("x")), (F.col("o_custkey") % 3 + 1).cast("int"))
    pid = S.clean_id(F.concat(F.col("o_custkey").cast("string"), F.lit(".0")))
    return o.select("o_orderkey", S.sex(code).alias("sex"), F.concat_ws("_", pid, S.time_key(F.col("o_orderdate"))).alias("eeg_id"))


@query("p10_duration", """SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN p_size * 3600 + 120 + 5 WHEN 1 THEN p_size * 60 + 30 WHEN 2 THEN p_size END AS DOUBLE) AS seconds FROM part""")
def p10(spark, sf):
    s = F.col("p_size").cast("string")
    text = F.when(F.col("p_partkey") % 4 == 0, F.concat(s, F.lit(":02:05"))).when(F.col("p_partkey") % 4 == 1, F.concat(s, F.lit(":30"))).when(F.col("p_partkey") % 4 == 2, s).otherwise("n/a")
    return table(spark, sf, "part").select("p_partkey", S.duration_seconds(text).alias("seconds"))


@query("p12_best_age", """SELECT c_custkey, CASE WHEN age > 89 THEN 90.0 ELSE age END AS age, src FROM (SELECT c_custkey, coalesce(a, b) AS age, CASE WHEN a IS NOT NULL THEN 'direct' WHEN b IS NOT NULL THEN 'integer' END AS src FROM
  (SELECT c_custkey, CASE WHEN round(c_acctbal/50,3) BETWEEN 0 AND 110 THEN round(c_acctbal/50,3) END AS a, CASE WHEN c_custkey % 130 BETWEEN 0 AND 110 THEN CAST(c_custkey % 130 AS DOUBLE) END AS b FROM customer))""")
def p12(spark, sf):
    age, src = S.best_age([("direct", F.round(F.col("c_acctbal") / 50, 3)), ("integer", (F.col("c_custkey") % 130).cast("double"))])
    return table(spark, sf, "customer").select("c_custkey", age.alias("age"), src.alias("src"))


@query("p13_roles", """SELECT CASE WHEN p_size % 5 = 0 THEN 'control' WHEN f AND g THEN 'both' WHEN f THEN 'focal_only' WHEN g THEN 'gen_only' ELSE 'other' END AS role, count(*) AS n
  FROM (SELECT p_size, p_size % 2 = 0 AS f, p_size % 3 = 0 AS g FROM part) GROUP BY 1""")
def p13(spark, sf):
    p = F.col("p_size")
    return table(spark, sf, "part").groupBy(S.role(p % 5 == 0, p % 2 == 0, p % 3 == 0).alias("role")).agg(F.count(F.lit(1)).alias("n"))


@query("p14_p15_inclusion_night", """SELECT p_partkey, (p_size % 7 <> 0 AND p_size * 20 >= 300 AND p_size >= 20 AND (p_size % 10) / 10.0 >= 0.2) AS included,
  CASE WHEN p_size % 7 <> 0 AND p_size * 20 >= 300 AND p_size >= 20 AND (p_size % 10) / 10.0 >= 0.2 THEN NULL WHEN p_size % 7 <> 0 THEN 'unusable:short_or_artifact' WHEN p_size % 2 = 0 THEN 'noedf' ELSE 'not_processed' END AS reason,
  (p_size >= (24 - p_partkey % 24) % 24 + 5 AND p_size >= 6 AND p_size < 48) AS night FROM part""")
def p14(spark, sf):
    s = F.col("p_size")
    inc, why = S.exclusion(s % 7 != 0, s * 20, s, (s % 10) / 10, F.when(s % 2 == 0, "noedf"))
    return table(spark, sf, "part").select("p_partkey", inc.alias("included"), why.alias("reason"), S.spans_night(s, F.col("p_partkey") % 24).alias("night"))


@query("p18_p25_words", f"""WITH {POW} SELECT eeg_id, channel, CASE WHEN r > 1.643 THEN 'delta' WHEN r < 0.515 THEN 'theta' ELSE 'theta-delta' END AS band, CASE WHEN s > 0.25 THEN 'left' WHEN s < -0.25 THEN 'right' ELSE 'bilateral' END AS side,
  CASE WHEN g > 1.645 THEN 'frontally predominant' WHEN g < -1.645 THEN 'posteriorly predominant' ELSE 'diffuse' END AS gradient,
  CASE WHEN alpha/10 < 0.01 THEN 'rare' WHEN alpha/10 < 0.1 THEN 'occasional' WHEN alpha/10 < 0.5 THEN 'frequent' WHEN alpha/10 < 0.9 THEN 'abundant' ELSE 'continuous' END AS prevalence,
  CASE WHEN channel = 7 THEN 'rhythmic delta activity' WHEN delta > 0 AND theta > 0 AND least(delta,theta)/greatest(delta,theta) > 0.5 THEN 'mixed theta/delta slowing' WHEN delta >= theta THEN 'delta slowing' ELSE 'theta slowing' END AS phrase
  FROM (SELECT *, ln((delta+1e-12)/(theta+1e-12)) AS r, (alpha - beta)/10 AS s, (delta - theta)/10 AS g FROM pw)""")
def p18(spark, sf):
    d, t, a, b = (F.col(x) for x in ("delta", "theta", "alpha", "beta"))
    return powers(spark, sf).select("eeg_id", "channel", S.band_call(F.log((d + 1e-12) / (t + 1e-12))).alias("band"), S.side_call((a - b) / 10).alias("side"), S.gradient_word((d - t) / 10).alias("gradient"), S.prevalence_word(a / 10).alias("prevalence"), S.band_phrase(d, t, F.col("channel") == 7).alias("phrase"))


@query("p16_p20_p21_focality", f"""WITH {POW}, x AS (SELECT eeg_id, channel, CASE WHEN stage = 'R' THEN -delta ELSE delta END AS oriented, alpha AS te, beta AS fr, gamma AS po FROM pw),
  e AS (SELECT *, te - (fr + po)/2 AS ft, fr - (te + po)/2 AS ff, po - (te + fr)/2 AS fp FROM x)
  SELECT eeg_id, channel, round(oriented,6) AS oriented, CASE WHEN round(ft,6) = round(greatest(ft,ff,fp),6) THEN 'temporal' WHEN round(ff,6) = round(greatest(ft,ff,fp),6) THEN 'frontal' ELSE 'posterior' END AS lobe,
  least(te,fr,po) >= 1.0 AS generalized FROM e""")
def p16(spark, sf):
    lobes = {k: F.round(v, 6) for k, v in S.lobe_excess({"temporal": F.col("alpha"), "frontal": F.col("beta"), "posterior": F.col("gamma")}).items()}
    best = F.greatest(*lobes.values())
    lobe = F.when(lobes["temporal"] == best, "temporal").when(lobes["frontal"] == best, "frontal").otherwise("posterior")
    return rounded(powers(spark, sf).select("eeg_id", "channel", S.oriented(F.col("stage"), F.col("delta"), ["R"]).alias("oriented"), lobe.alias("lobe"), (F.least("alpha", "beta", "gamma") >= 1.0).alias("generalized")))


@query("p23_topography", """WITH b AS (SELECT o_custkey, o_orderpriority AS region, round(avg(o_totalprice)/60000, 3) AS burden FROM orders GROUP BY 1, 2),
  s AS (SELECT o_custkey, list_sort(list(burden)) AS v, count(*) FILTER (burden >= 2) AS abn FROM b GROUP BY 1),
  d AS (SELECT o_custkey, abn, v[-1] / (coalesce(list_aggregate(v[1:len(v)-1], 'median'), NULL) + 1e-12) AS ratio, abs(o_custkey % 7 - 3) >= 2 AS asym FROM s)
  SELECT o_custkey, CASE WHEN abn = 0 THEN 'none' WHEN abn >= 2 AND ratio < 1.8 AND NOT asym THEN 'generalized' WHEN ratio >= 1.8 AND asym THEN 'focal' WHEN asym THEN 'lateralized' WHEN abn >= 2 THEN 'multifocal' ELSE 'focal' END AS class FROM d""")
def p23(spark, sf):
    b = table(spark, sf, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("region")).agg(F.round(F.avg("o_totalprice") / 60000, 3).alias("burden"))
    m = b.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("region", "burden"))).alias("m"))
    return m.select("o_custkey", S.topography(F.col("m"), (F.col("o_custkey") % 7 - 3)).alias("class"))


@query("p24_blind_arm", """SELECT o_orderkey, CAST(strpos('0123456789abcdef', substr(md5(CAST(o_custkey AS VARCHAR) || '|' || CAST(o_orderkey AS VARCHAR)), 32, 1)) - 1 AS INTEGER) % 2 AS arm FROM orders""")
def p24(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.blind_arm(F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("arm"))


@query("p26_guard", """SELECT user_id, max(value) < 100.0/3 AS guard, max(value) AS top FROM events GROUP BY user_id""")
def p26(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg((F.max("value") < 100.0 / 3).alias("guard"), F.max("value").alias("top"))


@query("p29_winsorise", """WITH q AS (SELECT event_type, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events GROUP BY 1)
  SELECT event_id, round(least(greatest(value, lo), hi), 6) AS value FROM events JOIN q USING (event_type)""")
def p29(spark, sf):
    from ..operators.aggregates import winsorised

    return rounded(winsorised(table(spark, sf, "events"), ["event_type"], "value").select("event_id", "value"))


@query("p30_central_average", f"WITH {POW} SELECT eeg_id, stage, round(avg(delta), 6) AS delta FROM pw WHERE channel IN (2, 3) GROUP BY 1, 2")
def p30(spark, sf):
    return rounded(powers(spark, sf).where(F.col("channel").isin(2, 3)).groupBy("eeg_id", "stage").agg(F.avg("delta").alias("delta")))
