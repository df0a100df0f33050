"""Queries of the text functions: the vocabulary is a parameter, here words of the driver's documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query
from .tables import table

# words that play the keyword, the sides and the bands in the driver's invented prose
KEY = "tion"
WORDS = T.SideWords(left=r"\bthe\b", right=r"\bof\b", diffuse=r"\band\b", right_first=r"\bin\b", left_first=r"\bwas\b")
_CL = "list_filter(string_split_regex(lower(coalesce(text, '')), '[.;\\n]'), lambda c: regexp_matches(c, 'tion'))"
# RE2's \b and DuckDB's lower() know ASCII only, so that the SQL of the sides says what Java's do: letters, digits and marks beyond ASCII are of a
# word, and a capital I with a dot becomes an i and a dot
_CL_JAVA = _CL.replace("coalesce(text, '')", "replace(coalesce(text, ''), chr(304), 'i' || chr(775))")


def _word(w: str) -> str:
    return rf"regexp_matches(c, '(?:^|[^\p{{L}}\p{{Nd}}_\p{{Mn}}]|(?:^|[^\p{{L}}\p{{Nd}}\p{{Mn}}])\p{{Mn}}+){w}(?:$|[^\p{{L}}\p{{Nd}}_\p{{Mn}}])')"


_SIDE = f"""CASE WHEN {_word('in')} THEN 'right' WHEN {_word('was')} THEN 'left' WHEN {_word('the')} AND {_word('of')} THEN 'bilateral'
  WHEN {_word('the')} THEN 'left' WHEN {_word('of')} THEN 'right' WHEN {_word('and')} THEN 'bilateral' END"""


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


@query("tx01_tx04_side_band", f"""WITH d AS (SELECT doc_id, {_CL_JAVA} AS cl FROM documents),
  s AS (SELECT doc_id, cl, list_filter(list_transform(cl, lambda c: {_SIDE}), lambda x: x IS NOT NULL) AS sides FROM d)
  SELECT doc_id, CAST(len(cl) AS BIGINT) AS n_clauses, CASE WHEN len(list_distinct(list_filter(sides, lambda x: x <> 'bilateral'))) = 1 THEN list_filter(sides, lambda x: x <> 'bilateral')[1] WHEN len(sides) > 0 THEN 'bilateral' END AS side,
  CASE WHEN len(list_filter(cl, lambda c: regexp_matches(c, 'ing'))) > 0 AND len(list_filter(cl, lambda c: regexp_matches(c, 'ment'))) > 0 THEN 'mixed' WHEN len(list_filter(cl, lambda c: regexp_matches(c, 'ing'))) > 0 THEN 'delta' WHEN len(list_filter(cl, lambda c: regexp_matches(c, 'ment'))) > 0 THEN 'theta' END AS band FROM s""")
def tx01(spark, sf):
    d = docs(spark, sf).select("doc_id", T.clauses(F.col("text"), KEY).alias("cl"))
    return d.select("doc_id", F.size("cl").cast("long").alias("n_clauses"), T.document_side(F.col("cl"), WORDS).alias("side"), T.band_word(F.col("cl"), "ing", "ment").alias("band"))


PLACES = [("north", "ing"), ("south", "ment"), ("east", "que"), ("west", "sch")]


@query("tx05_region", f"""WITH c AS (SELECT doc_id, unnest({_CL}) AS c FROM documents),
  r AS (SELECT doc_id, CASE WHEN regexp_matches(c, 'ing') THEN 1 WHEN regexp_matches(c, 'ment') THEN 2 WHEN regexp_matches(c, 'que') THEN 3 WHEN regexp_matches(c, 'sch') THEN 4 END AS k FROM c),
  n AS (SELECT doc_id, k, count(*) AS n FROM r WHERE k IS NOT NULL GROUP BY 1, 2),
  b AS (SELECT doc_id, k FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, k) = 1)
  SELECT doc_id, ['north', 'south', 'east', 'west'][k] AS region, CASE k WHEN 1 THEN 'polar' ELSE ['north', 'south', 'east', 'west'][k] END AS folded FROM documents LEFT JOIN b USING (doc_id)""")
def tx05(spark, sf):
    r = T.most_mentioned(T.clauses(F.col("text"), KEY), PLACES)
    return docs(spark, sf).select("doc_id", r.alias("region")).withColumn("folded", T.fold(F.col("region"), {"north": "polar"}))


@query("tx06_tx08_flags_conclusion", """SELECT doc_id, regexp_matches(lower(text), '\\bnormal (eeg|study|awake)|this is a normal\\b') AND NOT contains(lower(text), 'abnormal') AS normal, regexp_matches(lower(text), '\\babnormal\\b') AS abnormal,
  md5(coalesce(nullif(trim(regexp_extract(text, '(?is)(?:license|licence)\\s*:?\\s*(.*)', 1)), ''), '')) AS section, CASE WHEN nullif(trim(regexp_extract(text, '(?is)(?:license|licence)\\s*:?\\s*(.*)', 1)), '') IS NULL THEN 'none' ELSE 'section' END AS source FROM documents WHERE text IS NOT NULL""")
def tx06(spark, sf):
    n, a = T.normal_flags(F.col("text"))
    found, src = T.conclusion(F.lit(None).cast("string"), F.col("text"), T.section_pattern("license|licence"))
    return docs(spark, sf).where(F.col("text").isNotNull()).select("doc_id", n.alias("normal"), a.alias("abnormal"), F.md5(F.coalesce(found, F.lit("")).cast("binary")).alias("section"), src.alias("source"))


_CONTEXT = "array_to_string(cl, ' ')"


@query("tx07_base_labels", f"""WITH d AS (SELECT doc_id, {_CL} AS cl FROM documents), x AS (SELECT doc_id, len(cl) > 0 AS mentions, {_CONTEXT} AS c FROM d)
  SELECT doc_id, mentions, CASE WHEN contains(c, 'ing') AND contains(c, 'ment') THEN 'mixed' WHEN contains(c, 'ing') THEN 'delta' WHEN contains(c, 'ment') THEN 'theta' END AS band,
  CASE WHEN regexp_matches(c, '\\band|schaft|from\\b') THEN 'bilateral' WHEN regexp_matches(c, '\\bthe\\b') THEN 'left' WHEN regexp_matches(c, '\\bof\\b') THEN 'right' END AS side,
  CASE WHEN contains(c, 'sch') THEN 'sch' WHEN contains(c, 'que') THEN 'que' WHEN contains(c, 'ess') THEN 'ess' WHEN contains(c, 'en') THEN 'en' END AS region FROM x""")
def tx07(spark, sf):
    sides = [("bilateral", r"\band|schaft|from\b"), ("left", r"\bthe\b"), ("right", r"\bof\b")]
    found = T.base_labels(F.col("text"), KEY, sides, ["sch", "que", "ess", "en"], "ing", "ment")
    return docs(spark, sf).select("doc_id", *[c.alias(k) for k, c in found.items()])


_S = "list_filter(string_split_regex(coalesce(text, ''), '[.;\\n]'), lambda s: trim(s) <> '')"


@query("tx09_tx11_named_abnormal", f"""SELECT doc_id, len(list_filter({_S}, lambda s: regexp_matches(s, 'tion') AND NOT regexp_matches(s, ' (of|le) ') AND NOT regexp_matches(s, 'sch|ing'))) > 0 AS named,
  len(list_filter({_S}, lambda s: regexp_matches(s, 'tion') AND NOT regexp_matches(s, ' (of|le) ') AND regexp_matches(s, 'sch|ing'))) > 0 AS physiologic FROM documents""")
def tx09(spark, sf):
    args = {"keyword": KEY, "negated": " (of|le) ", "normal_state": "sch|ing"}
    return docs(spark, sf).select("doc_id", T.named_as_abnormal(F.col("text"), **args).alias("named"), T.physiologic(F.col("text"), **args).alias("physiologic"))


@query("tx12_negation_or_by_key", """WITH c AS (SELECT source, unnest(string_split_regex(lower(coalesce(text, '')), '[.;\\n]')) AS c FROM documents),
  h AS (SELECT source, regexp_matches(c, 'edth') AND NOT regexp_matches(right(regexp_extract(c, '^(.*?)(?:edth)', 1), 40), '\\b(the|of)\\b') AS hit FROM c)
  SELECT source, bool_or(hit) AS hit, count(*) FILTER (hit) AS n FROM h GROUP BY source""")
def tx12(spark, sf):
    d = table(spark, sf, "documents").select("source", F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[.;\n]")).alias("c"))
    hit = T.mentioned_unnegated(F.col("c"), "edth", r"\b(the|of)\b")
    return d.select("source", hit.alias("hit")).groupBy("source").agg(F.bool_or("hit").alias("hit"), F.count_if("hit").alias("n"))


@query("tx13_scrub")
def tx13(spark, sf):
    """All texts. RE2 knows no words and digits beyond ASCII, so SQL can't say it; a plain version in the tests does."""
    d = docs(spark, sf).where(F.col("text").isNotNull())
    return d.select("doc_id", F.md5(T.scrubbed(F.col("text")).cast("binary")).alias("scrubbed"))


@query("tx14_tx15_snippet", f"""WITH s AS (SELECT doc_id, text, array_to_string(list_transform(list_filter({_S}, lambda s: regexp_matches(s, 'tion'))[1:2], lambda s: trim(s)), '. ') AS j FROM documents)
  SELECT doc_id, CASE WHEN length(j) <= 120 THEN j ELSE regexp_replace(substr(j, 1, 120), '\\s+\\S*$', '') END AS snippet, contains(lower(text), 'report') AS has_report FROM s WHERE text IS NOT NULL AND NOT contains(text, chr(160))""")
def tx14(spark, sf):
    d = docs(spark, sf).where(F.col("text").isNotNull())
    return d.select("doc_id", T.snippet(F.col("text"), KEY).alias("snippet"), F.contains(F.lower("text"), F.lit("report")).alias("has_report"))


_N = "substr(regexp_replace(lower(s), '[^a-z0-9]', '', 'g'), 1, 60)"
_HALF = _S.replace("text", "substr(text, 1, CAST(floor(length(text) / 2) AS BIGINT))")


@query("tx14_not_repeated", f"WITH s AS (SELECT doc_id, {_S} AS own, list_transform({_HALF}, lambda s: {_N}) AS theirs FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5(array_to_string(list_transform(list_filter(own, lambda s: NOT list_contains(theirs, {_N})), lambda s: trim(s)), '. ')) AS rest FROM s")
def tx14_rest(spark, sf):
    """The sentences of a text that its first half doesn't have."""
    d = docs(spark, sf).where(F.col("text").isNotNull())
    half = F.substr(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    return d.select("doc_id", F.md5(T.not_repeated(F.col("text"), half).cast("binary")).alias("rest"))


@query("tx16_tx17_sentence", """SELECT p_partkey, CASE WHEN p_size % 11 = 0 THEN 'No statement is made.' ELSE CASE p_size % 3 WHEN 0 THEN 'Delta' WHEN 1 THEN 'Theta' ELSE 'Mixed' END || ' slowing, ' || CASE WHEN p_size % 2 = 0 THEN 'left temporal' ELSE 'right temporal' END || ', in ' || CAST(p_size AS VARCHAR) || ' % of segments.' END AS line FROM part""")
def tx16(spark, sf):
    s = F.col("p_size")
    band = F.when(s % 3 == 0, "delta").when(s % 3 == 1, "theta")
    return table(spark, sf, "part").select("p_partkey", T.finding_line(F.when(s % 2 == 0, "left").otherwise("right"), F.lit("temporal"), band, F.when(s % 11 != 0, s / 100)).alias("line"))


@query("tx18_channel_labels", """SELECT n_nationkey, ['T3', 'T4', 'T5', 'T6', 'CZ'][n_nationkey % 5 + 1] AS label FROM nation""")
def tx18(spark, sf):
    raw = F.element_at(F.array(*[F.lit(x) for x in ("EEG T7-Ref", " t8", "eeg P7-LE", "P8-A1", "Cz ")]), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return table(spark, sf, "nation").select("n_nationkey", T.channel_label(raw).alias("label"))


_RAW = "p_name || '-' || p_brand"
_LABEL = f"regexp_replace(regexp_replace(regexp_replace(upper(trim({_RAW})), '^(?:(?:SMALL|RED|OLD)\\s+)?(?:(?:SMALL|RED|OLD)-)?', ''), '-.*$', ''), '[\\s.]+', '', 'g')"


@query("tx18_label_kinds", f"""WITH s AS (SELECT p_partkey, {_LABEL} AS s FROM part), e AS (SELECT p_partkey, CASE WHEN s IN ('BLUERING', 'RING') THEN s ELSE regexp_replace(s, '^(.+)(?:ING|OLT)$', '\\1') END AS e FROM s),
  l AS (SELECT p_partkey, CASE e WHEN 'ROD' THEN 'BAR' WHEN 'PLATE' THEN 'SHEET' ELSE e END AS label FROM e)
  SELECT p_partkey, label, CASE WHEN label IN ('BAR', 'SHEET', 'HOTB') THEN 'stock' WHEN label IN ('RING', 'BLUERING', 'BAR') THEN 'round' WHEN label IN ('GEAR', 'COLDGEAR', 'GIZMO') THEN 'machine' END AS kind FROM l""")
def tx18_kinds(spark, sf):
    """Names of parts as labels: the first word is the kind, the brand the reference."""
    raw = F.concat("p_name", F.lit("-"), "p_brand")
    label = T.channel_label(raw, {"ROD": "BAR", "PLATE": "SHEET"}, ("SMALL", "RED", "OLD"), ("ING", "OLT"), ["BLUERING", "RING"])
    kinds = {"stock": ["BAR", "SHEET", "HOTB"], "round": ["RING", "BLUERING", "BAR"], "machine": ["GEAR", "COLDGEAR", "GIZMO"]}
    return table(spark, sf, "part").select("p_partkey", label.alias("label")).withColumn("kind", T.label_kind(F.col("label"), kinds))
