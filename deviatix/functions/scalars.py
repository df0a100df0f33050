"""Column functions: band features, ages, identities, roles, descriptor words. All native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12
#: Age bands of the coverage report: lower edges (left-closed) and labels. Fixed values.
AGE_EDGES = [0, 1, 6, 13, 18, 45, 60, 75, 200]
AGE_LABELS = ["0-1", "1-5", "6-12", "13-17", "18-44", "45-59", "60-74", "75+"]
#: Bands in the order of the feature vector. Fixed values.
BANDS = ["delta", "theta", "alpha", "beta", "gamma"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def band_features(p: dict[str, Column]) -> dict[str, Column]:
    """The 13 derived features of band powers (keys of BANDS and total): logs, shares and log ratios."""
    log = lambda x: F.log(x + EPS)
    out = {f"log_{b}": log(p[b]) for b in [*BANDS, "total"]}
    out |= {f"rel_{b}": p[b] / (p["total"] + EPS) for b in ("delta", "theta", "alpha")}
    ratio = lambda a, b: F.log((p[a] + EPS) / (p[b] + EPS))
    return out | {"log_dar": ratio("delta", "alpha"), "log_tar": ratio("theta", "alpha"), "log_dtr": ratio("delta", "theta"), "low_freq_rel": (p["delta"] + p["theta"]) / (p["total"] + EPS)}


def feature_vector(p: dict[str, Column]) -> dict[str, Column]:
    """31 features: powers, shares of the total, and all ordered pairwise ratios."""
    out = {b: p[b] for b in [*BANDS, "total"]} | {f"rel_{b}": p[b] / (p["total"] + EPS) for b in BANDS}
    return out | {f"{a}_{b}": p[a] / (p[b] + EPS) for a in BANDS for b in BANDS if a != b}


def only_if_positive(value: Column, powers: list[Column]) -> Column:
    """A measurement counts only if all its powers are positive."""
    return F.when(F.least(*powers) > 0, value)


def log_age(age: Column) -> Column:
    return F.log10(age + 1 / 12)


def banded(x: Column, edges: list[float], labels: list[str], right: bool = False) -> Column:
    """Label of the interval that holds x: [a, b), or (a, b] with ``right``; null outside."""
    out = None
    for a, b, label in zip(edges, edges[1:], labels, strict=False):
        inside = (x > a) & (x <= b) if right else (x >= a) & (x < b)
        out = (F.when if out is None else out.when)(inside, label)
    return out


def sex(x: Column) -> Column:
    """F, M or unknown, from letters, words or the codes 8532 and 8507."""
    s = F.upper(F.trim(x.cast("string")))
    return F.when(s.isin("F", "FEMALE", "8532"), "F").when(s.isin("M", "MALE", "8507"), "M").otherwise("unknown")


def clean_id(x: Column) -> Column:
    """An id that went through a float column."""
    return F.regexp_replace(F.trim(x.cast("string")), r"\.0$", "")


def duration_seconds(x: Column) -> Column:
    """HH:MM:SS, MM:SS or a number of seconds; null otherwise."""
    parts = F.transform(F.split(F.trim(x), ":"), lambda v: v.try_cast("double"))
    return F.when(F.size(parts) <= 3, F.aggregate(parts, F.lit(0.0), lambda acc, v: acc * 60 + v))


def epoch(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp, as it reads, in any session time zone."""
    base = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", base, ts.cast("timestamp_ntz")) / 1e6


def time_key(ts: Column) -> Column:
    """14 digits."""
    return F.date_format(ts, "yyyyMMddHHmmss")


def best_age(candidates: list[tuple[str, Column]], top: float = 90.0, most: float = 110.0) -> tuple[Column, Column]:
    """(age, source): the first candidate within 0..most; ages over 89 are coded as ``top``."""
    valid = [(n, F.when((c >= 0) & (c <= most), c)) for n, c in candidates]
    age = F.coalesce(*[c for _, c in valid])
    source = F.coalesce(*[F.when(c.isNotNull(), n) for n, c in valid])
    return F.when(age > 89, top).otherwise(age), source


def role(normal: Column, focal: Column, general: Column) -> Column:
    no = F.lit(False)
    n, f, g = (F.coalesce(x, no) for x in (normal, focal, general))
    return F.when(n, "control").when(f & g, "both").when(f, "focal_only").when(g, "gen_only").otherwise("other")


def exclusion(processed: Column, seconds: Column, usable: Column, fraction: Column, status: Column, min_minutes: float = 5, min_usable: int = 20, min_fraction: float = 0.2) -> tuple[Column, Column]:
    """(included, reason or null)."""
    enough = F.coalesce((seconds >= min_minutes * 60) & (usable >= min_usable) & (fraction >= min_fraction), F.lit(False))
    included = processed & enough
    return included, F.when(included, None).when(processed, "unusable:short_or_artifact").otherwise(F.coalesce(status, F.lit("not_processed")))


def spans_night(hours: Column, start_hour: Column) -> Column:
    return (hours >= F.pmod(24 - start_hour, F.lit(24)) + 5) & (hours >= 6) & (hours < 48)


def oriented(feature: Column, z: Column, low_is_abnormal: list[str]) -> Column:
    return F.when(feature.isin(low_is_abnormal), -z).otherwise(z)


def ordinal(n: Column) -> Column:
    suffix = F.when((n % 100).between(10, 20), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def centile_text(share: Column) -> Column:
    """Words for a normal share of 0 to 1."""
    c = share * 100
    n = F.rint(F.least(F.greatest(c, F.lit(1.0)), F.lit(99.0))).cast("int")
    return F.when(c >= 99.9, ">99.9th").when(c <= 0.1, "<0.1st").otherwise(ordinal(n))


def band_call(log_ratio: Column, low: float = 0.515, high: float = 1.643) -> Column:
    """delta above ``high``, theta below ``low`` (fixed values, matched to report shares), else both."""
    return F.when(log_ratio > high, "delta").when(log_ratio < low, "theta").otherwise("theta-delta")


def side_call(signed: Column, least: float = 0.25) -> Column:
    return F.when(signed > least, "left").when(signed < -least, "right").otherwise("bilateral")


def lobe_excess(lobes: dict[str, Column]) -> dict[str, Column]:
    """Each lobe less the mean of the others."""
    n = len(lobes) - 1
    total = sum(lobes.values(), F.lit(0.0))
    return {k: v - (total - v) / n for k, v in lobes.items()}


def leading_lobe(lobes: dict[str, Column]) -> Column:
    excess = lobe_excess(lobes)
    best = F.greatest(*excess.values())
    out = None
    for k, v in excess.items():
        out = (F.when if out is None else out.when)(v == best, k)
    return out


def is_focal(signed: Column, lobes: dict[str, Column]) -> Column:
    return (F.abs(signed) >= 0.5) | (F.greatest(*lobe_excess(lobes).values()) >= 0.6)


def gradient_word(z: Column, at: float = 1.645) -> Column:
    return F.when(z > at, "frontally predominant").when(z < -at, "posteriorly predominant").otherwise("diffuse")


def prevalence_word(share: Column) -> Column:
    return F.when(share < 0.01, "rare").when(share < 0.1, "occasional").when(share < 0.5, "frequent").when(share < 0.9, "abundant").otherwise("continuous")


def topography(burdens: Column, asymmetry: Column, burden: float = 2.0, dominance: float = 1.8, asymmetric: float = 2.0) -> Column:
    """Class of a map region -> burden: none, generalized, focal, lateralized or multifocal."""
    vals = F.array_sort(F.map_values(burdens))
    n = F.size(vals)
    rest = F.slice(vals, F.lit(1), n - 1)
    half = F.floor((n - 1) / 2).cast("int")
    median = F.when((n - 1) % 2 == 1, F.get(rest, half)).otherwise((F.get(rest, half - 1) + F.get(rest, half)) / 2)
    ratio = F.element_at(vals, -1) / (median + EPS)
    abnormal = F.size(F.filter(vals, lambda v: v >= burden))
    asym = F.abs(asymmetry) >= asymmetric
    return (
        F.when(abnormal == 0, "none").when((abnormal >= 2) & (ratio < dominance) & ~asym, "generalized").when((ratio >= dominance) & asym, "focal")
        .when(asym, "lateralized").when(abnormal >= 2, "multifocal").otherwise("focal")
    )


def blind_arm(rater: Column, case: Column) -> Column:
    """0 or 1 from the last bit of an md5: the same for a rater and case each time."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", rater, case).cast("binary")), 32, 1), 16, 10).cast("int") % 2).cast("int")


def band_phrase(delta: Column, theta: Column, rhythmic: Column) -> Column:
    mixed = (delta > 0) & (theta > 0) & (F.least(delta, theta) / F.greatest(delta, theta) > 0.5)
    return F.when(rhythmic, "rhythmic delta activity").when(mixed, "mixed theta/delta slowing").when(delta >= theta, "delta slowing").otherwise("theta slowing")
