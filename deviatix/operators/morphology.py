"""Shape of spectra, waves and fields: functions of arrays, so a channel's segment stays one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _mean(x: Column) -> Column:
    return F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda t, y: t + y) / F.greatest(F.size(x), F.lit(1)))


def _nothing(kind: str = "double") -> Column:
    return F.lit(None).cast(kind)


def peak_shape(spectrum: Column, low: float, high: float) -> Column:
    """peak (frequency), width and q = peak / width of the greatest power in [low, high) of an ascending array of structs (f, p).

    The width is that at half the peak's power, with both crossings linear between neighbouring frequencies; where the
    spectrum ends on one side before it falls so far, twice the other side; null if on both. Of equal powers the
    lowest frequency is the peak; null without any in the band.
    """
    inside = F.filter(spectrum, lambda s: (s["f"] >= low) & (s["f"] < high) & s["p"].isNotNull())

    def shape(top: Column) -> Column:
        half = top["p"] / 2
        before = F.filter(spectrum, lambda s: s["f"] <= top["f"])
        behind = F.filter(spectrum, lambda s: s["f"] >= top["f"])
        # the pair of neighbours between which the power crosses half the peak's
        cross = lambda a, b: a["f"] + (half - a["p"]) * (b["f"] - a["f"]) / (b["p"] - a["p"])
        pairs = lambda x: F.zip_with(F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        left = F.try_element_at(F.filter(pairs(before), lambda q: (q["a"]["p"] <= half) & (q["b"]["p"] > half)), F.lit(-1))
        right = F.get(F.filter(pairs(behind), lambda q: (q["a"]["p"] > half) & (q["b"]["p"] <= half)), F.lit(0))
        down, up = top["f"] - cross(left["a"], left["b"]), cross(right["a"], right["b"]) - top["f"]
        width = F.coalesce(down + up, 2 * down, 2 * up)
        return F.struct(top["f"].alias("peak"), width.alias("width"), F.when(width > 0, top["f"] / width).alias("q"))

    greatest = F.aggregate(inside, F.get(inside, F.lit(0)), lambda t, s: F.when(s["p"] > t["p"], s).otherwise(t))
    return F.when(F.size(inside) > 0, _let(greatest, shape))


def waves(samples: Column) -> Column:
    """cycles, peak_sharpness, trough_sharpness and rise_share of a signal about its mean.

    A cycle lies between two upward crossings of the mean; its peak is its greatest sample, its trough the least one behind the
    peak. Sharpness is the size of the second difference there, averaged over cycles. The rise share is the time from a
    trough to the next cycle's peak as a part of the time from peak to peak, averaged. Nulls where there is nothing to average.
    """
    indices = lambda x, first: F.when(F.size(x) > first, F.sequence(F.lit(first), F.size(x) - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda x, i: F.get(x, i)
    bend = lambda x, i: F.abs(at(x, i - 1) - 2 * at(x, i) + at(x, i + 1))

    def of(x: Column) -> Column:
        ups = F.filter(indices(x, 1), lambda i: (at(x, i - 1) < 0) & (at(x, i) >= 0))

        def between(u: Column) -> Column:
            spans = F.zip_with(F.slice(u, 1, F.greatest(F.size(u) - 1, F.lit(0))), F.slice(u, 2, F.greatest(F.size(u) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

            def extremes(s: Column) -> Column:
                part = F.slice(x, s["a"] + 1, s["b"] - s["a"])
                return _let((s["a"] + F.array_position(part, F.array_max(part)) - 1).cast("int"), lambda p: _let(F.slice(x, p + 1, s["b"] - p), lambda rest: F.struct(p.alias("peak"), (p + F.array_position(rest, F.array_min(rest)) - 1).cast("int").alias("trough"))))

            def summary(c: Column) -> Column:
                steps = F.zip_with(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: (b["peak"] - a["trough"]).cast("double") / (b["peak"] - a["peak"]))
                sharp = lambda k: _mean(F.filter(F.transform(c, lambda e: bend(x, e[k])), lambda v: v.isNotNull()))
                return F.struct(F.size(c).alias("cycles"), sharp("peak").alias("peak_sharpness"), sharp("trough").alias("trough_sharpness"), _mean(steps).alias("rise_share"))

            return _let(F.transform(spans, extremes), summary)

        return _let(ups, between)

    return _let(samples, lambda s: _let(_mean(s), lambda m: _let(F.transform(s, lambda v: v - m), of)))


def bursts(envelope: Column, threshold: Column | float, rate: float) -> Column:
    """duty (share of samples above the threshold), burst_rate (runs above it a second) and cv (SD by mean) of an envelope."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))

    def of(e: Column) -> Column:
        above = F.transform(e, lambda v: v > t)
        starts = F.filter(F.transform(above, lambda a, i: a & ~F.coalesce(F.get(above, i - 1), F.lit(False))), lambda s: s)
        sd = _let(_mean(e), lambda m: F.sqrt(_mean(F.transform(e, lambda v: (v - m) * (v - m)))) / F.nullif(m, F.lit(0.0)))
        n = F.greatest(F.size(e), F.lit(1))
        return F.struct((F.size(F.filter(above, lambda a: a)) / n).alias("duty"), (F.size(starts) * rate / n).alias("burst_rate"), sd.alias("cv"))

    return F.when(F.size(envelope) > 0, _let(envelope, of))


def field_size(active: Column, neighbours: dict[int, list[int]]) -> Column:
    """extent (active channels) and largest (channels of the largest group of active ones that hang together by ``neighbours``).
    ``active`` is an array of channel numbers; the montage is a constant of some tens of channels."""
    beside = F.create_map(*[v for k, near in sorted(neighbours.items()) for v in (F.lit(k).cast("long"), F.array(*[F.lit(x).cast("long") for x in near]))])

    def of(a: Column) -> Column:
        def grown(c: Column) -> Column:
            step = lambda s, _: F.array_union(s, F.filter(a, lambda x: F.exists(s, lambda y: F.coalesce(F.array_contains(F.try_element_at(beside, y), x), F.lit(False)))))
            return F.size(F.aggregate(a, F.array(c), step))

        return F.struct(F.size(a).alias("extent"), F.coalesce(F.array_max(F.transform(a, grown)), F.lit(0)).alias("largest"))

    return _let(F.array_distinct(F.transform(active, lambda c: c.cast("long"))), of)
