"""Signal operators over array columns: montage, segments, spectra, band powers, symmetry, artifacts, shape.

What arrays and groupings express is native; filters and multitaper spectra run in numpy by Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12
#: Band edges in Hz, [low, high). Fixed values.
BANDS = {"delta": (1.0, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0), "gamma": (30.0, 45.0), "total": (0.5, 45.0)}


def bipolar(signals: DataFrame, montage: DataFrame, keys: list[str], channel: str = "channel", samples: str = "samples") -> DataFrame:
    """keys, channel, samples = anode - cathode. The montage (channel, anode, cathode) is a dimension of a few rows."""
    one = signals.join(F.broadcast(montage.select("channel_out", F.col("anode").alias(channel))), channel).select(*keys, "channel_out", F.col(samples).alias("_a"))
    two = signals.join(F.broadcast(montage.select("channel_out", F.col("cathode").alias(channel))), channel).select(*keys, "channel_out", F.col(samples).alias("_b"))
    return one.join(two.hint("merge"), [*keys, "channel_out"]).select(*keys, F.col("channel_out").alias(channel), F.zip_with("_a", "_b", lambda a, b: a - b).alias(samples))


def cut_segments(signals: DataFrame, length: int, step: int, most: int | None = None, samples: str = "samples") -> DataFrame:
    """Adds segment and start, with the slice of ``length`` samples; partial ends go, and what starts beyond ``most``."""
    n = F.size(samples) if most is None else F.least(F.size(samples), F.lit(most))
    at = F.when(n >= length, F.sequence(F.lit(0), n - length, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return signals.select("*", F.posexplode(at).alias("segment", "start")).withColumn(samples, F.slice(samples, F.col("start") + 1, length))


def long_spectrum(df: DataFrame, keys: list[str], psd: str, resolution: float) -> DataFrame:
    """keys, f, p from an array of powers of equal spacing."""
    return df.select(*keys, F.posexplode(psd).alias("_i", "p")).select(*keys, (F.col("_i") * resolution).alias("f"), F.col("p").cast("double").alias("p"))


def band_power(psd: Column, resolution: float, low: float, high: float) -> Column:
    """Trapezoid over the bins of [low, high), in the array: no rows are made."""
    first = int(np.ceil(low / resolution - 1e-9))
    last = int(np.ceil(high / resolution - 1e-9)) - 1
    part = F.slice(psd, first + 1, last - first + 1)
    ends = (F.get(part, 0) + F.element_at(part, -1)) / 2
    return (F.aggregate(part, F.lit(0.0), lambda a, x: a + x.cast("double")) - ends) * resolution


def band_powers(df: DataFrame, psd: str, resolution: float, bands: dict[str, tuple[float, float]] = BANDS) -> DataFrame:
    return df.withColumns({b: band_power(F.col(psd), resolution, lo, hi) for b, (lo, hi) in bands.items()})


def slowing_ratios(p: dict[str, Column]) -> dict[str, Column]:
    return {"dar": p["delta"] / (p["alpha"] + EPS), "adr": p["alpha"] / (p["delta"] + EPS), "dtabr": (p["delta"] + p["theta"]) / (p["alpha"] + p["beta"] + EPS)}


def edge_and_peak(spectrum: DataFrame, keys: list[str], share: float = 0.95, low: float = 0.5, high: float = 45.0) -> DataFrame:
    """edge: least frequency below which ``share`` of the mean power lies; peak: that of the greatest power (the lowest
    of equal ones)."""
    m = spectrum.where((F.col("f") >= low) & (F.col("f") <= high)).groupBy(*keys, "f").agg(F.avg("p").alias("p"))
    w = Window.partitionBy(*keys)
    m = m.withColumn("c", F.sum("p").over(w.orderBy("f").rowsBetween(Window.unboundedPreceding, 0)) / (F.sum("p").over(w) + EPS))
    return m.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("c") >= share, F.col("f"))), F.max("f")).alias("edge"), F.max_by("f", F.struct("p", -F.col("f"))).alias("peak"))


def hemisphere_index(spectrum: DataFrame, keys: list[str], channel: str, left: list[int], right: list[int], low: float = 0.5, high: float = 25.0) -> DataFrame:
    """r_sbsi (unsigned) and pdbsi (signed, right positive): mean over bins of the normalised difference of means."""
    side = lambda c: F.avg(F.when(F.col(channel).isin(c), F.col("p")))
    m = spectrum.where((F.col("f") >= low) & (F.col("f") < high)).groupBy(*keys, "f").agg(side(right).alias("r"), side(left).alias("l"))
    d = (F.col("r") - F.col("l")) / (F.col("r") + F.col("l") + EPS)
    return m.groupBy(*keys).agg(F.avg(F.abs(d)).alias("r_sbsi"), F.avg(d).alias("pdbsi"))


def slow_shape(spectrum: DataFrame, keys: list[str], low: float = 0.5, high: float = 8.0) -> DataFrame:
    """centroid, spread and peak of the slow band, as power-weighted sums."""
    s = spectrum.where((F.col("f") >= low) & (F.col("f") < high))
    total = F.sum("p") + EPS
    c = F.sum(F.col("f") * F.col("p")) / total
    var = F.sum(F.col("f") * F.col("f") * F.col("p")) / total - c * c
    return s.groupBy(*keys).agg(c.alias("centroid"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("spread"), F.max_by("f", F.struct("p", -F.col("f"))).alias("peak"))


def range_and_deviation(samples: Column) -> tuple[Column, Column]:
    """(peak to peak, population SD) of an array."""
    n = F.size(samples)
    mean = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double")) / n
    square = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / n
    return (F.array_max(samples) - F.array_min(samples)).cast("double"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))


def artifacts(segments: DataFrame, keys: list[str], samples: str = "samples", flat: float = 1.0, flat_sd: float = 0.5, high: float = 500.0, flat_share: float = 0.5) -> DataFrame:
    """keys, usable, reason: flat, high_amplitude or ok, in this order; rows are the segment's channels."""
    p2p, sd = range_and_deviation(F.col(samples))
    c = segments.select(*keys, p2p.alias("p"), sd.alias("s"))
    g = c.groupBy(*keys).agg(F.avg(((F.col("p") < flat) | (F.col("s") < flat_sd)).cast("double")).alias("share"), F.percentile("p", F.lit(0.5)).alias("mp"), F.percentile("s", F.lit(0.5)).alias("ms"), F.max("p").alias("top"))
    reason = F.when((F.col("share") > flat_share) | (F.col("mp") < flat) | (F.col("ms") < flat_sd), "flat").when(F.col("top") > high, "high_amplitude").otherwise("ok")
    return g.select(*keys, (reason == "ok").alias("usable"), reason.alias("reason"))


def line_length(samples: Column) -> Column:
    """Sum of absolute steps."""
    steps = F.zip_with(F.slice(samples, F.lit(2), F.size(samples) - 1), F.slice(samples, F.lit(1), F.size(samples) - 1), lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)


def mobility(samples: Column) -> Column:
    """Hjorth mobility: SD of the steps over SD of the signal."""
    n = F.size(samples)
    steps = F.zip_with(F.slice(samples, F.lit(2), n - 1), F.slice(samples, F.lit(1), n - 1), lambda a, b: a.cast("double") - b.cast("double"))
    return range_and_deviation(steps)[1] / (range_and_deviation(samples)[1] + EPS)


def tapers(n: int, half_bandwidth: float = 4.0, k: int = 7) -> np.ndarray:
    """Slepian sequences: eigenvectors of the tridiagonal matrix that commutes with the concentration problem."""
    i = np.arange(n)
    w = half_bandwidth / n
    diagonal = ((n - 1 - 2 * i) / 2) ** 2 * np.cos(2 * np.pi * w)
    off = i[1:] * (n - i[1:]) / 2
    _, v = np.linalg.eigh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    v = v[:, ::-1][:, :k].T
    return v * np.sign(np.where(np.abs(v.sum(1)) > 1e-9, v.sum(1), v[:, 1]))[:, None]


def multitaper(df: DataFrame, keys: list[str], samples: str, fs: float, half_bandwidth: float = 4.0, k: int = 7) -> DataFrame:
    """keys, psd: mean over tapers of the detrended signal's power / fs, by batches of equal length."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, np.ndarray] = {}
        for b in batches:
            for n, part in b.groupby(b[samples].map(len)):
                if n < 8:
                    continue
                t = known.setdefault(n, tapers(n, half_bandwidth, k))
                x = np.stack(part[samples].to_numpy()).astype(float)
                time = np.arange(n) - (n - 1) / 2
                x = x - x.mean(1, keepdims=True) - np.outer(x @ time / (time @ time), time)
                psd = (np.abs(np.fft.rfft(x[:, None] * t[None], axis=2)) ** 2).mean(1) / fs
                yield part[keys].assign(psd=list(psd))

    kinds = dict(df.dtypes)
    return df.select(*keys, samples).mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", psd array<double>")


def bandpass(df: DataFrame, keys: list[str], samples: str, fs: float, low: float, high: float, notch: float | None = None) -> DataFrame:
    """keys, samples with frequencies outside [low, high] (and within 1 of ``notch``) removed, zero phase, by FFT."""
    import pandas as pd

    def one(x) -> np.ndarray:
        s = np.fft.rfft(np.asarray(x, float))
        f = np.fft.rfftfreq(len(x), 1 / fs)
        s[(f < low) | (f > high) | ((np.abs(f - notch) < 1) if notch else False)] = 0
        return np.fft.irfft(s, len(x))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[keys].assign(**{samples: [one(x) for x in b[samples]]})

    kinds = dict(df.dtypes)
    return df.select(*keys, samples).mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in keys) + f", {samples} array<double>")


def filled_channels(signals: DataFrame, keys: list[str], channels: list[int], least: int, channel: str = "channel", samples: str = "samples") -> DataFrame:
    """Adds the missing channels as the sample-wise mean of the present ones (filled = true); recordings with fewer than
    ``least`` channels go. A recording's channels, a few dozen, meet in one row."""
    g = signals.where(F.col(channel).isin(channels)).groupBy(*keys).agg(F.collect_list(samples).alias("_all"), F.collect_list(channel).alias("_have")).where(F.size("_have") >= least)
    total = F.aggregate(F.slice("_all", 2, len(channels)), F.transform(F.get("_all", 0), lambda x: x.cast("double")), lambda a, s: F.zip_with(a, s, lambda x, y: x + y.cast("double")))
    mean = F.transform(total, lambda x: x / F.size("_have"))
    missing = F.array_except(F.array(*[F.lit(c).cast("long") for c in channels]), F.transform("_have", lambda c: c.cast("long")))
    added = g.select(*keys, mean.alias(samples), F.explode(missing).alias(channel)).withColumn("filled", F.lit(True))
    kept = signals.where(F.col(channel).isin(channels)).join(g.select(*keys).hint("merge"), keys, "left_semi")
    return kept.select(*keys, F.col(channel).cast("long").alias(channel), F.transform(samples, lambda x: x.cast("double")).alias(samples), F.lit(False).alias("filled")).unionByName(added)


def pair_asymmetry(spectrum: DataFrame, keys: list[str], channel: str, pairs: list[tuple[int, int]], low: float = 0.5, high: float = 25.0) -> DataFrame:
    """q_asym: the greatest over homologous pairs of the mean normalised difference of their spectra; and its pair, of equal ones (to
    nine digits) the last. Both null where no pair has both channels."""
    sides = {c: (k, side) for k, pair in enumerate(pairs) for side, c in enumerate(pair)}
    lookup = F.create_map(*[F.lit(x) for c, (k, side) in sides.items() for x in (c, 2 * k + side)])
    s = spectrum.where((F.col("f") >= low) & (F.col("f") < high)).withColumn("_s", F.element_at(lookup, F.col(channel).cast("int"))).where("_s IS NOT NULL")
    own = s.groupBy(*keys, F.floor(F.col("_s") / 2).alias("pair"), "f").agg(F.max(F.when(F.col("_s") % 2 == 0, F.col("p"))).alias("l"), F.max(F.when(F.col("_s") % 2 == 1, F.col("p"))).alias("r"))
    per = own.groupBy(*keys, "pair").agg(F.avg(F.abs(F.col("r") - F.col("l")) / (F.col("r") + F.col("l") + EPS)).alias("a"))
    return per.groupBy(*keys).agg(F.max("a").alias("q_asym"), F.max_by("pair", F.when(F.col("a").isNotNull(), F.struct(F.round("a", 9), F.col("pair")))).alias("pair"))


def muscle_share(spectrum: DataFrame, keys: list[str], channel: str, low: float = 1.0, middle: float = 20.0, high: float = 45.0) -> DataFrame:
    """Median over channels of the share of power above 20 Hz."""
    f, p = F.col("f"), F.col("p")
    per = spectrum.groupBy(*keys, channel).agg((F.sum(F.when((f >= middle) & (f < high), p).otherwise(0.0)) / (F.sum(F.when((f >= low) & (f < high), p).otherwise(0.0)) + EPS)).alias("_share"))
    return per.groupBy(*keys).agg(F.percentile("_share", F.lit(0.5)).alias("muscle"))


def usable_segments(reasons: DataFrame, muscle: DataFrame, keys: list[str], most: float = 0.55) -> DataFrame:
    """``artifacts`` with its third rule: what is neither flat nor high, but mostly muscle."""
    reason = F.when((F.col("reason") == "ok") & (F.col("muscle") > most), "emg").otherwise(F.col("reason"))
    return reasons.select(*keys, "reason").join(muscle.hint("merge"), keys, "left").select(*keys, (reason == "ok").alias("usable"), reason.alias("reason"))


def file_class(labels: DataFrame, file: str, label: str, canonical: list[str], contact: str, tokens: str, least: int = 8, contacts: int = 32) -> DataFrame:
    """scalp, intracranial or ambiguous, from how many labels are canonical, look like contacts or name a depth."""
    x = F.col(label)
    g = labels.groupBy(file).agg(F.count_if(x.isin(canonical)).alias("n_canonical"), F.count_if(x.rlike(contact)).alias("n_contact"), F.coalesce(F.bool_or(x.rlike(tokens)), F.lit(False)).alias("token"))
    n, c = F.col("n_canonical"), F.col("n_contact")
    kind = F.when((n >= least) & (c < n), "scalp").when(F.col("token") | ((c >= contacts) & (n < least)), "intracranial").otherwise("ambiguous")
    return g.select(file, "n_canonical", "n_contact", kind.alias("kind"))


def longest_above(envelope: Column, level: Column) -> Column:
    """Samples of the longest run above a level."""
    step = lambda a, x: F.struct(F.when(x > level, a["run"] + 1).otherwise(0).alias("run"), F.greatest(a["best"], F.when(x > level, a["run"] + 1).otherwise(0)).alias("best"))
    return F.aggregate(envelope, F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")), step)["best"]


def bursts(envelopes: DataFrame, recording: str, unit: list[str], envelope: str, fs: float, factor: float = 2.0, seconds: float = 0.4) -> DataFrame:
    """Per unit (a segment), whether any of its channels has a run of ``seconds`` above ``factor`` times the recording's
    median of the envelope."""
    median = envelopes.select(recording, F.explode(envelope).alias("_x")).groupBy(recording).agg(F.percentile("_x", F.lit(0.5)).alias("_m"))
    run = longest_above(F.col(envelope), F.col("_m") * factor)
    return envelopes.join(median.hint("merge"), recording).groupBy(recording, *unit).agg(F.max(run).alias("longest")).withColumn("burst", F.col("longest") >= seconds * fs)


def spectral_entropy(spectrum: DataFrame, keys: list[str], low: float = 0.5, high: float = 45.0) -> DataFrame:
    """Entropy of the spectrum's shares over that of a flat one."""
    s = spectrum.where((F.col("f") >= low) & (F.col("f") <= high) & (F.col("p") > 0))
    total = F.sum("p")
    return s.groupBy(*keys).agg(((F.log(total) - F.sum(F.col("p") * F.log("p")) / total) / F.log(F.count(F.lit(1)))).alias("entropy"))


def complexity(samples: Column) -> Column:
    """Hjorth complexity: mobility of the steps over mobility of the signal."""
    n = F.size(samples)
    steps = F.zip_with(F.slice(samples, F.lit(2), n - 1), F.slice(samples, F.lit(1), n - 1), lambda a, b: a.cast("double") - b.cast("double"))
    return mobility(steps) / (mobility(samples) + EPS)


def duty_cycle(samples: Column, level: float) -> Column:
    """Share of samples whose size is above a level."""
    return F.size(F.filter(samples, lambda x: F.abs(x) > level)) / F.size(samples)


def array_quantile(values: Column, q: float) -> Column:
    """Quantile of an array, linear between its sorted values; null if it is empty."""
    ordered, at = F.array_sort(values), q * (F.size(values) - 1)
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    return F.when(F.size(values) > 0, F.get(ordered, low) + (F.get(ordered, high) - F.get(ordered, low)) * (at - low))


def amplitude(samples: Column) -> tuple[Column, Column]:
    """(root mean square, distance of the 5 and 95 % quantiles) of an array of doubles."""
    square = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x * x)
    return F.sqrt(square / F.nullif(F.size(samples), F.lit(0))), array_quantile(samples, 0.95) - array_quantile(samples, 0.05)


def _variation(values: Column) -> Column:
    """SD over mean; null for fewer than two values."""
    mean, sd = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values), range_and_deviation(values)[1]
    return F.when(F.size(values) > 1, sd / F.nullif(mean, F.lit(0.0)))


def cycles(df: DataFrame, samples: str, tolerance: float = 0.25) -> DataFrame:
    """Adds cycles, period_cv, amplitude_cv, above and longest_run of an array of doubles.

    A cycle reaches from one upward crossing of the mean to the next. The coefficients of variation are of its length and
    its range, null with fewer than two cycles; ``above`` is the share of samples over the mean within cycles;
    ``longest_run`` is the most cycles in a row whose length and range are within ``tolerance`` of their medians.
    """
    n = F.size(samples)
    mean = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x) / F.nullif(n, F.lit(0))
    d = df.withColumn("_mean", mean).withColumn("_c", F.transform(samples, lambda x: x - F.col("_mean")))
    up = F.filter(F.sequence(F.lit(1), n - 1), lambda i: (F.get("_c", i - 1) < 0) & (F.get("_c", i) >= 0))
    d = d.withColumn("_up", F.when(n > 1, up).otherwise(F.array().cast("array<int>")))
    firsts = F.slice("_up", F.lit(1), F.greatest(F.size("_up") - 1, F.lit(0)))
    d = d.withColumn("_cycle", F.transform(firsts, lambda i, k: F.slice("_c", i + 1, F.get("_up", k + 1) - i)))
    d = d.withColumns({"_period": F.transform("_cycle", lambda c: F.size(c).cast("double")), "_range": F.transform("_cycle", lambda c: F.array_max(c) - F.array_min(c))})
    d = d.withColumns({"_p": array_quantile(F.col("_period"), 0.5), "_r": array_quantile(F.col("_range"), 0.5)})
    near = lambda v, m: F.abs(v - F.col(m)) <= tolerance * F.col(m)
    steady = F.zip_with("_period", "_range", lambda p, r: near(p, "_p") & near(r, "_r"))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a: Column, ok: Column) -> Column:
        now = F.when(ok, a["now"] + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    over = F.aggregate("_cycle", F.lit(0), lambda a, c: a + F.size(F.filter(c, lambda x: x > 0)))
    length = F.aggregate("_period", F.lit(0.0), lambda a, x: a + x)
    return d.select(
        *df.columns, F.size("_cycle").alias("cycles"), _variation(F.col("_period")).alias("period_cv"), _variation(F.col("_range")).alias("amplitude_cv"),
        (over / F.nullif(length, F.lit(0.0))).alias("above"), F.aggregate(steady, start, step, lambda a: a["most"]).alias("longest_run"),
    )


def rhythmicity(df: DataFrame, samples: str, first: int, last: int) -> DataFrame:
    """Adds rhythmicity, the greatest autocorrelation at the lags ``first`` to ``last``, and its lag (the least of equal ones)."""
    n = F.size(samples)
    mean = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double")) / n
    d = df.withColumn("_mean", mean).withColumn("_c", F.transform(samples, lambda x: x.cast("double") - F.col("_mean")))
    square = F.aggregate("_c", F.lit(0.0), lambda a, x: a + x * x) + EPS
    at = lambda lag: F.aggregate(F.zip_with(F.slice("_c", F.lit(1), n - lag), F.slice("_c", lag + 1, n - lag), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    lags = F.sequence(F.lit(first), F.least(F.lit(last), n - 1))
    best = F.when(n > first, F.array_max(F.transform(lags, lambda lag: F.struct(at(lag).alias("r"), (-lag).alias("lag")))))
    d = d.withColumn("_best", best).withColumn("_square", square)
    return d.select(*df.columns, (F.col("_best.r") / F.col("_square")).alias("rhythmicity"), (-F.col("_best.lag")).alias("lag"))


def coherence(df: DataFrame, keys: list[str], segment: str, channel: str, samples: str, pairs: list[tuple[int, int]], bins: list[int]) -> DataFrame:
    """keys, pair, coherence: squared size of the mean cross spectrum over the product of the power spectra, which are
    sums over the segments of a key; mean over the Fourier ``bins``. Segments that lack a side of a pair don't count."""
    sides = {c: 2 * k + side for k, pair in enumerate(pairs) for side, c in enumerate(pair)}
    lookup = F.create_map(*[F.lit(x) for pair in sides.items() for x in pair])
    s = df.withColumn("_s", F.element_at(lookup, F.col(channel).cast("int"))).where("_s IS NOT NULL").select(*keys, segment, "_s", samples, F.explode(F.array(*[F.lit(b) for b in bins])).alias("_bin"))
    turn = lambda i: i * F.col("_bin") * (2 * np.pi) / F.size(samples)
    total = lambda f: F.aggregate(F.transform(samples, lambda x, i: x.cast("double") * f(turn(i))), F.lit(0.0), lambda a, x: a + x)
    one = lambda c, side: F.max(F.when(F.col("_s") % 2 == side, F.col(c)))
    s = s.select(*keys, segment, "_s", "_bin", total(F.cos).alias("_re"), total(F.sin).alias("_im"))
    per = s.groupBy(*keys, segment, F.floor(F.col("_s") / 2).alias("pair"), "_bin").agg(*[one(c, side).alias(f"{c}{side}") for c in ("_re", "_im") for side in (0, 1)])
    a, b, c, d = (F.col(x) for x in ("_re0", "_im0", "_re1", "_im1"))
    both = per.where(a.isNotNull() & c.isNotNull())
    real, imaginary = F.sum(a * c + b * d), F.sum(b * c - a * d)
    per = both.groupBy(*keys, "pair", "_bin").agg(((real * real + imaginary * imaginary) / (F.sum(a * a + b * b) * F.sum(c * c + d * d) + EPS)).alias("_v"))
    return per.groupBy(*keys, "pair").agg(F.avg("_v").alias("coherence"))


def candidate_offsets(df: DataFrame, keys: list[str], series: str, profile: str, step: int, top: int = 12, apart: int = 30) -> DataFrame:
    """keys, place, at, r: the ``top`` offsets of best correlation between the profile and every ``step``-th value of the
    series from there on, best first, each more than ``apart`` from those before it. Correlations are taken to 9 digits;
    of equal ones the least offset comes first. A row holds one series; its offsets are scored inside the row."""
    n = F.size(profile)
    mean = F.aggregate(profile, F.lit(0.0), lambda a, x: a + x.cast("double")) / n
    z = df.select(*keys, F.col(series).alias("_x"), F.col(profile).alias("_p"), mean.alias("_m"), range_and_deviation(F.col(profile))[1].alias("_sd"))
    z = z.withColumn("_z", F.transform("_p", lambda x: (x.cast("double") - F.col("_m")) / (F.col("_sd") + 1e-9)))
    k = F.size("_z")

    def score(at: Column) -> Column:
        picked = F.transform("_z", lambda v, i: F.struct(F.get("_x", at + i * step).cast("double").alias("x"), v.alias("v")))
        sums = F.aggregate(picked, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(0.0).alias("p")), lambda a, e: F.struct((a["s"] + e["x"]).alias("s"), (a["q"] + e["x"] * e["x"]).alias("q"), (a["p"] + e["x"] * e["v"]).alias("p")),
                           lambda a: a["p"] / k / (F.sqrt(F.greatest(a["q"] / k - a["s"] * a["s"] / (k * k), F.lit(0.0))) + 1e-9))
        return F.struct((-F.round(sums, 9)).alias("n"), at.alias("at"))

    last = F.size("_x") - (k - 1) * step - 1
    scores = z.select(*keys, F.sort_array(F.when(last >= 1, F.transform(F.sequence(F.lit(0), last), score)).otherwise(F.array().cast("array<struct<n:double,at:int>>"))).alias("_scores"))
    free = lambda kept, s: (F.size(kept) < top) & ~F.exists(kept, lambda p: F.abs(p["at"] - s["at"]) <= apart)
    chosen = F.aggregate("_scores", F.array().cast("array<struct<n:double,at:int>>"), lambda kept, s: F.when(free(kept, s), F.concat(kept, F.array(s))).otherwise(kept))
    return scores.select(*keys, F.posexplode(chosen).alias("place", "_c")).select(*keys, "place", F.col("_c.at").alias("at"), (-F.col("_c.n")).alias("r"))


def offset_mismatch(series: Column, stored: Column, at: Column, step: int, length: int) -> Column:
    """Greatest difference between stored means of segments and those recomputed from an offset on: an offset is the true
    one where it is about 0. Null where a segment would run over the end."""
    window = lambda i: F.slice(series, at + i * step + 1, length)
    mean = lambda i: F.aggregate(window(i), F.lit(0.0), lambda a, x: a + x.cast("double")) / length
    return F.when(at + (F.size(stored) - 1) * step + length <= F.size(series), F.array_max(F.transform(stored, lambda v, i: F.abs(mean(i) - v))))
