"""Recursive filters run forward and backward, and envelopes: numpy by Arrow batches, rows of equal length at once.

A filter is a cascade of second-order sections. A section runs over blocks of samples as matrix products, and only its
state of two numbers goes from block to block, so long signals need no loop over samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

BLOCK = 256
#: Samples that are filtered at once.
AT_ONCE = 4_000_000
Section = tuple[np.ndarray, np.ndarray]


def butterworth(order: int, fs: float, low: float | None = None, high: float | None = None) -> list[Section]:
    """Sections of a high-pass (``low`` alone), low-pass (``high`` alone) or band-pass filter, by the bilinear transform;
    a band-pass has twice the order."""
    prototype = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    warped = lambda f: 2 * fs * np.tan(np.pi * f / fs)
    if low and high:
        half, centre = prototype * (warped(high) - warped(low)) / 2, np.sqrt(warped(low) * warped(high))
        root = np.sqrt(half**2 - centre**2)
        poles, zeros, at = np.concatenate([half + root, half - root]), (1.0, -1.0), np.exp(2j * np.arctan(centre / (2 * fs)))
    elif low:
        poles, zeros, at = warped(low) / prototype, (1.0, 1.0), -1.0
    else:
        poles, zeros, at = warped(high) * prototype, (-1.0, -1.0), 1.0
    z = (2 * fs + poles) / (2 * fs - poles)
    real = np.sort(z[np.abs(z.imag) <= 1e-9].real)
    groups = [(p, p.conjugate()) for p in z[z.imag > 1e-9]] + [tuple(real[k : k + 2]) for k in range(0, len(real), 2)]
    out = []
    for g in groups:
        a, b = np.poly(g).real, np.poly(zeros[: len(g)])
        gain = abs(np.polyval(a, at) / np.polyval(b, at))
        fill = np.zeros(3 - len(a))
        out.append((np.append(b * gain, fill), np.append(a, fill)))
    return out


def notch(frequency: float, fs: float, quality: float = 30.0) -> list[Section]:
    """One section that removes a frequency; its width at half power is frequency / quality."""
    w = 2 * np.pi * frequency / fs
    gain = 1 / (1 + np.tan(w / quality / 2))
    middle = -2 * gain * np.cos(w)
    return [(np.array([gain, middle, gain]), np.array([1.0, middle, 2 * gain - 1]))]


def _run(x: np.ndarray, section: Section, state: np.ndarray) -> np.ndarray:
    """Rows filtered by a section from their ``state`` (rows, 2) on."""
    b, a = section
    step, into = np.array([[-a[1], 1.0], [-a[2], 0.0]]), b[1:] - a[1:] * b[0]
    rows, n = x.shape
    size = min(BLOCK, n)
    blocks = np.zeros((rows, -(-n // size) * size))
    blocks[:, :n] = x
    blocks = blocks.reshape(rows, -1, size)
    powers = [np.eye(2)]
    for _ in range(size):
        powers.append(powers[-1] @ step)
    seen = np.stack([p[0] for p in powers[:size]])
    response = np.append(b[0], seen[:-1] @ into)
    lag = np.arange(size)[:, None] - np.arange(size)
    inside = np.where(lag >= 0, response[lag], 0.0)
    gathered = blocks @ np.stack([p @ into for p in powers[:size][::-1]])
    states = np.empty((rows, blocks.shape[1], 2))
    for k in range(blocks.shape[1]):
        states[:, k] = state
        state = state @ powers[size].T + gathered[:, k]
    return (blocks @ inside.T + states @ seen.T).reshape(rows, -1)[:, :n]


def _cascade(x: np.ndarray, sections: list[Section]) -> np.ndarray:
    """Each section starts as if its first sample had always been there."""
    first = x[:, :1]
    for b, a in sections:
        rest = np.linalg.solve(np.array([[1 + a[1], -1.0], [a[2], 1.0]]), b[1:] - a[1:] * b[0])
        x = _run(x, (b, a), first * rest)
        first = first * (b.sum() / a.sum())
    return x


def forward_backward(x: np.ndarray, sections: list[Section]) -> np.ndarray:
    """Rows filtered in both directions, so without a shift in phase. Ends are continued by their point reflection over
    three times the filter's length, or as far as the signal goes."""
    pad = min(3 * (2 * len(sections) + 1), x.shape[1] - 1)
    if pad:
        x = np.hstack([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]])
    y = _cascade(_cascade(x, sections)[:, ::-1], sections)[:, ::-1]
    return y[:, pad : y.shape[1] - pad]


def magnitude(x: np.ndarray) -> np.ndarray:
    """Envelope of rows: the size of the analytic signal."""
    n = x.shape[1]
    weight = np.zeros(n)
    weight[0] = 1
    weight[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        weight[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x, axis=1) * weight, axis=1))


def _mapped(df: DataFrame, keys: list[str], samples: str, of) -> DataFrame:
    """keys, samples with ``of`` applied to matrices of signals of one length. Null signals, and those with a null or NaN
    sample, become null; empty ones stay empty."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            signals = [None if x is None else np.asarray(x, float) for x in b[samples]]
            signals = [None if x is None or not np.isfinite(x).all() else x for x in signals]
            by_length: dict[int, list[int]] = {}
            for i, x in enumerate(signals):
                if x is not None and len(x):
                    by_length.setdefault(len(x), []).append(i)
            for n, rows in by_length.items():
                most = max(AT_ONCE // n, 1)
                for k in range(0, len(rows), most):
                    part = rows[k : k + most]
                    for i, y in zip(part, of(np.stack([signals[i] for i in part])), strict=True):
                        signals[i] = y
            yield b[keys].assign(**{samples: signals})

    kinds = dict(df.dtypes)
    return df.select(*keys, samples).mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in keys) + f", {samples} array<double>")


def cleaned(df: DataFrame, keys: list[str], samples: str, fs: float, low: float = 0.5, notches: tuple[float, ...] = (60.0, 50.0), order: int = 4) -> DataFrame:
    """keys, samples without slow drift (high-pass at ``low``) and line noise (notches below half of ``fs``)."""
    filters = [butterworth(order, fs, low), *[notch(f, fs) for f in notches if f < fs / 2]]

    def of(x: np.ndarray) -> np.ndarray:
        for f in filters:
            x = forward_backward(x, f)
        return x

    return _mapped(df, keys, samples, of)


def band_envelope(df: DataFrame, keys: list[str], samples: str, fs: float, low: float, high: float, order: int = 4) -> DataFrame:
    """keys, samples: the envelope of the band [low, high]."""
    sections = butterworth(order, fs, low, high)
    return _mapped(df, keys, samples, lambda x: magnitude(forward_backward(x, sections)))
