"""Language identification by a convolutional network over bytes, trained here in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sized_join_hint

#: Bytes of a window; a text's windows stand end to end and the last one ends where the text ends.
WINDOW = 256
WIDTHS = {2: 12, 3: 12, 4: 16}
WIDEST = max(WIDTHS)
EMBED = 8
#: Windows that go through the network at a time: their activations fit a core's cache.
BLOCK = 64
#: Windows held before they go through the network (1 MB of text); a text beyond that goes through on its own.
HELD_WINDOWS = 4096
#: Labels up to which their table (a short text and a number a row) is broadcast; they are counted.
BROADCAST_ROWS = 200_000
_ASCII_LETTER = re.compile(r"[A-Za-z]")


class ByteCNN:
    """Byte embedding, filters of several widths, max pooling over the window, softmax.

    All filters are stored at the widest width; a narrower filter's weights beyond its width are held at 0.
    """

    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        n = sum(WIDTHS.values())
        reach = np.repeat(list(WIDTHS), list(WIDTHS.values()))
        self.classes = classes
        self.mask = np.repeat(np.arange(WIDEST)[:, None] < reach, EMBED, axis=0).astype(np.float32)
        scale = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        self.p = {"embed": scale(256, EMBED, by=0.5), "conv": scale(WIDEST * EMBED, n, by=0.2) * self.mask, "bias": np.zeros(n, np.float32), "out": scale(n, len(classes), by=0.2), "out_bias": np.zeros(len(classes), np.float32)}

    def _pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(grams, position x window x inputs; pooled activations; positions of the maxima), of windows x bytes."""
        x = self.p["embed"][windows.T]
        grams = np.concatenate([x[j : len(x) - WIDEST + 1 + j] for j in range(WIDEST)], axis=2)
        z = grams @ self.p["conv"]
        return grams, z.max(0) + self.p["bias"], z

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.classes)), np.float32)
        for a in range(0, len(windows), BLOCK):
            _, pooled, _ = self._pooled(windows[a : a + BLOCK])
            out[a : a + BLOCK] = np.maximum(pooled, 0) @ self.p["out"] + self.p["out_bias"]
        out -= out.max(1, keepdims=True)
        return out - np.log(np.exp(out).sum(1, keepdims=True))

    def _gradients(self, windows: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        grams, pooled, z = self._pooled(windows)
        at, hidden = z.argmax(0), np.maximum(pooled, 0)
        score = hidden @ self.p["out"] + self.p["out_bias"]
        d = np.exp(score - score.max(1, keepdims=True))
        d /= d.sum(1, keepdims=True)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        g = {"out": hidden.T @ d, "out_bias": d.sum(0)}
        dp = (d @ self.p["out"].T) * (pooled > 0)
        rows = np.arange(len(y))[:, None]
        best = grams[at, rows]  # window x filter x inputs: only the maxima pass gradients
        g["conv"] = np.einsum("bf,bfi->if", dp, best) * self.mask
        g["bias"] = dp.sum(0)
        dx = (dp[:, :, None] * self.p["conv"].T[None]).reshape(len(y), -1, WIDEST, EMBED)
        letters = windows[rows[:, :, None], at[:, :, None] + np.arange(WIDEST)]
        g["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(g["embed"], letters.ravel(), dx.reshape(-1, EMBED))
        return g

    def fit(self, windows: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteCNN:
        """Adam, with the rate falling to nothing."""
        rng, m, v, t = np.random.default_rng(seed), {}, {}, 0
        steps = epochs * -(-len(y) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for a in range(0, len(y), batch):
                pick, t = order[a : a + batch], t + 1
                for k, g in self._gradients(windows[pick], y[pick]).items():
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                    self.p[k] -= (rate * (1 - t / steps) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return self


def windows_of(text: bytes) -> np.ndarray:
    """All of a text in windows x bytes; a text shorter than a window is filled up with zeros."""
    a = np.frombuffer(text, np.uint8)
    if len(a) <= WINDOW:
        return np.pad(a, (0, WINDOW - len(a)))[None]
    whole = a[: len(a) // WINDOW * WINDOW].reshape(-1, WINDOW)
    return whole if len(a) % WINDOW == 0 else np.concatenate([whole, a[None, -WINDOW:]])


def has_letter(text: str) -> bool:
    if _ASCII_LETTER.search(text):
        return True
    import regex

    return regex.search(r"\p{L}", text) is not None


def held_out(doc_id):
    """Ids of the fold that is never learned from; rows without an id belong to it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 500, windows_per_doc: int = 4, max_languages: int = 64) -> ByteCNN | None:
    """The network, fitted on a bounded sample of the labelled rows outside the held-out fold.

    The bound: for each language the ``docs_per_language`` documents of least id hash, ``windows_per_doc`` windows of
    each spread over its text. With more than ``max_languages`` languages all are kept and share that many languages'
    documents, one each at least; so the driver gets max_languages * docs_per_language * windows_per_doc * 256
    characters at most, or a document of each language where these are more. None if no row is labelled.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    top = rows.groupBy("lang").count().collect()  # a row per label
    if not top:
        return None
    # of a large language only ids of low hash go on, some four times the bound whatever the table's size
    order, span = F.pmod(F.xxhash64("id"), F.lit(1 << 30)), 1 << 30
    share = min(docs_per_language, max(1, max_languages * docs_per_language // len(top)))
    below = docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, 4 * max(share, 16) / r["count"]) * span)) for r in top], "lang string, below long")
    rows = rows.join(sized_join_hint(below, len(top), BROADCAST_ROWS), "lang").where(order < F.col("below"))
    n = F.length("text")
    start = lambda k: F.floor(F.greatest(n - WINDOW, F.lit(0)) * k / max(1, windows_per_doc - 1)).cast("int") + 1
    cut = rows.select("id", "lang", order.alias("order"), F.array_distinct(F.array(*[F.substring("text", start(k), F.lit(WINDOW)) for k in range(windows_per_doc)])).alias("cuts"))
    first = cut.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order", "id", "cuts"))).where(F.col("rank") <= share)
    sample = sorted((r.lang, r.rank, list(r.cuts)) for r in first.select("lang", "rank", "cuts").collect())
    classes = sorted({lang for lang, _, _ in sample})
    texts = [(classes.index(lang), c.encode()[:WINDOW]) for lang, _, cuts in sample for c in cuts]
    windows = np.concatenate([windows_of(c) for _, c in texts])
    return ByteCNN(classes).fit(windows, np.array([k for k, _ in texts]))


def predict(docs: DataFrame, model: ByteCNN | None, id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False) -> DataFrame:
    """One row per input row: ``id``, ``lang_pred``, ``score``, and with ``keep_row`` the struct ``row`` of all input
    columns; whole texts, no shuffle.

    The mean of the windows' log probabilities decides; the score is the winner's softmax of that mean. ``und`` with
    score 0 if the text is null or has no letter, or if there was nothing to learn from. Labels and sources are not
    read. Repeated rows and null ids each get their row.
    """
    import pyarrow as pa

    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).field(text_at) if keep_row else batch.column(1)
            lang, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            held: list[np.ndarray] = []
            owner: list[int] = []
            waiting = 0

            def flush() -> None:
                if not held:
                    return
                logs = model.log_probabilities(np.concatenate(held))
                firsts = np.cumsum([0, *map(len, held[:-1])])
                mean = np.add.reduceat(logs, firsts, axis=0) / np.array(list(map(len, held)))[:, None]
                p = np.exp(mean - mean.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                for i, k, s in zip(owner, p.argmax(1), p.max(1), strict=True):
                    lang[i], score[i] = model.classes[k], min(1.0, float(s))
                held.clear()
                owner.clear()

            for i, text in enumerate(texts):
                text = text.as_py()
                if model is not None and text and has_letter(text):
                    held.append(windows_of(text.encode()))
                    owner.append(i)
                    waiting += len(held[-1])
                    if waiting >= HELD_WINDOWS:
                        flush()
                        waiting = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), *[batch.column(1)] * keep_row], names=["id", "lang_pred", "score", *["row"] * keep_row])

    second = F.struct("*").alias("row") if keep_row else F.col(text_col).cast("string").alias("text")
    schema = T.StructType().add("id", "long").add("lang_pred", "string").add("score", "double")
    return docs.select(F.col(id_col).cast("long").alias("id"), second).mapInArrow(run, schema.add("row", docs.schema) if keep_row else schema)
