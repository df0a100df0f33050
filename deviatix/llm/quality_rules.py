"""Quality rules by host: documents' rule failures are pooled by host, shrunk with an empirical beta prior, and the
hosts' verdicts joined back to the documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized_join_hint, written

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: The rules that hosts are judged by, each pooled on its own.
RULES = ("failed", "symbol_heavy", "line_heavy", "odd_words")
#: Hosts up to which the verdicts (some 50 bytes each, counted) are broadcast.
BROADCAST_HOSTS = 200_000


def repeated_window_words(words: list[bytes], window: int = 8) -> int:
    """Words within windows that stand twice or more in the text, the first included; windows are compared exactly.

    Ids of runs of 2, 4, 8 ... words are made from ids of halves, so that equal ids are equal runs.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    have = 1
    while have < window:
        step = min(have, window - have)  # runs of have + step words: two runs of `have` that may overlap
        pair = ids[: len(ids) - step] * (int(ids.max()) + 1) + ids[step:]
        _, ids = np.unique(pair, return_inverse=True)
        have += step
    twice = np.bincount(ids)[ids] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text; words stand between ASCII spaces."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split() splits at exactly these six characters
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_window_words(words)


def document_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 20, max_repeat_percent: int = 30, max_symbol_percent: int = 10, max_dup_line_percent: int = 30, word_length: tuple[float, float] = (2.5, 15.0)) -> DataFrame:
    """id, host, the counts of ``text_stats`` and the ``RULES``, one row per input row; no shuffle.

    ``failed`` is the document's own verdict: too few words or too many of them in repeated windows. The others count
    against its host only: the share of symbols in its characters, of repeated lines in its lines, and its mean word
    length. A text without words breaks none of these three.
    """
    import pyarrow as pa

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() for x in batch.column(2)]
            stats = np.array([(*text_stats(t), t.count("\n") + 1 if t else 0) for t in texts], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(stats[:, k]) for k in range(len(names))]], names=["id", "host", *names])

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text")).mapInArrow(run, "id long, host string, " + ", ".join(f"{x} long" for x in names))
    n, chars = F.col("n_words"), F.col("word_chars")
    rules = {
        "failed": (n < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * n),
        "symbol_heavy": 100 * F.col("n_symbols") > max_symbol_percent * chars,
        "line_heavy": 100 * F.col("n_dup_lines") > max_dup_line_percent * F.col("n_lines"),
        "odd_words": (chars < word_length[0] * n) | (chars > word_length[1] * n),
    }
    return out.withColumns(rules).drop("n_lines")


def _prior(docs: float, failures: float, hosts: int, square: float) -> tuple[float, float]:
    """Mean and strength of the beta prior by moments of the hosts' rates, weighted by documents: their mean, and the
    variance beyond what counts alone explain."""
    mean = min(max(failures / docs, 1e-6), 1 - 1e-6) if docs else 0.5
    noise = mean * (1 - mean) * hosts / docs if docs else 0.0
    spread = max((square / docs if docs else 0.0) - mean * mean - noise, 1e-6)
    return mean, min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6)


def host_verdicts(rules: DataFrame, max_rate: float = 0.5, least_rate: float = 0.25, times: float = 4.0, sigmas: float = 2.0) -> DataFrame:
    """host, docs, failures, rate (of ``failed``, shrunk), broken (the rules that condemn it) and ``bad`` (any does).

    Each rule has its own prior beta(a, b), fitted to the hosts' rates. A rule condemns a host whose posterior mean lies
    ``sigmas`` posterior deviations above ``times`` the prior's mean, ``least_rate`` at least: few documents, or a rate that
    is usual in the corpus (long words where none are spaced), condemn no host. For the documents' own rule the bound is at
    most ``max_rate``, whatever is usual. Documents without a host have no verdict.
    """
    hosts = written(rules.where(F.col("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("docs"), *[F.sum(F.col(r).cast("long")).alias(f"n_{r}") for r in RULES]), "hosts")
    square = lambda r: F.sum(F.col(f"n_{r}") * F.col(f"n_{r}") / F.col("docs"))
    # one row of two sums and two for each rule
    n, hosts_n, *sums = hosts.agg(F.sum("docs"), F.count(F.lit(1)), *[c for r in RULES for c in (F.sum(f"n_{r}"), square(r))]).first()
    posts, broken = {}, []
    for k, rule in enumerate(RULES):
        mean, strength = _prior(n or 0, sums[2 * k] or 0, hosts_n, sums[2 * k + 1] or 0.0)
        post = (F.col(f"n_{rule}") + mean * strength) / (F.col("docs") + strength)
        wide = F.sqrt(post * (1 - post) / (F.col("docs") + strength + 1))
        posts[rule] = post
        bound = max(times * mean, least_rate)
        broken.append(F.when(post - sigmas * wide > (min(bound, max_rate) if rule == "failed" else bound), rule))
    out = hosts.select("host", "docs", F.col("n_failed").alias("failures"), posts["failed"].alias("rate"), F.array_compact(F.array(*broken)).alias("broken"))
    return out.withColumn("bad", F.size("broken") > 0)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """``document_rules`` with the host's ``rate`` and ``broken`` rules (null without a host) and ``kept``: false for
    documents that fail themselves, else unless their host is bad.

    Null texts have no words and fail. Repeated rows each count and get a row; other columns are not read. A host with
    a third of all rows is pooled by partial aggregates; its verdict is joined by broadcast while the counted hosts
    are few, else by a merge join, whose large partitions Spark splits.
    """
    rules = written(document_rules(docs, id_col, text_col, host_col, **limits), "rules")
    verdicts = host_verdicts(rules)
    verdicts = verdicts.select(F.col("host").alias("v_host"), "rate", "broken", "bad")
    out = rules.join(sized_join_hint(verdicts, verdicts.count(), BROADCAST_HOSTS), F.col("host") == F.col("v_host"), "left").drop("v_host")
    return out.withColumn("kept", ~F.col("failed") & ~F.coalesce("bad", F.lit(False)))
