"""Embedding whitening against plain whole-number and numpy versions."""

from __future__ import annotations

import math

import numpy as np
import pytest

from deviatix.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, n int, component string, v string"


def brute(vectors: list[list[float]]) -> tuple[int, list[int], list[int], np.ndarray]:
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    deviation = [sum((n * r[i] - s[i]) ** 2 for i in range(d)) for r in x]
    cov = np.array([[sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x) / n**3 for j in range(d)] for i in range(d)])
    return n, s, deviation, cov


def check(rows, vectors: dict, most: int = 8) -> None:
    n, s, deviation, cov = brute(list(vectors.values()))
    value = np.linalg.eigvalsh(cov)[::-1]
    got: dict = {}
    for r in rows:
        got.setdefault(r.component, {})[r.vec_id] = r
    assert sorted(got) == list(range(1, min(most, len(s)) + 1))
    for k, own in got.items():
        assert own.keys() == vectors.keys()
        assert all(r.n == n for r in own.values())
        assert [own[i].deviation for i in vectors] == deviation
        assert {r.explained for r in own.values()} == {next(iter(own.values())).explained}
        assert next(iter(own.values())).explained == pytest.approx(value[k - 1] / value.sum(), rel=1e-6)
    w = np.array([[got[k][i].whitened for k in sorted(got)] for i in vectors])
    # whitened is the projection on unit eigenvectors: its back-projection through the covariance holds
    centred = np.array([[math.floor(1024 * float(c)) + 100_000 - t / n for c, t in zip(v, s, strict=True)] for v in vectors.values()])
    assert np.abs(w.T @ w / n - np.eye(w.shape[1])).max() < 1e-8
    axes = centred.T @ w / n / np.sqrt(value[: w.shape[1]])
    assert np.allclose(np.linalg.norm(axes, axis=0), 1, atol=1e-8) and np.allclose(cov @ axes, axes * value[: w.shape[1]], rtol=1e-6, atol=1e-6 * value[0])
    errors = {r.identity_error for r in rows}
    assert len(errors) == 1 and errors.pop() < 1e-8


def test_cross_products():
    r = np.random.default_rng(1)
    for low, high, shape in ((-5, 6, (40, 3)), (10**9, 10**9 + 700, (200, 5)), (-(1 << 40), 1 << 40, (70, 4)), (7, 8, (9, 2)), (0, 2, (1, 1))):
        x = r.integers(low, high, shape)
        assert (whitening.cross_products(x) == x.astype(object).T @ x.astype(object)).all()


def test_against_brute_force(spark):
    r = np.random.default_rng(2)
    vectors = {i: (r.normal(size=11) * np.linspace(1, 3, 11)).astype(np.float32).tolist() for i in range(300)}
    rows = [(i, v, 1, "c", None) for i, v in vectors.items()]
    rows += [(900, None, None, None, None), (901, [None, *vectors[0][1:]], 1, "", ""), (902, [float("nan"), *vectors[0][1:]], 1, "", ""), (903, [float("-inf"), *vectors[0][1:]], 1, "", ""), (904, [], 1, "", ""), (905, vectors[0][:4], 1, "", "")]
    for parts in (1, 7):
        check(whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect(), vectors)


def test_odd_tables(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None, 1, "", "")], SCHEMA)).collect() == []
    same = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0], 1, "", ""), (3, [1.0, 2.0], 1, "", "")], SCHEMA)).collect()
    assert sorted((r.vec_id or 0, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same) == [(i, k, 2, 0, None, None, None) for i in (0, 3) for k in (1, 2)]
    line = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1, "", ""), (1, [1.0, 2.0], 1, "", ""), (2, [3.0, 2.0], 1, "", "")], SCHEMA)).collect()
    assert all(r.whitened is None for r in line if r.component == 2)
    assert sorted(round(abs(r.whitened), 9) for r in line if r.component == 1) == sorted(round(x, 9) for x in (0.5**0.5, 0.5**0.5, 2**0.5))
    far = whitening.whiten(spark.createDataFrame([(1, [3e38, 0.0], 1, "", ""), (2, [-3e38, 1.0], 1, "", "")], SCHEMA)).collect()
    assert {r.deviation for r in far} == {None} and all(abs(abs(r.whitened) - 1) < 1e-9 for r in far if r.component == 1)


def test_op12(spark):
    data = "/root/testdata/sf0.001"
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    check(queries.queries()["op12_whitening"](spark, data).collect(), vectors)
