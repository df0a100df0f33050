"""Streams over several micro-batches, with rows out of order and late ones."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from deviatix.operators import windows
from deviatix.streaming import jobs

START = dt.datetime(2024, 1, 1)


def stream(spark, folder, batches: list[list[tuple]], schema: str):
    """A file for each micro-batch, read in turn."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part-{k:03d}.parquet")
    import os
    import time

    for k in range(len(batches)):
        stamp = time.time() - 1000 + k
        for d, _, files in os.walk(f"{folder}/part-{k:03d}.parquet"):
            for f in files:
                os.utime(f"{d}/{f}", (stamp, stamp))
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def test_episode_runs_equal_the_batch(spark, tmp_path):
    r = random.Random(1)
    rows = []
    for key in range(4):
        places = [p for p in range(60) if r.random() < 0.9]
        rows += [(f"k{key}", START + dt.timedelta(minutes=p), p, None if r.random() < 0.05 else r.random() < 0.6) for p in places]
    rows.sort(key=lambda x: (x[1] + dt.timedelta(minutes=r.uniform(0, 6)), x[0]))  # up to six minutes out of order
    size = len(rows) // 7 + 1
    batches = [rows[i : i + size] for i in range(0, len(rows), size)]
    late = [("k0", START, 0, True), ("k1", START + dt.timedelta(minutes=1), 1, True)]
    late = [x for x in late]
    schema = "k string, ts timestamp, place long, f boolean"
    got = jobs.run_updates(jobs.episode_runs(stream(spark, tmp_path / "in", [*batches, late], schema), "k", "ts", "place", F.col("f"), late="10 minutes"), ["k"], "seen")
    got = {x.k: (x.rows, x.longest, x.episodes) for x in got.collect()}
    batch = spark.createDataFrame(rows, schema)
    want = windows.persistence(batch, "k", "place", F.col("f"), seconds=60, step=60, require_contiguous=True).collect()
    for w in want:
        own = [x for x in rows if x[0] == w.k]
        assert got[w.k] == (len(own), round(w.longest), w.episodes)


def test_progress(spark, tmp_path):
    r = random.Random(2)
    done = {"a": sorted(r.uniform(0, 3600) for _ in range(300)), "b": [5.0, 8.0, 200.0], "c": [0.0, 1000.0]}
    rows = sorted(((s, START + dt.timedelta(seconds=t)) for s, ts in done.items() for t in ts), key=lambda x: x[1])
    batches = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    totals = spark.createDataFrame([("a", 400), ("b", 10)], "source string, total long")
    job = jobs.progress(stream(spark, tmp_path / "in", batches, "source string, ts timestamp"), totals, "source", "ts", "total", history=300, step=10, late="1 minute")
    got = {x.source: x for x in jobs.run_updates(job, ["source"], "at").collect()}
    base = int(START.replace(tzinfo=dt.UTC).timestamp())
    for s, ts in done.items():
        steps = [int(t // 10) * 10 for t in ts]
        before = [x for x in steps if x <= steps[-1] - 300]
        since = sum(x > before[-1] for x in steps) if before else 0
        rate = since * 60 / (steps[-1] - before[-1]) if since else None
        total = {"a": 400, "b": 10}.get(s)
        assert (got[s].at, got[s].done) == (base + steps[-1], len(ts))
        assert got[s].rate == (pytest.approx(rate) if rate else None)
        assert got[s].eta == (pytest.approx((total - len(ts)) / rate) if rate and total else None)


def test_latest_state_shrinks(spark, tmp_path):
    """Every hour has 50 keys of its own: 600 are seen, and the state never holds those of long ago."""
    batches = [[(f"k{h}-{k % 50}", START + dt.timedelta(hours=h, minutes=k % 60), h * 100 + k, float(k)) for k in range(100)] for h in range(12)]
    states: list = []
    job = jobs.latest_within(stream(spark, tmp_path / "in", batches, "k string, ts timestamp, id long, v double"), ["k"], "ts", "id", "v", keep="1 hour", late="10 minutes")
    got = jobs.run_updates(job, ["k"], "id", on_batch=lambda p: states.extend(x["stateOperators"][0]["numRowsTotal"] for x in p if x["stateOperators"]))
    got = {x.k: (x.v, x.id) for x in got.collect()}
    assert len(got) == 600 and all(v == id % 100 for v, id in got.values()) and all(id % 100 >= 50 for _, id in got.values())
    assert max(states) <= 150 and states[-1] < max(states)
