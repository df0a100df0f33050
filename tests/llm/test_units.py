"""What a task holds of the units doesn't grow with its partition."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from deviatix.llm import alignment, queries, units


def test_a_row_group_is_a_unit(spark):
    rows = [(k, f"text {k} " * 40 if k % 7 else None) for k in range(900)]
    packed = units.packed(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "doc_id", "text", 2000)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in packed.inputFiles()]
    groups = [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]
    assert len(groups) > 100 and set(groups) == {1}
    found = units.documents(packed).collect()
    assert sorted((r.id, r.text) for r in found) == rows
    assert len({r.unit for r in found}) == len(groups)


def test_a_worker_holds_a_run_at_a_time():
    r = random.Random(1)
    words = ["".join(r.choices("etaoinshrdlu", k=r.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(r.choices(words, k=500)).encode() for _ in range(1400)]
    at = np.cumsum([0, *map(len, texts)])
    unit = units.Unit(0, pa.array(range(len(texts))), np.zeros(len(texts), bool), np.frombuffer(b"".join(texts), np.uint8), at)
    with open(queries.tokenizer_file("byte_bpe_50k.json")) as a, open(queries.tokenizer_file("piece_bpe_32k.model"), "rb") as b:
        own = alignment.Aligner(a.read(), b.read())
    asked = list(own.pair_requests(unit, 3))
    found = pa.array([x[0] for x in asked]), pa.array([alignment.pair_totals([x[3]])[0] for x in asked])
    tracemalloc.start()
    try:
        columns, data, ends = own.results(unit, found, 3, np.zeros(own.a.lost, np.int64))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (columns[0] > 0).all() and len(ends) == len(at) and ends[-1] == len(data)
    assert peak < 32 * len(unit.data), (peak, len(unit.data))
