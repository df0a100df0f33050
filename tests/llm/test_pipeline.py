"""The pipeline against the same steps by brute force."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from .test_operators import SCHEMA, brute_components, brute_hits, brute_lines, corpus, items


def test_pipeline(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    import corpus_pipeline
    from deviatix.llm import language

    rows = [r[:5] for r in corpus()]
    columns = ", ".join(SCHEMA.split(", ")[:5])
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items(), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    rows = [r for r in rows if r[1] and language.has_letter(r[1])]
    lines = brute_lines(rows)
    rows = [(r[0], lines[r[0]][2], *r[2:4], len(lines[r[0]][2])) for r in rows]
    comps = brute_components(rows, 5, 80)
    rows = [r for r in rows if comps[r[0]][1] == r[0]]
    hits = brute_hits(rows, items())
    rows = [r for r in rows if not hits[r[0]][1]]
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {}
    for i, t, *_ in rows:
        ids = tok.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert got == want
    assert len(want) > 5


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null ids and texts, repeated rows and ids, ties, an empty benchmark, a column that clashes, a very long text; and
    no rows at all."""
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    rows = corpus()
    long = "Sentence of its own number " + " ".join(f"{chr(97 + k % 26)}{k}tion the reed" for k in range(60_000))
    odd = [*rows, rows[12], rows[12], (12, "Another text of this id, with words enough to tell", "en", "a", 1, None, None), (None, rows[12][1], None, None, None, None, None), (None, None, None, None, None, None, None), (500, long, "en", "a", len(long), "x", "y")]
    for name, some in (("odd", odd), ("none", [])):
        spark.createDataFrame(some, SCHEMA).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        ids = [r.doc_id for r in out]
        assert set(ids) <= {r[0] for r in some}
        if name == "odd":
            assert 500 in ids and next(r.n_tokens for r in out if r.doc_id == 500) > 100_000
            # of repeated rows, line dedup leaves the lines in those of the largest id: others may be empty
            assert sum(r.n_tokens > 0 for r in out) > 5
        else:
            assert ids == []
