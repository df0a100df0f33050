"""What caps and defaults of the training-data operators once cut off."""

from __future__ import annotations

import pytest

from deviatix.llm import decontaminate, language, licenses

from .test_operators import brute_hits, corpus, docs, items  # noqa: F401


def labels(text):
    return licenses.scan(text)[5:]


def test_license_expressions_are_whole():
    names = [f"Own-{k}" for k in range(200)]
    assert labels("SPDX-License-Identifier: " + " AND ".join(names) + " AND GPL-2.0\nMIT") == (",".join(sorted([*(n.lower() for n in names), "gpl"])), 0.7)
    nested = "(" * 300 + "MIT" + " AND ISC)" * 300
    assert labels(f"SPDX-License-Identifier: {nested}") == ("isc,mit", 0.1)
    assert labels(f"// SPDX-License-Identifier: MIT */ {'x ' * 20} /* SPDX-License-Identifier: GPL-3.0-only */ code") == ("gpl,mit", 0.7)
    assert labels("spdx-license-identifier: MIT (see LICENSE)") == ("mit", 0.1)
    assert labels("(SPDX-License-Identifier: MIT) text") == ("mit", 0.1)
    assert labels("SPDX-License-Identifier: (MIT OR\nISC)") == ("unknown", licenses.UNKNOWN)
    assert labels("SPDX-License-Identifier:\nMIT") == ("", 0.0)
    assert licenses.evaluate("MIT AND (GPL-2.0") == ({"unknown"}, licenses.UNKNOWN)


def test_long_license_expressions_cost_in_proportion():
    n = 100_000
    many = " OR ".join(f"L{k}" for k in range(n))
    assert len(licenses.evaluate(many)[0]) == n
    assert len(licenses.evaluate("(" + " OR (".join(f"L{k}" for k in range(n)) + ")" * n)[0]) == n
    assert licenses.scan("SPDX-License-Identifier: MIT " * n)[5:] == ("mit", 0.1)


@pytest.mark.parametrize("window", [8, 13])
def test_contamination_of_other_windows(spark, docs, window):  # noqa: F811
    texts = [t for _, t, *_ in corpus() if t and len(t) > 300]
    own = [*items(), (8, " ".join(texts[2].split()[:11])), (9, " ".join(texts[3].split()[2:14]))]
    got = {r.id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.contamination(docs, spark.createDataFrame(own, "item_id long, text string"), window=window).collect()}
    assert got == brute_hits(corpus(), own, window)
    assert sum(v[1] > window for v in got.values()) >= 2


def test_every_label_is_learned(spark):
    sets = {"aa": "the ing and", "bb": "que lle eau", "cc": "sch ung der", "dd": "ski ego ych"}
    rows = [(i, f"{sets[k]} {i} " * 20, k) for i in range(400) for k in ["aa" if i % 2 else "bb" if i % 3 else "cc" if i % 4 else "dd"]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df, docs_per_language=20, max_languages=2)
    assert model.classes == ["aa", "bb", "cc", "dd"]
    assert {(r.id, r.lang_pred) for r in language.predict(df, model).collect()} == {(i, k) for i, _, k in rows}


def test_codecs_of_very_long_and_many_texts():
    """Texts longer than a block, with and without white space, and every way in which texts meet in one."""
    import random

    import numpy as np
    import pyarrow as pa

    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from deviatix.llm import bpe
    from deviatix.llm.pieces import utf8_column

    r = random.Random(5)
    parts = ["'s", "'ll", "'", " '", "s", " ", "  ", "\n", "　", "\xa0", "é", "É", "１", "½", "中", "1", "23", "!", " !", "<|endoftext|>", "\t", "\x1c", "\x85", "​", "👍", "Σ", "word", " Word", "İ"]
    short = ["".join(r.choices(parts, k=r.randint(0, 25))) for _ in range(1500)]
    long = "".join(r.choices(parts, k=1_400_000))
    plain = " ".join(r.choices(["the", "of", "Naïve", "it's", "12"], k=1_200_000))
    texts = [*short, long, None, plain, "x" * 1_500_000, "", " " * 1_500_000, *short[:50], plain[:1_100_000] + "<|endoftext|>" + plain[:1_100_000]]
    for name, kind, method in (("byte_bpe_50k.json", bpe.ForcedBoundaryCodec, "encode"), ("word_bpe_49k.json", bpe.WordCodec, "encode_texts")):
        tok, codec = Tokenizer.from_file(P.path(name)), kind(open(P.path(name), encoding="utf-8").read())
        data, at = utf8_column(pa.array(texts, pa.string()))
        got = [(ids, count) for _, _, ids, count in getattr(codec, method)(data, at)]
        ids, count = (np.concatenate(x) for x in zip(*got, strict=True))
        for text, own in zip(texts, np.split(ids, np.cumsum(count)[:-1]), strict=True):
            assert own.tolist() == tok.encode(text or "", add_special_tokens=False).ids, (text or "")[:50]
            if method == "encode" and len(text or "") < 1000:
                assert codec.decode(own, np.array([len(own)]))[0].tobytes().decode() == tok.decode(own.tolist(), skip_special_tokens=False)


def test_other_tokenizers_are_refused():
    P = pytest.importorskip("public_tokenizers")
    from deviatix.llm import bpe

    with pytest.raises(ValueError, match="byte-level"):
        bpe.ForcedBoundaryCodec(open(P.path("word_bpe_49k.json"), encoding="utf-8").read())
