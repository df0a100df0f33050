"""License scan: Aho-Corasick finds identifier tags and notice phrases; a shunting-yard parser evaluates expressions."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases whose places make n_base, and their labels. Fixed values.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notice phrases and their labels. Fixed values.
NOTICES = {
    "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by sa": "cc-by-sa", "cc0": "cc0", "creative commons zero": "cc0",
    "apache license": "apache", "mit license": "mit", "permission is hereby granted free of charge": "mit",
    "bsd license": "bsd", "redistribution and use in source and binary forms": "bsd", "isc license": "isc",
    "boost software license": "bsl", "mozilla public license": "mpl", "eclipse public license": "epl",
    "lesser general public license": "lgpl", "affero general public license": "agpl", "dedicated to the public domain": "public-domain",
    "released into the public domain": "public-domain", "proprietary and confidential": "proprietary",
    "creative commons attribution": "cc-by", "attribution sharealike": "cc-by-sa", "attribution share alike": "cc-by-sa", "attribution noncommercial": "cc-by-nc",
    "attribution non commercial": "cc-by-nc", "attribution noderivatives": "cc-by-nd", "attribution noderivs": "cc-by-nd", "creativecommons org licenses by": "cc-by",
    "creativecommons org licenses by sa": "cc-by-sa", "creativecommons org licenses by nc": "cc-by-nc", "creativecommons org licenses by nd": "cc-by-nd",
    "creativecommons org publicdomain zero": "cc0", "apache org licenses": "apache", "licensed under the apache": "apache", "opensource org licenses mit": "mit",
    "licensed under the mit": "mit", "opensource org licenses isc": "isc", "mozilla org mpl": "mpl", "gnu gpl": "gpl", "gplv2": "gpl", "gplv3": "gpl", "gpl version": "gpl",
    "gnu lgpl": "lgpl", "lgplv2": "lgpl", "lgplv3": "lgpl", "lgpl version": "lgpl", "gnu agpl": "agpl", "agplv3": "agpl", "agpl version": "agpl",
    "library general public license": "lgpl", "gnu free documentation license": "gfdl", "open database license": "odbl", "artistic license": "artistic", "zlib license": "zlib",
    "free and unencumbered software": "unlicense", "boost org license": "bsl", "eclipse org legal epl": "epl", "for non commercial use only": "noncommercial", "for noncommercial use only": "noncommercial",
}
#: What a label obliges to, from 0 (nothing) to 1 (no use allowed). Fixed values.
OBLIGATION = {
    "cc0": 0.05, "public-domain": 0.05, "unlicense": 0.05, "mit": 0.1, "isc": 0.1, "bsl": 0.1, "zlib": 0.1, "bsd": 0.15, "apache": 0.2, "cc-by": 0.3,
    "mpl": 0.4, "epl": 0.4, "artistic": 0.4, "lgpl": 0.5, "cc-by-sa": 0.6, "gfdl": 0.6, "odbl": 0.6, "cc-by-nd": 0.7, "gpl": 0.7, "agpl": 0.8, "cc-by-nc": 0.8, "noncommercial": 0.8, "proprietary": 1.0, "reserved": 1.0,
}
UNKNOWN = 0.6
#: An exception lifts part of what a licence obliges to.
EXCEPTION = 0.7
TAG = "spdx license identifier"
_TAG_START = re.compile(r"(?i)spdx-license-identifier:")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+\-]+")
_BINDS = {"or": 1, "and": 2, "with": 3}
#: Lower-cases A-Z and makes all other ASCII but digits and a-z a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def label_of(identifier: str) -> str:
    """The label of an SPDX identifier: its family, the longest label that it begins with; else itself."""
    x = identifier.lower()
    return max((k for k in OBLIGATION if x == k or x.startswith((k + "-", k + "+"))), key=len, default=x)


def to_postfix(text: str, start: int = 0, stop: int = sys.maxsize) -> tuple[list[str], bool]:
    """Shunting-yard: (the expression at ``start`` in postfix order, whether it is whole). It ends at ``stop``, or behind a
    complete operand at a word, an opening bracket or a closing one without a partner: these are prose. Of a malformed
    expression the identifiers stay, up to the fault and without operators or exceptions."""
    out: list[str] = []
    named: list[str] = []  # identifiers, without what follows "with"
    stack: list[str] = []
    operand, opened, previous = True, 0, ""  # an operand is due; brackets open
    for m in _TOKEN.finditer(text, start, stop):
        token = m[0]
        op = token.lower()
        if op in _BINDS:
            if operand:
                return named, False
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[op]:
                out.append(stack.pop())
            stack.append(op)
            operand = True
        elif token == "(":
            if not operand:
                break
            stack.append(token)
            opened += 1
        elif token == ")":
            if operand:
                return named, False
            if not opened:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            opened -= 1
        else:
            if not operand:
                break
            out.append(token)
            if previous != "with":
                named.append(token)
            operand = False
        previous = op
    if operand or opened:
        return named, False
    return out + stack[::-1], True


def evaluate(text: str, start: int = 0, stop: int = sys.maxsize) -> tuple[set[str], float]:
    """(labels, obligation) of the expression there: "or" leaves the choice of the lesser, "and" binds to the greater, "with" lifts a part.
    A malformed expression is ``unknown`` beside the labels that it names, and binds to the greatest of all of them."""
    postfix, whole = to_postfix(text, start, stop)
    if not whole:
        named = {label_of(x) for x in postfix}
        return named | {"unknown"}, max([UNKNOWN, *(OBLIGATION.get(x, UNKNOWN) for x in named)])
    stack: list[tuple[set[str], float]] = []
    for token in postfix:
        if token in _BINDS and len(stack) >= 2:
            (right, y), (left, x) = stack.pop(), stack.pop()
            if token == "with":
                stack.append((left, x * EXCEPTION))
                continue
            more, less = (left, right) if len(left) >= len(right) else (right, left)
            more |= less  # the smaller set into the larger: long expressions cost n log n
            stack.append((more, min(x, y) if token == "or" else max(x, y)))
        else:
            label = label_of(token)
            stack.append(({label}, OBLIGATION.get(label, UNKNOWN)))
    return stack[-1]


@lru_cache(1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in {**BASE_PHRASES, **NOTICES, TAG: TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of a whole text.

    The words are laid out between single spaces (bytes as Latin-1 letters), so a phrase between spaces is whole
    words, and neighbours may share a space. The automaton reports every place, overlapping ones too.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split(b" ")
    words = [w for w in words if w]
    line = f" {b' '.join(words).decode('latin-1')} "
    at, seen, base, labels, oblige, tagged = 0, 0, [], set(), [], False
    for end, phrase in sorted((e - len(p) - 1, p) for e, p in _automaton().iter(line)):
        seen, at = seen + line.count(" ", at, end), end  # words before this place
        if phrase == TAG:
            tagged = True
            continue
        if phrase in BASE_PHRASES:
            base.append((seen, BASE_PHRASES[phrase]))
        label = BASE_PHRASES.get(phrase) or NOTICES[phrase]
        labels.add(label)
        oblige.append(OBLIGATION[label])
    tags = list(_TAG_START.finditer(text)) if tagged else []
    for k, m in enumerate(tags):
        after = tags[k + 1].start() if k + 1 < len(tags) else len(text)
        stop = text.find("\n", m.end(), after)
        stop = after if stop < 0 else stop
        if stop > m.end():
            own, weight = evaluate(text, m.end(), stop)
            labels |= own
            oblige.append(weight)
    join = lambda x: ",".join(sorted(x))
    return len(words), len(base), base[0][0] if base else None, max(s for s, _ in base) if base else None, join({x for _, x in base}), join(labels), max(oblige, default=0.0)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row with the fields of ``scan``; ``score`` is the greatest obligation of all that applies.

    No shuffle. Null text: as empty, no labels, score 0. Repeated rows and null ids each get their row; other columns
    are not read. Expressions of tags, however long, end at the line's end, the next tag, or the prose behind them.
    """
    import pyarrow as pa

    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i.as_py(), *scan(t.as_py())) for i, t in zip(batch.column(0), batch.column(1), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
