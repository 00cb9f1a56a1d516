"""License scans with fuzzy short-notice search.

A notice that may hold e edits is split into e + 1 pieces; at least one of
them stands in the text unchanged.  These exact seeds are found first, all
together by one automaton; then the regex library verifies the text around
each with at most e edits and gives the span.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text.
SEPARATORS = K.separator_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))

#: Phrases that count exactly, word by word, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Short notices that count with edits: text and label.
NOTICES = {
    "gnu general public license": "gpl",
    "licensed under the apache license": "apache",
    "licensed under cc by": "cc-by",
    "released under the mit license": "mit",
    "gnu lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use, copy, modify, and/or distribute this software": "isc",
    "permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "reserved",
    "spdx-license-identifier": "spdx",
}

#: One edit is allowed for each so many characters of a notice.
CHARS_PER_EDIT = 12

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def edits(notice: str) -> int:
    return max(1, len(notice) // CHARS_PER_EDIT)


@functools.cache
def _machine(notices: tuple[tuple[str, str], ...]):
    """The automaton of all pieces, and a pattern for each notice."""
    machine = ahocorasick.Automaton()
    pieces: dict[str, list[tuple[int, int]]] = {}
    patterns = []
    for k, (notice, _) in enumerate(notices):
        e = edits(notice)
        cuts = [len(notice) * i // (e + 1) for i in range(e + 2)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            pieces.setdefault(notice[lo:hi], []).append((k, lo))
        patterns.append(regex.compile(rf"(?b)(?:{regex.escape(notice)}){{e<={e}}}"))
    for piece, places in pieces.items():
        machine.add_word(piece, (len(piece), places))
    machine.make_automaton()
    return machine, patterns


@functools.cache
def _phrases(base: tuple[tuple[str, str], ...]):
    return [(label, phrase.split()[0], regex.compile(f"(?<!{_WORD})" + _GAP.join(map(regex.escape, phrase.split())) + f"(?!{_WORD})")) for phrase, label in base]


def fuzzy_spans(low: str, notices: tuple[tuple[str, str], ...]) -> list[tuple[int, int, str, int]]:
    """(start, end, label, edits) of notices in lower-cased text; of overlapping places of a notice that with fewest edits, then the first.

    Each seed is verified by itself: a match that holds it stands within the
    notice's length and its edits around it, and a window of that size has room
    for no second one beside it.
    """
    machine, patterns = _machine(notices)
    windows: dict[int, set[tuple[int, int]]] = {}
    for last, (size, places) in machine.iter(low):
        for k, offset in places:
            notice = notices[k][0]
            e = edits(notice)
            begin = last - size + 1 - offset
            windows.setdefault(k, set()).add((max(0, begin - e), min(len(low), begin + len(notice) + e)))
    out = []
    for k, mine in windows.items():
        found = {(sum(m.fuzzy_counts), m.start(), m.end()) for lo, hi in mine if (m := patterns[k].search(low, lo, hi)) is not None}
        out += [(a, b, notices[k][1], e) for e, a, b in apart(found)]
    return sorted(set(out))


def apart(found: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(edits, start, end) of places that do not overlap, those of fewest edits first, then the first."""
    kept: list[tuple[int, int]] = []  # in order of place
    out = []
    for e, a, b in sorted(found):
        k = bisect.bisect_left(kept, (a, b))
        if (k == 0 or kept[k - 1][1] <= a) and (k == len(kept) or b <= kept[k][0]):
            kept.insert(k, (a, b))
            out.append((e, a, b))
    return out


def _scan(base, notices) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = _phrases(base)
        longest = {label: max(len(n) for n, l in notices if l == label) for _, label in notices}
        for batch in batches:
            for i, j, body, at in K.chunks(batch.column(1)):
                low = K.LOWER[body]
                starts, _, first = K.word_bounds(low, at, SEPARATORS)
                whole = low.tobytes()
                out = {c: [] for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "spans", "score")}
                for k in range(j - i):
                    raw = whole[at[k] : at[k + 1]]
                    text = raw.decode("utf-8", "surrogatepass")
                    lead = None if len(text) == len(raw) else np.flatnonzero((body[at[k] : at[k + 1]] & 0xC0) != 0x80)  # the byte at which each code point begins
                    places, exact = [], set()
                    for label, head, pattern in phrases:
                        if head in text:
                            for m in pattern.finditer(text):
                                places.append(m.start() if lead is None else lead[m.start()])
                                exact.add(label)
                    found = fuzzy_spans(text, notices)
                    index = np.searchsorted(starts, np.array(places, np.int64) + at[k]) - first[k]
                    out["n_base"].append(len(places))
                    out["first_word"].append(int(index.min()) if len(index) else None)
                    out["last_word"].append(int(index.max()) if len(index) else None)
                    out["base_labels"].append(",".join(sorted(exact)))
                    out["labels"].append(",".join(sorted(exact | {x[2] for x in found})))
                    out["spans"].append([{"start": a, "end": b, "label": label, "edits": e} for a, b, label, e in found])
                    out["score"].append(1.0 if exact else max((1 - e / longest[label] for _, _, label, e in found), default=0.0))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(np.diff(first)),
                        *(pa.array(out[c], pa.int64()) for c in ("n_base", "first_word", "last_word")),
                        *(pa.array(out[c], pa.string()) for c in ("base_labels", "labels")),
                        pa.array(out["score"], pa.float64()),
                        pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("edits", pa.int32())]))),
                    ],
                    names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
                )

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """One row per row: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Base phrases count where their words stand one after another.  ``spans``
    are the fuzzy notices (code points, end exclusive, with their edits);
    ``labels`` has both kinds.  score is 1 with a base phrase, else 1 less the
    share of edits in the best notice, 0 without any.  A null or empty text has
    no words, null places, empty labels and score 0.  Repeated rows stay; other
    columns are ignored; texts are scanned whole.
    """
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    schema = (
        f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<start: int, end: int, label: string, edits: int>>"
    )
    out = given.mapInArrow(_scan(tuple((base or BASE).items()), tuple((notices or NOTICES).items())), schema)
    return out.withColumnRenamed("id", id_col)
