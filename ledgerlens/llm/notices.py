"""License notices: exact base phrases, and a fuzzy search for short notices.

The words of a text, joined by single blanks, are searched once. A notice that may differ by `edits` characters is split into
edits + 1 parts: whatever lies within that distance holds one of them unchanged. An Aho-Corasick automaton finds the parts, and
only the surroundings they point to are matched by the regex library with that bound of errors, which verifies the edits and gives
the span; borders of words are part of the pattern, so edits at either end are spent on whole words.

Defined results: null and empty texts have no words, places or labels and score 0; repeated rows and null ids each give a row;
other columns are not read. Of overlapping matches of one notice the first from the left counts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .nearcopies import few_edits
from .rows import KEY, kind, named
from .tokens import raw
from .words import SPACED, slices

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Short notices: label, words as they are searched (lower case, single blanks), characters that may differ.
NOTICES = (
    ("apache", "licensed under the apache license version 2 0", 3),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 4),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 5),
    ("gpl", "under the terms of the gnu general public license", 3),
    ("lgpl", "gnu lesser general public license", 3),
    ("mpl", "subject to the terms of the mozilla public license", 3),
    ("cc-by", "creative commons attribution", 2),
    ("cc0", "dedicated to the public domain", 2),
    ("reserved", "all rights reserved", 1),
    ("copyright", "copyright c", 0),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", 4),
    ("no-warranty", "provided as is without warranty of any kind", 3),
)


class Notices:
    """The compiled search; one a task."""

    def __init__(self, notices=NOTICES):
        import ahocorasick
        import regex
        self.notices, self.patterns = notices, []
        parts = {}
        for n, (_, words, edits) in enumerate(notices):
            size = -(-len(words) // (edits + 1))
            for at in range(0, len(words), size):
                parts.setdefault(words[at: at + size], []).append((n, at))
            self.patterns.append(regex.compile(
                rf"(?e) ((?:{regex.escape(words, literal_spaces=True)}){{e<={edits}}})(?![^ ])"))
        self.parts = ahocorasick.Automaton()
        for part, uses in parts.items():
            self.parts.add_word(part, (len(part), uses))
        self.parts.make_automaton()

    def spans(self, text: str):
        """(label, first and last character + 1, edits) of the notices in a text of single-blank words; whole words only."""
        found: dict[int, list[tuple[int, int]]] = {}
        for end, (size, uses) in self.parts.iter(text):
            for n, at in uses:
                _, words, edits = self.notices[n]
                low = end + 1 - size - at - edits
                # One character more shows whether a word ends there.
                found.setdefault(n, []).append((max(0, low), min(len(text), low + len(words) + 2 * edits + 1)))
        # The pattern begins with a blank, as the library inserts nothing where a match starts: places are one further on.
        padded = f" {text}"
        for n, places in sorted(found.items()):
            done = 0
            for low, high in joined(places):
                low = max(low, done)
                for match in self.patterns[n].finditer(padded, low, high + 1):
                    start, stop = (at - 1 for at in match.span(1))
                    while start < stop and text[start] == " ":
                        start += 1
                    while stop > start and text[stop - 1] == " ":
                        stop -= 1
                    edged = (not start or text[start - 1] == " ") and (stop == len(text) or text[stop] == " ")
                    if edged and stop > start and start >= done:
                        # The library's count is not always the least for its span.
                        label, words, _ = self.notices[n]
                        yield label, start, stop, few_edits(list(words), list(text[start:stop]), len(words) + stop - start)
                        done = stop


def joined(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping places as one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(places):
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], high)
        else:
            out.append((low, high))
    return out


def base_places(text: str) -> list[tuple[int, str]]:
    """(word number, label) of every place where a base phrase's words stand one after another."""
    places = []
    padded = f" {text} "
    for phrase, label in BASE.items():
        sought, at = f" {phrase} ", -1
        counted, words = 0, 0
        while (at := padded.find(sought, at + 1)) >= 0:
            words += padded.count(" ", counted, at)
            counted = at
            places.append((words, label))
    return places


def _row(text: bytes, search: Notices):
    words = text.translate(SPACED).split()
    clean = b" ".join(words).decode("utf-8", "replace")
    base = base_places(clean)
    spans = [(label, start, stop, clean.count(" ", 0, start), edits) for label, start, stop, edits in search.spans(clean)]
    base_labels, labels = {x for _, x in base}, {x for _, x in base} | {s[0] for s in spans}
    scores = [1.0] * bool(base) + [1 - e / max(1, stop - start) for _, start, stop, _, e in spans]
    return (len(words), len(base), min((w for w, _ in base), default=None), max((w for w, _ in base), default=None),
            ",".join(sorted(base_labels)), ",".join(sorted(labels)), max(0.0, max(scores, default=0.0)),
            [{"label": s[0], "first_word": s[3], "n_words": clean.count(" ", s[1], s[2]) + 1, "edits": s[4]} for s in spans])


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int64())]))


def scanned(docs: DataFrame, notices=NOTICES) -> DataFrame:
    """One row for each row of `docs`: doc_id, text_hash, n_words, n_base, first_word, last_word, base_labels, labels, score
    (1 for a base phrase, else the best match's share of unchanged characters) and spans of the fuzzy search."""
    names = [*KEY, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _SPANS]

    def scan(batches):
        search = Notices(notices)
        for batch in batches:
            for part in slices(batch):
                rows = [_row(t, search) for t in raw(part.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"),
                     *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]], names)

    return named(docs).mapInArrow(scan, f"doc_id {kind(docs)}, text_hash long, n_words long, n_base long, first_word long, "
                                  "last_word long, base_labels string, labels string, score double, "
                                  "spans array<struct<label: string, first_word: bigint, n_words: bigint, edits: bigint>>")
