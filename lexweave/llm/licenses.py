"""Fuzzy search for short licence notices.

A text becomes its words joined by single spaces. A notice that may differ in ``k`` characters
is cut in ``k + 1`` seeds: by the pigeonhole principle one of them stands unchanged in every
match, so an automaton over all seeds finds all candidates in one pass. Around each seed the
``regex`` library's bounded-error matching then verifies the edits and gives the span. Words
that tell licences apart (a name, a version) have to stand in the span as they are.
Phrases with no edits allowed are their own only seed and go the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from lexweave.llm.common import map_rows, text_bytes


@dataclass(frozen=True)
class Notice:
    label: str
    words: str
    edits: int = 0
    base: bool = False
    keys: str = ""  #: words that no edit may touch, in order


#: Phrases that count as base places, then short notices of common licences with the number
#: of single-character edits that still count as the notice.
NOTICES = (
    Notice("mit", "mit license", base=True),
    Notice("apache", "apache license", base=True),
    Notice("gpl", "general public license", base=True),
    Notice("mit-notice", "released under the mit license", 3, keys="mit"),
    Notice("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    Notice("apache-2.0-notice", "licensed under the apache license version 2 0", 4, keys="apache 2 0"),
    Notice("gpl-3.0-notice", "licensed under the gnu general public license version 3", 5, keys="general public 3"),
    Notice("gpl-grant", "this program is free software you can redistribute it and or modify", 6),
    Notice("cc-by-nc-4.0-notice", "licensed under cc by nc 4 0", 2, keys="cc by nc 4 0"),
    Notice("cc-by-4.0-notice", "licensed under cc by 4 0", 2, keys="cc by 4 0"),
    Notice("cc-by-notice", "creative commons attribution", 2),
    Notice("bsd-grant", "redistribution and use in source and binary forms", 4),
    Notice("mpl-notice", "mozilla public license", 2, keys="public"),
    Notice("isc-grant", "permission to use copy modify and or distribute this software", 5),
    Notice("unlicense-grant", "free and unencumbered software released into the public domain", 5),
    Notice("rights-notice", "all rights reserved", 2),
)

#: Upper to lower case; every ASCII character that is no letter or digit is a separator.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def fold(body: bytes) -> str:
    """Words of a text, each followed by a space, after one leading space."""
    words = [w for w in body.translate(_FOLD).split(b" ") if w]
    return " " + b" ".join([*words, b""]).decode("utf-8", "replace")


class NoticeFinder:
    """All places of the notices in one text."""

    def __init__(self, notices=NOTICES):
        self.notices = list(notices)
        self.patterns = [regex.compile(f"(?e)(?: {regex.escape(n.words, special_only=True)} ){{e<={n.edits}}}" if n.edits else regex.escape(f" {n.words} ")) for n in self.notices]
        self.keys = [n.keys.split() for n in self.notices]
        self.seeds = ahocorasick.Automaton()
        table: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(self.notices):
            text = f" {n.words} "
            cuts = [round(j * len(text) / (n.edits + 1)) for j in range(n.edits + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                table.setdefault(text[a:b], []).append((i, a))
        for seed, places in table.items():
            self.seeds.add_word(seed, (len(seed), places))
        self.seeds.make_automaton()

    def _keyed(self, i: int, matched: str) -> bool:
        """Whether the notice's key words stand in the span, whole and in order."""
        words = iter(matched.split())
        return all(k in words for k in self.keys[i])

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """``(notice, start, end, edits)`` of a folded text, in order; spans of one notice that
        allows edits do not overlap, exact phrases are all reported."""
        windows: dict[int, list[list[int]]] = {}
        for last, (size, places) in self.seeds.iter(text):
            for i, at in places:
                k, length = self.notices[i].edits, len(self.notices[i].words) + 2
                start = last - size + 1 - at
                low, high = max(0, start - k), min(len(text), start + length + k)
                own = windows.setdefault(i, [])
                if k and own and low <= own[-1][1]:
                    own[-1][0] = min(own[-1][0], low)
                    own[-1][1] = max(own[-1][1], high)
                else:
                    own.append([low, high])
        found = []
        for i, own in windows.items():
            if not self.notices[i].edits:  # the seed is the phrase
                found += [(i, low, high, 0) for low, high in own]
                continue
            for low, high in own:
                if any(text.find(f" {k} ", low, high) < 0 for k in self.keys[i]):
                    continue
                at = low
                while m := self.patterns[i].search(text, at, high):
                    if keyed := self._keyed(i, m[0]):
                        found.append((i, m.start(), m.end(), sum(m.fuzzy_counts)))
                    at = m.end() if keyed else m.start() + 1  # another notice may overlap this one
        return sorted(set(found), key=lambda x: (x[1], x[0]))


class WordPlaces:
    """Word numbers of places in a folded text: one pass over its spaces, then bisection."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        self.spaces = np.flatnonzero(codes == 32)

    def __len__(self) -> int:
        return len(self.spaces) - 1

    def at(self, places: list[int]) -> list[int]:
        """Index of the word that holds each character (or follows a space there)."""
        return (np.searchsorted(self.spaces, np.array(places, np.int64), "right") - 1).tolist()


def notice_spans(docs: DataFrame, notices=NOTICES) -> DataFrame:
    """One row per place: ``doc_id, label, is_base, first_word, last_word, edits, matched``.

    Null and empty texts, texts without a notice and empty tables give no rows; a null doc_id
    stays null; repeated rows give their places again; other columns are not read. Places that
    overlap are all reported, but for one notice with edits.
    """

    def rows(batch: Iterator[dict]) -> Iterator[dict]:
        finder = NoticeFinder(notices)
        for r in batch:
            text = fold(r["body"])
            found = finder.find(text)
            words = WordPlaces(text)
            first, last = words.at([a for _, a, _, _ in found]), words.at([b - 2 for _, _, b, _ in found])
            for (i, a, b, edits), p, q in zip(found, first, last, strict=True):
                n = finder.notices[i]
                yield {"doc_id": r["doc_id"], "label": n.label, "is_base": n.base, "first_word": p, "last_word": q, "edits": edits, "matched": text[a:b].strip()}

    schema = "doc_id bigint, label string, is_base boolean, first_word bigint, last_word bigint, edits int, matched string"
    return map_rows(docs.select("doc_id", text_bytes().alias("body")), rows, schema)


def license_scan(docs: DataFrame, notices=NOTICES) -> DataFrame:
    """One row per document with its licence places.

    ``n_words`` counts words (runs of ASCII letters, digits and non-ASCII characters, A-Z
    lower-cased); ``n_base``, ``first_word`` and ``last_word`` (start words) and ``base_labels``
    are about exact phrases; ``labels`` adds the notices found with bounded edits and ``score``
    is the best 1 - edits / length among all places, 0 without one. Null and empty texts have
    no words and no places; a null doc_id stays null; repeated rows repeat; other columns are
    not read.
    """

    def rows(batch: Iterator[dict]) -> Iterator[dict]:
        finder = NoticeFinder(notices)
        for r in batch:
            text = fold(r["body"])
            places = finder.find(text)
            base = WordPlaces(text).at([a for i, a, _, _ in places if finder.notices[i].base]) if places else []
            yield {
                "doc_id": r["doc_id"],
                "n_words": text.count(" ") - 1,
                "n_base": len(base),
                "first_word": min(base, default=None),
                "last_word": max(base, default=None),
                "base_labels": ",".join(sorted({finder.notices[i].label for i, *_ in places if finder.notices[i].base})),
                "labels": ",".join(sorted({finder.notices[i].label for i, *_ in places})),
                "score": max((1 - edits / (b - a) for _, a, b, edits in places), default=0.0),
            }

    schema = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    return map_rows(docs.select("doc_id", text_bytes().alias("body")), rows, schema)
