"""License scans: exact phrases and fuzzy search for short notices.

Base: places where a phrase's words stand consecutively. Notices: each is split into k + 1 pieces (k its edit
budget), of which one must occur exactly (pigeonhole); an automaton finds the pieces in the normalised text, and the
regex library's bounded-error matching verifies the window around each hit and reports spans and edits. Licenses
that a word or two tell apart have a notice each, so that the true one has the fewest edits.

Edge cases: null and empty texts have no words, null positions, empty labels, score 0; overlapping places all count;
of overlapping spans the one of fewest edits is reported; repeated rows are scanned alike. Extra
columns are ignored.
"""

from __future__ import annotations

import bisect

import ahocorasick
import regex
from pyspark.sql import DataFrame, SparkSession

from palisade.llm.common import map_texts

#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices (words only, lower case) and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "licensed under the gnu general public license version 3": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "mozilla public license version 2 0": "mpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by nd 4 0": "cc-by-nd",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa",
    "licensed under cc by nc nd 4 0": "cc-by-nc-nd",
    "creative commons attribution 4 0 international": "cc-by",
    "creative commons attribution noncommercial 4 0 international": "cc-by-nc",
    "creative commons attribution sharealike 4 0 international": "cc-by-sa",
    "creative commons attribution noderivatives 4 0 international": "cc-by-nd",
    "creative commons zero 1 0 universal": "cc0",
    "licensed under the gnu general public license version 2": "gpl",
    "eclipse public license version 2 0": "epl",
    "boost software license version 1 0": "boost",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this software is provided as is without any express or implied warranty": "zlib",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "proprietary",
}
#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 10
# A-Z lower-cased; ASCII other than digits and letters separates words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def budget(notice: str) -> int:
    return max(1, len(notice) // CHARS_PER_EDIT)


def pieces(notice: str) -> list[tuple[int, str]]:
    """budget + 1 disjoint pieces with their offsets."""
    k = budget(notice) + 1
    cuts = [len(notice) * i // k for i in range(k + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


def normalise(text: str) -> tuple[str, int]:
    """Words joined by single spaces, with one at either end, and their number."""
    words = text.encode("utf-8", "surrogatepass").translate(_TABLE).split()
    return (" " + b" ".join(words).decode("utf-8", "surrogatepass") + " ", len(words)) if words else (" ", 0)


class Scanner:
    def __init__(self, notices: dict[str, str] = NOTICES, phrases: dict[str, str] = PHRASES):
        self.notices, self.phrases = notices, phrases
        seeds: dict[str, list[tuple[str, int]]] = {}
        for notice in notices:
            for off, piece in pieces(notice):
                seeds.setdefault(piece, []).append((notice, off))
        self.automaton = ahocorasick.Automaton()
        for piece, where in seeds.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()
        self.patterns = {n: regex.compile(f"(?b)(?:{regex.escape(n)}){{e<={budget(n)}}}") for n in notices}

    def exact(self, norm: str) -> list[tuple[int, str]]:
        """(first word, label) of every place of every phrase."""
        found = []
        if "license" not in norm:
            return found
        for phrase, label in self.phrases.items():
            at, before, n = norm.find(f" {phrase} "), 0, 0
            while at >= 0:
                n, before = n + norm.count(" ", before, at), at
                found.append((n, label))
                at = norm.find(f" {phrase} ", at + 1)
        return found

    def fuzzy(self, norm: str) -> list[tuple[int, int, str, int]]:
        """(start, end, notice, edits) in the normalised text."""
        windows: dict[str, list[list[int]]] = {}
        for end, (n, where) in self.automaton.iter(norm):
            for notice, off in where:
                k = budget(notice)
                lo = max(0, end + 1 - n - off - k)
                hi = min(len(norm), lo + len(notice) + 3 * k)
                own = windows.setdefault(notice, [])
                if own and lo <= own[-1][1]:
                    own[-1] = [min(lo, own[-1][0]), max(hi, own[-1][1])]
                else:
                    own.append([lo, hi])
        found = []
        for notice, own in windows.items():
            rest = []
            for lo, hi in own:  # exact places first; what lies between them is searched for the others
                at = norm.find(notice, lo, hi)
                while at >= 0:
                    found.append((at, at + len(notice), notice, 0))
                    rest.append((lo, at))
                    lo = at + len(notice)
                    at = norm.find(notice, lo, hi)
                rest.append((lo, hi))
            while rest:  # the search gives the best place of a window: what lies before and after it is searched too
                lo, hi = rest.pop()
                if hi - lo >= len(notice) - budget(notice) and (m := self.patterns[notice].search(norm, lo, hi)):
                    found.append((m.start(), m.end(), notice, sum(m.fuzzy_counts)))
                    rest += [(lo, m.start()), (max(m.end(), lo + 1), hi)]
        kept: list[tuple[int, int, str, int]] = []  # disjoint, in order
        for s in sorted(found, key=lambda s: (s[3], s[0], s[2])):  # of overlapping spans the one of fewest edits
            i = bisect.bisect(kept, s)
            if (i == 0 or kept[i - 1][1] <= s[0]) and (i == len(kept) or s[1] <= kept[i][0]):
                kept.insert(i, s)
        return kept

    def __call__(self, texts: list[str]) -> list:
        cols: list[list] = [[] for _ in range(8)]
        for t in texts:
            norm, n = normalise(t)
            places, spans = self.exact(norm), self.fuzzy(norm)
            starts = [p for p, _ in places]
            base = {x for _, x in places}
            labels = base | {self.notices[s[2]] for s in spans}
            score = 1.0 if places else max((1 - e / len(q) for _, _, q, e in spans), default=0.0)
            row = (n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, ";".join(f"{self.notices[q]}:{a}-{b}:{e}" for a, b, q, e in spans))
            for c, v in zip(cols, row):
                c.append(v)
        return cols


ADDED = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """docs without text, with the scan's columns; spans: label:start-end:edits in the normalised text."""
    return map_texts(docs, Scanner, ADDED)


def op4_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
