"""License scans: fuzzy search for short notices.

Pigeonhole: a notice with at most k edits holds one of its k + 1 pieces unchanged, so the pieces are
the exact seeds of one automaton. Around each seed hit, in a window that ends between words, the regex
library's bounded-error matching verifies the edits and gives the span of whole words. A hit without edits
is a base place. Every notice within its bound is reported, short words included.

Text is lower-cased (A-Z only) and cut into words of [0-9a-z] and all characters from U+0080; words are
joined by one blank before the search, so punctuation and line ends between words don't matter.
Null text counts as empty: no words, no labels, score 0. Repeated rows give repeated results, an empty table
none. Texts of any length are read whole; of overlapping inexact spans of one label, an exact place stays.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from cytolake.llm.common import text_udf

#: Fixed values. Base phrases and their labels; the last number is the edits that the search allows.
BASE = (
    ("gnu general public license", "gpl", 3),
    ("apache license", "apache", 1),
    ("cc by", "cc-by", 0),
    ("mit license", "mit", 1),
)
#: Fixed values. Further notices that only the method labels.
NOTICES = (
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("creative commons attribution", "cc-by", 3),
    ("mozilla public license", "mpl", 2),
    ("eclipse public license", "epl", 2),
    ("bsd license", "bsd", 1),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("permission is hereby granted free of charge", "mit", 4),
    ("released into the public domain", "public-domain", 3),
    ("all rights reserved", "all-rights-reserved", 2),
)

#: No notice is longer.
LONGEST = max(len(text) for text, _, _ in BASE + NOTICES)

_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    edits: int
    base: bool

    def pieces(self) -> list[tuple[int, str]]:
        """Offset and text of edits + 1 pieces of about equal length."""
        n, parts = len(self.text), self.edits + 1
        cuts = [n * i // parts for i in range(parts + 1)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    def __init__(self, notices: tuple[Notice, ...]):
        import ahocorasick
        import regex

        self.notices = notices
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, notice in enumerate(notices):
            for offset, piece in notice.pieces():
                seeds.setdefault(piece, []).append((k, offset))
        self.seeds = ahocorasick.Automaton()
        for piece, at in seeds.items():
            self.seeds.add_word(piece, (len(piece), at))
        self.seeds.make_automaton()
        self.fuzzy = [regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(n.text, literal_spaces=True)}){{e<={n.edits}}}(?![^ ])") if n.edits else None for n in notices]

    def _matches(self, k: int, text: str, first: int, last: int) -> Iterator:
        """Matches of a notice in a window, by their places.

        The search for the best match passes over a first letter too many that takes the last edit allowed, so words
        outside its matches are tried as the start of one as well.
        """
        found = list(self.fuzzy[k].finditer(text, first, last))
        at = first
        for m in [*found, None]:
            end = m.start() if m else last
            while at < end:
                more = self.fuzzy[k].match(text, at, end)
                if more and more.end() > at:
                    yield more
                    at = more.end()
                at = text.find(" ", at, end) + 1 or end
            if m:
                yield m
                at = m.end() + 1

    def spans(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, edits) over the normalised text, sorted: all exact places, and inexact ones apart from them."""
        exact: set[tuple[int, int, int]] = set()
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (length, at) in self.seeds.iter(text):
            for k, offset in at:
                notice = self.notices[k]
                start = end + 1 - length - offset
                stop = start + len(notice.text)
                if start >= 0 and text.startswith(notice.text, start) and (start == 0 or text[start - 1] == " ") and text[stop : stop + 1] in ("", " "):
                    exact.add((start, stop, k))
                elif notice.edits:
                    windows.setdefault(k, []).append((max(0, start - notice.edits), stop + notice.edits))
        found = [(a, b, k, 0) for a, b, k in exact]
        for k, parts in windows.items():
            # Exact places of a label don't overlap by more than a notice, so the neighbours by start tell.
            taken = sorted((a, b) for a, b, j in exact if self.notices[j].label == self.notices[k].label)
            merged: list[list[int]] = []
            for a, b in sorted(parts):
                # To the word ends outside the window, so that no word is cut before it is verified.
                first, last = text.rfind(" ", 0, a) + 1, text.find(" ", b)
                last = len(text) if last < 0 else last
                if merged and first <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], last)
                else:
                    merged.append([first, last])
            for first, last in merged:
                for m in self._matches(k, text, first, last):
                    near = range(bisect.bisect_left(taken, (m.start() - LONGEST,)), bisect.bisect_left(taken, (m.end(),)))
                    if sum(m.fuzzy_counts) and not any(m.start() < taken[i][1] for i in near):
                        found.append((m.start(), m.end(), k, sum(m.fuzzy_counts)))
        return sorted(found)

    def scan(self, text: str | None) -> tuple:
        words = (text or "").encode().translate(_WORD_BYTES).split()
        joined = b" ".join(words).decode()
        spans = self.spans(joined)
        place, at, shown, base, score = 0, 0, [], [], 0.0
        for start, end, k, edits in spans:
            notice = self.notices[k]
            place += joined.count(" ", at, start)
            at = start
            shown.append(f"{notice.label}:{place}:{place + joined.count(' ', start, end)}:{edits}")
            score = max(score, 1 - edits / len(notice.text))
            if notice.base and not edits:
                base.append((place, notice.label))
        labels = sorted({self.notices[k].label for _, _, k, _ in spans})
        return len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({x for _, x in base})), ",".join(labels), score, ",".join(shown)


@functools.lru_cache(2)
def scanner() -> Scanner:
    return Scanner(tuple(Notice(*x, base=True) for x in BASE) + tuple(Notice(*x, base=False) for x in NOTICES))


def scan_text(text: str | None) -> tuple:
    return scanner().scan(text)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and RESULT for each row: words, base places, labels, the best share of unedited characters, and label:first word:last word:edits of each span."""
    return docs.select("doc_id", text_udf(scan_text, RESULT)("text").alias("r")).select("doc_id", "r.*")
