"""Fuzzy search for short license notices.

A notice that matches with k edits or fewer keeps at least one of its k + 1 pieces whole. All pieces of
all notices are found at once by an Aho-Corasick automaton; each hit opens a window in which the notice
can lie, and windows of one notice that touch are joined. A window's edit distances are worked out by a bit-parallel
scan; around the places where k or fewer are enough, the regex library's bounded-error matching, with the fewest
edits that do, verifies the match and reports its span. Of overlapping matches of one notice the one with the fewest
edits is taken (the leftmost of equals), and what it leaves of the others' windows is searched again. All
work but that is on stretches of about a notice's length, so it grows in step with the text. Case is ignored and white space is read as spaces,
both character by character, so spans are those of the text.

The allowed errors are one in ten characters of a notice, insertions, deletions and substitutions alike.

Defined results: NULL and empty texts have no match, an empty table none; repeated rows give repeated matches; texts of any length are
searched whole; a span that matches several notices is reported for each of them, ties between notices included; matches of one notice
don't overlap; other columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ostinata.llm.common import rows_of, table, tidy

NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "mit": "Released under the MIT License",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "gpl-3.0": "licensed under the GNU General Public License, version 3",
    "gpl-2.0": "licensed under the GNU General Public License, version 2",
    "lgpl": "GNU Lesser General Public License",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc-by-4.0": "Creative Commons Attribution 4.0 International License",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "epl-2.0": "made available under the terms of the Eclipse Public License 2.0",
}
#: Characters of a notice for each edit allowed.
CHARS_PER_EDIT = 10


def plain(text: str) -> str:
    """Lower case and single-character white space as spaces, with the same length as the text."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for c in _SPACES:
        low = low.replace(c, " ")
    return low


_SPACES = "\t\n\v\f\r\x85\xa0\u2028\u2029"


def pieces(notice: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of a split into k + 1 pieces of about equal length."""
    cut = [round(i * len(notice) / (k + 1)) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cut, cut[1:])]


class Search:
    def __init__(self, notices: dict[str, str], chars_per_edit: int = CHARS_PER_EDIT):
        import ahocorasick

        self.notices = [(name, plain(n), len(n) // chars_per_edit) for name, n in notices.items() if n]
        self.patterns: dict[tuple[int, int], object] = {}
        self.masks = []
        for _, n, _ in self.notices:
            masks: dict[str, int] = {}
            for i, c in enumerate(n):
                masks[c] = masks.get(c, 0) | 1 << i
            self.masks.append(masks)
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, (_, n, k) in enumerate(self.notices):
            for at, piece in pieces(n, k):
                seeds.setdefault(piece, []).append((i, at))
        self.machine = ahocorasick.Automaton()
        for piece, where in seeds.items():
            self.machine.add_word(piece, (len(piece), where))
        if seeds:
            self.machine.make_automaton()
        self.any = bool(seeds)

    def windows(self, low: str) -> list[tuple[int, int, int]]:
        """(notice, start, end) of the joined windows around all seeds; every match lies within one."""
        opened: dict[int, list[list[int]]] = {}
        for last, (size, where) in self.machine.iter(low):
            for i, at in where:
                _, n, k = self.notices[i]
                begin = last + 1 - size - at - k
                end = begin + len(n) + 2 * k
                w = opened.setdefault(i, [])
                w.append([max(0, begin), min(len(low), end)])
        out = []
        for i, spans in opened.items():
            spans.sort()
            now = spans[0]
            for s in spans[1:]:
                if s[0] <= now[1]:
                    now[1] = max(now[1], s[1])
                else:
                    out.append((i, *now))
                    now = s
            out.append((i, *now))
        return out

    def distances(self, i: int, low: str, start: int, end: int):
        """(place, edits) of the places in low[start:end] where a match of notice i with its allowed edits can end; edits are the fewest."""
        _, notice, k = self.notices[i]
        masks, m = self.masks[i], len(notice)
        full, top = (1 << m) - 1, 1 << (m - 1)
        pv, mv, score = full, 0, m
        for j in range(start, end):
            eq = masks.get(low[j], 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = (ph << 1) & full
            mh = (mh << 1) & full
            pv = mh | (full & ~(xv | ph))
            mv = ph & xv
            if score <= k:
                yield j + 1, score

    def regions(self, i: int, low: str, start: int, end: int):
        """(start, end, edits): stretches that hold all matches of notice i in low[start:end], and the fewest edits of one."""
        _, notice, k = self.notices[i]
        first = last = None
        least = 0
        for at, edits in self.distances(i, low, start, end):
            if first is not None and at == last + 1 and at - first < len(notice):
                last, least = at, min(least, edits)
            else:
                if first is not None:
                    yield max(start, first - len(notice) - k), last, least
                first, last, least = at, at, edits
        if first is not None:
            yield max(start, first - len(notice) - k), last, least

    def verified(self, i: int, low: str, start: int, end: int, edits: int) -> tuple[int, int, int]:
        """(edits, start, end) of the leftmost match of notice i with the fewest edits in low[start:end]."""
        if (i, edits) not in self.patterns:
            import regex

            self.patterns[i, edits] = regex.compile(f"(?b)(?:{regex.escape(self.notices[i][1], literal_spaces=True)}){{e<={edits}}}")
        m = self.patterns[i, edits].search(low, start, end)
        return sum(m.fuzzy_counts), m.start(), m.end()

    def matches(self, i: int, low: str, start: int, end: int) -> list[tuple[int, int, int]]:
        """(start, end, edits) of the matches of notice i in low[start:end] that don't overlap, the best taken first."""
        least = len(self.notices[i][1]) - self.notices[i][2]
        heap: list[tuple[int, int, int, int, int]] = []

        def search(a: int, b: int) -> None:
            if b - a >= least:
                for lo, hi, edits in self.regions(i, low, a, b):
                    heapq.heappush(heap, (*self.verified(i, low, lo, hi, edits), lo, hi))

        search(start, end)
        taken: list[tuple[int, int]] = []
        out = []
        while heap:
            edits, a, b, lo, hi = heapq.heappop(heap)
            at = bisect.bisect(taken, (a, b))
            if not (at and taken[at - 1][1] > a) and not (at < len(taken) and taken[at][0] < b):
                taken.insert(at, (a, b))
                out.append((a, b, edits))
            # what the taken ones leave of the region
            first = bisect.bisect(taken, (lo, lo))
            if first and taken[first - 1][1] > lo:
                first -= 1
            begin = lo
            for x, y in taken[first:]:
                if x >= hi:
                    break
                if x > begin:
                    search(begin, x)
                begin = max(begin, y)
            if begin < hi:
                search(begin, hi)
        return sorted(set(out))

    def __call__(self, text: str) -> list[tuple[str, int, int, int]]:
        """(notice, start, end, edits) of all matches."""
        if not self.any or not text:
            return []
        low = plain(text)
        return sorted((self.notices[i][0], *m) for i, a, b in self.windows(low) for m in self.matches(i, low, a, b))


def scan(docs: DataFrame, notices: dict[str, str] | None = None, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """doc_id, notice, start, end, edits, matched of every match in every text. start and end count characters from 0."""
    chosen = NOTICES if notices is None else notices

    def run(batches):
        find = Search(chosen, chars_per_edit)
        for b in (part for whole in batches for part in rows_of(whole)):
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for name, start, end, edits in find(text) if text else ():
                    for column, value in zip(out, (doc, name, start, end, edits, text[start:end])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], names=["doc_id", "notice", "start", "end", "edits", "matched"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(tidy(run), "doc_id bigint, notice string, start int, end int, edits int, matched string")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
