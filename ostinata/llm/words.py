"""Words of the vocabulary's published splitting pattern by array operations over code points.

The pattern is  's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ . Its matches cover a
text without gaps. They are the runs of letters, numbers, white space and other characters, with these changes: a
run takes a blank before it; white space before such a run gives up its last character; and an apostrophe that
is a run by itself, without a blank, takes an ending from the letters behind it.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pandas as pd

from ostinata.llm.common import span_hashes

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_OTHER, _LETTER, _NUMBER, _WHITE, _END = range(5)
_KINDS: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """The kind of each code point."""
    if not _KINDS:
        import regex

        points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
        every = "".join(map(chr, points.tolist()))
        out = np.zeros(0x110000, np.uint8)
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_WHITE, r"\s+")):
            for m in regex.finditer(pattern, every):
                out[points[m.start() : m.end()]] = kind
        _KINDS.append(out)
    return _KINDS[0]


def spans(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(the texts on one string with a character behind each, its code points, starts and ends of all words, number of words of each text)."""
    whole = "\n".join(texts) + "\n"
    point = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    kind = _kinds()[point]
    kind[ends] = _END
    first = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
    last = np.append(first[1:], len(kind))
    what = kind[first]
    start = np.zeros(len(kind) + 1, bool)
    start[ends] = True  # what ends a text begins no word
    solid = what < _WHITE
    blank = np.zeros(len(first), bool)
    blank[1:] = point[first[1:] - 1] == 32
    blank &= solid & (first > 0)
    begin = first - blank
    # endings behind a lone apostrophe
    lone = np.flatnonzero((what == _OTHER) & (point[first] == 39) & (last - first == 1) & ~blank)
    lone = lone[lone + 1 < len(what)]
    lone = lone[what[lone + 1] == _LETTER]
    if len(lone):
        at = last[lone]
        one = point[at]
        two = np.where(last[lone + 1] - at > 1, point[np.minimum(at + 1, len(point) - 1)], 0)
        size = np.isin(one, [115, 116, 109, 100]) * 1 + (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))) * 2
        begin[lone + 1] += size
    start[begin[solid & (begin < last)]] = True
    white = np.flatnonzero(what == _WHITE)
    start[first[white[(last - first)[white] > 1]]] = True
    follows = what[np.minimum(white + 1, len(what) - 1)]
    end = last[white] - 1
    start[end[(follows != _END) & (point[end] != 32)]] = True
    single = (last - first)[white] == 1
    start[first[white[single & (follows == _END)]]] = True
    start = np.flatnonzero(start[:-1])
    stop = np.append(start[1:], len(kind))
    word = kind[start] != _END
    start, stop = start[word], stop[word]
    return whole, point, start, stop, np.diff(np.searchsorted(start, ends), prepend=0)


def _inside(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of ranges, one range after the other."""
    out = np.repeat(start - (np.cumsum(size) - size), size)
    out += np.arange(len(out))
    return out


def _alike(one: np.ndarray, start: np.ndarray, other: np.ndarray, start_other: np.ndarray, size: np.ndarray) -> bool:
    """Whether all ranges of one hold the same as those of the other."""
    inside = _inside(start, size)
    there = one[inside]
    inside += np.repeat(start_other - start, size)
    return bool((there == other[inside]).all())


def numbered(texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(number of each word of all texts in order, distinct words by number, words of each text)."""
    whole, point, start, stop, counts = spans(texts)
    if not len(start):
        return np.zeros(0, np.int64), [], counts
    code, distinct = pd.factorize(span_hashes(point, start, stop))
    first = np.empty(len(distinct), np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    # equal hashes are held against the characters themselves
    size = stop - start
    again = np.flatnonzero(first[code] != np.arange(len(code)))  # other places than the first of a word
    same = (size == size[first[code]]).all() and _alike(point, start[again], point, start[first[code]][again], size[again])
    if not same:
        known: dict[str, int] = {}
        code = np.fromiter((known.setdefault(whole[a:b], len(known)) for a, b in zip(start.tolist(), stop.tolist())), np.int64, len(start))
        return code, list(known), counts
    return code, [whole[a:b] for a, b in zip(start[first].tolist(), stop[first].tolist())], counts


class Numbers:
    """Numbers of the distinct words of texts that come in turn; a word keeps its number. Known words are found by hash and held against their characters, without a string for each."""

    def __init__(self):
        self.hashes, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # in the hashes' order
        self.point = np.zeros(0, np.uint32)  # the known words' characters, end to end
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.known: dict[str, int] | None = None  # in the hashes' place once two words have the same

    def __len__(self) -> int:
        return len(self.size) if self.known is None else len(self.known)

    def of(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """(number of each word of all texts in order, the words that are new by number, words of each text)."""
        whole, point, start, stop, counts = spans(texts)
        if not len(start):
            return np.zeros(0, np.int64), [], counts
        if self.known is None:
            n, size = len(self.size), stop - start
            code, distinct = pd.factorize(span_hashes(point, start, stop))
            first = np.empty(len(distinct), np.int64)
            first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
            order = np.argsort(distinct)
            place = np.empty(len(distinct), np.int64)
            place[order] = np.searchsorted(self.hashes, distinct[order])
            there = np.zeros(len(distinct), bool)
            there[place < n] = self.hashes[place[place < n]] == distinct[place < n]
            number = np.empty(len(distinct), np.int64)
            number[there] = self.number[place[there]]
            new = order[~there[order]]
            number[new] = n + np.arange(len(new))
            # a known word's first place is held against the table, each further place of a word against its first
            again, known = np.flatnonzero(first[code] != np.arange(len(code))), np.flatnonzero(there)
            at, mine = first[known], number[known]
            if (size == size[first[code]]).all() and (size[at] == self.size[mine]).all() and _alike(point, start[again], point, start[first[code[again]]], size[again]) and _alike(point, start[at], self.point, self.begin[mine], size[at]):
                first = first[new]
                self.begin = np.concatenate([self.begin, len(self.point) + np.cumsum(size[first]) - size[first]])
                self.size = np.concatenate([self.size, size[first]])
                self.point = np.concatenate([self.point, point[_inside(start[first], size[first])]])
                self.hashes, self.number = np.insert(self.hashes, place[new], distinct[new]), np.insert(self.number, place[new], number[new])
                return number[code], [whole[a:b] for a, b in zip(start[first].tolist(), stop[first].tolist())], counts
            text = self.point.tobytes().decode("utf-32-le", "surrogatepass")
            self.known = {text[a : a + k]: i for i, (a, k) in enumerate(zip(self.begin.tolist(), self.size.tolist()))}
        n, known = len(self.known), self.known
        code = np.fromiter((known.setdefault(whole[a:b], len(known)) for a, b in zip(start.tolist(), stop.tolist())), np.int64, len(start))
        return code, list(islice(known, n, None)), counts
