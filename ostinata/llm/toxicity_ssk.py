"""Toxic sentences by a support vector machine on a subsequence string kernel with Nystroem landmarks.

A word is read as its letters between a begin and an end mark: lower case, accents removed, digits
and signs that stand for letters replaced, other signs dropped ("i.d.1-o.t" reads as "idiot"), and
runs of single letters and such signs joined ("i d 1 o t."); as a word of one letter may stand beside such a run,
it is also read without its first letter, its last and both, and the highest margin counts. Letters beyond a-z have
codes of their own, hashed from their code points. In scripts that put no spaces between words every two neighbouring
characters are a word. A word's subsequences are triples of letters that span five
places or fewer; a triple counts DECAY to the power of its gaps, so that an inserted letter weakens a
match and doesn't destroy it. The word kernel is the cosine of these triples to the power SHARP; values of less
than FLOOR to that power count as 0, so that a cheap upper bound can pass over most words. The kernel of a
run of words and a landmark word is the sum over the run's words, so its feature vector
K(run, Z) K(Z, Z)^(-1/2) and its margin are sums over words, and each distinct word of a batch is
evaluated once. A sentence's margin is that of its best run of at most SPAN words: what stands farther apart
doesn't add up, whatever the sentence's length, and no place is a cut.

A word with more letters inserted than the kernel bridges (INSERTED in all, or one at most in each gap, as in
"ixdxixoxt") reads as the marked word that is left without them, if it begins and ends like it. Words that clean
documents of the sample have as often as toxic ones are exempt; a clean word of this form that the sample
doesn't hold is taken for the insult.

Training: labels belong to documents, and near copies of one document count once. Sentences of clean documents are
clean; a sentence of a toxic document is toxic where it has a marked word, that is, one which toxic documents have more often
than chance gives to any word of the sample (a binomial tail below 1 / number of words frequent enough for that),
and after the first fit where its margin is positive; the rest of a toxic document is left out. Landmarks
are marked words, chosen until every marked word has a kernel value of COVER or more with one of them, and half as many common clean
words that are close to them.
Documents are toxic by a logistic rule over their count of toxic sentences, these sentences' summed
margins and the count of all sentences. The sample is
bounded by PER_CLASS documents of each class.

Defined results: a NULL text has NULL counts and score and isn't toxic; an empty text has no sentence,
score 0 and isn't toxic; repeated rows get equal results; without labels of both classes, or with so few that no word is
marked, nothing is toxic; a word of any length is read whole, in steps. Columns other than the text are untouched.
"""

from __future__ import annotations

import re
import unicodedata
from collections import ChainMap, Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinata.llm.common import batches_of, labelled_sample, release, table, tidy
from ostinata.llm.minhash_dedup import BANDS, UNSPACED, signatures

#: Labelled documents of each class that the machine is fitted on, at most.
PER_CLASS = 2000
SEED = 53
#: Kernel value that every marked word has with some landmark.
COVER = 0.5
#: Letters that may be inserted anywhere within a marked word, and the letters it has at least for that.
INSERTED, STEM = 2, 4
DECAY = 0.7
SHARP = 4
FLOOR = 0.55
#: Distinct words whose margins a worker remembers; beyond that it forgets them and evaluates anew.
MEMORY = 300_000
#: Neighbouring words that a sentence's margin can add up.
SPAN = 64
#: Letters and documents that are worked on at a time; a word of more than LONG letters is remembered by no worker.
STEP_LETTERS, STEP_DOCS, LONG = 100_000, 100, 64
#: Table entries that the kernel takes out at a time, however many landmarks there are (more only for one long word).
CELLS = 4_000_000

_END = re.compile(r"(?<=[.!?])[ \t\r\f\v]+|[\n\u2028\u2029]+|(?<=[\u3002\uff01\uff1f])")
_UNSPACED_RUN = re.compile(UNSPACED.pattern + "+")
_LONE = re.compile(r"(?<!\S)([^\w\s@$]*)((?:(?:[^\W\d_]|[013457@$])[ \t]+){2,}(?:[^\W\d_]|[013457@$]))(?=[^\w\s]*(?!\S))")
_BEGIN, _STOP, _OTHER = 28, 29, 30  # letters beyond a-z have the codes from _OTHER to 255
_GAPS = [(1, 1), (1, 2), (2, 1), (1, 3), (2, 2), (3, 1)]
#: Triples of a-z and marks have a number each, others share 2**17 by hash.
_FEATURES = 32**3 + (1 << 17)


def _other(c: str) -> str:
    return chr(_OTHER + (ord(c) * 0x9E3779B1 >> 7) % (256 - _OTHER))


class _Codes(dict):
    """Code point to the code of its letter, for str.translate; filled as letters come up."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        base = "ss" if c == "ß" else "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        out = "".join(chr(ord(x) - 96) if "a" <= x <= "z" else _SIGNS[x] if x in _SIGNS else _other(x) if x.isalpha() else "" for x in base)
        self[point] = out
        return out


_SIGNS = {k: chr(v) for k, v in {"0": 15, "1": 9, "3": 5, "4": 1, "5": 19, "7": 20, "@": 1, "$": 19}.items()}
_CODES = _Codes()
_EDGE = "$@!#%&*.,;:?\"'()[]{}|<>-_=+~`^/\\"
_LETTER = re.compile(r"[^\W\d_]")


def read_word(token: str) -> bytes:
    """The letters of a token as codes between the marks; no code at all where it has no letter."""
    core = token.lower().strip(_EDGE)
    if not core.isalpha() and not _LETTER.search(core):
        return b""
    return b"\x1c" + core.translate(_CODES).encode("latin-1") + b"\x1d"


def readings(token: str) -> list[bytes]:
    """The words that a token may be: one, or several of a joined run."""
    return [read_word(x) for x in token.split("\0")] if "\0" in token else [read_word(token)]


def _joined(run: re.Match) -> str:
    s = "".join(run[2].split()).replace("$", "s").replace("@", "a")
    return run[1] + "\0".join([s] + [x for x in (s[1:], s[:-1], s[1:-1]) if len(x) > 2])


class Inserted:
    """Words to the marked words that they are with letters put in between; others to themselves."""

    def __init__(self, marked: list[bytes], exempt: set[bytes] = frozenset()):
        self.exempt = exempt | set(marked)
        self.by_ends: dict[bytes, list[tuple[bytes, re.Pattern, re.Pattern]]] = {}
        for m in marked:
            if len(m) >= STEM + 2:
                letters = [re.escape(m[i : i + 1]) for i in range(1, len(m) - 1)]
                loose, tight = (re.compile(b"\x1c" + gap.join(letters) + b"\x1d", re.DOTALL) for gap in (b".{0,%d}" % INSERTED, b".?"))
                self.by_ends.setdefault(m[1:2] + m[-2:-1], []).append((m, loose, tight))

    def __call__(self, w: bytes) -> bytes:
        some = self.by_ends.get(w[1:2] + w[-2:-1])
        if not some or w in self.exempt:
            return w
        found = [m for m, loose, tight in some if len(m) < len(w) < 2 * len(m) - 2 and (len(w) - len(m) <= INSERTED and loose.fullmatch(w) or tight.fullmatch(w))]
        return max(found, key=len) if found else w


def _numbered(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    plain = x * 1024 + y * 32 + z
    other = np.maximum(np.maximum(x, y), z) >= 32
    if other.any():
        h = (x.astype(np.uint32) * np.uint32(0x01000193) ^ y.astype(np.uint32)) * np.uint32(0x01000193) ^ z.astype(np.uint32)
        h = (h * np.uint32(0x9E3779B1)) >> np.uint32(15)
        plain = np.where(other, 32**3 + h.astype(np.int32), plain)
    return plain


def triples(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, triple, weight) of every gapped triple; a triple may come up more than once in a word."""
    pad = b"\0\0\0\0"
    c = np.frombuffer(pad.join(words) + pad, np.uint8).astype(np.int32)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 4
    owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    n = len(c) - 4
    at, idx, wt = [], [], []
    for a, b in _GAPS:
        x, y, z = c[:n], c[a : a + n], c[a + b : a + b + n]
        ok = np.flatnonzero((x > 0) & (y > 0) & (z > 0))
        at.append(owner[ok])
        idx.append(_numbered(x[ok], y[ok], z[ok]))
        wt.append(np.full(len(ok), DECAY ** (a + b - 2), np.float32))
    return np.concatenate(at), np.concatenate(idx), np.concatenate(wt)


def _summed(word: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(triples, weights) of one word of any length, in steps of letters."""
    total = np.zeros(_FEATURES)
    for a in range(0, len(word), STEP_LETTERS):
        # a triple belongs to the step of its first letter
        c = np.frombuffer(word[a : a + STEP_LETTERS + 4], np.uint8).astype(np.int32)
        for i, j in _GAPS:
            n = min(STEP_LETTERS, len(c) - i - j)
            if n > 0:
                total += DECAY ** (i + j - 2) * np.bincount(_numbered(c[:n], c[i : i + n], c[i + j : i + j + n]), minlength=_FEATURES)
    idx = np.flatnonzero(total)
    return idx, total[idx]


def _merged(at: np.ndarray, idx: np.ndarray, wt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, back = np.unique(at.astype(np.int64) * _FEATURES + idx, return_inverse=True)
    return (key // _FEATURES).astype(np.int32), (key % _FEATURES).astype(np.int32), np.bincount(back, weights=wt, minlength=len(key)).astype(np.float32)


class Kernel:
    """Word kernel against fixed landmark words. Only triples of landmarks have a row in the table; row 0 is that of all others."""

    def __init__(self, landmarks: list[bytes]):
        at, idx, wt = _merged(*triples(landmarks))
        self.size, self.landmarks = len(landmarks), landmarks
        known = np.unique(idx)
        self.row = np.zeros(_FEATURES, np.int32)
        self.row[known] = np.arange(1, len(known) + 1)
        self.table = np.zeros((len(known) + 1, self.size), np.float32)
        self.table[self.row[idx], at] = wt
        self.table /= np.maximum(np.sqrt((self.table**2).sum(0)), 1e-9)
        self.most = self.table.max(1)
        order = sorted(range(self.size), key=landmarks.__getitem__)  # neighbours have much in common
        self.group_most = np.column_stack([self.table[:, order[k : k + 8]].max(1) for k in range(0, self.size, 8)])

    @staticmethod
    def _steps(first: np.ndarray, ends: np.ndarray, columns: int):
        """Ranges of words whose triples take out CELLS entries of so many columns together, or one word."""
        a = 0
        while a < len(first):
            b = max(a + 1, int(np.searchsorted(ends, first[a] + CELLS // columns, side="right")))
            yield a, b
            a = b

    def _bounded(self, near: np.ndarray, norm: np.ndarray, at: np.ndarray, row: np.ndarray, wt: np.ndarray) -> np.ndarray:
        """The near words that may reach the floor with a landmark of some group of eight."""
        keep = near[at]
        at, row, wt = at[keep], row[keep], wt[keep]
        order = np.argsort(at, kind="stable")
        at, row, wt = at[order], row[order], wt[order]
        rows = np.flatnonzero(near)
        first = np.searchsorted(at, rows)
        ends = np.append(first[1:], len(at))
        out = np.zeros(len(near), bool)
        for a, b in self._steps(first, ends, self.group_most.shape[1]):
            bound = np.add.reduceat(self.group_most[row[first[a] : ends[b - 1]]] * wt[first[a] : ends[b - 1], None], first[a:b] - first[a], axis=0)
            out[rows[a:b]] = bound.max(1) >= FLOOR * norm[rows[a:b]]
        return out

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(indices of the words with a kernel value over the floor, their values); all others have zeros."""
        found_at, found = [], []
        short = [i for i, w in enumerate(words) if len(w) <= STEP_LETTERS]
        for lo, hi in batches_of([words[i] for i in short], STEP_LETTERS):
            rows, values = self._step([words[i] for i in short[lo:hi]])
            found_at.append(np.array(short[lo:hi], np.int64)[rows])
            found.append(values)
        for i, w in enumerate(words):
            if len(w) > STEP_LETTERS:
                idx, wt = _summed(w)
                cos = (self.table[self.row[idx]] * wt[:, None]).sum(0) / np.sqrt((wt * wt).sum())
                found_at.append(np.array([i]))
                found.append(np.where(cos < FLOOR, 0, cos)[None].astype(np.float32) ** SHARP)
        if not found:
            return np.zeros(0, np.int64), np.zeros((0, self.size), np.float32)
        return np.concatenate(found_at), np.concatenate(found)

    def _step(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        at, idx, wt = triples(words)
        norm = np.sqrt(np.bincount(at, weights=wt * wt, minlength=len(words)))
        row = self.row[idx]
        hit = np.flatnonzero(row)  # other triples count in the norm alone
        bound = np.bincount(at[hit], weights=wt[hit] * self.most[row[hit]], minlength=len(words))
        near = (bound >= FLOOR * np.maximum(norm, 1e-9)) & (norm > 0)
        near = self._bounded(near, norm, at[hit], row[hit], wt[hit])
        keep = near[at]
        at, idx, wt = _merged(at[keep], idx[keep], wt[keep])
        rows = np.flatnonzero(near)
        out = np.zeros((len(rows), self.size), np.float32)
        if len(rows):
            first = np.searchsorted(at, rows)
            ends = np.append(first[1:], len(at))
            for a, b in self._steps(first, ends, self.size):
                lo, hi = first[a], ends[b - 1]
                out[a:b] = np.add.reduceat(self.table[self.row[idx[lo:hi]]] * wt[lo:hi, None], first[a:b] - lo, axis=0)
            norm = np.sqrt(np.add.reduceat(wt * wt, first))
            out /= norm[:, None]
        out[out < FLOOR] = 0
        return rows, out**SHARP


def _pairs(run: re.Match) -> str:
    s = run[0]
    return " " + (" ".join(s[i : i + 2] for i in range(len(s) - 1)) or s) + " "


def _sentences(text: str) -> list[list[str]]:
    text = _LONE.sub(_joined, text.replace("\0", ""))
    out = []
    for s in _END.split(text):
        if not s.isascii():
            s = _UNSPACED_RUN.sub(_pairs, s)
        if w := s.split():
            out.append(w)
    return out


def best_run(values: list[float]) -> tuple[float, int, int]:
    """(sum, start, end) of the run of at most SPAN values with the greatest sum; the greatest value where none is positive."""
    top = max(values)
    if top <= 0:
        i = values.index(top)
        return top, i, i + 1
    some = [(i, v) for i, v in enumerate(values) if v]
    best = (0.0, 0, 0)
    for k, (i, v) in enumerate(some):
        if v > 0:
            total = 0.0
            for j, u in some[k : k + SPAN]:
                if j - i >= SPAN:
                    break
                total += u
                if total > best[0]:
                    best = (total, i, j + 1)
    return best


@dataclass
class Machine:
    kernel: Kernel
    plain: Inserted
    alpha: np.ndarray
    bias: float
    rule: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    margins: dict = field(default_factory=dict)

    @property
    def landmarks(self) -> list[bytes]:
        return self.kernel.landmarks

    def __getstate__(self):
        return self.__dict__ | {"margins": {}}

    def words(self, tokens: set[str]) -> dict[str, float]:
        """The margin of each token; those of short ones are remembered."""
        new = [t for t in tokens if t not in self.margins]
        if len(self.margins) + len(new) > MEMORY:
            self.margins.clear()
            new = list(tokens)
        long = {}
        read: dict[bytes, list[str]] = {}
        several = []
        for t in new:
            if "\0" in t:
                several.append((t, [self.plain(w) for w in readings(t)]))
                for w in several[-1][1]:
                    read.setdefault(w, [])
            else:
                read.setdefault(self.plain(read_word(t)), []).append(t)
        found_all = dict.fromkeys(new, 0.0)
        words = list(read)
        rows, values = self.kernel(words)
        found = {}
        for i, g in zip(rows.tolist(), (values @ self.alpha).tolist()):
            found[words[i]] = g
            for t in read[words[i]]:
                found_all[t] = g
        for t, ws in several:
            found_all[t] = max(found.get(w, 0.0) for w in ws)
        for t, g in found_all.items():
            (self.margins if len(t) <= LONG else long)[t] = g
        return ChainMap(self.margins, long) if long else self.margins

    def counts(self, texts: list[str]) -> list[tuple[int, int, float]]:
        """(toxic sentences, sentences, sum of the toxic sentences' margins) of each text."""
        return [c for a in range(0, len(texts), STEP_DOCS) for c in self._counts(texts[a : a + STEP_DOCS])]

    def _counts(self, texts: list[str]) -> list[tuple[int, int, float]]:
        split = [_sentences(t) for t in texts]
        tokens: set[str] = set()
        for s in split:
            for w in s:
                tokens.update(w)
        get = self.words(tokens).__getitem__
        out = []
        for s in split:
            over = [m for w in s if (m := best_run(list(map(get, w)))[0] + self.bias) > 0]
            out.append((len(over), len(s), float(sum(over))))
        return out

    def score(self, toxic: int, all_: int, margin: float) -> float:
        if not toxic:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.rule, _rule_terms(toxic, all_, margin)), -500, 500))))


def _rule_terms(toxic: int, all_: int, margin: float) -> list[float]:
    return [np.log1p(toxic), np.log1p(margin), np.log1p(all_), 1.0]


def _sums(margins: np.ndarray, row: np.ndarray, col: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the sum of the margins of its words; row and col: of each word its row and its place in margins."""
    return np.bincount(row, weights=margins[col], minlength=n)


def _svm(mapped: np.ndarray, row: np.ndarray, col: np.ndarray, y: np.ndarray, times: np.ndarray, steps: int = 300, penalty: float = 2e-5) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by Adam; a row counts `times` times, and classes weigh in by the square root of their share.

    A row's features are the sum of its words' in mapped. That sum is never laid out: margins and slopes are summed instead.
    """
    w, bias = np.zeros(mapped.shape[1]), 0.0
    s = np.where(y == 1, 1.0, -1.0)
    weight = times * np.where(y == 1, np.sqrt(times[y == 0].sum() / max(1, times[y == 1].sum())), 1.0)
    weight /= weight.sum()
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        slope = weight * s * np.maximum(0, 1 - s * (_sums(mapped @ w.astype(np.float32), row, col, len(y)) + bias))
        at_words = np.bincount(col, weights=slope[row], minlength=len(mapped)).astype(np.float32)
        g = np.append(-2 * (at_words @ mapped) + 2 * penalty * w, -2 * slope.sum())
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def _same(texts: list[str]) -> list[int]:
    """A number for each text, equal for near copies: the least of those that share a MinHash band, and of theirs."""
    up = list(range(len(texts)))

    def least(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    first: dict[tuple[int, bytes], int] = {}
    for lo, hi in batches_of(texts, 600_000):
        sig, some, _ = signatures(texts[lo:hi])
        for i in np.flatnonzero(some).tolist():
            for k in range(BANDS):
                a, b = least(lo + i), least(first.setdefault((k, sig[i, k::BANDS].tobytes()), lo + i))
                up[max(a, b)] = min(a, b)
    return [least(i) for i in range(len(texts))]


def _tail(hits: int, trials: int, share: float) -> float:
    """log of P(X >= hits), X ~ Bin(trials, share)."""
    k = np.arange(hits, trials + 1)
    log = np.cumsum(np.concatenate(([0.0], np.log(np.arange(1, trials + 1)))))
    terms = log[trials] - log[k] - log[trials - k] + k * np.log(share) + (trials - k) * np.log1p(-share)
    return float(terms.max() + np.log(np.exp(terms - terms.max()).sum()))


def marked_words(seen: list[Counter], n: np.ndarray) -> list[bytes]:
    """Words that toxic documents have more often than chance gives to any of all words, the surest first. seen: documents of each label by word, n: their sums."""
    share = n[1] / n.sum()
    # only words that come up often enough to be sure at all count as tried (Tarone's correction)
    total = np.sort(np.fromiter((c + seen[0][w] for w, c in seen[1].items()), np.int64, len(seen[1])))
    least = next((t for t in range(1, int(total.max(initial=0)) + 1) if share**t * (len(total) - np.searchsorted(total, t)) <= 1), None)
    if least is None:
        return []
    sure = -np.log(len(total) - np.searchsorted(total, least))
    judged = []
    for w, c in seen[1].items():
        other = seen[0][w]
        if c * n[0] > 4 * other * n[1] and (p := _tail(c, c + other, share)) <= sure:
            judged.append((p, w))
    return [w for _, w in sorted(judged)]


def landmarks_of(marked: list[bytes], clean: list[bytes]) -> list[bytes]:
    """Marked words that cover all of them, and half as many clean words close to these."""
    rows, values = Kernel(marked)(marked)
    near = np.zeros((len(marked), len(marked)), np.float32)
    near[rows] = values
    chosen: list[int] = []
    covered = np.zeros(len(marked), bool)
    for i in range(len(marked)):
        if not covered[i]:
            chosen.append(i)
            covered |= near[:, i] >= COVER
            covered[i] = True
    out = [marked[i] for i in chosen]
    if clean:
        rows, values = Kernel(out)(clean)
        if len(rows):
            out += [clean[i] for i in rows[np.argsort(-values.max(1), kind="stable")][: -(-len(chosen) // 2)]]
    return out


def fit(texts: list[str], toxic: list[int]) -> Machine | None:
    """A machine from documents labelled 1 (toxic) or 0; None without both labels, or where no word is marked."""
    y = np.asarray(toxic, np.int64)
    if not len(y) or y.min() == y.max():
        return None
    # words are kept as the numbers of their readings; those of a single letter or none are left out
    forms: dict[tuple[bytes, ...], int] = {}
    known: dict[str, int] = {}
    docs, sizes, sentences = [], [], []
    for t in texts:
        codes, ends = [], [0]
        for words in _sentences(t):
            for w in words:
                c = known.get(w)
                if c is None:
                    r = tuple(readings(w))
                    c = known[w] = forms.setdefault(r, len(forms)) if len(r[0]) > 3 else -1
                if c >= 0:
                    codes.append(c)
            ends.append(len(codes))
        docs.append(np.array(codes, np.int32))
        sizes.append(np.diff(np.array(ends, np.int32)))
        sentences.append(len(ends) - 1)
    read = list(forms)
    del forms, known
    alike: dict[tuple[int, int], list[int]] = {}
    for i, pair in enumerate(zip(y.tolist(), _same(texts))):
        alike.setdefault(pair, []).append(i)
    seen = [Counter(), Counter()]
    n = np.zeros(2, np.int64)
    for (label, _), some in alike.items():
        words = {read[c][0] for c in np.unique(np.concatenate([docs[i] for i in some])).tolist()}
        seen[label].update(words)
        n[label] += len(words)  # a long document has more of all words
    marked = marked_words(seen, n)
    if not marked:
        return None
    sharp = set(marked)
    plain = Inserted(marked)
    plain.exempt |= {w for w, c in seen[0].items() if plain(w) != w and c * n[1] >= seen[1][w] * n[0]}
    final = [next((p for w in r if (p := plain(w)) in sharp), r[0]) for r in read]
    landmarks = landmarks_of(marked, [w for w, _ in sorted(seen[0].items(), key=lambda p: (-p[1], p[0])) if w not in sharp and seen[0][w] >= 3])
    del seen
    kernel = Kernel(landmarks)
    rows, square = kernel(landmarks)
    full = np.zeros((len(landmarks), len(landmarks)))
    full[rows] = square
    val, vec = np.linalg.eigh((full + full.T) / 2)
    root = vec @ np.diag(1 / np.sqrt(np.maximum(val, 1e-3))) @ vec.T
    words = sorted(set(final))
    rows, values = kernel(words)
    mapped = values @ root.astype(np.float32)
    place = dict.fromkeys(words, -1) | {words[i]: k for k, i in enumerate(rows.tolist())}
    place_of = np.fromiter((place[w] for w in final), np.int32, len(final))
    sharp_of = np.fromiter((w in sharp for w in final), bool, len(final))
    del words, values, place, final, read
    codes, size, toxic_doc = np.concatenate(docs), np.concatenate(sizes), np.repeat(y == 1, sentences)
    del docs, sizes
    sentence = np.repeat(np.arange(len(size), dtype=np.int32), size)
    at = place_of[codes]
    near = np.bincount(sentence[at >= 0], minlength=len(size)) > 0
    label = (np.bincount(sentence[sharp_of[codes]], minlength=len(size)) > 0) & toxic_doc
    empties = np.count_nonzero(~near & ~toxic_doc)
    at, size, label, toxic_doc = at[near[sentence]], size[near], label[near], toxic_doc[near]
    del codes, sentence
    # clean sentences without any kernel value are alike: one row stands for them, with a tenth of their weight
    label, toxic_doc = np.append(label, False).astype(np.int64), np.append(toxic_doc, False)
    times = np.ones(len(label))
    times[-1] = empties / 10
    first = label
    row = np.repeat(np.arange(len(size), dtype=np.int32), size)
    ends = np.cumsum(size).tolist()
    beta, bias = None, 0.0
    for _ in range(2):
        use = at >= 0
        if beta is not None:  # the runs that the sentences' margins are of
            margin = np.append(mapped @ beta, 0.0)
            for lo, hi in zip([0, *ends], ends):
                _, a, b = best_run(margin[at[lo:hi]].tolist())
                use[lo : lo + a] = False
                use[lo + b : hi] = False
            label = np.where(toxic_doc, (_sums(margin, row[use], at[use], len(label)) + bias > 0) | (first == 1), 0)
        beta, bias = _svm(mapped, row[use], at[use], label, times * ((label == 1) | ~toxic_doc))
    del at, row, ends, use
    release()
    machine = Machine(kernel, plain, (root @ beta).astype(np.float32), bias)
    counts = machine.counts(texts)
    some = np.array([c[0] > 0 for c in counts])  # the others aren't toxic, whatever the rule
    z, y = np.array([_rule_terms(*c) for c in counts])[some].reshape(-1, 4), y[some]
    w = np.zeros(4)
    for _ in range(60):  # Newton steps of a penalised logistic fit
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 0.1 * np.eye(4), z.T @ (y - p) - 0.1 * w)
    machine.rule = tuple(map(float, w))
    machine.margins.clear()
    return machine


def train(spark: SparkSession, sf_dir: str, per_class: int = PER_CLASS) -> Machine | None:
    sample = labelled_sample(spark, sf_dir, "toxic", per_class, SEED)
    texts, y = sample["text"].tolist(), sample["y"].tolist()
    del sample
    try:
        return fit(texts, y)
    finally:
        release()


def toxicity(machine: Machine | None, text: Column | str) -> Column:
    """struct(toxic_sentences, sentences, score) of each text."""
    text = F.col(text) if isinstance(text, str) else text

    def scored(texts: pd.Series) -> pd.DataFrame:
        there = texts.notna().to_numpy()
        out = pd.DataFrame({"toxic_sentences": pd.array([None] * len(texts), "Int64"), "sentences": pd.array([None] * len(texts), "Int64"), "score": pd.array([None] * len(texts), "Float64")})
        known = texts[there].tolist()
        if known:
            got = machine.counts(known) if machine else [(0, len(_sentences(t)), 0.0) for t in known]
            out.loc[there, "toxic_sentences"] = [c[0] for c in got]
            out.loc[there, "sentences"] = [c[1] for c in got]
            out.loc[there, "score"] = [machine.score(*c) if machine else 0.0 for c in got]
        return out

    @F.pandas_udf("toxic_sentences bigint, sentences bigint, score double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from tidy(lambda them: map(scored, them))(batches)

    return score(text)


def classify(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id, toxic_sentences, sentences, score, toxic of every row."""
    scored = docs.select("doc_id", toxicity(machine, "text").alias("t")).select("doc_id", "t.*")
    return scored.withColumn("toxic", F.coalesce(F.col("score") >= 0.5, F.lit(False)))


def op5_toxicity_ssk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), train(spark, sf_dir))
