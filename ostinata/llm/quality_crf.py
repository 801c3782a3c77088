"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. Its features are measures of the line itself and of the lines
before and after it; a 2 x 2 transition weight ties neighbours. A document's quality is the mean of
the lines' forward-backward marginals P(good), weighted by the lines' byte lengths.

Training: documents carry one label, lines none. All lines of a bad document start as bad; after a
fit, its lines take the labels that their marginals give (the worst line stays bad), and the field is
fitted again. The sample is bounded by PER_CLASS documents of each class.

Defined results: a NULL text has NULL quality and is rejected; a text without a character other than
white space has quality 0.0 and is rejected; repeated rows get equal results; with labels of fewer
than two classes nothing can be learned, and all documents with text have quality 1.0. Columns other
than the text are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinata.llm.common import batches_of, labelled_sample, release, run_bounds, span_hashes, table, tidy

#: Labelled documents of each class that the field is fitted on, at most.
PER_CLASS = 1500
SEED = 71
#: Characters of text whose features are worked out at a time.
STEP_CHARS = 1_000_000
_OWN = 16

_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 lower or non-ASCII, 2 upper, 3 digit, 4 space, 5 sentence mark, 6 symbol
_CLASS[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)] = 1
_CLASS[0x80:] = 1
_CLASS[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = 2
_CLASS[np.frombuffer(b"0123456789", np.uint8)] = 3
_CLASS[np.frombuffer(b" \t\r\n\x0b\x0c", np.uint8)] = 4
_CLASS[np.frombuffer(b".,;:?'\"-()", np.uint8)] = 5
_CLASS[np.frombuffer(b"!#$%&*+/<=>@[\\]^_`{|}~", np.uint8)] = 6


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, its byte length, number of lines of each text). Lines of white space are left out."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    text_end = np.cumsum(sizes + 1)
    kind = _CLASS[buf]
    full_s, full_e = run_bounds(buf != 10)
    solid = np.concatenate(([0], np.cumsum(kind != 4)))
    some = solid[full_e] > solid[full_s]
    ls, le = full_s[some], full_e[some]
    doc = np.searchsorted(text_end, ls, side="right")
    counts = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    if not len(ls):
        return np.zeros((0, _OWN)), np.zeros(0), counts
    size = (le - ls).astype(np.float64)

    def share(flags: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(flags)))
        return (c[le] - c[ls]).astype(np.float64)

    low, up, dig, spc, mark, sym = (share(kind == k) for k in (1, 2, 3, 4, 5, 6))
    ws, we = run_bounds(kind != 4)
    wline = np.searchsorted(ls, ws, side="right") - 1
    words = np.bincount(wline, minlength=len(ls)).astype(np.float64)
    wh = span_hashes(buf, ws, we)
    same = np.zeros(len(ws))
    if len(ws) > 1:
        same[1:] = (wh[1:] == wh[:-1]) & (wline[1:] == wline[:-1])
    repeats = np.bincount(wline, weights=same, minlength=len(ls))
    order = np.lexsort((wh, wline))
    new = np.ones(len(ws))
    new[1:] = (wh[order][1:] != wh[order][:-1]) | (wline[order][1:] != wline[order][:-1])
    kinds = np.bincount(wline[order], weights=new, minlength=len(ls))
    lone_symbol = np.bincount(wline, weights=(kind[ws] == 6) & (we - ws == 1), minlength=len(ls))
    tail_symbol = np.bincount(wline, weights=(kind[we - 1] == 6) & (we - ws > 1), minlength=len(ls))
    lh = span_hashes(buf, ls, le)
    order = np.lexsort((lh, doc))
    eq = (lh[order][1:] == lh[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    copied = np.zeros(len(ls))
    copied[order[1:]] = eq
    copied[order[:-1]] = np.maximum(copied[order[:-1]], eq)
    w1 = np.maximum(words, 1)
    ends = np.isin(buf[le - 1], np.frombuffer(b".!?\"", np.uint8)).astype(np.float64)
    # the share of distinct words falls with the length of a line by itself; 60 words put all lines on one footing
    varied = kinds / np.minimum(w1, 60 + 0.35 * np.maximum(w1 - 60, 0))
    x = np.column_stack([
        np.minimum(1, low / size), np.minimum(1, 2 * up / size), np.minimum(1, 4 * dig / size), np.minimum(1, 4 * spc / size), np.minimum(1, 8 * mark / size),
        np.minimum(1, 6 * sym / size), repeats / w1, np.minimum(1, varied), lone_symbol / w1, tail_symbol / w1, copied, ends,
        np.minimum(1, size / words.clip(1) / 16), np.log1p(size) / 8, (words <= 2).astype(np.float64), np.minimum(1, up / (low + up + 1)),
    ])
    return x, size, counts


def line_features_in_steps(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for texts of any number, with the memory of STEP_CHARS of text."""
    parts = [line_features(texts[a:b]) for a, b in batches_of(texts, STEP_CHARS)]
    if not parts:
        return line_features([])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])


def with_neighbours(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after (zeros and a flag at a text's ends) and a constant."""
    n = len(x)
    if not n:
        return np.zeros((0, 3 * _OWN + 3))
    first = np.zeros(n, bool)
    last = np.zeros(n, bool)
    ends = np.cumsum(counts[counts > 0])
    last[ends - 1] = True
    first[np.concatenate(([0], ends[:-1]))] = True
    before = np.vstack([np.zeros((1, x.shape[1])), x[:-1]])
    after = np.vstack([x[1:], np.zeros((1, x.shape[1]))])
    before[first] = 0
    after[last] = 0
    return np.hstack([x, before, after, first[:, None], last[:, None], np.ones((n, 1))])


def emissions(x: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """with_neighbours(x, counts) @ weights, with the memory of a few numbers a line."""
    n = len(x)
    own, before, after = (x @ weights[k * _OWN : (k + 1) * _OWN] for k in range(3))
    ends = np.cumsum(counts[counts > 0])
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    last[ends - 1] = True
    first[np.concatenate(([0], ends[:-1]))] = True
    own += weights[-1] + first * weights[-3] + last * weights[-2]
    own[1:] += np.where(first[1:], 0, before[:-1])
    own[:-1] += np.where(last[:-1], 0, after[1:])
    return own


def marginals(emit: np.ndarray, move: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(bad) of each line, summed pair marginals and log partition of chains, by forward-backward over all chains at once.

    emit: score of label bad less that of label good. move[a, b]: weight of label a before label b.
    Chains are walked in step, longest first, so that step t touches only those longer than t.
    """
    counts = counts[counts > 0]
    n = len(emit)
    start = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    start, counts = start[order], counts[order]
    steps = int(counts[0]) if len(counts) else 0
    alive = np.searchsorted(-counts, -np.arange(1, steps + 1), side="right")
    e = np.column_stack([np.zeros(n), emit])
    fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
    for t in range(steps):
        at = start[: alive[t]] + t
        if t == 0:
            fwd[at] = e[at]
        else:
            a = fwd[at - 1]
            fwd[at] = np.logaddexp(a[:, :1] + move[0], a[:, 1:] + move[1]) + e[at]
    for t in range(steps - 2, -1, -1):
        at = start[: alive[t + 1]] + t
        b = bwd[at + 1] + e[at + 1]
        bwd[at] = np.logaddexp(b[:, :1] + move[:, 0], b[:, 1:] + move[:, 1])
    both = fwd + bwd
    bad = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
    last = start + counts - 1
    z = np.logaddexp(fwd[last, 0], fwd[last, 1])
    pairs = np.zeros((2, 2))
    if n > len(counts):
        inner = np.ones(n, bool)
        inner[last] = False
        at = np.flatnonzero(inner)
        zl = np.logaddexp(both[at, 0], both[at, 1])
        for a in (0, 1):
            for b in (0, 1):
                pairs[a, b] = np.exp(fwd[at, a] + move[a, b] + e[at + 1, b] + bwd[at + 1, b] - zl).sum()
    return bad, pairs, float(z.sum())


@dataclass
class Field:
    weights: np.ndarray
    move: np.ndarray
    threshold: float

    def quality(self, texts: list[str]) -> np.ndarray:
        steps = [self._step(texts[a:b]) for a, b in batches_of(texts, STEP_CHARS)]
        return np.concatenate(steps) if steps else np.zeros(0)

    def _step(self, texts: list[str]) -> np.ndarray:
        x, size, counts = line_features(texts)
        if not len(x):
            return np.zeros(len(texts))
        bad, _, _ = marginals(emissions(x, counts, self.weights), self.move, counts)
        doc = np.repeat(np.arange(len(texts)), counts)
        total = np.bincount(doc, weights=size, minlength=len(texts))
        good = np.bincount(doc, weights=size * (1 - bad), minlength=len(texts))
        return np.divide(good, total, out=np.zeros(len(texts)), where=total > 0)


def _fit_once(x: np.ndarray, y: np.ndarray, counts: np.ndarray, weight: np.ndarray, steps: int = 160, penalty: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Penalised conditional likelihood by Adam. weight: of each line's own term, to balance the classes."""
    w, move = np.zeros(x.shape[1]), np.zeros((2, 2))
    inner = np.ones(len(y), bool)
    inner[np.cumsum(counts[counts > 0]) - 1] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at], y[at + 1]), 1)
    m = [np.zeros_like(w), np.zeros_like(move)]
    v = [np.zeros_like(w), np.zeros_like(move)]
    for t in range(1, steps + 1):
        bad, pairs, _ = marginals(x @ w, move, counts)
        grads = [x.T @ (weight * (y - bad)) / len(y) - penalty * w / len(y), (seen - pairs) / len(y) - penalty * move / len(y)]
        for k, p in enumerate((w, move)):
            m[k] = 0.9 * m[k] + 0.1 * grads[k]
            v[k] = 0.99 * v[k] + 0.01 * grads[k] ** 2
            p += 0.15 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return w, move


def fit(texts: list[str], good: list[int]) -> Field | None:
    """A field from documents labelled 1 (good) or 0 (bad); None without both labels."""
    good_a = np.asarray(good, np.int64)
    if not len(good_a) or good_a.min() == good_a.max():
        return None
    own, _, counts = line_features_in_steps(texts)
    if not len(own):
        return None
    x = with_neighbours(own, counts)
    doc = np.repeat(np.arange(len(texts)), counts)
    y = (1 - good_a)[doc]
    for turn in range(2):
        w, move = _fit_once(x, y, counts, np.ones(len(y)))
        if turn == 0:
            bad, _, _ = marginals(x @ w, move, counts)
            worst = np.full(len(texts), -1.0)
            np.maximum.at(worst, doc, bad)
            y = np.where(good_a[doc] == 1, 0, ((bad >= 0.5) | (bad >= worst[doc])).astype(np.int64))
    field = Field(w, move, 0.5)
    q = field.quality(texts)
    # the threshold with the fewest errors; among equals the middle of the widest gap
    order = np.argsort(q, kind="stable")
    edge = np.concatenate(([0.0], q[order], [1.0]))
    wrong = np.concatenate(([0], np.cumsum(good_a[order] == 1))) + np.concatenate((np.cumsum((good_a[order] == 0)[::-1])[::-1], [0]))
    gap = np.diff(edge)
    best = max(np.flatnonzero(wrong == wrong.min()), key=lambda i: (gap[i], -i))
    field.threshold = float((edge[best] + edge[best + 1]) / 2)
    return field


def train(spark: SparkSession, sf_dir: str, per_class: int = PER_CLASS) -> Field | None:
    sample = labelled_sample(spark, sf_dir, "quality", per_class, SEED)
    try:
        return fit(sample["text"].tolist(), sample["y"].tolist())
    finally:
        release()


def quality(field: Field | None, text: Column | str) -> Column:
    """The quality of each text as a column."""
    text = F.col(text) if isinstance(text, str) else text
    if field is None:
        return F.when(text.isNotNull(), F.lit(1.0))

    def scored(texts: pd.Series) -> pd.Series:
        there = texts.notna().to_numpy()
        known = texts[there].tolist()
        out = np.full(len(texts), np.nan)
        out[there] = field.quality(known)
        return pd.Series(out).astype("object").where(there, None)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidy(lambda them: map(scored, them))(batches)

    return score(text)


def classify(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, quality, keep of every row."""
    limit = 0.5 if field is None else field.threshold
    scored = docs.select("doc_id", quality(field, "text").alias("quality"))
    return scored.withColumn("keep", F.coalesce(F.col("quality") >= F.lit(limit), F.lit(False)))


def op7_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), train(spark, sf_dir))
