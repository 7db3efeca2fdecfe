"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is good or bad. What speaks for a state is the line's own features and those of
the lines beside it; transition weights tie neighbouring states. Document quality is the mean
of the lines' forward-backward marginals, weighted by their length. The field is fitted on
the driver to a bounded sample of labelled documents, whose lines all carry the document's
label; features are made by the executors, and scoring is one pass over the scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import ID, TEXT, batch, chunks, texts

#: Labelled documents that the field is fitted to, at most: those of the least hashes of
#: their ids.
TRAIN_DOCS = 6_000
#: Lines of a chain while fitting; a longer document makes several. Scoring has no such limit.
TRAIN_LINES = 32
STEPS, RATE, DECAY = 250, 0.05, 1e-3
_TRAIN = pa.schema([(ID, pa.int64()), ("label", pa.int32()), ("lines", pa.int64()), ("features", pa.binary())])
_SCORES = pa.schema([(ID, pa.int64()), ("score", pa.float64()), ("n_lines", pa.int64()), ("bad_lines", pa.int64())])

_CLASSES = {
    "symbol": b"#*$%&|<>", "mark": b"!?", "stop": b".,;:", "digit": b"0123456789", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)),
    "other": bytes(x for x in range(33, 127) if not chr(x).isalnum() and chr(x) not in "#*$%&|<>!?.,;:"),
}


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (total[ends] - total[starts]).astype(np.float64)


def line_features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, bytes of each line, index of the first line of each text and
    the end). A text has one line more than line feeds."""
    feed = np.flatnonzero(buf == 10)
    starts = np.sort(np.concatenate([off[:-1], feed + 1]), kind="stable")
    owner = np.searchsorted(feed, off)
    at = owner + np.arange(len(off))
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    ends[at[1:] - 1] = off[1:]
    size = ends - starts
    share = lambda n, of: n / np.maximum(of, 1)
    first, last, _ = words.word_spans(buf, off)
    hashes = words.word_hashes(buf, first, last)
    line = np.searchsorted(starts, first, "right") - 1
    count = np.bincount(line, minlength=len(starts)).astype(np.float64)
    again = np.zeros(len(first), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((hashes, line))
    new = np.ones(len(first), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order][new], minlength=len(starts))
    short = np.bincount(line[last - first <= 3], minlength=len(starts))
    black = size - _sums(words.SPACE[buf], starts, ends)
    columns = [np.log1p(size), np.log1p(count), (size == 0).astype(float), share(black, count) / 8, share(short, count), share(np.bincount(line[again], minlength=len(starts)), count), 1 - share(distinct, np.maximum(count, 1))]
    for members in _CLASSES.values():
        table = np.zeros(256, bool)
        table[list(members)] = True
        part = share(_sums(table[buf], starts, ends), black)
        columns += [part, np.sqrt(part)]
    columns.append(share(_sums(buf > 127, starts, ends), black))
    columns += [(columns[k] > x).astype(float) for k, x in ((5, 0.1), (6, 0.5), (7, 0.05), (9, 0.05), (15, 0.3))]
    own = np.stack(columns, axis=1).astype(np.float32)
    return own, size, at


def with_neighbours(own: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and of the line behind (its own where
    there is none)."""
    before, behind = np.arange(len(own)) - 1, np.arange(len(own)) + 1
    before[at[:-1]] += 1
    behind[at[1:] - 1] -= 1
    return np.concatenate([own, own[before], own[behind]], axis=1)


def _steps(at: np.ndarray) -> list[np.ndarray]:
    """The lines at place 0, 1, ... of all chains; longer chains first, so that each step's
    chains are the first of the step before."""
    length = np.diff(at)
    order = np.argsort(-length, kind="stable")
    start, length = at[:-1][order], length[order]
    active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")
    return [start[:k] + t for t, k in enumerate(active)]


def forward_backward(evidence: np.ndarray, at: np.ndarray, move: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log forward, log backward) of both states of every line of all chains. ``evidence``
    is the log odds that a line is good."""
    a, b = np.zeros((len(evidence), 2)), np.zeros((len(evidence), 2))
    steps = _steps(at)
    for t, i in enumerate(steps):
        if not t:
            a[i] = begin
        else:
            a[i, 0] = np.logaddexp(a[i - 1, 0] + move[0, 0], a[i - 1, 1] + move[1, 0])
            a[i, 1] = np.logaddexp(a[i - 1, 0] + move[0, 1], a[i - 1, 1] + move[1, 1])
        a[i, 1] += evidence[i]
    for i in reversed(steps[1:]):
        good = evidence[i] + b[i, 1]
        b[i - 1, 0] = np.logaddexp(move[0, 0] + b[i, 0], move[0, 1] + good)
        b[i - 1, 1] = np.logaddexp(move[1, 0] + b[i, 0], move[1, 1] + good)
    return a, b


@dataclass
class Field:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    move: np.ndarray
    begin: np.ndarray

    def marginals(self, own: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The probability of each line that it is good."""
        x = (with_neighbours(own, at) - self.mean) / self.scale
        a, b = forward_backward(x @ self.weight + self.bias, at, self.move, self.begin)
        return 1 / (1 + np.exp(np.clip((a + b)[:, 0] - (a + b)[:, 1], -500, 500)))


def fit(chains: list[tuple[np.ndarray, int]]) -> Field:
    """Gradient ascent (Adam) on the likelihood of the chains' labels."""
    width = line_features(np.empty(0, np.uint8), np.zeros(2, np.int64))[0].shape[1]
    parts = [(x[k : k + TRAIN_LINES], y) for x, y in chains for k in range(0, len(x), TRAIN_LINES)] or [(np.zeros((1, width), np.float32), 1)]
    at = np.concatenate([[0], np.cumsum([len(x) for x, _ in parts])])
    label = np.repeat([y for _, y in parts], np.diff(at))
    x = with_neighbours(np.concatenate([x for x, _ in parts]), at).astype(np.float64)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    x = (x - mean) / scale
    n, d = x.shape
    theta = np.zeros(d + 7)  # weights, bias, moves, begin
    inner = np.ones(n, bool)
    inner[at[:-1]] = False
    i = np.flatnonzero(inner)
    first = at[:-1]
    seen_move = np.bincount(2 * label[i - 1] + label[i], minlength=4)
    seen_begin = np.bincount(label[first], minlength=2)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        move, begin = theta[d + 1 : d + 5].reshape(2, 2), theta[d + 5 :]
        e = x @ theta[:d] + theta[d]
        a, b = forward_backward(e, at, move, begin)
        z = np.repeat(np.logaddexp(*(a[at[1:] - 1]).T), np.diff(at))
        p = np.exp(a + b - z[:, None])
        pair = [np.exp(a[i - 1, s] + move[s, t] + t * e[i] + b[i, t] - z[i]).sum() for s in (0, 1) for t in (0, 1)]
        rest = label - p[:, 1]
        gradient = np.concatenate([x.T @ rest, [rest.sum()], seen_move - pair, seen_begin - p[first].sum(axis=0)]) / n - DECAY * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(mean, scale, theta[:d], float(theta[d]), theta[d + 1 : d + 5].reshape(2, 2), theta[d + 5 :])


def train(docs: DataFrame, labels: DataFrame, learn: Column) -> Field:
    """The field of the labelled documents that ``learn`` (of doc_id) holds for."""
    known = labels.filter(learn & F.col(ID).isNotNull() & F.col("quality").isNotNull()).groupBy(ID).agg(F.min("quality").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64(ID), ID).limit(TRAIN_DOCS)
    sample = texts(docs).join(F.broadcast(chosen), ID).select(ID, "label", TEXT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, off in chunks(b.column(2)):
                own, _, at = line_features(buf, off)
                data = [own[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
                yield batch(_TRAIN, *(b.column(k).slice(lo, hi - lo) for k in (0, 1)), np.diff(at), data)

    rows = sample.mapInArrow(run, f"{ID} bigint, label int, lines bigint, features binary").collect()
    return fit([(np.frombuffer(r["features"], np.float32).reshape(r["lines"], -1), r["label"]) for r in sorted(rows, key=lambda r: (r[ID], r["features"]))])


def score(docs: DataFrame, field: Field, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """A row per row of ``docs``: doc_id, score (0 to 1, higher: better), n_lines, bad_lines
    (lines that are bad more likely than good).

    A line weighs its bytes and one more. A null or empty text is one empty line and is
    scored like it. Rows that repeat are scored each, alike; an empty table gives no rows.
    Without labelled documents every score is near a half.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, off in chunks(b.column(1)):
                own, size, at = line_features(buf, off)
                good = field.marginals(own, at)
                weight = size + 1.0
                total = np.add.reduceat(good * weight, at[:-1]) / np.add.reduceat(weight, at[:-1])
                yield batch(_SCORES, b.column(0).slice(lo, hi - lo), np.clip(total, 0, 1), np.diff(at), np.add.reduceat((good < 0.5).astype(np.int64), at[:-1]))

    return texts(docs, id_col, text_col).mapInArrow(run, f"{ID} bigint, score double, n_lines bigint, bad_lines bigint")
