"""Periodic runs of words: a suffix automaton whose suffix links form a link-cut tree.

The words of a text are appended one by one to a suffix automaton. Its suffix links are kept
as a link-cut tree in which every preferred path carries one colour: the place where its
strings ended last. Appending word i and calling ``access`` on its state walks the paths
between that state and the root. For a path of colour e, with a string of length L at its
lower end, the word suffixes that end at e and at i agree on exactly L words; if the distance
p = i - e is at most L, the L + p words up to i are a square (or more) of smallest period p,
and nothing to the left extends it. The walk then joins all these paths into one of colour i.
A run is met again at each of its words with the same first word and period, so the last
meeting extends it to its full length.

Words outside every run of the wanted length are skipped beforehand, and provably so: in a
run of ``LEAST`` words or more each word lies in some window of ``LEAST // 2`` words that
the text holds twice. Only stretches of such windows are appended; window hashes that collide
make a stretch longer, never lose one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ID, TEXT, batch, chunks, texts
from .words import U, mix, shingles, word_hashes, word_spans

#: A run has at least so many words, and at least twice its period.
LEAST = 12
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = pa.schema([(ID, pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


class LastEnds:
    """The suffix automaton of the words appended so far, and the link-cut tree of its suffix
    links. Node 0 is none, node 1 the root.

    A preferred path is a splay tree ordered by depth: ``left`` and ``right`` are children,
    ``up`` the parent, which for a path's topmost splay node is the state above the path.
    ``colour`` counts at the topmost splay node only.
    """

    def __init__(self) -> None:
        self.next: list[dict] = [{}, {}]
        self.link, self.length = [0, 0], [0, 0]
        self.left, self.right, self.up, self.colour = [0, 0], [0, 0], [0, 0], [-1, -1]
        self.last, self.n = 1, 0

    def _state(self, length: int, moves: dict) -> int:
        for values, value in ((self.next, moves), (self.link, 0), (self.length, length), (self.left, 0), (self.right, 0), (self.up, 0), (self.colour, -1)):
            values.append(value)
        return len(self.link) - 1

    def _splay(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        while True:
            p = up[x]
            if left[p] != x and right[p] != x:
                return
            g = up[p]
            inner = left[g] == p or right[g] == p
            if inner and (left[g] == p) == (left[p] == x):  # both turns the same way: the parent first
                self._turn(p, g)
                self._turn(x, p)
            else:
                self._turn(x, p)
                if inner:
                    self._turn(x, g)

    def _turn(self, x: int, p: int) -> None:
        left, right, up = self.left, self.right, self.up
        g = up[p]
        if left[p] == x:
            child = right[x]
            left[p], right[x] = child, p
        else:
            child = left[x]
            right[p], left[x] = child, p
        if child:
            up[child] = p
        if left[g] == p:
            left[g] = x
        elif right[g] == p:
            right[g] = x
        else:
            self.colour[x] = self.colour[p]
        up[p], up[x] = x, g

    def _above(self, q: int, clone: int) -> None:
        """``clone`` becomes the state above ``q``, on the path of ``q``, of its colour."""
        self._splay(q)
        over = self.left[q]
        self.left[q], self.up[clone], self.left[clone] = clone, q, over
        if over:
            self.up[over] = clone

    def _access(self, x: int, end: int) -> list[tuple[int, int]]:
        """Makes the path from ``x`` to the root one, of colour ``end``; returns (colour,
        length at the lower end) of the paths it is made of."""
        met, below = [], 0
        while x:
            self._splay(x)
            colour, deeper = self.colour[x], self.right[x]
            if colour >= 0:
                met.append((colour, self.length[x]))
            if deeper:
                self.colour[deeper] = colour
            self.right[x] = below
            below, x = x, self.up[x]
        self.colour[below] = end
        return met

    def append(self, word: int) -> list[tuple[int, int]]:
        """Appends a word; returns (previous end, common length) of the paths recoloured."""
        link, length, moves = self.link, self.length, self.next
        end, p = self.n, self.last
        self.n += 1
        cur = self.last = self._state(end + 1, {})
        while p and word not in moves[p]:
            moves[p][word] = cur
            p = link[p]
        if not p:
            link[cur] = 1
        else:
            q = moves[p][word]
            if length[q] > length[p] + 1:
                clone = self._state(length[p] + 1, dict(moves[q]))
                link[clone] = link[q]
                self._above(q, clone)
                link[q] = clone
                while p and moves[p].get(word) == q:
                    moves[p][word] = clone
                    p = link[p]
                q = clone
            link[cur] = q
        self.up[cur] = link[cur]
        return self._access(cur, end)


def runs_of(words: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every maximal run of ``words``, by start, then
    period."""
    ends, found = LastEnds(), {}
    for i, word in enumerate(words):
        for end, common in ends.append(word):
            if (period := i - end) <= common:
                found[i - common - period + 1, period] = i
    return sorted((s, i - s + 1, p) for (s, p), i in found.items() if i - s + 1 >= least)


def stretches(hashes: np.ndarray, at: np.ndarray, least: int = LEAST) -> list[np.ndarray]:
    """For each text, (start, end) of the stretches of words that can hold a run."""
    width = least // 2
    grams, to = shingles(hashes, at, width)
    text = np.repeat(np.arange(len(to) - 1), np.diff(to))
    with np.errstate(over="ignore"):
        key = mix(grams + text.astype(U) * U(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.flatnonzero(twice)
    place, owner = hit - to[text[hit]], text[hit]
    # Windows of one text that overlap or touch are one stretch.
    begins = np.ones(len(hit), bool)
    begins[1:] = (owner[1:] != owner[:-1]) | (place[1:] > place[:-1] + width)
    first = np.flatnonzero(begins)
    last = np.append(first[1:], len(hit)) - 1 if len(hit) else first
    spans = np.stack([place[first], place[last] + width], axis=1) if len(hit) else np.empty((0, 2), np.int64)
    return np.split(spans, np.searchsorted(owner[first], np.arange(1, len(to) - 1))) if len(to) > 1 else []


def of_text(raw: bytes, spans: np.ndarray, least: int = LEAST) -> tuple[int, list[tuple[int, int, int]], str]:
    """(number of words, runs, text without repetition) of one text, whose runs lie within
    ``spans``."""
    words, runs = raw.split(), []  # bytes split at exactly the six white space bytes
    for start, end in spans.tolist():
        known: dict[bytes, int] = {}
        ids = [known.setdefault(w, len(known)) for w in words[start:end]]
        runs += [(start + s, n, p) for s, n, p in runs_of(ids, least)]
    if runs:
        dropped = np.zeros(len(words) + 1, np.int64)
        for s, n, p in runs:
            dropped[s + p] += 1
            dropped[s + n] -= 1
        return len(words), runs, b" ".join(w for w, d in zip(words, np.cumsum(dropped).tolist(), strict=False) if not d).decode("utf-8", "replace")
    return len(words), runs, b" ".join(words).decode("utf-8", "replace")


def find(docs: DataFrame, least: int = LEAST, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, in words from 0, by start, then
    period) and collapsed (the words joined by one space, without those that a run holds
    behind its first period) of every text.

    A run is a stretch of at least ``least`` words, and at least twice its smallest period,
    that no neighbouring word extends. Words are runs of bytes other than space and
    ``\\x09`` to ``\\x0D``, compared byte by byte. A null or empty text has no words, no runs
    and an empty ``collapsed``; rows that repeat an id, or have none, are rows of their own;
    other columns are left out. An empty table gives no rows. One pass, no shuffle; a task
    holds one batch of rows, and the automaton of one stretch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, off in chunks(b.column(1)):
                begin, end, at = word_spans(buf, off)
                spans = stretches(word_hashes(buf, begin, end), at, least)
                found = [of_text(buf[x:y].tobytes(), s, least) for x, y, s in zip(off[:-1], off[1:], spans, strict=True)]
                runs = [[{"start": s, "length": n, "period": p} for s, n, p in r] for _, r, _ in found]
                yield batch(_SCHEMA, b.column(0).slice(lo, hi - lo), [n for n, _, _ in found], runs, [c for _, _, c in found])

    return texts(docs, id_col, text_col).mapInArrow(
        run, f"{ID} bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    )
