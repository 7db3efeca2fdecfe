"""Licence scan: winnowed fingerprints in an inverted index, then banded alignment.

Texts and templates are read without case, punctuation and repeated spaces. From every
``WINDOW`` neighbouring character grams of a template the one of least hash is kept, so any
run of ``WINDOW + GRAM - 1`` characters that a text shares with a template holds a kept gram;
every gram of a text is looked up. Around the diagonal of every hit the words of the text are
aligned with those of the template in a band; of the alignments that reach the coverage the
best are places, and hits outside of them are aligned again between them until none gives
another. One pass over the scan; the templates are a parameter and travel with the code.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words
from .common import ID, TEXT, batch, chunks, texts
from .license_templates import TEMPLATES

GRAM, WINDOW = 12, 8
#: Words by which an alignment may leave the diagonal of its hits.
BAND = 12
_FILTER = 20
_RESULT = pa.schema([(ID, pa.int64()), ("template", pa.string()), ("coverage", pa.float64()), ("n_matched", pa.int64()), ("n_words", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

_PLAIN = np.full(256, 32, np.uint8)
for _c in range(256):
    if chr(_c).isascii() and chr(_c).isalnum() or _c > 127:
        _PLAIN[_c] = ord(chr(_c).lower()) if _c < 128 else _c


def plain(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(normalised bytes, the place of each in ``buf``, offsets of the texts in them)."""
    out = _PLAIN[buf]
    space = out == 32
    drop = space.copy()
    drop[1:] &= space[:-1]
    drop[:1] = False
    at = np.flatnonzero(~drop)
    return out[at], at, np.searchsorted(at, off)


def grams(text: np.ndarray) -> np.ndarray:
    n = max(len(text) - GRAM + 1, 0)
    h = np.zeros(n, words.U)
    power = words.powers(GRAM)
    with np.errstate(over="ignore"):
        for j in range(GRAM):
            h += text[j : j + n].astype(words.U) * power[j]
    return words.mix(h)


def winnowed(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the least hash (the last of equal ones) of every ``window`` neighbours."""
    if not len(h):
        return np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(h, min(window, len(h)))
    last = windows.shape[1] - 1 - windows[:, ::-1].argmin(axis=1)
    return np.unique(last + np.arange(len(windows)))


def align(template: list[bytes], text: list[bytes], diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(template words matched, first and end word of the text) of the best local alignment
    with ``text[i + diagonal + d]`` at ``template[i]``, ``d`` within ``band``: 2 for a match, -1
    for a word changed, added or missing."""
    width, none = 2 * band + 1, (0, 0, -1, -1)
    before, best = [none] * (width + 1), none
    for i, word in enumerate(template):
        row, left = [], none
        for d in range(width):
            j = i + diagonal + d - band
            cell = none
            if 0 <= j < len(text):
                s, m, a, _ = before[d]
                cell = (s + 2, m + 1, a if s else j, j + 1) if text[j] == word else (s - 1, m, a, j + 1)
                up = before[d + 1]
                for s, m, a, e in ((up[0] - 1, up[1], up[2], up[3]), (left[0] - 1, left[1], left[2], j + 1)):
                    if s > cell[0]:
                        cell = (s, m, a, e)
                if cell[0] <= 0:
                    cell = none
                if cell[0] > best[0]:
                    best = cell
            row.append(cell)
            left = cell
        before = [*row, none]
    return best[1], best[2], best[3]


class Index:
    """The inverted index of the templates' fingerprints."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words, self.ends = [], []
        value, owner, place = [], [], []
        for k, name in enumerate(self.names):
            buf = np.frombuffer(templates[name].encode(), np.uint8)
            text, _, _ = plain(buf, np.array([0, len(buf)]))
            text = np.frombuffer(text.tobytes().strip(), np.uint8)
            h = grams(text)
            kept = winnowed(h)
            value.append(h[kept])
            owner.append(np.full(len(kept), k))
            place.append(kept)
            first, last, _ = words.word_spans(text, np.array([0, len(text)]))
            self.ends.append(last)
            self.words.append([text[a:b].tobytes() for a, b in zip(first, last, strict=True)])
        value, owner, place = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (value, owner, place))
        order = np.argsort(value, kind="stable")
        self.value, self.owner, self.place = value[order].astype(words.U), owner[order], place[order]
        self.seen = np.zeros(1 << _FILTER, bool)
        self.seen[self.value >> words.U(64 - _FILTER)] = True

    def scan(self, buf: np.ndarray, off: np.ndarray, least: float) -> list[tuple[int, int, int, int, int, int]]:
        """(text, template, words matched, words of the template, first and end byte)."""
        text, source, at = plain(buf, off)
        h = grams(text)
        hit = np.flatnonzero(self.seen[h >> words.U(64 - _FILTER)])
        doc = np.searchsorted(at, hit, "right") - 1
        inside = hit + GRAM <= at[doc + 1]
        hit, doc = hit[inside], doc[inside]
        lo, hi = np.searchsorted(self.value, h[hit], "left"), np.searchsorted(self.value, h[hit], "right")
        n = hi - lo
        post = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        doc, hit, owner, place = np.repeat(doc, n), np.repeat(hit, n), self.owner[post], self.place[post]
        # The first byte of a word: a gram that begins with a space belongs to the word behind it.
        hit, place = hit + (text[hit] == 32), place + (text[hit] == 32)
        order = np.lexsort((owner, doc))
        doc, owner, hit, place = doc[order], owner[order], hit[order], place[order]
        out = []
        for d, rows in groupby(range(len(doc)), lambda k: doc[k]):
            rows = np.array(list(rows))
            own = text[at[d] : at[d + 1]]
            first, last, _ = words.word_spans(own, np.array([0, len(own)]))
            for o in np.unique(owner[rows]).tolist():
                mine = rows[owner[rows] == o]
                word = np.searchsorted(last, hit[mine] - at[d], "right")
                diagonal = word - np.searchsorted(self.ends[o], place[mine], "right")
                hits = np.unique(np.stack([word, diagonal], axis=1), axis=0).tolist()
                for a, b, matched in self._places(own, first, last, self.words[o], hits, least):
                    out.append((int(d), o, matched, len(self.words[o]), int(source[at[d] + first[a]]), int(source[at[d] + last[b - 1] - 1]) + 1))
        return sorted(out)

    def _places(self, own, first, last, template, hits, least) -> list[tuple[int, int, int]]:
        """(first and end word, template words matched) of places that don't overlap. hits:
        (word of the text, diagonal)."""
        taken: list[tuple[int, int, int]] = []
        tried: dict[tuple[int, int, int], tuple[int, int, int] | None] = {}
        while hits:
            found, left = set(), []
            for word, diagonal in hits:
                k = bisect_right(taken, word, key=lambda t: t[0])
                if k and word < taken[k - 1][1]:
                    continue
                left.append((word, diagonal))
                lo = max(0, diagonal - BAND, taken[k - 1][1] if k else 0)
                hi = min(len(first), diagonal + len(template) + BAND, taken[k][0] if k < len(taken) else len(first))
                if (diagonal, lo, hi) not in tried:
                    tried[diagonal, lo, hi] = self._best(own, first, last, template, diagonal, lo, hi, least)
                if best := tried[diagonal, lo, hi]:
                    found.add(best)
            if not found:
                break
            for a, b, matched in sorted(found, key=lambda t: (-t[2], t[1] - t[0], t[0])):
                k = bisect_left(taken, a, key=lambda t: t[0])
                if (not k or taken[k - 1][1] <= a) and (k == len(taken) or b <= taken[k][0]):
                    insort(taken, (a, b, matched))
            hits = left
        return taken

    def _best(self, own, first, last, template, diagonal, lo, hi, least) -> tuple[int, int, int] | None:
        """(first and end word, template words matched) of the best alignment within words lo
        to hi; where it does not reach ``least``, of the best beside it that does."""
        text = own[first[lo] : last[hi - 1]].tobytes().split() if lo < hi else []
        known = set(text)
        if sum(w in known for w in template) < least * len(template):
            return None
        matched, a, b = align(template, text, diagonal - lo)
        if not matched:
            return None
        if matched >= least * len(template):
            return lo + a, lo + b, matched
        beside = [self._best(own, first, last, template, diagonal, *x, least) for x in ((lo, lo + a), (lo + b, hi))]
        return max((x for x in beside if x), key=lambda t: t[2], default=None)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """A row per place where ``least`` of a template's words stand in order: doc_id, template,
    coverage (n_matched / n_words), n_matched, n_words, start and end (character offsets in
    the text).

    Several templates may match one place; each is reported. Places of one template don't
    overlap, however near they are. Templates of fewer than ``GRAM``
    characters have no fingerprint and are refused. Null, empty and blank texts give no rows,
    rows that repeat give theirs each, an empty table gives none.
    """
    chosen = dict(TEMPLATES if templates is None else templates)
    index = Index(chosen)
    if short := sorted(set(index.names) - {index.names[k] for k in index.owner.tolist()}):
        raise ValueError(f"templates too short: {short}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, off in chunks(b.column(1)):
                found = index.scan(buf, off, least)
                if not found:
                    continue
                rows = []
                for d, o, matched, size, first, end in found:
                    begins = (buf[off[d] : end] & 0xC0) != 0x80  # first bytes of characters
                    rows.append((b.column(0)[lo + d].as_py(), index.names[o], matched / size, matched, size, int(begins[: first - off[d]].sum()), int(begins.sum())))
                yield batch(_RESULT, *(list(c) for c in zip(*rows, strict=True)))

    return texts(docs, id_col, text_col).mapInArrow(run, f"{ID} bigint, template string, coverage double, n_matched bigint, n_words bigint, start bigint, end bigint")
