"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by the number of their shingles, each partition up to a power of two,
``u``. An item is short and a document may be long, so their Jaccard similarity would be near
zero however fully the item is contained; therefore each partition meets the documents in
windows of ``2 u`` shingles, one every ``u / 2``. An item of a partition that lies within
``1.5 u`` shingles of a document lies whole in one window, where a containment of ``t``
means a Jaccard similarity of ``t q / (q + 2 u - t q)`` at least, and the least of these over
the partition decides its bands. Window sketches are minima over blocks, shared by all
partitions. Whatever shares a band is verified: the item's whole shingle set against the
whole document's.

Items come in blocks of bounded size, each block one pass over the documents, whatever the
number of items. No pass shuffles.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words
from .common import ID, ROW, TEXT, batch, chunks, keyed
from .ngram_join import bands_for

#: Shingles of the items that one pass takes, and so the size of what is broadcast.
BLOCK_GRAMS = 1 << 20
#: Hash functions of a partition at most.
MOST = 96
_HITS = pa.schema([(ID, pa.int64()), (ROW, pa.int64()), ("item_id", pa.int64()), ("n_grams", pa.int64()), ("n_found", pa.int64())])
_FILTER = 18


class Index:
    """Sketches of one block of items by size partition, and their shingle sets."""

    def __init__(self, items: list[tuple[int, np.ndarray]], over: int, under: int, recall: float):
        self.items, self.over, self.under = items, over, under
        parts = defaultdict(list)
        for k, (_, grams) in enumerate(items):
            parts[max(2, 1 << (len(grams) - 1).bit_length())].append(k)
        self.parts = []
        t = over / under
        for u, own in sorted(parts.items()):
            q = min(len(items[k][1]) for k in own)
            bands, rows = bands_for(t * q / (q + 2 * u - t * q), recall, MOST) if q > 2 else (MOST, 1)
            tables = []
            sketch = np.stack([self.sketch(items[k][1], np.array([0]), bands * rows)[:, 0] for k in own])
            for b in range(bands):
                value = self.band(sketch[:, b * rows : (b + 1) * rows].T)
                order = np.argsort(value, kind="stable")
                seen = np.zeros(1 << _FILTER, bool)
                seen[value >> words.U(64 - _FILTER)] = True
                tables.append((seen, value[order], np.array(own)[order]))
            self.parts.append((u, bands, rows, tables))

    @staticmethod
    def sketch(grams: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """The least value of each hash function over the blocks that begin at ``at``."""
        salt, factor = words.constants(size, 23), words.constants(size, 29)
        with np.errstate(over="ignore"):
            return np.stack([np.minimum.reduceat((grams ^ salt[k]) * factor[k], at) for k in range(size)])

    @staticmethod
    def band(rows: np.ndarray) -> np.ndarray:
        join = words.constants(len(rows), 31)
        with np.errstate(over="ignore"):
            return words.mix((words.mix(rows) * join[:, None]).sum(axis=0, dtype=words.U))

    def candidates(self, grams: np.ndarray, to: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs that share a band."""
        found: set[tuple[int, int]] = set()
        count = np.diff(to)
        full = np.flatnonzero(count)
        if not len(full):
            return found
        unit = self.parts[0][0] // 2
        most = max(bands * rows for _, bands, rows, _ in self.parts)
        # Blocks of the smallest partition; each larger one's are made of pairs of them.
        n = -(-count[full] // unit)
        text = np.repeat(full, n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        least = self.sketch(grams, to[text] + nth * unit, most)
        for u, bands, rows, tables in self.parts:
            while unit < u // 2:
                first = np.flatnonzero(nth % 2 == 0)
                least = np.minimum.reduceat(least, first, axis=1)
                text, nth, unit = text[first], nth[first] // 2, unit * 2
            # A window is four blocks from each block on, fewer at the end of a text.
            window = least[: bands * rows].copy()
            for k in range(1, 4):
                if len(text) > k:
                    same = text[k:] == text[:-k]
                    window[:, :-k][:, same] = np.minimum(window[:, :-k][:, same], least[: bands * rows, k:][:, same])
            for b, (seen, value, own) in enumerate(tables):
                mine = self.band(window[b * rows : (b + 1) * rows])
                hit = np.flatnonzero(seen[mine >> words.U(64 - _FILTER)])
                lo, hi = np.searchsorted(value, mine[hit], "left"), np.searchsorted(value, mine[hit], "right")
                for h, x, y in zip(hit[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                    found.update((int(text[h]), k) for k in own[x:y].tolist())
        return found

    def hits(self, grams: np.ndarray, to: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item id, shingles of the item, of these found in the text)."""
        out, last, own = [], -1, None
        for text, k in sorted(self.candidates(grams, to)):
            if text != last:
                last, own = text, np.unique(grams[to[text] : to[text + 1]])
            item, wanted = self.items[k]
            n = int((own[np.minimum(np.searchsorted(own, wanted), len(own) - 1)] == wanted).sum())
            if n * self.under >= len(wanted) * self.over:
                out.append((text, item, len(wanted), n))
        return out


def _blocks(items: DataFrame, n: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    block, size = [], 0
    for item, text in items.toLocalIterator():
        for _, _, buf, off in chunks(pa.array([text], pa.string())):
            _, _, grams, _ = words.of_texts(buf, off, n)
            if len(grams):
                block.append((item, np.unique(grams)))
                size += len(block[-1][1])
        if size >= BLOCK_GRAMS:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, n: int = 5, over: int = 4, under: int = 5, recall: float = 0.9995, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """(document, item) pairs with at least ``over / under`` of the item's distinct ``n``-word
    shingles in the document: doc_id, row hash, item_id, n_grams, n_found.

    ``items`` has item_id and text. A text of fewer than ``n`` words has one shingle, of all
    its words, so such an item is found only in texts of just these words. Items and
    documents without words (null, empty, blank) are in no pair; rows that repeat give a
    pair each; empty tables give no pairs.
    """
    spark = docs.sparkSession
    own = keyed(docs, id_col, text_col)
    out = spark.createDataFrame([], f"{ID} bigint, {ROW} bigint, item_id bigint, n_grams bigint, n_found bigint")
    found = []
    for block in _blocks(items.select("item_id", "text"), n):
        shared = spark.sparkContext.broadcast(Index(block, over, under, recall))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                for lo, hi, buf, off in chunks(b.column(1)):
                    _, _, grams, to = words.of_texts(buf, off, n)
                    if hits := index.hits(grams, to):
                        text, item, size, common = (list(c) for c in zip(*hits, strict=True))
                        at = pa.array(text)
                        yield batch(_HITS, *(b.column(k).slice(lo, hi - lo).take(at) for k in (0, 2)), item, size, common)

        found.append(own.mapInArrow(run, out.schema))
    for f in found:
        out = out.unionAll(f) if len(found) > 1 else f
    return out


def clean(docs: DataFrame, items: DataFrame, n: int = 5, over: int = 4, under: int = 5, recall: float = 0.9995, text_col: str = TEXT) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item in the sense of ``search``; each
    block of items is one more pass in the same task."""
    out = docs
    for block in _blocks(items.select("item_id", "text"), n):
        shared = docs.sparkSession.sparkContext.broadcast(Index(block, over, under, recall))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                for lo, hi, buf, off in chunks(b.column(b.schema.get_field_index(text_col))):
                    _, _, grams, to = words.of_texts(buf, off, n)
                    stays = np.ones(hi - lo, bool)
                    stays[[h[0] for h in index.hits(grams, to)]] = False
                    yield b.slice(lo, hi - lo).filter(pa.array(stays))

        out = out.mapInArrow(run, out.schema)
    return out
