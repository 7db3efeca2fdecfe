"""Exact removal of long repeated byte strings by prefix-free parsing.

Triggers: a position is a trigger when the rolling hash of the bytes from there is the least
(the leftmost of equal ones) of as many neighbouring positions as half a string has. So
every string of ``length`` bytes has one trigger of its own in its first half, which its
own bytes alone decide. The strings that share a trigger start side by side; a phrase is the
text from the first of them to the end of the last, and phrases overlap by a string's length,
so that no string is cut. Equal strings have the same trigger at the same place in them:
only phrases with the same bytes behind their trigger can hold equal strings.

From here the method departs from the textbook one: no suffix array of dictionary and parse is
built, and nothing is put in corpus order. The question is only which 200-byte strings start at
two places, and equal strings lie in phrases of one digest, so phrases are grouped by digest
instead of being ranked. What stands alone falls out, which is nearly all of ordinary text.
Phrases equal as wholes are repeated as wholes, however many copies there are: one of
them speaks for all. Only where different phrases meet, that is at the edges of repeated
passages, are the strings of one phrase of each kind digested and counted.

Strings meet only under two 64-bit hashes of overlapping bytes that both agree. Rows are
known by a 64-bit hash of id and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ID, ROW, TEXT, batch, chunks, cut

#: Bytes under the rolling hash.
GRAM = 16
_PHRASES = pa.schema([("key", pa.int64()), ("whole", pa.int64()), (ROW, pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("more", pa.list_(pa.int32()))])
_STRINGS = pa.schema([("key", pa.int64()), ("string", pa.int64()), (ROW, pa.int64()), ("first", pa.int32())])
_U = np.uint64
_POWERS = np.array([pow(0x9E3779B97F4A7C15, GRAM - 1 - j, 1 << 64) for j in range(GRAM)], _U)


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, _U).view(np.int64)


def rolling(buf: np.ndarray) -> np.ndarray:
    """The 32 highest mixed bits of the polynomial hash of every ``GRAM`` bytes."""
    n = len(buf) - GRAM + 1
    h = np.zeros(n, _U)
    with np.errstate(over="ignore"):
        for j in range(GRAM):
            h += buf[j : j + n].astype(_U) * _POWERS[j]
        h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h >> _U(32)


def phrases(buf: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first string start, number of strings, trigger) of the phrases of all texts;
    places count from the start of ``buf``."""
    none = np.empty(0, np.int64)
    room = np.maximum(np.diff(off) - length + 1, 0)
    total = int(room.sum())
    if not total:
        return none, none, none, none
    wide = length // 2 - GRAM + 1
    order = (rolling(buf) << _U(32)) | np.arange(len(buf) - GRAM + 1, dtype=_U)
    pad = -len(order) % wide
    blocks = np.concatenate([order, np.full(pad + wide, np.iinfo(_U).max, _U)]).reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    text = np.repeat(np.arange(len(room)), room)
    start = np.arange(total) + np.repeat(off[:-1] - (np.cumsum(room) - room), room)
    trigger = (np.minimum(behind[start], ahead[start + wide - 1]) & _U(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(total, bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], start[at], np.diff(at, append=total), trigger[at]


def _gathered(key: np.ndarray, whole: np.ndarray, text: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(places of the first of equal phrases of a text, where the others start): a text that
    repeats a word a thousand times sends one row."""
    order = np.lexsort((first, whole, key, text))
    new = np.ones(len(order), bool)
    new[1:] = (text[order][1:] != text[order][:-1]) | (key[order][1:] != key[order][:-1]) | (whole[order][1:] != whole[order][:-1])
    others = np.diff(np.flatnonzero(new), append=len(order)) - 1
    places = np.concatenate([[0], np.cumsum(others)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(places, mask=np.append(others == 0, False)), pa.array(first[order][~new]))
    return order[new], lists


def _parse(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, off in chunks(b.column(0)):
                text, first, n, trigger = phrases(buf, off, length)
                if not len(text):
                    continue
                row = b.column(1).slice(lo, hi - lo).to_numpy()[text]
                data, digest, half = memoryview(buf), xxhash.xxh3_64_intdigest, length // 2
                key = [digest(data[t : t + half]) for t in trigger.tolist()]
                # The place of the trigger belongs to the phrase.
                whole = [digest(data[f : f + k + length - 1], seed=t - f) for f, k, t in zip(first.tolist(), n.tolist(), trigger.tolist(), strict=True)]
                key, whole, first = _signed(key), _signed(whole), (first - off[text]).astype(np.int32)
                at, more = _gathered(key, whole, text, first)
                yield batch(_PHRASES, key[at], whole[at], row[at], first[at], n[at].astype(np.int32), more)

    return run


def _strings(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            first_list, n_list, key_list = (b.column(b.schema.get_field_index(c)) for c in ("first", "n", "key"))
            for lo, hi, buf, off in chunks(b.column(1), 1 << 18):
                data = memoryview(buf)
                parts = []
                for i in range(lo, hi):
                    at, row = int(off[i - lo]), b.column(2)[i].as_py()
                    first, n, key = (c[i].values.to_numpy() for c in (first_list, n_list, key_list))
                    place = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                    found = _signed([digest(data[at + p : at + p + length]) for p in place.tolist()])
                    parts.append((np.repeat(key, n), found, np.full(len(place), row), place.astype(np.int32)))
                if parts:
                    yield batch(_STRINGS, *(np.concatenate(c) for c in zip(*parts, strict=True)))

    return run


def _remove(as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, carried, start, end = (b.column(b.schema.get_field_index(c)) for c in (TEXT, "carried", "start", "end"))
            kind = pa.string() if as_text else pa.binary()
            schema = pa.schema([b.schema.field("carried"), ("n_bytes", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept", kind)])
            for lo, hi, buf, off in chunks(text):
                starts, ends, kept = [], [], []
                for i in range(lo, hi):
                    own = buf[off[i - lo] : off[i - lo + 1]]
                    turn = np.empty(0, np.int64)
                    if start[i].is_valid:
                        edge = np.bincount(start[i].values.to_numpy(), minlength=len(own) + 1) - np.bincount(end[i].values.to_numpy(), minlength=len(own) + 1)
                        gone = np.cumsum(edge[:-1]) > 0
                        turn = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                        own = own[~gone]
                    starts.append(turn[::2])
                    ends.append(turn[1::2])
                    kept.append(own.tobytes().decode(errors="ignore") if as_text else own.tobytes())
                yield batch(schema, carried.slice(lo, hi - lo), np.diff(off), starts, ends, kept)

    return run


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = ID, text_col: str = TEXT, as_text: bool = False) -> DataFrame:
    """Every byte covered by a string of ``length`` bytes that starts at another place too,
    in the same document or another one, is removed. Returns the columns of ``docs`` but the
    text in a struct ``carried``, n_bytes, starts and ends (the removed runs, in bytes) and
    kept (the bytes that remain; ``as_text``: as a string without characters cut in two), a
    row per row of ``docs``.

    Overlaps count; all copies go, the first one too; matches never cross documents. A null
    text is empty, texts shorter than ``length`` stay, rows that repeat another whole row
    lose what the two share, and an empty table gives no rows. ``length`` is 64 at least.
    """
    if length < 64:
        raise ValueError("length must be 64 at least")
    others = F.struct(*(c for c in docs.columns if c != text_col))
    rows = docs.select(others.alias("carried"), F.col(text_col).alias(TEXT), F.xxhash64(text_col, id_col).alias(ROW))
    parsed = rows.select(TEXT, ROW).mapInArrow(_parse(length), f"key bigint, whole bigint, {ROW} bigint, first int, n int, more array<int>")
    times = F.sum(1 + F.coalesce(F.array_size("more"), F.lit(0)))
    group, kind = Window.partitionBy("key"), Window.partitionBy("key", "whole")
    met = (
        parsed.withColumns({"size": times.over(group), "least": F.min("whole").over(group), "most": F.max("whole").over(group)})
        .filter("size > 1")
        .withColumns({"equal": times.over(kind), "nth": F.row_number().over(kind.orderBy(ROW, "first"))})
        .select("key", ROW, "first", "n", "more", (F.col("equal") > 1).alias("repeated"), ((F.col("least") != F.col("most")) & (F.col("nth") == 1)).alias("speaks"))
        .filter("repeated or speaks")
    )
    met = cut(met, "phrases")
    # One exchange of the texts serves both joins.
    speaking = met.filter("speaks").groupBy(ROW).agg(*(F.collect_list(c).alias(c) for c in ("first", "n", "key")))
    strings = (
        rows.join(speaking, ROW).select("carried", TEXT, ROW, "first", "n", "key")
        .mapInArrow(_strings(length), f"key bigint, string bigint, {ROW} bigint, first int")
        .withColumn("equal", F.count("*").over(Window.partitionBy("key", "string")))
        .filter("equal > 1").select(ROW, F.col("first").alias("start"), (F.col("first") + length).alias("end"))
    )
    repeated = met.filter("repeated")
    repeated = repeated.select(ROW, "first", "n").unionAll(repeated.select(ROW, F.explode("more").alias("first"), "n"))
    covered = repeated.select(ROW, F.col("first").alias("start"), (F.col("first") + F.col("n") + (length - 1)).alias("end"))
    # A row that is there many times says the same of each copy; one set of spans serves them all.
    spans = covered.unionAll(strings).groupBy(ROW).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = spans.select(ROW, F.transform("spans", lambda s: s["start"]).alias("start"), F.transform("spans", lambda s: s["end"]).alias("end"))
    joined = rows.join(spans, ROW, "left").select("carried", TEXT, "start", "end")
    kind = "string" if as_text else "binary"
    return joined.mapInArrow(_remove(as_text), f"carried {rows.schema['carried'].dataType.simpleString()}, n_bytes bigint, starts array<bigint>, ends array<bigint>, kept {kind}")


def cleaned(docs: DataFrame, length: int = 200, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """``docs`` with all their columns and rows, texts without repeated strings; a text that is
    one repeat, and a null text, is empty then."""
    out = remove_repeats(docs, length, id_col, text_col, as_text=True)
    return out.select(*(F.col("kept").alias(c) if c == text_col else F.col("carried")[c].alias(c) for c in docs.columns))
