"""Substring dedup by lines and paragraphs.

Units are lines, and paragraphs of two lines or more (lines between blank ones), so that a
passage which is broken into short lines counts as well. A unit of fewer than ``LEAST`` words is
too common to be a copy and never goes by itself. Units are normalised (case dropped, white space
collapsed) and digested; digests are counted and ranked over the whole corpus by partial
aggregation, and only digests that occur twice or more travel back to the units. The unit of the
least rank (doc_id, then place) stays, all others go, with their character offsets in the
original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ID, ROW, TEXT, batch, cut, join_counted, keyed

#: Words a unit has at least to be removed. Of the documents of the smallest test table that
#: share no 50 words with another, 355 of 803 lose a line without this bound, 29 with it.
LEAST = 15
_SPACES = r"[\x20\x09-\x0D]+"
#: What separates two paragraphs.
BLANK = r"\n[\x20\x09-\x0D]*\n"
_RESULT = pa.schema([
    (ID, pa.int64()), ("n_units", pa.int64()), ("n_repeated", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept", pa.string()),
])


def normal(unit: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(unit), _SPACES, " "))


def lines_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the lines of a text."""
    size = np.array([len(u) for u in text.split("\n")])
    start = np.cumsum(size) - size + np.arange(len(size))
    return start, start + size


def paragraphs_of(text: str) -> list[tuple[int, int]]:
    """(start, end) of the paragraphs of a text, in the numbering of a split at ``BLANK``."""
    cuts = [(0, 0), *(m.span() for m in re.finditer(BLANK, text)), (len(text), len(text))]
    return [(a[1], b[0]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc, text, lines, paragraphs, repeated in zip(*(c.to_pylist() for c in b.columns), strict=True):
            text = text or ""
            start, end = lines_of(text)
            gone = np.zeros(len(start), bool)
            gone[list(lines or ())] = True
            if paragraphs:
                places = paragraphs_of(text)
                for k in paragraphs:
                    gone |= (start >= places[k][0]) & (end <= places[k][1])
            kept = "\n".join(text[s:e] for s, e in zip(start[~gone].tolist(), end[~gone].tolist(), strict=True)) if gone.any() else text
            rows.append((doc, len(start), repeated or 0, start[gone].tolist(), end[gone].tolist(), kept))
        if rows:
            yield batch(_RESULT, *(list(c) for c in zip(*rows, strict=True)))


def dedup(docs: DataFrame, least: int = LEAST, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_units (lines), n_repeated (lines and paragraphs of
    ``least`` words or more that occur elsewhere too, the first occurrence included), starts and
    ends (character offsets of the removed lines in the original text, without line ends)
    and kept (the other lines).

    A line goes if it, or its paragraph, is a unit of ``least`` words or more and occurred
    before: ids rank in ascending order, null last; rows that repeat an id rank by the hash of
    their text, then places in the text; rows that repeat a whole row count as one document.
    A null text is one empty line. An empty table gives no rows.
    """
    own = keyed(docs, id_col, text_col)
    text = F.coalesce(TEXT, F.lit(""))
    line = own.select(ID, ROW, F.lit(0).alias("kind"), F.posexplode(F.split(text, "\n")).alias("nth", "unit"))
    paragraph = own.select(ID, ROW, F.lit(1).alias("kind"), F.posexplode(F.split(text, BLANK)).alias("nth", "unit")).filter(F.col("unit").contains("\n"))
    units = line.unionByName(paragraph).select(ID, ROW, "kind", "nth", normal(F.col("unit")).alias("unit"))
    units = units.filter((F.col("unit") != "") & (F.size(F.split("unit", " ")) >= least))
    units = cut(units.select(ID, ROW, "kind", "nth", F.unhex(F.md5(F.concat_ws(":", "kind", "unit"))).alias("digest")), "units")
    rank = F.struct(F.col(ID).isNull().alias("none"), ID, ROW, "nth")
    first = units.groupBy("digest").agg(F.min(rank).alias("first"), F.max(rank).alias("last"), F.count("*").alias("n"))
    first = first.filter(~F.col("first").eqNullSafe(F.col("last"))).select("digest", "first", "n")
    found = join_counted(units, first, "digest").withColumn("later", ~rank.eqNullSafe(F.col("first")))
    gone = found.groupBy(ID, ROW).agg(
        F.collect_set(F.when(F.col("later") & (F.col("kind") == 0), F.col("nth"))).alias("lines"),
        F.collect_set(F.when(F.col("later") & (F.col("kind") == 1), F.col("nth"))).alias("paragraphs"),
        F.count_distinct("kind", "nth").alias("repeated"),
    ).withColumnsRenamed({ID: "_id", ROW: "_own"})
    joined = own.join(gone, (F.col(ROW) == F.col("_own")) & F.col(ID).eqNullSafe(F.col("_id")), "left").select(ID, TEXT, "lines", "paragraphs", "repeated")
    return joined.mapInArrow(_remove, f"{ID} bigint, n_units bigint, n_repeated bigint, starts array<bigint>, ends array<bigint>, kept string")
