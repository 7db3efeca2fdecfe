"""Packing by power-of-two decomposition.

A document's ids (its tokens and one end id) are cut into pieces whose lengths are the
powers of two of its length's binary form, whole sequences of ``limit`` first, then
descending. Each piece is a sequence of its own: no sequence crosses documents, and a batch
drawn from one length bucket needs no padding at all. Cutting needs no other document, so
the work is one pass over the scan: no shuffle, no group and no order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, TEXT, batch, chunks, texts
from .tokens import encoder, vocabulary_path

_SCHEMA = pa.schema([(ID, pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])


def cuts(n: int, limit: int) -> list[int]:
    """The lengths of the pieces of ``n`` ids, longest first."""
    rest = n % limit
    return [limit] * (n // limit) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, limit: int = 4096, end_id: int = 2, vocabulary: str | None = None, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, bucket (the
    length's power of two) and ids (little-endian unsigned 32-bit).

    ``limit`` is a power of two. ``sequence_id`` is unique, and the same whenever the same
    file splits are read. A null or empty text is its end id alone; rows that repeat an id,
    or have none, are packed like any other. An empty table gives no rows.
    """
    if limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for b in batches:
            for lo, hi, _, _ in chunks(b.column(1)):
                ids, at = code.encode(b.column(1).slice(lo, hi - lo))
                rows = []
                for doc, x, y in zip(b.column(0).slice(lo, hi - lo).to_pylist(), at[:-1], at[1:], strict=True):
                    own = np.append(ids[x:y], np.uint32(end_id)).astype("<u4")
                    start = 0
                    for length in cuts(len(own), limit):
                        rows.append((doc, start, length, len(own), own[start : start + length].tobytes()))
                        start += length
                yield batch(_SCHEMA, *(list(c) for c in zip(*rows, strict=True)))

    out = texts(docs, id_col, text_col).mapInArrow(run, f"{ID} bigint, start bigint, length bigint, doc_tokens bigint, ids binary")
    return out.select(
        ID, "start", "length", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"), F.log2("length").cast("int").alias("bucket"), "ids",
    )


def write_buckets(packed: DataFrame, folder: str) -> None:
    """Packed sequences as Parquet, one folder per length bucket."""
    packed.write.partitionBy("bucket").parquet(folder)
