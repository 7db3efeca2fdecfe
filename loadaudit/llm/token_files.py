"""Token ids in binary shards of fixed bit width.

Documents are range-partitioned by id and sorted, and each partition becomes one shard, so
the shards in order hold all documents in ascending id order. A shard is:

    8 bytes  magic
    blocks   of ``block_ids`` ids, each id in ``bits`` bits, least significant bit first
    index    doc ids (int64), 1 byte each: id is null, first id of each document (int64)
    offsets  byte offset of every block (int64)
    footer   bits, block_ids, n_docs, n_ids, place of the index, place of the offsets (int64)

All numbers are little-endian. The width is the least that holds the vocabulary. Any run of
ids is read by its blocks alone and unpacked by numpy. A task writes under a name of its own
attempt and moves the file into place when it is whole: a task that runs again replaces
the same bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, TEXT, batch, chunks, cut, new_path, texts
from .tokens import encoder, vocabulary_path

MAGIC = b"TOKBITS1"
BLOCK_IDS = 1 << 16
#: Ids that a reader unpacks at once; a longer document is read whole.
READ_IDS = 1 << 21
_MANIFEST = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
_ROWS = pa.schema([(ID, pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` one after the other in ``bits`` bits each; the last byte is filled with zeros."""
    if bits == 16:  # the same bytes, without the detour
        return ids.astype("<u2").tobytes()
    each = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(each[:, :bits].reshape(-1), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, "<u2", n).astype("<u4")
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = each
    return np.packbits(wide, axis=1, bitorder="little").reshape(-1).view("<u4")


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class Shard:
    """Random access to one shard."""

    def __init__(self, path: str):
        system, place = _open(path)
        self.file = system.open_input_file(place)
        size = self.file.size()
        if self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"not a token shard: {path}")
        self.bits, self.block_ids, n, self.n_ids, index, offsets = np.frombuffer(self.file.read_at(48, size - 48), "<i8").tolist()
        data = self.file.read_at(17 * n, index)
        self.doc_ids = np.frombuffer(data, "<i8", n)
        self.null = np.frombuffer(data, np.uint8, n, 8 * n).astype(bool)
        self.starts = np.append(np.frombuffer(data, "<i8", n, 9 * n), self.n_ids)
        self.offsets = np.append(np.frombuffer(self.file.read_at(size - 48 - offsets, offsets), "<i8"), index)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to ``stop`` of the shard, read from their blocks alone."""
        if stop <= start:
            return np.empty(0, "<u4")
        a, b = start // self.block_ids, (stop - 1) // self.block_ids + 1
        data = self.file.read_at(int(self.offsets[b] - self.offsets[a]), int(self.offsets[a]))
        parts = []
        for k in range(a, b):
            held = min(self.block_ids, self.n_ids - k * self.block_ids)
            parts.append(unpack_bits(data[self.offsets[k] - self.offsets[a] : self.offsets[k + 1] - self.offsets[a]], self.bits, held))
        return np.concatenate(parts)[start - a * self.block_ids : stop - a * self.block_ids]

    def close(self) -> None:
        self.file.close()


class _Writer:
    def __init__(self, path: str, bits: int):
        self.system, self.place = _open(path)
        self.bits, self.waiting, self.held = bits, [], 0
        self.docs, self.null, self.starts, self.n_ids, self.offsets = [], [], [], 0, []
        self.system.create_dir(self.place.rpartition("/")[0], recursive=True)
        self.temporary = f"{self.place}.{uuid.uuid4().hex}.tmp"
        self.out = self.system.open_output_stream(self.temporary)
        self.out.write(MAGIC)
        self.at = len(MAGIC)

    def _block(self, ids: np.ndarray) -> None:
        self.offsets.append(self.at)
        data = pack_bits(ids, self.bits)
        self.out.write(data)
        self.at += len(data)

    def add(self, docs: list, ids: np.ndarray, at: np.ndarray) -> None:
        self.docs += [0 if d is None else d for d in docs]
        self.null += [d is None for d in docs]
        self.starts.append(self.n_ids + at[:-1])
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK_IDS:
            every = np.concatenate(self.waiting)
            whole = len(every) // BLOCK_IDS * BLOCK_IDS
            for k in range(0, whole, BLOCK_IDS):
                self._block(every[k : k + BLOCK_IDS])
            self.waiting, self.held = [every[whole:]], len(every) - whole

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.waiting))
        index = self.at
        for data in (np.array(self.docs, "<i8"), np.array(self.null, np.uint8), np.concatenate(self.starts).astype("<i8")):
            self.out.write(data.tobytes())
            self.at += data.nbytes
        footer = [self.bits, BLOCK_IDS, len(self.docs), self.n_ids, index, self.at]
        self.out.write(np.array(self.offsets, "<i8").tobytes() + np.array(footer, "<i8").tobytes())
        self.out.close()
        self.system.move(self.temporary, self.place)


def write_token_files(docs: DataFrame, folder: str | None = None, end_id: int = 1, vocabulary: str | None = None, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """Shards in ``folder`` (a new one in the shared folder if none is named); returns their
    manifest: shard, path, n_docs, n_ids.

    A null or empty text is its end id alone. Documents with a null id come first; rows that
    repeat an id lie side by side. An empty table writes nothing.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    source = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(source)
        shard = TaskContext.get().partitionId()
        path = f"{folder}/shard-{shard:06d}.bin"
        out = None
        for b in batches:
            for lo, hi, _, _ in chunks(b.column(1)):
                ids, at = code.encode(b.column(1).slice(lo, hi - lo))
                ids = np.insert(ids, at[1:], np.uint32(end_id))
                out = out or _Writer(path, code.bits)
                out.add(b.column(0).slice(lo, hi - lo).to_pylist(), ids, at + np.arange(len(at)))
        if out:
            out.close()
            yield batch(_MANIFEST, [shard], [path], [len(out.docs)], [out.n_ids])

    # The range partitioner samples its input: ordering the texts, not the ids, keeps the
    # tokenizer out of that pass.
    ordered = texts(docs, id_col, text_col).repartitionByRange(F.col(ID).asc_nulls_first()).sortWithinPartitions(F.col(ID).asc_nulls_first())
    return cut(ordered.mapInArrow(run, "shard bigint, path string, n_docs bigint, n_ids bigint"), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """The documents of the shards: doc_id, start (ids of all documents before it), n_tokens
    and ids (little-endian unsigned 32-bit). The manifest has a row per shard, so the
    driver can add up where each begins."""
    spark = manifest.sparkSession
    rows, base = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["shard"]):
        rows.append((r["path"], base))
        base += r["n_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                shard = Shard(path)
                lo, n = 0, len(shard.doc_ids)
                while lo < n:
                    hi = max(lo + 1, int(np.searchsorted(shard.starts, shard.starts[lo] + READ_IDS, "right")) - 1)
                    at = shard.starts[lo : hi + 1]
                    data = shard.ids(int(at[0]), int(at[-1])).tobytes()
                    places = ((at - at[0]) * 4).astype(np.int32)
                    ids = pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(places.tobytes()), pa.py_buffer(data)])
                    docs = pa.array(shard.doc_ids[lo:hi], pa.int64(), mask=shard.null[lo:hi])
                    yield batch(_ROWS, docs, at[:-1] + first, np.diff(at), ids)
                    lo = hi
                shard.close()

    shards = spark.createDataFrame(rows, "path string, first bigint")
    return shards.repartition(max(1, len(rows))).mapInArrow(run, f"{ID} bigint, start bigint, n_tokens bigint, ids binary")
