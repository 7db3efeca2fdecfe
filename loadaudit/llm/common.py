"""Helpers of the training-data operators: row identity, tables that cut lineage, and
whole texts as numpy arrays.

Every operator selects the id and text columns it is told to use first, so other columns
of any name pass by untouched. A row is identified by its id and the hash of its text
(``ROW``): rows with a null id, rows that repeat an id with another text and rows repeated
whole all get a defined result, the last ones the same result each.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
ID, TEXT, ROW = "doc_id", "text", "_row"
#: Bytes of text that numpy works on at once. One longer text is a chunk by itself.
CHUNK = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a local session without one gets its own."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="loadaudit-llm-")
        spark.conf.set(SETTING, folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: computed once, and a lost
    executor costs no more than its running tasks."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """``doc_id`` and ``text`` alone."""
    return docs.select(F.col(id_col).alias(ID), F.col(text_col).alias(TEXT))


def keyed(docs: DataFrame, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """``doc_id``, ``text`` and the row hash."""
    return texts(docs, id_col, text_col).withColumn(ROW, F.xxhash64(TEXT, ID))


def on_row(left: DataFrame, right: DataFrame):
    """The join condition of two frames that carry ``doc_id`` and the row hash."""
    return left[ID].eqNullSafe(right[ID]) & (left[ROW] == right[ROW])


def unused(names: list[str], name: str) -> str:
    """``name``, or with as many underscores before it as no column of ``names`` has."""
    while name.lower() in {n.lower() for n in names}:
        name = f"_{name}"
    return name


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str = ID, text_col: str = TEXT, once: bool = False) -> DataFrame:
    """Rows of ``docs``, all columns, whose id and row hash are in ``kept``; column names may
    be any. ``once``: of rows that share both, the one stays whose whole row has
    the least hash."""
    quoted = [f"`{c.replace('`', '``')}`" for c in docs.columns]
    row, whole, own, mark = (unused(docs.columns, n) for n in ("row_hash", "whole_row", "kept_id", "kept_hash"))
    one = docs.select(F.struct(*quoted).alias(whole), F.col(id_col).alias(own), F.xxhash64(text_col, id_col).alias(row))
    right = kept.select(F.col(ID).alias("_right"), F.col(ROW).alias(mark))
    out = one.join(right, one[own].eqNullSafe(right["_right"]) & (one[row] == right[mark]), "left_semi")
    if once:
        out = out.withColumn(mark, F.xxhash64(F.to_json(whole))).groupBy(own, row).agg(F.min_by(whole, mark).alias(whole))
    return out.select(*[F.col(whole)[c].alias(c) for c in docs.columns])


#: A key is frequent with more than one row in so many; so there are at most so many of them.
FREQUENT = 5000


def join_counted(rows: DataFrame, counted: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``counted``, which has one row a key and in ``n`` how many of
    ``rows`` have it. ``rows`` is a stored table.

    Frequent keys, at most ``FREQUENT`` whatever the size, are broadcast, so their rows stay
    where they are read; all others meet by a shuffle, in which no key is large.
    """
    counted = cut(counted, "counted")
    bound = rows.count() / FREQUENT
    often = counted.filter(F.col("n") > bound)
    hot = rows.join(F.broadcast(often), key)
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(counted.filter(F.col("n") <= bound), key)
    return hot.unionByName(rest).drop("n")


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) over a string column; a
    null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return
    _, at, data = column.buffers()
    off = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1))
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, as ``--py-files`` would, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="loadaudit-ship-"), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(package.rglob("*.py")):
            out.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
