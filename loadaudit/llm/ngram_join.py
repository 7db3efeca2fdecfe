"""Similarity join on word n-grams: MinHash bands find candidates, full n-gram sets decide.

Texts with the same words in the same order are one node, so copies never meet. Bands of the
nodes are counted by value; whatever shares a band value is linked to its least member,
and the components of these stars are the candidate groups, supersets of all pairs that
share a band. A group is cut by hash into blocks of about ``BLOCK`` nodes and every pair of
blocks is one unit of work, however large the group; there the n-gram sets are compared whole
by matrix products. A unit gives each node's number of links and one star per component of
its links, never a list of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import ID, ROW, TEXT, batch, chunks, cut, keyed, on_row
from .graph import components

#: Nodes of a block; a unit of work holds the n-gram sets of two blocks.
BLOCK = 96
#: N-grams of a unit that one matrix product takes.
COLUMNS = 2048
_SIGNED = pa.schema([(ID, pa.int64()), (ROW, pa.int64()), ("w1", pa.int64()), ("w2", pa.int64()), ("n_grams", pa.int64()), ("bands", pa.list_(pa.int64()))])
_SETS = pa.schema([("node", pa.int64()), ("component", pa.int64()), ("copies", pa.int64()), ("block", pa.int32()), ("blocks", pa.int32()), ("grams", pa.binary())])
_LINKS = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])


def bands_for(similarity: float, recall: float, most: int = 256) -> tuple[int, int]:
    """(bands, rows): the most rows per band with which a pair of just that similarity shares
    a band at ``recall``, within ``most`` hash functions."""
    for rows in range(16, 0, -1):
        for bands in range(1, most // rows + 1):
            if 1 - (1 - similarity**rows) ** bands >= recall:
                return bands, rows
    raise ValueError("no such bands")


def _mapper(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = words.constants(2, 7)
        salt, factor = words.constants(bands * rows, 11), words.constants(bands * rows, 13)
        join = words.constants(rows, 17)
        for b in batches:
            for lo, hi, buf, off in chunks(b.column(1)):
                h, at, grams, to = words.of_texts(buf, off, n)
                full = np.flatnonzero(np.diff(to) > 0)
                with np.errstate(over="ignore"):
                    # The sequence of words under two hashes: sums of place-dependent products.
                    place = (np.arange(len(h)) - np.repeat(at[:-1], np.diff(at))).astype(words.U)
                    ids = []
                    for c in (first, second):
                        total = np.concatenate([[words.U(0)], np.cumsum(words.mix((h ^ c) * (place * words.U(2) + words.U(1)) + c * place))])
                        ids.append(words.mix(total[at[1:]] - total[at[:-1]]).view(np.int64))
                    values = np.zeros((len(full), bands), words.U)
                    for k in range(bands * rows if len(full) else 0):
                        least = np.minimum.reduceat((grams ^ salt[k]) * factor[k], to[full])
                        values[:, k // rows] += words.mix(least) * join[k % rows]
                count = np.zeros(hi - lo, np.int32)
                count[full] = bands
                places = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(places, pa.array(values.view(np.int64).reshape(-1)))
                yield batch(_SIGNED, b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), *ids, np.diff(to), lists)

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, off in chunks(b.column(0)):
                _, _, grams, to = words.of_texts(buf, off, n)
                own = [s.tobytes() for s in words.sets(grams, to)]
                yield batch(_SETS, *(b.column(k).slice(lo, hi - lo) for k in range(1, 6)), own)

    return run


def _linked(left: list[np.ndarray], right: list[np.ndarray], over: int, under: int) -> np.ndarray:
    """Whether |A ∩ B| / |A ∪ B| >= over / under, for every A of left and B of right."""
    size = [np.array([len(x) for x in s], np.int64) for s in (left, right)]
    flat = [np.concatenate(s) for s in (left, right)]
    owner = [np.repeat(np.arange(len(s)), n) for s, n in zip((left, right), size, strict=True)]
    shared = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    common = np.zeros((len(left), len(right)), np.float32)
    places = []
    for values, own in zip(flat, owner, strict=True):
        at = np.minimum(np.searchsorted(shared, values), max(len(shared) - 1, 0))
        hit = shared[at] == values if len(shared) else np.zeros(len(values), bool)
        order = np.argsort(at[hit], kind="stable")
        places.append((at[hit][order], own[hit][order]))
    for k in range(0, len(shared), COLUMNS):
        dense = []
        for (at, own), n in zip(places, (len(left), len(right)), strict=True):
            a, b = np.searchsorted(at, [k, k + COLUMNS])
            part = np.zeros((n, min(COLUMNS, len(shared) - k)), np.float32)
            part[own[a:b], at[a:b] - k] = 1
            dense.append(part)
        common += dense[0] @ dense[1].T
    both = common.astype(np.int64)
    return both * under >= (size[0][:, None] + size[1][None, :] - both) * over


def _roots(link: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least node of the component of each node of left and of right."""
    none, before = np.iinfo(np.int64).max, None
    while before is None or (left != before).any():
        before = left
        right = np.minimum(right, np.where(link, left[:, None], none).min(axis=0))
        left = np.minimum(left, np.where(link, right[None, :], none).min(axis=1))
    return left, right


def _unit(rows: list[tuple], i: int, j: int, over: int, under: int) -> list[tuple[int, int, int]]:
    """(node, least node of its component of the links here, links here) of one pair of blocks:
    a spanning forest, so no component of all links falls apart."""
    sides = [[r for r in rows if r[3] == k] for k in ((i, j) if i != j else (i,))]
    left, right = sides[0], sides[-1]
    if not left or not right:
        return []
    link = _linked([r[4] for r in left], [r[4] for r in right], over, under)
    if i == j:
        np.fill_diagonal(link, False)
    node, copies = ([np.array([r[k] for r in s], np.int64) for s in (left, right)] for k in (1, 2))
    root = _roots(link, *node)
    out = []
    for side, m in ((0, link), (1, link.T)) if i != j else ((0, link),):
        for k in np.flatnonzero(m.any(axis=1)):
            out.append((int(node[side][k]), int(root[side][k]), int(copies[1 - side][m[k]].sum())))
    return out


def _verify(over: int, under: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by (component, i, j); units may span batches."""
        now, rows = None, []
        for b in batches:
            out = []
            for component, i, j, node, copies, block, grams in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (component, i, j) != now:
                    out += _unit(rows, *now[1:], over, under) if now else []
                    now, rows = (component, i, j), []
                rows.append((component, node, copies, block, np.frombuffer(grams, np.uint64)))
            if out:
                yield batch(_LINKS, *(list(c) for c in zip(*out, strict=True)))
        if now and (out := _unit(rows, *now[1:], over, under)):
            yield batch(_LINKS, *(list(c) for c in zip(*out, strict=True)))

    return run


def join(docs: DataFrame, n: int = 5, over: int = 4, under: int = 5, recall: float = 0.9995, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """A row per row of ``docs``: doc_id, row hash, class_id, n_links, class (a hash that tells
    classes apart where ids repeat).

    Two documents are linked if the Jaccard similarity of their sets of ``n``-word shingles
    is at least ``over / under``; a pair of just that similarity becomes a candidate with
    probability ``recall``, more similar ones more often. class_id is the least doc_id of all
    that are linked directly or through others, n_links the number of other documents linked
    directly. A text of fewer than ``n`` words has one shingle, of all its words. Documents
    without words (null, empty, blank) link with nothing and are a class of their own. Rows
    that repeat a whole row count as linked documents. Where all ids of equal texts are null
    a hash stands for them in class_id. An empty table gives no rows.
    """
    bands, rows_ = bands_for(over / under, recall)
    own = keyed(docs, id_col, text_col)
    signed = cut(
        own.select(ID, TEXT, ROW).mapInArrow(_mapper(n, bands, rows_), f"{ID} bigint, {ROW} bigint, w1 bigint, w2 bigint, n_grams bigint, bands array<bigint>"),
        "signed",
    )
    nodes = cut(
        signed.filter("n_grams > 0").groupBy("w1", "w2")
        .agg(F.min_by(F.struct(ID, ROW), F.struct(ID, ROW)).alias("one"), F.min(ID).alias("least"), F.count("*").alias("copies"), F.min("bands").alias("bands"))
        .select("w1", "w2", F.col(f"one.{ID}"), F.col(f"one.{ROW}"), F.col("w1").alias("node"), "least", "copies", "bands"),
        "nodes",
    )
    each = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    shared = each.groupBy("band", "value").agg(F.min("node").alias("least"), F.count("*").alias("n")).filter("n > 1")
    stars = each.join(shared, ["band", "value"]).select(F.col("node").alias("a"), F.col("least").alias("b"))
    groups = components(stars)
    size = groups.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = (
        groups.join(size, "root")
        .join(nodes.select(ID, ROW, "node", "copies"), "node")
        .select("node", F.col("root").alias("component"), "copies", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), "blocks", ID, ROW)
    )
    sets = (
        own.dropDuplicates([ID, ROW]).join(members.withColumnsRenamed({ID: "_id", ROW: "_own"}), (F.col(ROW) == F.col("_own")) & F.col(ID).eqNullSafe(F.col("_id")))
        .select(TEXT, "node", "component", "copies", "block", "blocks")
        .mapInArrow(_sets(n), "node bigint, component bigint, copies bigint, block int, blocks int, grams binary")
    )
    spread = sets.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = spread.select("component", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "node", "copies", "block", "grams")
    units = units.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    links = cut(units.mapInArrow(_verify(over, under), "node bigint, other bigint, links bigint"), "links")
    classes = components(links.select(F.col("node").alias("a"), F.col("other").alias("b")))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    of_node = nodes.select("w1", "w2", "node", "least", "copies").join(classes, "node", "left").withColumn("class", F.coalesce("root", "node"))
    named = of_node.groupBy("class").agg(F.coalesce(F.min("least"), F.col("class")).alias("class_id"))
    by_node = (
        of_node.join(counted, "node", "left").join(named, "class")
        .select("w1", "w2", "class", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    return (
        signed.withColumns({"w1": F.when(F.col("n_grams") > 0, F.col("w1")), "w2": F.when(F.col("n_grams") > 0, F.col("w2"))})
        .join(by_node, ["w1", "w2"], "left")
        .select(ID, ROW, F.coalesce("class_id", ID, ROW).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("class", ROW).alias("class"))
    )


def representatives(joined: DataFrame) -> DataFrame:
    """The rows of ``join`` that stay when one document of each class does: that of its least
    id (by the least row hash if rows share it, or if no row has one)."""
    first = joined.groupBy("class").agg(F.min(F.struct(F.coalesce(ID, F.lit((1 << 63) - 1)), ID, ROW)).alias("one"))
    return first.select(F.col(f"one.{ID}").alias(ID), F.col(f"one.{ROW}").alias(ROW))
