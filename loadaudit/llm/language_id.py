"""Language identification by compression.

Each language has a zstandard dictionary of raw content, pieces from hashed places of
the texts of a bounded sample of its labelled documents. A whole text, without its case, is compressed with every dictionary; the
language whose dictionary makes it smallest is predicted, and the prediction is rejected
when the runner-up comes too near. Where a text comes that near, it is compressed once more
at a higher level. One pass over the scan; texts that are judged are never cut.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ID, TEXT, batch, texts

#: Bytes of a dictionary, and the labelled documents of a language that it is taken from, at
#: most: those of the least hashes of their ids.
DICTIONARY_BYTES = 1 << 16
SAMPLE_DOCS = 96
LEVEL, FINE_LEVEL = 6, 12
#: A prediction is accepted if the runner-up's size is this much above the smallest, as a
#: share of it.
MARGIN = 0.02
UNKNOWN = "und"
_RESULT = pa.schema([(ID, pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])


def _piece(data: bytes, share: int) -> bytes:
    """``share`` bytes of ``data`` at most, whole characters from a place that its hash gives."""
    at = zlib.crc32(data) % (max(len(data) - share, 0) + 1)
    return data[at : at + share].decode(errors="ignore").encode()


def dictionaries(docs: DataFrame, learn: Column, lang_col: str = "lang") -> dict[str, bytes]:
    """One dictionary for each language of the documents that ``learn`` holds for. The sample
    is ``SAMPLE_DOCS`` documents a language: the driver gets that and no more."""
    known = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(TEXT).isNotNull()).select(ID, F.col(lang_col).alias("lang"), TEXT)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(ID), ID))
    chosen = known.select(ID, "lang").withColumn("nth", rank).filter(F.col("nth") <= SAMPLE_DOCS)
    rows = known.join(F.broadcast(chosen), [ID, "lang"]).select("lang", "nth", F.encode(F.lower(TEXT), "utf-8").alias("data")).collect()
    parts: dict[str, list[tuple[int, bytes]]] = {}
    for r in rows:
        parts.setdefault(r["lang"], []).append((r["nth"], bytes(r["data"])))
    # The most frequent language first: it wins ties.
    frequent = {r["lang"]: -r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    out = {}
    for lang, own in sorted(parts.items(), key=lambda p: (frequent[p[0]], p[0])):
        # An equal share of every document, so that one long text doesn't make the dictionary.
        share = max(256, DICTIONARY_BYTES // len(own) - 1)
        out[lang] = b"\n".join(_piece(data, share) for _, data in sorted(own))[:DICTIONARY_BYTES]
    return out


def _coder(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    own = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    own.precompute_compress(level=level)
    return zstandard.ZstdCompressor(dict_data=own, level=level, write_content_size=False, write_checksum=False, write_dict_id=False)


def predict(docs: DataFrame, learned: dict[str, bytes], margin: float = MARGIN, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """A row per row of ``docs``: doc_id, lang_pred, score, accepted.

    ``lang_pred`` is the learned language of the smallest output (the most frequent one if
    several tie), ``und`` where the text is null or has no letter, or where nothing was
    learned. ``score`` grows with the margin to the runner-up, from 0.5 at a tie to 1; it is 0
    for ``und`` and 1 if only one language is known. ``accepted`` is false where the margin
    is narrow. Rows that repeat are judged each, alike; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(learned)
        quick, fine = ([_coder(learned[name], level) for name in names] for level in (LEVEL, FINE_LEVEL))

        def measured(data, coders) -> tuple[int, float]:
            size = np.array([len(c.compress(data)) for c in coders], float)
            best = int(size.argmin())
            return best, (np.delete(size, best).min() - size[best]) / size[best] if len(size) > 1 else math.inf

        for b in batches:
            text = pc.fill_null(b.column(1), "")
            letters = pc.match_substring_regex(text, r"\p{L}").to_pylist()
            lang, score, sure = [], [], []
            for x, ok in zip(pc.utf8_lower(text).cast(pa.binary()), letters, strict=True):
                if not ok or not names:
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    sure.append(False)
                    continue
                best, apart = measured(x.as_buffer(), quick)
                if apart < margin:
                    best, apart = measured(x.as_buffer(), fine)
                lang.append(names[best])
                score.append(1 / (1 + math.exp(-min(apart / margin, 50))))
                sure.append(bool(apart >= margin))
            yield batch(_RESULT, b.column(0), lang, score, sure)

    return texts(docs, id_col, text_col).mapInArrow(run, f"{ID} bigint, lang_pred string, score double, accepted boolean")
