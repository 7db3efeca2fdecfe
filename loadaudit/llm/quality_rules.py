"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio.

All of it is DataFrame functions. Words, word pairs and the last three characters of words
are hashed into ``BUCKETS`` buckets.
One pass over all documents counts the buckets of the raw corpus and of its trusted part; the
table of weights has a fixed size, and a second pass adds up each document's weights. A
document's score is the mean weight of its n-grams, log p(trusted) - log p(raw), and it stays
if that reaches a fixed threshold. Weights are whole millionths, so sums don't depend on
their order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ID, TEXT, texts

BUCKETS = 1 << 14
#: Documents labelled good that make the trusted multinomial, at most; those of the least
#: hashes of their ids. The raw counts cover every document.
TRUSTED_DOCS = 20_000
#: A document stays from this mean log ratio on.
THRESHOLD = -0.12
_SPACE, _NOT_SPACE = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
_SPACES, _SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
_UNIT = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE), "")


def hashed(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id and text) with ``words``, the hashes of the words (``h1``), and those of
    the 2, 4 and 8 words from each word on; at the end of a text these mean nothing."""
    out = docs.withColumn("words", words(F.col(TEXT))).withColumn("h1", F.transform("words", lambda x: F.xxhash64(x)))
    for size in (1, 2, 4):
        own = F.col(f"h{size}")
        out = out.withColumn(f"h{2 * size}", F.zip_with(own, F.slice(own, F.lit(1 + size), F.size(own)), lambda a, b: F.xxhash64(a, b)))
    return out


def _whole(size: int) -> Column:
    """The hashes of ``size`` words that lie whole in the text."""
    return F.slice(F.col(f"h{size}"), F.lit(1), F.greatest(F.size("h1") - (size - 1), F.lit(0)))


def with_repeated_words(docs: DataFrame) -> DataFrame:
    """``docs``, hashed, and ``n_repeat_words``: words inside windows of 8 words that occur
    twice or more in the text.

    A set of hashes tells the texts without a repeat; the others sort their windows' 64-bit
    hashes and compare neighbours."""
    size = 8
    m = F.size("words") - (size - 1)
    windows = F.array_sort(F.transform(_whole(size), lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    out = docs.withColumn("_windows", F.when((m > 1) & (F.size(F.array_distinct(_whole(size))) < m), windows))
    none, own = F.array(F.lit(None).cast("struct<x:bigint,i:int>")), F.col("_windows")
    beside = F.arrays_zip(own.alias("w"), F.concat(none, own).alias("a"), F.concat(F.slice(own, F.lit(2), F.size(own)), none).alias("b"))
    found = F.filter(beside, lambda z: z["w"]["x"].eqNullSafe(z["a"]["x"]) | z["w"]["x"].eqNullSafe(z["b"]["x"]))
    at = F.array_sort(F.transform(F.filter(found, lambda z: z["w"].isNotNull()), lambda z: z["w"]["i"]))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate(at, start, lambda s, i: F.struct((i + size).alias("end"), (s["n"] + i + size - F.greatest(i, s["end"])).alias("n")), lambda s: s["n"])
    return out.withColumn("n_repeat_words", F.when(own.isNull(), 0).otherwise(covered).cast("bigint"))


def base(docs: DataFrame) -> DataFrame:
    """``docs``, hashed, and its base counts."""
    text = F.coalesce(F.col(TEXT), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(_NOT_SPACE))
    counted = docs.withColumns({
        "n_words": F.size("words").cast("bigint"),
        "word_chars": F.length(F.translate(text, _SPACES, "")).cast("bigint"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("bigint"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
    })
    return with_repeated_words(counted).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _ends() -> Column:
    return F.transform("words", lambda x: F.xxhash64(F.lit(0), F.right(x, F.lit(3))))


def _bucket(value: Column) -> Column:
    return F.pmod(value, F.lit(BUCKETS)).cast("int")


def trusted_ids(labels: DataFrame, bound: int = TRUSTED_DOCS) -> DataFrame:
    """Ids with no label but good, ``bound`` at most."""
    good = labels.filter("doc_id is not null").groupBy(ID).agg(F.min("quality").alias("worst")).filter("worst = 1").select(ID)
    return good.orderBy(F.xxhash64(ID), ID).limit(bound)


def bucket_counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """bucket, raw, good: how often the n-grams of all and of the trusted documents fall into
    each bucket. ``trusted`` has a bounded number of ids."""
    marked = hashed(texts(docs)).select(ID, F.concat("h1", _whole(2), _ends()).alias("grams")).join(F.broadcast(trusted.withColumn("good", F.lit(1))), ID, "left")
    # An inner explode would be preceded by a filter that makes the n-grams a second time.
    grams = marked.select("good", F.explode_outer("grams").alias("gram")).filter("gram is not null")
    return grams.withColumn("bucket", _bucket(F.col("gram"))).groupBy("bucket").agg(F.count("*").alias("raw"), F.count("good").alias("good"))


def weights(counts: list) -> list[int]:
    """Millionths of log p(good) - log p(raw) by bucket, one added to each count."""
    raw, good = [1] * BUCKETS, [1] * BUCKETS
    for r in counts:
        raw[r["bucket"]] += r["raw"]
        good[r["bucket"]] += r["good"]
    shift = math.log(sum(raw)) - math.log(sum(good))
    return [round(_UNIT * (math.log(g) - math.log(r) + shift)) for g, r in zip(good, raw, strict=True)]


def scored(docs: DataFrame, table: list[int]) -> DataFrame:
    """``docs``, hashed, and ``score``, the mean weight of its n-grams; 0 without words."""
    by_bucket = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")
    total = F.lit(0).cast("bigint")
    for grams in (F.col("h1"), _whole(2), _ends()):
        total = total + F.aggregate(grams, F.lit(0).cast("bigint"), lambda s, x: s + F.get(by_bucket, _bucket(x)))
    n = F.size("words")
    return docs.withColumn("score", F.when(n > 0, total / (3 * n - 1) / _UNIT).otherwise(F.lit(0.0)))


def judged(docs: DataFrame, own: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """``docs`` (doc_id, text and whatever else) with counts, score and kept; ``own`` is its
    doc_id and text."""
    table = weights(bucket_counts(own, trusted_ids(labels)).collect())
    out = scored(base(hashed(docs)), table)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, score.

    A null text has no words, so it fails the base rules like an empty one. Rows that repeat
    are judged each, alike; a null id can't be trusted but is judged. Without trusted
    documents every weight is near 0 and only the base rules decide. An empty table gives
    no rows. The driver gets the bucket counts, ``BUCKETS`` rows at most.
    """
    own = texts(docs, id_col, text_col)
    return judged(own, own, labels, threshold).select(ID, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """The rows of ``docs``, all columns, that ``judge`` keeps."""
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(id_col).alias(ID), F.col(text_col).alias(TEXT))
    out = judged(packed, texts(docs, id_col, text_col), labels, threshold)
    # A plain filter would be pushed below the counts and make each of them several times.
    one = out.select(F.explode_outer(F.when(F.col("kept"), F.array("_doc"))).alias("_doc"))
    return one.filter("_doc is not null").select("_doc.*")
