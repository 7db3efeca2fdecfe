"""From raw documents to packed training sequences, in five stages.

``STAGES`` lists (name, function). Each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the documents of the next stage.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadaudit.llm import decontaminate, ngram_join, packing, quality_rules, suffix_dedup
from loadaudit.llm.common import cut, keep_rows, ship, table


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each class of near duplicates; of rows that repeat a
    whole row, one."""
    ship(spark)
    return keep_rows(docs, ngram_join.representatives(ngram_join.join(docs)), once=True)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that occur twice or more. A document that had
    nothing else stays with an empty text."""
    ship(spark)
    out = suffix_dedup.cleaned(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    ship(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids, one row each."""
    ship(spark)
    out = packing.pack(docs)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket", "ids")


STAGES = [
    ("quality_rules", by_quality),
    ("ngram_join", one_of_each),
    ("suffix_dedup", without_repeats),
    ("decontaminate", without_benchmark),
    ("packing", packed),
]

#: The tokenizer of the last stage can't be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
