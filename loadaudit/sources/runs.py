"""Published runs: tables by bill that are replaced bill by bill.

A run writes each of its tables below ``<root>/<table>/run=<id>/bucket=<n>`` and then, last,
its list of bills below ``<root>/manifest/run=<id>``. A bill's rows are those of the last
run that lists it, so a run replaces exactly its own bills, what a bill no longer has
is gone, and a run that broke off before its list shows nowhere. Bills are dealt to a fixed
number of buckets by hash: the number of files follows the amount of data, not tasks times
bills, and reading one bill opens one bucket of one run."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, StringType, IntegerType

BUCKETS = 64


def bucket_of(bill: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(bill.cast("string")), F.lit(buckets)).cast("int")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt by ``bucket`` before they are written; a bucket too large for a task is
    split, small ones share one."""
    return df.hint("rebalance", F.col("bucket"))


def _write(df: DataFrame, path: str, kind: str) -> None:
    spread(df).write.partitionBy("bucket").format(kind).save(path)


def publish(tables: dict[str, DataFrame], bills: DataFrame, root: str, buckets: int = BUCKETS, kind: str = "parquet") -> str:
    """Writes the tables, each with bill_id, as the new rows of ``bills``; returns the run's id."""
    spark = bills.sparkSession
    run = f"{time.time_ns() // 1000:017d}-{uuid.uuid4().hex[:8]}"
    for name, df in tables.items():
        _write(df.withColumn("bucket", bucket_of(F.col("bill_id"), buckets)), f"{root}/{name}/run={run}", kind)
    layouts = [(name, df.schema.json(), kind) for name, df in tables.items()]
    spark.createDataFrame(layouts, "name string, fields string, kind string").coalesce(1).write.parquet(f"{root}/layout/run={run}")
    listed = bills.select(F.col("bill_id").cast("string").alias("bill_id")).distinct()
    _write(listed.withColumns({"bucket": bucket_of(F.col("bill_id"), buckets), "buckets": F.lit(buckets)}), f"{root}/manifest/run={run}", "parquet")
    return run


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """bill_id, run and buckets of the last run of every bill; partitioned by run and bucket."""
    schema = "bill_id string, buckets int, run string, bucket int"
    return spark.read.schema(schema).parquet(f"{root}/manifest")


def latest(spark: SparkSession, root: str) -> DataFrame:
    return manifest(spark, root).groupBy("bill_id").agg(F.max("run").alias("run"))


def read(spark: SparkSession, root: str, name: str, bill_id=None) -> DataFrame:
    """A table's rows of every bill's last run, or of one bill: then only its run and
    bucket are opened."""
    layout = spark.read.parquet(f"{root}/layout").where(F.col("name") == name).orderBy(F.desc("run")).first()
    if layout is None:
        raise ValueError(f"no run below {root} has a table {name}")
    own = StructType.fromJson(json.loads(layout.fields))
    schema = StructType([f for f in own.fields if f.name not in ("run", "bucket")] + [StructField("run", StringType()), StructField("bucket", IntegerType())])
    rows = spark.read.schema(schema).format(layout.kind).load(f"{root}/{name}")
    bill = F.col("bill_id").cast("string")
    if bill_id is None:
        last = latest(spark, root).withColumnRenamed("bill_id", "_bill")
        kept = rows.join(last, (bill == F.col("_bill")) & (rows["run"] == last["run"]), "left_semi")
    else:
        # One number of buckets a run, so the newest run of a bill tells where its rows are.
        last = manifest(spark, root).where(F.col("bill_id") == str(bill_id)).agg(F.max(F.struct("run", "bucket")).alias("at")).first()["at"]
        if last is None:
            return rows.where(F.lit(False)).drop("run", "bucket")
        kept = rows.where((F.col("run") == last.run) & (F.col("bucket") == last.bucket) & (bill == str(bill_id)))
    return kept.drop("run", "bucket")
