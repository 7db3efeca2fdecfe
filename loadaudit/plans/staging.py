"""Compact intermediate tables. A frame that several outputs share is written once
to the shared folder of ``spark.checkpoint.dir`` and read back, so it is computed
once and a lost executor costs no more than its files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder. Only a local session without one gets its own; elsewhere a
    session that names none is an error."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="loadaudit-")
        spark.conf.set(SETTING, folder)
        return folder
    raise ValueError(f"{SETTING} must name a folder that driver and executors share")


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back with its own schema."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
