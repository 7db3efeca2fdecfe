"""Ordered neighbours that survive a hot key.

A plain ``lag`` over a key puts the whole key in one task. Here a key's rows are
first split into order buckets; neighbours inside a bucket come from a window on
(key, bucket), and only the two edge rows of each bucket meet in a second, small
window on the key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_buckets(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with a column ``name``, an order bucket for orders without a natural unit, such
    as names: ranges of (keys, order) that Spark measures, so a hot key is cut wherever its
    values lie. Written once, so that every use sees the same ranges."""
    from ..plans.staging import stage

    return stage(df.repartitionByRange(*keys, *order).withColumn(name, F.spark_partition_id()), "ranges")


def neighbours(df: DataFrame, keys: list[str], order: list[str], bucket: Column, carry: list[str]) -> DataFrame:
    """Adds ``prev`` and ``next`` structs of the ``carry`` columns, ordered within
    ``keys``. ``bucket`` must not decrease along ``order``. Null keys form a group."""
    # Whatever dealt the rows before, a key's buckets go to different tasks.
    cut = df.withColumn("_bucket", bucket).repartition(*keys, "_bucket")
    spot = F.struct(*order)
    row = F.struct(*carry)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    local = cut.withColumn("_prev", F.lag(row).over(inside)).withColumn("_next", F.lead(row).over(inside))

    across = Window.partitionBy(*keys).orderBy("_bucket")
    edges = (
        cut.groupBy(*keys, "_bucket")
        .agg(F.min_by(row, spot).alias("_first"), F.max_by(row, spot).alias("_last"))
        .select(
            *[F.col(k).alias(f"_k_{k}") for k in keys],
            F.col("_bucket").alias("_k_bucket"),
            F.lag("_last").over(across).alias("_before"),
            F.lead("_first").over(across).alias("_after"),
        )
        .where(F.col("_before").isNotNull() | F.col("_after").isNotNull())
    )
    same = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_bucket").eqNullSafe(F.col("_k_bucket"))],
    )
    joined = local.join(edges, same, "left")
    return joined.select(
        *df.columns,
        F.coalesce("_prev", "_before").alias("prev"),
        F.coalesce("_next", "_after").alias("next"),
    )


def numbered(df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str = "n") -> DataFrame:
    """Adds the 1-based position of each row within ``keys``. Positions are counted per
    order bucket and shifted by the sizes of the earlier buckets, so a hot key is never
    sorted in one task. ``bucket`` must not decrease along ``order``."""
    cut = df.withColumn("_bucket", bucket).repartition(*keys, "_bucket")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    sizes = cut.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size")).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_k_bucket"), "_size"
    )
    earlier = (
        Window.partitionBy(*[f"_k_{k}" for k in keys])
        .orderBy("_k_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(earlier), F.lit(0))).drop("_size")
    same = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_bucket").eqNullSafe(F.col("_k_bucket"))],
    )
    local = cut.withColumn("_i", F.row_number().over(inside))
    return local.join(starts, same).select(*df.columns, (F.col("_i") + F.col("_start")).alias(name))
