"""Decisions: how a ruling on a drain moves its money."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money, text
from .rollup import bill_summary

KINDS = ["APPROVE", "HOLD"]
NOTE_MAX = 500


def _split(decision: Column) -> dict[str, Column]:
    v, r, h = F.col("evidence_verified"), F.col("evidence_review"), F.col("evidence_held")
    nothing = F.lit(0)
    approve, hold = decision == "APPROVE", decision == "HOLD"
    return {
        "verified_tonnes": F.when(approve, v + r + h).otherwise(v).cast(money.TONNES),
        "review_tonnes": F.when(approve | hold, nothing).otherwise(r).cast(money.TONNES),
        "held_tonnes": F.when(approve, nothing).when(hold, r + h).otherwise(h).cast(money.TONNES),
    }


def apply_decision(drains: DataFrame) -> DataFrame:
    """Adds the decided split. It always starts from the evidence split, so a changed
    decision replaces the previous one."""
    return drains.withColumns(_split(F.col("decision")))


def merge_decisions(log: DataFrame, drains: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(latest valid decision per drain, rejected log rows with the reason).

    ``log`` has bill_id, drain_id, decision, note and the ``order`` columns;
    ``drains`` has a verdict once verified."""
    kind = F.upper(F.coalesce("decision", F.lit("")))
    known = drains.select("bill_id", "drain_id", F.col("verdict").alias("_verdict"), F.lit(True).alias("_known"))
    checked = log.join(known, ["bill_id", "drain_id"], "left").withColumn(
        "reject",
        F.when(F.coalesce(F.col("drain_id").cast("string"), F.lit("")) == "", F.lit("drainId is required"))
        .when(~kind.isin(KINDS), F.lit("decision must be one of APPROVE, HOLD"))
        .when(F.col("_known").isNull(), F.lit("no such drain on this bill"))
        .when(F.col("_verdict").isNull(), F.lit("Run verification before deciding.")),
    )
    note = F.nullif(F.substring(text.strip(F.col("note")), 1, NOTE_MAX), F.lit(""))
    latest = (
        checked.where(F.col("reject").isNull())
        .groupBy("bill_id", "drain_id")
        .agg(
            F.max_by(F.struct(kind.alias("decision"), note.alias("note"), *order), F.struct(*order)).alias("_d")
        )
        .select("bill_id", "drain_id", "_d.*")
    )
    rejects = checked.where(F.col("reject").isNotNull()).select(*log.columns, "reject")
    return latest, rejects


def preview_decision(drains: DataFrame, bills: DataFrame, drain_id, kind: str) -> DataFrame:
    """The bill after one hypothetical decision, with the tonnes and rupees it moves.
    It starts from the drain's current row. A null ``drain_id`` means every drain."""
    picked = F.lit(True) if drain_id is None else F.col("drain_id") == F.lit(drain_id)
    current = drains.withColumns(
        {
            "evidence_verified": F.col("verified_tonnes"),
            "evidence_review": F.col("review_tonnes"),
            "evidence_held": F.col("held_tonnes"),
            "_moved": F.when(
                picked,
                F.col("review_tonnes") + (F.col("held_tonnes") if kind == "APPROVE" else F.lit(0)),
            ).otherwise(F.lit(0)),
            "decision": F.when(picked, F.lit(kind)).otherwise(F.col("decision")),
        }
    )
    after = {c: F.when(picked, v).otherwise(F.col(c)) for c, v in _split(F.lit(kind)).items()}
    rows = current.withColumns(after)
    moved = rows.groupBy("bill_id").agg(F.sum("_moved").cast(money.TONNES).alias("moved_tonnes"))
    return (
        bill_summary(rows, bills)
        .join(moved, "bill_id")
        .withColumn("moved_rupees", money.rupees(F.col("moved_tonnes"), F.col("rate_per_tonne")))
    )
