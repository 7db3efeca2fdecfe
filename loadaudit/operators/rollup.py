"""From findings to money: trips, drains, bills."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money
from ..plans.wording import AMBER, GREEN, HARD, HOLD, RED, REVIEW, VERIFIED

TRIP_KEYS = ("bill_id", "trip_id")


def verdict(any_hard: Column, any_soft: Column) -> Column:
    """Any hard rule holds, any other finding asks for review."""
    return F.when(any_hard, F.lit(HOLD)).when(any_soft, F.lit(REVIEW)).otherwise(F.lit(VERIFIED))


def trip_verdicts(findings: DataFrame, trips: DataFrame, keys=TRIP_KEYS, rules: Iterable[str] | None = None) -> DataFrame:
    """Trips with verdict and sorted rule lists, from long findings that already
    include each trip's drain findings. The lists hold at most one entry per rule.

    ``rules``: the ids that findings may have, at most 63; another id is an error. Each is then
    a bit of a number, which hash aggregation holds; sets of unknown ids have to be sorted."""
    keys = list(keys)
    known = {r: 1 << i for i, r in enumerate(sorted(set(rules or ())))}
    if len(known) > 63:
        raise ValueError(f"{len(known)} rules do not fit in 63 bits")

    def gathered(severity):
        rule = F.when(F.col("severity") == severity, F.col("rule"))
        if not known:
            return F.array_sort(F.collect_set(rule))
        bit = F
        for r, b in known.items():
            bit = bit.when(rule == r, F.lit(b).cast("bigint"))
        return F.bit_or(bit.when(rule.isNotNull(), F.raise_error(F.concat(F.lit("unknown rule "), rule)).cast("bigint")))

    def listed(found):
        if not known:
            return F.coalesce(found, F.array().cast("array<string>"))
        return F.array_compact(F.array(*[F.when(found.bitwiseAND(F.lit(b).cast("bigint")) != 0, F.lit(r)) for r, b in known.items()]))

    per_trip = findings.groupBy(*keys).agg(gathered(HARD).alias("hard_fails"), gathered("soft").alias("soft_fails"))
    # Sorted by the finest key first: texts are compared by their first bytes.
    joined = trips.join(per_trip, keys[::-1], "left").select(*keys, *[c for c in trips.columns if c not in keys], "hard_fails", "soft_fails")
    joined = joined.withColumns({c: listed(F.col(c)) for c in ("hard_fails", "soft_fails")})
    return joined.withColumn("verdict", verdict(F.size("hard_fails") > 0, F.size("soft_fails") > 0))


def _tonnes_when(condition: Column) -> Column:
    return F.sum(F.when(condition, F.coalesce(F.col("claimed_tonnes"), F.lit(0))).otherwise(F.lit(0))).cast(
        money.TONNES
    )


def drain_colour(trips: DataFrame, keys=("bill_id", "drain_id")) -> DataFrame:
    return trips.groupBy(*keys).agg(_colour().alias("colour"))


def _colour() -> Column:
    worst = F.max(F.when(F.col("verdict") == HOLD, 2).when(F.col("verdict") == REVIEW, 1).otherwise(0))
    return F.when(worst == 2, F.lit(RED)).when(worst == 1, F.lit(AMBER)).otherwise(F.lit(GREEN))


def drain_split(trips: DataFrame, keys=("bill_id", "drain_id")) -> DataFrame:
    """Per drain: trip count, claimed tonnes, the evidence split and its colour."""
    return trips.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trip_count"),
        _tonnes_when(F.lit(True)).alias("claimed_tonnes"),
        _tonnes_when(F.col("verdict") == VERIFIED).alias("evidence_verified"),
        _tonnes_when(F.col("verdict") == REVIEW).alias("evidence_review"),
        _tonnes_when(F.col("verdict") == HOLD).alias("evidence_held"),
        _colour().alias("verdict"),
    )


def bill_summary(drains: DataFrame, bills: DataFrame, billed_claim: bool = True) -> DataFrame:
    """Tonnes and rupees per bill and the count of drains by colour, zeros for a bill
    without drains. With ``billed_claim`` the claim stored on the bill replaces the sum of
    its drains."""

    def total(c):
        return F.coalesce(F.sum(c), F.lit(0)).cast(money.TONNES).alias(c)

    names = ["claimed_tonnes", "verified_tonnes", "review_tonnes", "held_tonnes"]
    sums = drains.groupBy("bill_id").agg(
        *[total(c) for c in names],
        F.count(F.lit(1)).alias("drain_count"),
        *[F.count_if(F.col("verdict") == c).alias(c.lower()) for c in (RED, AMBER, GREEN)],
        F.count_if(F.length("decision") > 0).alias("decided"),
    )
    header = bills.select(
        "bill_id", F.col("rate_per_tonne"), F.col("claimed_tonnes").cast(money.TONNES).alias("_billed")
    )
    joined = header.join(sums, "bill_id", "left")
    counts = ("drain_count", RED.lower(), AMBER.lower(), GREEN.lower(), "decided")
    joined = joined.withColumns({
        **{c: F.coalesce(c, F.lit(0)).cast(money.TONNES) for c in names}, **{c: F.coalesce(c, F.lit(0)) for c in counts},
    })
    if billed_claim:
        joined = joined.withColumn("claimed_tonnes", F.coalesce("_billed", "claimed_tonnes"))
    rupee_columns = {c.replace("tonnes", "rupees"): money.rupees(F.col(c), F.col("rate_per_tonne")) for c in names}
    return joined.drop("_billed").withColumns(rupee_columns)


def ledger_shares(summary: DataFrame) -> DataFrame:
    """Percent of the claim in each state; 0 for an empty claim."""

    def share(c):
        return F.coalesce(F.try_divide(F.col(c) * 100.0, F.col("claimed_tonnes").cast("double")), F.lit(0.0))

    return summary.select(
        "bill_id",
        *[share(f"{s}_tonnes").alias(f"{s}_pct") for s in ("verified", "review", "held")],
    )


def pending_view(drains: DataFrame, bills: DataFrame) -> DataFrame:
    """Drains as shown before their bill is verified: no verdicts, nothing moved, the
    whole claim pending."""
    joined = drains.join(bills.select("bill_id", F.col("status").alias("_status")), "bill_id")
    done = F.col("_status") == VERIFIED
    blank = {
        c: F.when(done, F.col(c)) for c in ("verdict", "decision", "note", "failed_rules") if c in drains.columns
    }
    zero = {
        c: F.when(done, F.col(c)).otherwise(F.lit(0)).cast(money.TONNES)
        for c in ("verified_tonnes", "review_tonnes", "held_tonnes")
    }
    pending = F.when(done, F.lit(0)).otherwise(F.col("claimed_tonnes")).cast(money.TONNES)
    return joined.withColumns({**blank, **zero, "pending_tonnes": pending}).drop("_status")


def drain_order() -> list[Column]:
    """Register order: by whole number, anything else as 0."""
    return [F.coalesce(F.col("drain_id").try_cast("int"), F.lit(0)), F.col("drain_id")]


def register_view(drains: DataFrame) -> DataFrame:
    return drains.orderBy("bill_id", *drain_order())


def trips_view(trips: DataFrame) -> DataFrame:
    return trips.orderBy("bill_id", "drain_id", F.coalesce("trip_no", F.lit("")))


def photos_view(photos: DataFrame) -> DataFrame:
    return photos.orderBy("bill_id", "drain_id", F.coalesce("role", F.lit("")), F.coalesce("s3_key", F.lit("")))
