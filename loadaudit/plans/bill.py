"""Bill mode: every rule over all bills at once.

Evidence is joined once to the row it judges (photo, trip or drain) and each rule
is a condition over that row. Drain findings are kept on the drain and meet the
trips again only as rule ids."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock, geo, money, text
from ..functions.rounding import round_half_even
from ..operators import decisions, findings, photos as reuse, rollup, traces
from ..operators.findings import Case, say
from . import wording
from .staging import stage
from .wording import HARD, SOFT


@dataclass
class Limits:
    soft_band_m: float = wording.SOFT_BAND_M
    speed_kmh: float = wording.SPEED_LIMIT_KMH
    slip_minutes: float = wording.SLIP_TOLERANCE_MIN
    gap_s: float = wording.GAP_LIMIT_S
    reuse_bits: int = wording.REUSE_MAX_BITS


@dataclass
class BillCase:
    """The evidence tables of any number of bills (see ``schemas``)."""

    bills: DataFrame
    drains: DataFrame
    trips: DataFrame
    photos: DataFrame
    slips: DataFrame
    trace_items: DataFrame
    points: DataFrame
    vehicles: DataFrame
    sites: DataFrame

    def only(self, bill_id) -> "BillCase":
        """One bill: a filter on ``bill_id`` that prunes partitions."""
        pick = {
            f.name: getattr(self, f.name).where(F.col("bill_id") == F.lit(bill_id))
            if "bill_id" in getattr(self, f.name).columns
            else getattr(self, f.name)
            for f in fields(self)
        }
        return BillCase(**pick)


# ------------------------------------------------------------------- joins
def bill_sites(bills: DataFrame, sites: DataFrame) -> DataFrame:
    """One dump-site geofence and centre per bill; a bill without a site is left out."""
    return bills.select("bill_id", "site_id").join(sites, "site_id").select("bill_id", "site_id", "geofence", "center")


def trip_evidence(trips: DataFrame, slips: DataFrame, facts: DataFrame, trace_items: DataFrame) -> DataFrame:
    """Trips with their slip (``slip_*``), trace facts and trace item (``item_*``);
    a missing side stays null. Slips and items that know their bill meet its trips only."""
    slip_bill, item_bill = ([c for c in df.columns if c == "bill_id"] for df in (slips, trace_items))
    slip = slips.select(
        *slip_bill,
        F.col("s3_key").alias("slip_key"),
        F.lit(True).alias("slip_found"),
        *[
            F.col(c).alias(f"slip_{c}")
            for c in ("status", "error", "vehicle_no", "net", "time_in", "missing_fields")
            if c in slips.columns
        ],
    )
    item = trace_items.select(
        *item_bill,
        F.col("s3_key").alias("trace_key"),
        F.lit(True).alias("item_found"),
        F.col("status").alias("item_status"),
        F.col("error").alias("item_error"),
    )
    return (
        trips.join(slip, [*slip_bill, "slip_key"], "left")
        .join(facts, ["bill_id", "trace_key"], "left")
        .join(item, [*item_bill, "trace_key"], "left")
    )


def with_capacity(trips: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Adds ``capacity_tonnes``, null for an unregistered vehicle. No broadcast hint:
    the registry may be large, so its measured size decides the join."""
    return trips.join(vehicles.select("vehicle_no", "capacity_tonnes"), "vehicle_no", "left")


def photos_by_drain(photos: DataFrame, drains: DataFrame) -> DataFrame:
    """Photos of known drains; the others only count as originals of copies."""
    return photos.join(drains.select("bill_id", "drain_id"), ["bill_id", "drain_id"], "left_semi")


# ------------------------------------------------------------- photo rules
def drain_distance_m(p: Column, geofence: Column, centreline: Column) -> Column:
    """0 inside the geofence, else metres to the centreline, else to the outer ring;
    infinite with neither."""
    outer = F.get(F.get(geofence, F.lit(0)), F.lit(0))
    line = F.when(F.size(centreline) > 0, centreline).otherwise(outer)
    return F.when(geo.in_geometry(p["lon"], p["lat"], geofence), F.lit(0.0)).otherwise(geo.dist_to_line_m(p, line))


def _name() -> Column:
    return text.basename(F.col("s3_key"))


def _readable() -> Column:
    return F.coalesce(F.col("status"), F.lit("")) != "ERROR"


def error_cases() -> list[Case]:
    return [
        Case("EVIDENCE_ERROR", SOFT, ~_readable(), say("photo_error", _name()),
             {"s3Key": F.col("s3_key"), "error": F.col("error")})
    ]


def r1_cases(limits: Limits) -> list[Case]:
    """Needs ``distance_m``."""
    d = F.col("distance_m")
    located = _readable() & F.coalesce(F.col("has_gps"), F.lit(False))
    seen = {"s3Key": F.col("s3_key"), "distanceM": F.when(d < float("inf"), round_half_even(d, 1)).otherwise(d)}
    metres = F.when(d < float("inf"), text.fixed0(F.when(d < float("inf"), d))).otherwise(F.lit("inf"))
    return [
        Case("R1", SOFT, _readable() & ~F.coalesce(F.col("has_gps"), F.lit(False)), say("r1_no_gps", _name()),
             {"s3Key": F.col("s3_key"), "problems": F.array_join("problems", ",")}),
        Case("R1", HARD, located & (d > limits.soft_band_m), say("r1_far", _name(), metres), seen),
        Case("R1", SOFT, located & (d > 0) & (d <= limits.soft_band_m), say("r1_near", _name(), metres), seen),
    ]


def r2_cases() -> list[Case]:
    """Needs ``taken``, ``window_from`` and ``window_to`` as times."""
    taken, start, end = F.col("taken"), F.col("window_from"), F.col("window_to")
    bounded = taken.isNotNull() & start.isNotNull() & end.isNotNull()
    outside = bounded & ~clock.in_window(taken, start, end)
    return [
        Case("R2", SOFT, _readable() & taken.isNull(), say("r2_undated", _name()), {"s3Key": F.col("s3_key")}),
        Case("R2", HARD, _readable() & outside, say("r2_outside", _name(), clock.date_text(taken["wall_us"])),
             {"s3Key": F.col("s3_key"), "timestamp": F.col("timestamp")}),
    ]


def r3_cases() -> list[Case]:
    """Needs ``original``, ``original_owner`` and ``distance``."""
    return [
        Case("R3", HARD, _readable() & F.col("original").isNotNull(),
             say("r3_reused", _name(), text.basename(F.col("original")),
                 F.coalesce(F.col("original_owner").cast("string"), F.lit("None"))),
             {"s3Key": F.col("s3_key"), "original": F.col("original"), "originalDrainId": F.col("original_owner"),
              "hammingDistance": F.col("distance")})
    ]


def r4_cases() -> list[Case]:
    v = F.col("vision")
    ok = F.coalesce(v["ok"], F.lit(False))
    load = _readable() & ok & (F.col("role") == "load")
    key = {"s3Key": F.col("s3_key")}
    noted = {**key, "notes": v["notes"]}
    return [
        Case("R4", SOFT, _readable() & ~ok, say("r4_unassessed", _name()), noted),
        Case("R4", HARD, load & (v["load_type"] == "debris"), say("r4_debris", _name()),
             {**key, "confidence": v["confidence"], "notes": v["notes"]}),
        Case("R4", SOFT, load & (v["load_type"] == "unclear"), say("r4_unclear", _name()), noted),
        Case("R4", SOFT, _readable() & ok & (F.col("role") == "after") & (v["cleared"] == F.lit(False)),
             say("r4_not_cleared", _name()), noted),
    ]


def located_photos(photos: DataFrame, drains: DataFrame) -> DataFrame:
    """Photos of known drains with ``distance_m`` to their drain."""
    shapes = drains.select("bill_id", "drain_id", F.col("geofence").alias("_fence"), F.col("centreline").alias("_line"))
    here = geo.pt(F.col("lon"), F.col("lat"))
    distance = F.when(F.col("has_gps"), drain_distance_m(here, F.col("_fence"), F.col("_line")))
    return photos.join(shapes, ["bill_id", "drain_id"]).withColumn("distance_m", distance).drop("_fence", "_line")


def dated_photos(photos: DataFrame, bills: DataFrame) -> DataFrame:
    """Photos with their capture time and their bill's work window as times."""
    window = bills.select(
        "bill_id",
        clock.iso_parts(F.col("window_start")).alias("window_from"),
        clock.iso_parts(F.col("window_end")).alias("window_to"),
    )
    return photos.withColumn("taken", clock.iso_parts(F.col("timestamp").cast("string"))).join(window, "bill_id", "left")


def reused_photos(photos: DataFrame, limits: Limits, **tuning) -> DataFrame:
    """Every photo, with its first original when it is a copy."""
    originals = reuse.first_originals(photos, max_bits=limits.reuse_bits, **tuning)
    return photos.join(originals, ["bill_id", "s3_key"], "left")


def photo_findings(case: BillCase, limits: Limits | None = None) -> tuple[DataFrame, list[Case]]:
    """Photos of known drains with everything R1 to R4 need, and the cases."""
    limits = limits or Limits()
    judged = located_photos(dated_photos(reused_photos(case.photos, limits), case.bills), case.drains)
    cases = error_cases() + r1_cases(limits) + r2_cases() + r3_cases() + r4_cases()
    return judged, cases


# ------------------------------------------------------------- drain rules
def volume_cases() -> list[Case]:
    """Needs ``claimed`` and the drain's dimensions."""
    computed = F.col("length_m") * F.col("width_m") * F.col("depth_m") * (wording.SILT_DENSITY * wording.HEADROOM)
    ceiling = F.coalesce(F.col("plausible_max_tonnes"), computed)
    claimed = F.col("claimed").cast("double")
    return [
        Case("R10", SOFT, claimed > ceiling, say("r10_over", text.fixed0(claimed), text.fixed0(ceiling)),
             {"claimedTonnes": F.col("claimed"), "plausibleMaxTonnes": round_half_even(ceiling, 1)})
    ]


def claimed_drains(drains: DataFrame, trips: DataFrame) -> DataFrame:
    """Drains with the tonnes their trips claim (0 without trips)."""
    sums = trips.groupBy("bill_id", "drain_id").agg(F.sum("claimed_tonnes").cast(money.TONNES).alias("claimed"))
    return drains.join(sums, ["bill_id", "drain_id"], "left").withColumn(
        "claimed", F.coalesce("claimed", F.lit(0)).cast(money.TONNES)
    )


def photo_gap_cases() -> list[Case]:
    """Needs ``n_photos``."""
    return [Case("PHOTOS_MISSING", SOFT, F.coalesce(F.col("n_photos"), F.lit(0)) == 0, "photos_missing")]


def counted_drains(drains: DataFrame, photos: DataFrame) -> DataFrame:
    counts = photos.groupBy("bill_id", "drain_id").agg(F.count(F.lit(1)).alias("n_photos"))
    return drains.join(counts, ["bill_id", "drain_id"], "left")


# -------------------------------------------------------------- trip rules
def _has_points() -> Column:
    return F.coalesce(F.col("n_points"), F.lit(0)) > 0


def trace_cases(limits: Limits) -> list[Case]:
    lost = ~_has_points()
    item = F.coalesce(F.col("item_found"), F.lit(False))
    failed = item & (F.col("item_status") == "ERROR")
    key = {"traceKey": F.col("trace_key")}
    last = F.col("last_point")
    return [
        Case("EVIDENCE_ERROR", SOFT, lost & F.coalesce(failed, F.lit(False)), "trace_error",
             {**key, "error": F.col("item_error")}),
        Case("TRACE_MISSING", SOFT, lost & ~item, "trace_missing", key),
        Case("TRACE_MISSING", SOFT, lost & item & ~F.coalesce(failed, F.lit(False)), "trace_unreadable", key),
        Case("R5", HARD, _has_points() & ~F.coalesce(F.col("entered"), F.lit(False)), "r5_never",
             {**key, "lastPoint": F.format_string("[%s, %s]", last["lon"].cast("string"), last["lat"].cast("string"))}),
        Case("GPS_GAP", SOFT, _has_points() & (F.col("max_gap_s") > limits.gap_s),
             say("gap", text.fixed0(F.col("max_gap_s") / 60)),
             {**key, "gapSeconds": text.fixed0(F.col("max_gap_s"))}),
    ]


def r6_cases(limits: Limits) -> list[Case]:
    """Needs the ``before`` and ``after`` structs of ``truck_legs``."""
    cases = []
    for side in ("before", "after"):
        leg = F.col(side)
        overlap = leg["minutes"] <= 0
        km = text.fixed(leg["km"], 1)
        speed = text.fixed0(F.when(~overlap, leg["kmh"]))
        other = leg["other"].cast("string")
        message = F.when(overlap, say("r6_overlap", other, km)).otherwise(
            say("r6_speed", other, text.fixed0(leg["minutes"]), km, speed)
        )
        evidence = {
            "otherTripId": leg["other"], "minutes": round_half_even(leg["minutes"], 1), "km": round_half_even(leg["km"], 1),
            "overlapping": F.when(overlap, F.lit("true")), "impliedSpeedKmh": speed,
        }
        cases.append(Case("R6", HARD, leg["kmh"] > limits.speed_kmh, message, evidence))
    return cases


def _slip_ok() -> Column:
    return F.coalesce(F.col("slip_found"), F.lit(False)) & (F.coalesce(F.col("slip_status"), F.lit("")) != "ERROR")


def slip_gap_cases() -> list[Case]:
    found = F.coalesce(F.col("slip_found"), F.lit(False))
    key = {"slipKey": F.col("slip_key")}
    return [
        Case("SLIP_MISSING", SOFT, ~found, "slip_missing", key),
        Case("EVIDENCE_ERROR", SOFT, found & (F.coalesce(F.col("slip_status"), F.lit("")) == "ERROR"), "slip_error",
             {**key, "error": F.col("slip_error")}),
    ]


def r7_cases() -> list[Case]:
    net, capacity = F.col("slip_net"), F.col("capacity_tonnes")
    key = {"slipKey": F.col("slip_key")}
    return [
        Case("R7", SOFT, _slip_ok() & net.isNull(), "r7_unread",
             {**key, "missing": F.array_join("slip_missing_fields", ",")}),
        Case("R7", HARD, _slip_ok() & (net > capacity), say("r7_over", text.fixed(net, 2), text.fixed0(capacity)),
             {**key, "net": net, "capacityTonnes": capacity}),
    ]


def with_slip_delta(trips: DataFrame) -> DataFrame:
    """Adds ``delta_min``: the slip's time-in against the arrival, in minutes."""
    return trips.withColumn("delta_min", clock.minutes_apart(F.col("slip_time_in"), F.col("arrival.wall_us")))


def r8_message(time_in: Column, delta: Column, arrival: Column, entered: Column, departure: Column) -> Column:
    """Names the GPS time that was used; a last fix is never called an arrival."""
    minutes = text.fixed0(F.abs(delta))
    at = clock.hhmm_text(arrival["wall_us"])
    before_after = F.when(delta < 0, F.lit("before")).otherwise(F.lit("after"))
    after_before = F.when(delta < 0, F.lit("after")).otherwise(F.lit("before"))
    lead = clock.minutes_apart(time_in, departure["wall_us"])
    quoted = F.when(
        lead < 0, say("r8_lead", text.fixed0(-lead), clock.hhmm_text(departure["wall_us"]))
    ).otherwise(F.lit(""))
    return F.when(entered, say("r8_entered", time_in, minutes, before_after, at)).otherwise(
        F.concat(say("r8_start", time_in), quoted, say("r8_last_fix", at, minutes, after_before))
    )


def r8_cases(limits: Limits) -> list[Case]:
    """Needs ``delta_min``."""
    time_in, delta = F.col("slip_time_in"), F.col("delta_min")
    entered = F.coalesce(F.col("entered"), F.lit(False))
    key = {"slipKey": F.col("slip_key")}
    return [
        Case("R8", SOFT, _slip_ok() & time_in.isNull(), "r8_unread", key),
        Case("R8", SOFT, _slip_ok() & time_in.isNotNull() & delta.isNull(), "r8_no_arrival", key),
        Case("R8", HARD, _slip_ok() & (F.abs(delta) > limits.slip_minutes),
             r8_message(time_in, delta, F.col("arrival"), entered, F.col("departure")),
             {**key, "timeIn": time_in, "arrival": clock.iso_text(F.col("arrival")),
              "arrivalKind": F.when(entered, F.lit("dumpsite")).otherwise(F.lit("lastFix")),
              "departure": clock.iso_text(F.col("departure")), "minutesEarly": round_half_even(-delta, 1)}),
    ]


def r9_cases() -> list[Case]:
    slip, trip = F.col("slip_vehicle_no").cast("string"), F.col("vehicle_no").cast("string")
    key = {"slipKey": F.col("slip_key")}
    return [
        Case("R9", SOFT, _slip_ok() & slip.isNull(), "r9_unread", key),
        Case("R9", HARD, _slip_ok() & (F.length(trip) > 0) & (slip != trip), say("r9_differs", slip, trip),
             {**key, "slipVehicleNo": slip, "tripVehicleNo": trip}),
    ]


def trip_cases(limits: Limits) -> list[Case]:
    return trace_cases(limits) + r6_cases(limits) + slip_gap_cases() + r7_cases() + r8_cases(limits) + r9_cases()


# ------------------------------------------------------------------- audit
_DRAIN_KEYS = ["bill_id", "drain_id"]


class Audit:
    """All rules over a ``BillCase``. The frames that every output shares (one row per
    trace, leg, photo or drain) are staged on first use, which runs a job; the rest is lazy."""

    def __init__(self, case: BillCase, limits: Limits | None = None, staged: bool = True):
        self.case, self.limits = case, limits or Limits()
        self._stage = stage if staged else lambda df, name: df

    @cached_property
    def facts(self) -> DataFrame:
        """Trace facts against each bill's own dump site."""
        fences = bill_sites(self.case.bills, self.case.sites)
        placed = traces.points_in_site(traces.with_times(self.case.points), fences)
        return self._stage(traces.trace_facts(placed), "trace-facts")

    @cached_property
    def legs(self) -> DataFrame:
        """Per trip with a timed trace: the truck's legs before and after it."""
        driven = self.case.trips.select("bill_id", "trip_id", "vehicle_no", "trace_key").join(
            self.facts, ["bill_id", "trace_key"]
        )
        legs = traces.truck_legs(driven)
        return self._stage(legs.select("bill_id", F.col("leg_id").alias("trip_id"), "before", "after"), "truck-legs")

    @cached_property
    def judged_trips(self) -> DataFrame:
        case = self.case
        trips = with_capacity(trip_evidence(case.trips, case.slips, self.facts, case.trace_items), case.vehicles)
        return with_slip_delta(trips.join(self.legs, ["bill_id", "trip_id"], "left"))

    @cached_property
    def _trip_cases(self) -> list[Case]:
        return trip_cases(self.limits)

    @cached_property
    def _photos(self) -> tuple[DataFrame, list[Case]]:
        """Photos with all that their rules ask for, the search for originals included: made
        once, for findings and rule ids."""
        photos, cases = photo_findings(self.case, self.limits)
        return self._stage(photos, "judged-photos"), cases

    @cached_property
    def drain_findings(self) -> DataFrame:
        photos, cases = self._photos
        keep = [*_DRAIN_KEYS, "s3_key"]
        by_photo = findings.explode_findings(photos, cases, keep)
        gaps = findings.explode_findings(counted_drains(self.case.drains, self.case.photos), photo_gap_cases(), _DRAIN_KEYS)
        volume = findings.explode_findings(claimed_drains(self.case.drains, self.case.trips), volume_cases(), _DRAIN_KEYS)
        return findings.union_findings(by_photo, gaps, volume)

    @cached_property
    def drain_rules(self) -> DataFrame:
        """Rule ids per drain, from conditions alone: no sentence is built."""
        photos, cases = self._photos

        def ids(df, cases):
            return df.select(
                *_DRAIN_KEYS, findings.rule_ids(cases, HARD).alias("hard"), findings.rule_ids(cases, SOFT).alias("soft")
            )

        drains = counted_drains(claimed_drains(self.case.drains, self.case.trips), self.case.photos)
        both = ids(photos, cases).unionByName(ids(drains, photo_gap_cases() + volume_cases()))
        # Rule ids are few, so they are counted as flags: a hash aggregation, no lists in the shuffle.
        flags = {
            (rule, severity): F.max(F.array_contains(severity, rule)).alias(f"{severity}_{rule}")
            for rule, severity in sorted({(c.rule, c.severity) for c in cases + photo_gap_cases() + volume_cases()})
        }
        per_drain = both.groupBy(*_DRAIN_KEYS).agg(*flags.values())

        def listed(severity):
            names = [r for r, s in flags if s == severity]
            return F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"{severity}_{r}"), F.lit(r)) for r in names])))

        rules = per_drain.select(*_DRAIN_KEYS, listed(HARD).alias("drain_hard"), listed(SOFT).alias("drain_soft"))
        return self._stage(rules, "drain-rules")

    @cached_property
    def trip_findings(self) -> DataFrame:
        """The trips' own findings; their drain's findings stay in ``drain_findings``."""
        known = photos_by_drain(self.judged_trips, self.case.drains)
        return findings.explode_findings(known, self._trip_cases, [*_DRAIN_KEYS, "trip_id"])

    @cached_property
    def findings(self) -> DataFrame:
        return findings.union_findings(self.drain_findings, self.trip_findings)

    @cached_property
    def trips(self) -> DataFrame:
        """Verdict and rule lists per trip, its drain's rules included."""
        joined = self.judged_trips.join(self.drain_rules, _DRAIN_KEYS)

        def merged(severity, drain_column):
            own = findings.rule_ids(self._trip_cases, severity)
            return F.array_sort(F.array_union(own, F.col(drain_column)))

        named = joined.select(
            *_DRAIN_KEYS,
            "trip_id",
            "trip_no",
            "vehicle_no",
            F.coalesce("claimed_tonnes", F.lit(0)).cast(money.TONNES).alias("claimed_tonnes"),
            merged(HARD, "drain_hard").alias("hard_fails"),
            merged(SOFT, "drain_soft").alias("soft_fails"),
            F.concat("drain_hard", "drain_soft").alias("from_drain_evidence"),
            # From the conditions, not the lists: a roll-up that ignores the lists never builds them.
            rollup.verdict(
                findings.any_case(self._trip_cases, HARD) | (F.size("drain_hard") > 0),
                findings.any_case(self._trip_cases, SOFT) | (F.size("drain_soft") > 0),
            ).alias("verdict"),
        )
        return named

    @cached_property
    def drains(self) -> DataFrame:
        split = rollup.drain_split(self.trips)
        registered = self.case.drains.select(*_DRAIN_KEYS, "name", "decision", "note")
        rules = self.drain_rules.select(
            *_DRAIN_KEYS, F.array_sort(F.array_union("drain_hard", "drain_soft")).alias("failed_rules")
        )
        joined = registered.join(rules, _DRAIN_KEYS, "left").join(split, _DRAIN_KEYS, "left")
        sums = ("claimed_tonnes", "evidence_verified", "evidence_review", "evidence_held")
        whole = joined.withColumns(
            {
                **{c: F.coalesce(F.col(c), F.lit(0)).cast(money.TONNES) for c in sums},
                "trip_count": F.coalesce("trip_count", F.lit(0)),
                "verdict": F.coalesce("verdict", F.lit(wording.GREEN)),
                "failed_rules": F.coalesce("failed_rules", F.array().cast("array<string>")),
            }
        )
        return decisions.apply_decision(whole)

    @cached_property
    def summary(self) -> DataFrame:
        return rollup.bill_summary(self.drains, self.case.bills, billed_claim=False)

    @cached_property
    def gaps(self) -> DataFrame:
        return missing_evidence(self.case)


def evaluate(case: BillCase, limits: Limits | None = None, staged: bool = True) -> Audit:
    return Audit(case, limits, staged)


# ----------------------------------------------------------------- missing
def missing_rows(case: BillCase) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(trips without a slip, trips without a trace item, drains without photos)."""
    def without(table, key):
        own = [c for c in table.columns if c == "bill_id"]
        return case.trips.join(table.select(*own, F.col("s3_key").alias(key)), [*own, key], "left_anti")

    return (
        without(case.slips, "slip_key"),
        without(case.trace_items, "trace_key"),
        case.drains.join(case.photos, _DRAIN_KEYS, "left_anti"),
    )


def missing_evidence(case: BillCase, unreadable_traces: DataFrame | None = None) -> DataFrame:
    """Five counts per bill of what never arrived or could not be read."""
    absent = ("trips_without_slip", "trips_without_trace", "drains_without_photos")
    gaps_by_kind = [
        df.select("bill_id", F.lit(name).alias("gap")) for df, name in zip(missing_rows(case), absent)
    ]
    failed = F.col("status") == "ERROR"
    trip_slips = case.trips.select("bill_id", F.col("slip_key").alias("s3_key")).distinct()
    trip_items = case.trips.select("bill_id", F.col("trace_key").alias("s3_key")).distinct()

    def in_error(keys, table):
        own = [c for c in table.columns if c == "bill_id"]
        return keys.join(table.where(failed).select(*own, "s3_key"), [*own, "s3_key"]).select("bill_id")

    errors = (
        case.photos.where(failed)
        .select("bill_id")
        .unionByName(in_error(trip_slips, case.slips))
        .unionByName(in_error(trip_items, case.trace_items))
        .select("bill_id", F.lit("evidence_errors").alias("gap"))
    )
    gaps = findings.union_findings(*gaps_by_kind, errors)
    if unreadable_traces is not None:
        gaps = gaps.unionByName(unreadable_traces.select("bill_id", F.lit("unreadable_traces").alias("gap")))
    names = ["trips_without_slip", "trips_without_trace", "unreadable_traces", "evidence_errors", "drains_without_photos"]
    counts = gaps.groupBy("bill_id").agg(*[F.count_if(F.col("gap") == n).alias(n) for n in names])
    return case.bills.select("bill_id").join(counts, "bill_id", "left").select(
        "bill_id", *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names]
    )
