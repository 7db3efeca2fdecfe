"""Case mode: every check has an outcome. Prerequisites come first, so what is
missing is NOT_EVALUATED and never reads as passed."""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock, geo, text
from ..functions.binding import let
from ..functions.rounding import round_half_even
from ..operators import photos as reuse, traces
from ..operators.findings import evidence_map
from ..operators.ordered import numbered
from . import case_wording as words
from . import wording
from .bill import r8_message
from .case_wording import CONSISTENT, FAIL, INCONCLUSIVE, NEED, NOT_EVALUATED, PASS, REVIEW
from .staging import stage
from .wording import HARD, SOFT

TRACE_KEYS = ("case_id", "evidence_id")
_SUBJECT = ["case_id", "evidence_id", "filename", "grp", "role", "pos"]


@dataclass
class CaseLimits:
    speed_kmh: float = wording.SPEED_LIMIT_KMH
    slip_minutes: float = wording.SLIP_TOLERANCE_MIN
    gap_s: float = wording.GAP_LIMIT_S
    reuse_bits: int = wording.REUSE_MAX_BITS


@dataclass
class CaseTables:
    """READY evidence and details of any number of cases (see ``schemas``)."""

    cases: DataFrame
    photos: DataFrame
    slips: DataFrame
    traces: DataFrame
    points: DataFrame


# ------------------------------------------------------------------ pieces
def say(key: str, *values: Column) -> Column:
    return F.format_string(words.SAY[key], *values) if values else F.lit(words.SAY[key])


@dataclass
class Branch:
    when: Column
    status: str
    message: Column
    severity: str | None = None
    missing: Column | None = None
    basis: Column | str | None = None
    evidence: dict[str, Column] | None = None


def needs(*conditions: tuple[Column, str | Column]) -> Column:
    """The needs whose condition holds, in order."""
    texts = [F.when(c, F.lit(NEED[n]) if isinstance(n, str) else n) for c, n in conditions]
    return F.array_compact(F.array(*texts))


def unmet(missing: Column) -> Branch:
    return Branch(F.size(missing) > 0, NOT_EVALUATED, say("insufficient"), missing=missing)


_lean = ContextVar("lean", default=False)


@contextmanager
def outcomes_only():
    """Checks built inside carry their status and basis but no words or evidence; a
    count of statuses then computes nothing else."""
    token = _lean.set(True)
    try:
        yield
    finally:
        _lean.reset(token)


def check(rule: str, branches: list[Branch]) -> Column:
    """The first branch that holds."""

    def outcome(b: Branch) -> Column:
        if _lean.get():
            b = Branch(b.when, b.status, F.lit(None).cast("string"), b.severity, basis=b.basis)
        basis = b.basis if isinstance(b.basis, Column) else F.lit(b.basis).cast("string")
        missing = b.missing if b.missing is not None else F.array().cast("array<string>")
        return F.struct(
            F.lit(rule).alias("rule"),
            F.lit(b.status).alias("status"),
            F.lit(b.severity).cast("string").alias("severity"),
            b.message.alias("message"),
            missing.alias("missing"),
            basis.alias("basis"),
            evidence_map(b.evidence or {}).alias("evidence"),
        )

    return reduce(
        lambda done, b: done.when(b.when, outcome(b)), branches[1:], F.when(branches[0].when, outcome(branches[0]))
    )


def checks_of(df: DataFrame, *checks: Column) -> DataFrame:
    """One row per check of a row; rows carry their subject when they have one."""
    subject = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in _SUBJECT[:-1]]
    place = F.col("pos") if "pos" in df.columns else F.lit(0)
    return df.select(*subject, place.cast("int").alias("pos"), F.explode(F.array(*checks)).alias("_c")).where(
        F.col("_c").isNotNull()
    ).select(*_SUBJECT, "_c.*")


def _name() -> Column:
    return F.coalesce("filename", "evidence_id")


def _always() -> Column:
    return F.lit(True)


# ------------------------------------------------------------------ photos
def chk_r1(photos: DataFrame, cases: DataFrame) -> DataFrame:
    """Location against the supplied drain point or line; at best CONSISTENT."""
    drain = F.col("drain")
    here = geo.pt(F.col("lon"), F.col("lat"))
    has_line = F.coalesce(F.size(drain["line"]) > 0, F.lit(False))
    distance = F.when(has_line, geo.dist_to_line_m(here, drain["line"])).otherwise(
        geo.metres_between(here, drain["point"])
    )
    rows = photos.join(cases.select("case_id", "drain"), "case_id").withColumns(
        {
            "_d": F.when(F.col("has_gps"), distance),
            "_tol": F.coalesce(drain["tolerance_m"], F.lit(words.TOLERANCE_M)),
            "_ref": F.when(has_line, F.lit("line")).otherwise(F.lit("point")),
        }
    )
    d, tol, ref, acc = F.col("_d"), F.col("_tol"), F.col("_ref"), F.col("gps_accuracy_m")
    measured = ~F.isnan(acc) & (F.abs(acc) < float("inf"))
    measured = F.coalesce(measured, F.lit(False))
    metres, limit = text.fixed0(d), text.fixed0(tol)
    seen = {
        "distanceM": round_half_even(d, 1), "toleranceM": tol, "marginM": F.lit(words.MARGIN_M), "gpsAccuracyM": acc,
        "reference": ref, "source": drain["source"],
    }
    note = F.when(measured, say("r1_accuracy", text.fixed0(F.when(measured, acc)))).otherwise(say("r1_no_accuracy"))
    about = dict(basis="approximate", evidence=seen)
    branches = [
        unmet(needs((~F.coalesce("has_gps", F.lit(False)), "gps"), (drain.isNull(), "drain"))),
        Branch(d > tol + words.MARGIN_M, FAIL,
               say("r1_far", _name(), text.grouped(d, 0), ref, limit, F.lit("30")), HARD, **about),
        Branch(d > tol, REVIEW, say("r1_near", _name(), metres, ref, text.fixed0(d - tol), limit), SOFT, **about),
        Branch(drain["derived_from_photos"], INCONCLUSIVE, say("r1_circular", _name(), metres, ref, ref), **about),
        Branch(measured & (acc > tol), INCONCLUSIVE,
               say("r1_vague", _name(), metres, ref, text.fixed0(F.when(measured, acc)), limit), **about),
        Branch(_always(), CONSISTENT, say("r1_inside", _name(), metres, ref, limit, note), **about),
    ]
    return checks_of(rows, check("R1", branches))


def chk_r2(photos: DataFrame, cases: DataFrame) -> DataFrame:
    """Capture time against the work window; an assumed time zone is said."""
    rows = photos.join(cases.select("case_id", "window"), "case_id").withColumns(
        {
            "_taken": clock.iso_parts(F.col("timestamp")),
            "_from": clock.iso_parts(F.col("window.start")),
            "_to": clock.iso_parts(F.col("window.end")),
        }
    )
    taken, start, end = F.col("_taken"), F.col("_from"), F.col("_to")
    assumed = ~F.coalesce("timestamp_has_offset", F.lit(False)) & start["offset_min"].isNotNull()
    note = F.when(assumed, say("r2_assumed")).otherwise(F.lit(""))
    seen = {
        "timestamp": F.col("timestamp"), "windowStart": F.col("window.start"), "windowEnd": F.col("window.end"),
        "timezoneAssumed": F.when(assumed, F.lit("true")),
    }
    when = (_name(), clock.date_text(taken["wall_us"]), clock.hhmm_text(taken["wall_us"]), note)
    branches = [
        unmet(needs((F.coalesce("timestamp", F.lit("")) == "", "time"), (F.col("window").isNull(), "window"))),
        Branch(taken.isNull() | start.isNull() | end.isNull(), INCONCLUSIVE, say("r2_unread"), basis="extracted"),
        Branch(~clock.in_window(taken, start, end), FAIL, say("r2_outside", *when), HARD, basis="extracted", evidence=seen),
        Branch(_always(), PASS, say("r2_inside", *when), basis="extracted", evidence=seen),
    ]
    return checks_of(rows, check("R2", branches))


def chk_r3(photos: DataFrame, limits: CaseLimits | None = None, **tuning) -> DataFrame:
    """Reuse inside one case, one check per hashed photo of a case with two or more."""
    bits = (limits or CaseLimits()).reuse_bits
    hashed = photos.where(F.length("p_hash") > 0)
    enough = hashed.groupBy("case_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 2).select("case_id")
    usable = hashed.join(enough, "case_id", "left_semi")
    copies = reuse.first_originals(usable, ["case_id"], "evidence_id", None, bits, **tuning)
    named = photos.select("case_id", F.col("evidence_id").alias("original"), _name().alias("_original_name"))
    rows = usable.join(copies, ["case_id", "evidence_id"], "left").join(named, ["case_id", "original"], "left")
    copy = F.col("distance").isNotNull()
    same = say("r3_same", _name(), F.col("_original_name"), F.col("distance").cast("string"), F.lit(str(bits)))
    branches = [
        Branch(copy, FAIL, same, HARD, basis="extracted",
               evidence={"originalEvidenceId": F.col("original"), "hammingDistance": F.col("distance")}),
        Branch(_always(), PASS, say("r3_unlike", _name()), basis="extracted"),
    ]
    return checks_of(rows, check("R3", branches))


def chk_r4(photos: DataFrame) -> DataFrame:
    """What the model saw, after-photos only."""
    v = F.col("vision")
    basis = F.when(v["mocked"], F.lit("mocked")).otherwise(F.lit("model"))
    sure = {"confidence": v["confidence"]}
    skipped = F.coalesce(F.nullif(v["skipped_reason"], F.lit("")), F.lit("not run"))
    spoken = F.coalesce(v["confidence"].cast("string"), F.lit("None"))
    branches = [
        Branch(~F.coalesce(v["ran"], F.lit(False)), NOT_EVALUATED, say("r4_not_run"),
               missing=F.array(F.format_string(NEED["model"], skipped))),
        Branch(~F.coalesce(v["ok"], F.lit(False)) | v["cleared"].isNull(), INCONCLUSIVE, say("r4_unusable", _name()), basis=basis),
        Branch(~v["cleared"], REVIEW, say("r4_not_cleared", _name(), spoken), SOFT, basis=basis, evidence=sure),
        Branch(_always(), PASS, say("r4_cleared", _name(), spoken), basis=basis, evidence=sure),
    ]
    return checks_of(photos.where(F.col("role") == "after"), check("R4", branches))


# ------------------------------------------------------------------ traces
def effective_vehicle(trace_vehicle: Column, truck: Column) -> Column:
    named = F.coalesce(F.nullif(trace_vehicle, F.lit("")), truck["vehicle_no"])
    return text.norm_vehicle(named)


def case_trace_facts(tables: CaseTables) -> DataFrame:
    """Trace facts against each case's designated site (polygon, else circle)."""
    fences = tables.cases.where(F.col("site").isNotNull()).select("case_id", geo.site_fence(F.col("site")).alias("geofence"))
    placed = traces.points_in_site(traces.with_times(tables.points), fences, "case_id")
    return traces.trace_facts(placed, TRACE_KEYS)


def chk_trace(traced: DataFrame, cases: DataFrame, limits: CaseLimits | None = None) -> DataFrame:
    """R5 and GPS_GAP. ``traced`` is traces joined with their facts."""
    limits = limits or CaseLimits()
    rows = traced.join(cases.select("case_id", "site"), "case_id")
    site, arrival, last = F.col("site"), F.col("arrival"), F.col("last_point")
    at = F.coalesce(F.when(arrival.isNotNull(), clock.hhmm_text(arrival["wall_us"])), say("r5_untimed"))
    km = text.fixed(geo.metres_between(last, site["point"]) / 1000, 1)
    gap = F.col("max_gap_s")
    seconds = {"gapSeconds": text.fixed0(gap)}
    r5 = [
        unmet(needs((site.isNull(), "site"))),
        Branch(F.col("entered"), PASS, say("r5_enters", at), basis="supplied", evidence={"arrival": clock.iso_text(arrival)}),
        Branch(_always(), FAIL, say("r5_never", km), HARD, basis="supplied",
               evidence={"lastFix": F.format_string("[%s, %s]", last["lon"].cast("string"), last["lat"].cast("string")),
                         "lastFixTime": clock.iso_text(F.col("last_fix"))}),
    ]
    dark = [
        Branch(gap.isNull(), INCONCLUSIVE, say("gap_few"), basis="supplied"),
        Branch(gap > limits.gap_s, REVIEW, say("gap_dark", text.fixed0(gap / 60)), SOFT, basis="supplied", evidence=seconds),
        Branch(_always(), PASS, say("gap_fine", text.fixed0(gap)), basis="supplied", evidence=seconds),
    ]
    return checks_of(rows, check("R5", r5), check("GPS_GAP", dark))


def same_truck_traces(traced: DataFrame, cases: DataFrame) -> DataFrame:
    """Traces of a vehicle with two or more in its case, with ``vehicle``."""
    known = traced.join(cases.select("case_id", "truck"), "case_id").withColumn(
        "vehicle", effective_vehicle(F.col("vehicle_no"), F.col("truck"))
    ).where(F.col("vehicle").isNotNull())
    shared = known.groupBy("case_id", "vehicle").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 2)
    return known.join(shared.select("case_id", "vehicle"), ["case_id", "vehicle"], "left_semi")


def chk_r6(traced: DataFrame, cases: DataFrame, limits: CaseLimits | None = None) -> DataFrame:
    """The first clash of each trace of a truck with several."""
    limits = limits or CaseLimits()
    eligible = same_truck_traces(traced, cases)
    legs = traces.truck_legs(eligible, ("case_id", "vehicle"), "evidence_id")

    def clash(side):
        return F.when(F.col(side)["kmh"] > limits.speed_kmh, F.col(side))

    clashes = legs.select("case_id", F.col("leg_id").alias("evidence_id"), F.coalesce(clash("before"), clash("after")).alias("_x"))
    named = traced.select("case_id", F.col("evidence_id").alias("_other"), _name().alias("_other_name"))
    rows = eligible.join(clashes, ["case_id", "evidence_id"], "left").withColumn("_other", F.col("_x.other")).join(
        named, ["case_id", "_other"], "left"
    )
    x = F.col("_x")
    minutes = text.fixed0(F.greatest(x["minutes"], F.lit(0.0)))
    branches = [
        Branch(x.isNotNull(), FAIL, say("r6_clash", _name(), F.col("_other_name"), text.fixed(x["km"], 1), minutes, text.fixed0(F.lit(limits.speed_kmh))), HARD,
               basis="supplied",
               evidence={"otherEvidenceId": x["other"], "km": round_half_even(x["km"], 2), "minutes": round_half_even(x["minutes"], 1)}),
        Branch(_always(), PASS, say("r6_fine", _name()), basis="supplied"),
    ]
    return checks_of(rows, check("R6", branches))


# ------------------------------------------------------------------- slips
def pair_slips(slips: DataFrame, traced: DataFrame, cases: DataFrame) -> DataFrame:
    """``(case_id, evidence_id, trace_id)``: one slip and one trace pair directly;
    otherwise the k-th slip of a vehicle takes the k-th trace of it. That equals
    walking the slips in order, because a choice never crosses vehicles."""
    sizes = (
        slips.groupBy("case_id").agg(F.count(F.lit(1)).alias("_slips"))
        .join(traced.groupBy("case_id").agg(F.count(F.lit(1)).alias("_traces")), "case_id")
        .withColumn("_single", (F.col("_slips") == 1) & (F.col("_traces") == 1))
        .select("case_id", "_single")
    )
    s = slips.join(sizes, "case_id").withColumn("vehicle", text.norm_vehicle(F.col("vehicle_no")))
    t = traced.join(sizes, "case_id").join(cases.select("case_id", "truck"), "case_id").withColumn(
        "vehicle", effective_vehicle(F.col("vehicle_no"), F.col("truck"))
    )

    def ranked(df, id_name):
        usable = df.where(~F.col("_single") & F.col("vehicle").isNotNull()).select(
            "case_id", "vehicle", "pos", F.col("evidence_id").alias(id_name)
        )
        return numbered(usable, ["case_id", "vehicle"], ["pos", id_name], F.floor(F.col("pos") / F.lit(4096)), "_k").drop("pos")

    by_vehicle = ranked(s, "evidence_id").join(ranked(t, "trace_id"), ["case_id", "vehicle", "_k"])
    direct = s.where("_single").select("case_id", "evidence_id").join(
        t.where("_single").select("case_id", F.col("evidence_id").alias("trace_id")), "case_id"
    )
    return direct.unionByName(by_vehicle.select("case_id", "evidence_id", "trace_id"))


def paired_slips(slips: DataFrame, traced: DataFrame, cases: DataFrame) -> DataFrame:
    """Slips with their trace's facts (``trace_id`` null when unpaired) and case details."""
    facts = traced.select(
        "case_id", F.col("evidence_id").alias("trace_id"), F.col("vehicle_no").alias("trace_vehicle"),
        "entered", "arrival", "departure",
    )
    pairs = pair_slips(slips, traced, cases)
    return (
        slips.join(pairs, ["case_id", "evidence_id"], "left")
        .join(facts, ["case_id", "trace_id"], "left")
        .join(cases.select("case_id", "site", "truck"), "case_id")
    )


def _slip_basis() -> Column:
    return F.when(F.col("mocked"), F.lit("mocked")).otherwise(F.lit("extracted"))


def chk_r7(paired: DataFrame) -> DataFrame:
    net, capacity = F.col("net"), F.col("truck.capacity_tonnes")
    seen = dict(basis=_slip_basis(), evidence={"net": net, "capacityTonnes": capacity})
    spoken = (text.fixed(net, 2), text.general(capacity))
    return checks_of(paired, check("R7", [
        Branch(net.isNull(), INCONCLUSIVE, say("r7_unread"), basis=_slip_basis()),
        unmet(needs((capacity.isNull(), "capacity"))),
        Branch(net > capacity, FAIL, say("r7_over", *spoken), HARD, **seen),
        Branch(_always(), PASS, say("r7_within", *spoken), **seen),
    ]))


def chk_r8(paired: DataFrame, limits: CaseLimits | None = None) -> DataFrame:
    limits = limits or CaseLimits()
    rows = paired.withColumn("_delta", clock.minutes_apart(F.col("time_in"), F.col("arrival.wall_us")))
    time_in, delta, arrival = F.col("time_in"), F.col("_delta"), F.col("arrival")
    entered = F.coalesce("entered", F.lit(False))
    kind = F.when(entered, F.lit("disposalSite")).otherwise(F.lit("lastFix"))
    spoken = F.when(entered, F.lit("arrival at the site")).otherwise(F.lit("last fix"))
    return checks_of(rows, check("R8", [
        Branch(time_in.isNull(), INCONCLUSIVE, say("r8_unread"), basis=_slip_basis()),
        unmet(needs((F.col("trace_id").isNull(), "paired"), (F.col("site").isNull(), "site"))),
        Branch(delta.isNull(), INCONCLUSIVE, say("r8_untimed"), basis=_slip_basis()),
        Branch(F.abs(delta) > limits.slip_minutes, FAIL, r8_message(time_in, delta, arrival, entered, F.col("departure")),
               HARD, basis=_slip_basis(),
               evidence={"timeIn": time_in, "arrival": clock.iso_text(arrival), "arrivalKind": kind,
                         "minutes": round_half_even(delta, 1), "traceEvidenceId": F.col("trace_id")}),
        Branch(_always(), PASS,
               say("r8_within", time_in, F.lit(f"{limits.slip_minutes:.0f}"), spoken, clock.hhmm_text(arrival["wall_us"])),
               basis=_slip_basis(), evidence={"minutes": round_half_even(delta, 1), "arrivalKind": kind}),
    ]))


def chk_r9(paired: DataFrame) -> DataFrame:
    rows = paired.withColumns(
        {
            "_slip": text.norm_vehicle(F.col("vehicle_no")),
            "_trip": effective_vehicle(F.when(F.col("trace_id").isNotNull(), F.col("trace_vehicle")), F.col("truck")),
        }
    )
    slip, trip = F.col("_slip"), F.col("_trip")
    return checks_of(rows, check("R9", [
        Branch(slip.isNull(), INCONCLUSIVE, say("r9_unread"), basis=_slip_basis()),
        unmet(needs((trip.isNull(), "vehicle"))),
        Branch(slip != trip, FAIL, say("r9_differs", slip, trip), HARD, basis=_slip_basis(),
               evidence={"slipVehicleNo": slip, "tripVehicleNo": trip}),
        Branch(_always(), PASS, say("r9_same", slip), basis=_slip_basis()),
    ]))


def chk_t2(slips: DataFrame) -> DataFrame:
    gross, tare, net = F.col("gross"), F.col("tare"), F.col("net")
    two = [text.fixed(c, 2) for c in (gross, tare, net)]
    return checks_of(slips, check("T2", [
        Branch(gross.isNull() | tare.isNull() | net.isNull(), INCONCLUSIVE, say("t2_unread"), basis=_slip_basis()),
        Branch(F.coalesce("net_derived", F.lit(False)), INCONCLUSIVE, say("t2_circular"), basis=_slip_basis()),
        Branch(F.abs(gross - tare - net) > words.T2_TONNES, FAIL,
               say("t2_differs", two[0], two[1], text.fixed(gross - tare, 2), two[2]), HARD, basis=_slip_basis(),
               evidence={"gross": gross, "tare": tare, "net": net}),
        Branch(_always(), PASS, say("t2_same", *two), basis=_slip_basis()),
    ]))


# ------------------------------------------------------------------- claim
def _quantity() -> Column:
    return F.col("claim.quantity_tonnes")


def chk_t1(cases: DataFrame) -> DataFrame:
    quantity, rate, amount = _quantity(), F.col("claim.rate_per_tonne"), F.col("claim.amount_rupees")
    expected = quantity * rate
    tolerance = F.greatest(F.lit(words.T1_RUPEES), F.lit(words.T1_FRACTION) * expected)
    sums = (text.general(quantity), text.grouped(rate, 2), text.grouped(expected, 2))
    return checks_of(cases, check("T1", [
        unmet(needs((quantity.isNull(), "quantity"), (rate.isNull(), "rate"), (amount.isNull(), "amount"))),
        Branch(F.abs(expected - amount) > tolerance, FAIL,
               say("t1_differs", *sums, text.grouped(amount, 2), text.grouped(amount - expected, 2)), HARD, basis="supplied",
               evidence={"expectedRupees": round_half_even(expected, 2), "claimedRupees": amount}),
        Branch(_always(), PASS, say("t1_same", *sums), basis="supplied", evidence={"expectedRupees": round_half_even(expected, 2)}),
    ]))


def chk_r10(cases: DataFrame) -> DataFrame:
    d, quantity = F.col("drain"), _quantity()
    ceiling = d["length_m"] * d["width_m"] * d["depth_m"] * (wording.SILT_DENSITY * wording.HEADROOM)
    seen = dict(basis="supplied", evidence={"plausibleMaxTonnes": round_half_even(ceiling, 1)})
    over = F.format_string(wording.SAY["r10_over"], text.fixed0(quantity), text.fixed0(ceiling))
    return checks_of(cases, check("R10", [
        unmet(needs((quantity.isNull(), "quantity"), (ceiling.isNull(), "dimensions"))),
        Branch(quantity > ceiling, REVIEW, over, SOFT, **seen),
        Branch(_always(), PASS, say("r10_fits", text.general(quantity), text.grouped(ceiling, 0)), **seen),
    ]))


def chk_t3(cases: DataFrame, slips: DataFrame) -> DataFrame:
    read = slips.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("_slips"),
        F.count("net").alias("_read"),
        F.sum(F.col("net").cast("decimal(18,3)")).cast("double").alias("_total"),
        F.max(F.coalesce("mocked", F.lit(False))).alias("_mocked"),
    )
    rows = cases.join(read, "case_id", "left")
    quantity, total = _quantity(), F.col("_total")
    none = F.coalesce("_slips", F.lit(0)) == 0
    unread = F.col("_slips") - F.col("_read")
    note = F.when(unread > 0, say("t3_note", unread.cast("string"))).otherwise(F.lit(""))
    basis = F.when(F.col("_mocked"), F.lit("mocked")).otherwise(F.lit("extracted"))
    sums = dict(basis=basis, evidence={"slipTotalTonnes": total, "claimedTonnes": quantity})
    spoken = (text.general(total), text.general(quantity))
    return checks_of(rows, check("T3", [
        unmet(needs((quantity.isNull(), "quantity"), (none, "slip"))),
        Branch(F.col("_read") == 0, INCONCLUSIVE, say("t3_unread"), basis="extracted"),
        Branch(total >= quantity * words.T3_FRACTION, PASS, say("t3_covered", *spoken, note), **sums),
        Branch(_always(), REVIEW, say("t3_short", *spoken, text.fixed0(total / quantity * 100), note), SOFT, **sums),
    ]))


# ------------------------------------------------------------- empty cases
def chk_absent(cases: DataFrame, photos: DataFrame, slips: DataFrame, traced: DataFrame, same_truck: DataFrame) -> DataFrame:
    """The checks of cases that lack a whole kind of evidence."""

    def count(df, name, condition=None):
        n = F.count(F.lit(1)) if condition is None else F.count_if(condition)
        return df.groupBy("case_id").agg(n.alias(name))

    counts = photos.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("_photos"),
        F.count_if(F.length("p_hash") > 0).alias("_hashed"),
        F.count_if(F.col("role") == "after").alias("_after"),
    )
    rows = (
        cases.join(counts, "case_id", "left")
        .join(count(slips, "_slips"), "case_id", "left")
        .join(count(traced, "_traces"), "case_id", "left")
        .join(count(same_truck, "_pairs"), "case_id", "left")
    )

    def few(name, least=1):
        return F.coalesce(F.col(name), F.lit(0)) < least

    def absent(rule, condition, *more):
        need = needs((_always(), more[0]), *[(F.col(c).isNull(), n) for c, n in more[1:]])
        return check(rule, [Branch(condition, NOT_EVALUATED, say("insufficient"), missing=need)])

    no_slip = [absent(rule, few("_slips"), "slip") for rule in ("R7", "R8", "R9", "T2")]
    return checks_of(
        rows,
        absent("R1", few("_photos"), "photo", ("drain", "drain")),
        absent("R2", few("_photos"), "photo", ("window", "window")),
        absent("R3", few("_hashed", 2), "hashes"),
        absent("R4", few("_after"), "after"),
        absent("R5", few("_traces"), "trace", ("site", "site")),
        absent("GPS_GAP", few("_traces"), "trace"),
        absent("R6", few("_pairs", 2), "two_traces"),
        *no_slip,
    )


# ------------------------------------------------------------------- whole
def demote_mocked(checks: DataFrame) -> DataFrame:
    """An outcome computed from mocked readings is no outcome; it is kept apart."""
    mocked = (F.col("basis") == "mocked") & ~F.col("status").isin(NOT_EVALUATED, INCONCLUSIVE)
    mocked = F.coalesce(mocked, F.lit(False))
    return checks.select(
        *[c for c in checks.columns if c not in ("status", "severity", "message", "missing")],
        F.when(mocked, F.lit(NOT_EVALUATED)).otherwise(F.col("status")).alias("status"),
        F.when(~mocked, F.col("severity")).alias("severity"),
        F.when(mocked, say("mock", F.col("message"))).otherwise(F.col("message")).alias("message"),
        F.when(mocked, F.array(F.lit(NEED["real"]))).otherwise(F.col("missing")).alias("missing"),
        F.when(mocked, F.col("status")).alias("mock_outcome"),
    )


def with_titles(checks: DataFrame) -> DataFrame:
    """Adds the title and ``rule_order``, the place of the rule in a report."""
    titles = F.create_map(*[F.lit(x) for kv in words.TITLES.items() for x in kv])
    order = F.array(*[F.lit(r) for r in words.TITLES])
    return checks.withColumns(
        {"title": F.try_element_at(titles, F.col("rule")), "rule_order": F.array_position(order, F.col("rule"))}
    )


def status_counts(checks: DataFrame) -> DataFrame:
    return checks.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in words.STATUSES]
    )


class CaseReport:
    """All checks of all cases, lazily; the trace facts are staged once."""

    def __init__(self, tables: CaseTables, limits: CaseLimits | None = None, staged: bool = True, **tuning):
        self.tables, self.limits, self._tuning = tables, limits or CaseLimits(), tuning
        self._stage = stage if staged else lambda df, name: df

    @cached_property
    def traced(self) -> DataFrame:
        facts = case_trace_facts(self.tables)
        return self._stage(self.tables.traces.join(facts, list(TRACE_KEYS)), "case-traces")

    @cached_property
    def checks(self) -> DataFrame:
        return with_titles(demote_mocked(self._parts()))

    def _parts(self) -> DataFrame:
        t = self.tables
        paired = paired_slips(t.slips, self.traced, t.cases)
        parts = [
            chk_r1(t.photos, t.cases),
            chk_r2(t.photos, t.cases),
            chk_r3(t.photos, self.limits, **self._tuning),
            chk_r4(t.photos),
            chk_trace(self.traced, t.cases, self.limits),
            chk_r6(self.traced, t.cases, self.limits),
            chk_r7(paired),
            chk_r8(paired, self.limits),
            chk_r9(paired),
            chk_t2(t.slips),
            chk_t1(t.cases),
            chk_r10(t.cases),
            chk_t3(t.cases, t.slips),
            chk_absent(t.cases, t.photos, t.slips, self.traced, same_truck_traces(self.traced, t.cases)),
        ]
        return reduce(DataFrame.unionByName, parts)

    @cached_property
    def counts(self) -> DataFrame:
        with outcomes_only():
            return status_counts(demote_mocked(self._parts()))


def evaluate_cases(tables: CaseTables, limits: CaseLimits | None = None, **options) -> CaseReport:
    return CaseReport(tables, limits, **options)


# ----------------------------------------------------------------- reports
def section_checks(checks: DataFrame) -> DataFrame:
    """Adds the section a check is shown in and that section's order."""
    keys = list(words.SECTIONS)
    place = (
        F.when(F.col("status").isin(FAIL, REVIEW), 0).when(F.col("status").isin(PASS, CONSISTENT), 1)
        .when(F.col("status") == INCONCLUSIVE, 2).otherwise(3)
    )
    section = F.get(F.array(*[F.lit(k) for k in keys]), place)
    title = F.get(F.array(*[F.lit(words.SECTIONS[k]) for k in keys]), place)
    return checks.withColumns({"section": section, "section_title": title, "section_order": place})


def summary_text(checks: DataFrame, mocked: DataFrame | None = None) -> DataFrame:
    """One paragraph per case: counts, the first three problems, the first five needs.
    Only those few are gathered, after they are chosen."""
    counts = checks.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in words.STATUSES],
    )
    firsts = numbered(
        checks.where(F.col("status").isin(FAIL, REVIEW)).withColumn("_e", F.coalesce("evidence_id", F.lit(""))),
        ["case_id"], ["rule_order", "pos", "_e", "rule"], F.col("rule_order"), "_k",
    ).where(F.col("_k") <= 3)
    told = firsts.groupBy("case_id").agg(
        F.array_sort(F.collect_list(F.struct("_k", F.concat_ws(": ", "rule", "message").alias("t")))).alias("_told")
    )
    wants = (
        checks.where(F.col("status") == NOT_EVALUATED)
        .select("case_id", F.explode("missing").alias("need"))
        .distinct()
        .groupBy("case_id")
        .agg(F.array_sort(F.collect_set("need")).alias("_needs"))
    )
    joined = counts.join(told, "case_id", "left").join(wants, "case_id", "left")
    if mocked is not None:
        joined = joined.join(mocked.select("case_id", F.lit(True).alias("_mock")).distinct(), "case_id", "left")
    else:
        joined = joined.withColumn("_mock", F.lit(False))
    n = F.col("fail") + F.col("review")
    more = F.when(n > 3, F.format_string(words.SUMMARY["more"], (n - 3).cast("string"))).otherwise(F.lit(""))
    listed = F.array_join(F.transform("_told", lambda x: x["t"]), " ")
    problems = F.when(n > 0, F.format_string(words.SUMMARY["problems"], listed, more)).otherwise(F.lit(words.SUMMARY["no_problem"]))
    supply = let(
        F.col("_needs"),
        lambda w: F.when(
            F.size(w) > 0,
            F.format_string(
                words.SUMMARY["supplying"],
                F.array_join(F.slice(w, 1, 5), "; "),
                F.when(F.size(w) > 5, F.lit(words.SUMMARY["and_more"])).otherwise(F.lit("")),
            ),
        ),
    )
    numbers = [F.col(c).cast("string") for c in ("total", "fail", "review", "pass", "consistent", "inconclusive", "not_evaluated")]
    lines = F.array(
        F.when(F.col("_mock"), F.lit(words.SUMMARY["mocked"])),
        F.format_string(words.SUMMARY["counts"], *numbers),
        problems,
        supply,
        F.lit(words.SUMMARY["end"]),
    )
    return joined.select("case_id", F.array_join(F.array_compact(lines), " ").alias("summary"))


def observations(tables: CaseTables, summaries: DataFrame | None = None) -> DataFrame:
    """What was read from each evidence item, by kind, kept apart from the checks."""
    photo = tables.photos.select("case_id", "evidence_id", "filename", F.lit("vision").alias("kind"), "role", "vision", "p_hash", "timestamp")
    slip = tables.slips.select(
        "case_id", "evidence_id", "filename", F.lit("textract").alias("kind"),
        F.struct("net", "gross", "tare", "time_in", "vehicle_no").alias("fields"), "mocked",
    )
    trace = tables.traces.select("case_id", "evidence_id", "filename", F.lit("trace").alias("kind"), "vehicle_no")
    if summaries is not None:
        trace = trace.drop("vehicle_no").join(summaries, list(TRACE_KEYS), "left")
    return photo.unionByName(slip, allowMissingColumns=True).unionByName(trace, allowMissingColumns=True)


def split_ready(evidence: DataFrame, now_epoch: Column) -> tuple[DataFrame, DataFrame]:
    """(READY rows, the others with the reason they were left out).

    ``evidence`` has state, error_message, lease_until and updated_at (epoch seconds)."""
    from ..operators.control import is_stalled

    reason = F.coalesce(
        F.nullif(F.col("error_message"), F.lit("")),
        F.when(F.col("state") == "UPLOADING", F.lit("Upload was never completed."))
        .when(is_stalled(now_epoch), F.lit("Processing did not finish; retry or remove this file."))
        .otherwise(F.col("state")),
    )
    ready = evidence.where(F.col("state") == "READY")
    rest = evidence.where(F.coalesce(F.col("state"), F.lit("")) != "READY").withColumn("reason", reason)
    return ready, rest


def line_from_photos(photos: DataFrame) -> DataFrame:
    """A line per case through its photos' fixes in capture order, repeats dropped. It is
    long form: one row per kept vertex, so no case is gathered."""
    from ..operators.ordered import neighbours, range_buckets

    fixes = photos.where("has_gps").select("case_id", F.coalesce("timestamp", F.lit("")).alias("t"), "pos", "evidence_id", "lon", "lat")
    order = ["t", "pos", "evidence_id"]
    near = neighbours(range_buckets(fixes, ["case_id"], order, "_range"), ["case_id"], order, F.col("_range"), ["lon", "lat"])
    moved = F.col("prev").isNull() | (F.col("prev.lon") != F.col("lon")) | (F.col("prev.lat") != F.col("lat"))
    return near.where(moved).select("case_id", "t", "pos", "evidence_id", "lon", "lat")
