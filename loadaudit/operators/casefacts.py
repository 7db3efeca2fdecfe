"""What a drain's case file says, for every drain: the trip to open on, where its
trucks stopped, titles and a timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock, geo, text
from ..functions.rounding import round_half_even
from ..plans import wording
from ..plans.wording import HOLD, REVIEW

KEYS = ["bill_id", "drain_id"]
TOGETHER_M = 300.0
WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]


def focus_trip(trips: DataFrame) -> DataFrame:
    """One trip per drain: held and never arrived, else held, else in review, else the
    first; trips in order of number. ``trips`` has verdict and failed_r5."""
    rank = (
        F.when((F.col("verdict") == HOLD) & F.col("failed_r5"), 0)
        .when(F.col("verdict") == HOLD, 1).when(F.col("verdict") == REVIEW, 2).otherwise(3)
    )
    first = F.min(F.struct(rank.alias("rank"), F.coalesce("trip_no", F.lit("")).alias("no"), F.col("trip_id").alias("trip_id")))
    return trips.groupBy(*KEYS).agg(first.alias("_f")).select(*KEYS, "_f.trip_id")


def judged(audit) -> DataFrame:
    """The audit's trips with verdicts and what their traces and slips show."""
    j = audit.judged_trips
    has_points = F.coalesce(F.col("n_points"), F.lit(0)) > 0
    slip_ok = F.coalesce("slip_found", F.lit(False)) & (F.coalesce("slip_status", F.lit("")) != "ERROR")
    late = slip_ok & (F.abs(F.col("delta_min")) > audit.limits.slip_minutes)
    shown = j.select(
        *KEYS, "trip_id",
        (has_points & ~F.coalesce("entered", F.lit(False))).alias("failed_r5"),
        F.when(has_points, F.col("last_point")).alias("end"),
        F.coalesce(late, F.lit(False)).alias("has_r8"),
        F.coalesce("entered", F.lit(False)).alias("entered"),
        F.col("slip_time_in").alias("time_in"), "arrival", "departure", "delta_min",
        *[c for c in ("start_time", "arrival_time") if c in j.columns], "trace_key",
    )
    return shown.join(audit.trips, [*KEYS, "trip_id"])


def case_facts(trips: DataFrame, drains: DataFrame, drain_findings: DataFrame, sites: DataFrame, routes: DataFrame,
               lengths: DataFrame) -> DataFrame:
    """One row per drain of ``drains``, those without trips too. ``trips`` is ``judged``; ``sites`` gives a bill's ``center``, ``routes`` a drain's
    ``claimed_route``, ``lengths`` a trace's distance_m."""
    focus = focus_trip(trips).join(trips, [*KEYS, "trip_id"])
    focus = focus.join(lengths.select("bill_id", "trace_key", "distance_m"), ["bill_id", "trace_key"], "left")
    aim = focus.select(*KEYS, F.col("end").alias("_aim"))
    spread = trips.join(aim, KEYS).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("trips"),
        F.count_if(F.col("verdict") == HOLD).alias("hold_trips"),
        F.count_if(F.col("verdict") == REVIEW).alias("review_trips"),
        F.min("failed_r5").alias("_all_r5"),
        F.coalesce(F.min(geo.metres_between(F.col("end"), F.col("_aim")) < TOGETHER_M), F.lit(True)).alias("_close"),
        F.avg("end.lon").alias("_lon"),
        F.avg("end.lat").alias("_lat"),
        F.min(F.when(F.col("verdict") == HOLD, F.size("hard_fails"))).alias("hard_min"),
        F.max(F.when(F.col("verdict") == HOLD, F.size("hard_fails"))).alias("hard_max"),
        *_rule_flags(),
    )
    hard, soft = _listed("hard"), _listed("soft")
    r3 = drain_findings.where(F.col("rule") == "R3").groupBy(*KEYS).agg(
        F.min_by(
            F.col("evidence")["originalDrainId"],
            F.struct(F.when(F.col("evidence")["hammingDistance"] == "0", 0).otherwise(1), "s3_key"),
        ).alias("r3_owner"),
        F.count(F.lit(1)).alias("_r3"),
    )
    joined = focus.join(spread, KEYS).join(r3, KEYS, "left").join(routes, KEYS, "left").join(sites.select("bill_id", "center"), "bill_id", "left")
    together = (F.col("trips") > 1) & F.col("_all_r5") & F.col("end").isNotNull() & F.col("_close")
    stop = F.when(together, geo.pt(F.col("_lon"), F.col("_lat"))).otherwise(F.col("end"))
    reached = ~F.col("failed_r5")
    every = F.array_union(hard, soft)
    own = F.array_union("hard_fails", "soft_fails")

    def family(rules, names):
        return F.array_intersect(F.array(*[F.lit(n) for n in names]), rules)

    conflicting = (
        F.when(F.array_contains(own, "R8"), F.lit("timeIn")).when(F.array_contains(own, "R7"), F.lit("net"))
        .when(F.array_contains(own, "R9"), F.lit("vehicleNo"))
    )
    start = F.col("start_time") if "start_time" in trips.columns else F.lit(None).cast("string")
    r8 = F.struct(
        F.col("time_in").alias("time_in"),
        F.coalesce(F.when(F.col("departure").isNotNull(), clock.hhmm_text(F.col("departure.wall_us"))), clock.hhmm(start)).alias("departure"),
        F.when(F.col("arrival").isNotNull(), clock.hhmm_text(F.col("arrival.wall_us"))).alias("compared"),
        F.when(F.col("entered"), F.lit("arrival")).otherwise(F.lit("lastFix")).alias("kind"),
        F.floor(F.abs(round_half_even(-F.col("delta_min"), 1))).cast("int").alias("minutes"),
    )
    facts = joined.select(
        *KEYS, "trip_id", "trip_no", "vehicle_no", reached.alias("reached_dump"), together.alias("all_stop_together"), stop.alias("stop"),
        F.when(~reached, geo.metres_between(stop, F.col("center"))).alias("short_of_dump_m"),
        (geo.line_length_m(F.col("claimed_route")) / 1000).alias("claimed_km"),
        (F.col("distance_m") / 1000).alias("driven_km"),
        "trips", "hold_trips", "review_trips", "hard_min", "hard_max",
        hard.alias("hard_rules"), soft.alias("soft_rules"),
        family(every, wording.ROUTE_RULES).alias("route_rules"),
        F.when(F.size(own) > 0, family(own, wording.SLIP_RULES)).otherwise(family(every, wording.SLIP_RULES)).alias("slip_rules"),
        family(every, wording.PHOTO_RULES).alias("photo_rules"),
        conflicting.alias("conflicting_field"),
        F.array_contains(own, "R6").alias("has_r6"),
        F.when(F.col("has_r8"), r8).alias("r8"),
        (F.coalesce("_r3", F.lit(0)) > 0).alias("has_r3"), "r3_owner",
        *[c for c in ("start_time", "arrival_time") if c in trips.columns],
    )
    found = drain_findings.groupBy(*KEYS).agg(
        *[F.array_sort(F.collect_set(F.when(F.col("severity") == s, F.col("rule")))).alias(f"_{s}") for s in (wording.HARD, wording.SOFT)]
    )
    bare = drains.select(*KEYS).distinct().join(trips.select(*KEYS).distinct(), KEYS, "left_anti")
    bare = bare.join(found, KEYS, "left").join(r3, KEYS, "left").join(routes, KEYS, "left")
    hard, soft = (F.coalesce(F.col(f"_{s}"), F.array().cast("array<string>")) for s in (wording.HARD, wording.SOFT))
    every = F.array_union(hard, soft)
    return facts.unionByName(bare.select(
        *KEYS, F.lit(True).alias("reached_dump"), F.lit(False).alias("all_stop_together"), F.lit(False).alias("has_r6"),
        (geo.line_length_m(F.col("claimed_route")) / 1000).alias("claimed_km"),
        *[F.lit(0).cast("bigint").alias(c) for c in ("trips", "hold_trips", "review_trips")],
        hard.alias("hard_rules"), soft.alias("soft_rules"),
        *[family(every, names).alias(c) for c, names in (("route_rules", wording.ROUTE_RULES), ("slip_rules", wording.SLIP_RULES), ("photo_rules", wording.PHOTO_RULES))],
        (F.coalesce("_r3", F.lit(0)) > 0).alias("has_r3"), "r3_owner",
    ), allowMissingColumns=True)


def _rule_flags() -> list[Column]:
    return [
        F.max(F.array_contains(f"{s}_fails", r)).alias(f"_{s}_{r}") for s in ("hard", "soft") for r in wording.REASON_ORDER
    ]


def _listed(severity: str) -> Column:
    return F.array_sort(
        F.array_compact(F.array(*[F.when(F.col(f"_{severity}_{r}"), F.lit(r)) for r in wording.REASON_ORDER]))
    )


# Exhibit titles.
TITLES = {
    "two_places": "One truck, logged in two places at once",
    "none_reached": "No truck reached the dump site",
    "never_reached": "Trip %s never reached the dump site",
    "dark": "The GPS trace goes dark on the way",
    "no_trace": "A trip has no GPS trace",
    "reached": "Every trace reaches the dump site",
    "haul": "The haul to the dump site",
    "before_left": "The slip is stamped before the truck left",
    "slip_time": "The slip time does not match the GPS",
    "slip_net": "The slip claims more than the truck carries",
    "slip_plate": "The slip names a different truck",
    "no_slip": "No weighbridge slip for this trip",
    "slip": "The weighbridge slip",
    "filed_first": "The after-photo was filed for drain %s first",
    "filed_twice": "A photo was filed twice",
    "not_silt": "The photographed load is not drain silt",
    "off_drain": "A photo was taken outside the drain",
    "off_window": "A photo was taken outside the work window",
    "no_photo": "No photographs were filed",
    "photos": "The photographs",
    "clean": "Every check passed.",
    "all_held": "Every trip failed %s hard %s.",
    "held": "Every trip failed a hard check.",
    "some_held": "%s of %s trips held",
    "in_review": "%s in review",
    "drain_level": "Flagged at drain level.",
}


def case_titles(facts: DataFrame, colours: DataFrame) -> DataFrame:
    """The headline of each exhibit and the verdict line, by the first condition that holds."""
    f = facts.join(colours.select(*KEYS, F.col("verdict").alias("_colour")), KEYS)

    def title(name, *values):
        return F.format_string(TITLES[name], *values) if values else F.lit(TITLES[name])

    def has(family, rule):
        return F.array_contains(family, rule)

    route = (
        F.when(F.col("has_r6"), title("two_places"))
        .when(~F.col("reached_dump") & F.col("all_stop_together"), title("none_reached"))
        .when(~F.col("reached_dump"), title("never_reached", F.col("trip_no")))
        .when(has("route_rules", "R6"), title("two_places"))
        .when(has("route_rules", "GPS_GAP"), title("dark"))
        .when(has("route_rules", "TRACE_MISSING"), title("no_trace"))
        .when(F.col("_colour").isNull(), title("haul"))
        .otherwise(title("reached"))
    )
    early = clock.minute_of_day(F.col("r8.time_in")) < clock.minute_of_day(F.col("r8.departure"))
    slip = (
        F.when(early, title("before_left"))
        .when(F.col("r8").isNotNull(), title("slip_time"))
        .when(has("slip_rules", "R7"), title("slip_net"))
        .when(has("slip_rules", "R9"), title("slip_plate"))
        .when(has("slip_rules", "SLIP_MISSING"), title("no_slip"))
        .otherwise(title("slip"))
    )
    photo = (
        F.when(F.col("has_r3") & (F.length("r3_owner") > 0), title("filed_first", F.col("r3_owner")))
        .when(F.col("has_r3"), title("filed_twice"))
        .when(has("photo_rules", "R4"), title("not_silt"))
        .when(has("photo_rules", "R1"), title("off_drain"))
        .when(has("photo_rules", "R2"), title("off_window"))
        .when(has("photo_rules", "PHOTOS_MISSING"), title("no_photo"))
        .otherwise(title("photos"))
    )
    k = F.col("hard_min")
    word = F.coalesce(F.get(F.array(*[F.lit(w) for w in WORDS]), k), k.cast("string"))
    held, review, n = F.col("hold_trips"), F.col("review_trips"), F.col("trips")
    parts = F.array_compact(
        F.array(
            F.when(held > 0, title("some_held", held.cast("string"), n.cast("string"))),
            F.when(review > 0, title("in_review", review.cast("string"))),
        )
    )
    line = (
        F.when(F.col("_colour") == wording.GREEN, title("clean"))
        .when((n > 0) & (held == n) & (k == F.col("hard_max")), title("all_held", word, F.when(k == 1, F.lit("check")).otherwise(F.lit("checks"))))
        .when((n > 0) & (held == n), title("held"))
        .when(F.size(parts) > 0, F.concat(F.array_join(parts, ", "), F.lit(".")))
        .otherwise(title("drain_level"))
    )
    return f.select(*KEYS, route.alias("route_title"), slip.alias("slip_title"), photo.alias("photo_title"), line.alias("verdict_line"))


def timeline_events(facts: DataFrame, slips: DataFrame) -> DataFrame:
    """Tidy rows of each drain's focus trip: (lane, place, time, text, bad) events of the
    slip and GPS lanes and the (lead, r8) brackets with their minutes. ``slips`` gives
    time_in and time_out per trip_id; ``facts`` may carry start_time and arrival_time."""

    def maybe(name):
        return F.col(name) if name in facts.columns else F.lit(None).cast("string")

    f = facts.join(slips.select("trip_id", F.col("time_in").alias("_in"), F.col("time_out").alias("_out")), "trip_id", "left")
    departure = F.coalesce(F.col("r8.departure"), clock.hhmm(maybe("start_time")))
    arrival = clock.hhmm(maybe("arrival_time"))
    reached = F.col("reached_dump")
    short = F.coalesce(F.concat(text.fixed(F.col("short_of_dump_m") / 1000, 1), F.lit(" km short")), F.lit("short"))
    last_fix = F.when(F.col("r8.kind") == "lastFix", F.col("r8.compared"))

    def event(lane, place, when, time, words, bad, until=None, minutes=None):
        return F.when(
            when,
            F.struct(
                F.lit(lane).alias("lane"), F.lit(place).alias("place"), time.alias("time"), words.alias("text"), bad.alias("bad"),
                (until if until is not None else F.lit(None).cast("string")).alias("until"),
                (minutes if minutes is not None else F.lit(None)).cast("int").alias("minutes"),
            ),
        )

    never, always = F.lit(False), F.lit(True)
    lead = clock.minute_of_day(F.col("r8.departure")) - clock.minute_of_day(F.col("r8.time_in"))
    against = F.when(F.col("r8.kind") == "lastFix", F.lit("the last GPS fix")).otherwise(F.lit("the GPS arrival at the dump site"))
    events = F.array(
        event("slip", 0, F.length("_in") > 0, F.col("_in"), F.lit("time in"), F.coalesce(F.col("conflicting_field") == "timeIn", never)),
        event("slip", 1, F.length("_out") > 0, F.col("_out"), F.lit("time out"), never),
        event("gps", 0, departure.isNotNull(), departure, F.concat(F.lit("leaves drain "), F.col("drain_id")), never),
        event("gps", 1, reached & arrival.isNotNull(), arrival, F.lit("arrives at the dump site"), never),
        event("gps", 1, ~reached & arrival.isNotNull(), arrival, F.concat(F.lit("stops "), short), always),
        event("gps", 2, ~reached & last_fix.isNotNull() & ~last_fix.eqNullSafe(arrival), last_fix, F.lit("last fix"), always),
        event("bracket", 0, lead > 0, F.col("r8.time_in"),
              F.format_string("Slip time-in is %s min before the truck leaves the drain", lead.cast("string")), always, F.col("r8.departure"), lead),
        event("bracket", 1, F.col("r8.compared").isNotNull(), F.col("r8.time_in"),
              F.format_string("R8: slip time-in against %s, %s min apart. Allowed: 10 min.", against, F.col("r8.minutes").cast("string")),
              always, F.col("r8.compared"), F.col("r8.minutes")),
    )
    return f.select(*KEYS, "trip_id", F.explode(F.array_compact(events)).alias("_e")).select(*KEYS, "trip_id", "_e.*")
