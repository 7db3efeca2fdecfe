"""Bill mode over traces, slips and photos of the same bills."""

from pyspark.sql import functions as F

from loadaudit.functions import geo
from loadaudit.operators import findings, photos as reuse, rollup, traces
from loadaudit.plans import bill
from loadaudit.plans.fixturemap import FIXTURE_LIMITS, Fixture

from . import sqlviews
from .ledger import KEYS, as_doubles, said
from .registry import query, view

KM = "printf('%.1f', km)"


def facts(fx):
    placed = traces.points_in_site(traces.with_times(fx.points), bill.bill_sites(fx.bills, fx.sites))
    return traces.trace_facts(placed)


# ------------------------------------------------------------------ traces
@query("join_04_points_in_site", "SELECT seq, inside FROM v_inside")
def join_04(spark, d):
    fx = Fixture(spark, d)
    return traces.points_in_site(fx.points, bill.bill_sites(fx.bills, fx.sites)).select("seq", "inside")


@query("win_02_max_gap", "SELECT trace_key, gap_s AS max_gap_s FROM v_fact")
def win_02(spark, d):
    return traces.trace_facts(Fixture(spark, d).points).select("trace_key", "max_gap_s")


@query("win_03_arrival", """
SELECT trace_key, entered, coalesce(us_in, us1) AS arrival_us, us0 AS departure_us, n AS n_points, round(lon1, 6) AS last_lon FROM v_fact""")
def win_03(spark, d):
    return facts(Fixture(spark, d)).select(
        "trace_key", "entered", F.col("arrival.epoch_us").alias("arrival_us"), F.col("departure.epoch_us").alias("departure_us"),
        "n_points", F.round("last_point.lon", 6).alias("last_lon"),
    )


view("v_step", f"""
SELECT *, {sqlviews.haversine("plon", "plat", "lon", "lat")} AS step_m, (us - pus) / 1e6 AS secs FROM (
  SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat, lag(us) OVER w AS pus FROM v_point
  WINDOW w AS (PARTITION BY trace_key ORDER BY seq))""")


@query("win_04_trace_quality", """
SELECT trace_key, count(*) AS n_points, round(coalesce(sum(step_m), 0), 1) AS distance_m, coalesce(sum((step_m = 0)::INT), 0)::BIGINT AS repeats,
  round(coalesce(max(CASE WHEN secs > 0 THEN step_m / secs * 3.6 END), 0), 4) AS max_kmh FROM v_step GROUP BY trace_key""")
def win_04(spark, d):
    out = traces.trace_quality(Fixture(spark, d).points, block=512)
    return out.select(
        "trace_key", "n_points", F.round("distance_m", 1).alias("distance_m"), "repeats", F.round("max_kmh", 4).alias("max_kmh")
    )


@query("win_05_backwards", """
SELECT user_id % 25 || '' AS bill_id, user_id || '' AS trace_key, min(event_id) AS backwards_seq FROM (
  SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY event_id) AS pv FROM (SELECT *, floor(value)::BIGINT AS v FROM events)) WHERE v < pv GROUP BY ALL""")
def win_05(spark, d):
    """A user's values read as seconds of a clock, which does run backwards."""
    pts = Fixture(spark, d).table("events").select(
        (F.col("user_id") % 25).cast("string").alias("bill_id"), F.col("user_id").cast("string").alias("trace_key"),
        F.col("event_id").alias("seq"), F.lit(1.0).alias("lon"), F.lit(1.0).alias("lat"),
        (F.floor("value") * 1_000_000).alias("wall_us"), F.lit(None).cast("int").alias("offset_min"),
        (F.floor("value") * 1_000_000).alias("epoch_us"),
    )
    return traces.backwards(pts, block=1000)


@query("flt_02_bbox", """
SELECT bill_id, min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat FROM v_point GROUP BY ALL""")
def flt_02(spark, d):
    return traces.points_bbox(Fixture(spark, d).points, keys=["bill_id"])


@query("win_01_truck_legs", f"""
SELECT trip_id AS leg_id, next_id AS other, round(minutes, 3) AS minutes, round(km, 4) AS km FROM v_pair""")
def win_01(spark, d):
    fx = Fixture(spark, d)
    legs = traces.truck_legs(fx.trace_trips.join(facts(fx), ["bill_id", "trace_key"]), bucket_us=9 * 86_400_000_000)
    return legs.where(F.col("after").isNotNull()).select(
        "leg_id", F.col("after.other").alias("other"), F.round("after.minutes", 3).alias("minutes"), F.round("after.km", 4).alias("km")
    )


def judged(fx):
    """Trips with slip, trace, neighbours and capacity."""
    return bill.Audit(fx.case, FIXTURE_LIMITS).judged_trips


@query("rule_r5", """
SELECT trip_id, 'R5' AS rule, 'hard' AS severity, 'The truck''s GPS trace never enters the approved dump site.' AS message FROM v_ttrip WHERE NOT entered""")
def rule_r5(spark, d):
    fx = Fixture(spark, d)
    trips = fx.trace_trips.join(facts(fx), ["bill_id", "trace_key"], "left").withColumns(
        {"item_found": F.lit(True), "item_status": F.lit("OK"), "item_error": F.lit(None).cast("string")}
    )
    cases = [c for c in bill.trace_cases(FIXTURE_LIMITS) if c.rule == "R5"]
    return said(trips, cases, ["trip_id"])


@query("rule_gap", """
SELECT trip_id, 'GPS_GAP' AS rule, 'soft' AS severity, 'The GPS trace goes dark for ' || round_even(gap_s / 60, 0)::BIGINT || ' minutes.' AS message
FROM v_ttrip WHERE gap_s > 43200""")
def rule_gap(spark, d):
    fx = Fixture(spark, d)
    trips = fx.trace_trips.join(facts(fx), ["bill_id", "trace_key"], "left").withColumns(
        {"item_found": F.lit(True), "item_status": F.lit("OK"), "item_error": F.lit(None).cast("string")}
    )
    cases = [c for c in bill.trace_cases(FIXTURE_LIMITS) if c.rule == "GPS_GAP"]
    return said(trips, cases, ["trip_id"])


@query("rule_r6", f"""
SELECT trip_id, 'R6' AS rule, 'hard' AS severity, 'The same truck is logged on trip ' || other || ' ' || round_even(minutes, 0)::BIGINT || ' minutes and '
  || {KM} || ' km away, which needs ' || round_even(kmh, 0)::BIGINT || ' km/h.' AS message FROM v_clash_side""")
def rule_r6(spark, d):
    fx = Fixture(spark, d)
    legs = traces.truck_legs(fx.trace_trips.join(facts(fx), ["bill_id", "trace_key"]))
    return said(legs.withColumn("trip_id", F.col("leg_id")), bill.r6_cases(FIXTURE_LIMITS), ["trip_id"])


view("v_r8", """
SELECT t.*, s.slip_key IS NOT NULL AS found, s.status, s.time_in, s.net, s.vehicle_no AS slip_vehicle, d.delta, c.capacity,
  strftime(make_timestamp(us_arr), '%H:%M') AS arr_at, strftime(make_timestamp(us0), '%H:%M') AS left_at,
  (us0 // 86400000000 * 86400000000 + (split_part(s.time_in, ':', 1)::INT * 60 + split_part(s.time_in, ':', 2)::INT) * 60000000::BIGINT - us0) / 60e6 AS lead_min
FROM v_ttrip t LEFT JOIN v_tslip s ON s.slip_key = t.trip_id LEFT JOIN v_delta d ON d.trip_id = t.trip_id LEFT JOIN v_uvehicle c ON c.vehicle_no = t.vehicle_no""")


@query("rule_r8", """
SELECT trip_id, 'R8' AS rule, CASE WHEN time_in IS NULL THEN 'soft' ELSE 'hard' END AS severity,
  CASE WHEN time_in IS NULL THEN 'The slip''s time-in could not be read.'
   WHEN entered THEN 'The slip records time-in at ' || time_in || ', ' || round_even(abs(delta), 0)::BIGINT || ' minutes '
     || CASE WHEN delta < 0 THEN 'before' ELSE 'after' END || ' the truck''s GPS reached the dump site at ' || arr_at || '.'
   ELSE 'The slip records time-in at ' || time_in
     || CASE WHEN lead_min < 0 THEN ', ' || round_even(-lead_min, 0)::BIGINT || ' minutes before the truck left the drain at ' || left_at ELSE '' END
     || '. The GPS trace never reaches the dump site; its last fix, at ' || arr_at || ', is ' || round_even(abs(delta), 0)::BIGINT || ' minutes '
     || CASE WHEN delta < 0 THEN 'after' ELSE 'before' END || ' the slip''s time-in.' END AS message
FROM v_r8 WHERE found AND status <> 'ERROR' AND (time_in IS NULL OR abs(delta) > 120)""")
def rule_r8(spark, d):
    fx = Fixture(spark, d)
    slips = fx.trace_slips
    trips = bill.trip_evidence(fx.trace_trips, slips, facts(fx), fx.trace_items)
    return said(bill.with_slip_delta(trips), bill.r8_cases(FIXTURE_LIMITS), ["trip_id"])


# ------------------------------------------------------------------ photos
DIST = """CASE WHEN lon >= clon - 0.003::DOUBLE AND lon < clon + 0.003::DOUBLE AND lat >= clat - 0.003::DOUBLE AND lat < clat + 0.003::DOUBLE THEN 0
 ELSE (SELECT sqrt(power(px - t * vx, 2) + power(py - t * vy, 2)) FROM (SELECT px, py, vx, vy, greatest(0, least(1, (px * vx + py * vy) / (vx * vx + vy * vy))) AS t FROM (
   SELECT (lon - clon) * 111320.0::DOUBLE * cos(radians(clat)) AS px, (lat - clat) * 111320.0::DOUBLE AS py,
     (clon + 0.002::DOUBLE - clon) * 111320.0::DOUBLE * cos(radians(clat)) AS vx, (clat + 0.001::DOUBLE - clat) * 111320.0::DOUBLE AS vy))) END"""
view("v_located", f"""
SELECT p.*, CASE WHEN has_gps THEN {DIST} END AS dist, split_part(s3_key, '/', 4) AS short FROM v_photo p JOIN v_wdrain USING (bill_id, drain_id)""")


@query("join_07_distance_to_drain", "SELECT s3_key, round(dist, 3) AS distance_m FROM v_located")
def photo_distance(spark, d):
    fx = Fixture(spark, d)
    return bill.located_photos(fx.photos, fx.ward_drains).select("s3_key", F.round("distance_m", 3).alias("distance_m"))


@query("rule_r1", """
SELECT s3_key, 'R1' AS rule, CASE WHEN dist > 600 THEN 'hard' ELSE 'soft' END AS severity,
  CASE WHEN NOT has_gps THEN short || ' carries no GPS, so its location cannot be checked.'
   WHEN dist > 600 THEN short || ' was taken ' || round_even(dist, 0)::BIGINT || ' m from the drain, well outside its 30 m geofence.'
   ELSE short || ' was taken ' || round_even(dist, 0)::BIGINT || ' m outside the geofence, within the margin of a consumer GPS fix.' END AS message
FROM v_located WHERE NOT failed AND (NOT has_gps OR dist > 0)""")
def rule_r1(spark, d):
    fx = Fixture(spark, d)
    return said(bill.located_photos(fx.photos, fx.ward_drains), bill.r1_cases(FIXTURE_LIMITS), ["s3_key"])


view("v_r2", """
SELECT s3_key, taken, split_part(s3_key, '/', 4) AS short, failed,
 (taken + INTERVAL 10 HOUR) BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2000-12-31' AS inside FROM v_photo""")


@query("rule_r2", """
SELECT s3_key, 'R2' AS rule, CASE WHEN taken IS NULL THEN 'soft' ELSE 'hard' END AS severity,
  CASE WHEN taken IS NULL THEN short || ' has no timestamp, so it cannot be dated.'
   ELSE short || ' was taken on ' || taken || ', outside the bill''s work window.' END AS message
FROM v_r2 WHERE NOT failed AND (taken IS NULL OR NOT inside)""")
def rule_r2(spark, d):
    fx = Fixture(spark, d)
    return said(bill.dated_photos(fx.photos, fx.bills), bill.r2_cases(), ["s3_key"])


@query("flt_01_in_window", "SELECT s3_key, inside FROM v_r2 WHERE taken IS NOT NULL")
def flt_01(spark, d):
    from loadaudit.functions import clock

    fx = Fixture(spark, d)
    dated = bill.dated_photos(fx.photos, fx.bills).where(F.col("taken").isNotNull())
    return dated.select("s3_key", clock.in_window(F.col("taken"), F.col("window_from"), F.col("window_to")).alias("inside"))


@query("join_05_reuse_pairs", """
SELECT bill_id, s3_key AS copy_key, original AS earlier_key, distance FROM v_reuse_pair""")
def join_05(spark, d):
    """All pairs (earlier, later) within the bit limit; distinct hashes are compared once."""
    from loadaudit.functions import hashing

    photos = Fixture(spark, d).photos.select(
        "bill_id", "s3_key", F.col("p_hash").alias("hash"), F.struct(F.coalesce("timestamp", F.lit("")).alias("t"), "s3_key").alias("at")
    )
    pairs = reuse.near_hashes(photos, ["bill_id"], max_bits=20, hashes_per_group=200).distinct()
    later = photos.join(pairs, ["bill_id", "hash"])
    earlier = photos.select("bill_id", F.col("s3_key").alias("earlier_key"), F.col("hash").alias("other"), F.col("at").alias("earlier_at"))
    return later.join(earlier, ["bill_id", "other"]).where(F.col("earlier_at") < F.col("at")).select(
        "bill_id", F.col("s3_key").alias("copy_key"), "earlier_key", hashing.hamming_hex(F.col("hash"), F.col("other")).alias("distance")
    )


@query("win_06_first_original", "SELECT * FROM v_reuse")
def win_06(spark, d):
    return reuse.first_originals(Fixture(spark, d).photos, max_bits=20, hashes_per_group=200)


@query("rule_r3", """
SELECT p.s3_key, 'R3' AS rule, 'hard' AS severity, split_part(p.s3_key, '/', 4) || ' is the same image as ' || split_part(original, '/', 4)
  || ', already submitted for drain ' || original_owner || '.' AS message FROM v_reuse r JOIN v_photo p USING (bill_id, s3_key) WHERE NOT failed""")
def rule_r3(spark, d):
    fx = Fixture(spark, d)
    return said(bill.reused_photos(fx.photos, FIXTURE_LIMITS, hashes_per_group=200), bill.r3_cases(), ["s3_key"])


view("v_r4", """
SELECT *, CASE WHEN NOT ok THEN 'soft' WHEN role = 'load' AND load_type = 'debris' THEN 'hard' WHEN role = 'load' AND load_type = 'unclear' THEN 'soft'
  WHEN role = 'after' AND NOT cleared THEN 'soft' END AS r4,
  CASE WHEN NOT ok THEN short || ' could not be assessed by the vision model.'
   WHEN role = 'load' AND load_type = 'debris' THEN 'The load in ' || short || ' is construction debris, not drain silt.'
   WHEN role = 'load' AND load_type = 'unclear' THEN 'The load in ' || short || ' could not be identified.'
   WHEN role = 'after' AND NOT cleared THEN short || ' is an after-photo, but the channel does not look cleared.' END AS words
FROM (SELECT *, split_part(s3_key, '/', 4) AS short FROM v_photo) WHERE NOT failed""")


@query("rule_r4", "SELECT s3_key, 'R4' AS rule, r4 AS severity, words AS message FROM v_r4 WHERE r4 IS NOT NULL")
def rule_r4(spark, d):
    return said(Fixture(spark, d).photos, bill.r4_cases(), ["s3_key"])


@query("join_03_photos_by_drain", """
SELECT p.bill_id, p.drain_id, count(*) AS n FROM v_photo p JOIN v_wdrain w ON p.bill_id = w.bill_id AND p.drain_id = w.drain_id WHERE w.d < 5 GROUP BY ALL""")
def join_03(spark, d):
    fx = Fixture(spark, d)
    known = fx.ward_drains.where(F.col("drain_id") < "5")
    return bill.photos_by_drain(fx.photos, known).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------- missing, errors
view("v_gone", """
SELECT t.bill_id, t.trip_id, t.user_id % 7 = 3 AS no_points, t.user_id % 3 = 0 AS no_item, t.user_id % 3 = 1 AS item_error,
  s.slip_key IS NULL AS no_slip, coalesce(s.status = 'ERROR', false) AS slip_error FROM v_ttrip t LEFT JOIN v_tslip s ON s.slip_key = t.trip_id""")


def patchy_case(fx):
    """Traces of some users have no points; some trace items are absent or in error."""
    import dataclasses

    truck = F.split("s3_key", "-")[0].cast("int")
    items = fx.trace_items.where(truck % 3 != 0).withColumn("status", F.when(truck % 3 == 1, F.lit("ERROR")).otherwise(F.lit("OK")))
    return dataclasses.replace(fx.case, points=fx.points.where(F.col("user_id") % 7 != 3), trace_items=items)


@query("rule_miss", """
SELECT trip_id, 'SLIP_MISSING' AS rule, 'No weighbridge slip was ingested for this trip.' AS message FROM v_gone WHERE no_slip
UNION ALL SELECT trip_id, 'TRACE_MISSING', 'No GPS trace was ingested for this trip.' FROM v_gone WHERE no_points AND no_item
UNION ALL SELECT trip_id, 'TRACE_MISSING', 'The GPS trace was ingested but could not be read back, so the route cannot be checked.'
  FROM v_gone WHERE no_points AND NOT no_item AND NOT item_error
UNION ALL SELECT 'drain ' || bill_id || '/' || drain_id, 'PHOTOS_MISSING', 'No photo evidence was ingested for this drain.'
  FROM v_wdrain ANTI JOIN v_photo USING (bill_id, drain_id)""")
def rule_miss(spark, d):
    fx = Fixture(spark, d)
    case = patchy_case(fx)
    trips = bill.trip_evidence(case.trips, case.slips, traces.trace_facts(case.points), case.trace_items)
    cases = [c for c in bill.trace_cases(FIXTURE_LIMITS) + bill.slip_gap_cases() if c.rule.endswith("_MISSING")]
    gone = said(trips, cases, ["trip_id"])
    bare = bill.counted_drains(fx.ward_drains, fx.photos).withColumn("trip_id", F.concat(F.lit("drain "), "bill_id", F.lit("/"), "drain_id"))
    return gone.unionByName(said(bare, bill.photo_gap_cases(), ["trip_id"])).select("trip_id", "rule", "message")


@query("rule_err", """
SELECT trip_id AS key, 'The GPS trace could not be read during ingestion.' AS message FROM v_gone WHERE no_points AND item_error
UNION ALL SELECT trip_id, 'The weighbridge slip could not be read.' FROM v_gone WHERE slip_error
UNION ALL SELECT s3_key, split_part(s3_key, '/', 4) || ' could not be read during ingestion.' FROM v_photo WHERE failed""")
def rule_err(spark, d):
    fx = Fixture(spark, d)
    case = patchy_case(fx)
    trips = bill.trip_evidence(case.trips, case.slips, traces.trace_facts(case.points), case.trace_items)
    cases = [c for c in bill.trace_cases(FIXTURE_LIMITS) + bill.slip_gap_cases() if c.rule == "EVIDENCE_ERROR"]
    failed = said(trips.withColumn("key", F.col("trip_id")), cases, ["key"])
    return failed.unionByName(said(fx.photos.withColumn("key", F.col("s3_key")), bill.error_cases(), ["key"])).select("key", "message")


@query("join_01_trip_evidence", """
SELECT g.bill_id, trip_id, NOT no_slip AS slip_found, slip_error, NOT no_item AS item_found, CASE WHEN NOT no_item THEN CASE WHEN item_error THEN 'ERROR' ELSE 'OK' END END AS item_status,
  CASE WHEN NOT no_points THEN f.n END AS n_points FROM v_gone g LEFT JOIN v_fact f ON f.trace_key = trip_id""")
def join_01(spark, d):
    """Slips, trace facts and trace items, each absent or in error for some trips."""
    case = patchy_case(Fixture(spark, d))
    placed = traces.points_in_site(traces.with_times(case.points), bill.bill_sites(case.bills, case.sites))
    out = bill.trip_evidence(case.trips, case.slips, traces.trace_facts(placed), case.trace_items)
    found = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    error = F.coalesce(F.col("slip_status") == "ERROR", F.lit(False)).alias("slip_error")
    return out.select("bill_id", "trip_id", found("slip_found"), error, found("item_found"), "item_status", "n_points")


GAPS_SQL = """
SELECT b.bill_id, coalesce(g.a, 0) AS trips_without_slip, coalesce(g.b, 0) AS trips_without_trace, 0::BIGINT AS unreadable_traces,
  coalesce(g.c, 0) + coalesce(e.n, 0) AS evidence_errors, coalesce(p.n, 0) AS drains_without_photos
FROM v_bill b
LEFT JOIN (SELECT bill_id, count(*) FILTER (WHERE no_slip) AS a, count(*) FILTER (WHERE no_item) AS b,
  count(*) FILTER (WHERE slip_error) + count(*) FILTER (WHERE item_error) AS c FROM v_gone GROUP BY ALL) g USING (bill_id)
LEFT JOIN (SELECT bill_id, count(*) AS n FROM v_photo WHERE failed GROUP BY ALL) e USING (bill_id)
LEFT JOIN (SELECT bill_id, count(*) AS n FROM v_wdrain ANTI JOIN v_photo USING (bill_id, drain_id) GROUP BY ALL) p USING (bill_id)"""


@query("agg_05_gap_counts", GAPS_SQL)
def agg_05(spark, d):
    return bill.missing_evidence(patchy_case(Fixture(spark, d)))


@query("join_08_missing_evidence", """
SELECT trip_id AS key, 'slip' AS what FROM v_gone WHERE no_slip UNION ALL SELECT trip_id, 'trace' FROM v_gone WHERE no_item
UNION ALL SELECT bill_id || '/' || drain_id, 'photos' FROM v_wdrain ANTI JOIN v_photo USING (bill_id, drain_id)""")
def join_08(spark, d):
    case = patchy_case(Fixture(spark, d))
    no_slip, no_trace, no_photo = bill.missing_rows(case)
    return (
        no_slip.select(F.col("trip_id").alias("key"), F.lit("slip").alias("what"))
        .unionByName(no_trace.select(F.col("trip_id").alias("key"), F.lit("trace").alias("what")))
        .unionByName(no_photo.select(F.concat_ws("/", *KEYS).alias("key"), F.lit("photos").alias("what")))
    )


# ------------------------------------------------------------- whole audit
view("v_photo_rule", """
SELECT bill_id, drain_id, 'EVIDENCE_ERROR' AS rule, 'soft' AS sev FROM v_photo WHERE failed
UNION ALL SELECT bill_id, drain_id, 'R1', CASE WHEN dist > 600 THEN 'hard' ELSE 'soft' END FROM v_located WHERE NOT failed AND (NOT has_gps OR dist > 0)
UNION ALL SELECT bill_id, drain_id, 'R2', CASE WHEN r.taken IS NULL THEN 'soft' ELSE 'hard' END FROM v_r2 r JOIN v_photo p USING (s3_key) WHERE NOT r.failed AND (r.taken IS NULL OR NOT inside)
UNION ALL SELECT p.bill_id, p.drain_id, 'R3', 'hard' FROM v_reuse r JOIN v_photo p USING (bill_id, s3_key) WHERE NOT failed
UNION ALL SELECT bill_id, drain_id, 'R4', r4 FROM v_r4 WHERE r4 IS NOT NULL
UNION ALL SELECT bill_id, drain_id, 'PHOTOS_MISSING', 'soft' FROM v_wdrain ANTI JOIN v_photo USING (bill_id, drain_id)
UNION ALL SELECT w.bill_id, w.drain_id, 'R10', 'soft' FROM v_wdrain w JOIN (SELECT bill_id, drain_id, sum(claimed) AS c FROM v_ttrip GROUP BY ALL) t USING (bill_id, drain_id)
  WHERE c::DOUBLE > coalesce(plausible, length_m * width_m * depth_m * (1.4::DOUBLE * 1.2::DOUBLE))""")
view("v_trip_rule", """
SELECT trip_id, 'R5' AS rule, 'hard' AS sev FROM v_ttrip WHERE NOT entered
UNION ALL SELECT trip_id, 'GPS_GAP', 'soft' FROM v_ttrip WHERE gap_s > 43200
UNION ALL SELECT trip_id, 'R6', 'hard' FROM v_clash_side
UNION ALL SELECT trip_id, 'SLIP_MISSING', 'soft' FROM v_r8 WHERE NOT found
UNION ALL SELECT trip_id, 'EVIDENCE_ERROR', 'soft' FROM v_r8 WHERE status = 'ERROR'
UNION ALL SELECT trip_id, 'R7', CASE WHEN net IS NULL THEN 'soft' ELSE 'hard' END FROM v_r8 WHERE found AND status <> 'ERROR' AND (net IS NULL OR net > capacity)
UNION ALL SELECT trip_id, 'R8', CASE WHEN time_in IS NULL THEN 'soft' ELSE 'hard' END FROM v_r8 WHERE found AND status <> 'ERROR' AND (time_in IS NULL OR abs(delta) > 120)
UNION ALL SELECT trip_id, 'R9', CASE WHEN slip_vehicle IS NULL THEN 'soft' ELSE 'hard' END FROM v_r8 WHERE found AND status <> 'ERROR' AND (slip_vehicle IS NULL OR slip_vehicle <> vehicle_no)""")
view("v_all_rule", """
SELECT trip_id, rule, sev FROM v_trip_rule UNION SELECT t.trip_id, p.rule, p.sev FROM v_ttrip t JOIN v_photo_rule p USING (bill_id, drain_id)""")
view("v_all_trip", """
SELECT t.bill_id, t.drain_id, t.trip_id, t.claimed, coalesce(h.hard, '') AS hard, coalesce(h.soft, '') AS soft,
  CASE WHEN h.hard IS NOT NULL THEN 'HOLD' WHEN h.soft IS NOT NULL THEN 'REVIEW' ELSE 'VERIFIED' END AS verdict
FROM v_ttrip t LEFT JOIN (SELECT trip_id, string_agg(rule, ',' ORDER BY rule) FILTER (WHERE sev = 'hard') AS hard,
  string_agg(rule, ',' ORDER BY rule) FILTER (WHERE sev = 'soft') AS soft FROM v_all_rule GROUP BY ALL) h USING (trip_id)""")
view("v_all_drain", """
SELECT w.bill_id, w.drain_id, w.decision, coalesce(n, 0) AS trip_count, coalesce(c, 0) AS c, coalesce(ver, 0) AS ver, coalesce(rev, 0) AS rev, coalesce(held, 0) AS held,
  coalesce(colour, 'GREEN') AS verdict, coalesce(rules, '') AS failed_rules
FROM v_wdrain w LEFT JOIN (SELECT bill_id, drain_id, count(*) AS n, sum(claimed) AS c, sum(claimed) FILTER (WHERE verdict = 'VERIFIED') AS ver,
  sum(claimed) FILTER (WHERE verdict = 'REVIEW') AS rev, sum(claimed) FILTER (WHERE verdict = 'HOLD') AS held,
  CASE WHEN bool_or(verdict = 'HOLD') THEN 'RED' WHEN bool_or(verdict = 'REVIEW') THEN 'AMBER' ELSE 'GREEN' END AS colour FROM v_all_trip GROUP BY ALL) USING (bill_id, drain_id)
LEFT JOIN (SELECT bill_id, drain_id, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM v_photo_rule GROUP BY ALL) USING (bill_id, drain_id)""")


def audit(fx):
    return bill.evaluate(fx.case, FIXTURE_LIMITS)


@query("rule_all_trips", "SELECT bill_id, drain_id, trip_id, hard AS hard_fails, soft AS soft_fails, verdict FROM v_all_trip")
def rule_all_trips(spark, d):
    out = audit(Fixture(spark, d)).trips
    return out.select(*KEYS, "trip_id", F.array_join("hard_fails", ",").alias("hard_fails"), F.array_join("soft_fails", ",").alias("soft_fails"), "verdict")


@query("rule_all_drains", """
SELECT bill_id, drain_id, trip_count, c::DOUBLE AS claimed_tonnes, verdict, failed_rules,
  (CASE decision WHEN 'APPROVE' THEN ver + rev + held ELSE ver END)::DOUBLE AS verified_tonnes,
  (CASE WHEN decision IS NULL THEN rev ELSE 0 END)::DOUBLE AS review_tonnes,
  (CASE decision WHEN 'APPROVE' THEN 0 WHEN 'HOLD' THEN rev + held ELSE held END)::DOUBLE AS held_tonnes FROM v_all_drain""")
def rule_all_drains(spark, d):
    out = as_doubles(audit(Fixture(spark, d)).drains, "claimed_tonnes", "verified_tonnes", "review_tonnes", "held_tonnes")
    return out.select(
        *KEYS, "trip_count", "claimed_tonnes", "verdict", F.array_join("failed_rules", ",").alias("failed_rules"),
        "verified_tonnes", "review_tonnes", "held_tonnes",
    )


@query("rule_all_findings", """
SELECT rule, sev AS severity, count(*) AS n FROM (SELECT rule, sev FROM v_trip_rule UNION ALL SELECT rule, sev FROM v_photo_rule) GROUP BY ALL""")
def rule_all_findings(spark, d):
    return audit(Fixture(spark, d)).findings.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))
