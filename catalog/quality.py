"""Quality jobs, case facts, details, control and the streaming forms."""

from pyspark.sql import functions as F

from loadaudit.functions import geo, money
from loadaudit.operators import casefacts, control, findings, quality, traces
from loadaudit.plans import bill, case
from loadaudit.plans.details import validate_details
from loadaudit.plans.fixturemap import FIXTURE_LIMITS, Fixture
from loadaudit.plans.staging import stage
from loadaudit.sources import tables
from loadaudit.sources.files import key_fields
from loadaudit.streaming import streams

from . import sqlviews
from .bill import audit
from .ledger import KEYS
from .registry import query, view
from .sources import _fresh


# --------------------------------------------------------- nearest, checks
def hub_drains(fx):
    """A fenced drain per supplier around the points, plus far ones."""
    k = F.col("s_suppkey")
    lon, lat = F.lit(72.80) + (k % 20) * 0.005, F.lit(19.00) + F.floor(k / 20) % 5 * 0.01
    fence = F.when(k % 3 != 0, F.array(F.array(F.array(*[geo.pt(lon + x, lat + y) for x, y in ((-0.001, -0.001), (0.001, -0.001), (0.001, 0.001), (-0.001, 0.001))]))))
    return fx.table("supplier").select(
        k.cast("string").alias("drain_id"), k.alias("place"), fence.alias("geofence"), F.array(geo.pt(lon, lat), geo.pt(lon + 0.002, lat + 0.001)).alias("centreline")
    )


view("q_drain", """
SELECT s_suppkey AS k, 72.80::DOUBLE + (s_suppkey % 20) * 0.005::DOUBLE AS clon, 19.00::DOUBLE + (s_suppkey // 20) % 5 * 0.01::DOUBLE AS clat, s_suppkey % 3 <> 0 AS fenced FROM supplier""")
view("q_dist", """
SELECT seq, k, CASE WHEN fenced AND lon >= clon - 0.001::DOUBLE AND lon < clon + 0.001::DOUBLE AND lat >= clat - 0.001::DOUBLE AND lat < clat + 0.001::DOUBLE THEN 0 ELSE
  sqrt(power(px - t * vx, 2) + power(py - t * vy, 2)) END AS d FROM (SELECT *, greatest(0, least(1, (px * vx + py * vy) / (vx * vx + vy * vy))) AS t FROM (
   SELECT *, (lon - clon) * 111320.0::DOUBLE * cos(radians(clat)) AS px, (lat - clat) * 111320.0::DOUBLE AS py,
    (clon + 0.002::DOUBLE - clon) * 111320.0::DOUBLE * cos(radians(clat)) AS vx, (clat + 0.001::DOUBLE - clat) * 111320.0::DOUBLE AS vy FROM v_point, q_drain))""")


@query("join_07_locate", """
SELECT seq AS point_id, arg_min(k, {'d': d, 'k': k})::VARCHAR AS drain_id, round(min(d), 3) AS distance_m FROM q_dist GROUP BY ALL""")
def join_07(spark, d):
    fx = Fixture(spark, d)
    out = quality.locate(fx.points.withColumnRenamed("seq", "point_id"), hub_drains(fx))
    return out.select("point_id", "drain_id", F.round("distance_m", 3).alias("distance_m"))


@query("join_09_reconcile", """
SELECT trip_id AS s3_key, CASE WHEN l_linenumber >= 6 THEN 'blocking' ELSE level END AS level, CASE WHEN l_linenumber >= 6 THEN 'status' ELSE field END AS field FROM (
 SELECT *, unnest(CASE WHEN l_linenumber >= 6 THEN [{'level': 'x', 'field': 'x'}] ELSE list_filter([
  CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN {'level': 'blocking', 'field': 'vehicle_no'} END, CASE WHEN l_tax = 0 THEN {'level': 'blocking', 'field': 'net'} END,
  CASE WHEN l_orderkey % 7 = 0 THEN {'level': 'warning', 'field': 'ticket_no'} END, CASE WHEN l_orderkey % 5 = 0 THEN {'level': 'warning', 'field': 'gross'} END], lambda x: x IS NOT NULL) END, recursive := true) FROM v_load)""")
def join_09(spark, d):
    fx = Fixture(spark, d)
    o = F.col("l_orderkey")
    none = F.lit(None).cast("string")
    printed = fx._loads.select(
        F.col("trip_id").alias("s3_key"), F.col("l_partkey").cast("string").alias("vehicle_no"), F.col("l_quantity").alias("net"), F.lit("07:00").alias("time_in"),
        F.concat(F.lit("wb "), o.cast("string")).alias("ticket_no"), (F.col("l_quantity") + 8).alias("gross"), F.lit(8.0).alias("tare"), none.alias("time_out"), F.lit("Site  A").alias("site"),
    )
    extra = fx._loads.select(F.col("trip_id").alias("s3_key"), o.alias("o"), F.col("l_quantity").alias("q"))
    read = fx.weighed_slips.join(extra, "s3_key").select(
        "s3_key", "status", "vehicle_no", "net", F.lit("07:00").alias("time_in"),
        F.concat(F.when(F.col("o") % 7 == 0, F.lit("WX ")).otherwise(F.lit("WB ")), F.col("o").cast("string")).alias("ticket_no"),
        (F.col("q") + 8 + F.when(F.col("o") % 5 == 0, 0.01).otherwise(0.004)).alias("gross"), F.lit(8.0).alias("tare"), none.alias("time_out"), F.lit(" site a").alias("site"),
    )
    return quality.reconcile(printed, read).select("s3_key", "level", "field")


@query("join_10_verdict_diff", """
SELECT bill_id, drain_id, field FROM (SELECT bill_id, drain_id, unnest(list_filter([CASE WHEN drain_id::INT % 3 = 0 THEN 'verdict' END, CASE WHEN drain_id::INT % 4 = 0 THEN 'trip_count' END,
  CASE WHEN drain_id::INT % 5 = 0 THEN 'claimed_tonnes' END], lambda x: x IS NOT NULL)) AS field FROM v_ssplit)""")
def join_10(spark, d):
    from .ledger import ledger_trips
    from loadaudit.operators import rollup

    actual = rollup.drain_split(ledger_trips(Fixture(spark, d)))
    k = F.col("drain_id").cast("int")
    expected = actual.withColumns(
        {
            "verdict": F.when(k % 3 == 0, F.lit("BLUE")).otherwise(F.col("verdict")),
            "trip_count": F.col("trip_count") + F.when(k % 4 == 0, 1).otherwise(0),
            "claimed_tonnes": F.col("claimed_tonnes") + F.when(k % 5 == 0, F.lit("0.1").cast(money.TONNES)).otherwise(F.lit("0.04").cast(money.TONNES)),
        }
    )
    return quality.verdict_diff(expected, actual, KEYS, ["verdict", "trip_count"], ["claimed_tonnes"]).select(*KEYS, "field")


@query("dq_02_audit_hashes", """
SELECT problem, a, b, distance FROM (
SELECT 'copy too far' AS problem, 'p' || (vec_id + 100000) AS a, 'p' || vec_id AS b, 4 AS distance FROM v_photo WHERE vec_id % 10 = 0
UNION ALL SELECT 'unrelated too close', ka, kb, dist FROM q_close
UNION ALL SELECT 'unrelated too close', least('p' || vec_id, 'q' || vec_id), greatest('p' || vec_id, 'q' || vec_id), 0 FROM v_photo WHERE vec_id % 10 = 1)""")
def dq_02(spark, d):
    """Every tenth photo has a declared exact copy that differs in four bits, every next
    one an undeclared twin."""
    photos = Fixture(spark, d).photos.select("vec_id", "p_hash")
    flip = F.translate(F.substring("p_hash", 1, 1), "0123456789abcdef", "fedcba9876543210")
    edited = F.concat(flip, F.substring("p_hash", 2, 15))
    name = lambda p, n=0: F.concat(F.lit(p), (F.col("vec_id") + n).cast("string"))
    copy_rows = photos.where(F.col("vec_id") % 10 == 0)
    every = (
        photos.select(name("p").alias("key"), "p_hash")
        .unionByName(copy_rows.select(name("p", 100000).alias("key"), edited.alias("p_hash")))
        .unionByName(photos.where(F.col("vec_id") % 10 == 1).select(name("q").alias("key"), "p_hash"))
    )
    copies = copy_rows.select(name("p", 100000).alias("key"), name("p").alias("source"), F.lit("exact copy").alias("kind"))
    out = quality.audit_hashes(every, copies, unrelated_bits=16, hashes_per_group=500)
    shown = [F.when(F.col("problem") == "copy too far", F.col("a")).otherwise(F.least("a", "b")).alias("a"), F.when(F.col("problem") == "copy too far", F.col("b")).otherwise(F.greatest("a", "b")).alias("b")]
    return out.select("problem", *shown, "distance")


view("q_hashed", """
SELECT 'p' || vec_id AS key, vec_id AS family, bits FROM v_photo
UNION ALL SELECT 'p' || (vec_id + 100000), vec_id, list_transform(list_zip(bits, range(0, 64)), lambda z: CASE WHEN z[2] < 4 THEN NOT z[1]::BOOL ELSE z[1]::BOOL END) FROM v_photo WHERE vec_id % 10 = 0""")
view("q_close", """
SELECT a.key AS ka, b.key AS kb, 64 - list_sum(list_transform(list_zip(a.bits, b.bits), lambda z: (z[1] = z[2])::INT))::INT AS dist
FROM q_hashed a JOIN q_hashed b ON a.key < b.key AND a.family <> b.family WHERE 64 - list_sum(list_transform(list_zip(a.bits, b.bits), lambda z: (z[1] = z[2])::INT)) <= 16""")


@query("dq_03_field_report", """
SELECT bill_id, s3_key AS name, CASE WHEN vec_id % 31 = 0 THEN 'no_exif' WHEN NOT has_gps THEN 'no_gps' WHEN best > 0 THEN 'outside' ELSE 'inside' END AS state,
 CASE WHEN vec_id % 31 <> 0 AND has_gps THEN best_drain END AS drain_id, CASE WHEN vec_id % 31 <> 0 AND has_gps THEN round(best, 3) END AS distance_m
FROM v_photo LEFT JOIN (SELECT vec_id AS v, arg_min(drain_id, {'d': dd, 'i': drain_id}) AS best_drain, min(dd) AS best FROM q_photo_dist GROUP BY ALL) ON v = vec_id""")
def dq_03(spark, d):
    fx = Fixture(spark, d)
    problems = F.when(F.col("vec_id") % 31 == 0, F.array(F.lit("no_exif"))).otherwise(F.array().cast("array<string>"))
    photos = fx.photos.select("bill_id", F.col("s3_key").alias("name"), problems.alias("problems"), "has_gps", "lon", "lat", "p_hash")
    drains = fx.ward_drains.withColumn("place", F.col("drain_id").cast("int"))
    report, _ = quality.field_report(photos, drains, by=("bill_id",))
    return report.select("bill_id", "name", "state", "drain_id", F.round("distance_m", 3).alias("distance_m"))


view("q_photo_dist", """
SELECT vec_id, drain_id, CASE WHEN lon >= clon - 0.003::DOUBLE AND lon < clon + 0.003::DOUBLE AND lat >= clat - 0.003::DOUBLE AND lat < clat + 0.003::DOUBLE THEN 0 ELSE sqrt(power(px - t * vx, 2) + power(py - t * vy, 2)) END AS dd
FROM (SELECT *, greatest(0, least(1, (px * vx + py * vy) / (vx * vx + vy * vy))) AS t FROM (SELECT p.vec_id, w.drain_id, p.lon, p.lat, clon, clat, (lon - clon) * 111320.0::DOUBLE * cos(radians(clat)) AS px, (lat - clat) * 111320.0::DOUBLE AS py,
  (clon + 0.002::DOUBLE - clon) * 111320.0::DOUBLE * cos(radians(clat)) AS vx, (clat + 0.001::DOUBLE - clat) * 111320.0::DOUBLE AS vy FROM v_photo p JOIN v_wdrain w ON w.bill_id = p.bill_id WHERE has_gps))""")


@query("dq_04_check_targets", """
SELECT bill_id, 'claimed' AS what FROM v_ssummary WHERE bill_id::INT % 3 = 0 UNION ALL SELECT bill_id, 'drain ' || drain_id FROM v_ssplit WHERE colour <> CASE WHEN drain_id::INT % 2 = 0 THEN 'RED' ELSE 'GREEN' END""")
def dq_04(spark, d):
    from .ledger import ledger_drains
    from loadaudit.operators import rollup

    fx = Fixture(spark, d)
    drains = ledger_drains(fx)
    sums = rollup.bill_summary(drains, fx.bills).select("bill_id", F.lit("claimed").alias("name"), F.col("claimed_tonnes").cast("double").alias("value"))
    targets = sums.withColumn("value", F.col("value") + F.when(F.col("bill_id").cast("int") % 3 == 0, 0.6).otherwise(0.4))
    colours = fx.supplier_drains.where(F.col("drain_id").cast("int") % 2 == 0).select(*KEYS, F.lit("RED").alias("colour"))
    return quality.check_targets(sums, targets, drains, colours).select("bill_id", "what")


# -------------------------------------------------------------- case facts
view("f_rows", """
SELECT bill_id, drain_id, NULL AS trip_id, rule, sev FROM v_photo_rule UNION ALL SELECT t.bill_id, t.drain_id, r.trip_id, r.rule, r.sev FROM v_trip_rule r JOIN v_ttrip t USING (trip_id)""")


@query("agg_06_distinct_findings", """
SELECT bill_id, drain_id, count(*) AS n FROM (SELECT DISTINCT bill_id, drain_id, s3_key, 'R3' AS r FROM v_reuse JOIN (SELECT s3_key, drain_id, failed FROM v_photo) p USING (s3_key) WHERE NOT failed) GROUP BY ALL""")
def agg_06(spark, d):
    """Reuse findings, whose sentence names the photo, listed twice and reduced again."""
    fx = Fixture(spark, d)
    rows = findings.explode_findings(bill.reused_photos(fx.photos, FIXTURE_LIMITS, hashes_per_group=200), bill.r3_cases(), [*KEYS, "s3_key"])
    twice = rows.unionByName(rows).withColumn("trip_id", F.lit(None).cast("string"))
    return findings.distinct_findings(twice).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))


@query("agg_06_first_per_rule", "SELECT bill_id, drain_id, rule FROM f_rows GROUP BY ALL")
def agg_06_rules(spark, d):
    return findings.first_per_rule(audit(Fixture(spark, d)).findings).select(*KEYS, "rule")


RANKS = "['R3', 'R5', 'R8', 'R4', 'R7', 'R6', 'R9', 'R2', 'R1', 'R10', 'GPS_GAP', 'SLIP_MISSING', 'TRACE_MISSING', 'PHOTOS_MISSING', 'EVIDENCE_ERROR']"


@query("agg_07_reason_for", f"""
SELECT bill_id, drain_id, {RANKS}[min(list_position({RANKS}, rule))] AS rule FROM f_rows GROUP BY ALL""")
def agg_07(spark, d):
    """The rule of the weightiest reason, found again from its sentence."""
    found = audit(Fixture(spark, d)).findings
    reason = findings.reason_for(found)
    named = found.select(*KEYS, "rule", F.col("message").alias("reason")).distinct()
    return reason.join(named, [*KEYS, "reason"]).select(*KEYS, "rule").distinct()


view("f_trip", """
SELECT a.bill_id, a.drain_id, a.trip_id, a.verdict, a.hard, a.soft, NOT t.entered AS r5, t.us0, t.us_arr, t.entered, t.lon1, t.lat1, t.user_id FROM v_all_trip a JOIN v_ttrip t USING (trip_id)""")
view("f_focus", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bill_id, drain_id ORDER BY CASE WHEN verdict = 'HOLD' AND r5 THEN 0 WHEN verdict = 'HOLD' THEN 1 WHEN verdict = 'REVIEW' THEN 2 ELSE 3 END, trip_id) AS rn FROM f_trip) WHERE rn = 1""")


@query("win_08_focus_trip", "SELECT bill_id, drain_id, trip_id FROM f_focus")
def win_08(spark, d):
    return casefacts.focus_trip(casefacts.judged(audit(Fixture(spark, d))))


def facts_of(fx):
    a = audit(fx)
    trips = stage(casefacts.judged(a), "judged-trips")
    lengths = traces.trace_quality(fx.points, block=512).select("bill_id", "trace_key", "distance_m")
    sites = bill.bill_sites(fx.bills, fx.sites)
    return a, casefacts.case_facts(trips, fx.case.drains, a.drain_findings, sites, tables.claimed_route(fx.case), lengths)


@query("agg_08_case_facts", f"""
SELECT f.bill_id, f.drain_id, f.trip_id, NOT f.r5 AS reached_dump, n AS trips, h AS hold_trips, r AS review_trips, hard_rules,
 CASE WHEN f.r5 AND f.bill_id <> '24' THEN round({sqlviews.haversine("lon1", "lat1", "72.85::DOUBLE", "19.005::DOUBLE")}, 1) END AS short_of_dump_m,
 CASE WHEN ',' || f.hard || ',' || f.soft || ',' LIKE '%,R8,%' THEN 'timeIn' WHEN ',' || f.hard || ',' || f.soft || ',' LIKE '%,R7,%' THEN 'net' WHEN ',' || f.hard || ',' || f.soft || ',' LIKE '%,R9,%' THEN 'vehicleNo' END AS conflicting_field
FROM f_focus f JOIN (SELECT bill_id, drain_id, count(*) AS n, count(*) FILTER (WHERE verdict = 'HOLD') AS h, count(*) FILTER (WHERE verdict = 'REVIEW') AS r FROM f_trip GROUP BY ALL) USING (bill_id, drain_id)
LEFT JOIN (SELECT bill_id, drain_id, string_agg(DISTINCT rule, ',' ORDER BY rule) AS hard_rules FROM f_rows WHERE sev = 'hard' GROUP BY ALL) USING (bill_id, drain_id)
UNION ALL BY NAME
SELECT w.bill_id, w.drain_id, NULL::VARCHAR AS trip_id, true AS reached_dump, 0::BIGINT AS trips, 0::BIGINT AS hold_trips, 0::BIGINT AS review_trips, hard_rules, NULL::DOUBLE AS short_of_dump_m, NULL::VARCHAR AS conflicting_field
FROM (SELECT bill_id, drain_id FROM v_wdrain ANTI JOIN f_trip USING (bill_id, drain_id)) w
LEFT JOIN (SELECT bill_id, drain_id, string_agg(DISTINCT rule, ',' ORDER BY rule) AS hard_rules FROM f_rows WHERE sev = 'hard' GROUP BY ALL) USING (bill_id, drain_id)""")
def agg_08(spark, d):
    _, facts = facts_of(Fixture(spark, d))
    return facts.select(
        *KEYS, "trip_id", "reached_dump", "trips", "hold_trips", "review_trips", F.nullif(F.array_join("hard_rules", ","), F.lit("")).alias("hard_rules"),
        F.when(~F.col("all_stop_together"), F.round("short_of_dump_m", 1)).alias("short_of_dump_m"), "conflicting_field",
    )


@query("agg_10_case_titles", """
SELECT f.bill_id, f.drain_id, CASE WHEN n = 1 AND h = 1 THEN 'one' WHEN h = n THEN 'all' WHEN h > 0 AND r > 0 THEN h || ' of ' || n || ' trips held, ' || r || ' in review.'
  WHEN h > 0 THEN h || ' of ' || n || ' trips held.' WHEN r > 0 THEN r || ' in review.' WHEN f.bill_id = '5' THEN 'Flagged at drain level.' ELSE 'Every check passed.' END AS verdict_line,
 CASE WHEN ',' || f.hard || ',' LIKE '%,R6,%' THEN 'One truck, logged in two places at once' WHEN f.r5 THEN 'Trip ' || f.trip_id || ' never reached the dump site'
  WHEN f.bill_id = '5' AND NOT EXISTS (SELECT 1 FROM f_rows x WHERE x.bill_id = f.bill_id AND x.drain_id = f.drain_id AND x.rule IN ('R6', 'GPS_GAP', 'TRACE_MISSING')) THEN 'The haul to the dump site' ELSE 'other' END AS route_title
FROM f_focus f JOIN (SELECT bill_id, drain_id, count(*) AS n, count(*) FILTER (WHERE verdict = 'HOLD') AS h, count(*) FILTER (WHERE verdict = 'REVIEW') AS r FROM f_trip GROUP BY ALL) USING (bill_id, drain_id)
UNION ALL SELECT bill_id, drain_id, CASE WHEN bill_id = '5' THEN 'Flagged at drain level.' ELSE 'Every check passed.' END, CASE WHEN bill_id = '5' THEN 'The haul to the dump site' ELSE 'other' END
FROM v_wdrain ANTI JOIN f_trip USING (bill_id, drain_id)""")
def agg_10(spark, d):
    """Drains without trips among them; one bill's drains have no verdict yet."""
    a, facts = facts_of(Fixture(spark, d))
    facts = stage(facts, "case-facts")
    colours = a.drains.withColumn("verdict", F.when(F.col("bill_id") != "5", F.col("verdict")))
    titles = casefacts.case_titles(facts, colours).join(facts.select(*KEYS, "trips", "hold_trips", "reached_dump", "has_r6"), KEYS)
    line = F.when((F.col("trips") == 1) & (F.col("hold_trips") == 1), F.lit("one")).when((F.col("trips") > 0) & (F.col("trips") == F.col("hold_trips")), F.lit("all")).otherwise(F.col("verdict_line"))
    shown = F.col("has_r6") | ~F.col("reached_dump") | F.col("route_title").startswith("The haul")
    route = F.when(shown, F.col("route_title")).otherwise(F.lit("other"))
    return titles.select(*KEYS, line.alias("verdict_line"), route.alias("route_title"))


view("f_time", """
SELECT f.*, s.time_in, coalesce(abs(d.delta) > 120, false) AND s.status <> 'ERROR' AND s.time_in IS NOT NULL AS r8, d.delta,
 strftime(make_timestamp(us0), '%H:%M') AS left_at, strftime(make_timestamp(us_arr), '%H:%M') AS arr_at,
 hour(make_timestamp(us0)) * 60 + minute(make_timestamp(us0)) - split_part(s.time_in, ':', 1)::INT * 60 - split_part(s.time_in, ':', 2)::INT AS lead_min
FROM f_focus f LEFT JOIN v_tslip s ON s.slip_key = f.trip_id LEFT JOIN v_delta d ON d.trip_id = f.trip_id""")


@query("agg_11_timeline", """
SELECT bill_id, drain_id, 'slip' AS lane, 0 AS place, time_in AS time, ',' || hard || ',' || soft || ',' LIKE '%,R8,%' AS bad FROM f_time WHERE time_in IS NOT NULL
UNION ALL SELECT bill_id, drain_id, 'slip', 1, '17:45', false FROM f_time JOIN (SELECT slip_key AS trip_id FROM v_tslip) USING (trip_id)
UNION ALL SELECT bill_id, drain_id, 'gps', 0, CASE WHEN r8 THEN left_at ELSE '06:30' END, false FROM f_time
UNION ALL SELECT bill_id, drain_id, 'gps', 1, '08:15', r5 FROM f_time
UNION ALL SELECT bill_id, drain_id, 'gps', 2, arr_at, true FROM f_time WHERE r8 AND r5 AND arr_at <> '08:15'
UNION ALL SELECT bill_id, drain_id, 'bracket', 0, time_in, true FROM f_time WHERE r8 AND lead_min > 0
UNION ALL SELECT bill_id, drain_id, 'bracket', 1, time_in, true FROM f_time WHERE r8""")
def agg_11(spark, d):
    fx = Fixture(spark, d)
    _, facts = facts_of(fx)
    told = lambda t: F.when(F.col("trip_id").isNotNull(), F.lit(t))
    facts = facts.withColumns({"start_time": told("2026-09-25T06:30:00+05:30"), "arrival_time": told("2026-09-25T08:15:00+05:30")})
    slips = fx.trace_slips.select(F.col("s3_key").alias("trip_id"), "time_in", F.lit("17:45").alias("time_out"))
    return casefacts.timeline_events(facts, slips).select(*KEYS, "lane", "place", "time", "bad")


# ----------------------------------------------------------------- details
DETAIL = """{"drainLocation":{"point":[%s,19.0],"toleranceM":%s,"name":"  A   b "},"claim":{"quantityTonnes":%s},"truck":{"vehicleNo":"wb-%s"},"workWindow":{"start":"2026-01-01T00:00:00Z","end":"%s"}%s}"""


def detail_texts(fx):
    c = F.col("c_custkey")
    lon = F.when(c % 6 == 0, F.lit("181.5")).when(c % 6 == 1, F.lit('"x"')).otherwise(F.lit("72.5"))
    tolerance = F.when(c % 7 == 0, F.lit("4")).otherwise(F.lit("40"))
    quantity = F.when(c % 5 == 0, F.lit("0")).when(c % 5 == 1, F.lit("true")).otherwise(F.lit("12.5"))
    end = F.when(c % 4 == 0, F.lit("2025-01-01T00:00:00Z")).when(c % 4 == 1, F.lit("2026-03-01T00:00:00")).when(c % 4 == 2, F.lit("soon")).otherwise(F.lit("2026-03-01T00:00:00Z"))
    tail = F.when(c % 9 == 0, F.lit(',"disposalSite":null,"extra":1')).otherwise(F.lit(""))
    body = F.format_string(DETAIL, lon, tolerance, quantity, c.cast("string"), end, tail)
    return fx.table("customer").select(c.cast("string").alias("case_id"), F.when(c % 50 == 7, F.lit("{}")).otherwise(body).alias("details"))


view("d_case", "SELECT c_custkey AS c, c_custkey::VARCHAR AS case_id FROM customer WHERE c_custkey % 50 <> 7")


@query("chk_det_errors", """
SELECT case_id, 'drainLocation.point' AS field, CASE c % 6 WHEN 0 THEN 'must be at most 180' ELSE 'must be [longitude, latitude]' END AS message FROM d_case WHERE c % 6 < 2
UNION ALL SELECT case_id, 'drainLocation.toleranceM', 'must be at least 5' FROM d_case WHERE c % 7 = 0
UNION ALL SELECT case_id, 'claim.quantityTonnes', 'give at least one of quantity, rate or amount' FROM d_case WHERE c % 5 < 2
UNION ALL SELECT case_id, 'workWindow.end', CASE c % 4 WHEN 0 THEN 'must be after the start' WHEN 1 THEN 'give both times with a timezone offset, or neither' ELSE 'must be an ISO 8601 date-time' END FROM d_case WHERE c % 4 < 3
UNION ALL SELECT case_id, 'extra', 'is not a trial detail' FROM d_case WHERE c % 9 = 0
UNION ALL SELECT c_custkey::VARCHAR, 'body', 'nothing to update' FROM customer WHERE c_custkey % 50 = 7""")
def chk_det_errors(spark, d):
    return validate_details(detail_texts(Fixture(spark, d)))[1]


@query("chk_det_accepted", """
SELECT c_custkey::VARCHAR AS case_id, CASE WHEN k AND c_custkey % 6 >= 2 AND c_custkey % 7 <> 0 THEN 'A b' END AS drain_name, CASE WHEN k AND c_custkey % 5 >= 2 THEN 12.5::DOUBLE END AS quantity,
 CASE WHEN k THEN 'WB ' || c_custkey END AS vehicle_no, CASE WHEN k AND c_custkey % 4 = 3 THEN '2026-03-01T00:00:00+00:00' END AS window_end, k AND c_custkey % 9 = 0 AS site_cleared FROM (SELECT *, c_custkey % 50 <> 7 AS k FROM customer)""")
def chk_det_accepted(spark, d):
    out = validate_details(detail_texts(Fixture(spark, d)))[0]
    return out.select(
        "case_id", F.col("drain.name").alias("drain_name"), F.col("claim.quantity_tonnes").alias("quantity"), F.col("truck.vehicle_no").alias("vehicle_no"),
        F.col("window.end").alias("window_end"), F.array_contains("cleared", "disposalSite").alias("site_cleared"),
    )


# ----------------------------------------------------------------- control
STATE_SQL = "CASE event_type WHEN 'signup' THEN 'UPLOADING' WHEN 'view' THEN 'UPLOADED' WHEN 'click' THEN 'QUEUED' WHEN 'purchase' THEN 'READY' ELSE 'FAILED' END"


def event_items(fx):
    e, k = F.col("event_type"), F.col("event_id")
    state = F.when(e == "signup", F.lit("UPLOADING")).when(e == "view", F.lit("PROCESSING")).when(e == "click", F.lit("QUEUED")).when(e == "purchase", F.lit("READY")).otherwise(F.lit("FAILED"))
    return fx.table("events").select(
        k.alias("event_id"), state.alias("state"), F.when(k % 3 == 0, F.lit("photo")).when(k % 3 == 1, F.lit("slip")).otherwise(F.lit("trace")).alias("grp"),
        (k % 5).cast("int").alias("attempts"), F.when(k % 4 == 0, F.lit("FILE_TOO_LARGE")).otherwise(F.lit("TIMEOUT")).alias("error_code"), (k % 2 == 0).alias("vision_ran"),
        (F.lit(1000) + k % 300).alias("lease_until"), F.when(k % 7 != 0, F.lit(500) + k % 300).alias("updated_at"),
        F.when(k % 11 == 0, F.lit("broken")).alias("error_message"),
    )


view("o_item", """
SELECT *, CASE st WHEN 'PROCESSING' THEN 1000 + event_id % 300 < 1150 WHEN 'QUEUED' THEN event_id % 7 = 0 OR 500 + event_id % 300 + 600 < 1150 ELSE false END AS stuck FROM (
 SELECT event_id, CASE event_type WHEN 'signup' THEN 'UPLOADING' WHEN 'view' THEN 'PROCESSING' WHEN 'click' THEN 'QUEUED' WHEN 'purchase' THEN 'READY' ELSE 'FAILED' END AS st,
  CASE event_id % 3 WHEN 0 THEN 'photo' WHEN 1 THEN 'slip' ELSE 'trace' END AS grp FROM events)""")


@query("str_08_stalled", """
SELECT event_id, stuck AS stalled, event_id % 5 < 3 AND ((grp <> 'trace' AND stuck) OR (st = 'FAILED' AND event_id % 4 <> 0) OR (st = 'READY' AND grp = 'photo' AND event_id % 2 <> 0)) AS retryable FROM o_item""")
def str_08(spark, d):
    return control.stalled(event_items(Fixture(spark, d)), F.lit(1150)).select("event_id", "stalled", "retryable")


@query("flt_04_split_ready", """
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'broken' WHEN st = 'UPLOADING' THEN 'Upload was never completed.' WHEN stuck THEN 'Processing did not finish; retry or remove this file.' ELSE st END AS reason FROM o_item WHERE st <> 'READY'
UNION ALL SELECT event_id, NULL FROM o_item WHERE st = 'READY'""")
def flt_04(spark, d):
    ready, rest = case.split_ready(event_items(Fixture(spark, d)), F.lit(1150))
    return rest.select("event_id", "reason").unionByName(ready.select("event_id", F.lit(None).cast("string").alias("reason")))


@query("str_11_retention", "SELECT event_id FROM events WHERE epoch_us(ts) // 1000000 + 172800 > epoch_us(TIMESTAMP '2024-01-20') // 1000000")
def str_11(spark, d):
    rows = Fixture(spark, d).table("events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("created_at"))
    return control.expire(rows, F.lit(1705708800)).select("event_id")


@query("str_09_admit_calls", """
SELECT event_id, case_ok AND row_number() OVER (PARTITION BY d, event_type, case_ok ORDER BY event_id) <= CASE event_type WHEN 'click' THEN 20 WHEN 'view' THEN 15 ELSE 0 END AS admitted FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) <= 8 AS case_ok, ts::DATE AS d FROM events)""")
def str_09(spark, d):
    calls = Fixture(spark, d).table("events").select("event_id", F.col("user_id").alias("case_id"), F.col("event_type").alias("kind"), F.to_date("ts").alias("day"))
    kinds = calls.select("kind").distinct()
    daily = kinds.where(F.col("kind").isin("click", "view")).select("kind", F.when(F.col("kind") == "click", 20).otherwise(15).alias("limit"))
    each = kinds.select("kind", F.lit(8).alias("limit"))
    return control.admit_calls(calls, daily, each, ["event_id"], F.floor(F.col("event_id") / 1000)).select("event_id", "admitted")


BUDGET = control.Budget(max_files=6, max_bytes=9000, group_files={"en": 3, "fr": 2, "de": 2, "es": 1})


@query("str_10_admit_files", """
SELECT doc_id, admitted FROM (WITH RECURSIVE o AS (SELECT doc_id, source, lang, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
f AS (SELECT source, 0::BIGINT AS i, NULL::BIGINT AS doc_id, false AS admitted, 0::BIGINT AS files, 0::BIGINT AS b, 0 AS en, 0 AS fr, 0 AS de, 0 AS es FROM (SELECT DISTINCT source FROM documents)
 UNION ALL SELECT q.source, q.i, q.doc_id, q.ok, q.files + q.ok::INT, q.b + CASE WHEN q.ok THEN q.n_chars ELSE 0 END, q.en + (q.ok AND lang = 'en')::INT, q.fr + (q.ok AND lang = 'fr')::INT, q.de + (q.ok AND lang = 'de')::INT, q.es + (q.ok AND lang = 'es')::INT
 FROM (SELECT f.source, o.i, o.doc_id, o.n_chars, o.lang, f.files, f.b, f.en, f.fr, f.de, f.es, f.files < 6 AND f.b + o.n_chars <= 9000 AND CASE lang WHEN 'en' THEN f.en < 3 WHEN 'fr' THEN f.fr < 2 WHEN 'de' THEN f.de < 2 ELSE f.es < 1 END AS ok
  FROM f JOIN o ON o.source = f.source AND o.i = f.i + 1) q) SELECT doc_id, admitted FROM f WHERE doc_id IS NOT NULL)""")
def str_10(spark, d):
    uploads = Fixture(spark, d).table("documents").select("doc_id", F.col("source").alias("case_id"), F.col("lang").alias("grp"), F.col("n_chars").alias("size_bytes"))
    return control.admit_files(uploads, "doc_id", BUDGET).select("doc_id", "admitted")


def state_log(fx):
    e = F.col("event_type")
    to = F.when(e == "signup", F.lit("PROCESSING")).when(e == "view", F.lit("UPLOADED")).when(e == "click", F.lit("QUEUED")).when(e == "purchase", F.lit("READY")).otherwise(F.lit("FAILED"))
    return fx.table("events").select(
        F.col("user_id").alias("item_id"), F.when(F.col("user_id") % 4 == 0, F.lit("trace")).otherwise(F.lit("photo")).alias("grp"), F.col("event_id").alias("n"), to.alias("state")
    )


STATE_FOLD = """
WITH RECURSIVE o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, user_id % 4 = 0 AS direct,
  CASE event_type WHEN 'signup' THEN 'PROCESSING' WHEN 'view' THEN 'UPLOADED' WHEN 'click' THEN 'QUEUED' WHEN 'purchase' THEN 'READY' ELSE 'FAILED' END AS goal FROM events),
f AS (SELECT user_id, 0::BIGINT AS i, 'UPLOADING' AS s, NULL::BIGINT AS event_id, NULL::VARCHAR AS prev, NULL::VARCHAR AS goal, true AS ok FROM (SELECT DISTINCT user_id FROM events)
 UNION ALL SELECT q.user_id, q.i, CASE WHEN q.ok THEN q.goal ELSE q.s END, q.event_id, q.s, q.goal, q.ok FROM (SELECT f.user_id, o.i, f.s, o.event_id, o.goal, CASE WHEN direct THEN
   o.goal IN ('UPLOADED', 'READY') AND CASE f.s WHEN 'UPLOADING' THEN true WHEN 'UPLOADED' THEN true ELSE false END
  ELSE CASE f.s WHEN 'UPLOADING' THEN o.goal = 'UPLOADED' WHEN 'UPLOADED' THEN o.goal IN ('UPLOADED', 'QUEUED') WHEN 'QUEUED' THEN o.goal IN ('PROCESSING', 'UPLOADED', 'QUEUED')
   WHEN 'PROCESSING' THEN o.goal IN ('READY', 'FAILED', 'QUEUED', 'PROCESSING') ELSE o.goal = 'QUEUED' END END AS ok FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1) q)"""


@query("str_07_evidence_state", f"SELECT item_id, state FROM ({STATE_FOLD} SELECT user_id AS item_id, arg_max(s, i) AS state FROM f GROUP BY ALL)")
def str_07(spark, d):
    """The log arrives as a stream; the states of every touched item are kept current."""
    log = state_log(_Streamed(spark, d))
    path = _fresh(spark, "states")
    streams.stream_states(log, path, f"{path}/checkpoint", bucket=500, once=True).awaitTermination()
    return streams.current_results(spark, path, ["item_id"]).select("item_id", "state")


@query("str_07_illegal_moves", f"SELECT item_id, n, from_state, to_state FROM ({STATE_FOLD} SELECT user_id AS item_id, event_id AS n, prev AS from_state, goal AS to_state FROM f WHERE NOT ok)")
def str_07_illegal(spark, d):
    return control.evidence_state(state_log(Fixture(spark, d)), "n", F.floor(F.col("n") / 500))[1]


# --------------------------------------------------------------- streaming
class _Streamed(Fixture):
    """The same tables, read as file streams."""

    def table(self, name):
        """A pattern that only the table's path fits: it may be one file, which a stream does not
        take as its path, or a folder of files, whose names tell nothing."""
        schema = self.spark.read.parquet(f"{self.folder}/{name}.parquet").schema
        return self.spark.readStream.schema(schema).parquet(f"{self.folder}/{name}.parque[t]")


@query("str_01_ingest", """
SELECT kind, CASE WHEN kind = 'PHOTO' AND u % 10 = 7 THEN 'ERROR' ELSE 'OK' END AS status, count(*) AS n
FROM (SELECT DISTINCT event_type, user_id % 40 AS u, CASE event_type WHEN 'click' THEN 'PHOTO' WHEN 'view' THEN 'SLIP' WHEN 'error' THEN 'TRACE' END AS kind FROM events) WHERE kind IS NOT NULL GROUP BY ALL""")
def str_01(spark, d):
    """Events as arriving objects: one content per type and forty keys, so most repeat."""
    u, e = (F.col("user_id") % 40).cast("string"), F.col("event_type")
    key = (
        F.when(e == "click", F.concat(F.lit("photos/B1/drain1/after-"), u, F.lit(".jpg"))).when(e == "view", F.concat(F.lit("slips/B1/1-"), u, F.lit(".png")))
        .when(e == "error", F.concat(F.lit("traces/B1/1-"), u, F.lit(".json"))).otherwise(F.concat(F.lit("other/"), u))
    )
    objects = _Streamed(spark, d).table("events").select(key.alias("key"), F.lit("v1").alias("etag"), F.col("ts").cast("timestamp").alias("ts"))
    path = _fresh(spark, "arrivals")
    read = lambda arrived: arrived.withColumn("error", F.when(F.col("key").endswith("7.jpg"), F.lit("unreadable")))
    streams.stream_ingest(objects, read, f"{path}/items", f"{path}/checkpoint", once=True).awaitTermination()
    items = key_fields(streams.current_items(spark, f"{path}/items"))
    return items.groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"))


def _timed(points):
    return points.withColumn("ts", F.col("t").cast("timestamp"))


@query("str_02_gap_sessions", """
SELECT bill_id, trace_key, count(*) AS gaps, round(sum(g), 3) AS dark_s FROM (SELECT bill_id, trace_key, (us - lag(us) OVER (PARTITION BY trace_key ORDER BY us)) / 1e6 AS g FROM v_point) WHERE g > 43200 GROUP BY ALL""")
def str_02(spark, d):
    path = _fresh(spark, "gaps")
    points = _timed(_Streamed(spark, d).points)
    streams.stream_gaps(points, f"{path}/runs", f"{path}/checkpoint", 43200, 3600, once=True).awaitTermination()
    gaps = streams.gaps_of(streams.current_runs(spark, f"{path}/runs", 43200))
    return gaps.groupBy("bill_id", "trace_key").agg(F.count(F.lit(1)).alias("gaps"), F.round(F.sum("gap_s"), 3).alias("dark_s"))


@query("str_03_arrivals", "SELECT bill_id, trace_key, us_in AS inside_us, us1 AS last_us, n FROM v_fact")
def str_03(spark, d):
    fx, path = Fixture(spark, d), _fresh(spark, "entries")
    points = _timed(_Streamed(spark, d).points)
    streams.stream_arrivals(points, bill.bill_sites(fx.bills, fx.sites), f"{path}/facts", f"{path}/checkpoint", once=True).awaitTermination()
    out = streams.current_arrivals(spark, f"{path}/facts")
    return out.select("bill_id", "trace_key", F.unix_micros("inside_ts").alias("inside_us"), F.unix_micros("last_ts").alias("last_us"), "n")


def order_legs(fx):
    """An order as a leg: from its date, a day long, between two made-up corners."""
    start = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    time = lambda us: F.struct(us.alias("wall_us"), F.lit(None).cast("int").alias("offset_min"), us.alias("epoch_us"))
    corner = lambda n: geo.pt(F.lit(72.0) + (F.col("o_orderkey") % n) * 0.1, F.lit(19.0))
    return fx.table("orders").select(
        F.lit("B").alias("bill_id"), (F.col("o_custkey") % 500).cast("string").alias("vehicle_no"), F.col("o_orderkey").cast("string").alias("trip_id"),
        time(start).alias("departure"), time(start + 86_400_000_000 * 2).alias("last_fix"), corner(7).alias("first_point"), corner(5).alias("last_point"),
    )


@query("str_04_turnaround", f"""
SELECT v AS vehicle_no, leg AS leg_id, nxt AS other, round(minutes, 3) AS minutes, round({sqlviews.haversine("x1", "19.0::DOUBLE", "x0", "19.0::DOUBLE")} / 1000, 4) AS km FROM (
 SELECT v, leg, lead(leg) OVER w AS nxt, (lead(us) OVER w - us - 172800000000) / 60e6 AS minutes, 72.0::DOUBLE + (k % 5) * 0.1::DOUBLE AS x1, 72.0::DOUBLE + (lead(k) OVER w % 7) * 0.1::DOUBLE AS x0
 FROM (SELECT (o_custkey % 500)::VARCHAR AS v, o_orderkey::VARCHAR AS leg, o_orderkey AS k, epoch_us(o_orderdate) AS us FROM orders) WINDOW w AS (PARTITION BY v ORDER BY us, leg))
WHERE nxt IS NOT NULL AND CASE WHEN minutes <= 0 THEN true ELSE {sqlviews.haversine("x1", "19.0::DOUBLE", "x0", "19.0::DOUBLE")} / 1000 / (minutes / 60) > 0.5 END""")
def str_04(spark, d):
    path = _fresh(spark, "turnaround")
    streams.stream_turnaround(order_legs(_Streamed(spark, d)), path, f"{path}/checkpoint", once=True).awaitTermination()
    out = streams.current_turnaround(spark, path, 0.5)
    return out.select("vehicle_no", "leg_id", "other", F.round("minutes", 3).alias("minutes"), F.round("km", 4).alias("km"))


@query("str_05_reuse", "SELECT bill_id, s3_key, original, distance FROM v_reuse")
def str_05(spark, d):
    path = _fresh(spark, "reuse")
    photos = _Streamed(spark, d).photos.select("bill_id", "drain_id", "s3_key", "timestamp", "p_hash")
    for running in streams.stream_reuse(photos, path, f"{path}/checkpoint", 20, bands=5, once=True):
        running.awaitTermination()
    out = streams.current_reuse(spark, path)
    return out.select(F.col("bill_id").cast("string").alias("bill_id"), "s3_key", "original", "distance")


@query("str_06_verify", """
SELECT bill_id, drain_id, trip_count, verdict, failed_rules FROM v_all_drain WHERE bill_id IN (SELECT label::VARCHAR FROM embeddings)""")
def str_06(spark, d):
    """Photos arrive; the bills they belong to, and no others, are verified again."""
    path = _fresh(spark, "verified")
    tables.save_case(Fixture(spark, d).case, f"{path}/evidence")
    changes = _Streamed(spark, d).photos.select("bill_id")

    def load(session, touched):
        return tables.load_case(session, f"{path}/evidence", touched=touched)

    def write(case_touched):
        tables.write_verdicts(bill.evaluate(case_touched, FIXTURE_LIMITS), f"{path}/verdicts")

    streams.stream_verify(changes, load, write, f"{path}/checkpoint", once=True).awaitTermination()
    out = tables.read_verdicts(spark, f"{path}/verdicts", "drains")
    return out.select("bill_id", "drain_id", "trip_count", "verdict", F.array_join("failed_rules", ",").alias("failed_rules"))
