"""Case mode: customers as cases, orders as slips, event blocks as traces."""

import math

from pyspark.sql import functions as F

from loadaudit.functions import geo
from loadaudit.plans import case
from loadaudit.plans.fixturemap import Fixture

from . import sqlviews
from .registry import query, view

LIMITS = case.CaseLimits(speed_kmh=1.0, slip_minutes=120.0, gap_s=12 * 3600.0, reuse_bits=20)
TUNING = {"hashes_per_group": 20}
INSUFFICIENT = "'Not evaluated: insufficient evidence.'"

view("c_case", """
SELECT c_custkey AS c, c_custkey::VARCHAR AS case_id, c_custkey % 4 <> 0 AS has_drain, 72.80::DOUBLE + (c_custkey % 50) / 1000.0::DOUBLE AS dlon,
  19.00::DOUBLE + (c_custkey % 30) / 5000.0::DOUBLE AS dlat, c_custkey % 8 = 1 AS has_line, 30.0::DOUBLE + c_custkey % 3 * 700 AS tol,
  c_custkey % 9 = 0 AS derived, 10.0::DOUBLE + c_custkey % 50 AS length_m, CASE WHEN c_custkey % 6 <> 0 THEN 2.0::DOUBLE END AS width_m,
  c_custkey % 3 AS site, CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 THEN 20.0::DOUBLE + c_custkey % 200 END AS q,
  CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 11 <> 0 THEN 1800.0::DOUBLE END AS rate,
  CASE WHEN c_custkey % 6 <> 0 AND c_custkey % 11 <> 0 THEN (20.0::DOUBLE + c_custkey % 200) * 1800 + c_custkey % 4 * 500 END AS amount,
  c_custkey % 10 <> 0 AS has_window, CASE WHEN c_custkey % 2 = 0 THEN 'WB ' || (c_custkey % 50) END AS truck,
  CASE WHEN c_custkey % 4 = 2 THEN 8.5::DOUBLE + c_custkey % 10 END AS capacity FROM customer""")
view("c_photo", """
SELECT p.*, (vec_id % 97)::VARCHAR AS case_id, 'p' || vec_id AS evidence_id,
  CASE WHEN vec_id % 10 <> 0 THEN 'IMG_' || vec_id || '.jpg' ELSE 'p' || vec_id END AS nm, CASE WHEN vec_id % 2 = 0 THEN 'after' ELSE 'before' END AS crole,
  vec_id % 6 <> 0 AS zoned, CASE WHEN vec_id % 4 = 0 THEN (vec_id % 100)::DOUBLE END AS acc, vec_id % 7 <> 0 AS ran,
  CASE WHEN vec_id % 17 <> 0 THEN vec_id % 4 <> 0 END AS ccleared, vec_id % 8 = 0 AS mocked,
  CASE WHEN vec_id % 14 = 0 THEN 'quota' ELSE 'not run' END AS skipped FROM v_photo p""")
view("c_slip", """
SELECT *, round(net + 8 + CASE WHEN o % 5 = 0 THEN 0.2::DOUBLE ELSE 0 END, 2) AS gross, 8.0::DOUBLE AS tare FROM (
SELECT o_orderkey AS o, o_custkey::VARCHAR AS case_id, 's' || o_orderkey AS evidence_id,
  CASE WHEN o_orderkey % 9 <> 0 THEN round(o_totalprice / 20000, 2) END AS net,
  CASE WHEN o_orderkey % 19 <> 0 THEN printf('%02d:%02d', o_orderkey % 24, o_custkey % 60) END AS time_in,
  CASE WHEN o_orderkey % 16 <> 0 THEN 'WB ' || (o_custkey % 50 + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) END AS vehicle,
  o_orderkey % 12 = 0 AS derived, CASE WHEN o_orderkey % 10 = 0 THEN 'mocked' ELSE 'extracted' END AS basis FROM orders)""")
RING = ", ".join(
    f"[72.85::DOUBLE + 600.0 * {math.cos(2 * math.pi * i / 48)!r}::DOUBLE / (111320.0::DOUBLE * cos(radians(19.005::DOUBLE))), "
    f"19.005::DOUBLE + 600.0 * {math.sin(2 * math.pi * i / 48)!r}::DOUBLE / 111320.0::DOUBLE]"
    for i in range(48)
)
view("c_edge", f"""
SELECT r[i][1] AS x1, r[i][2] AS y1, r[i % 48 + 1][1] AS x2, r[i % 48 + 1][2] AS y2 FROM (SELECT [{RING}] AS r), range(1, 49) t(i)""")
view("c_circle", """
SELECT seq, sum((lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1))::INT) % 2 = 1 AS inside FROM v_point, c_edge WHERE (y1 > lat) <> (y2 > lat) GROUP BY seq""")
view("c_point", """
SELECT p.user_id::VARCHAR AS case_id, p.trace_key, p.seq, p.lon, p.lat, p.us, c.site,
  CASE c.site WHEN 1 THEN p.lon >= 72.845::DOUBLE AND p.lon < 72.855::DOUBLE AND p.lat >= 19.0::DOUBLE AND p.lat < 19.01::DOUBLE
    WHEN 2 THEN coalesce(k.inside, false) ELSE false END AS inside
FROM v_point p JOIN c_case c ON c.c = p.user_id LEFT JOIN c_circle k ON k.seq = p.seq""")
view("c_trace", """
SELECT f.*, split_part(trace_key, '-', 2)::INT AS block, CASE WHEN split_part(trace_key, '-', 2)::INT % 4 <> 3
  THEN 'WB ' || (case_id::INT % 50 + split_part(trace_key, '-', 2)::INT % 2) ELSE truck END AS vehicle
FROM (SELECT case_id, trace_key, any_value(site) AS site, count(*) AS n, arg_min(us, seq) AS us0, arg_max(us, seq) AS us1, arg_min(lon, seq) AS lon0,
  arg_min(lat, seq) AS lat0, arg_max(lon, seq) AS lon1, arg_max(lat, seq) AS lat1, bool_or(inside) AS entered,
  coalesce(arg_min(us, seq) FILTER (WHERE inside), arg_max(us, seq)) AS us_arr FROM c_point GROUP BY ALL) f JOIN c_case USING (case_id)""")


def shown(checks):
    return checks.select("case_id", "evidence_id", "status", "message")


def traced(fx):
    return case.CaseReport(fx.case_tables, LIMITS).traced


view("c_r1", f"""
SELECT case_id, evidence_id, nm, has_gps AND has_drain AS can, d, tol, acc, derived, CASE WHEN has_line THEN 'line' ELSE 'point' END AS r FROM (
SELECT p.*, c.*, CASE WHEN has_line THEN (SELECT sqrt(power(px - t * vx, 2) + power(py - t * vy, 2)) FROM (SELECT px, py, vx, vy,
   greatest(0, least(1, (px * vx + py * vy) / (vx * vx + vy * vy))) AS t FROM (SELECT (lon - dlon) * 111320.0::DOUBLE * cos(radians(dlat)) AS px,
   (lat - dlat) * 111320.0::DOUBLE AS py, (dlon + 0.01::DOUBLE - dlon) * 111320.0::DOUBLE * cos(radians(dlat)) AS vx, (dlat + 0.002::DOUBLE - dlat) * 111320.0::DOUBLE AS vy)))
  ELSE {sqlviews.haversine("lon", "lat", "dlon", "dlat")} END AS d
FROM (SELECT case_id, evidence_id, nm, has_gps, lon, lat, acc FROM c_photo) p JOIN c_case c USING (case_id))""")
view("c_r1s", """
SELECT *, CASE WHEN NOT can THEN 'NOT_EVALUATED' WHEN d > tol + 30 THEN 'FAIL' WHEN d > tol THEN 'REVIEW' WHEN derived OR acc > tol THEN 'INCONCLUSIVE' ELSE 'CONSISTENT' END AS status FROM c_r1""")


@query("chk_r1", f"""
SELECT case_id, evidence_id, status, CASE
  WHEN NOT can THEN {INSUFFICIENT}
  WHEN status = 'FAIL' THEN nm || ' was taken ' || format('{{:,.0f}}', d) || ' m from the supplied drain ' || r || ', beyond its ' || tol::INT || ' m tolerance and the 30 m margin.'
  WHEN status = 'REVIEW' THEN nm || ' was taken ' || round_even(d, 0)::INT || ' m from the supplied drain ' || r || ', ' || round_even(d - tol, 0)::INT || ' m outside its ' || tol::INT
    || ' m tolerance: within the margin of a consumer GPS fix, so a person should look.'
  WHEN derived THEN nm || ' is ' || round_even(d, 0)::INT || ' m from the drain ' || r || ', but that ' || r || ' was drawn from these same photographs, so the comparison is circular and proves nothing.'
  WHEN acc > tol THEN nm || ' is ' || round_even(d, 0)::INT || ' m from the drain ' || r || ', but the phone reports a GPS accuracy of ' || acc::INT || ' m, wider than the ' || tol::INT || ' m tolerance.'
  ELSE nm || ' is ' || round_even(d, 0)::INT || ' m from the supplied drain ' || r || ', inside its ' || tol::INT
    || ' m tolerance. The location was supplied for this trial and is not an official drain map, so this is consistency, not proof.'
    || CASE WHEN acc IS NOT NULL THEN ' The phone reports ' || acc::INT || ' m accuracy.' ELSE ' The photo does not record its GPS accuracy.' END END AS message FROM c_r1s""")
def chk_r1(spark, d):
    fx = Fixture(spark, d)
    return shown(case.chk_r1(fx.case_photos, fx.case_rows))


view("c_r2", """
SELECT case_id, evidence_id, nm, taken, zoned, CASE WHEN taken IS NULL OR NOT has_window THEN 'NOT_EVALUATED'
  WHEN (taken + INTERVAL 10 HOUR) BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2000-12-31' THEN 'PASS' ELSE 'FAIL' END AS status FROM c_photo JOIN c_case USING (case_id)""")


@query("chk_r2", f"""
SELECT case_id, evidence_id, status, CASE WHEN status = 'NOT_EVALUATED' THEN {INSUFFICIENT} ELSE nm || ' was taken at ' || taken || ' 10:00, '
  || CASE WHEN status = 'PASS' THEN 'inside' ELSE 'outside' END || ' the work window.'
  || CASE WHEN zoned THEN '' ELSE ' The photo''s time carries no timezone, so it was read in the work window''s timezone.' END END AS message FROM c_r2""")
def chk_r2(spark, d):
    fx = Fixture(spark, d)
    return shown(case.chk_r2(fx.case_photos, fx.case_rows))


view("c_r3_pair", """
SELECT a.case_id, a.evidence_id, b.nm AS original_nm, 64 - list_sum(list_transform(list_zip(a.bits, b.bits), lambda z: (z[1] = z[2])::INT))::INT AS distance,
  row_number() OVER (PARTITION BY a.case_id, a.evidence_id ORDER BY b.stamp, b.evidence_id) AS rn
FROM (SELECT *, coalesce(taken || 'T10:00:00' || CASE WHEN zoned THEN '+05:30' ELSE '' END, '') AS stamp FROM c_photo) a
JOIN (SELECT *, coalesce(taken || 'T10:00:00' || CASE WHEN zoned THEN '+05:30' ELSE '' END, '') AS stamp FROM c_photo) b
  ON a.case_id = b.case_id AND (b.stamp, b.evidence_id) < (a.stamp, a.evidence_id)
WHERE 64 - list_sum(list_transform(list_zip(a.bits, b.bits), lambda z: (z[1] = z[2])::INT)) <= 20""")
view("c_r3", """
SELECT p.case_id, p.evidence_id, nm, original_nm, distance, CASE WHEN distance IS NULL THEN 'PASS' ELSE 'FAIL' END AS status
FROM c_photo p LEFT JOIN c_r3_pair r ON r.case_id = p.case_id AND r.evidence_id = p.evidence_id AND rn = 1
WHERE p.case_id IN (SELECT case_id FROM c_photo GROUP BY case_id HAVING count(*) >= 2)""")


@query("chk_r3", """
SELECT case_id, evidence_id, status, CASE WHEN status = 'FAIL' THEN nm || ' is the same image as ' || original_nm || ' (' || distance || ' of 64 hash bits differ; the threshold is 20).'
  ELSE nm || ' does not match any other photo in this trial. Trials are not compared with each other or with Bill B1.' END AS message FROM c_r3""")
def chk_r3(spark, d):
    return shown(case.chk_r3(Fixture(spark, d).case_photos, LIMITS, **TUNING))


view("c_r4", """
SELECT case_id, evidence_id, nm, confidence, skipped, mocked, CASE WHEN NOT ran THEN 'NOT_EVALUATED' WHEN NOT ok OR ccleared IS NULL THEN 'INCONCLUSIVE'
  WHEN NOT ccleared THEN 'REVIEW' ELSE 'PASS' END AS status FROM c_photo WHERE crole = 'after'""")


@query("chk_r4", """
SELECT case_id, evidence_id, status, CASE status WHEN 'NOT_EVALUATED' THEN 'Not evaluated: the model did not read this photo.'
  WHEN 'INCONCLUSIVE' THEN 'The model''s answer for ' || nm || ' did not fit the expected form, so it cannot decide whether the channel is cleared.'
  WHEN 'REVIEW' THEN nm || ' is labelled ''after'', but the model does not see a cleared channel (confidence ' || confidence || ').'
  ELSE 'The model sees a cleared channel in ' || nm || ' (confidence ' || confidence || '). A model reading is an observation, not proof that desilting happened.' END AS message,
  CASE WHEN status = 'NOT_EVALUATED' THEN 'a model result (' || skipped || ')' ELSE '' END AS missing FROM c_r4""")
def chk_r4(spark, d):
    out = case.chk_r4(Fixture(spark, d).case_photos)
    return out.select("case_id", "evidence_id", "status", "message", F.array_join("missing", ";").alias("missing"))


view("c_gap", """
SELECT case_id, trace_key, max(g) AS gap FROM (SELECT case_id, trace_key, (us - lag(us) OVER (PARTITION BY case_id, trace_key ORDER BY us)) / 1e6 AS g FROM c_point) GROUP BY ALL""")
view("c_r5", f"""
SELECT case_id, trace_key AS evidence_id, us_arr, CASE WHEN site = 0 THEN 'NOT_EVALUATED' WHEN entered THEN 'PASS' ELSE 'FAIL' END AS status,
 {sqlviews.haversine("lon1", "lat1", "72.85::DOUBLE", "19.005::DOUBLE")} / 1000 AS km FROM c_trace""")
view("c_dark", """
SELECT case_id, trace_key AS evidence_id, gap, CASE WHEN gap IS NULL THEN 'INCONCLUSIVE' WHEN gap > 43200 THEN 'REVIEW' ELSE 'PASS' END AS status FROM c_gap""")


@query("chk_r5", f"""
SELECT case_id, evidence_id, 'R5' AS rule, status, CASE status WHEN 'NOT_EVALUATED' THEN {INSUFFICIENT} WHEN 'PASS' THEN 'The trace enters the designated disposal site at '
  || strftime(make_timestamp(us_arr), '%H:%M') || '. The site was designated for this trial; that does not make it an authorised landfill.'
  ELSE 'The trace never enters the designated disposal site. Its last fix is ' || printf('%.1f', km) || ' km from the site''s centre.' END AS message FROM c_r5
UNION ALL SELECT case_id, evidence_id, 'GPS_GAP', status, CASE status WHEN 'INCONCLUSIVE' THEN 'The trace has too few timed points.'
  WHEN 'REVIEW' THEN 'The trace goes dark for ' || round_even(gap / 60, 0)::BIGINT || ' minutes.' ELSE 'The longest gap between fixes is ' || round_even(gap, 0)::BIGINT || ' s.' END FROM c_dark""")
def chk_r5(spark, d):
    fx = Fixture(spark, d)
    out = case.chk_trace(traced(fx), fx.case_rows, LIMITS)
    return out.select("case_id", "evidence_id", "rule", "status", "message")


view("c_leg", f"""
SELECT *, {sqlviews.haversine("lon1", "lat1", "nlon", "nlat")} / 1000 AS km, (nus0 - us1) / 60e6 AS minutes FROM (
 SELECT *, lead(trace_key) OVER w AS nkey, lead(us0) OVER w AS nus0, lead(lon0) OVER w AS nlon, lead(lat0) OVER w AS nlat, lag(trace_key) OVER w AS pkey FROM c_trace
 WHERE vehicle IS NOT NULL WINDOW w AS (PARTITION BY case_id, vehicle ORDER BY us0, trace_key))""")
view("c_clash", """
SELECT case_id, trace_key, nkey, km, minutes FROM c_leg WHERE nkey IS NOT NULL AND CASE WHEN minutes <= 0 THEN true ELSE km / (minutes / 60) > 1 END""")
view("c_side", """
SELECT case_id, nkey AS evidence_id, trace_key AS other, km, minutes, 0 AS o FROM c_clash UNION ALL SELECT case_id, trace_key, nkey, km, minutes, 1 FROM c_clash""")
view("c_first", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, evidence_id ORDER BY o) AS rn FROM c_side) WHERE rn = 1")
view("c_shared", """
SELECT case_id, trace_key AS evidence_id FROM c_trace JOIN (SELECT case_id, vehicle FROM c_trace WHERE vehicle IS NOT NULL GROUP BY ALL HAVING count(*) >= 2) USING (case_id, vehicle)""")
view("c_r6", """
SELECT s.case_id, s.evidence_id, f.other, f.km, f.minutes, CASE WHEN f.other IS NULL THEN 'PASS' ELSE 'FAIL' END AS status FROM c_shared s LEFT JOIN c_first f USING (case_id, evidence_id)""")


@query("chk_r6", """
SELECT case_id, evidence_id, status, CASE WHEN status = 'PASS' THEN evidence_id || '.json does not clash with the truck''s other traces.'
  ELSE evidence_id || '.json and ' || other || '.json put the same truck ' || printf('%.1f', km) || ' km apart with only ' || round_even(greatest(minutes, 0), 0)::BIGINT
   || ' minutes between them (limit 1 km/h).' END AS message FROM c_r6""")
def chk_r6(spark, d):
    fx = Fixture(spark, d)
    return shown(case.chk_r6(traced(fx), fx.case_rows, LIMITS))


view("c_sizes", """
SELECT s.case_id, s.n AS slips, t.n AS traces FROM (SELECT case_id, count(*) AS n FROM c_slip GROUP BY ALL) s JOIN (SELECT case_id, count(*) AS n FROM c_trace GROUP BY ALL) t USING (case_id)""")
view("c_pairs", """
SELECT s.case_id, s.evidence_id, t.trace_key FROM (SELECT *, row_number() OVER (PARTITION BY case_id, vehicle ORDER BY o) AS k FROM c_slip WHERE vehicle IS NOT NULL) s
 JOIN (SELECT *, row_number() OVER (PARTITION BY case_id, vehicle ORDER BY block) AS k FROM c_trace WHERE vehicle IS NOT NULL) t
  ON s.case_id = t.case_id AND s.vehicle = t.vehicle AND s.k = t.k JOIN c_sizes z ON z.case_id = s.case_id WHERE NOT (z.slips = 1 AND z.traces = 1)
UNION ALL SELECT s.case_id, s.evidence_id, t.trace_key FROM c_slip s JOIN c_trace t USING (case_id) JOIN c_sizes z USING (case_id) WHERE z.slips = 1 AND z.traces = 1""")


@query("join_06_pair_slips", "SELECT case_id, evidence_id, trace_key AS trace_id FROM c_pairs")
def join_06(spark, d):
    fx = Fixture(spark, d)
    return case.pair_slips(fx.case_slips, fx.case_traces, fx.case_rows)


view("c_judged", """
SELECT s.*, c.c, c.site AS csite, c.truck, c.capacity, p.trace_key, t.entered, t.us_arr, t.us0, coalesce(t.vehicle, c.truck) AS trip_vehicle
FROM c_slip s JOIN c_case c USING (case_id) LEFT JOIN c_pairs p USING (case_id, evidence_id) LEFT JOIN c_trace t ON t.case_id = s.case_id AND t.trace_key = p.trace_key""")
view("c_r7", """
SELECT case_id, evidence_id, net, capacity, basis, CASE WHEN net IS NULL THEN 'INCONCLUSIVE' WHEN capacity IS NULL THEN 'NOT_EVALUATED' WHEN net > capacity THEN 'FAIL' ELSE 'PASS' END AS status FROM c_judged""")


@query("chk_r7", f"""
SELECT case_id, evidence_id, status, CASE status WHEN 'INCONCLUSIVE' THEN 'The slip''s net weight could not be read.' WHEN 'NOT_EVALUATED' THEN {INSUFFICIENT}
 WHEN 'FAIL' THEN 'The slip claims ' || printf('%.2f', net) || ' t on a truck rated ' || format('{{:g}}', capacity) || ' t.'
 ELSE 'Net ' || printf('%.2f', net) || ' t is within the truck''s rated ' || format('{{:g}}', capacity) || ' t.' END AS message FROM c_r7""")
def chk_r7(spark, d):
    fx = Fixture(spark, d)
    return shown(case.chk_r7(case.paired_slips(fx.case_slips, traced(fx), fx.case_rows)))


view("c_mins", """
SELECT case_id, evidence_id, arg_min(x, {'a': abs(x), 'k': k}) AS delta FROM (SELECT case_id, evidence_id, k, ((us_arr // 86400000000 + k) * 86400000000
  + (split_part(time_in, ':', 1)::INT * 60 + split_part(time_in, ':', 2)::INT) * 60000000::BIGINT - us_arr) / 60e6 AS x
 FROM c_judged, (VALUES (-1), (0), (1)) v(k) WHERE time_in IS NOT NULL AND us_arr IS NOT NULL) GROUP BY ALL""")
view("c_r8", """
SELECT j.*, m.delta, strftime(make_timestamp(us_arr), '%H:%M') AS arr_at, strftime(make_timestamp(us0), '%H:%M') AS left_at,
 (us0 // 86400000000 * 86400000000 + (split_part(time_in, ':', 1)::INT * 60 + split_part(time_in, ':', 2)::INT) * 60000000::BIGINT - us0) / 60e6 AS lead0,
 CASE WHEN time_in IS NULL THEN 'INCONCLUSIVE' WHEN trace_key IS NULL OR csite = 0 THEN 'NOT_EVALUATED' WHEN abs(delta) > 120 THEN 'FAIL' ELSE 'PASS' END AS status
FROM c_judged j LEFT JOIN c_mins m USING (case_id, evidence_id)""")
view("c_lead", """
SELECT *, CASE WHEN lead0 > 720 THEN lead0 - 1440 WHEN lead0 < -720 THEN lead0 + 1440 ELSE lead0 END AS lead_min FROM c_r8""")


@query("chk_r8", f"""
SELECT case_id, evidence_id, status, CASE status WHEN 'INCONCLUSIVE' THEN 'The slip''s time-in could not be read.' WHEN 'NOT_EVALUATED' THEN {INSUFFICIENT}
 WHEN 'PASS' THEN 'The slip''s time-in ' || time_in || ' is within 120 minutes of the GPS ' || CASE WHEN entered THEN 'arrival at the site' ELSE 'last fix' END || ' at ' || arr_at || '.'
 ELSE CASE WHEN entered THEN 'The slip records time-in at ' || time_in || ', ' || round_even(abs(delta), 0)::BIGINT || ' minutes '
     || CASE WHEN delta < 0 THEN 'before' ELSE 'after' END || ' the truck''s GPS reached the dump site at ' || arr_at || '.'
   ELSE 'The slip records time-in at ' || time_in
     || CASE WHEN lead_min < 0 THEN ', ' || round_even(-lead_min, 0)::BIGINT || ' minutes before the truck left the drain at ' || left_at ELSE '' END
     || '. The GPS trace never reaches the dump site; its last fix, at ' || arr_at || ', is ' || round_even(abs(delta), 0)::BIGINT || ' minutes '
     || CASE WHEN delta < 0 THEN 'after' ELSE 'before' END || ' the slip''s time-in.' END END AS message FROM c_lead""")
def chk_r8(spark, d):
    fx = Fixture(spark, d)
    return shown(case.chk_r8(case.paired_slips(fx.case_slips, traced(fx), fx.case_rows), LIMITS))


view("c_r9", """
SELECT case_id, evidence_id, vehicle, trip_vehicle, basis, CASE WHEN vehicle IS NULL THEN 'INCONCLUSIVE' WHEN trip_vehicle IS NULL THEN 'NOT_EVALUATED'
  WHEN vehicle <> trip_vehicle THEN 'FAIL' ELSE 'PASS' END AS status FROM c_judged""")


@query("chk_r9", f"""
SELECT case_id, evidence_id, status, CASE status WHEN 'INCONCLUSIVE' THEN 'The slip''s vehicle number could not be read.' WHEN 'NOT_EVALUATED' THEN {INSUFFICIENT}
 WHEN 'FAIL' THEN 'The slip is for ' || vehicle || ', but the trip''s truck is ' || trip_vehicle || '.' ELSE 'The slip and the trip both name ' || vehicle || '.' END AS message FROM c_r9""")
def chk_r9(spark, d):
    fx = Fixture(spark, d)
    return shown(case.chk_r9(case.paired_slips(fx.case_slips, traced(fx), fx.case_rows)))


view("c_t2", """
SELECT *, CASE WHEN net IS NULL OR derived THEN 'INCONCLUSIVE' WHEN abs(gross - tare - net) > 0.05 THEN 'FAIL' ELSE 'PASS' END AS status FROM c_slip WHERE case_id IN (SELECT case_id FROM c_case)""")


@query("chk_t2", """
SELECT case_id, evidence_id, status, CASE WHEN net IS NULL THEN 'Gross, tare and net could not all be read, so the slip''s arithmetic cannot be checked.'
 WHEN derived THEN 'The net weight was not read from the slip; it was computed as gross − tare, so checking it against gross − tare would be circular.'
 WHEN status = 'FAIL' THEN 'Gross ' || printf('%.2f', gross) || ' t − tare ' || printf('%.2f', tare) || ' t = ' || printf('%.2f', gross - tare) || ' t, but the slip prints net ' || printf('%.2f', net) || ' t.'
 ELSE 'Gross ' || printf('%.2f', gross) || ' t − tare ' || printf('%.2f', tare) || ' t matches net ' || printf('%.2f', net) || ' t.' END AS message FROM c_t2""")
def chk_t2(spark, d):
    return shown(case.chk_t2(Fixture(spark, d).case_slips))


view("c_t1", """
SELECT *, q * rate AS e, CASE WHEN q IS NULL OR rate IS NULL OR amount IS NULL THEN 'NOT_EVALUATED' WHEN abs(q * rate - amount) > greatest(1, 0.005::DOUBLE * q * rate) THEN 'FAIL' ELSE 'PASS' END AS status FROM c_case""")


@query("chk_t1", f"""
SELECT case_id, status, CASE status WHEN 'NOT_EVALUATED' THEN {INSUFFICIENT}
 WHEN 'FAIL' THEN format('{{:g}}', q) || ' t × ₹' || format('{{:,.2f}}', rate) || '/t = ₹' || format('{{:,.2f}}', e) || ', but the claim is ₹' || format('{{:,.2f}}', amount)
   || ' (a difference of ₹' || format('{{:,.2f}}', amount - e) || ').'
 ELSE format('{{:g}}', q) || ' t × ₹' || format('{{:,.2f}}', rate) || '/t = ₹' || format('{{:,.2f}}', e) || ', matching the claim.' END AS message,
 coalesce(array_to_string([CASE WHEN q IS NULL THEN 'the claimed quantity' END, CASE WHEN rate IS NULL THEN 'the claimed rate' END, CASE WHEN amount IS NULL THEN 'the claimed amount' END], ';'), '') AS missing FROM c_t1""")
def chk_t1(spark, d):
    out = case.chk_t1(Fixture(spark, d).case_rows)
    return out.select("case_id", "status", "message", F.array_join("missing", ";").alias("missing"))


view("c_r10", """
SELECT *, length_m * width_m * 1.5 * (1.4::DOUBLE * 1.2::DOUBLE) AS ceiling, CASE WHEN q IS NULL OR NOT has_drain OR width_m IS NULL THEN 'NOT_EVALUATED'
 WHEN q > length_m * width_m * 1.5 * (1.4::DOUBLE * 1.2::DOUBLE) THEN 'REVIEW' ELSE 'PASS' END AS status FROM c_case""")


@query("chk_r10", f"""
SELECT case_id, status, CASE status WHEN 'NOT_EVALUATED' THEN {INSUFFICIENT} WHEN 'REVIEW' THEN 'The drain claims ' || q::BIGINT || ' t, more than the ' || round_even(ceiling, 0)::BIGINT
  || ' t its length, width and depth allow.' ELSE format('{{:g}}', q) || ' t is within the ' || format('{{:,.0f}}', ceiling) || ' t that the stated dimensions allow (1.4 t/m³, ×1.2 headroom).' END AS message FROM c_r10""")
def chk_r10(spark, d):
    return case.chk_r10(Fixture(spark, d).case_rows).select("case_id", "status", "message")


view("c_t3", """
SELECT c.*, n, r, total, CASE WHEN q IS NULL OR coalesce(n, 0) = 0 THEN 'NOT_EVALUATED' WHEN r = 0 THEN 'INCONCLUSIVE' WHEN total >= q * 0.98::DOUBLE THEN 'PASS' ELSE 'REVIEW' END AS status,
  CASE WHEN mock THEN 'mocked' ELSE 'extracted' END AS basis
FROM c_case c LEFT JOIN (SELECT case_id, count(*) AS n, count(net) AS r, sum(net::DECIMAL(18,3))::DOUBLE AS total, bool_or(basis = 'mocked') AS mock FROM c_slip GROUP BY ALL) USING (case_id)""")


@query("chk_t3", f"""
SELECT case_id, status, CASE status WHEN 'NOT_EVALUATED' THEN {INSUFFICIENT} WHEN 'INCONCLUSIVE' THEN 'No slip''s net weight could be read.'
 WHEN 'PASS' THEN 'The slips'' net weights total ' || format('{{:g}}', total) || ' t against ' || format('{{:g}}', q) || ' t claimed.'
 ELSE 'The slips account for ' || format('{{:g}}', total) || ' t of the ' || format('{{:g}}', q) || ' t claimed (' || round_even(total / q * 100, 0)::BIGINT || '%).' END
 || CASE WHEN status IN ('PASS', 'REVIEW') AND n > r THEN ' ' || (n - r) || ' slip(s) had no readable net weight.' ELSE '' END AS message FROM c_t3""")
def chk_t3(spark, d):
    fx = Fixture(spark, d)
    return case.chk_t3(fx.case_rows, fx.case_slips).select("case_id", "status", "message")


view("c_absent", """
SELECT case_id, rule FROM (SELECT case_id, unnest([
  CASE WHEN p = 0 THEN 'R1' END, CASE WHEN p = 0 THEN 'R2' END, CASE WHEN p < 2 THEN 'R3' END, CASE WHEN a = 0 THEN 'R4' END, CASE WHEN t = 0 THEN 'R5' END, CASE WHEN t = 0 THEN 'GPS_GAP' END,
  CASE WHEN g < 2 THEN 'R6' END, CASE WHEN s = 0 THEN 'R7' END, CASE WHEN s = 0 THEN 'R8' END, CASE WHEN s = 0 THEN 'R9' END, CASE WHEN s = 0 THEN 'T2' END]) AS rule
 FROM (SELECT c.case_id, (SELECT count(*) FROM c_photo x WHERE x.case_id = c.case_id) AS p, (SELECT count(*) FROM c_photo x WHERE x.case_id = c.case_id AND crole = 'after') AS a,
  (SELECT count(*) FROM c_trace x WHERE x.case_id = c.case_id) AS t, (SELECT count(*) FROM c_shared x WHERE x.case_id = c.case_id) AS g,
  (SELECT count(*) FROM c_slip x WHERE x.case_id = c.case_id) AS s FROM c_case c)) WHERE rule IS NOT NULL""")
view("c_all", """
SELECT case_id, rule, status, coalesce(basis, '') AS basis, CASE WHEN basis = 'mocked' AND status NOT IN ('NOT_EVALUATED', 'INCONCLUSIVE') THEN 'NOT_EVALUATED' ELSE status END AS shown,
  CASE WHEN basis = 'mocked' AND status NOT IN ('NOT_EVALUATED', 'INCONCLUSIVE') THEN status END AS mock_outcome FROM (
SELECT case_id, 'R1' AS rule, status, NULL AS basis FROM c_r1s UNION ALL SELECT case_id, 'R2', status, NULL FROM c_r2 UNION ALL SELECT case_id, 'R3', status, NULL FROM c_r3
UNION ALL SELECT case_id, 'R4', status, CASE WHEN mocked THEN 'mocked' END FROM c_r4 UNION ALL SELECT case_id, 'R5', status, NULL FROM c_r5 UNION ALL SELECT case_id, 'GPS_GAP', status, NULL FROM c_dark
UNION ALL SELECT case_id, 'R6', status, NULL FROM c_r6 UNION ALL SELECT case_id, 'R7', status, basis FROM c_r7 UNION ALL SELECT case_id, 'R8', status, basis FROM c_r8
UNION ALL SELECT case_id, 'R9', status, basis FROM c_r9 UNION ALL SELECT case_id, 'T2', status, basis FROM c_t2 UNION ALL SELECT case_id, 'T1', status, NULL FROM c_t1
UNION ALL SELECT case_id, 'R10', status, NULL FROM c_r10 UNION ALL SELECT case_id, 'T3', status, basis FROM c_t3 UNION ALL SELECT case_id, rule, 'NOT_EVALUATED', NULL FROM c_absent)""")


def report(fx):
    return case.evaluate_cases(fx.case_tables, LIMITS, **TUNING)


@query("chk_all_counts", """
SELECT case_id, count(*) AS total, count(*) FILTER (WHERE shown = 'PASS') AS pass, count(*) FILTER (WHERE shown = 'CONSISTENT') AS consistent, count(*) FILTER (WHERE shown = 'REVIEW') AS review,
 count(*) FILTER (WHERE shown = 'FAIL') AS fail, count(*) FILTER (WHERE shown = 'INCONCLUSIVE') AS inconclusive, count(*) FILTER (WHERE shown = 'NOT_EVALUATED') AS not_evaluated FROM c_all GROUP BY ALL""")
def chk_all(spark, d):
    return report(Fixture(spark, d)).counts


@query("chk_mock", "SELECT rule, shown AS status, mock_outcome, count(*) AS n FROM c_all WHERE rule IN ('R7', 'T2') GROUP BY ALL")
def chk_mock(spark, d):
    fx = Fixture(spark, d)
    both = case.chk_r7(case.paired_slips(fx.case_slips, traced(fx), fx.case_rows)).unionByName(case.chk_t2(fx.case_slips))
    both = both.unionByName(_absent(fx).where(F.col("rule").isin("R7", "T2")))
    return case.demote_mocked(both).groupBy("rule", "status", "mock_outcome").agg(F.count(F.lit(1)).alias("n"))


def _absent(fx):
    t = traced(fx)
    return case.chk_absent(fx.case_rows, fx.case_photos, fx.case_slips, t, case.same_truck_traces(t, fx.case_rows))


@query("ord_02_sections", """
SELECT case_id, CASE WHEN shown IN ('FAIL', 'REVIEW') THEN 'problems' WHEN shown IN ('PASS', 'CONSISTENT') THEN 'clear' WHEN shown = 'INCONCLUSIVE' THEN 'inconclusive' ELSE 'missing' END AS section,
 count(*) AS n FROM c_all GROUP BY ALL""")
def ord_02(spark, d):
    return case.section_checks(report(Fixture(spark, d)).checks).groupBy("case_id", "section").agg(F.count(F.lit(1)).alias("n"))


@query("chk_txt_summary", """
SELECT case_id, count(*) || ' checks: ' || count(*) FILTER (WHERE status = 'FAIL') || ' failed, 0 need review, ' || count(*) FILTER (WHERE status = 'PASS') || ' passed, 0 consistent with an approximate reference, 0 inconclusive, and '
 || count(*) FILTER (WHERE status = 'NOT_EVALUATED') || ' not evaluated for lack of evidence. '
 || CASE WHEN bool_or(status = 'FAIL') THEN 'Problems: T1: ' || any_value(words) FILTER (WHERE status = 'FAIL') ELSE 'No check found a problem with the evidence that was supplied.' END
 || CASE WHEN bool_or(status = 'NOT_EVALUATED') THEN ' Supplying ' || any_value(need) FILTER (WHERE status = 'NOT_EVALUATED') || ' would let more checks run.' ELSE '' END || ' Not evaluated is not passed.' AS summary
FROM (SELECT *, format('{:g}', q) || ' t × ₹' || format('{:,.2f}', rate) || '/t = ₹' || format('{:,.2f}', e) || ', but the claim is ₹' || format('{:,.2f}', amount)
   || ' (a difference of ₹' || format('{:,.2f}', amount - e) || ').' AS words,
  array_to_string(list_sort(list_filter([CASE WHEN q IS NULL THEN 'the claimed quantity' END, CASE WHEN rate IS NULL THEN 'the claimed rate' END, CASE WHEN amount IS NULL THEN 'the claimed amount' END], lambda x: x IS NOT NULL)), '; ') AS need FROM c_t1) GROUP BY ALL""")
def chk_txt(spark, d):
    return case.summary_text(case.with_titles(case.chk_t1(Fixture(spark, d).case_rows)))


@query("chk_obs", """
SELECT case_id, evidence_id, 'vision' AS kind, crole AS role, NULL AS vehicle_no FROM c_photo UNION ALL SELECT case_id, evidence_id, 'textract', NULL, NULL FROM c_slip
UNION ALL SELECT user_id::VARCHAR, trace_key, 'trace', NULL, CASE WHEN split_part(trace_key, '-', 2)::INT % 4 <> 3 THEN 'WB ' || (user_id % 50 + split_part(trace_key, '-', 2)::INT % 2) END
 FROM (SELECT DISTINCT user_id, trace_key FROM v_point)""")
def chk_obs(spark, d):
    return case.observations(Fixture(spark, d).case_tables).select("case_id", "evidence_id", "kind", "role", "vehicle_no")


@query("win_09_line_from_photos", """
SELECT case_id, evidence_id FROM (SELECT case_id, evidence_id, lon, lat, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM (
  SELECT *, coalesce(taken || 'T10:00:00' || CASE WHEN zoned THEN '+05:30' ELSE '' END, '') AS stamp FROM c_photo WHERE has_gps)
 WINDOW w AS (PARTITION BY case_id ORDER BY stamp, vec_id)) WHERE plon IS NULL OR plon <> lon OR plat <> lat""")
def win_09(spark, d):
    return case.line_from_photos(Fixture(spark, d).case_photos).select("case_id", "evidence_id")
