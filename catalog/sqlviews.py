"""The fixture views again, in SQL."""

from .registry import view

view("v_bill", """
SELECT n_nationkey::VARCHAR AS bill_id, 1800 + 10 * n_nationkey AS rate,
       CASE WHEN n_nationkey % 2 = 0 THEN 'VERIFIED' ELSE 'PENDING' END AS status,
       n_nationkey <> 24 AS has_site FROM nation""")
view("v_sdrain", """
SELECT s_nationkey::VARCHAR AS bill_id, s_suppkey::VARCHAR AS drain_id, s_name AS name,
       (400 + s_suppkey % 400 * 8)::DOUBLE AS length_m, 1.2::DOUBLE + (s_suppkey % 5) * 0.5::DOUBLE AS width_m,
       0.8::DOUBLE + (s_suppkey % 3) * 0.4::DOUBLE AS depth_m,
       CASE s_suppkey % 4 WHEN 0 THEN 'APPROVE' WHEN 1 THEN 'HOLD' END AS decision FROM supplier""")
view("v_load", """
SELECT *, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-'
       || strftime(l_shipdate, '%Y%m%d') AS trip_id FROM lineitem""")
view("v_strip", """
SELECT s_nationkey::VARCHAR AS bill_id, l_suppkey::VARCHAR AS drain_id, l_linenumber::VARCHAR AS trip_no, trip_id,
       l_partkey::VARCHAR AS vehicle_no, l_quantity::DECIMAL(18,3) AS claimed, l_orderkey
FROM v_load JOIN supplier ON s_suppkey = l_suppkey""")
view("v_sslip", """
SELECT trip_id AS slip_key, CASE WHEN l_linenumber = 6 THEN 'ERROR' ELSE 'OK' END AS status,
       (l_partkey + CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 1 ELSE 0 END)::VARCHAR AS vehicle_no,
       CASE WHEN l_tax = 0 THEN NULL ELSE l_quantity END AS net
FROM v_load WHERE l_linenumber <> 7""")
view("v_svehicle", "SELECT p_partkey::VARCHAR AS vehicle_no, p_size::DOUBLE AS capacity FROM part")
view("v_sjudged", """
SELECT t.*, s.slip_key IS NOT NULL AS found, s.status, s.net, s.vehicle_no AS slip_vehicle, v.capacity
FROM v_strip t LEFT JOIN v_sslip s ON s.slip_key = t.trip_id LEFT JOIN v_svehicle v ON v.vehicle_no = t.vehicle_no""")

view("v_point", """
SELECT (user_id % 25)::VARCHAR AS bill_id, user_id,
       user_id || '-' || (date_diff('day', TIMESTAMP '2024-01-01', ts) // 3) AS trace_key, event_id AS seq, ts,
       epoch_us(ts) AS us, 19.00::DOUBLE + value / 5000 AS lat,
       72.80::DOUBLE + json_extract_string(props, '$.k')::DOUBLE / 1000 AS lon FROM events""")
view("v_inside", """
SELECT p.*, b.has_site AND lon >= 72.845::DOUBLE AND lon < 72.855::DOUBLE AND lat >= 19.0::DOUBLE AND lat < 19.01::DOUBLE AS inside
FROM v_point p JOIN v_bill b USING (bill_id)""")
view("v_gapped", """
SELECT *, (us - lag(us) OVER (PARTITION BY trace_key ORDER BY us)) / 1e6 AS gap_s FROM v_inside""")
view("v_fact", """
SELECT bill_id, trace_key, user_id, count(*) AS n, min(seq) AS seq0, max(seq) AS seq1,
       arg_min(us, seq) AS us0, arg_max(us, seq) AS us1, arg_min(lon, seq) AS lon0, arg_min(lat, seq) AS lat0,
       arg_max(lon, seq) AS lon1, arg_max(lat, seq) AS lat1, max(gap_s) AS gap_s, bool_or(inside) AS entered,
       arg_min(us, seq) FILTER (WHERE inside) AS us_in FROM v_gapped GROUP BY ALL""")
view("v_ttrip", """
SELECT bill_id, (user_id % 7)::VARCHAR AS drain_id, trace_key AS trip_id, user_id, user_id::VARCHAR AS vehicle_no,
       (5 + n)::DECIMAL(18,3) AS claimed, n, us0, us1, lon0, lat0, lon1, lat1, gap_s, entered,
       coalesce(us_in, us1) AS us_arr FROM v_fact""")
view("v_tslip", """
SELECT trace_key AS slip_key, CASE WHEN user_id % 13 = 0 THEN 'ERROR' ELSE 'OK' END AS status,
       CASE WHEN user_id % 17 <> 0 THEN (user_id + CASE WHEN n % 9 = 0 THEN 1 ELSE 0 END)::VARCHAR END AS vehicle_no,
       CASE WHEN n % 8 <> 0 THEN (5 + n)::DOUBLE END AS net,
       CASE WHEN user_id % 19 <> 0 THEN strftime(make_timestamp(us0), '%H:%M') END AS time_in
FROM v_fact WHERE user_id % 11 <> 0""")
view("v_uvehicle", """
SELECT DISTINCT user_id::VARCHAR AS vehicle_no, (8 + user_id % 15)::DOUBLE AS capacity FROM events WHERE user_id % 10 <> 0""")
view("v_leg", """
SELECT *, lead(trip_id) OVER w AS next_id, lead(us0) OVER w AS next_us0, lead(lon0) OVER w AS next_lon, lead(lat0) OVER w AS next_lat
FROM v_ttrip WINDOW w AS (PARTITION BY bill_id, vehicle_no ORDER BY us0, trip_id)""")
HAVERSINE = (
    "2 * 6371000.0::DOUBLE * asin(sqrt(power(sin((radians({lat2}) - radians({lat1})) / 2), 2)"
    " + cos(radians({lat1})) * cos(radians({lat2})) * power(sin((radians({lon2}) - radians({lon1})) / 2), 2)))"
)


def haversine(lon1, lat1, lon2, lat2):
    return HAVERSINE.format(lon1=lon1, lat1=lat1, lon2=lon2, lat2=lat2)


view("v_pair", f"""
SELECT bill_id, vehicle_no, trip_id, next_id, (next_us0 - us1) / 60e6 AS minutes,
       {haversine("lon1", "lat1", "next_lon", "next_lat")} / 1000 AS km
FROM v_leg WHERE next_id IS NOT NULL""")
view("v_clash", """
SELECT * FROM (SELECT *, CASE WHEN minutes <= 0 THEN 'infinity'::DOUBLE ELSE km / (minutes / 60) END AS kmh FROM v_pair) WHERE kmh > 1.0""")
view("v_clash_side", """
SELECT bill_id, trip_id, next_id AS other, minutes, km, kmh FROM v_clash
UNION ALL SELECT bill_id, next_id AS trip_id, trip_id AS other, minutes, km, kmh FROM v_clash""")
view("v_minutes", """
SELECT t.trip_id, k, ((us_arr // 86400000000 + k) * 86400000000
         + (split_part(s.time_in, ':', 1)::INT * 60 + split_part(s.time_in, ':', 2)::INT) * 60000000::BIGINT - us_arr) / 60e6 AS d
FROM v_ttrip t JOIN v_tslip s ON s.slip_key = t.trip_id, (VALUES (-1), (0), (1)) x(k) WHERE s.time_in IS NOT NULL""")
view("v_delta", "SELECT trip_id, arg_min(d, {'a': abs(d), 'k': k}) AS delta FROM v_minutes GROUP BY trip_id")

view("v_photo", """
SELECT label::VARCHAR AS bill_id, (vec_id % 7)::VARCHAR AS drain_id, vec_id,
       CASE vec_id % 3 WHEN 0 THEN 'before' WHEN 1 THEN 'after' ELSE 'load' END AS role,
       'photos/' || label || '/drain' || (vec_id % 7) || '/' || CASE vec_id % 3 WHEN 0 THEN 'before' WHEN 1 THEN 'after' ELSE 'load' END
         || '-' || vec_id || '.jpg' AS s3_key,
       vec_id % 29 = 0 AS failed, vec_id % 5 <> 0 AS has_gps,
       72.80::DOUBLE + (vec_id % 7) * 0.01::DOUBLE + (vec_id % 41) * 0.0002::DOUBLE AS lon,
       19.003::DOUBLE + (vec_id % 23) * 0.0003::DOUBLE AS lat,
       CASE WHEN vec_id % 11 <> 0 THEN DATE '1995-06-01' + (vec_id % 2300)::INT END AS taken,
       list_transform(embedding, lambda x: x > 0) AS bits,
       vec_id % 13 <> 0 AS ok, vec_id % 4 <> 0 AS cleared,
       CASE (vec_id // 3) % 3 WHEN 0 THEN 'silt' WHEN 1 THEN 'debris' ELSE 'unclear' END AS load_type,
       (vec_id % 100) / 100.0::DOUBLE AS confidence FROM embeddings""")
view("v_reuse_pair", """
SELECT a.bill_id, a.s3_key, b.s3_key AS original, b.drain_id AS original_owner,
       64 - list_sum(list_transform(list_zip(a.bits, b.bits), lambda z: (z[1] = z[2])::INT))::INT AS distance,
       row_number() OVER (PARTITION BY a.bill_id, a.s3_key
         ORDER BY coalesce(b.taken::VARCHAR, ''), b.s3_key) AS rn
FROM v_photo a JOIN v_photo b ON a.bill_id = b.bill_id
 AND (coalesce(b.taken::VARCHAR, ''), b.s3_key) < (coalesce(a.taken::VARCHAR, ''), a.s3_key)
WHERE 64 - list_sum(list_transform(list_zip(a.bits, b.bits), lambda z: (z[1] = z[2])::INT)) <= 20""")
view("v_reuse", "SELECT bill_id, s3_key, original, original_owner, distance FROM v_reuse_pair WHERE rn = 1")
view("v_wdrain", """
SELECT n_nationkey::VARCHAR AS bill_id, d::VARCHAR AS drain_id, d, 72.80::DOUBLE + d * 0.01::DOUBLE AS clon, 19.003::DOUBLE AS clat,
       100.0::DOUBLE AS length_m, CASE WHEN d <> 6 THEN 2.0::DOUBLE END AS width_m, 0.5::DOUBLE + d * 0.5::DOUBLE AS depth_m,
       CASE WHEN d = 5 THEN 250.0::DOUBLE END AS plausible, CASE d WHEN 1 THEN 'APPROVE' WHEN 2 THEN 'HOLD' END AS decision
FROM nation, range(0, 7) r(d)""")
