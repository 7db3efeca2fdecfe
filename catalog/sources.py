"""Readers, ingest control and sinks. Raw documents are built from the tables by Spark,
one per row, and read back with the same operators a file scan uses."""

from pyspark.sql import functions as F

from loadaudit.functions import geo, money
from loadaudit.plans import bill
from loadaudit.plans.fixturemap import FIXTURE_LIMITS, Fixture
from loadaudit.plans.staging import shared_folder
from loadaudit.sources import features, files, manifests, readings, runs, tables, traces

from . import sqlviews
from .bill import GAPS_SQL, patchy_case
from .registry import query, view

KEY_SQL = """CASE l_linenumber % 5 WHEN 0 THEN 'photos/B' || (l_suppkey % 25) || '/drain' || l_suppkey || '/after-' || l_orderkey || '.jpg'
  WHEN 1 THEN 'slips/B' || (l_suppkey % 25) || '/' || l_suppkey || '-' || printf('%03d', l_orderkey % 1000) || '.png'
  WHEN 2 THEN 'traces/B' || (l_suppkey % 25) || '/' || l_suppkey || '-' || l_orderkey || '.json'
  WHEN 3 THEN 'photos/loose-' || l_orderkey || '.jpg' ELSE 'misc/' || l_orderkey || '.txt' END"""


def keys(fx):
    s, o = F.col("l_suppkey").cast("string"), F.col("l_orderkey").cast("string")
    b = F.concat(F.lit("B"), (F.col("l_suppkey") % 25).cast("string"))
    k = F.col("l_linenumber") % 5
    key = (
        F.when(k == 0, F.concat(F.lit("photos/"), b, F.lit("/drain"), s, F.lit("/after-"), o, F.lit(".jpg")))
        .when(k == 1, F.concat(F.lit("slips/"), b, F.lit("/"), s, F.lit("-"), F.lpad((F.col("l_orderkey") % 1000).cast("string"), 3, "0"), F.lit(".png")))
        .when(k == 2, F.concat(F.lit("traces/"), b, F.lit("/"), s, F.lit("-"), o, F.lit(".json")))
        .when(k == 3, F.concat(F.lit("photos/loose-"), o, F.lit(".jpg")))
        .otherwise(F.concat(F.lit("misc/"), o, F.lit(".txt")))
    )
    return fx._loads.withColumn("key", key).withColumn("owner", b)


@query("src_01_key_fields", f"""
SELECT trip_id, CASE WHEN k LIKE 'photos/%' THEN 'PHOTO' WHEN k LIKE 'slips/%' THEN 'SLIP' WHEN k LIKE 'traces/%' THEN 'TRACE' ELSE 'UNKNOWN' END AS kind,
 CASE WHEN n < 3 THEN 'B' || (l_suppkey % 25) END AS bill_id, CASE WHEN n < 3 THEN l_suppkey::VARCHAR END AS drain_id,
 CASE n WHEN 1 THEN printf('%03d', l_orderkey % 1000) WHEN 2 THEN l_orderkey::VARCHAR END AS trip_no, CASE n WHEN 0 THEN 'after' END AS role
FROM (SELECT *, {KEY_SQL} AS k, l_linenumber % 5 AS n FROM v_load)""")
def src_01(spark, d):
    return files.key_fields(keys(Fixture(spark, d))).select("trip_id", "kind", "bill_id", "drain_id", "trip_no", "role")


# ------------------------------------------------------------------ traces
def trace_texts(fx):
    """A trace text per event: three shapes and a broken one; one point lacks its latitude."""
    lat, lon, t = F.col("lat"), F.col("lon"), F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss")
    points = F.concat(
        F.lit("[{\"lat\":"), lat, F.lit(",\"lon\":"), lon, F.lit(",\"t\":\""), t, F.lit("\"},{\"lon\":1.5},["), lon, F.lit(","), lat,
        F.lit("],{\"lat\":\""), lat, F.lit("\",\"lon\":"), lon, F.lit(",\"timestamp\":\""), t, F.lit("\"}]"),
    )
    k = F.col("seq") % 4
    content = (
        F.when(k == 0, F.concat(F.lit('{"vehicleNo":"V1","points":'), points, F.lit("}")))
        .when(k == 1, F.concat(F.lit('{"points":[],"Points":'), points, F.lit("}")))
        .when(k == 2, points).otherwise(F.concat(F.lit("{"), points))
    )
    return fx.points.select(F.col("seq").cast("string").alias("trace_key"), content.alias("content"))


@query("src_02_read_traces", """
SELECT seq::VARCHAR AS trace_key, k AS seq, lat, lon, CASE k WHEN 1 THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS t FROM v_point, range(0, 3) r(k) WHERE v_point.seq % 4 <> 3""")
def src_02(spark, d):
    return traces.parse_traces(trace_texts(Fixture(spark, d)))


@query("src_02_problems", """
SELECT seq::VARCHAR AS trace_key, CASE WHEN seq % 4 = 0 THEN 'V1' END AS vehicle_no, CASE WHEN seq % 4 = 3 THEN 0 ELSE 3 END AS point_count,
 CASE WHEN seq % 4 = 3 THEN 'unparseable_trace,no_points' ELSE '' END AS problems FROM v_point""")
def src_02_problems(spark, d):
    out = traces.trace_problems(trace_texts(Fixture(spark, d)))
    return out.select("trace_key", "vehicle_no", "point_count", F.array_join("problems", ",").alias("problems"))


def geojson_texts(fx):
    lat, lon = F.col("lat"), F.col("lon")
    t = F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("seq") % 6
    second = F.when(k == 5, F.lit("")).otherwise(F.concat(F.lit(',"'), t, F.lit('Z"')))
    shape = F.when(k == 4, F.lit("Point")).otherwise(F.lit("LineString"))
    feature = F.concat(
        F.lit('{"type":"Feature","properties":{"vehicleNo":"wb-1","times":["'), t, F.lit('Z"'), second, F.lit(']},"geometry":{"type":"'), shape,
        F.lit('","coordinates":[['), lon, F.lit(","), lat, F.lit("],["), lon, F.lit(",19.5]]}}"),
    )
    collection = F.concat(F.lit('{"type":"FeatureCollection","features":['), feature, F.when(k == 2, F.concat(F.lit(","), feature)).otherwise(F.lit("")), F.lit("]}"))
    content = F.when(k.isin(1, 2), collection).when(k == 3, F.lit("[[1,2]]")).otherwise(feature)
    return fx.points.select(F.col("seq").cast("string").alias("trace_key"), content.alias("content"))


@query("src_03_geojson", """
SELECT seq::VARCHAR AS trace_key, CASE WHEN seq % 6 IN (0, 1, 4, 5) THEN 'geojson' END AS format,
 CASE seq % 6 WHEN 2 THEN 'a GeoJSON FeatureCollection must hold exactly one trace' WHEN 4 THEN 'the GeoJSON geometry must be a LineString'
  WHEN 5 THEN 'GeoJSON traces need properties.times with one timestamp per coordinate'
  WHEN 3 THEN 'unrecognised trace format: use {"points": [{"lat", "lon", "t"}]} or a GeoJSON LineString Feature with properties.times' END AS reason,
 CASE WHEN seq % 6 < 2 THEN 2 ELSE 0 END AS points, CASE WHEN seq % 6 < 2 THEN round(lat + 19.5::DOUBLE, 6) END AS lat_sum FROM v_point""")
def src_03(spark, d):
    heads = traces.strict_headers(geojson_texts(Fixture(spark, d)))
    lats = F.aggregate("raw", F.lit(0.0), lambda a, p: a + p["lat"])
    fmt = F.when(F.col("reason").startswith("a GeoJSON FeatureCollection"), F.lit(None)).otherwise(F.col("format"))
    return heads.select(
        "trace_key", fmt.alias("format"), "reason", F.coalesce(F.size("raw"), F.lit(0)).alias("points"), F.round(lats, 6).alias("lat_sum")
    )


view("s_strict", """
SELECT user_id::VARCHAR AS trace_key, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, ts FROM events""")


def strict_rows(fx):
    """A trace per user; by user, one of its points is spoiled."""
    from loadaudit.operators.ordered import numbered

    placed = numbered(fx.points, ["user_id"], ["seq"], F.floor(F.col("seq") / 1000), "n").withColumn("i", F.col("n") - 1)
    u, i = F.col("user_id") % 8, F.col("i")
    t = F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss")
    spoiled = (
        F.when((u == 5) & (i == 4), F.lit("yesterday")).when((u == 6) & (i == 2), F.lit("")).when((u == 7) & (i == 3), F.concat(t, F.lit("Z")))
        .when((u == 4) & (i == 2), F.lit("2023-01-01T00:00:00")).otherwise(t)
    )
    lon = F.when((u == 1) & (i == 3), F.lit(None)).when((u == 3) & (i == 1), F.lit(0.0)).otherwise(F.col("lon"))
    lat = F.when((u == 2) & (i == 2), F.lit(95.5)).when((u == 3) & (i == 1), F.lit(0.0)).otherwise(F.col("lat"))
    return placed.select(F.col("user_id").cast("string").alias("trace_key"), i.alias("seq"), lon.alias("lon"), lat.alias("lat"), spoiled.alias("t"))


@query("chk_trc_rejects", """
SELECT trace_key, CASE user_id % 8 WHEN 1 THEN 'point 4 longitude is missing or not a number' WHEN 2 THEN 'point 3 latitude 95.5 is out of range'
  WHEN 3 THEN 'point 2 is [0, 0], which is not a real fix' WHEN 4 THEN 'timestamps go backwards at point 3 (2023-01-01T00:00:00 after ' || strftime(any_value(ts) FILTER (WHERE i = 1), '%Y-%m-%dT%H:%M:%S') || ')'
  WHEN 5 THEN 'point 5 timestamp is not ISO 8601' WHEN 6 THEN 'point 3 has no timestamp' WHEN 7 THEN 'timestamps mix timezone offsets with times that have none' END AS reason
FROM s_strict WHERE user_id % 8 <> 0 GROUP BY trace_key, user_id""")
def chk_trc(spark, d):
    _, rejected = traces.validate_traces(strict_rows(Fixture(spark, d)), ("trace_key",), block=16)
    return rejected


@query("chk_sum", f"""
SELECT trace_key, count(*) AS n_points, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS start_time, printf('%.1f', sum(step_m))::DOUBLE AS distance_m,
  max(secs) AS max_gap_s, min(lon) AS min_lon, 'Timestamps carry no timezone offset; they are compared as local times.' AS warnings, least(count(*), 300) AS kept
FROM (SELECT *, {sqlviews.haversine("plon", "plat", "lon", "lat")} AS step_m, epoch(t) - lag(epoch(t)) OVER w AS secs FROM (
  SELECT user_id::VARCHAR AS trace_key, event_id, ts, date_trunc('second', ts) AS t, 72.80::DOUBLE + json_extract_string(props, '$.k')::DOUBLE / 1000 AS lon, 19.00::DOUBLE + value / 5000 AS lat,
   lag(72.80::DOUBLE + json_extract_string(props, '$.k')::DOUBLE / 1000) OVER (PARTITION BY user_id ORDER BY event_id) AS plon,
   lag(19.00::DOUBLE + value / 5000) OVER (PARTITION BY user_id ORDER BY event_id) AS plat FROM events WHERE user_id % 8 = 0) WINDOW w AS (PARTITION BY trace_key ORDER BY event_id))
GROUP BY trace_key""")
def chk_sum(spark, d):
    """Summaries of the traces that validation accepts."""
    good, _ = traces.validate_traces(strict_rows(Fixture(spark, d)), ("trace_key",), block=16)
    out = traces.trace_summary(good, ("trace_key",), block=16)
    # Same-position steps depend on the data; only the fixed remark is compared.
    return out.select(
        "trace_key", "n_points", "start_time", "distance_m", "max_gap_s", "min_lon", F.get("warnings", F.lit(0)).alias("warnings"),
        F.size("route").cast("bigint").alias("kept"),
    )


# ---------------------------------------------------------------- geometry
def feature_texts(fx):
    k = F.col("s_suppkey")
    ring = F.concat(F.lit("[["), k, F.lit(".0,1.0],["), k, F.lit(".5,1.0],["), k, F.lit(".5,2.0],["), k, F.lit(".0,1.0]]"))
    shape = (
        F.when(k % 3 == 0, F.concat(F.lit('{"type":"Polygon","coordinates":['), ring, F.lit("]}")))
        .when(k % 3 == 1, F.concat(F.lit('{"type":"MultiPolygon","coordinates":[['), ring, F.lit("],["), ring, F.lit("]]}")))
        .otherwise(F.lit('{"type":"Point","coordinates":[1,2]}'))
    )
    content = F.concat(
        F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":'), shape, F.lit(',"properties":{"drainId":"'), k,
        F.lit('","name":"'), F.col("s_name"), F.lit('","lengthM":'), (k + 10).cast("double"), F.lit(',"centreline":[['), k, F.lit(",1.5],["), k, F.lit(",2.5]]}}]}"),
    )
    return fx.table("supplier").select(content.alias("content"))


@query("src_04_features", """
SELECT s_suppkey::VARCHAR AS drain_id, s_name AS name, (s_suppkey + 10)::DOUBLE AS length_m, CASE s_suppkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS polygons,
 CASE WHEN s_suppkey % 3 < 2 THEN 4 END AS vertices, CASE WHEN s_suppkey % 3 < 2 THEN s_suppkey + 0.5::DOUBLE END AS east, 2 AS line_vertices FROM supplier""")
def src_04(spark, d):
    out = features.parse_features(feature_texts(Fixture(spark, d)))
    ring = F.get(F.get("geofence", F.lit(0)), F.lit(0))
    return out.select(
        "drain_id", "name", "length_m", F.when(F.col("geofence").isNotNull(), F.size("geofence")).alias("polygons"),
        F.when(F.col("geofence").isNotNull(), F.size(ring)).alias("vertices"), F.get(ring, F.lit(1))["lon"].alias("east"), F.size("centreline").alias("line_vertices"),
    )


WAY_TAGS = ["primary", "residential", "footway", "", "", ""]


def way_texts(fx):
    k = F.col("p_partkey")
    n = k % 6
    x = 72.8 + (k % 100) * 0.0001
    far = x + F.when(k % 4 == 0, 0.0002).otherwise(0.009)
    tags = (
        F.when(n == 0, F.lit('"highway":"primary"')).when(n == 1, F.lit('"highway":"residential"')).when(n == 2, F.lit('"highway":"footway"'))
        .when(n == 3, F.lit('"natural":"water"')).when(n == 4, F.lit('"waterway":"canal"')).otherwise(F.lit('"landuse":"basin"'))
    )
    point = lambda lat, lon: F.concat(F.lit('{"lat":'), lat, F.lit(',"lon":'), lon, F.lit("}"))
    base = F.concat(point(F.lit("19.0"), x), F.lit(","), point(F.lit("19.0"), far), F.lit(',{"lat":null,"lon":1.0}'))
    closed = F.concat(base, F.lit(","), point(F.lit("19.01"), far), F.lit(","), point(F.lit("19.0"), x))
    line = F.when(n == 3, closed).when(k % 50 == 7, point(F.lit("19.0"), x)).otherwise(base)
    kind = F.when(k % 31 == 0, F.lit("node")).otherwise(F.lit("way"))
    content = F.concat(
        F.lit('{"elements":[{"type":"'), kind, F.lit('","id":'), k, F.lit(',"geometry":['), line, F.lit('],"tags":{"name":"'), F.col("p_name"), F.lit('",'), tags, F.lit("}}]}"),
    )
    return fx.table("part").select(content.alias("content"))


X, FAR = "72.8::DOUBLE + (p_partkey % 100) * 0.0001::DOUBLE", "72.8::DOUBLE + (p_partkey % 100) * 0.0001::DOUBLE + CASE WHEN p_partkey % 4 = 0 THEN 0.0002::DOUBLE ELSE 0.009::DOUBLE END"
view("s_way", f"""
SELECT p_partkey, p_name, p_partkey % 6 AS n, CASE WHEN p_partkey % 6 = 3 THEN {sqlviews.haversine(X, "19.0::DOUBLE", FAR, "19.0::DOUBLE")}
  + {sqlviews.haversine(FAR, "19.0::DOUBLE", FAR, "19.01::DOUBLE")} + {sqlviews.haversine(FAR, "19.01::DOUBLE", X, "19.0::DOUBLE")}
  ELSE {sqlviews.haversine(X, "19.0::DOUBLE", FAR, "19.0::DOUBLE")} END AS len
FROM part WHERE p_partkey % 31 <> 0 AND (p_partkey % 6 = 3 OR p_partkey % 50 <> 7)""")


@query("src_05_osm_lines", """
SELECT p_partkey AS osm_id, p_name AS name, CASE WHEN n = 4 THEN 'canal' END AS waterway, CASE WHEN n = 3 THEN 4 ELSE 2 END AS vertices, printf('%.1f', len)::DOUBLE AS length_m FROM s_way""")
def src_05(spark, d):
    return features.osm_lines(features.parse_ways(way_texts(Fixture(spark, d)))).select("osm_id", "name", "waterway", F.size("line").alias("vertices"), "length_m")


@query("src_06_classify_osm", """
SELECT p_partkey AS osm_id, CASE WHEN n < 2 THEN 'road' ELSE 'water' END AS kind, CASE n WHEN 0 THEN 'major' WHEN 1 THEN 'minor' WHEN 4 THEN 'line' ELSE 'body' END AS class,
 CASE WHEN n = 3 THEN 'Polygon' ELSE 'LineString' END AS shape FROM s_way WHERE n <> 2 AND (n > 1 OR len >= 40)""")
def src_06(spark, d):
    return features.classify_ways(features.parse_ways(way_texts(Fixture(spark, d)))).select("osm_id", "kind", "class", "shape")


@query("flt_05_split_lines", """
SELECT o_orderkey, CASE WHEN p > 1 THEN i + 1 END AS section, CASE WHEN p = 1 THEN n ELSE least(n, (i + 1) * n // p + 1) - i * n // p END AS vertices FROM (
  SELECT o_orderkey, 2 + o_orderkey % 9 AS n, greatest(1, ceil(o_totalprice / 100000)::INT) AS p FROM orders) q, range(0, 6) r(i)
WHERE i < p AND (p = 1 OR least(n, (i + 1) * n // p + 1) - i * n // p >= 2)""")
def flt_05(spark, d):
    n = (F.lit(2) + F.col("o_orderkey") % 9).cast("int")
    line = F.transform(F.sequence(F.lit(1), n), lambda i: geo.pt(F.lit(72.8) + i * 0.001, F.lit(19.0)))
    lines = Fixture(spark, d).table("orders").select("o_orderkey", line.alias("line"), F.col("o_totalprice").alias("length_m"))
    return features.split_lines(lines, 100000.0).select("o_orderkey", F.col("section").cast("int").alias("section"), F.size("line").cast("bigint").alias("vertices"))


# --------------------------------------------------------------- manifests
def manifest_rows(fx):
    o = F.col("o_orderkey")
    return fx.table("orders").select(
        o.alias("row_number"),
        F.when(o % 13 != 0, F.concat(F.lit(" img"), o.cast("string"), F.lit(".JPG "))).alias("filename"),
        (F.col("o_custkey") % 40).cast("string").alias("drainId"),
        F.when(o % 4 == 0, F.lit("Before")).when(o % 4 == 1, F.lit("after ")).when(o % 4 == 2, F.lit("LOAD")).otherwise(F.lit("later")).alias("role"),
        F.col("o_orderpriority").alias("note"),
    )


@query("src_07_manifest", """
SELECT o_orderkey AS row_number, o_orderkey % 13 <> 0 AND o_orderkey % 4 <> 3 AS usable FROM orders""")
def src_07(spark, d):
    good, bad = manifests.split_manifest(manifest_rows(Fixture(spark, d)))
    return good.select("row_number", F.lit(True).alias("usable")).unionByName(bad.select("row_number", F.lit(False).alias("usable")))


@query("win_07_number_photos", """
SELECT o_orderkey AS row_number, row_number() OVER (PARTITION BY o_custkey % 40, o_orderkey % 4 ORDER BY o_orderkey) AS sequence FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 4 <> 3""")
def win_07(spark, d):
    good, _ = manifests.split_manifest(manifest_rows(Fixture(spark, d)))
    return manifests.number_photos(good, "row_number").select("row_number", "sequence")


@query("ing_07_validate_uploads", """
SELECT doc_id, code, CASE WHEN code IS NULL THEN substr(regexp_replace(CASE WHEN name = '' THEN 'upload' ELSE name END, '[\\\\/]', '_', 'g'), 1, 120) END AS name FROM (SELECT doc_id, name, CASE WHEN g IS NULL THEN 'UNSUPPORTED_GROUP' WHEN g = 'trace' THEN 'UNSUPPORTED_TYPE' WHEN n_chars % 10 = 0 THEN 'INVALID_REQUEST' WHEN n_chars % 10 = 1 THEN 'EMPTY_FILE'
   WHEN n_chars * 2000 > CASE g WHEN 'photo' THEN 15 ELSE 10 END * 1048576 THEN 'FILE_TOO_LARGE' WHEN g = 'photo' AND doc_id % 7 = 0 THEN 'INVALID_ROLE' WHEN g <> 'photo' AND doc_id % 7 < 2 THEN 'INVALID_ROLE' WHEN length(name) > 200 THEN 'INVALID_REQUEST' END AS code
FROM (SELECT *, CASE lang WHEN 'en' THEN 'photo' WHEN 'fr' THEN 'slip' WHEN 'de' THEN 'trace' END AS g, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\\x00-\\x1f\\x7f]', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM documents))""")
def ing_07(spark, d):
    lang, n, k = F.col("lang"), F.col("n_chars"), F.col("doc_id")
    rows = Fixture(spark, d).table("documents").select(
        "doc_id",
        F.when(lang == "en", F.lit("photo")).when(lang == "fr", F.lit("slip")).when(lang == "de", F.lit("trace")).otherwise(F.lit("memo")).alias("group"),
        F.lit(" Image/JPG ").alias("content_type"),
        F.when(n % 10 == 0, F.lit("1.5")).when(n % 10 == 1, F.lit("0")).otherwise((n * 2000).cast("string")).alias("size"),
        F.when(k % 7 == 0, F.lit("hero")).when(k % 7 == 1, F.lit("after")).alias("role"),
        F.col("text").alias("filename"),
    )
    return manifests.validate_uploads(rows).select("doc_id", "code", F.col("settled_name").alias("name"))


def slots(fx):
    return fx.table("nation").select(F.explode(F.sequence(F.lit(0), F.lit(1))).alias("h"), "n_nationkey").select(
        (F.col("n_nationkey") + 25 * F.col("h")).cast("string").alias("drainId"), F.explode(F.array(F.lit("before"), F.lit("load"))).alias("role")
    )


@query("set_02_slot_gaps", """
SELECT 'unfilled' AS what, s.d::VARCHAR AS drain_id, s.role FROM (SELECT d, role FROM range(0, 50) r(d), (VALUES ('before'), ('load')) v(role)) s
 ANTI JOIN (SELECT o_custkey % 40 AS d, CASE o_orderkey % 4 WHEN 0 THEN 'before' WHEN 1 THEN 'after' WHEN 2 THEN 'load' END AS role FROM orders WHERE o_orderkey % 13 <> 0) m USING (d, role)
UNION ALL SELECT DISTINCT 'unknown', (o_custkey % 40)::VARCHAR, 'after' FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 4 = 1""")
def set_02(spark, d):
    fx = Fixture(spark, d)
    good, _ = manifests.split_manifest(manifest_rows(fx))
    unfilled, unknown = manifests.slot_gaps(good, slots(fx))
    named = lambda df, what: df.select(F.lit(what).alias("what"), F.col("drainId").alias("drain_id"), "role")
    return named(unfilled, "unfilled").unionByName(named(unknown, "unknown").distinct())


view("s_source", """
SELECT o_orderkey AS rn, 'f' || (o_orderkey // 2) AS file, (o_orderkey % 60)::VARCHAR AS d, CASE WHEN o_custkey % 2 = 0 THEN 'before' ELSE 'load' END AS role,
 CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'someone' END AS author, CASE WHEN o_orderkey % 7 = 0 THEN 'CC-BY-NC-4.0' ELSE 'CC-BY-4.0' END AS licence,
 CASE WHEN o_orderkey % 5 = 0 THEN 'ftp://x' ELSE 'https://x' END AS url FROM orders""")


@query("dq_01_audit_sources", """
WITH complete AS (SELECT * FROM s_source WHERE author <> ''), first_of AS (SELECT d, role, min(rn) AS f FROM complete WHERE d::INT < 50 GROUP BY ALL)
SELECT rn AS row_number, 'row ' || rn || ' (' || file || '): missing author' AS problem FROM s_source WHERE author = ''
UNION ALL SELECT rn, 'row ' || rn || ' (' || file || '): licence ''' || licence || ''' is not accepted (allowed: CC-BY-2.0, CC-BY-3.0, CC-BY-4.0, CC0-1.0, PDM-1.0, Pexels, Unsplash)' FROM complete WHERE licence <> 'CC-BY-4.0'
UNION ALL SELECT rn, 'row ' || rn || ' (' || file || '): sourceUrl must be the page the photograph came from' FROM complete WHERE url LIKE 'ftp%'
UNION ALL SELECT rn, 'row ' || rn || ' (' || file || '): no generated photo for drain ' || d || ' role ''' || role || '''' FROM complete WHERE d::INT >= 50
UNION ALL SELECT rn, 'row ' || rn || ' (' || file || '): drain ' || d || ' ' || role || ' is already filled by row ' || f FROM complete JOIN first_of USING (d, role) WHERE rn > f
UNION ALL SELECT NULL, 'no photograph for drain ' || s.d || ' ' || s.role FROM (SELECT x::VARCHAR AS d, role FROM range(0, 50) r(x), (VALUES ('before'), ('load')) v(role)) s ANTI JOIN complete USING (d, role)
UNION ALL SELECT NULL, file || ' is used for more than one slot; each slot needs its own photograph' FROM s_source GROUP BY file HAVING count(*) > 1""".replace("WITH complete", "SELECT * FROM (WITH complete", 1) + ")")
def dq_01(spark, d):
    fx = Fixture(spark, d)
    o = F.col("o_orderkey")
    rows = fx.table("orders").select(
        o.alias("row_number"), F.concat(F.lit("f"), F.floor(o / 2).cast("string")).alias("file"), (o % 60).cast("string").alias("drainId"),
        F.when(F.col("o_custkey") % 2 == 0, F.lit("before")).otherwise(F.lit("load")).alias("role"),
        F.when(o % 5 == 0, F.lit("ftp://x")).otherwise(F.lit("https://x")).alias("sourceUrl"),
        F.when(o % 11 != 0, F.lit("someone")).alias("author"), F.when(o % 7 == 0, F.lit("CC-BY-NC-4.0")).otherwise(F.lit("CC-BY-4.0")).alias("licence"),
    )
    return manifests.audit_sources(rows, slots(fx))


# ---------------------------------------------------------------- assembly
@query("src_08_bill_context", """
SELECT bill_id, (SELECT count(*) FROM v_wdrain x WHERE x.bill_id = b.bill_id) AS drains, (SELECT count(*) FROM v_ttrip x WHERE x.bill_id = b.bill_id) AS trips,
 (SELECT count(*) FROM v_photo x WHERE x.bill_id = b.bill_id) AS photos, (SELECT count(*) FROM v_ttrip t JOIN v_tslip s ON s.slip_key = t.trip_id WHERE t.bill_id = b.bill_id) AS slips,
 (SELECT count(*) FROM v_point x WHERE x.bill_id = b.bill_id) AS points, CASE WHEN bill_id::INT % 5 = 0 THEN (SELECT count(*) FROM v_ttrip x WHERE x.bill_id = b.bill_id) END AS touched_trips,
 CASE WHEN bill_id::INT % 5 = 0 THEN (SELECT round(sum(lon) + sum(lat), 3) FROM v_photo x WHERE x.bill_id = b.bill_id AND has_gps) END AS touched_place,
 CASE WHEN bill_id = '7' THEN (SELECT count(*) FROM v_point x WHERE x.bill_id = b.bill_id) END AS own_points FROM v_bill b""")
def src_08(spark, d):
    """Written as tables dealt by bill; loaded back whole, for some bills and for one."""
    fx = Fixture(spark, d)
    root = _fresh(spark, "context")
    tables.save_case(fx.case, root)
    case = tables.load_case(spark, root)
    some = tables.load_case(spark, root, touched=case.bills.select("bill_id").where(F.col("bill_id").cast("int") % 5 == 0))
    one = tables.load_case(spark, root, "7")

    def count(df, name):
        return df.groupBy("bill_id").agg(F.count(F.lit(1)).alias(name))

    def slips_of(c):
        return c.trips.join(c.slips.select("bill_id", F.col("s3_key").alias("slip_key")), ["bill_id", "slip_key"])

    out = case.bills.select("bill_id")
    for df, name in ((case.drains, "drains"), (case.trips, "trips"), (case.photos, "photos"), (slips_of(case), "slips"), (case.points, "points")):
        out = out.join(count(df, name), "bill_id", "left")
    out = out.na.fill(0)
    place = some.photos.where("has_gps").groupBy("bill_id").agg(F.round(F.sum("lon") + F.sum("lat"), 3).alias("touched_place"))
    return (
        out.join(count(some.trips, "touched_trips"), "bill_id", "left").join(place, "bill_id", "left").join(count(one.points, "own_points"), "bill_id", "left")
    )


def _fresh(spark, name):
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("src_09_assemble_bill", """
SELECT bill_id, drain_id, c::DOUBLE AS claimed_tonnes, (c * rate)::BIGINT AS claimed_rupees, printf('%.1f', length_m * width_m * depth_m * 1.4::DOUBLE * 1.2::DOUBLE)::DOUBLE AS plausible_max_tonnes
FROM v_sdrain d JOIN v_bill USING (bill_id) LEFT JOIN (SELECT bill_id, drain_id, sum(claimed) AS c FROM v_strip GROUP BY ALL) USING (bill_id, drain_id)""")
def src_09(spark, d):
    fx = Fixture(spark, d)
    made = tables.assemble_bill(fx.supplier_drains, fx.supplier_trips, fx.bills.drop("claimed_tonnes", "status"))
    return made["drains"].select("bill_id", "drain_id", F.col("claimed_tonnes").cast("double").alias("claimed_tonnes"), "claimed_rupees", "plausible_max_tonnes")


# ---------------------------------------------------------------- readings
def ocr_texts(fx):
    """Slip answers per order: two answers for the net weight, none for the site."""
    o = F.col("o_orderkey")
    doc = o.cast("string")

    def block(alias, *answers):
        ids = ",".join(f'"{alias}-{i}"' for i in range(len(answers)))
        parts = [F.lit('{"BlockType":"QUERY","Id":"q-' + alias + '","Query":{"Alias":"' + alias + '"},"Relationships":[{"Type":"ANSWER","Ids":[' + ids + "]}]}")]
        for i, (value, confidence) in enumerate(answers):
            parts += [F.lit(',{"BlockType":"QUERY_RESULT","Id":"' + f"{alias}-{i}" + '","Text":"'), value, F.lit('","Confidence":'), confidence, F.lit("}")]
        return F.concat(*parts)

    sure, vague = (F.lit(80) + o % 20).cast("string"), (F.lit(50) + o % 40).cast("string")
    net = (F.lit(5) + o % 15).cast("string")
    blocks = [
        block("TICKET_NO", (F.concat(F.lit("WB  "), doc), sure)),
        block("VEHICLE_NO", (F.format_string("mh 0%d ab %04d", (o % 10).cast("int"), (o % 10000).cast("int")), sure)),
        block("GROSS_WEIGHT", (F.concat((F.lit(13) + o % 15).cast("string"), F.lit(".50 T")), sure)),
        block("TARE_WEIGHT", (F.when(o % 6 == 0, F.lit("--")).otherwise(F.lit("8500 kg")), sure)),
        block("NET_WEIGHT", (F.lit(""), F.lit("99")), (F.when(o % 4 == 0, F.lit("n/a")).otherwise(F.concat(net, F.lit(" T"))), vague), (F.lit("77 T"), F.lit("49"))),
        block("TIME_IN", (F.lit("9:42"), vague)), block("TIME_OUT", (F.lit("unclear"), sure)), block("SITE"),
    ]
    content = F.concat(F.lit('{"Blocks":['), F.concat_ws(",", *blocks), F.lit("]}"))
    return fx.dealt(fx.table("orders")).select(doc.alias("doc"), content.alias("content"))


@query("src_10_ocr_answers", """
SELECT o_orderkey::VARCHAR AS doc, alias, CASE alias WHEN 'TICKET_NO' THEN 'WB  ' || o_orderkey WHEN 'VEHICLE_NO' THEN printf('mh 0%d ab %04d', o_orderkey % 10, o_orderkey % 10000)
  WHEN 'GROSS_WEIGHT' THEN (13 + o_orderkey % 15) || '.50 T' WHEN 'TARE_WEIGHT' THEN CASE WHEN o_orderkey % 6 = 0 THEN '--' ELSE '8500 kg' END
  WHEN 'NET_WEIGHT' THEN CASE WHEN o_orderkey % 4 = 0 THEN 'n/a' ELSE (5 + o_orderkey % 15) || ' T' END WHEN 'TIME_IN' THEN '9:42' WHEN 'TIME_OUT' THEN 'unclear' END AS text,
 CASE WHEN alias = 'SITE' THEN NULL WHEN alias IN ('NET_WEIGHT', 'TIME_IN') THEN 50 + o_orderkey % 40 ELSE 80 + o_orderkey % 20 END::DOUBLE AS confidence
FROM orders, (VALUES ('TICKET_NO'), ('VEHICLE_NO'), ('GROSS_WEIGHT'), ('TARE_WEIGHT'), ('NET_WEIGHT'), ('TIME_IN'), ('TIME_OUT'), ('SITE')) v(alias)""")
def src_10(spark, d):
    return readings.ocr_answers(ocr_texts(Fixture(spark, d)))


@query("src_11_slip_records", """
SELECT o_orderkey::VARCHAR AS s3_key, 'WB ' || o_orderkey AS ticket_no, printf('MH %02d AB %04d', o_orderkey % 10, o_orderkey % 10000) AS vehicle_no, (13 + o_orderkey % 15) + 0.5::DOUBLE AS gross,
 CASE WHEN o_orderkey % 6 <> 0 THEN 8.5::DOUBLE END AS tare, CASE WHEN o_orderkey % 4 <> 0 THEN (5 + o_orderkey % 15)::DOUBLE WHEN o_orderkey % 6 <> 0 THEN (5 + o_orderkey % 15)::DOUBLE END AS net,
 '09:42' AS time_in, array_to_string(list_filter([CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 6 = 0 THEN 'net' END, 'site', CASE WHEN o_orderkey % 6 = 0 THEN 'tare' END, 'timeOut'], lambda x: x IS NOT NULL), ',') AS missing,
 CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 6 <> 0 THEN 'gross-tare' END AS derived FROM orders""")
def src_11(spark, d):
    rows = readings.slip_rows(readings.read_slips(ocr_texts(Fixture(spark, d))))
    return rows.select(
        "s3_key", "ticket_no", "vehicle_no", "gross", "tare", "net", "time_in", F.array_join("missing_fields", ",").alias("missing"), F.col("net_derived").alias("derived")
    )


@query("src_11_from_answers", """
SELECT count(*) AS docs, count(*) FILTER (WHERE o_orderkey % 4 <> 0 OR o_orderkey % 6 <> 0) AS with_net, count(*) FILTER (WHERE o_orderkey % 6 <> 0) AS with_tare FROM orders""")
def src_11_long(spark, d):
    """The same records from the long answers, by a pivot."""
    records = readings.slip_records(readings.ocr_answers(ocr_texts(Fixture(spark, d))))
    return records.agg(F.count(F.lit(1)).alias("docs"), F.count_if("net.ok").alias("with_net"), F.count_if("tare.ok").alias("with_tare"))


def vision_texts(fx):
    """Answers per document: the tool, fenced JSON, JSON in prose, wrong types, plain prose."""
    k = F.col("doc_id") % 5
    notes = F.to_json(F.struct(F.col("text").alias("t")))
    quoted = F.expr("substring(n, 6, length(n) - 6)")
    body = F.concat(F.lit('{"cleared":true,"load_type":"Silt","confidence":'), (F.col("n_chars") % 100).cast("string"), F.lit(',"notes":'), quoted, F.lit("}"))
    small = F.concat(F.lit('{\\"cleared\\": \\"no\\", \\"load_type\\": \\"debris\\", \\"confidence\\": 0.'), (F.col("n_chars") % 9 + 1).cast("string"), F.lit(', \\"notes\\": \\"x\\"}'))
    wrong = F.lit('{"cleared":"yes","load_type":"rubble","confidence":"high","notes":["a","b"]}')
    block = (
        F.when(k == 0, F.concat(F.lit('{"toolUse":{"name":"record_photo_check","input":'), body, F.lit("}}")))
        .when(k == 1, F.concat(F.lit('{"text":"Here:\\n```json\\n'), small, F.lit('\\n```\\n"}')))
        .when(k == 2, F.concat(F.lit('{"text":"I think '), small, F.lit(' is right"}')))
        .when(k == 3, F.concat(F.lit('{"toolUse":{"name":"record_photo_check","input":'), wrong, F.lit("}}")))
        .otherwise(F.lit('{"text":" I cannot help. "}'))
    )
    content = F.concat(F.lit('{"output":{"message":{"content":['), block, F.lit("]}}}"))
    return fx.table("documents").withColumn("n", notes).select(F.col("doc_id").alias("doc"), content.alias("content"))


@query("src_12_vision_verdicts", """
SELECT doc_id AS doc, k IN (0, 3) AS cleared, CASE k WHEN 0 THEN 'silt' WHEN 1 THEN 'debris' WHEN 2 THEN 'debris' ELSE 'unclear' END AS load_type,
 printf('%.3f', CASE WHEN k = 0 THEN CASE WHEN n_chars % 100 > 1 THEN (n_chars % 100) / 100.0::DOUBLE ELSE n_chars % 100 END WHEN k < 3 THEN (n_chars % 9 + 1) / 10.0::DOUBLE WHEN k = 3 THEN 0.85::DOUBLE ELSE 0.0::DOUBLE END::DOUBLE)::DOUBLE AS confidence,
 CASE k WHEN 0 THEN md5(substr(regexp_replace(text, '^[ \\t\\n\\x0b\\f\\r]+|[ \\t\\n\\x0b\\f\\r]+$', '', 'g'), 1, 500)) WHEN 3 THEN md5('["a", "b"]') WHEN 4 THEN md5('I cannot help.') ELSE md5('x') END AS notes,
 k < 3 AS ok, CASE WHEN k IN (0, 3) THEN 'tool_use' WHEN k = 4 THEN 'none' ELSE 'text_json' END AS source,
 CASE k WHEN 3 THEN 'load_type_out_of_enum,confidence_not_a_number,notes_not_a_string' WHEN 4 THEN 'no_structured_output' ELSE '' END AS problems
FROM (SELECT *, doc_id % 5 AS k FROM documents)""")
def src_12(spark, d):
    out = readings.vision_verdicts(vision_texts(Fixture(spark, d)))
    return out.select("doc", "cleared", "load_type", "confidence", F.md5(F.col("notes").cast("binary")).alias("notes"), "ok", "source", F.array_join("problems", ",").alias("problems"))


@query("src_13_route_points", """
SELECT o_orderkey::VARCHAR AS doc, CASE WHEN o_orderkey % 10 = 0 THEN 0 WHEN o_orderkey % 3 = 0 THEN 3 ELSE 4 END AS points,
 CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN o_orderkey::DOUBLE ELSE 7.0::DOUBLE END AS distance_m, o_orderkey % 10 <> 0 AS ok FROM orders""")
def src_13(spark, d):
    o = F.col("o_orderkey")
    x = (F.lit(1) + o % 90).cast("string")
    bend = F.when(o % 3 == 0, x).otherwise(F.concat(x, F.lit(".5")))
    legs = F.concat(
        F.lit('{"Geometry":{"LineString":[['), x, F.lit(",1],["), bend, F.lit(",1],["), x, F.lit(',2]]},"VehicleLegDetails":{"Summary":{"Overview":{"Distance":7,"Duration":8}}}},'),
        F.lit('{"Geometry":{"LineString":[['), x, F.lit(",2],["), x, F.lit(",3],[5]]}}"),
    )
    head = F.when(o % 2 == 0, F.concat(F.lit('"Summary":{"Distance":'), o.cast("string"), F.lit(',"Duration":5},'))).otherwise(F.lit(""))
    content = F.when(o % 10 == 0, F.lit('{"Routes":[]}')).otherwise(F.concat(F.lit('{"Routes":[{'), head, F.lit('"Legs":['), legs, F.lit("]}]}")))
    raw = Fixture(spark, d).table("orders").select(o.cast("string").alias("doc"), content.alias("content"))
    out = readings.route_points(raw)
    return out.select("doc", F.greatest(F.coalesce(F.size("points"), F.lit(0)), F.lit(0)).alias("points"), "distance_m", "ok")


@query("src_14_photo_facts", """
SELECT c_custkey, k NOT IN (0, 1, 4, 5) AS has_gps, CASE WHEN k IN (0, 2) THEN NULL ELSE '2026-10-08T09:42:11+05:30' END AS timestamp,
 CASE WHEN k NOT IN (0, 1, 4, 5) THEN round((c_custkey % 80) + 30 / 60.0::DOUBLE + 36 / 3600.0::DOUBLE, 7) END AS lat,
 CASE k WHEN 0 THEN 'no_exif' WHEN 1 THEN 'no_gps' WHEN 2 THEN 'no_timestamp' WHEN 4 THEN 'gps_out_of_range' WHEN 5 THEN 'gps_unparseable' ELSE '' END AS problems FROM (SELECT *, c_custkey % 7 AS k FROM customer)""")
def src_14(spark, d):
    c = F.col("c_custkey")
    k = c % 7
    three = F.array((c % 80).cast("double"), F.lit(30.0), F.lit(36.0))
    tags = Fixture(spark, d).table("customer").select(
        c.alias("s3_key"), (k != 0).alias("has_exif"), F.when(k == 3, F.lit("garbled")).when(k != 2, F.lit("2026:10:08 09:42:11")).alias("original"),
        F.when(k == 3, F.lit("2026/10/08 09:42:11")).alias("digitized"), F.lit(None).cast("string").alias("modified"), F.lit("+05:30").alias("offset"),
        (k != 1).alias("has_gps_tags"),
        F.when(k == 4, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))).when(k == 5, F.array(F.lit(1.0))).otherwise(three).alias("gps_lat"), F.lit("N").alias("gps_lat_ref"),
        F.when(k == 4, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))).otherwise(three).alias("gps_lon"), F.lit("E").alias("gps_lon_ref"),
    )
    out = readings.photo_facts(tags)
    return out.select(F.col("s3_key").alias("c_custkey"), "has_gps", "timestamp", "lat", F.array_join("problems", ",").alias("problems"))


# ------------------------------------------------------------------ ingest
@query("ing_01_new_objects", "SELECT doc_id AS key FROM documents WHERE NOT (doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 4 <> 0)")
def ing_01(spark, d):
    docs = Fixture(spark, d).table("documents")
    k = F.col("doc_id")
    etag = F.md5(F.col("text").cast("binary"))
    incoming = docs.select(k.alias("key"), etag.alias("etag"))
    state = docs.where(k % 3 != 0).select(
        k.alias("key"), F.when(k % 5 == 0, F.lit("old")).otherwise(etag).alias("etag"), F.when(k % 4 == 0, F.lit("ERROR")).otherwise(F.lit("OK")).alias("status")
    )
    return tables.new_objects(incoming, state).select("key")


@query("ing_02_upsert", """
SELECT c_custkey AS k, coalesce(m, -1) AS version, coalesce(o_orderpriority, c_mktsegment) AS value FROM customer LEFT JOIN (
  SELECT o_custkey, max(o_orderkey) AS m, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY ALL) ON o_custkey = c_custkey""")
def ing_02(spark, d):
    fx = Fixture(spark, d)
    target = fx.table("customer").select(F.col("c_custkey").alias("k"), F.lit(-1).cast("bigint").alias("version"), F.col("c_mktsegment").alias("value"))
    updates = fx.table("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("value"))
    return tables.upsert(target, updates, ["k"], "version")


@query("ing_03_split_failures", """
SELECT CASE WHEN length(text) > 5000 THEN 'failed' WHEN lang = 'de' THEN 'skipped' ELSE 'processed' END AS outcome, count(*) AS n,
 sum(CASE WHEN length(text) > 5000 THEN 900 ELSE 0 END)::BIGINT AS kept_chars FROM documents GROUP BY ALL""")
def ing_03(spark, d):
    docs = Fixture(spark, d).table("documents").select(
        "doc_id", F.when(F.length("text") > 5000, F.col("text")).alias("error"), F.when(F.col("lang") == "de", F.lit("skipped")).alias("outcome")
    )
    _, errors, counts = tables.split_failures(docs)
    kept = errors.select(F.lit("failed").alias("outcome"), F.length("error").alias("c")).groupBy("outcome").agg(F.sum("c").alias("kept_chars"))
    return counts.join(kept, "outcome", "left").na.fill(0, ["kept_chars"])


@query("ing_04_digest", "SELECT doc_id, sha256(text) AS sha256, strlen(text) AS size FROM documents")
def ing_04(spark, d):
    docs = Fixture(spark, d).table("documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return files.content_digest(docs).select("doc_id", "sha256", "size")


@query("ing_04_changed_objects", "SELECT page_id AS key FROM pages WHERE page_id % 4 = 0 OR page_id % 3 = 1")
def ing_04_changed(spark, d):
    k = F.col("page_id")
    pages = Fixture(spark, d).table("pages")
    body = F.concat(F.when(k % 3 == 1, F.lit("")).otherwise(F.lit("%PDF-1.7 ")), F.col("html")).cast("binary")
    now = pages.select(k.alias("key"), body.alias("content"))
    registry = now.select("key", (F.length("content") + F.when(F.col("key") % 4 == 0, 1).otherwise(0)).alias("declared_size"), F.lit("application/pdf").alias("content_type"))
    return files.changed_objects(now, registry)


@query("ing_05_signature", """
SELECT page_id, page_id % 6 IN (0, 1, 2, 3) AS signature_ok FROM pages""")
def ing_05(spark, d):
    k = F.col("page_id") % 6
    html = F.col("html").cast("binary")
    lead = (
        F.when(k == 0, F.unhex(F.lit("FFD8FFE1"))).when(k == 1, F.unhex(F.lit("89504E470D0A1A0A"))).when(k == 2, F.lit("%PDF-1.7").cast("binary"))
        .when(k == 3, F.unhex(F.lit("EFBBBF20200A7B"))).when(k == 4, F.lit("lat,lon").cast("binary")).otherwise(F.lit("GIF89a").cast("binary"))
    )
    declared = F.when(k == 0, F.lit("image/jpeg")).when(k == 1, F.lit("image/png")).when(k == 2, F.lit("application/pdf")).when(k == 5, F.lit("image/gif")).otherwise(F.lit("application/json"))
    rows = Fixture(spark, d).table("pages").select("page_id", declared.alias("content_type"), F.concat(lead, html).alias("content"))
    return files.signature_audit(rows).select("page_id", "signature_ok")


@query("ing_06_pdf_pages", "SELECT page_id, (page_id % 5)::INT AS pages FROM pages")
def ing_06(spark, d):
    k = (F.col("page_id") % 5).cast("int")
    body = F.concat(F.lit("/Type /Pages "), F.col("html"), F.repeat(F.lit("<< /Type\n /Page >> "), k))
    rows = Fixture(spark, d).table("pages").select("page_id", body.cast("binary").alias("content"))
    return files.pdf_pages(rows).select("page_id", "pages")


@query("ing_08_canonical_keys", """
SELECT trip_id, l_linenumber % 5 = CASE WHEN l_partkey % 2 = 0 THEN 0 ELSE 1 END AND l_partkey % 7 <> 0 AS ok FROM v_load""")
def ing_08(spark, d):
    other = F.when(F.col("l_partkey") % 7 == 0, F.lit("elsewhere")).when(F.col("l_partkey") % 7 == 1, F.lit(None).cast("string")).otherwise(F.col("owner"))
    items = keys(Fixture(spark, d)).select(
        "trip_id", "key", F.when(F.col("l_partkey") % 2 == 0, F.lit("photo")).otherwise(F.lit("slip")).alias("kind"), F.col("owner").alias("bill_id"),
        F.col("l_suppkey").cast("string").alias("drain_id"), other.alias("owner_bill"), F.col("l_suppkey").cast("string").alias("owner_drain"),
    )
    return files.canonical_keys(items).select("trip_id", "ok")


# ------------------------------------------------------------------- sinks
@query("snk_01_write_verdicts", """
SELECT bill_id, drain_id, trip_count, verdict, failed_rules, c::DOUBLE AS claimed_tonnes FROM v_all_drain""")
def snk_01(spark, d):
    """Written for all bills, then again for some; the second run leaves the others."""
    case = Fixture(spark, d).case
    path = _fresh(spark, "verdicts")
    tables.write_verdicts(bill.evaluate(case, FIXTURE_LIMITS), path)
    tables.write_verdicts(bill.evaluate(case.only("3"), FIXTURE_LIMITS), path)
    out = tables.read_verdicts(spark, path, "drains")
    return out.select("bill_id", "drain_id", "trip_count", "verdict", F.array_join("failed_rules", ",").alias("failed_rules"), F.col("claimed_tonnes").cast("double").alias("claimed_tonnes"))


@query("snk_02_export_cases", f"""
SELECT w.bill_id, w.drain_id, coalesce(t.n, 0) AS trips, coalesce(p.n, 0) AS photos, w.bill_id <> '24' AS has_route, g.trips_without_slip, g.trips_without_trace, g.evidence_errors, g.drains_without_photos
FROM v_wdrain w
LEFT JOIN (SELECT bill_id, drain_id, count(*) AS n FROM v_ttrip GROUP BY ALL) t USING (bill_id, drain_id)
LEFT JOIN (SELECT bill_id, drain_id, count(*) AS n FROM v_photo GROUP BY ALL) p USING (bill_id, drain_id) JOIN ({GAPS_SQL}) g ON g.bill_id = w.bill_id""")
def snk_02(spark, d):
    """Exported for all bills, then again for one; read back from the JSON documents."""
    case = patchy_case(Fixture(spark, d))
    path = _fresh(spark, "documents")
    tables.export_cases(bill.evaluate(case, FIXTURE_LIMITS), path)
    tables.export_cases(bill.evaluate(case.only("3"), FIXTURE_LIMITS), path)

    def documents(name):
        return runs.read(spark, path, name)

    def counted(name):
        return documents(name).groupBy("bill_id", "drain_id").agg(F.count(F.lit(1)).alias(name))

    gaps = documents("bills").select("bill_id", "missing_evidence.*").drop("unreadable_traces")
    heads = documents("drains").select("bill_id", "drain_id", F.coalesce(F.size("claimed_route") == 2, F.lit(False)).alias("has_route"))
    return heads.join(counted("trips"), ["bill_id", "drain_id"], "left").join(counted("photos"), ["bill_id", "drain_id"], "left").na.fill(0).join(gaps, "bill_id")


@query("agg_09_claimed_route", """
SELECT bill_id, drain_id, round(clon, 4) AS from_lon, round(clat, 4) AS from_lat, 72.85::DOUBLE AS to_lon, 19.005::DOUBLE AS to_lat FROM v_wdrain WHERE bill_id <> '24'""")
def agg_09(spark, d):
    out = tables.claimed_route(Fixture(spark, d).case)
    a, b = F.get("claimed_route", F.lit(0)), F.get("claimed_route", F.lit(1))
    return out.select("bill_id", "drain_id", F.round(a["lon"], 4).alias("from_lon"), F.round(a["lat"], 4).alias("from_lat"), b["lon"].alias("to_lon"), b["lat"].alias("to_lat"))
