"""Column functions over whole tables."""

from pyspark.sql import functions as F

from loadaudit.functions import clock, coerce, geo, hashing, money, text
from loadaudit.plans.fixturemap import Fixture

from . import sqlviews
from .registry import query

D = "::DOUBLE"


def here():
    return geo.pt(F.col("lon"), F.col("lat"))


LINE = [(72.80, 19.00), (72.85, 19.02), (72.90, 19.01)]
RING = [(72.81, 19.0), (72.88, 19.0), (72.86, 19.03), (72.83, 19.015)]
HOLE = [(72.84, 19.003), (72.85, 19.003), (72.85, 19.009), (72.84, 19.009)]
VALUES = lambda pts: ", ".join(f"({i}, {x}{D}, {y}{D})" for i, (x, y) in enumerate(pts))


def events(spark, d):
    return Fixture(spark, d).points


def in_ring_sql(points, name):
    """One row per point: does it lie inside the ring (even-odd rule)?"""
    return f"""(SELECT seq, sum(CASE WHEN (y1 > lat) <> (y2 > lat) THEN (lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1))::INT ELSE 0 END) % 2 = 1 AS {name}
  FROM v_point, (SELECT a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM (VALUES {VALUES(points)}) a(i, x, y) JOIN (VALUES {VALUES(points)}) b(i, x, y)
    ON b.i = (a.i + 1) % {len(points)}) e GROUP BY seq)"""


@query("fn_01_haversine", f"SELECT seq, round({sqlviews.haversine('lon', 'lat', '72.85' + D, '19.005' + D)}, 3) AS metres FROM v_point")
def fn_01(spark, d):
    m = geo.haversine_m(F.col("lon"), F.col("lat"), F.lit(72.85), F.lit(19.005))
    return events(spark, d).select("seq", F.round(m, 3).alias("metres"))


@query("fn_02_local_projection", """
SELECT seq, round((lon - 72.8::DOUBLE) * 111320.0::DOUBLE * cos(radians(19.0::DOUBLE)), 3) AS x, round((lat - 19.0::DOUBLE) * 111320.0::DOUBLE, 3) AS y,
  round(lon, 7) AS back_lon, round(lon + 50 / (111320.0::DOUBLE * cos(radians(lat))), 7) AS east_lon, round(lon + (72.8::DOUBLE - lon) * 0.25::DOUBLE, 7) AS mid_lon FROM v_point""")
def fn_02(spark, d):
    origin = geo.pt(72.8, 19.0)
    local = geo.to_local_m(here(), origin)
    return events(spark, d).select(
        "seq", F.round(local["x"], 3).alias("x"), F.round(local["y"], 3).alias("y"),
        F.round(geo.from_local_m(local, origin)["lon"], 7).alias("back_lon"),
        F.round(geo.offset_m(here(), 50.0, 0.0)["lon"], 7).alias("east_lon"),
        F.round(geo.lerp(here(), origin, 0.25)["lon"], 7).alias("mid_lon"),
    )


@query("fn_03_in_ring", f"SELECT seq, inside FROM {in_ring_sql(RING, 'inside')}")
def fn_03(spark, d):
    return events(spark, d).select("seq", geo.in_ring(F.col("lon"), F.col("lat"), geo.line_literal(RING)).alias("inside"))


@query("fn_04_in_geometry", f"SELECT seq, o.inside AND NOT h.hole AS inside FROM {in_ring_sql(RING, 'inside')} o JOIN {in_ring_sql(HOLE, 'hole')} h USING (seq)")
def fn_04(spark, d):
    shape = F.array(F.array(geo.line_literal(RING), geo.line_literal(HOLE)))
    return events(spark, d).select("seq", geo.in_geometry(F.col("lon"), F.col("lat"), shape).alias("inside"))


@query("fn_05_dist_to_line", f"""
SELECT seq, round(min(sqrt(power(px - t * vx, 2) + power(py - t * vy, 2))), 3) AS metres FROM (
 SELECT *, greatest(0, least(1, (px * vx + py * vy) / (vx * vx + vy * vy))) AS t FROM (
  SELECT seq, (lon - a.x) * 111320.0{D} * cos(radians(a.y)) AS px, (lat - a.y) * 111320.0{D} AS py,
    (b.x - a.x) * 111320.0{D} * cos(radians(a.y)) AS vx, (b.y - a.y) * 111320.0{D} AS vy
  FROM v_point, (VALUES {VALUES(LINE)}) a(i, x, y) JOIN (VALUES {VALUES(LINE)}) b(i, x, y) ON b.i = a.i + 1)) GROUP BY seq""")
def fn_05(spark, d):
    return events(spark, d).select("seq", F.round(geo.dist_to_line_m(here(), geo.line_literal(LINE)), 3).alias("metres"))


def quad(lon, lat, dx=0.01, dy=0.006):
    """Four corners whose shape varies with the point."""
    return F.array(geo.pt(lon, lat), geo.pt(lon + dx, lat), geo.pt(lon + dx, lat + dy), geo.pt(lon, lat + dy / 2))


QUAD_SQL = "(SELECT seq, lon AS x1, lat AS y1, lon + 0.01::DOUBLE AS x2, lat AS y2, lon + 0.01::DOUBLE AS x3, lat + 0.006::DOUBLE AS y3, lon AS x4, lat + 0.006::DOUBLE / 2 AS y4 FROM v_point)"


@query("fn_06_ring_centroid", f"""
SELECT seq, round(round(((x1 + x2) * a + (x2 + x3) * b + (x3 + x4) * c + (x4 + x1) * d) / ((a + b + c + d) * 3), 7), 4) AS lon,
  round(round(((y1 + y2) * a + (y2 + y3) * b + (y3 + y4) * c + (y4 + y1) * d) / ((a + b + c + d) * 3), 7), 4) AS lat
FROM (SELECT *, x1 * y2 - x2 * y1 AS a, x2 * y3 - x3 * y2 AS b, x3 * y4 - x4 * y3 AS c, x4 * y1 - x1 * y4 AS d FROM {QUAD_SQL})""")
def fn_06(spark, d):
    """Compared to four decimals: the shoelace sum cancels most of a double's digits."""
    centre = geo.ring_centroid(quad(F.col("lon"), F.col("lat")))
    return events(spark, d).select("seq", centre.alias("c")).select("seq", F.round("c.lon", 4).alias("lon"), F.round("c.lat", 4).alias("lat"))


@query("fn_07_line_length", f"""
SELECT seq, round({sqlviews.haversine('x1', 'y1', 'x2', 'y2')} + {sqlviews.haversine('x2', 'y2', 'x3', 'y3')} + {sqlviews.haversine('x3', 'y3', 'x4', 'y4')}, 1) AS metres FROM {QUAD_SQL}""")
def fn_07(spark, d):
    return events(spark, d).select("seq", F.round(geo.line_length_m(quad(F.col("lon"), F.col("lat"))), 1).alias("metres"))


@query("fn_08_downsample", """
SELECT label, vec_id, list_sum(list_transform(range(0, 10), lambda i: embedding[(i * (64 / 10.0::DOUBLE))::DOUBLE::INT + 1 - CASE WHEN (i * 6.4::DOUBLE)::INT > i * 6.4::DOUBLE THEN 1 ELSE 0 END]::DOUBLE))
  + embedding[64]::DOUBLE AS kept FROM embeddings""")
def fn_08(spark, d):
    """Eleven of 64 dimensions, the last always kept."""
    kept = geo.downsample(F.col("embedding"), 11)
    total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return Fixture(spark, d).table("embeddings").select("label", "vec_id", total.alias("kept"))


@query("fn_08_thin_route", """
SELECT user_id::VARCHAR AS trace_key, count(*) AS kept, sum(i)::BIGINT AS places FROM (
  SELECT user_id, i, n FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
  WHERE n <= 20 OR i = n - 1 OR i IN (SELECT floor(k * (n / 19.0::DOUBLE))::BIGINT FROM range(0, 19) r(k))) GROUP BY ALL""")
def fn_08_rows(spark, d):
    """The row form: each user's events thinned to twenty without gathering them first."""
    from loadaudit.operators.ordered import numbered

    placed = numbered(Fixture(spark, d).table("events"), ["user_id"], ["event_id"], F.floor(F.col("event_id") / 1000), "place")
    rows = placed.select(F.col("user_id").cast("string").alias("trace_key"), (F.col("place") - 1).alias("seq"))
    sizes = rows.groupBy("trace_key").agg((F.max("seq") + 1).alias("n"))
    kept = rows.join(sizes, "trace_key").where(geo.keeps_index(F.col("seq"), F.col("n"), 20))
    return kept.groupBy("trace_key").agg(F.count(F.lit(1)).alias("kept"), F.sum("seq").alias("places"))


@query("fn_09_hamming", """
SELECT vec_id, 64 - list_sum(list_transform(list_zip(list_transform(embedding, lambda x: x > 0), list_transform(range(0, 64), lambda i: (i // 4) % 2 = 0)), lambda z: (z[1] = z[2])::INT))::INT AS bits,
  NULL::INT AS uneven FROM embeddings""")
def fn_09(spark, d):
    other = F.lit("f0f0f0f0f0f0f0f0")
    return Fixture(spark, d).photos.select(
        "vec_id", hashing.hamming_hex(F.col("p_hash"), other).alias("bits"), hashing.hamming_hex(F.col("p_hash"), F.lit("ff")).alias("uneven")
    )


@query("fn_10_weight", "SELECT trip_id, CASE WHEN l_tax <> 0 THEN l_quantity END AS tonnes FROM v_load")
def fn_10(spark, d):
    return Fixture(spark, d).weight_texts.select("trip_id", text.parse_weight_t(F.col("raw_net")).alias("tonnes"))


@query("fn_11_hhmm", """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE printf('%02d:%02d', o_orderkey % 24, o_custkey % 60) END AS clock FROM orders""")
def fn_11(spark, d):
    h, m = (F.col("o_orderkey") % 24).cast("int"), (F.col("o_custkey") % 60).cast("int")
    h12 = F.when(h % 12 == 0, 12).otherwise(h % 12)
    half = F.when(h < 12, F.lit(" AM")).otherwise(F.lit(" PM"))
    k = F.col("o_orderkey") % 6
    raw = (
        F.when(k == 0, F.format_string("%d:%02d", h, m))
        .when(k == 1, F.concat(F.format_string("%d.%02d", h12, m), half))
        .when(k == 2, F.format_string("%02d%02d", h, m))
        .when(k == 3, F.translate(F.format_string(" %02d-%02d", h, m), "0", "O"))
        .when(k == 4, F.lit("n/a"))
        .otherwise(F.concat(F.lit("25:"), F.format_string("%02d", m)))
    )
    # 'OO-OO' has no digit at all and is unreadable by design; give it one.
    raw = F.when(raw.rlike("[0-9]"), raw).otherwise(F.when(k == 3, F.format_string("%02d-%02d", h, m)).otherwise(raw))
    return Fixture(spark, d).table("orders").select("o_orderkey", text.parse_hhmm(raw).alias("clock"))


@query("fn_12_plate", """
SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 'MH ' || printf('%02d', p_size) || ' GO ' || printf('%04d', p_partkey % 10000) END AS plate FROM part""")
def fn_12(spark, d):
    raw = F.format_string("mh-%02d go.%04d", F.col("p_size"), (F.col("p_partkey") % 10000).cast("int"))
    misread = F.concat(F.substring(raw, 1, 3), F.translate(F.substring(raw, 4, 2), "01", "OI"), F.substring(raw, 6, 4),
                       F.translate(F.substring(raw, 10, 4), "5", "S"))
    # Keep one true digit, so the text is not taken for prose.
    shown = F.when(misread.rlike("[0-9]"), misread).otherwise(raw)
    shown = F.when(F.col("p_partkey") % 9 == 0, F.lit("--")).otherwise(shown)
    return Fixture(spark, d).table("part").select("p_partkey", text.parse_plate(shown).alias("plate"))


@query("fn_13_clean_text", """
SELECT doc_id, md5(t) AS digest, CASE WHEN length(t) > 2000 THEN 'must be 2000 characters or fewer' END AS error, CASE WHEN length(t) <= 2000 THEN length(t) END AS kept FROM (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[\\x00-\\x1f\\x7f]', ' ', 'g'), '^[ \\t\\n\\x0b\\f\\r]+|[ \\t\\n\\x0b\\f\\r]+$', '', 'g'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g') AS t FROM documents)""")
def fn_13(spark, d):
    checked = text.clean_text_max(F.col("text"), 2000)
    return Fixture(spark, d).table("documents").select("doc_id", text.clean_text(F.col("text")).alias("t"), checked.alias("c")).select(
        "doc_id", F.md5(F.regexp_replace(F.regexp_replace("t", r"[\x00-\x1f\x7f]+", " "), " +", " ").cast("binary")).alias("digest"),
        F.col("c.error").alias("error"), F.length("c.value").alias("kept"),
    )


@query("fn_14_norm_vehicle", "SELECT p_partkey, trim(regexp_replace(upper(p_name || '--' || p_brand), '[^A-Z0-9]+', ' ', 'g')) AS vehicle FROM part")
def fn_14(spark, d):
    return Fixture(spark, d).table("part").select("p_partkey", text.norm_vehicle(F.concat("p_name", F.lit("--"), "p_brand")).alias("vehicle"))


@query("fn_15_exif", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%dT') || printf('%02d:%02d:', o_orderkey % 24, o_custkey % 60)
  || CASE WHEN o_orderkey % 4 = 1 THEN '00' ELSE '07' END || CASE WHEN o_orderkey % 3 = 0 THEN '+05:30' ELSE '' END END AS taken,
 round(CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * ((o_orderkey % 90)::DOUBLE + (o_custkey % 60) / 60.0::DOUBLE + (o_orderkey % 60) / 3600.0::DOUBLE), 6) + 0.0::DOUBLE AS degrees FROM orders""")
def fn_15(spark, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    h, m = (o % 24).cast("int"), (c % 60).cast("int")
    raw = (
        F.when(o % 4 == 0, F.concat(F.date_format("o_orderdate", "yyyy:MM:dd"), F.format_string(" %02d:%02d:07", h, m)))
        .when(o % 4 == 1, F.concat(F.date_format("o_orderdate", "yyyy/MM/dd"), F.format_string(" %02d:%02d", h, m)))
        .when(o % 4 == 2, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.format_string(" %02d:%02d:07", h, m)))
        .otherwise(F.lit("yesterday"))
    )
    offset = F.when(o % 3 == 0, F.lit("+05:30"))
    ref = F.when(o % 2 == 0, F.lit("S")).otherwise(F.lit("N"))
    deg = clock.dms_deg((o % 90).cast("double"), (c % 60).cast("double"), (o % 60).cast("double"), ref)
    return Fixture(spark, d).table("orders").select("o_orderkey", clock.exif_time(raw, offset).alias("taken"), (F.round(deg, 6) + 0.0).alias("degrees"))


@query("fn_16_iso", """
SELECT event_id, epoch_us(ts) // 1000000 * 1000000 - CASE WHEN event_id % 3 = 0 THEN 19800000000 WHEN event_id % 3 = 1 THEN -16200000000 ELSE 0 END AS epoch_us,
  CASE event_id % 3 WHEN 0 THEN 330 WHEN 1 THEN -270 END AS offset_min, strftime(ts, '%H:%M') AS wall FROM events""")
def fn_16(spark, d):
    e = F.col("event_id")
    zone = F.when(e % 3 == 0, F.lit("+05:30")).when(e % 3 == 1, F.lit("-0430")).otherwise(F.lit(""))
    parts = clock.iso_parts(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone))
    return Fixture(spark, d).table("events").select("event_id", parts.alias("p")).select(
        "event_id", F.col("p.epoch_us").alias("epoch_us"), F.col("p.offset_min").alias("offset_min"), clock.hhmm_text(F.col("p.wall_us")).alias("wall")
    )


@query("fn_17_minutes_apart", """
SELECT event_id, round(arg_min(x, {'a': abs(x), 'k': k}), 4) AS minutes FROM (SELECT event_id, k, ((epoch_us(ts) // 86400000000 + k) * 86400000000
   + (user_id % 24 * 60 + event_id % 60) * 60000000 - epoch_us(ts)) / 60e6 AS x FROM events, (VALUES (-1), (0), (1)) v(k)) GROUP BY ALL""")
def fn_17(spark, d):
    printed = F.format_string("%02d:%02d", (F.col("user_id") % 24).cast("int"), (F.col("event_id") % 60).cast("int"))
    return Fixture(spark, d).table("events").select(
        "event_id", F.round(clock.minutes_apart(printed, F.unix_micros(F.col("ts").cast("timestamp"))), 4).alias("minutes")
    )


@query("fn_18_fences", f"""
SELECT seq, 49 AS vertices, round(lon + 100 / (111320.0{D} * cos(radians(lat))), 7) AS east, round(lat + 200 / 111320.0{D}, 7) AS north,
  true AS centre_inside FROM v_point""")
def fn_18(spark, d):
    ring = geo.circle(here(), F.lit(100.0))
    inside = geo.in_ring(F.col("lon"), F.col("lat"), F.col("ring"))
    return events(spark, d).withColumn("ring", ring).select(
        "seq", F.size("ring").alias("vertices"), F.round(F.get("ring", F.lit(0))["lon"], 7).alias("east"),
        F.round(F.get(geo.square(here(), 200.0), F.lit(2))["lat"], 7).alias("north"), inside.alias("centre_inside"),
    )


@query("fn_19_slice_line", f"""
SELECT seq, CASE WHEN (a + b + c) * 0.5{D} <= a THEN 2 WHEN (a + b + c) * 0.5{D} <= a + b THEN 3 ELSE 4 END AS vertices, round(bear, 4) AS bearing FROM (
 SELECT seq, {sqlviews.haversine('x1', 'y1', 'x2', 'y2')} AS a, {sqlviews.haversine('x2', 'y2', 'x3', 'y3')} AS b, {sqlviews.haversine('x3', 'y3', 'x4', 'y4')} AS c,
  degrees(atan2((x3 - x1) * cos(radians(y1)), y3 - y1)) AS bear FROM {QUAD_SQL})""")
def fn_19(spark, d):
    line = quad(F.col("lon"), F.col("lat"))
    return events(spark, d).withColumn("line", line).select(
        "seq", F.size(geo.slice_line(F.col("line"), 0.5)).alias("vertices"),
        F.round(geo.bearing(F.get("line", F.lit(0)), F.get("line", F.lit(2))), 4).alias("bearing"),
    )


@query("fn_20_wall_clock", "SELECT event_id, strftime(ts, '%H:%M') AS clock, (hour(ts) * 60 + minute(ts))::INT AS minute FROM events")
def fn_20(spark, d):
    shown = clock.hhmm(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return Fixture(spark, d).table("events").select("event_id", shown.alias("clock"), clock.minute_of_day(shown).alias("minute"))


@query("fn_21_coerce", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN printf('%.3f', CASE WHEN value > 100 THEN 1.0::DOUBLE WHEN value > 1 THEN value / 100 ELSE value END)::DOUBLE WHEN 1 THEN 0.85 WHEN 2 THEN 0 WHEN 3 THEN 0 ELSE 0.3 END::DOUBLE AS confidence,
 event_id % 5 = 0 AS confident, CASE event_id % 5 WHEN 0 THEN value <> 0 WHEN 2 THEN true WHEN 3 THEN false ELSE false END AS truth, event_id % 5 IN (0, 2) AS truth_ok FROM events""")
def fn_21(spark, d):
    k = F.col("event_id") % 5
    raw = (
        F.when(k == 0, F.col("value").cast("decimal(10,2)").cast("string")).when(k == 1, F.lit('" High "')).when(k == 2, F.lit("true"))
        .when(k == 3, F.lit('"perhaps"')).otherwise(F.lit('"low"'))
    )
    v = F.parse_json(raw)
    read = Fixture(spark, d).table("events").withColumn("v", v).select(
        "event_id", coerce.coerce_confidence(F.col("v")).alias("c"), coerce.coerce_bool(F.col("v")).alias("b")
    )
    return read.select(
        "event_id", F.col("c.value").alias("confidence"), F.col("c.ok").alias("confident"), F.col("b.value").alias("truth"), F.col("b.ok").alias("truth_ok")
    )


@query("fn_22_checks", """
SELECT event_id, CASE WHEN value < 1 THEN 'must be at least 1' WHEN value > 100 THEN 'must be at most 100' END AS number_error,
 CASE WHEN value > 180 THEN 'must be at most 180' WHEN event_id % 10 = 0 THEN '[0, 0] is not a real location' END AS point_error,
 CASE WHEN value > 180 THEN 'point 2 must be at most 180' END AS line_error FROM events""")
def fn_22(spark, d):
    lon = F.when(F.col("value") > 180, F.col("value")).otherwise(F.when(F.col("event_id") % 10 == 0, 0.0).otherwise(F.col("value")))
    p = geo.pt(lon, F.when(F.col("event_id") % 10 == 0, 0.0).otherwise(19.0))
    second = geo.pt(F.col("value"), F.lit(19.0))
    return Fixture(spark, d).table("events").select(
        "event_id", coerce.check_number(F.col("value"), 1, 100).alias("number_error"), coerce.check_lonlat(p).alias("point_error"),
        coerce.check_line(F.array(geo.pt(1.0, 2.0), second), 2, 5).alias("line_error"),
    )


@query("fn_23_swapped_hint", f"""
SELECT seq, CASE WHEN seq % 2 = 0 THEN false ELSE {sqlviews.haversine('lat', 'lon', '72.85' + D, '19.005' + D)} > 500000
  AND {sqlviews.haversine('lon', 'lat', '72.85' + D, '19.005' + D)} < 50000 END AS swapped FROM v_point""")
def fn_23(spark, d):
    flipped = F.when(F.col("seq") % 2 == 0, here()).otherwise(geo.pt(F.col("lat"), F.col("lon")))
    return events(spark, d).select("seq", geo.swapped_hint(flipped, geo.pt(72.85, 19.005)).alias("swapped"))


@query("fn_24_money", """
SELECT o_orderkey, round_even(o_totalprice::DECIMAL(18,2) * 1.5, 0)::BIGINT AS rupees, printf('%.2f', (o_orderkey * 977) / 100000.0::DOUBLE) AS lakh,
 CASE WHEN length(n) <= 3 THEN n WHEN length(n) <= 5 THEN n[:-4] || ',' || n[-3:] WHEN length(n) <= 7 THEN n[:-6] || ',' || n[-5:-4] || ',' || n[-3:]
  ELSE n[:-8] || ',' || n[-7:-6] || ',' || n[-5:-4] || ',' || n[-3:] END AS grouped FROM (SELECT *, (o_orderkey * 977)::VARCHAR AS n FROM orders)""")
def fn_24(spark, d):
    amount = F.col("o_orderkey") * 977
    return Fixture(spark, d).table("orders").select(
        "o_orderkey", money.rupees(F.col("o_totalprice").cast("decimal(18,2)"), F.lit("1.5").cast("decimal(3,1)")).alias("rupees"),
        money.lakh(amount).alias("lakh"), money.indian_group(amount).alias("grouped"),
    )
