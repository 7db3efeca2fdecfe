"""Column functions on the literal vectors of the domain."""

import pytest
from pyspark.sql import functions as F

from loadaudit.functions import clock, coerce, geo, hashing, money, text
from loadaudit.functions.rounding import round_half_even


def apply(spark, fn, values, ddl="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}")
    return [r[0] for r in df.select(F.col("i"), fn(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


WEIGHTS = {
    "9.80 T": 9.8, "9.80T": 9.8, "  12.60 t ": 12.6, "22,400 kg": 22.4, "9800kg": 9.8, "9.8O T": 9.8, "l0.50 T": 10.5,
    "22400": 22.4, "14": 14.0, "--": None, "": None, "n/a": None, "not a weight": None,
}
CLOCKS = {
    "09:42": "09:42", "9:42": "09:42", "O9:42": "09:42", "9.42 AM": "09:42", "2:15 pm": "14:15", "12:30 AM": "00:30",
    "12:30 PM": "12:30", "0942": "09:42", "09-42": "09:42", "25:70": None, "--": None, "": None,
}
PLATES = {
    "MH 01 AB 1234": "MH 01 AB 1234", "mh 01 ab 1234": "MH 01 AB 1234", "MH O1 AB l234": "MH 01 AB 1234",
    "MH-01-AB-1234": "MH 01 AB 1234", "MH 02 GO 3456": "MH 02 GO 3456", "--": None,
}


@pytest.mark.parametrize("fn, vectors", [(text.parse_weight_t, WEIGHTS), (text.parse_hhmm, CLOCKS), (text.parse_plate, PLATES)])
def test_printed_texts(spark, fn, vectors):
    assert apply(spark, fn, [*vectors, None]) == [*vectors.values(), None]


def test_vehicle_and_text_cleaning(spark):
    assert apply(spark, text.norm_vehicle, ["wb-25 ab.1234", "", None]) == ["WB 25 AB 1234", None, None]
    assert apply(spark, text.clean_text, [" a \n b ", "N/A", None]) == ["a b", None, None]
    bounded = apply(spark, lambda c: text.clean_text_max(c, 3), ["abc", "abcd", " \x01 "])
    assert [(b.value, b.error) for b in bounded] == [("abc", None), (None, "must be 3 characters or fewer"), (None, None)]


def test_number_text(spark):
    assert apply(spark, text.general, [12.5, 1240.0, 1234567.0, 0.5, 100000.0], "double") == ["12.5", "1240", "1.23457e+06", "0.5", "100000"]
    assert apply(spark, text.fixed0, [0.5, 2.5, 3.5], "double") == ["0", "2", "4"]
    assert apply(spark, lambda c: text.fixed(c, 1), [0.25, 0.35], "double") == ["0.2", "0.3"]


def test_rounding_matches_python(spark):
    import random

    draw = random.Random(7)
    values = [draw.randrange(-10**7, 10**7) / 2000 for _ in range(3000)] + [1.115, 2.675, 0.125, 0.375, -0.125, 1.005]
    for digits in (1, 2, 3):
        assert apply(spark, lambda c: round_half_even(c, digits), values, "double") == [round(v, digits) for v in values]


def test_iso_times(spark):
    good = ["2026-09-25T10:00:00+05:30", "2026-09-25T10:00", "2026-09-25", "2026-09-25T10:00:00.5Z"]
    again = apply(spark, lambda c: clock.iso_text(clock.iso_parts(c)), good)
    assert again == ["2026-09-25T10:00:00+05:30", "2026-09-25T10:00:00", "2026-09-25T00:00:00", "2026-09-25T10:00:00.500000+00:00"]
    assert apply(spark, clock.iso_parts, ["2026-02-30T10:00:00", "yesterday", "", "2026-09-25T25:00:00", None]) == [None] * 5


def test_minutes_apart_crosses_midnight(spark):
    arrival = F.lit("2026-09-25T00:05:00+05:30")
    fn = lambda c: clock.minutes_apart(c, clock.iso_parts(arrival)["wall_us"])
    assert apply(spark, fn, ["23:55", "00:10", "12:05", "", None, "nonsense"]) == [-10.0, 5.0, -720.0, None, None, None]


def test_camera_times(spark):
    fn = lambda c: clock.exif_time(c, F.lit("+05:30"))
    assert apply(spark, fn, ["2026:10:08 09:42:11", "2026/10/08 09:42", "2026-10-08 09:42:11", "today"]) == [
        "2026-10-08T09:42:11+05:30", "2026-10-08T09:42:00+05:30", "2026-10-08T09:42:11+05:30", None
    ]


def test_windows_borrow_the_offset(spark):
    start, end = clock.iso_parts(F.lit("2026-09-21T06:00:00+05:30")), clock.iso_parts(F.lit("2026-10-04T19:00:00+05:30"))
    fn = lambda c: clock.in_window(clock.iso_parts(c), start, end)
    assert apply(spark, fn, ["2026-09-21T06:00:00", "2026-09-21T05:59:59", "2026-09-21T00:30:00Z", "2026-10-04T19:00:00+05:30"]) == [True, False, True, True]


def test_geometry(spark):
    square = geo.line_literal([(0, 0), (1, 0), (1, 1), (0, 1)])
    hole = geo.line_literal([(0.4, 0.4), (0.6, 0.4), (0.6, 0.6), (0.4, 0.6)])
    shape = F.array(F.array(square, hole))
    row = spark.range(1).select(
        geo.in_ring(F.lit(0.5), F.lit(0.5), square).alias("ring"),
        geo.in_geometry(F.lit(0.5), F.lit(0.5), shape).alias("hole"),
        geo.in_geometry(F.lit(0.2), F.lit(0.5), shape).alias("solid"),
        geo.in_geometry(F.lit(0.2), F.lit(0.5), F.lit(None).cast(geo.GEOMETRY_DDL)).alias("none"),
        geo.dist_to_line_m(geo.pt(0.5, 0.001), square).alias("near"),
        geo.dist_to_line_m(geo.pt(0.5, 0.001), F.array().cast(geo.LINE_DDL)).alias("nowhere"),
        geo.ring_centroid(square).alias("centre"),
        geo.haversine_m(F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("unknown"),
        geo.bearing(geo.pt(0, 0), geo.pt(1, 1)).alias("bearing"),
        geo.swapped_hint(geo.pt(22.5801, 88.4712), geo.pt(88.4712, 22.5801)).alias("swapped"),
        geo.swapped_hint(geo.pt(88.47, 22.58), geo.pt(88.4712, 22.5801)).alias("straight"),
    ).collect()[0]
    assert (row.ring, row.hole, row.solid, row.none) == (True, False, True, False)
    assert row.near == pytest.approx(111.32) and row.nowhere == float("inf")
    assert (row.centre.lon, row.centre.lat) == (0.5, 0.5)
    assert row.unknown is None and row.bearing == pytest.approx(45)
    assert (row.swapped, row.straight) == (True, False)


def test_hamming(spark):
    pairs = [("ffffffffffffffff", "0fffffffffffff0f"), ("ff", "f0"), ("ff", "fff"), ("", ""), ("zz", "ff"), ("f" * 32, "f" * 31 + "0")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [r.d for r in df.select("i", hashing.hamming_hex(F.col("a"), F.col("b")).alias("d")).orderBy("i").collect()]
    assert got == [8, 4, None, None, None, 4]


def test_coercions(spark):
    values = ["0.9", "1", "85", "150", "-2", '"0.4"', '"high"', "true", "null"]
    conf = apply(spark, lambda c: coerce.coerce_confidence(F.parse_json(c)), values)
    assert [(c.value, c.ok) for c in conf] == [
        (0.9, True), (1.0, True), (0.85, True), (1.0, True), (0.0, True), (0.4, True), (0.85, False), (0.0, False), (0.0, False)
    ]
    truth = apply(spark, lambda c: coerce.coerce_bool(F.parse_json(c)), ['"yes"', '"No"', "0", "true", "[]"])
    assert [(t.value, t.ok) for t in truth] == [(True, True), (False, True), (False, True), (True, True), (False, False)]


def test_money(spark):
    assert apply(spark, money.indian_group, [999, 1240, 345600, 12345678], "bigint") == ["999", "1,240", "3,45,600", "1,23,45,678"]
    assert apply(spark, lambda c: money.rupees(c, F.lit(1)), [2.5, 3.5], "double") == [2, 4]
    assert apply(spark, money.lakh, [666000], "bigint") == ["6.66"]


def test_wall_clock_ignores_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:00.25' AS t").select(clock.wall_us(F.col("t"))).collect()[0][0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == 1710037800250000


def test_clock_texts_with_seconds(spark):
    rows = spark.createDataFrame([("09:42",), ("09:42:10",), ("0942",), (None,)], "c string")
    at = clock.iso_parts(F.lit("2026-10-09T10:00:00+05:30"))["wall_us"]
    got = [(r.apart, r.minute) for r in rows.select(clock.minutes_apart(F.col("c"), at).alias("apart"), clock.minute_of_day(F.col("c")).alias("minute")).collect()]
    assert got == [(-18.0, 582), (None, 582), (None, None), (None, None)]


def test_compact_iso_texts_and_offsets(spark):
    import datetime as dt

    texts = [
        "20261009T070000Z", "2026-10-09T07", "20261009", "20261009T0700", "2026-10-09T070000+0530", "20261009T07:00:00.5-04:30", "2026-10-09T07Z", "2026-10-09 07:00:00+05",
        "2026-10-09T07:00:00+25:00", "2026-10-09T07:00:00+05:75", "2026-1-9", "20261309", "202610", "2026-10-09T7", "2026-10-09T07:00:00+23:59",
    ]
    got = {r.c: r.p for r in spark.createDataFrame([(t,) for t in texts], "c string").select("c", clock.iso_parts(F.col("c")).alias("p")).collect()}
    for t in texts:
        try:
            want = dt.datetime.fromisoformat(t)
        except ValueError:
            assert got[t] is None, t
            continue
        offset = want.utcoffset()
        assert got[t].offset_min == (None if offset is None else offset.total_seconds() // 60), t
        epoch = (want if want.tzinfo else want.replace(tzinfo=dt.timezone.utc)).timestamp()
        assert got[t].epoch_us == round(epoch * 1_000_000), t


def test_space_of_any_script_and_json_text(spark):
    import json

    row = spark.range(1).select(
        text.clean_text(F.lit("\u00a09.80\u2003 T\u3000")).alias("clean"), text.spaced_json(F.lit('{"a,b":["x:\\"y,",1],"é🙂":{}}')).alias("json")
    ).first()
    assert row.clean == "9.80 T" and row.json == json.dumps({"a,b": ['x:"y,', 1], "é🙂": {}})
