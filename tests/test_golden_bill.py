"""A bill with every planted case, built by hand: the headline split must hold."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from loadaudit import schemas
from loadaudit.functions import geo
from loadaudit.plans.bill import BillCase, evaluate, missing_evidence

CLAIMED = {
    "1": 48, "2": 56, "3": 126, "4": 60, "5": 44, "6": 70, "7": 52, "8": 55, "9": 58, "10": 46,
    "11": 85, "12": 62, "13": 50, "14": 192, "15": 54, "16": 75, "17": 42, "18": 65,
}
SITE = (73.02, 19.1)


def fence(lon, lat, half=0.00027):
    ring = [(lon - half, lat - half), (lon + half, lat - half), (lon + half, lat + half), (lon - half, lat + half)]
    return [[[{"lon": x, "lat": y} for x, y in ring]]]


def clock(minute, day=25):
    return f"2026-09-{day:02d}T{8 + minute // 60:02d}:{minute % 60:02d}:00+05:30"


def build(spark):
    frame = spark.createDataFrame
    drains, trips, photos, slips, items, points = [], [], [], [], [], []
    vehicles = {}
    for number, (drain, tonnes) in enumerate(CLAIMED.items()):
        lon, lat = 72.80 + number * 0.01, 19.0
        drains.append(("B1", drain, f"Drain {drain}", 400.0, 2.0, 1.0, None, fence(lon, lat),
                       [{"lon": lon, "lat": lat}, {"lon": lon + 0.0001, "lat": lat}], None, None))
        for index, role in enumerate(("before", "after")):
            key = f"photos/B1/drain{drain}/{role}-1.jpg"
            # Unrelated hashes: every pair of these differs in well over 12 bits.
            p_hash = f"{(0x9E3779B97F4A7C15 * (2 * number + index + 1)) % 2**64:016x}"
            offset = 0.0
            stamp = f"2026-09-24T{8 + index:02d}:{number:02d}:00+05:30"
            vision = (True, role == "after", "silt", 0.9, None)
            if drain == "14" and role == "after":
                p_hash = [p for p in photos if p[2] == "photos/B1/drain9/after-1.jpg"][0][10]
                stamp = "2026-09-26T10:00:00+05:30"
            if drain == "8" and role == "after":
                offset = 45 / geo.M_PER_DEG_LAT
            photos.append(("B1", drain, key, role, "OK", None, True, lat + offset, lon, stamp, p_hash, [], vision))
        if drain == "3":
            photos.append(("B1", drain, "photos/B1/drain3/load-1.jpg", "load", "OK", None, True, lat, lon,
                           "2026-09-24T11:00:00+05:30", "00ff00ff00ff00ff", [], (True, False, "debris", 0.9, "bricks")))
        loads = {"11": [(14, "bad"), (14, "bad"), (57, "ok")], "16": [(12, "r6a"), (12, "r6b"), (51, "ok")],
                 "6": [(10, "gap"), (60, "ok")]}.get(drain, [(tonnes / 2, "ok"), (tonnes - tonnes / 2, "ok")])
        for index, (t, kind) in enumerate(loads):
            trip = f"{drain}#{index + 1:03d}"
            plate = f"MH 01 AB {number:02d}{index:02d}"
            if kind in ("r6a", "r6b"):
                plate = "MH 01 AB 9999"
            vehicles[plate] = 10.0 if kind == "bad" else 100.0
            slip_key, trace_key = f"slips/B1/{drain}-{index + 1:03d}.png", f"traces/B1/{drain}-{index + 1:03d}.json"
            trips.append(("B1", drain, f"{index + 1:03d}", trip, plate, Decimal(str(t)), slip_key, trace_key, None, None))
            begin = 37 + 30 if kind == "r6b" else 30
            stamps = [begin + i for i in range(31)]
            if kind == "gap":
                stamps = [s if s < begin + 15 else s + 4 for s in stamps]
            target = (lon + 0.1, lat + 0.05) if drain == "14" else SITE
            for i, minute in enumerate(stamps):
                f = i / 30
                start = (72.81, 19.02) if kind == "r6b" else (lon, lat)
                x, y = start[0] + (target[0] - start[0]) * f, start[1] + (target[1] - start[1]) * f
                points.append(("B1", trace_key, i, y, x, clock(minute)))
            arrival = stamps[-1] - (40 if drain == "14" else 0)
            slips.append((slip_key, "OK", None, "T1", plate, None, None, float(t), clock(arrival)[11:16], None, None, []))
            items.append((trace_key, "OK", None, 31))
    return BillCase(
        bills=frame([("B1", "C", "W", Decimal(1800), Decimal(1240), "2026-09-21T06:00:00+05:30",
                      "2026-10-04T19:00:00+05:30", "PENDING", "D1")], schemas.BILLS),
        drains=frame(drains, schemas.DRAINS),
        trips=frame(trips, schemas.TRIPS),
        photos=frame(photos, schemas.PHOTOS),
        slips=frame(slips, schemas.SLIPS),
        trace_items=frame(items, schemas.TRACE_ITEMS),
        points=frame(points, schemas.POINTS),
        vehicles=frame(sorted(vehicles.items()), schemas.VEHICLES),
        sites=frame([("D1", "Site", fence(*SITE), {"lon": SITE[0], "lat": SITE[1]})], schemas.SITES),
    )


@pytest.fixture(scope="module")
def case(spark):
    return build(spark)


@pytest.fixture(scope="module")
def audit(case):
    return evaluate(case)


def test_headline_split(audit):
    row = audit.summary.collect()[0]
    split = [float(row[c]) for c in ("claimed_tonnes", "verified_tonnes", "review_tonnes", "held_tonnes")]
    assert split == [1240, 805, 65, 370]
    assert (row.claimed_rupees, row.held_rupees) == (2232000, 666000)
    assert (row.drain_count, row.red, row.amber, row.green, row.decided) == (18, 4, 2, 12, 0)


def test_each_planted_drain(audit):
    rows = {r.drain_id: r for r in audit.drains.collect()}
    assert {d: r.verdict for d, r in rows.items() if r.verdict != "GREEN"} == {
        "3": "RED", "6": "AMBER", "8": "AMBER", "11": "RED", "14": "RED", "16": "RED",
    }
    assert rows["11"].failed_rules == []
    assert rows["14"].failed_rules == ["R3"]
    assert rows["3"].failed_rules == ["R4"]
    assert rows["8"].failed_rules == ["R1"]
    assert float(rows["14"].evidence_held) == 192
    assert float(rows["11"].evidence_held) == 28
    assert float(rows["6"].evidence_review) == 10
    assert float(rows["8"].evidence_review) == 55


def test_trip_rules(audit):
    trips = {r.trip_id: r for r in audit.trips.collect()}
    assert trips["14#001"].hard_fails == ["R3", "R5", "R8"]
    assert trips["11#001"].hard_fails == ["R7"]
    assert trips["16#001"].hard_fails == ["R6"] and trips["16#002"].hard_fails == ["R6"]
    assert trips["6#001"].soft_fails == ["GPS_GAP"] and trips["6#001"].hard_fails == []
    assert trips["1#001"].verdict == "VERIFIED"


def test_findings_carry_words_and_measurements(audit):
    found = {(r.drain_id, r.trip_id, r.rule): r for r in audit.findings.collect()}
    reuse = found[("14", None, "R3")]
    assert reuse.message == (
        "after-1.jpg is the same image as after-1.jpg, already submitted for drain 9."
    )
    assert reuse.evidence["hammingDistance"] == "0"
    late = found[("14", "14#001", "R8")]
    assert late.message == (
        "The slip records time-in at 08:20, 10 minutes before the truck left the drain at 08:30. "
        "The GPS trace never reaches the dump site; its last fix, at 09:00, is 40 minutes after the slip's time-in."
    )
    assert found[("6", "6#001", "GPS_GAP")].evidence["gapSeconds"] == "300"
    assert found[("8", None, "R1")].message.startswith("after-1.jpg was taken 45 m outside the geofence")


def test_nothing_missing(case):
    row = missing_evidence(case).collect()[0].asDict()
    row.pop("bill_id")
    assert set(row.values()) == {0}


def test_one_bill_is_a_filter(case):
    assert evaluate(case.only("none")).trips.count() == 0
