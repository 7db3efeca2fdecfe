"""Skew-proof operators against brute force on small, lopsided inputs."""

import random

from pyspark.sql import functions as F

from loadaudit.functions import geo
from loadaudit.operators import control, photos, quality, traces
from loadaudit.operators.ordered import neighbours, numbered, range_buckets
from loadaudit.sources import traces as trace_files


def lopsided(n=600, seed=3):
    """(key, order): a third of the rows on one key, one null key."""
    draw = random.Random(seed)
    return [("hot" if draw.random() < 0.34 else draw.choice(["a", "b", "c", None]), i * 7 % 1009) for i in range(n)]


def test_neighbours_equal_a_plain_scan(spark):
    rows = lopsided()
    df = spark.createDataFrame(rows, "k string, o int")
    got = {(r.k, r.o): (r.prev.o if r.prev else None, r.next.o if r.next else None) for r in neighbours(df, ["k"], ["o"], F.floor(F.col("o") / 50), ["o"]).collect()}
    for key in {k for k, _ in rows}:
        line = sorted(o for k, o in rows if k == key)
        for i, o in enumerate(line):
            assert got[(key, o)] == (line[i - 1] if i else None, line[i + 1] if i + 1 < len(line) else None)


def test_numbers_equal_a_plain_scan(spark):
    rows = lopsided(seed=5)
    df = spark.createDataFrame(rows, "k string, o int")
    got = {(r.k, r.o): r.n for r in numbered(df, ["k"], ["o"], F.floor(F.col("o") / 64)).collect()}
    for key in {k for k, _ in rows}:
        for i, o in enumerate(sorted(o for k, o in rows if k == key)):
            assert got[(key, o)] == i + 1


def hashes(seed=11):
    """Clusters of edited copies, a big group of equal hashes, unrelated ones."""
    draw = random.Random(seed)
    out = []
    for cluster in range(12):
        base = draw.getrandbits(64)
        for _ in range(6):
            edited = base
            for bit in draw.sample(range(64), draw.randrange(0, 16)):
                edited ^= 1 << bit
            out.append(edited)
    out += [draw.getrandbits(64) for _ in range(40)] + [out[0]] * 50
    return out


def test_first_original_equals_all_pairs(spark):
    draw = random.Random(2)
    rows = [
        (draw.choice(["B1", "B2"]), f"k{i:03d}", draw.choice([None, f"2026-09-{draw.randrange(1, 29):02d}T10:00:00"]), f"{h:016x}", str(i % 5))
        for i, h in enumerate(hashes())
    ]
    df = spark.createDataFrame(rows, "bill_id string, s3_key string, timestamp string, p_hash string, drain_id string")
    want = {}
    for bill in ("B1", "B2"):
        line = sorted((r for r in rows if r[0] == bill), key=lambda r: (r[2] or "", r[1]))
        for i, row in enumerate(line):
            for earlier in line[:i]:
                distance = bin(int(row[3], 16) ^ int(earlier[3], 16)).count("1")
                if distance <= 12:
                    want[row[1]] = (earlier[1], earlier[4], distance)
                    break
    for bands in (2, 3, 4, 5):
        got = photos.first_originals(df, bands=bands).collect()
        assert {r.s3_key: (r.original, r.original_owner, r.distance) for r in got} == want


def test_near_hash_pairs_are_complete(spark):
    values = sorted({f"{h:016x}" for h in hashes(4)})
    df = spark.createDataFrame([("x", v) for v in values], "g string, hash string")
    got = {(r.hash, r.other) for r in photos.near_hashes(df, ["g"], 16, hashes_per_group=100).collect()}
    want = {(a, b) for a in values for b in values if bin(int(a, 16) ^ int(b, 16)).count("1") <= 16}
    assert got == want


def track(n, seed):
    draw = random.Random(seed)
    t = 0
    points = []
    for i in range(n):
        t += draw.choice([0, 10, 30, 30, 500, -5 if seed % 2 else 20])
        points.append((i, 72.8 + draw.randrange(5) * 0.001, 19.0 + draw.randrange(3) * 0.001, t * 1_000_000))
    return points


def test_trace_folds_equal_a_plain_scan(spark):
    rows = [("B", f"t{k}", *p) for k in range(4) for p in track(300 if k == 0 else 15, k)]
    df = spark.createDataFrame(rows, "bill_id string, trace_key string, seq bigint, lon double, lat double, epoch_us bigint").withColumns(
        {"wall_us": F.col("epoch_us"), "offset_min": F.lit(None).cast("int")}
    )
    facts = {r.trace_key: r for r in traces.trace_facts(df, gap_bucket_us=100_000_000).collect()}
    quality_rows = {r.trace_key: r for r in traces.trace_quality(df, block=8).collect()}
    for key in {r[1] for r in rows}:
        line = [r for r in rows if r[1] == key]
        stamps = sorted(r[5] for r in line)
        assert facts[key].max_gap_s == max((b - a) / 1e6 for a, b in zip(stamps, stamps[1:]))
        assert facts[key].n_points == len(line)
        assert (facts[key].first_point.lon, facts[key].last_point.lat) == (line[0][3], line[-1][4])
        same = sum((a[3], a[4]) == (b[3], b[4]) for a, b in zip(line, line[1:]))
        back = [b[2] for a, b in zip(line, line[1:]) if b[5] < a[5]]
        assert quality_rows[key].repeats == same
        assert quality_rows[key].backwards_seq == (back[0] if back else None)


def test_thin_route_keeps_the_same_points(spark):
    rows = [("B", f"t{n}", i, float(i), 0.0) for n in (1, 20, 21, 59, 240) for i in range(n)]
    df = spark.createDataFrame(rows, "bill_id string, trace_key string, seq bigint, lon double, lat double")
    got = {r.trace_key: [int(p.lon) for p in r.route] for r in traces.thin_route(df, limit=20).collect()}
    for n in (1, 20, 21, 59, 240):
        step = n / 19
        want = list(range(n)) if n <= 20 else [int(i * step) for i in range(19)] + [n - 1]
        assert got[f"t{n}"] == want


def test_thin_route_with_gaps_in_seq(spark):
    rows = [("B", "t", 1000 * i * i, float(i), 0.0) for i in range(50)]
    df = spark.createDataFrame(rows, "bill_id string, trace_key string, seq bigint, lon double, lat double")
    route = [int(p.lon) for p in traces.thin_route(df, limit=20).first().route]
    assert route == [int(i * 50 / 19) for i in range(19)] + [49]


def test_neighbours_over_measured_ranges(spark):
    rows = [("hot", f"photos/camera/2026/{i * 7919 % 2003:05d}.jpg") for i in range(900)] + [("cold", "photos/a.jpg")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = range_buckets(spark.createDataFrame(rows, "k string, name string"), ["k"], ["name"], "_range")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert df.where("k = 'hot'").select("_range").distinct().count() > 1
    got = {r.name: r.prev.name if r.prev else None for r in neighbours(df, ["k"], ["name"], F.col("_range"), ["name"]).where("k = 'hot'").collect()}
    names = sorted(n for k, n in rows if k == "hot")
    assert got == dict(zip(names, [None, *names]))


def test_budget_rounds_equal_a_loop(spark):
    draw = random.Random(9)
    rows = [(draw.choice(["hot", "hot", "x", "y"]), i, draw.choice(["photo", "slip", "memo"]), draw.randrange(1, 60)) for i in range(200)]
    df = spark.createDataFrame(rows, "case_id string, n bigint, grp string, size_bytes bigint")
    caps = {"photo": 4, "slip": 2}
    want = set()
    for case in ("hot", "x", "y"):
        used, size, files = {}, 0, 0
        for _, n, grp, s in [r for r in rows if r[0] == case]:
            if files < 5 and size + s <= 120 and used.get(grp, 0) < caps.get(grp, 0):
                used[grp], size, files = used.get(grp, 0) + 1, size + s, files + 1
                want.add((case, n))
    got = control.admit_files(df.repartition(7), "n", control.Budget(5, 120, caps)).collect()
    assert {(r.case_id, r.n) for r in got if r.admitted} == want and len(got) == 200


def test_an_admission_plans_without_a_job(spark):
    df = spark.range(2000).select(F.lit("hot").alias("case_id"), F.col("id").alias("n"), F.lit("photo").alias("grp"), F.lit(1).alias("size_bytes"))
    tracker = spark.sparkContext.statusTracker()
    before = tracker.getJobIdsForGroup()
    admitted = control.admit_files(df, "n")
    assert tracker.getJobIdsForGroup() == before
    assert sorted(r.n for r in admitted.where("admitted").collect()) == list(range(12))


def test_nearest_drain_equals_brute_force(spark):
    draw = random.Random(6)
    drains = []
    for i in range(40):
        x, y = 72 + draw.random() * (0.1 if i < 30 else 20), 19 + draw.random() * (0.1 if i < 30 else 10)
        fence = [[[{"lon": x + a, "lat": y + b} for a, b in ((-0.001, -0.001), (0.001, -0.001), (0.001, 0.001), (-0.001, 0.001))]]] if i % 2 else None
        line = [] if i % 9 == 1 else [{"lon": x, "lat": y}, {"lon": x + 0.003, "lat": y + 0.002}][: 1 if i % 7 == 0 else 2]
        drains.append((str(i), i, fence, line))
    points = [(n, 72 + draw.random() * 0.1, 19 + draw.random() * 0.1) for n in range(120)] + [(200 + n, 60 + draw.random() * 40, draw.random() * 50) for n in range(30)]
    d = spark.createDataFrame(drains, f"drain_id string, place int, geofence {geo.GEOMETRY_DDL}, centreline {geo.LINE_DDL}")
    p = spark.createDataFrame(points, "point_id int, lon double, lat double")
    got = {r.point_id: (r.drain_id, round(r.distance_m, 6)) for r in quality.locate(p, d).collect()}
    pairs = p.crossJoin(d).select(
        "point_id", "drain_id", "place",
        F.when(geo.in_geometry(F.col("lon"), F.col("lat"), F.col("geofence")), F.lit(-1.0)).otherwise(geo.dist_to_line_m(geo.pt(F.col("lon"), F.col("lat")), F.col("centreline"))).alias("m"),
    )
    want = {}
    for r in sorted(pairs.collect(), key=lambda r: (r.point_id, r.m, r.place)):
        want.setdefault(r.point_id, (r.drain_id, round(max(r.m, 0.0), 6)))
    assert got == want


def test_nearest_drain_anywhere_on_the_globe(spark):
    """Long and short segments, equal shapes, high latitudes, far points; by group; no pair of
    tables meets without a key."""
    draw = random.Random(8)
    drains = []
    for i in range(60):
        x, y, w = draw.uniform(-170, 170), draw.uniform(-86, 86), draw.choice([0, 1e-5, 0.01, 0.4, 9])
        line = [{"lon": x, "lat": y}, {"lon": x + w, "lat": y + w / 3 if y < 80 else y}]
        drains += [(draw.choice("gh"), str(i), i, None, line)] + ([("g", f"again{i}", 100 + i, None, line)] if i % 5 == 0 else [])
    drains.append(("none", "fence", 1, [[[{"lon": a, "lat": b} for a, b in ((-20.0, -20.0), (20.0, -20.0), (20.0, 20.0), (-20.0, 20.0))]]], []))
    points = [(draw.choice("gh"), n, draw.uniform(-180, 180), draw.uniform(-88, 88)) for n in range(80)] + [("none", 500, 1.0, 1.0), ("none", 501, 50.0, 1.0)]
    d = spark.createDataFrame(drains, f"grp string, drain_id string, place int, geofence {geo.GEOMETRY_DDL}, centreline {geo.LINE_DDL}")
    p = spark.createDataFrame(points, "grp string, point_id int, lon double, lat double")
    located = quality.locate(p, d, by=("grp",))
    got = {r.point_id: (r.drain_id, round(r.distance_m, 4)) for r in located.collect()}
    here = geo.pt(F.col("lon"), F.col("lat"))
    metres = F.when(geo.in_geometry(F.col("lon"), F.col("lat"), F.col("geofence")), F.lit(-1.0)).otherwise(geo.dist_to_line_m(here, F.col("centreline")))
    want = {}
    for r in sorted(p.join(d, "grp").select("point_id", "drain_id", "place", metres.alias("m")).collect(), key=lambda r: (r.point_id, r.m, r.place)):
        want.setdefault(r.point_id, (r.drain_id if r.m < float("inf") else None, round(max(r.m, 0.0), 4)))
    assert got == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = quality.locate(p, d)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "Cartesian" not in plan


GOOD = '{"points":[{"lat":22.58,"lon":88.47,"t":"2026-10-09T07:00:00+05:30"},{"lat":22.57,"lon":88.46,"t":"2026-10-09T07:05:00+05:30"}]}'


def test_trace_refusals_one_per_reason(spark):
    a = '{"lat":22.58,"lon":88.47,"t":"2026-10-09T07:00:00+05:30"}'
    b = '{"lat":22.57,"lon":88.46,"t":"2026-10-09T07:05:00+05:30"}'
    wrap = lambda *p: '{"points":[' + ",".join(p) + "]}"
    feature = '{"type":"Feature","properties":{"times":["2026-10-09T07:00:00Z"]},"geometry":{"type":"LineString","coordinates":[[88.47,22.58],[88.46,22.57]]}}'
    cases = {
        "json": ("not json", "not valid UTF-8 JSON"), "few": (wrap(a), "at least 2 points"),
        "range": (wrap(a.replace("22.58", "95"), b), "latitude 95 is out of range"),
        "number": (wrap(a.replace("88.47", "null"), b), "longitude is missing"), "text": (wrap(a.replace("88.47", '"88"'), b), "longitude is missing"),
        "zero": (wrap('{"lat":0,"lon":0,"t":"2026-10-09T07:00:00+05:30"}', b), "[0, 0]"),
        "iso": (wrap(a.replace("2026-10-09T07:00:00+05:30", "yesterday"), b), "not ISO 8601"),
        "none": (wrap('{"lat":22.58,"lon":88.47,"t":null}', b), "no timestamp"), "back": (wrap(b, a), "backwards"),
        "mix": (wrap(a.replace("+05:30", ""), b), "mix"), "list": ("[[88.47, 22.58]]", "unrecognised trace format"),
        "times": (feature, "one timestamp per coordinate"),
        "point": ('{"type":"Feature","properties":{},"geometry":{"type":"Point","coordinates":[88.47,22.58]}}', "LineString"),
        "object": (wrap(a, "[1,2]"), "point 2 must be an object"), "good": (GOOD, None),
    }
    files = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "trace_key string, content string")
    heads = trace_files.strict_headers(files)
    good, bad = trace_files.validate_traces(trace_files.strict_points(heads), ("trace_key",))
    reasons = {r.trace_key: r.reason for r in heads.where("reason is not null").select("trace_key", "reason").unionByName(bad).collect()}
    for key, (_, reason) in cases.items():
        assert (reasons.get(key) is None) if reason is None else reason in reasons[key], (key, reasons.get(key))
    assert {r.trace_key for r in good.select("trace_key").distinct().collect()} == {"good"}


def test_buckets_of_a_hot_bill_are_dealt_apart(spark):
    """With the fences joined by shuffle, the points still meet an exchange by bucket."""
    rows = [("B", "t", i, 72.8 + i / 1e5, 19.0, i * 60_000_000) for i in range(60)] + [("B", "t", 60 + i, 72.8, 19.0, None) for i in range(20_000)]
    points = spark.createDataFrame(rows, "bill_id string, trace_key string, seq bigint, lon double, lat double, epoch_us bigint")
    points = points.selectExpr("*", "epoch_us AS wall_us", "CAST(NULL AS INT) AS offset_min")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        other = spark.createDataFrame([("B", 1)], "bill_id string, x int")
        placed = points.join(other, "bill_id").withColumn("inside", F.lit(False)).drop("x")
        plan = traces.trace_facts(placed)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert any("hashpartitioning" in x and "trace_key" in x and "_bucket" in x for x in plan.split("\n"))
    facts = traces.trace_facts(placed).first()
    assert (facts.n_points, facts.n_timed, facts.max_gap_s) == (20_060, 60, 60.0)
