"""Streams against batch: the same rows in several micro-batches, some of them late."""

from pyspark.sql import functions as F

from loadaudit.functions import geo
from loadaudit.operators import control, photos, traces
from loadaudit.streaming import streams


def feed(spark, tmp_path, batches, ddl):
    """One file per micro-batch, read one at a time in the order written."""
    folder = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(folder)


LEG = "bill_id string, vehicle_no string, trip_id string, start bigint, end bigint, x double"


def as_legs(df):
    time = lambda c: F.struct(F.col(c).alias("wall_us"), F.lit(None).cast("int").alias("offset_min"), F.col(c).alias("epoch_us"))
    point = geo.pt(F.col("x"), F.lit(19.0))
    return df.select("bill_id", "vehicle_no", "trip_id", time("start").alias("departure"), time("end").alias("last_fix"), point.alias("first_point"), point.alias("last_point"))


def read_rows(query):
    """Rows that each micro-batch took in."""
    return [p.numInputRows for p in query.recentProgress if p.numInputRows]


def test_late_leg_changes_both_neighbours(spark, tmp_path):
    m = 60_000_000
    month = 31 * 24 * 60 * m
    batches = [
        [("B", "T1", "a", 0, 30 * m, 72.0), ("B", "T1", "c", 100 * m, 130 * m, 72.0), ("B", "T2", "x", 0, 10 * m, 72.0)],
        [("B", "T1", "z", 5 * month, 5 * month + m, 90.0)],
        [("B", "T1", "b", 40 * m, 60 * m, 73.0)],
        [("B", "T1", "y", 2 * month, 5 * month - m, 72.0)],  # between two cells that are never read again
    ]
    legs = as_legs(feed(spark, tmp_path, batches, LEG))
    path = str(tmp_path / "out")
    streams.stream_turnaround(legs, path, str(tmp_path / "cp"), once=True).awaitTermination()
    got = {(r.leg_id, r.other, r.kmh) for r in streams.current_turnaround(spark, path).collect()}
    everything = spark.createDataFrame([r for b in batches for r in b], LEG)
    want = {(r.leg_id, r.after.other, r.after.kmh) for r in traces.truck_legs(as_legs(everything)).where("after.kmh > 40").collect()}
    assert got == want and {x[:2] for x in got} == {("a", "b"), ("b", "c"), ("y", "z")}


def test_a_batch_of_legs_opens_its_own_time_cells(spark, tmp_path, monkeypatch):
    """A leg a month for two years: the rows that a batch reads back do not grow."""
    m, month = 60_000_000, 30 * 24 * 3600 * 1_000_000
    batches = [[("B", "T", f"l{i}-{k}", i * month + k * 60 * m, i * month + (k * 60 + 30) * m, 72.0 + k) for k in range(3)] for i in range(12)]
    seen, stored = [], streams._stored

    def watched(session, path, *args):
        df = stored(session, path, *args)
        where = df.where

        def counted(condition):
            out = where(condition)
            seen.append(out.count())
            return out

        df.where = counted
        return df

    monkeypatch.setattr(streams, "_stored", watched)
    path = str(tmp_path / "out")
    streams.stream_turnaround(as_legs(feed(spark, tmp_path, batches, LEG)), path, str(tmp_path / "cp"), once=True).awaitTermination()
    assert len(seen) == 12 and max(seen) == 0
    everything = as_legs(spark.createDataFrame([r for b in batches for r in b], LEG))
    want = {(r.leg_id, r.after.other) for r in traces.truck_legs(everything).where("after.kmh > 40").collect()}
    assert {(r.leg_id, r.other) for r in streams.current_turnaround(spark, path).collect()} == want


PHOTO = "bill_id string, drain_id string, s3_key string, timestamp string, p_hash string"


def reused(spark, tmp_path, batches, **more):
    path = str(tmp_path / "out")
    running = streams.stream_reuse(feed(spark, tmp_path, batches, PHOTO), path, str(tmp_path / "cp"), once=True, **more)
    for query in running:
        query.awaitTermination()
    got = {(r.bill_id, r.s3_key, r.original, r.distance) for r in streams.current_reuse(spark, path).collect()}
    everything = spark.createDataFrame([r for b in batches for r in b], PHOTO)
    want = {(r.bill_id, r.s3_key, r.original, r.distance) for r in photos.first_originals(everything, hashes_per_group=20).collect()}
    assert got == want
    return got, running


def test_earlier_photo_arriving_late_becomes_the_original(spark, tmp_path):
    batches = [
        [("B1", "1", "k2", "2026-09-02", "00000000000000ff"), ("B1", "2", "k3", "2026-09-03", "00000000000000fe"), ("B2", "1", "z", "2026-09-01", "00000000000000ff")],
        [("B1", "3", "k1", "2026-09-01", "00000000000000fd"), ("B1", "3", "bad", "2026-09-01", "no hash"), ("B1", "4", "k9", None, None)],
    ]
    got, _ = reused(spark, tmp_path, batches)
    assert {x[1:3] for x in got} == {("k2", "k1"), ("k3", "k1")}


def test_a_batch_of_photos_looks_up_its_own_bands(spark, tmp_path):
    """One bill grows by five photos a batch: no batch does more than the first ones."""
    import random

    draw = random.Random(4)
    batches = [[("B", "1", f"k{i}-{k}", f"2026-09-{i:02d}", f"{draw.getrandbits(64):016x}") for k in range(5)] for i in range(6)]
    batches[3][0] = ("B", "1", "copy", "2026-10-01", batches[0][0][4])
    got, running = reused(spark, tmp_path, batches, max_bits=3)
    pairs = [p for p in running[0].recentProgress if p.numInputRows]
    assert {p.numInputRows for p in pairs} == {5}  # the batch, and nothing else
    join = [max(p.stateOperators, key=lambda s: s.numRowsUpdated).numRowsUpdated for p in pairs]
    assert max(join) <= join[0]
    assert ("B", "copy", "k0-0", 0) in got


def test_gap_sessions_merge_late_fixes(spark, tmp_path):
    ddl = "bill_id string, trace_key string, s bigint"
    batches = [[("B", "t", 0), ("B", "t", 180), ("B", "t", 541)], [("B", "t", 361)], [("B", "u", 0), ("B", "u", 181)]]
    points = feed(spark, tmp_path, batches, ddl).withColumn("ts", F.timestamp_seconds("s"))
    for delay in (3600, 10):  # late fixes inside the delay, and behind it
        path = str(tmp_path / f"runs-{delay}")
        streams.stream_gaps(points, path, str(tmp_path / f"cp-{delay}"), delay_s=delay, once=True).awaitTermination()
        runs = streams.current_runs(spark, path)
        gaps = {(r.trace_key, r.gap_s) for r in streams.gaps_of(runs).collect()}
        # 180 s is no gap and 181 s is; the late fix at 361 closes 541 - 361 = 180 but leaves 181.
        assert gaps == {("t", 181.0), ("u", 181.0)}
        assert {(r.trace_key, r.n) for r in runs.collect()} == {("t", 2), ("u", 1)}


def test_what_is_kept_does_not_grow_with_new_traces(spark, tmp_path):
    """Twenty batches, each with traces that the batch before did not have."""
    ddl = "bill_id string, trace_key string, seq bigint, lon double, lat double, s bigint"
    batches = [[("B", f"t{i}-{k}", j, 72.0 + j, 19.0, i * 3600 + j * 60) for k in range(2) for j in range(3)] for i in range(20)]
    points = feed(spark, tmp_path, batches, ddl).withColumn("ts", F.timestamp_seconds("s"))
    path = str(tmp_path / "runs")
    streams.stream_gaps(points, path, str(tmp_path / "cp"), delay_s=600, once=True).awaitTermination()
    sizes = [r.n for r in spark.read.parquet(f"{path}/open").where("last_ts IS NOT NULL").groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 20 and max(sizes) <= 2
    runs = streams.current_runs(spark, path).collect()
    assert len(runs) == 40 and {r.n for r in runs} == {3}


def test_arrivals_in_batches_equal_one_pass(spark, tmp_path):
    ddl = "bill_id string, trace_key string, seq bigint, lon double, lat double, s bigint"
    ring = [geo_point(72.0, 19.0), geo_point(72.1, 19.0), geo_point(72.1, 19.1), geo_point(72.0, 19.1), geo_point(72.0, 19.0)]
    sites = spark.createDataFrame([("B", [[ring]], (72.05, 19.05))], f"bill_id string, geofence {geo.GEOMETRY_DDL}, center {geo.POINT_DDL}")
    rows = [("B", "in", i, 71.9 + i * 0.03, 19.05, i * 60) for i in range(6)] + [("B", "out", i, 70.0, 19.0, i * 60) for i in range(4)]
    batches = [[rows[5], rows[4], rows[6]], [rows[9], rows[7]], [rows[3], rows[0], rows[8]], [rows[2], rows[1]]]
    points = feed(spark, tmp_path, batches, ddl).withColumn("ts", F.timestamp_seconds("s"))
    for delay in (86_400, 0):
        path = str(tmp_path / f"facts-{delay}")
        streams.stream_arrivals(points, sites, path, str(tmp_path / f"cp-{delay}"), delay_s=delay, once=True).awaitTermination()
        got = {r.trace_key: (r.inside_seq, r.last_ts.timestamp(), r.n) for r in streams.current_arrivals(spark, path).collect()}
        assert got == {"in": (4, 300.0, 6), "out": (None, 180.0, 4)}


def geo_point(lon, lat):
    return (lon, lat)


def test_a_content_that_failed_is_tried_again(spark, tmp_path):
    ddl = "key string, etag string, s bigint"
    photo, slip = "photos/B1/drain1/after-1.jpg", "slips/B1/1-001.png"
    batches = [
        [(photo, "e1", 0), (photo, "e1", 1), ("misc/x", "e", 2), (slip, "e", 3)],
        [(photo, "e1", 4), (slip, "e", 5)],
        [(photo, "e1", 6), (slip, "e2", 7)],
        [(slip, "e", 4)],  # the older content once more: tried, but it does not replace the newer
    ]
    tried = []

    def process(objects):
        rows = [(r.key, r.etag) for r in objects.collect()]
        tried.append(sorted(rows))
        broken = (F.col("key") == photo) & F.lit(len(tried) == 1)
        return objects.withColumn("error", F.when(broken, F.lit("x" * 2000)))

    objects = feed(spark, tmp_path, batches, ddl).select("key", "etag", F.timestamp_seconds("s").alias("ts"))
    path = str(tmp_path / "items")
    streams.stream_ingest(objects, process, path, str(tmp_path / "cp"), once=True).awaitTermination()
    assert tried == [[(photo, "e1"), (slip, "e")], [(photo, "e1")], [(slip, "e2")], [(slip, "e")]]
    items = {r.key: (r.etag, r.status, r.error) for r in streams.current_items(spark, path).collect()}
    assert items == {photo: ("e1", "OK", None), slip: ("e2", "OK", None)}
    first = streams.current_items(spark, path, before=1).where(F.col("key") == photo).first()
    assert (first.status, len(first.error)) == ("ERROR", 900)


def test_states_in_batches_equal_one_fold(spark, tmp_path):
    ddl = "item_id string, grp string, n bigint, state string"
    log = [
        ("i", "photo", 1, "UPLOADED"), ("i", "photo", 2, "QUEUED"), ("i", "photo", 3, "READY"), ("i", "photo", 4, "PROCESSING"),
        ("i", "photo", 5, "FAILED"), ("i", "photo", 6, "QUEUED"), ("t", "trace", 1, "READY"), ("t", "trace", 2, "QUEUED"),
    ]
    path = str(tmp_path / "out")
    streams.stream_states(feed(spark, tmp_path, [log[:4], log[4:]], ddl), path, str(tmp_path / "cp"), bucket=2, once=True).awaitTermination()
    got = {r.item_id: r.state for r in streams.current_results(spark, path, ["item_id"]).collect()}
    assert got == {"i": "QUEUED", "t": "READY"}
    _, illegal = control.evidence_state(spark.createDataFrame(log, ddl), "n", F.floor(F.col("n") / 2))
    assert {(r.item_id, r.n, r.from_state, r.to_state) for r in illegal.collect()} == {("i", 3, "QUEUED", "READY"), ("t", 2, "READY", "QUEUED")}
