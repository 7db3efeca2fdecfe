"""All pairs of hashes: compared in blocks, in one batch and over the batches of a stream."""

import random

import pytest
from pyspark.sql import functions as F

from loadaudit.operators import photos, quality
from loadaudit.streaming import streams


def drawn(seed, n=50):
    """Hashes and others a few bits apart from them."""
    draw = random.Random(seed)
    values = {f"{draw.getrandbits(64):016x}" for _ in range(n)}
    for v in sorted(values):
        bits = int(v, 16)
        for b in draw.sample(range(64), draw.randrange(1, 26)):
            bits ^= 1 << b
        values.add(f"{bits:016x}")
    return sorted(values)


def near(a, b, bits):
    return len(a) == len(b) and a != b and bin(int(a, 16) ^ int(b, 16)).count("1") <= bits


@pytest.mark.parametrize("block", [9, 16384])
def test_blocks_give_each_near_pair_once(spark, monkeypatch, block):
    monkeypatch.setattr(photos, "BLOCK", block)
    values = drawn(3)
    own = [(g, 1, v) for g in ("x", None) for v in values] + [("y", 2, v) for v in values[:7]] + [("x", 2, values[0])]
    own += [("x", 1, v + e) for v in values[:20] for e in ("0f", "ff")] + [("x", 1, v[:5]) for v in values[:9]] + [("x", 1, values[0].upper())]
    own = sorted(set(own), key=str)
    ddl = "g string, n int, hash string"
    df = spark.createDataFrame(own, ddl)
    got = sorted(map(tuple, photos.every_pair(df, df, ["g", "n"], 20).collect()))
    pairs = lambda left, right: sorted((g, n, a, b) for g, n, a in left for h, m, b in right if g is not None and (g, n) == (h, m) and near(a, b, 20))
    want = pairs(own, own)
    upper = values[0].upper()
    # Two spellings of one hash are two hashes without a bit between them.
    assert got == want and upper != values[0] and ("x", 1, upper, values[0]) in got
    others = spark.createDataFrame(own[::3] + [("z", 1, values[0])], ddl)
    mixed = sorted(map(tuple, photos.every_pair(df, others, ["g", "n"], 20).collect()))
    assert mixed == pairs(own, own[::3]) and mixed


def test_a_dense_unit_leaves_in_parts(spark):
    values = [f"{i:016x}" for i in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "hash string")
    assert photos.every_pair(df, df, [], 64).count() == photos.every_pair(df, df, [], 64).distinct().count() == 400 * 399


def batches_of(spark, tmp_path, batches):
    ddl = "bill_id string, drain_id string, s3_key string, timestamp string, p_hash string"
    folder = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(folder), spark.createDataFrame([r for b in batches for r in b], ddl)


def test_a_stream_compares_new_hashes_with_its_groups_and_keeps_no_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(photos, "BLOCK", 20)
    draw, values = random.Random(8), drawn(6, 40)
    row = lambda i, bill, v: (bill, str(i % 3), f"k{i}", draw.choice([None, f"2026-09-{draw.randrange(1, 29):02d}"]), v)
    rows = [row(i, draw.choice(["B1", "B2"]), draw.choice(values)) for i in range(150)] + [row(200, None, values[0]), row(201, None, values[0]), row(202, "B1", "no hash"), row(203, "B1", None)]
    draw.shuffle(rows)
    batches = [rows[:70], rows[70:75], rows[70:75], rows[75:], [row(300, "B9", "00")]]
    stream, everything = batches_of(spark, tmp_path, batches)
    path = str(tmp_path / "out")
    running = streams.stream_reuse(stream, path, str(tmp_path / "cp"), 20, bands=5, once=True)
    for query in running:
        query.awaitTermination()
    got = sorted(map(str, streams.current_reuse(spark, path).select("bill_id", "s3_key", "original", "distance").collect()))
    want = photos.first_originals(everything, max_bits=20, bands=5).select("bill_id", "s3_key", "original", "distance")
    assert got == sorted(map(str, want.collect())) and len(got) > 30
    # Before: 32 rows of state a hash, and each hash of the group read from them for each new one.
    assert not any(p.stateOperators for p in running[0].recentProgress)
    pairs = spark.read.parquet(f"{path}/pairs")
    assert pairs.select("bill_id", "hash", "other").distinct().count() == pairs.count() > 0
    hashes = spark.read.parquet(f"{path}/hashes")
    assert hashes.count() == hashes.select("bill_id", "hash").distinct().count()


def test_bands_that_half_of_all_pairs_share_are_not_used(spark):
    values = drawn(11, 40)
    df = spark.createDataFrame([("x", v) for v in values] + [("y", values[0])], "g string, hash string")
    assert 0.5 < photos.meetings(16, photos.choose_bands(16, 500)) < 1
    pairs = photos.near_hashes(df, ["g"], 16, hashes_per_group=500)
    # Before: 144 probes a hash, and a row for each pair that shares a band value.
    assert "shiftrightunsigned" not in pairs._jdf.queryExecution().analyzed().toString().lower()
    want = [("x", a, b) for a in values for b in values if a == b or near(a, b, 16)] + [("y", values[0], values[0])]
    assert sorted(map(tuple, pairs.collect())) == sorted(want)
    named = pairs.where(F.col("hash") < F.col("other")).join(df.select("hash").distinct(), "hash")
    named.collect()
    assert "BroadcastHashJoin" not in named._jdf.queryExecution().executedPlan().toString()
    few = photos.near_hashes(df, ["g"], 3, hashes_per_group=500)
    assert "shiftrightunsigned" in few._jdf.queryExecution().analyzed().toString().lower()


def test_an_audit_reads_its_photos_once(spark):
    values = drawn(12, 30)
    rows = [(f"p{i}", v) for i, v in enumerate(values)] + [("q0", values[0]), ("c0", values[1]), ("c1", values[2]), ("n", None), (None, values[3])]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows, "key string, p_hash string").mapInArrow(counted, "key string, p_hash string")
    copies = spark.createDataFrame([("c0", "p1", "exact copy"), ("c1", "p1", "exact copy")], "key string, source string, kind string")
    out = quality.audit_hashes(df, copies, unrelated_bits=16, hashes_per_group=500).collect()
    assert seen.value == len(rows)  # before: each of the ten reads of them
    far = {(r.a, r.b) for r in out if r.problem == "copy too far"}
    assert far == ({("c1", "p1")} if values[1] != values[2] else set())
    close = [frozenset((r.a, r.b)) for r in out if r.problem == "unrelated too close" and r.distance]
    first = {v: min(k for k, x in rows if x == v and k) for v in values}
    want = {frozenset((first[a], first[b])) for a in values for b in values if near(a, b, 16)}
    assert len(close) == len(set(close)) and set(close) == want
    assert [(r.a, r.b) for r in out if r.distance == 0 and {r.a, r.b} == {"p0", "q0"}]
