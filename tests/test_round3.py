"""Joins that must not be broadcast, streams of tables that are folders."""

import random

from pyspark.sql import functions as F

from catalog import quality
from loadaudit.functions import geo
from loadaudit.operators import photos
from loadaudit.plans import fixturemap
from loadaudit.plans.fixturemap import Fixture
from loadaudit.sources import features


def test_probes_of_hashes_are_never_broadcast(spark):
    value = F.lpad(F.lower(F.hex(F.xxhash64("id"))), 16, "0")
    df = spark.range(300).select(F.lit("x").alias("g"), value.alias("hash"))
    pairs = photos.near_hashes(df, ["g"], 20, hashes_per_group=20)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    assert pairs.where(F.col("hash") == F.col("other")).count() == 300


def test_all_pairs_in_blocks_are_complete_and_cheaper_than_wide_bands(spark):
    draw = random.Random(5)
    values = {f"{draw.getrandbits(64):016x}" for _ in range(60)}
    for v in sorted(values)[:40]:
        bits = int(v, 16)
        for b in draw.sample(range(64), draw.randrange(1, 24)):
            bits ^= 1 << b
        values.add(f"{bits:016x}")
    rows = [(g, v) for g in ("x", "y", None) for v in sorted(values)] + [("x", v + "0f") for v in sorted(values)]
    df = spark.createDataFrame(rows, "g string, hash string")
    assert photos.meetings(20, 5) > 1 > photos.meetings(12, 4)
    got = photos.meeting(df, df, ["g"], 20, 5).collect()
    near = lambda a, b: len(a) == len(b) and a != b and bin(int(a, 16) ^ int(b, 16)).count("1") <= 20
    want = sorted((g, a, b) for g, a in rows for h, b in rows if g is not None and g == h and near(a, b))
    assert sorted(map(tuple, got)) == want
    # Two random hashes met 5 times in five bands, for 894 rows of a hash.
    probes = photos.meeting(df, df, ["g"], 20, 5)._jdf.queryExecution().analyzed().toString()
    assert "shiftrightunsigned" not in probes.lower()


def test_a_streamed_table_may_be_a_file_or_a_folder(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("event_id"))
    rows.repartition(3).write.parquet(str(tmp_path / "folder" / "events.parquet"))
    rows.repartition(2).write.parquet(str(tmp_path / "folder" / "others.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "made"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "made").glob("part-*.parquet")).rename(tmp_path / "file" / "events.parquet")
    for kind in ("file", "folder"):
        streamed = quality._Streamed(spark, str(tmp_path / kind)).table("events")
        assert streamed.schema == Fixture(spark, str(tmp_path / kind)).table("events").schema
        out, kept = str(tmp_path / f"out-{kind}"), str(tmp_path / f"kept-{kind}")
        streamed.writeStream.option("checkpointLocation", kept).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
        assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == list(range(40))


def test_sections_of_one_length_are_sorted_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(features, "SORTED_ROWS", 100)
    line = F.array(*[geo.pt(F.lit(72.8 + i * 0.001), F.lit(19.0)) for i in range(8)])
    lines = spark.range(300).select(F.col("id").alias("osm_id"), F.create_map(F.lit("a"), F.lit("b")).alias("tags"), line.alias("line"), F.lit(736.0).alias("length_m"))
    lines = lines.unionByName(lines.limit(5).withColumn("length_m", F.lit(5.0) + F.col("osm_id")))
    out = features.split_lines(lines, 400.0)
    rows = out.withColumn("at", F.spark_partition_id()).collect()
    assert len(rows) == 605 and [r.length_m for r in rows] == sorted((r.length_m for r in rows), reverse=True)
    assert len({(r.osm_id, r.section) for r in rows if r.section}) == 600
    assert max(sum(r.at == at for r in rows) for at in {r.at for r in rows}) < 250


def test_a_large_table_is_dealt_to_more_tasks_than_cores(spark, monkeypatch):
    monkeypatch.setattr(fixturemap, "TASK_ROWS", 10)
    dealt = Fixture(spark, "").dealt(spark.range(95))
    assert dealt.rdd.getNumPartitions() == 10 and dealt.count() == 95
    assert Fixture(spark, "").dealt(spark.range(3)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
