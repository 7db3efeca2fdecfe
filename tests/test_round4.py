"""Findings that are exploded by number, verdicts from bits, slips dealt by their key."""

import pytest
from pyspark.sql import functions as F

from catalog import ledger
from loadaudit.operators import findings, rollup
from loadaudit.operators.findings import Case
from loadaudit.plans.fixturemap import Fixture

ROWS = [("a", 1), ("b", 5), ("c", None), (None, 9)]


def cases():
    return [
        Case("R7", "soft", F.col("n").isNull(), F.concat(F.lit("unread "), F.col("id"))),
        Case("R9", "hard", F.col("n") > 3, F.format_string("%d of %s", "n", "id"), {"n": F.col("n"), "id": F.col("id")}),
        Case("R7", "hard", F.col("n") > 8, "photos_missing"),
    ]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_finding_is_built_only_where_it_is_read(spark):
    out = findings.explode_findings(spark.createDataFrame(ROWS, "id string, n int"), cases(), ["id"])
    assert sorted((r.id or "", r.pos, r.rule, r.severity, r.message, r.evidence) for r in out.collect()) == [
        ("", 0, "R9", "hard", "9 of null", {"n": "9"}), ("", 1, "R7", "hard", "No photo evidence was ingested for this drain.", {}),
        ("b", 0, "R9", "hard", "5 of b", {"n": "5", "id": "b"}), ("c", 0, "R7", "soft", "unread c", {}),
    ]
    assert out.columns == ["id", "pos", "rule", "severity", "rule_text", "message", "evidence"]
    assert "format_string" in plan(out) and "map_from_arrays" in plan(out)
    bare = plan(out.select("id", "rule", "severity"))
    assert "format_string" not in bare and "map_from_arrays" not in bare


def test_verdicts_from_known_rules_are_those_from_any(spark):
    said = [("x", "1", "R9", "hard"), ("x", "1", "R9", "hard"), ("x", "1", "R10", "soft"), ("x", "1", "R7", "hard"), ("x", "2", "SLIP_MISSING", "soft"), ("x", "2", None, "hard"),
            ("y", "1", "R7", "other"), (None, "1", "R7", "hard"), ("x", "9", "R7", "hard")]
    found = spark.createDataFrame(said, "bill_id string, trip_id string, rule string, severity string")
    trips = spark.createDataFrame([(7, "x", "1"), (8, "x", "1"), (1, "x", "2"), (2, "x", "3"), (3, "y", "1"), (4, None, "1")], "k int, bill_id string, trip_id string")
    want = rollup.trip_verdicts(found, trips)
    got = rollup.trip_verdicts(found, trips, rules=["SLIP_MISSING", "R9", "R10", "R7", "R7"])
    assert got.columns == want.columns == ["bill_id", "trip_id", "k", "hard_fails", "soft_fails", "verdict"]
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert {r.k: (r.hard_fails, r.soft_fails, r.verdict) for r in got.collect() if r.k in (7, 1, 2, 4)} == {
        7: (["R7", "R9"], ["R10"], "HOLD"), 1: ([], ["SLIP_MISSING"], "REVIEW"), 2: ([], [], "VERIFIED"), 4: ([], [], "VERIFIED"),
    }
    assert "collect_set" in plan(want) and "collect_set" not in plan(got)
    with pytest.raises(Exception, match="unknown rule (R9|R10|SLIP_MISSING)"):
        rollup.trip_verdicts(found, trips, rules=["R7"]).collect()


def test_slips_are_dealt_once_and_meet_trips_by_their_key(spark, tmp_path):
    lines = [(k, 1 + k % 7, k % 5, k % 3, float(k % 40 + 1), 0.01 * (k % 4), "R" if k % 9 == 0 else "N") for k in range(400)]
    loads = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_tax double, l_returnflag string")
    loads.withColumn("l_shipdate", F.when(F.col("l_orderkey") > 5, F.lit("1996-02-03").cast("date"))).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(3).select(F.col("id").alias("s_suppkey"), (F.col("id") % 2).alias("s_nationkey"), F.lit("s").alias("s_name")).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(5).select(F.col("id").alias("p_partkey"), F.lit(20).alias("p_size")).write.parquet(str(tmp_path / "part.parquet"))
    fx = Fixture(spark, str(tmp_path))
    assert fx.weighed_slips.count() == sum(k[1] != 7 for k in lines)
    # Null keys join nothing and are left out before the slips are dealt.
    joined = fx.supplier_trips.join(fx.weighed_slips.withColumnRenamed("s3_key", "slip_key"), "slip_key")
    text = plan(joined)
    dealt = text[text.index("RepartitionByExpression"):]
    assert "isnotnull(concat(" in dealt
    out = ledger.agg_01(spark, str(tmp_path))
    assert "RoundRobin" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    assert len(rows) == 400 and sum(r.trip_id is None for r in rows) == 6
    assert all("SLIP_MISSING" in (r.soft_fails or "") for r in rows if r.trip_id and r.trip_id.split("-")[1] == "7")
