"""One pass over the points: summaries and refusals of traces."""

import random

from pyspark.sql import functions as F

from loadaudit.functions import clock
from loadaudit.operators import traces
from loadaudit.sources import traces as files


def points(spark, rows):
    return spark.createDataFrame(rows, "trace_key string, seq bigint, lon double, lat double, t string")


def random_rows(draw):
    rows = []
    for k in range(12):
        second = draw.randrange(100)
        n = draw.choice([1, 2, 7, 40, 130])
        for i in range(n):
            second += draw.choice([0, 5, 60, 400, -30 if draw.random() < 0.02 else 5])
            zone = "" if k % 4 == 0 or (k == 5 and i == 3) else "+05:30"
            t = None if draw.random() < 0.01 else f"2026-09-25T{6 + second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}{zone}"
            rows.append((f"t{k}", i, 72.0 + draw.choice([0, 0.001, 0.01, i * 0.01]), 19.0, t))
    return rows


def test_blocks_of_any_size_say_the_same(spark):
    rows = random_rows(random.Random(3))
    df = points(spark, rows)
    want = None
    for block in (1, 3, 64, 4096):
        got = {}
        for r in traces.block_summary(df, ("trace_key",), block).collect():
            got[r.trace_key] = (
                r.n_points, r.n_timed, r.naive, r.aware, round(r.distance_m, 6), r.repeats, round(r.max_kmh, 6), r.max_gap_s, r.back, r.first, r.last, r.min_lon, r.max_lon, r.min_lat, r.max_lat,
            )
        want = want or got
        assert got == want
    plain = {r.trace_key: r for r in traces.trace_quality(df, ("trace_key",)).collect()}
    for k, g in want.items():
        p = plain[k]
        assert (g[0], g[4], g[5], g[6], g[8] and g[8].seq) == (p.n_points, round(p.distance_m, 6), p.repeats, round(p.max_kmh, 6), p.backwards_seq)
    facts = {r.trace_key: r for r in traces.trace_facts(df, ("trace_key",)).collect()}
    for k, g in want.items():
        assert (g[1], g[9].at, g[10].at) == (facts[k].n_timed, facts[k].departure, facts[k].last_fix)
        if g[8] is None and g[1] == g[0]:
            assert g[7] == facts[k].max_gap_s


def test_the_points_are_exchanged_once(spark):
    df = points(spark, random_rows(random.Random(4)))
    for frame in (traces.block_summary(df, ("trace_key",)), files.trace_summary(df, ("trace_key",), route_limit=None)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(trace_key") == 2  # the points by block, one row a block by trace
        assert plan.count("_block") and plan.count("Exchange") == 2
    _, refused = files.validate_traces(df, ("trace_key",))
    assert refused._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


def test_reasons_rank_over_blocks(spark):
    rows = [("back", i, 72.0 + i, 19.0, f"2026-09-25T06:{(10 + i if i < 8 else 5):02d}:00Z") for i in range(12)]
    rows += [("bad", i, 72.0 if i != 9 else 999.0, 19.0, f"2026-09-25T06:{10 + i}:00Z") for i in range(12)]
    rows += [("mixed", i, 72.0, 19.0, f"2026-09-25T06:{10 + i}:00" + ("Z" if i == 7 else "")) for i in range(12)]
    rows += [("one", 0, 72.0, 19.0, "2026-09-25T06:10:00Z")] + [("good", i, 72.0, 19.0, f"2026-09-25T06:{10 + i}:00Z") for i in range(12)]
    for block in (4, 4096):
        good, refused = files.validate_traces(points(spark, rows), ("trace_key",), block=block)
        reasons = {r.trace_key: r.reason for r in refused.collect()}
        assert set(reasons) == {"back", "bad", "mixed", "one"} and {r.trace_key for r in good.select("trace_key").distinct().collect()} == {"good"}
        assert reasons["mixed"] == files.REASONS["mixed"] and reasons["one"] == files.REASONS["few"]
        assert "9" in reasons["back"] and "06:05" in reasons["back"] and "10" in reasons["bad"]
    row = files.trace_summary(good, ("trace_key",)).first()
    assert (row.n_points, row.start_time[:16], row.end_time[:16], row.max_gap_s, len(row.route)) == (12, "2026-09-25T06:10", "2026-09-25T06:21", 60.0, 12)
