"""What the sinks leave behind, and what loading opens."""

import dataclasses
import json
import re
from types import SimpleNamespace

from pyspark.sql import functions as F

from loadaudit.operators import rollup
from loadaudit.plans import bill
from loadaudit.sources import runs, tables

from test_golden_bill import build as golden_case


def filters(df):
    """The partition filters of every scan of a plan."""
    return re.findall(r"PartitionFilters: \[([^\]]*)\]", df._jdf.queryExecution().executedPlan().toString())


def audited(spark, bills, found):
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    return SimpleNamespace(
        case=SimpleNamespace(bills=frame([(b,) for b in bills], "bill_id string")),
        findings=frame([(b, r, f"{b} {r}") for b, r in found], "bill_id string, rule string, message string"),
        trips=frame([(b, f"t{b}", "VERIFIED") for b, _ in found], "bill_id string, trip_id string, verdict string"),
        drains=frame([(b, "1") for b in bills], "bill_id string, drain_id string"),
        summary=frame([(b, len(found)) for b in bills], "bill_id string, n int"),
        gaps=frame([(b, 0) for b in bills], "bill_id string, trips_without_slip int"),
    )


def test_findings_that_are_gone_leave_the_table(spark, tmp_path):
    path = str(tmp_path / "verdicts")
    tables.write_verdicts(audited(spark, ["1", "2"], [("1", "R1"), ("1", "R5"), ("2", "R7")]), path)
    tables.write_verdicts(audited(spark, ["1"], []), path)
    left = lambda name: sorted(str(r.bill_id) for r in tables.read_verdicts(spark, path, name).collect())
    assert left("findings") == ["2"] and left("trips") == ["2"]
    assert left("drains") == left("summary") == left("gaps") == ["1", "2"]
    assert tables.read_verdicts(spark, path, "findings", "1").collect() == []
    assert [r.rule for r in tables.read_verdicts(spark, path, "findings", "2").collect()] == ["R7"]
    assert tables.read_verdicts(spark, path, "findings", "of no run").collect() == []


def test_a_run_without_its_list_shows_nowhere(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "verdicts")
    tables.write_verdicts(audited(spark, ["1"], [("1", "R1")]), path)
    whole = runs._write

    def broken(df, target, kind):
        if "/manifest/" in target:
            raise OSError("lost")
        whole(df, target, kind)

    monkeypatch.setattr(runs, "_write", broken)
    try:
        tables.write_verdicts(audited(spark, ["1"], [("1", "R2"), ("1", "R3")]), path)
    except OSError:
        pass
    assert [r.rule for r in tables.read_verdicts(spark, path, "findings").collect()] == ["R1"]


def test_files_follow_the_data_not_tasks_times_bills(spark, tmp_path):
    bills = spark.range(200).select(F.col("id").cast("string").alias("bill_id"))
    rows = spark.range(0, 20_000, 1, 40).select((F.col("id") % 200).cast("string").alias("bill_id"), "id")
    runs.publish({"rows": rows}, bills, str(tmp_path / "runs"), buckets=8)
    files = list((tmp_path / "runs" / "rows").rglob("*.parquet"))
    assert len(files) <= 2 * 8
    assert runs.read(spark, str(tmp_path / "runs"), "rows").count() == 20_000


def test_one_bill_opens_one_bucket_of_one_run(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = spark.range(1000).select((F.col("id") % 50).cast("string").alias("bill_id"), "id")
    for _ in range(2):
        runs.publish({"rows": rows}, rows, path, buckets=8)
    one = runs.read(spark, path, "rows", "7")
    assert sorted(r.id for r in one.collect()) == list(range(7, 1000, 50))
    opened = filters(one)
    assert len(opened) == 1 and "run#" in opened[0] and runs.latest(spark, path).first().run in opened[0] and "bucket#" in opened[0]


def test_exports_of_two_bills_leave_both(spark, tmp_path):
    case = golden_case(spark)
    path = str(tmp_path / "documents")
    first = case.bills.first().bill_id
    other = dataclasses.replace(
        case, **{f.name: df.withColumn("bill_id", F.lit("OTHER")) for f in dataclasses.fields(case) if "bill_id" in (df := getattr(case, f.name)).columns}
    )
    for c in (case, other):
        tables.export_cases(bill.evaluate(c), path)
    for name in ("bills", "drains", "trips", "photos", "findings"):
        n = {r.bill_id: r.n for r in runs.read(spark, path, name).groupBy("bill_id").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert set(n) == {first, "OTHER"} and n[first] == n["OTHER"], name
    head = runs.read(spark, path, "bills", first).first()
    want = bill.missing_evidence(case).first()
    assert head.missing_evidence.asDict() == {k: v for k, v in want.asDict().items() if k != "bill_id"}
    text = next((tmp_path / "documents" / "bills").rglob("part-*.json")).read_text().splitlines()[0]
    assert json.loads(text)["status"] == "VERIFIED"


def test_some_bills_open_their_buckets_of_all_nine_tables(spark, tmp_path):
    case = golden_case(spark)
    root = str(tmp_path / "evidence")
    tables.save_case(case, root, buckets=8)
    bill_id = case.bills.first().bill_id
    bucket = spark.range(1).select(runs.bucket_of(F.lit(bill_id), 8)).first()[0]
    touched = case.bills.select("bill_id")
    for part in (tables.load_case(spark, root, bill_id), tables.load_case(spark, root, touched=touched)):
        for f in dataclasses.fields(part):
            opened = filters(getattr(part, f.name))
            assert opened and all("bucket#" in x or "run#" in x for x in opened[:1]) and any(f" {bucket})" in x for x in opened), f.name
    whole = tables.load_case(spark, root)
    want = sorted(map(str, bill.evaluate(case).trips.collect()))
    for part in (whole, tables.load_case(spark, root, touched=touched)):
        got = bill.evaluate(part)
        assert sorted(map(str, got.trips.collect())) == want
        assert got.gaps.collect() == bill.missing_evidence(case).collect()
    assert tables.load_case(spark, root, "of no bill").bills.collect() == []


def test_a_bill_without_drains_has_a_summary_of_zeros(spark):
    bills = spark.createDataFrame([("1", 1800, "VERIFIED", 40), ("2", 1800, "PENDING", None)], "bill_id string, rate_per_tonne int, status string, claimed_tonnes int")
    drains = spark.createDataFrame([], "bill_id string, claimed_tonnes int, verified_tonnes int, review_tonnes int, held_tonnes int, verdict string, decision string")
    got = {r.bill_id: r for r in rollup.bill_summary(drains, bills).collect()}
    assert (got["1"].claimed_tonnes, got["1"].claimed_rupees, got["1"].held_tonnes, got["1"].drain_count) == (40, 72_000, 0, 0)
    assert (got["2"].claimed_tonnes, got["2"].green, got["2"].decided) == (0, 0, 0)
