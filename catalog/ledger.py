"""The bill ledger: loads as trips, suppliers as drains, nations as bills."""

from pyspark.sql import functions as F

from loadaudit.functions import money
from loadaudit.operators import decisions, findings, rollup
from loadaudit.plans import bill
from loadaudit.plans.fixturemap import Fixture
from loadaudit.plans.wording import HARD, SOFT

from . import sqlviews  # noqa: F401
from .registry import query, view

KEYS = ["bill_id", "drain_id"]


def judged(fx):
    slips = fx.weighed_slips
    slip = slips.select(
        F.col("s3_key").alias("slip_key"), F.lit(True).alias("slip_found"), F.col("status").alias("slip_status"),
        F.col("error").alias("slip_error"), F.col("vehicle_no").alias("slip_vehicle_no"), F.col("net").alias("slip_net"),
        F.lit(None).cast("array<string>").alias("slip_missing_fields"),
    )
    return bill.with_capacity(fx.supplier_trips.join(slip, "slip_key", "left"), fx.part_vehicles)


def slip_cases():
    return bill.slip_gap_cases() + bill.r7_cases() + bill.r9_cases()


def said(df, cases, keep):
    return findings.explode_findings(df, cases, keep).select(*keep, "rule", "severity", "message")


def ledger_trips(fx):
    """Trips with verdicts: their own slip rules and their drain's volume rule."""
    volume = bill.claimed_drains(fx.supplier_drains, fx.supplier_trips)
    drain_rules = volume.select(*KEYS, findings.rule_ids(bill.volume_cases(), SOFT).alias("drain_soft"))
    joined = judged(fx).join(drain_rules, KEYS)
    own = slip_cases()
    return joined.select(
        *KEYS, "trip_id", "claimed_tonnes",
        findings.rule_ids(own, HARD).alias("hard_fails"),
        F.array_sort(F.array_union(findings.rule_ids(own, SOFT), F.col("drain_soft"))).alias("soft_fails"),
        rollup.verdict(findings.any_case(own, HARD), findings.any_case(own, SOFT) | (F.size("drain_soft") > 0)).alias("verdict"),
    )


def ledger_drains(fx):
    split = rollup.drain_split(ledger_trips(fx))
    return decisions.apply_decision(fx.supplier_drains.select(*KEYS, "name", "decision", "note").join(split, KEYS))


def as_doubles(df, *names):
    return df.withColumns({n: F.col(n).cast("double") for n in names})


SPLIT = ["claimed_tonnes", "verified_tonnes", "review_tonnes", "held_tonnes"]

view("v_sflags", """
SELECT *, found AND status <> 'ERROR' AS usable,
  CASE WHEN NOT found THEN 'SLIP_MISSING' WHEN status = 'ERROR' THEN 'EVIDENCE_ERROR' END AS gap_rule,
  found AND status <> 'ERROR' AND net IS NULL AS r7_soft,
  coalesce(found AND status <> 'ERROR' AND net > capacity, false) AS r7_hard,
  found AND status <> 'ERROR' AND slip_vehicle IS NULL AS r9_soft,
  coalesce(found AND status <> 'ERROR' AND slip_vehicle <> vehicle_no, false) AS r9_hard FROM v_sjudged""")
view("v_svolume", """
SELECT d.*, coalesce(c.claimed, 0) AS drain_claimed, length_m * width_m * depth_m * (1.4::DOUBLE * 1.2::DOUBLE) AS ceiling
FROM v_sdrain d LEFT JOIN (SELECT bill_id, drain_id, sum(claimed) AS claimed FROM v_strip GROUP BY ALL) c USING (bill_id, drain_id)""")
view("v_sverdict", """
SELECT f.*, v.drain_claimed::DOUBLE > v.ceiling AS r10,
  CASE WHEN r7_hard OR r9_hard THEN 'HOLD'
       WHEN gap_rule IS NOT NULL OR r7_soft OR r9_soft OR v.drain_claimed::DOUBLE > v.ceiling THEN 'REVIEW' ELSE 'VERIFIED' END AS verdict
FROM v_sflags f JOIN v_svolume v USING (bill_id, drain_id)""")
view("v_ssplit", """
SELECT bill_id, drain_id, count(*) AS trip_count, sum(claimed) AS claimed,
  coalesce(sum(claimed) FILTER (WHERE verdict = 'VERIFIED'), 0) AS ver, coalesce(sum(claimed) FILTER (WHERE verdict = 'REVIEW'), 0) AS rev,
  coalesce(sum(claimed) FILTER (WHERE verdict = 'HOLD'), 0) AS held,
  CASE WHEN bool_or(verdict = 'HOLD') THEN 'RED' WHEN bool_or(verdict = 'REVIEW') THEN 'AMBER' ELSE 'GREEN' END AS colour
FROM v_sverdict GROUP BY ALL""")
view("v_sdecided", """
SELECT s.*, d.decision, CASE decision WHEN 'APPROVE' THEN ver + rev + held ELSE ver END AS ver2,
  CASE WHEN decision IS NULL THEN rev ELSE 0 END AS rev2,
  CASE decision WHEN 'APPROVE' THEN 0 WHEN 'HOLD' THEN rev + held ELSE held END AS held2
FROM v_ssplit s JOIN v_sdrain d USING (bill_id, drain_id)""")
view("v_ssummary", """
SELECT bill_id, rate, coalesce(sum(claimed), 0) AS c, coalesce(sum(ver2), 0) AS v, coalesce(sum(rev2), 0) AS r, coalesce(sum(held2), 0) AS h, count(drain_id) AS drain_count,
  count(*) FILTER (WHERE colour = 'RED') AS red, count(*) FILTER (WHERE colour = 'AMBER') AS amber,
  count(*) FILTER (WHERE colour = 'GREEN') AS green, count(decision) AS decided
FROM v_bill LEFT JOIN v_sdecided USING (bill_id) GROUP BY ALL""")


@query("bill_ledger", """
SELECT bill_id, c::DOUBLE AS claimed_tonnes, v::DOUBLE AS verified_tonnes, r::DOUBLE AS review_tonnes, h::DOUBLE AS held_tonnes,
  (c * rate)::BIGINT AS claimed_rupees, (v * rate)::BIGINT AS verified_rupees, (r * rate)::BIGINT AS review_rupees,
  (h * rate)::BIGINT AS held_rupees, drain_count, red, amber, green, decided FROM v_ssummary""")
def bill_ledger(spark, d):
    fx = Fixture(spark, d)
    out = rollup.bill_summary(ledger_drains(fx), fx.bills)
    return as_doubles(out, *SPLIT).drop("rate_per_tonne")


@query("join_01_slips", """
SELECT t.bill_id, t.trip_id, found AS slip_found, net, CASE WHEN found THEN status END AS slip_status FROM v_sjudged t""")
def join_01_slips(spark, d):
    """A ledger without traces: slips alone."""
    fx = Fixture(spark, d)
    keyless = fx.supplier_trips.withColumn("trace_key", F.lit(None).cast("string"))
    none = fx.trace_items.limit(0)
    facts = fx.table("region").where("false").select(
        F.lit("").alias("bill_id"), F.lit("").alias("trace_key"), F.lit(0).alias("n_points")
    )
    out = bill.trip_evidence(keyless, fx.weighed_slips.withColumn("time_in", F.lit(None).cast("string")), facts, none)
    return out.select(
        "bill_id", "trip_id", F.coalesce("slip_found", F.lit(False)).alias("slip_found"), F.col("slip_net").alias("net"), "slip_status"
    )


@query("join_02_capacity", "SELECT trip_id, t.vehicle_no, capacity AS capacity_tonnes FROM v_strip t LEFT JOIN v_svehicle USING (vehicle_no)")
def join_02(spark, d):
    fx = Fixture(spark, d)
    return bill.with_capacity(fx.supplier_trips, fx.part_vehicles).select("trip_id", "vehicle_no", "capacity_tonnes")


@query("rule_r7", """
SELECT trip_id, 'R7' AS rule, CASE WHEN r7_soft THEN 'soft' ELSE 'hard' END AS severity,
  CASE WHEN r7_soft THEN 'The slip''s net weight could not be read.'
       ELSE 'The slip claims ' || printf('%.2f', net) || ' t on a truck rated ' || printf('%.0f', capacity) || ' t.' END AS message
FROM v_sflags WHERE r7_soft OR r7_hard""")
def rule_r7(spark, d):
    return said(judged(Fixture(spark, d)), bill.r7_cases(), ["trip_id"])


@query("rule_r9", """
SELECT trip_id, 'R9' AS rule, 'hard' AS severity,
  'The slip is for ' || slip_vehicle || ', but the trip is logged to ' || vehicle_no || '.' AS message FROM v_sflags WHERE r9_hard""")
def rule_r9(spark, d):
    return said(judged(Fixture(spark, d)), bill.r9_cases(), ["trip_id"])


@query("rule_r10", """
SELECT bill_id, drain_id, 'R10' AS rule, 'soft' AS severity, 'The drain claims ' || round_even(drain_claimed::DOUBLE, 0)::BIGINT
  || ' t, more than the ' || round_even(ceiling, 0)::BIGINT || ' t its length, width and depth allow.' AS message
FROM v_svolume WHERE drain_claimed::DOUBLE > ceiling""")
def rule_r10(spark, d):
    fx = Fixture(spark, d)
    return said(bill.claimed_drains(fx.supplier_drains, fx.supplier_trips), bill.volume_cases(), KEYS)


@query("set_01_union_findings", """
SELECT rule, severity, count(*) AS n FROM (
  SELECT gap_rule AS rule, 'soft' AS severity FROM v_sflags WHERE gap_rule IS NOT NULL
  UNION ALL SELECT 'R7', 'soft' FROM v_sflags WHERE r7_soft UNION ALL SELECT 'R7', 'hard' FROM v_sflags WHERE r7_hard
  UNION ALL SELECT 'R9', 'hard' FROM v_sflags WHERE r9_hard
  UNION ALL SELECT 'R10', 'soft' FROM v_svolume WHERE drain_claimed::DOUBLE > ceiling) GROUP BY ALL""")
def set_01(spark, d):
    fx = Fixture(spark, d)
    own = findings.explode_findings(judged(fx), slip_cases(), [*KEYS, "trip_id"])
    volume = findings.explode_findings(bill.claimed_drains(fx.supplier_drains, fx.supplier_trips), bill.volume_cases(), KEYS)
    return findings.union_findings(own, volume).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))


TRIP_SQL = """
SELECT bill_id, trip_id, verdict,
  list_aggregate(list_sort(list_filter([CASE WHEN r7_hard THEN 'R7' END, CASE WHEN r9_hard THEN 'R9' END], lambda x: x IS NOT NULL)), 'string_agg', ',') AS hard_fails,
  list_aggregate(list_sort(list_filter([gap_rule, CASE WHEN r7_soft THEN 'R7' END, CASE WHEN r10 THEN 'R10' END], lambda x: x IS NOT NULL)), 'string_agg', ',') AS soft_fails
FROM v_sverdict"""


@query("agg_01_trip_verdicts", TRIP_SQL)
def agg_01(spark, d):
    """From long findings: the trips' own plus their drain's, fanned out by a join."""
    fx = Fixture(spark, d)
    own = findings.explode_findings(judged(fx), slip_cases(), ["bill_id", "trip_id"])
    volume = findings.explode_findings(bill.claimed_drains(fx.supplier_drains, fx.supplier_trips), bill.volume_cases(), KEYS)
    fanned = fx.supplier_trips.select(*KEYS, "trip_id").join(volume, KEYS[::-1]).drop("drain_id")
    rules = [c.rule for c in slip_cases() + bill.volume_cases()]
    out = rollup.trip_verdicts(findings.union_findings(own, fanned), fx.supplier_trips, rules=rules)
    joined = {c: F.nullif(F.array_join(c, ","), F.lit("")) for c in ("hard_fails", "soft_fails")}
    return out.withColumns(joined).select("bill_id", "trip_id", "verdict", "hard_fails", "soft_fails")


@query("agg_02_drain_split", """
SELECT bill_id, drain_id, trip_count, claimed::DOUBLE AS claimed_tonnes, ver::DOUBLE AS evidence_verified, rev::DOUBLE AS evidence_review,
  held::DOUBLE AS evidence_held, colour AS verdict FROM v_ssplit""")
def agg_02(spark, d):
    out = rollup.drain_split(ledger_trips(Fixture(spark, d)))
    return as_doubles(out, "claimed_tonnes", "evidence_verified", "evidence_review", "evidence_held")


@query("agg_03_drain_colour", "SELECT bill_id, drain_id, colour FROM v_ssplit")
def agg_03(spark, d):
    return rollup.drain_colour(ledger_trips(Fixture(spark, d)))


@query("agg_04_bill_summary", """
SELECT b.bill_id, (CASE WHEN status = 'VERIFIED' THEN 5000.5 ELSE coalesce(c, 0) END)::DOUBLE AS claimed_tonnes,
  round_even((CASE WHEN status = 'VERIFIED' THEN 5000.5 ELSE coalesce(c, 0) END) * b.rate, 0)::BIGINT AS claimed_rupees,
  coalesce(h, 0)::DOUBLE AS held_tonnes, (coalesce(h, 0) * b.rate)::BIGINT AS held_rupees, coalesce(red, 0) AS red, coalesce(amber, 0) AS amber,
  coalesce(green, 0) AS green, coalesce(decided, 0) AS decided FROM v_bill b LEFT JOIN v_ssummary s USING (bill_id)""")
def agg_04(spark, d):
    """Verified bills carry their own claim, which replaces the sum."""
    fx = Fixture(spark, d)
    billed = fx.bills.withColumn("claimed_tonnes", F.when(F.col("status") == "VERIFIED", F.lit(5000.5)).cast(money.TONNES))
    out = as_doubles(rollup.bill_summary(ledger_drains(fx), billed), "claimed_tonnes", "held_tonnes")
    return out.select("bill_id", "claimed_tonnes", "claimed_rupees", "held_tonnes", "held_rupees", "red", "amber", "green", "decided")


@query("agg_12_ledger_shares", """
SELECT bill_id, coalesce(round(v * 100.0::DOUBLE / c::DOUBLE, 6), 0) AS verified_pct, coalesce(round(r * 100.0::DOUBLE / c::DOUBLE, 6), 0) AS review_pct,
  coalesce(round(h * 100.0::DOUBLE / c::DOUBLE, 6), 0) AS held_pct FROM v_bill LEFT JOIN v_ssummary USING (bill_id)""")
def agg_12(spark, d):
    fx = Fixture(spark, d)
    out = rollup.ledger_shares(rollup.bill_summary(ledger_drains(fx), fx.bills))
    return out.select("bill_id", *[F.round(f"{s}_pct", 6).alias(f"{s}_pct") for s in ("verified", "review", "held")])


@query("flt_03_pending_view", """
SELECT bill_id, drain_id, CASE WHEN status = 'VERIFIED' THEN colour END AS verdict, CASE WHEN status = 'VERIFIED' THEN decision END AS decision,
  (CASE WHEN status = 'VERIFIED' THEN ver2 ELSE 0 END)::DOUBLE AS verified_tonnes, (CASE WHEN status = 'VERIFIED' THEN 0 ELSE claimed END)::DOUBLE AS pending_tonnes
FROM v_sdecided JOIN v_bill USING (bill_id)""")
def flt_03(spark, d):
    fx = Fixture(spark, d)
    out = as_doubles(rollup.pending_view(ledger_drains(fx), fx.bills), "verified_tonnes", "pending_tonnes")
    return out.select(*KEYS, "verdict", "decision", "verified_tonnes", "pending_tonnes")


@query("dec_01_apply_decision", """
SELECT bill_id, drain_id, decision, ver2::DOUBLE AS verified_tonnes, rev2::DOUBLE AS review_tonnes, held2::DOUBLE AS held_tonnes FROM v_sdecided""")
def dec_01(spark, d):
    out = as_doubles(ledger_drains(Fixture(spark, d)), *SPLIT)
    return out.select(*KEYS, "decision", "verified_tonnes", "review_tonnes", "held_tonnes")


def decision_log(fx):
    """Orders as rulings on a supplier's drain; some name a drain that does not exist."""
    owners = fx.table("supplier").select(
        F.col("s_suppkey").cast("string").alias("drain_id"), F.col("s_nationkey").cast("string").alias("bill_id")
    )
    kind = F.when(F.col("o_orderstatus") == "F", F.lit("approve")).when(F.col("o_orderstatus") == "O", F.lit("HOLD")).otherwise(F.lit("WAIT"))
    log = fx.table("orders").select(
        (F.col("o_custkey") % 120).cast("string").alias("drain_id"), kind.alias("decision"),
        F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" ")).alias("note"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at"), F.col("o_orderkey").alias("n"),
    )
    return log.join(owners, "drain_id", "left")


view("v_dlog", """
SELECT (o_custkey % 120)::VARCHAR AS drain_id, upper(CASE o_orderstatus WHEN 'F' THEN 'approve' WHEN 'O' THEN 'HOLD' ELSE 'WAIT' END) AS kind,
  trim(o_orderpriority) AS note, o_orderdate, o_orderkey, d.bill_id
FROM orders LEFT JOIN v_sdrain d ON d.drain_id = (o_custkey % 120)::VARCHAR""")


@query("dec_02_merge_decisions", """
SELECT bill_id, drain_id, decision, note FROM (SELECT bill_id, drain_id, kind AS decision, note,
  row_number() OVER (PARTITION BY drain_id ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM v_dlog WHERE bill_id IS NOT NULL AND kind IN ('APPROVE', 'HOLD')) WHERE rn = 1""")
def dec_02(spark, d):
    fx = Fixture(spark, d)
    drains = fx.supplier_drains.withColumn("verdict", F.lit("GREEN"))
    latest, _ = decisions.merge_decisions(decision_log(fx), drains, ["at", "n"])
    return latest.select(*KEYS, "decision", "note")


@query("dec_02_rejects", """
SELECT CASE WHEN kind NOT IN ('APPROVE', 'HOLD') THEN 'decision must be one of APPROVE, HOLD' ELSE 'no such drain on this bill' END AS reject, count(*) AS n
FROM v_dlog WHERE bill_id IS NULL OR kind NOT IN ('APPROVE', 'HOLD') GROUP BY ALL""")
def dec_02_rejects(spark, d):
    fx = Fixture(spark, d)
    _, rejects = decisions.merge_decisions(decision_log(fx), fx.supplier_drains.withColumn("verdict", F.lit("GREEN")), ["at", "n"])
    return rejects.groupBy("reject").agg(F.count(F.lit(1)).alias("n"))


@query("dec_03_preview", """
SELECT s.bill_id, m.moved::DOUBLE AS moved_tonnes, (m.moved * s.rate)::BIGINT AS moved_rupees, (v + moved_all)::DOUBLE AS verified_tonnes,
  (h - h_moved)::DOUBLE AS held_tonnes
FROM v_ssummary s JOIN (SELECT bill_id, sum(rev2 + held2) AS moved, sum(rev2 + held2) AS moved_all, sum(held2) AS h_moved FROM v_sdecided GROUP BY ALL) m USING (bill_id)""")
def dec_03(spark, d):
    fx = Fixture(spark, d)
    out = decisions.preview_decision(ledger_drains(fx), fx.bills, None, "APPROVE")
    return as_doubles(out, "moved_tonnes", "verified_tonnes", "held_tonnes").select(
        "bill_id", "moved_tonnes", "moved_rupees", "verified_tonnes", "held_tonnes"
    )


@query("ord_01_register", """
SELECT bill_id, drain_id, row_number() OVER (PARTITION BY bill_id ORDER BY drain_id::INT) - 1 AS place FROM v_sdrain""")
def ord_01(spark, d):
    """Register order within each bill, made visible as a place."""
    from pyspark.sql import Window

    fx = Fixture(spark, d)
    inside = Window.partitionBy("bill_id").orderBy(*rollup.drain_order())
    return rollup.register_view(fx.supplier_drains).select(
        *KEYS, (F.row_number().over(inside) - 1).cast("bigint").alias("place")
    )
