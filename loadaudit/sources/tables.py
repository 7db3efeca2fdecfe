"""The evidence tables on disk: assembly, loading, ingest control, sinks."""

from __future__ import annotations

import json
from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..functions import geo, money
from ..functions.rounding import round_half_even
from ..operators import traces
from ..plans import wording
from ..plans.bill import Audit, BillCase
from . import runs


# --------------------------------------------------------------- assembly
def plausible_max(length_m: Column, width_m: Column, depth_m: Column) -> Column:
    return round_half_even(length_m * width_m * depth_m * wording.SILT_DENSITY * wording.HEADROOM, 1)


def assemble_bill(features: DataFrame, trips: DataFrame, header: DataFrame) -> dict[str, DataFrame]:
    """Bill and drain tables from drain features, trips and a header per bill
    (bill_id, contractor, ward, rate_per_tonne, window_start, window_end, site_id):
    claimed tonnes and rupees by drain and by bill, and the plausible maximum."""
    claimed = trips.groupBy("bill_id", "drain_id").agg(F.sum("claimed_tonnes").cast(money.TONNES).alias("claimed_tonnes"))
    drains = (
        features.join(claimed, ["bill_id", "drain_id"], "left")
        .join(header.select("bill_id", "rate_per_tonne"), "bill_id")
        .withColumn("claimed_tonnes", F.coalesce("claimed_tonnes", F.lit(0)).cast(money.TONNES))
        .withColumns(
            {
                "claimed_rupees": money.rupees(F.col("claimed_tonnes"), F.col("rate_per_tonne")),
                "plausible_max_tonnes": plausible_max(F.col("length_m"), F.col("width_m"), F.col("depth_m")),
            }
        )
        .drop("rate_per_tonne")
    )
    totals = drains.groupBy("bill_id").agg(F.sum("claimed_tonnes").cast(money.TONNES).alias("claimed_tonnes"))
    bills = header.join(totals, "bill_id").withColumns(
        {"claimed_rupees": money.rupees(F.col("claimed_tonnes"), F.col("rate_per_tonne")), "status": F.lit("PENDING")}
    )
    return {"bills": bills, "drains": drains, "trips": trips}


# ----------------------------------------------------------------- loading
#: Where the whole registries lie; their other buckets hold what the bucket's bills refer to.
WHOLE = -1


def _of_bills(case: BillCase) -> dict[str, DataFrame]:
    """Every evidence table with the bill that its rows belong to. A slip, trace item,
    vehicle or site occurs once for each bill that refers to it."""
    trips = case.trips

    def owned(table, key, owners, name):
        if "bill_id" in table.columns:
            return table
        pairs = owners.select("bill_id", F.col(name).alias(key)).where(F.col(key).isNotNull()).distinct()
        return table.join(pairs, key, "left")

    return {
        **{f.name: getattr(case, f.name) for f in fields(BillCase)},
        "slips": owned(case.slips, "s3_key", trips, "slip_key"),
        "trace_items": owned(case.trace_items, "s3_key", trips, "trace_key"),
        "vehicles": owned(case.vehicles, "vehicle_no", trips, "vehicle_no").where(F.col("bill_id").isNotNull()),
        "sites": owned(case.sites, "site_id", case.bills, "site_id").where(F.col("bill_id").isNotNull()),
    }


def save_case(case: BillCase, root: str, buckets: int = runs.BUCKETS) -> None:
    """The nine evidence tables as Parquet, dealt to ``buckets`` by the hash of their bill, so
    that the work on a few bills opens a few buckets of every table. Registries (vehicles,
    sites) lie there whole, and once more by the bills that refer to them."""
    whole, layout = {"vehicles": case.vehicles, "sites": case.sites}, []
    for name, frame in _of_bills(case).items():
        dealt = frame.withColumn("bucket", runs.bucket_of(F.col("bill_id"), buckets))
        if name in whole:
            dealt = dealt.dropDuplicates(["bucket", dealt.columns[0]]).drop("bill_id")
            dealt = dealt.unionByName(whole[name].withColumn("bucket", F.lit(WHOLE)))
        runs.spread(dealt).write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/{name}")
        layout.append((name, dealt.drop("bucket").schema.json(), buckets))
    spark = case.bills.sparkSession
    spark.createDataFrame(layout, "name string, fields string, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{root}/layout")


def load_case(spark: SparkSession, root: str, bill_id=None, touched: DataFrame | None = None) -> BillCase:
    """Every evidence table, of all bills, of one, or of the ``touched`` ones (bill_id). Of one
    or some bills only their buckets are opened, of each of the nine tables; their numbers, at
    most as many as there are buckets, are all that the driver sees."""
    layout = spark.read.parquet(f"{root}/layout").collect()  # one row a table
    schemas_ = {r.name: StructType.fromJson(json.loads(r.fields)).add("bucket", IntegerType()) for r in layout}
    frames = {name: spark.read.schema(schema).parquet(f"{root}/{name}") for name, schema in schemas_.items()}
    registries = ("vehicles", "sites")
    if bill_id is None and touched is None:
        return BillCase(**{n: (df.where(F.col("bucket") == WHOLE) if n in registries else df).drop("bucket") for n, df in frames.items()})
    buckets = layout[0].buckets
    if touched is None:
        where = F.col("bucket") == runs.bucket_of(F.lit(str(bill_id)), buckets)
        return BillCase(**{n: df.where(where).drop("bucket") for n, df in frames.items()}).only(bill_id)
    numbers = touched.select(runs.bucket_of(F.col("bill_id"), buckets).alias("b")).distinct().collect()
    where = F.col("bucket").isin([r.b for r in numbers])
    cut = {n: df.where(where).drop("bucket") for n, df in frames.items()}
    some = {n: df.join(touched.select("bill_id"), "bill_id", "left_semi") if "bill_id" in df.columns else df.dropDuplicates([df.columns[0]]) for n, df in cut.items()}
    return BillCase(**some)


# ---------------------------------------------------------- ingest control
def new_objects(incoming: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """Objects to process: those without a successful item of the same content tag."""
    if force:
        return incoming
    done = state.where(F.col("status") == "OK").select("key", "etag")
    return incoming.join(done, ["key", "etag"], "left_anti")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the highest version per key; on a tie the update wins. A maximum, not
    a window, so the copies of a hot key are reduced before they are shuffled."""
    both = target.withColumn("_from", F.lit(0)).unionByName(updates.withColumn("_from", F.lit(1)))
    rest = [c for c in target.columns if c not in keys]
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "_from")).alias("_row"))
    return newest.select(*keys, "_row.*").select(*target.columns)


ERROR_MAX = 900


def split_failures(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows without an error, ERROR rows with the message cut, counts by outcome).
    ``df`` may name an ``outcome`` (skipped, ignored); a row is else processed or failed."""
    failed = F.col(error).isNotNull()
    named = F.col("outcome") if "outcome" in df.columns else F.lit(None).cast("string")
    outcome = F.when(failed, F.lit("failed")).otherwise(F.coalesce(named, F.lit("processed")))
    ok = df.where(~failed).drop(error)
    errors = df.where(failed).withColumns({error: F.substring(error, 1, ERROR_MAX), "status": F.lit("ERROR")})
    return ok, errors, df.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------- sinks
def write_verdicts(audit: Audit, path: str) -> str:
    """Findings, trips, drains, summaries and gaps of the audited bills, published as a run:
    they replace those bills and no others, and what a bill no longer has is gone."""
    found = {"findings": audit.findings, "trips": audit.trips, "drains": audit.drains, "summary": audit.summary, "gaps": audit.gaps}
    return runs.publish(found, audit.case.bills, path)


def read_verdicts(spark: SparkSession, path: str, name: str, bill_id=None) -> DataFrame:
    """One of the tables of ``write_verdicts``, of all bills or of one."""
    return runs.read(spark, path, name, bill_id)


def case_documents(audit: Audit, route_limit: int = 60) -> dict[str, DataFrame]:
    """Documents of a bill, its drains and all that belongs to a drain: ``bills`` (header, totals and
    what is missing), ``drains`` (row, claimed route and the numbers of trips, photos and
    findings), ``trips`` (with slip, thinned route, length and own findings), ``photos`` and
    ``findings``. The layout is the same for a drain of any size: no document grows
    with the number of others."""
    case = audit.case
    keys = ["bill_id", "drain_id"]
    routes = traces.thin_route(traces.with_times(case.points), limit=route_limit)
    lengths = traces.trace_quality(case.points).select("bill_id", "trace_key", round_half_even(F.col("distance_m"), 1).alias("distance_m"))
    slip_bill = [c for c in case.slips.columns if c == "bill_id"]
    slips = case.slips.select(*slip_bill, F.col("s3_key").alias("slip_key"), F.struct(*[c for c in case.slips.columns if c != "bill_id"]).alias("slip"))
    own = audit.trip_findings.groupBy(*keys, "trip_id").agg(
        # At most two findings per rule, so a trip's list is short.
        F.array_sort(F.collect_list(F.struct("pos", "rule", "severity", "message"))).alias("findings")
    )
    trips = (
        case.trips.join(audit.trips.select(*keys, "trip_id", "verdict", "hard_fails", "soft_fails"), [*keys, "trip_id"], "left")
        .join(slips, [*slip_bill, "slip_key"], "left")
        .join(routes, ["bill_id", "trace_key"], "left")
        .join(lengths, ["bill_id", "trace_key"], "left")
        .join(own, [*keys, "trip_id"], "left")
    ).select(
        *keys, "trip_no", "trip_id", "vehicle_no", "claimed_tonnes", "verdict", "hard_fails", "soft_fails", "slip", "route", "distance_m", "findings"
    )
    photos = case.photos.select(*keys, "role", "s3_key", "status", "lat", "lon", "timestamp", "p_hash")
    found = audit.drain_findings.select(*keys, "rule", "severity", "message")
    drains = audit.drains.join(claimed_route(case), keys, "left")
    for name, df in (("n_trips", case.trips), ("n_photos", case.photos), ("n_findings", found)):
        drains = drains.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), keys, "left")
    drains = drains.na.fill(0, ["n_trips", "n_photos", "n_findings"])
    header = case.bills.select("bill_id", "contractor", "ward", "window_start", "window_end", "site_id") if "contractor" in case.bills.columns else case.bills.select("bill_id")
    gaps = audit.gaps.select("bill_id", F.struct(*[c for c in audit.gaps.columns if c != "bill_id"]).alias("missing_evidence"))
    bills = header.join(audit.summary, "bill_id").join(gaps, "bill_id", "left").withColumn("status", F.lit("VERIFIED"))
    return {"bills": bills, "drains": drains, "trips": trips, "photos": photos, "findings": found}


def claimed_route(case: BillCase) -> DataFrame:
    """What the bill implies a truck drove: the drain's centroid to the site's centre."""
    from ..plans.bill import bill_sites

    sites = bill_sites(case.bills, case.sites).select("bill_id", "center")
    outer = F.get(F.get("geofence", F.lit(0)), F.lit(0))
    origin = geo.ring_centroid(outer)
    end = geo.pt(F.round("center.lon", 7), F.round("center.lat", 7))
    return (
        case.drains.join(sites, "bill_id")
        .select("bill_id", "drain_id", origin.alias("_from"), end.alias("_to"))
        .where(F.col("_from").isNotNull() & F.col("_to.lon").isNotNull())
        .select("bill_id", "drain_id", F.array("_from", "_to").alias("claimed_route"))
    )


def export_cases(audit: Audit, path: str) -> str:
    """The documents of the audited bills as JSON, published as a run: an export of one bill
    leaves all others."""
    return runs.publish(case_documents(audit), audit.case.bills, path, kind="json")
