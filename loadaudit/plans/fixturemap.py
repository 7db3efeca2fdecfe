"""The model's tables as plain deterministic views over a TPC-H-like star schema
with events and embeddings. Thresholds are parameters because that data is not
shaped like the domain."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, money, text
from .bill import BillCase, Limits

BLOCK_DAYS = 3
#: Rows that a parsing task gets at most.
TASK_ROWS = 100_000
FIXTURE_LIMITS = Limits(soft_band_m=600.0, speed_kmh=1.0, slip_minutes=120.0, gap_s=12 * 3600.0, reuse_bits=20)


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def box(lon: Column, lat: Column, half: float) -> Column:
    """A square geometry around a point."""
    corners = [(-half, -half), (half, -half), (half, half), (-half, half)]
    return F.array(F.array(F.array(*[geo.pt(lon + dx, lat + dy) for dx, dy in corners])))


class Fixture:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def dealt(self, df: DataFrame, *keys: str) -> DataFrame:
        """Rows of a table that is one small file, for parsers that deserve every core. A task
        gets no more than ``TASK_ROWS``, however large the table; Parquet counts its rows by itself.
        Dealt by ``keys``, about as many, and a join on them needs no second shuffle."""
        return df.repartition(max(self.spark.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS)), *keys)

    # ------------------------------------------------------------- the ledger
    @cached_property
    def bills(self) -> DataFrame:
        key = F.col("n_nationkey")
        return self.table("nation").select(
            key.cast("string").alias("bill_id"),
            (F.lit(1800) + key * 10).cast(money.TONNES).alias("rate_per_tonne"),
            F.lit(None).cast(money.TONNES).alias("claimed_tonnes"),
            F.lit("1996-01-01T00:00:00+05:30").alias("window_start"),
            F.lit("2000-12-31T00:00:00+05:30").alias("window_end"),
            F.when(key % 2 == 0, F.lit("VERIFIED")).otherwise(F.lit("PENDING")).alias("status"),
            F.when(key != 24, F.lit("D1")).alias("site_id"),
        )

    @cached_property
    def supplier_drains(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.table("supplier").select(
            F.col("s_nationkey").cast("string").alias("bill_id"),
            key.cast("string").alias("drain_id"),
            F.col("s_name").alias("name"),
            (F.lit(400) + key % 400 * 8).cast("double").alias("length_m"),
            (F.lit(1.2) + (key % 5) * 0.5).alias("width_m"),
            (F.lit(0.8) + (key % 3) * 0.4).alias("depth_m"),
            F.lit(None).cast("double").alias("plausible_max_tonnes"),
            F.when(key % 4 == 0, F.lit("APPROVE")).when(key % 4 == 1, F.lit("HOLD")).alias("decision"),
            F.lit(None).cast("string").alias("note"),
        )

    @cached_property
    def _loads(self) -> DataFrame:
        trip = _text(
            F.col("l_orderkey"), "-", F.col("l_linenumber"), "-", F.col("l_partkey"), "-", F.col("l_suppkey"), "-",
            F.date_format("l_shipdate", "yyyyMMdd"),
        )
        return self.table("lineitem").withColumn("trip_id", trip)

    @cached_property
    def supplier_trips(self) -> DataFrame:
        owners = self.table("supplier").select(
            F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("string").alias("bill_id")
        )
        return self._loads.join(owners, "l_suppkey").select(
            "bill_id",
            F.col("l_suppkey").cast("string").alias("drain_id"),
            F.col("l_linenumber").cast("string").alias("trip_no"),
            "trip_id",
            F.col("l_partkey").cast("string").alias("vehicle_no"),
            F.col("l_quantity").cast(money.TONNES).alias("claimed_tonnes"),
            F.col("trip_id").alias("slip_key"),
        )

    def _printed(self, loads: DataFrame) -> DataFrame:
        """Printed weights: tonnes or kilograms by parity, zeros misread on every third key."""
        whole = F.col("l_quantity").cast("int")
        printed = F.when(F.col("l_orderkey") % 2 == 0, _text(whole, " T")).otherwise(_text(whole * 1000, " kg"))
        misread = F.when(F.col("l_orderkey") % 3 == 0, F.translate(printed, "0", "O")).otherwise(printed)
        return loads.withColumn("raw_net", F.when(F.col("l_tax") != 0, misread))

    @cached_property
    def weight_texts(self) -> DataFrame:
        return self._printed(self.dealt(self._loads))

    @cached_property
    def weighed_slips(self) -> DataFrame:
        """Slips are joined by their key, so they are dealt by it."""
        wrong = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)
        return self._printed(self.dealt(self._loads, "trip_id")).where(F.col("l_linenumber") != 7).select(
            F.col("trip_id").alias("s3_key"),
            F.when(F.col("l_linenumber") == 6, F.lit("ERROR")).otherwise(F.lit("OK")).alias("status"),
            F.lit(None).cast("string").alias("error"),
            (F.col("l_partkey") + F.when(wrong, 1).otherwise(0)).cast("string").alias("vehicle_no"),
            text.parse_weight_t(F.col("raw_net")).alias("net"),
        )

    @cached_property
    def part_vehicles(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").cast("string").alias("vehicle_no"), F.col("p_size").cast("double").alias("capacity_tonnes")
        )

    # ------------------------------------------------------------- the traces
    @cached_property
    def points(self) -> DataFrame:
        """A fix per event; a trace is one user's three-day block."""
        block = F.floor(F.datediff("ts", F.lit("2024-01-01")) / BLOCK_DAYS)
        return self.table("events").select(
            (F.col("user_id") % 25).cast("string").alias("bill_id"),
            _text(F.col("user_id"), "-", block).alias("trace_key"),
            F.col("event_id").alias("seq"),
            (F.lit(19.00) + F.col("value") / 5000).alias("lat"),
            (F.lit(72.80) + F.get_json_object("props", "$.k").cast("double") / 1000).alias("lon"),
            F.col("ts").alias("t"),
            "user_id",
        )

    @cached_property
    def sites(self) -> DataFrame:
        one = self.table("region").where(F.col("r_regionkey") == 0)
        lon, lat = F.lit(72.85), F.lit(19.005)
        ring = geo.line_literal([(72.845, 19.0), (72.855, 19.0), (72.855, 19.01), (72.845, 19.01)])
        return one.select(
            F.lit("D1").alias("site_id"), F.array(F.array(ring)).alias("geofence"), geo.pt(lon, lat).alias("center")
        )

    @cached_property
    def trace_trips(self) -> DataFrame:
        """One trip per trace: the user is the truck, seven drains per bill."""
        user = F.col("user_id")
        return (
            self.points.groupBy("bill_id", "trace_key", "user_id")
            .agg(F.count(F.lit(1)).alias("_n"))
            .select(
                "bill_id",
                (user % 7).cast("string").alias("drain_id"),
                F.col("trace_key").alias("trip_no"),
                F.col("trace_key").alias("trip_id"),
                user.cast("string").alias("vehicle_no"),
                (F.lit(5) + F.col("_n")).cast(money.TONNES).alias("claimed_tonnes"),
                F.col("trace_key").alias("slip_key"),
                "trace_key",
            )
        )

    @cached_property
    def trace_slips(self) -> DataFrame:
        """A slip per trace, stamped at the trace's first fix; some absent or unread."""
        user = F.col("user_id")
        return (
            self.points.groupBy("trace_key", "user_id")
            .agg(F.min("t").alias("_first"), F.count(F.lit(1)).alias("_n"))
            .where(user % 11 != 0)
            .select(
                F.col("trace_key").alias("s3_key"),
                F.when(user % 13 == 0, F.lit("ERROR")).otherwise(F.lit("OK")).alias("status"),
                F.lit(None).cast("string").alias("error"),
                F.when(user % 17 != 0, (user + F.when(F.col("_n") % 9 == 0, 1).otherwise(0)).cast("string")).alias(
                    "vehicle_no"
                ),
                F.when(F.col("_n") % 8 != 0, (F.lit(5) + F.col("_n")).cast("double")).alias("net"),
                F.when(user % 19 != 0, F.date_format("_first", "HH:mm")).alias("time_in"),
                F.array().cast("array<string>").alias("missing_fields"),
            )
        )

    @cached_property
    def trace_items(self) -> DataFrame:
        return self.trace_trips.select(
            F.col("trace_key").alias("s3_key"), F.lit("OK").alias("status"), F.lit(None).cast("string").alias("error")
        )

    @cached_property
    def user_vehicles(self) -> DataFrame:
        users = self.table("events").select("user_id").distinct()
        return users.where(F.col("user_id") % 10 != 0).select(
            F.col("user_id").cast("string").alias("vehicle_no"),
            (F.lit(8) + F.col("user_id") % 15).cast("double").alias("capacity_tonnes"),
        )

    # ------------------------------------------------------------- the photos
    @cached_property
    def photos(self) -> DataFrame:
        """A photo per embedding: its hash is the sign of each dimension."""
        bits = F.array_join(F.transform("embedding", lambda x: F.when(x > 0, F.lit("1")).otherwise(F.lit("0"))), "")

        def word(start):
            return F.lpad(F.lower(F.conv(F.substring("_bits", start, 32), 2, 16)), 8, "0")

        v = F.col("vec_id")
        role = F.when(v % 3 == 0, F.lit("before")).when(v % 3 == 1, F.lit("after")).otherwise(F.lit("load"))
        taken = F.date_format(F.date_add(F.lit("1995-06-01").cast("date"), (v % 2300).cast("int")), "yyyy-MM-dd")
        vision = F.struct(
            (v % 13 != 0).alias("ok"),
            (v % 4 != 0).alias("cleared"),
            F.when(F.floor(v / 3) % 3 == 0, F.lit("silt")).when(F.floor(v / 3) % 3 == 1, F.lit("debris"))
            .otherwise(F.lit("unclear")).alias("load_type"),
            ((v % 100) / 100).alias("confidence"),
            F.lit(None).cast("string").alias("notes"),
        )
        return self.table("embeddings").withColumn("_bits", bits).select(
            F.col("label").cast("string").alias("bill_id"),
            (v % 7).cast("string").alias("drain_id"),
            _text("photos/", F.col("label"), "/drain", v % 7, "/", role, "-", v, ".jpg").alias("s3_key"),
            role.alias("role"),
            F.when(v % 29 == 0, F.lit("ERROR")).otherwise(F.lit("OK")).alias("status"),
            F.lit(None).cast("string").alias("error"),
            (v % 5 != 0).alias("has_gps"),
            F.when(v % 5 != 0, F.lit(72.80) + (v % 7) * 0.01 + (v % 41) * 0.0002).alias("lon"),
            F.when(v % 5 != 0, F.lit(19.003) + (v % 23) * 0.0003).alias("lat"),
            F.when(v % 11 != 0, F.concat(taken, F.lit("T10:00:00+05:30"))).alias("timestamp"),
            F.concat(word(1), word(33)).alias("p_hash"),
            F.array().cast("array<string>").alias("problems"),
            vision.alias("vision"),
            v.alias("vec_id"),
        )

    @cached_property
    def ward_drains(self) -> DataFrame:
        """Seven drains for each nation's bill, with geofence and centreline."""
        d = F.col("_d")
        lon, lat = F.lit(72.80) + d * 0.01, F.lit(19.003)
        return (
            self.table("nation")
            .select(F.col("n_nationkey").cast("string").alias("bill_id"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("_d"))
            .select(
                "bill_id",
                d.cast("string").alias("drain_id"),
                _text("Drain ", d).alias("name"),
                F.lit(100.0).alias("length_m"),
                F.when(d != 6, F.lit(2.0)).alias("width_m"),
                (F.lit(0.5) + d * 0.5).alias("depth_m"),
                F.when(d == 5, F.lit(250.0)).alias("plausible_max_tonnes"),
                box(lon, lat, 0.003).alias("geofence"),
                F.array(geo.pt(lon, lat), geo.pt(lon + 0.002, lat + 0.001)).alias("centreline"),
                F.when(d == 1, F.lit("APPROVE")).when(d == 2, F.lit("HOLD")).alias("decision"),
                F.lit(None).cast("string").alias("note"),
            )
        )

    @cached_property
    def case(self) -> BillCase:
        """Traces, slips and photos of the same bills and drains."""
        return BillCase(
            bills=self.bills, drains=self.ward_drains, trips=self.trace_trips, photos=self.photos,
            slips=self.trace_slips, trace_items=self.trace_items, points=self.points,
            vehicles=self.user_vehicles, sites=self.sites,
        )

    # ---------------------------------------------------------------- cases
    @cached_property
    def case_rows(self) -> DataFrame:
        """A case per customer; each detail is absent for some of them."""
        from .. import schemas

        c = F.col("c_custkey")
        lon, lat = F.lit(72.80) + (c % 50) / 1000, F.lit(19.00) + (c % 30) / 5000
        none = F.lit(None)
        drain = F.struct(
            geo.pt(lon, lat).alias("point"),
            F.when(c % 8 == 1, F.array(geo.pt(lon, lat), geo.pt(lon + 0.01, lat + 0.002))).alias("line"),
            (F.lit(30.0) + c % 3 * 700).alias("tolerance_m"),
            F.lit("manual_point").alias("source"),
            (c % 9 == 0).alias("derived_from_photos"),
            none.cast("string").alias("name"),
            (F.lit(10.0) + c % 50).alias("length_m"),
            F.when(c % 6 != 0, F.lit(2.0)).alias("width_m"),
            F.lit(1.5).alias("depth_m"),
        )
        ring = geo.line_literal([(72.845, 19.0), (72.855, 19.0), (72.855, 19.01), (72.845, 19.01), (72.845, 19.0)])
        site = F.struct(
            geo.pt(72.85, 19.005).alias("point"), F.lit(600.0).alias("radius_m"),
            F.when(c % 3 == 1, ring).alias("polygon"), none.cast("string").alias("name"),
        )
        quantity = F.when(c % 7 != 0, F.lit(20.0) + c % 200)
        claim = F.struct(
            quantity.alias("quantity_tonnes"),
            F.when(c % 5 != 0, F.lit(1800.0)).alias("rate_per_tonne"),
            F.when(c % 6 != 0, (F.lit(20.0) + c % 200) * 1800 + c % 4 * 500).alias("amount_rupees"),
            none.cast("string").alias("contractor"), none.cast("string").alias("reference"),
        )
        window = F.struct(F.lit("1996-01-01T00:00:00+05:30").alias("start"), F.lit("2000-12-31T00:00:00+05:30").alias("end"))
        truck = F.struct(
            F.concat(F.lit("wb-"), (c % 50).cast("string")).alias("vehicle_no"),
            F.when(c % 4 == 2, F.lit(8.5) + c % 10).alias("capacity_tonnes"),
        )
        return self.table("customer").select(
            c.cast("string").alias("case_id"),
            F.when(c % 4 != 0, drain).cast(schemas.DRAIN_LOCATION_DDL).alias("drain"),
            F.when(c % 3 != 0, site).cast(schemas.DISPOSAL_SITE_DDL).alias("site"),
            F.when(c % 11 != 0, claim).cast(schemas.CLAIM_DDL).alias("claim"),
            F.when(c % 10 != 0, window).alias("window"),
            F.when(c % 2 == 0, truck).alias("truck"),
        )

    @cached_property
    def case_photos(self) -> DataFrame:
        v = F.col("vec_id")
        vision = F.struct(
            (v % 7 != 0).alias("ran"), (v % 13 != 0).alias("ok"),
            F.when(v % 17 != 0, v % 4 != 0).alias("cleared"), ((v % 100) / 100).alias("confidence"),
            (v % 8 == 0).alias("mocked"), F.when(v % 14 == 0, F.lit("quota")).alias("skipped_reason"),
        )
        stamp = F.when(v % 6 == 0, F.substring("timestamp", 1, 19)).otherwise(F.col("timestamp"))
        return self.photos.select(
            (v % 97).cast("string").alias("case_id"), _text("p", v).alias("evidence_id"),
            F.when(v % 10 != 0, _text("IMG_", v, ".jpg")).alias("filename"), F.lit("photo").alias("grp"),
            F.when(v % 2 == 0, F.lit("after")).otherwise(F.lit("before")).alias("role"), v.cast("int").alias("pos"),
            "has_gps", "lon", "lat", stamp.alias("timestamp"), (v % 6 != 0).alias("timestamp_has_offset"),
            F.when(v % 4 == 0, (v % 100).cast("double")).alias("gps_accuracy_m"), "p_hash", vision.alias("vision"),
        )

    @cached_property
    def case_slips(self) -> DataFrame:
        o, c = F.col("o_orderkey"), F.col("o_custkey")
        net = F.when(o % 9 != 0, F.round(F.col("o_totalprice") / 20000, 2))
        return self.table("orders").select(
            c.cast("string").alias("case_id"), _text("s", o).alias("evidence_id"),
            F.when(o % 10 != 0, _text("slip-", o, ".png")).alias("filename"), F.lit("slip").alias("grp"), o.cast("int").alias("pos"),
            net.alias("net"),
            F.round(net + 8 + F.when(o % 5 == 0, 0.2).otherwise(0.0), 2).alias("gross"), F.lit(8.0).alias("tare"),
            F.when(o % 19 != 0, F.format_string("%02d:%02d", (o % 24).cast("int"), (c % 60).cast("int"))).alias("time_in"),
            F.when(o % 16 != 0, _text("WB ", c % 50 + F.when(o % 3 == 0, 1).otherwise(0))).alias("vehicle_no"),
            (o % 12 == 0).alias("net_derived"), (o % 10 == 0).alias("mocked"),
        )

    @cached_property
    def case_points(self) -> DataFrame:
        return self.points.select(
            F.col("user_id").cast("string").alias("case_id"), F.col("trace_key").alias("evidence_id"), "seq", "lat", "lon", "t",
        )

    @cached_property
    def case_traces(self) -> DataFrame:
        block = F.split("evidence_id", "-")[1].cast("int")
        user = F.col("case_id").cast("int")
        return self.case_points.select("case_id", "evidence_id").distinct().select(
            "case_id", "evidence_id", F.concat("evidence_id", F.lit(".json")).alias("filename"), F.lit("trace").alias("grp"),
            block.alias("pos"), F.when(block % 4 != 3, _text("WB ", user % 50 + block % 2)).alias("vehicle_no"),
        )

    @cached_property
    def case_tables(self):
        from .case import CaseTables

        return CaseTables(self.case_rows, self.case_photos, self.case_slips, self.case_traces, self.case_points)
