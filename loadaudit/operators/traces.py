"""Vehicle traces: long tables of fixes, one row per point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clock, geo
from .ordered import neighbours, numbered

GAP_BUCKET_US = 6 * 3_600_000_000
STEP_BLOCK = 4096
TRACE_KEYS = ("bill_id", "trace_key")


def with_times(points: DataFrame) -> DataFrame:
    """Adds ``wall_us, offset_min, epoch_us`` from ``t`` (ISO text or a timestamp).
    Points that already carry them pass through."""
    if "epoch_us" in points.columns:
        return points
    if isinstance(points.schema["t"].dataType, T.StringType):
        parsed = points.withColumn("_at", clock.iso_parts(F.col("t")))
        return parsed.select(*points.columns, "_at.*")
    # Typed columns need no text parsing: the wall clock is the stored value.
    t = F.col("t")
    at = clock.wall_us(t) if isinstance(points.schema["t"].dataType, T.TimestampNTZType) else F.unix_micros(t)
    return points.select(
        "*", at.alias("wall_us"), F.lit(None).cast("int").alias("offset_min"), at.alias("epoch_us")
    )


def points_in_site(points: DataFrame, sites: DataFrame, key: str = "bill_id") -> DataFrame:
    """Adds ``inside``. ``sites`` has one ``geofence`` per ``key`` value; a point
    without a site is outside."""
    fences = sites.select(
        key, F.col("geofence").alias("_fence"), geo.geometry_bbox(F.col("geofence")).alias("_box")
    )
    hit = geo.in_fence(F.col("lon"), F.col("lat"), F.col("_fence"), F.col("_box"))
    return points.join(fences, key, "left").select(
        *points.columns, F.coalesce(hit, F.lit(False)).alias("inside")
    )


def _at(prefix: str, by: Column, which) -> list[Column]:
    """Position and time of the extreme point, as primitive columns so the
    aggregation stays a hash aggregation."""
    return [
        which(F.col(c), by).alias(f"{prefix}_{c}") for c in ("lon", "lat", "wall_us", "offset_min", "epoch_us")
    ]


def _merge(prefix: str, by: str, which) -> list[Column]:
    return [
        which(F.col(f"{prefix}_{c}"), F.col(by)).alias(f"{prefix}_{c}")
        for c in ("lon", "lat", "wall_us", "offset_min", "epoch_us")
    ]


def trace_facts(points: DataFrame, keys=TRACE_KEYS, gap_bucket_us: int = GAP_BUCKET_US) -> DataFrame:
    """One row per trace: size, first and last fix in file order, first fix inside
    the site, arrival (that fix, else the last one) and the largest gap in time
    order. One shuffle of the points; a hot trace is spread over its time buckets."""
    keys = list(keys)
    timed = with_times(points)
    if "inside" not in timed.columns:
        timed = timed.withColumn("inside", F.lit(False))
    # Fixes without a time are spread by their place, in buckets below all others.
    untimed = F.lit(-(1 << 50)).cast("bigint") - F.floor(F.col("seq") / F.lit(STEP_BLOCK))
    timed = timed.withColumn("_bucket", F.coalesce(F.floor(F.col("epoch_us") / F.lit(gap_bucket_us)), untimed))
    # An earlier join may have dealt the points by bill alone, which the window would accept.
    timed = timed.repartition(*keys, "_bucket")

    in_bucket = Window.partitionBy(*keys, "_bucket").orderBy("epoch_us")
    gap = F.col("epoch_us") - F.lag("epoch_us").over(in_bucket)
    inside_seq = F.when(F.col("inside"), F.col("seq"))
    per_bucket = (
        timed.withColumn("_gap", gap)
        .withColumn("_inside_seq", inside_seq)
        .groupBy(*keys, "_bucket")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("epoch_us").alias("n_timed"),
            F.min("seq").alias("first_seq"),
            F.max("seq").alias("last_seq"),
            F.min("_inside_seq").alias("inside_seq"),
            F.min("epoch_us").alias("_lo"),
            F.max("epoch_us").alias("_hi"),
            F.max("_gap").alias("_gap"),
            *_at("first", F.col("seq"), F.min_by),
            *_at("last", F.col("seq"), F.max_by),
            *_at("inside", F.col("_inside_seq"), F.min_by),
        )
    )
    across = Window.partitionBy(*keys).orderBy(F.col("_lo").asc_nulls_first())
    facts = (
        per_bucket.withColumn("_bridge", F.col("_lo") - F.lag("_hi").over(across))
        .groupBy(*keys)
        .agg(
            F.sum("n").alias("n_points"),
            F.sum("n_timed").alias("n_timed"),
            F.max(F.greatest("_gap", "_bridge")).alias("_gap_us"),
            *_merge("first", "first_seq", F.min_by),
            *_merge("last", "last_seq", F.max_by),
            *_merge("inside", "inside_seq", F.min_by),
            F.min("inside_seq").alias("inside_seq"),
        )
    )
    entered = F.col("inside_seq").isNotNull()

    def time_of(prefix):
        parts = F.struct(
            F.col(f"{prefix}_wall_us").alias("wall_us"),
            F.col(f"{prefix}_offset_min").alias("offset_min"),
            F.col(f"{prefix}_epoch_us").alias("epoch_us"),
        )
        return F.when(F.col(f"{prefix}_wall_us").isNotNull(), parts)

    return facts.select(
        *keys,
        "n_points",
        "n_timed",
        (F.col("_gap_us") / F.lit(1_000_000.0)).alias("max_gap_s"),
        geo.pt(F.col("first_lon"), F.col("first_lat")).alias("first_point"),
        geo.pt(F.col("last_lon"), F.col("last_lat")).alias("last_point"),
        time_of("first").alias("departure"),
        time_of("last").alias("last_fix"),
        entered.alias("entered"),
        F.when(entered, time_of("inside")).otherwise(time_of("last")).alias("arrival"),
    )


def trace_quality(points: DataFrame, keys=TRACE_KEYS, block: int = STEP_BLOCK) -> DataFrame:
    """One row per trace over its consecutive fixes in file order: distance, repeated
    positions, fastest step (steps without elapsed time ignored) and the first point
    whose time runs backwards. Split into blocks of ``block`` points."""
    keys = list(keys)
    timed = with_times(points).withColumn("_block", F.floor(F.col("seq") / F.lit(block))).repartition(*keys, "_block")
    inside = Window.partitionBy(*keys, "_block").orderBy("seq")
    carried = ("seq", "lon", "lat", "epoch_us")
    local = timed.select(*keys, "_block", *carried, *[F.lag(c).over(inside).alias(f"p_{c}") for c in carried])
    per_block = local.transform(_step_columns).groupBy(*keys, "_block").agg(
        *_step_aggregates(),
        F.count(F.lit(1)).alias("n_points"),
        *[F.min_by(c, "seq").alias(f"a_{c}") for c in carried],
        *[F.max_by(c, "seq").alias(f"z_{c}") for c in carried],
    )
    across = Window.partitionBy(*keys).orderBy("_block")
    bridged = per_block.select(
        *keys,
        *[F.col(c).alias(f"in_{c}") for c in ("distance_m", "repeats", "max_kmh", "backwards_seq")],
        "n_points",
        *[F.col(f"a_{c}").alias(c) for c in carried],
        *[F.lag(f"z_{c}").over(across).alias(f"p_{c}") for c in carried],
    ).transform(_step_columns)
    return bridged.groupBy(*keys).agg(
        F.sum("n_points").alias("n_points"),
        F.sum(F.coalesce(F.col("step_m"), F.lit(0.0)) + F.col("in_distance_m")).alias("distance_m"),
        F.sum(F.coalesce(F.col("repeat"), F.lit(0)) + F.col("in_repeats")).alias("repeats"),
        F.coalesce(F.max(F.greatest("kmh", "in_max_kmh")), F.lit(0.0)).alias("max_kmh"),
        F.min(F.least("back_seq", "in_backwards_seq")).alias("backwards_seq"),
    )


def _step_columns(df: DataFrame) -> DataFrame:
    seconds = (F.col("epoch_us") - F.col("p_epoch_us")) / F.lit(1_000_000.0)
    return (
        df.withColumn("step_m", geo.haversine_m(F.col("p_lon"), F.col("p_lat"), F.col("lon"), F.col("lat")))
        .withColumn("repeat", (F.col("step_m") == 0).cast("bigint"))
        .withColumn("kmh", F.when(seconds > 0, F.col("step_m") / seconds * 3.6))
        .withColumn("back_seq", F.when(seconds < 0, F.col("seq")))
    )


def _step_aggregates() -> list[Column]:
    return [
        F.coalesce(F.sum("step_m"), F.lit(0.0)).alias("distance_m"),
        F.coalesce(F.sum("repeat"), F.lit(0)).alias("repeats"),
        F.max("kmh").alias("max_kmh"),
        F.min("back_seq").alias("backwards_seq"),
    ]


def block_summary(points: DataFrame, keys=TRACE_KEYS, block: int = STEP_BLOCK) -> DataFrame:
    """All that is known of a trace from its fixes in file order, in one exchange of the
    points: n_points, n_timed, naive and aware (times without and with an offset), first and
    last (seq, lon, lat, at), distance_m, repeats, max_kmh, max_gap_s, the box, back (seq, now and
    before of the first fix whose time runs backwards) and bad (stage, seq and error of the first
    fault, if the points carry ``stage`` and ``error``).

    Each block of ``block`` points becomes one row; what lies between two blocks follows from
    the last fix of one and the first of the next. Rows of blocks combine in any grouping, so a
    hot trace is spread over its blocks, and only one row a block meets by trace."""
    keys = list(keys)
    timed = with_times(points)
    at = F.struct("wall_us", "offset_min", "epoch_us")
    fix = F.struct("seq", "lon", "lat", F.when(F.col("epoch_us").isNotNull(), at).alias("at"))
    fault = F.when(F.col("error").isNotNull(), F.struct("stage", "seq", "error")) if "error" in timed.columns else F.lit(None).cast("struct<stage:int,seq:bigint,error:string>")
    cut = timed.select(*keys, F.floor(F.col("seq") / F.lit(block)).alias("_block"), fix.alias("fix"), fault.alias("fault")).repartition(*keys, "_block")

    def steps(df):
        seconds = (F.col("fix.at.epoch_us") - F.col("prev.at.epoch_us")) / F.lit(1_000_000.0)
        metres = geo.haversine_m(F.col("prev.lon"), F.col("prev.lat"), F.col("fix.lon"), F.col("fix.lat"))
        return df.withColumns({"_s": seconds, "_m": metres}).withColumns({
            "_repeat": (F.col("_m") == 0).cast("bigint"),
            "_kmh": F.when(F.col("_s") > 0, F.col("_m") / F.col("_s") * 3.6),
            "_back": F.when(F.col("_s") < 0, F.struct(F.col("fix.seq").alias("seq"), F.col("fix.at").alias("now"), F.col("prev.at").alias("before"))),
        })

    inside = Window.partitionBy(*keys, "_block").orderBy("fix.seq")
    blocks = steps(cut.withColumn("prev", F.lag("fix").over(inside))).groupBy(*keys, "_block").agg(
        F.count(F.lit(1)).alias("n_points"), F.count("fix.at").alias("n_timed"),
        F.count_if(F.col("fix.at").isNotNull() & F.col("fix.at.offset_min").isNull()).alias("naive"),
        F.count_if(F.col("fix.at.offset_min").isNotNull()).alias("aware"),
        F.coalesce(F.sum("_m"), F.lit(0.0)).alias("distance_m"), F.coalesce(F.sum("_repeat"), F.lit(0)).alias("repeats"),
        F.max("_kmh").alias("max_kmh"), F.max("_s").alias("max_gap_s"), F.min("_back").alias("back"), F.min("fault").alias("bad"),
        *[which(f"fix.{c}").alias(f"{name}_{c}") for c in ("lon", "lat") for name, which in (("min", F.min), ("max", F.max))],
        F.min("fix").alias("first"), F.max("fix").alias("last"),
    )
    across = Window.partitionBy(*keys).orderBy("_block")
    joined = steps(blocks.withColumns({"prev": F.lag("last").over(across), "fix": F.col("first")}))
    return joined.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("n_points", "n_timed", "naive", "aware")],
        F.sum(F.coalesce("_m", F.lit(0.0)) + F.col("distance_m")).alias("distance_m"),
        F.sum(F.coalesce("_repeat", F.lit(0)) + F.col("repeats")).alias("repeats"),
        F.coalesce(F.max(F.greatest("max_kmh", "_kmh")), F.lit(0.0)).alias("max_kmh"), F.max(F.greatest("max_gap_s", "_s")).alias("max_gap_s"),
        F.min(F.least("back", "_back")).alias("back"), F.min("bad").alias("bad"),
        *[which(f"{name}_{c}").alias(f"{name}_{c}") for c in ("lon", "lat") for name, which in (("min", F.min), ("max", F.max))],
        F.min("first").alias("first"), F.max("last").alias("last"),
    )


def backwards(points: DataFrame, keys=TRACE_KEYS, block: int = STEP_BLOCK) -> DataFrame:
    """The first offending point of every trace whose times run backwards."""
    found = trace_quality(points, keys, block).where(F.col("backwards_seq").isNotNull())
    return found.select(*keys, "backwards_seq")


def thin_route(points: DataFrame, keys=TRACE_KEYS, limit: int = 60) -> DataFrame:
    """At most ``limit`` points per trace as ``route``. The points to keep are chosen
    row by row, by their place among the trace's points in order of ``seq``, so gaps in
    ``seq`` don't matter and no trace is gathered before it is thin."""
    keys = list(keys)
    sizes = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    placed = numbered(points, keys, ["seq"], F.floor(F.col("seq") / STEP_BLOCK), "_place")
    kept = placed.join(sizes, keys).where(geo.keeps_index(F.col("_place") - 1, F.col("_n"), limit))
    ordered = F.array_sort(F.collect_list(F.struct("seq", geo.pt(F.col("lon"), F.col("lat")).alias("p"))))
    return kept.groupBy(*keys).agg(F.transform(ordered, lambda x: x["p"]).alias("route"))


def points_bbox(points: DataFrame, keys=TRACE_KEYS, margin_m: float = 0.0) -> DataFrame:
    box = points.groupBy(*keys).agg(
        F.min("lon").alias("min_lon"),
        F.min("lat").alias("min_lat"),
        F.max("lon").alias("max_lon"),
        F.max("lat").alias("max_lat"),
        F.avg("lat").alias("_lat"),
    )
    if margin_m:
        dlat = F.lit(margin_m / geo.M_PER_DEG_LAT)
        dlon = F.lit(margin_m) / geo.m_per_deg_lon(F.col("_lat"))
        box = box.select(
            *keys,
            F.round(F.col("min_lon") - dlon, 6).alias("min_lon"),
            F.round(F.col("min_lat") - dlat, 6).alias("min_lat"),
            F.round(F.col("max_lon") + dlon, 6).alias("max_lon"),
            F.round(F.col("max_lat") + dlat, 6).alias("max_lat"),
        )
    return box.drop("_lat")


LEG_BUCKET_US = 7 * 86_400_000_000


def timed_legs(legs: DataFrame, keys=("bill_id", "vehicle_no"), id_col: str = "trip_id") -> DataFrame:
    """Legs with a readable start and end: leg_id, start_us, end_us, from_point, to_point."""
    return legs.where(F.col("departure").isNotNull() & F.col("last_fix").isNotNull()).select(
        *keys,
        F.col(id_col).alias("leg_id"),
        F.col("departure.epoch_us").alias("start_us"),
        F.col("last_fix.epoch_us").alias("end_us"),
        F.col("first_point").alias("from_point"),
        F.col("last_point").alias("to_point"),
    )


def truck_legs(legs: DataFrame, keys=("bill_id", "vehicle_no"), id_col: str = "trip_id",
               bucket_us: int = LEG_BUCKET_US) -> DataFrame:
    """Each leg with the one before and after it on the same truck, by start time.

    ``legs`` has ``departure`` and ``last_fix`` times and ``first_point`` and
    ``last_point``; legs without a readable start or end drop out. Adds
    ``before`` and ``after`` structs: the other leg, minutes and km between, and
    the speed needed (infinite for an overlap)."""
    near = neighbours(
        timed_legs(legs, keys, id_col),
        list(keys),
        ["start_us", "leg_id"],
        F.floor(F.col("start_us") / F.lit(bucket_us)),
        ["leg_id", "start_us", "end_us", "from_point", "to_point"],
    )
    here = F.struct("leg_id", "start_us", "end_us", "from_point", "to_point")
    return near.select(
        *keys,
        "leg_id",
        between(F.col("prev"), here, F.col("prev")).alias("before"),
        between(here, F.col("next"), F.col("next")).alias("after"),
    )


def between(first: Column, second: Column, other: Column) -> Column:
    minutes = (second["start_us"] - first["end_us"]) / F.lit(60_000_000.0)
    km = geo.metres_between(first["to_point"], second["from_point"]) / 1000
    speed = F.when(minutes <= 0, F.lit(float("inf"))).otherwise(km / (minutes / 60))
    pair = F.struct(
        other["leg_id"].alias("other"), minutes.alias("minutes"), km.alias("km"), speed.alias("kmh")
    )
    return F.when(other.isNotNull(), pair)

