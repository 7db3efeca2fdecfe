"""Trace files. One row per file comes in, one row per fix goes out; a file is
parsed once, as a VARIANT, and never fails the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.binding import let
from ..functions.clock import iso_text
from ..functions.coerce import kind_of as _kind
from ..functions.rounding import round_half_even
from ..operators import traces as ops
from ..operators.traces import TRACE_KEYS

MIN_POINTS, MAX_POINTS = 2, 20_000
JUMP_KMH = 150.0

# The reasons a trace is refused and the remarks it may carry.
REASONS = {
    "json": "the file is not valid UTF-8 JSON",
    "collection": "a GeoJSON FeatureCollection must hold exactly one trace",
    "geometry": "the GeoJSON geometry must be a LineString",
    "coordinates": "the LineString has no coordinates",
    "times": "GeoJSON traces need properties.times with one timestamp per coordinate",
    "unknown": 'unrecognised trace format: use {"points": [{"lat", "lon", "t"}]} or a GeoJSON LineString Feature '
    "with properties.times",
    "pair": "point %s is not [longitude, latitude]",
    "object": "point %s must be an object with lat, lon and t",
    "few": "a trace needs at least 2 points",
    "many": "a trace can have at most 20,000 points",
    "number": "point %s %s is missing or not a number",
    "range": "point %s %s %s is out of range",
    "zero": "point %s is [0, 0], which is not a real fix",
    "no_time": "point %s has no timestamp",
    "bad_time": "point %s timestamp is not ISO 8601",
    "mixed": "timestamps mix timezone offsets with times that have none",
    "backwards": "timestamps go backwards at point %s (%s after %s)",
}
REMARKS = {
    "local": "Timestamps carry no timezone offset; they are compared as local times.",
    "repeats": "%s consecutive point(s) repeat the previous position.",
    "jump": "One step implies %s km/h, faster than a loaded truck; the trace may contain a bad fix.",
}


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _is_array(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


# ----------------------------------------------------------- lenient (bill)
def parse_traces(files: DataFrame, content: str = "content", keep: tuple[str, ...] = ("trace_key",)) -> DataFrame:
    """Points of trace texts in file order, ``seq`` from 0 over the kept ones. Accepts
    ``{points}``, ``{Points}`` or a bare list, of objects or ``[lon, lat, t?]``."""

    def point(p):
        as_object = F.struct(
            _get(p, "$.lat", "double").alias("lat"),
            _get(p, "$.lon", "double").alias("lon"),
            F.coalesce(F.nullif(_get(p, "$.t", "string"), F.lit("")), _get(p, "$.timestamp", "string")).alias("t"),
        )
        as_list = F.struct(
            _get(p, "$[1]", "double").alias("lat"), _get(p, "$[0]", "double").alias("lon"), _get(p, "$[2]", "string").alias("t")
        )
        return F.when(_is_object(p), as_object).when(_is_array(p), as_list)

    def listed(v):
        filled = F.filter(
            F.array(_get(v, "$.points", "array<variant>"), _get(v, "$.Points", "array<variant>")), lambda a: F.size(a) > 0
        )
        return F.when(_is_array(v), v.cast("array<variant>")).otherwise(F.get(filled, F.lit(0)))

    raw = let(F.try_parse_json(F.col(content)), listed)
    points = F.filter(F.transform(raw, point), lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())
    long = files.select(*keep, F.posexplode(points).alias("seq", "p"))
    return long.select(*keep, F.col("seq").cast("bigint").alias("seq"), "p.lat", "p.lon", "p.t")


def trace_problems(files: DataFrame, content: str = "content", key: str = "trace_key") -> DataFrame:
    """One row per file: vehicle, point count and what was wrong with it."""
    counted = parse_traces(files, content, (key,)).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    parsed = F.try_parse_json(F.col(content))
    read = files.select(key, parsed.isNull().alias("bad"), _get(parsed, "$.vehicleNo", "string").alias("vehicle_no"))
    n = F.coalesce("n", F.lit(0))
    problems = F.array_compact(
        F.array(F.when(F.col("bad"), F.lit("unparseable_trace")), F.when(n == 0, F.lit("no_points")))
    )
    return read.join(counted, key, "left").select(key, "vehicle_no", n.alias("point_count"), problems.alias("problems"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as ``trace_key`` and ``content``."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.regexp_extract(F.input_file_name(), r"((?:traces/.*)|[^/]+)$", 1).alias("trace_key"), F.col("value").alias("content")
    )


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    return parse_traces(read_texts(spark, path))


# ------------------------------------------------------------ strict (case)
def strict_headers(files: DataFrame, content: str = "content", keep: tuple[str, ...] = ("trace_key",)) -> DataFrame:
    """Per file: format, vehicle, raw points and the reason its format is refused."""

    def feature_of(v):
        members = _get(v, "$.features", "array<variant>")
        single = F.when(F.size(members) == 1, F.get(members, F.lit(0)))
        return F.when(_get(v, "$.type", "string") == "FeatureCollection", single).when(
            _get(v, "$.type", "string") == "Feature", v
        )

    def number(v, path):
        at = _get(v, path, "variant")
        return F.when(_kind(at) == "number", _get(v, path, "double"))

    def label(v, path):
        at = _get(v, path, "variant")
        return F.when(_kind(at) == "text", _get(v, path, "string"))

    def raw(lon, lat, t, shaped):
        return F.struct(lon.alias("lon"), lat.alias("lat"), t.alias("t"), shaped.alias("shaped"))

    def from_feature(f):
        coordinates = _get(f, "$.geometry.coordinates", "array<variant>")
        times = F.coalesce(
            F.when(F.size(_get(f, "$.properties.times", "array<variant>")) > 0, _get(f, "$.properties.times", "array<variant>")),
            _get(f, "$.properties.coordTimes", "array<variant>"),
        )
        zipped = F.zip_with(
            coordinates, times,
            lambda c, t: raw(
                number(c, "$[0]"), number(c, "$[1]"), F.when(_kind(t) == "text", _get(t, "$", "string")),
                _is_array(c) & (F.size(c.try_cast("array<variant>")) >= 2),
            ),
        )
        reason = (
            F.when(f.isNull(), F.lit(REASONS["collection"]))
            .when(F.coalesce(_get(f, "$.geometry.type", "string"), F.lit("")) != "LineString", F.lit(REASONS["geometry"]))
            .when(coordinates.isNull(), F.lit(REASONS["coordinates"]))
            .when(F.coalesce(F.size(times), F.lit(-1)) != F.size(coordinates), F.lit(REASONS["times"]))
        )
        return _header(F.lit("geojson"), label(f, "$.properties.vehicleNo"), F.when(reason.isNull(), zipped), reason)

    def from_points(v):
        points = F.transform(
            _get(v, "$.points", "array<variant>"),
            lambda p: raw(
                number(p, "$.lon"), number(p, "$.lat"), F.coalesce(label(p, "$.t"), label(p, "$.timestamp")), _is_object(p)
            ),
        )
        return _header(F.lit("points"), label(v, "$.vehicleNo"), points, F.lit(None).cast("string"))

    def whole(v):
        nothing = F.lit(None)
        is_geojson = F.coalesce(_get(v, "$.type", "string").isin("Feature", "FeatureCollection"), F.lit(False))
        failed = _header(
            nothing.cast("string"), nothing.cast("string"), nothing.cast(_RAW_DDL),
            F.when(v.isNull(), F.lit(REASONS["json"])).otherwise(F.lit(REASONS["unknown"])),
        )
        return (
            F.when(is_geojson, let(feature_of(v), from_feature))
            .when(_get(v, "$.points", "array<variant>").isNotNull(), from_points(v))
            .otherwise(failed)
        )

    clean = F.regexp_replace(F.col(content), "^﻿", "")
    return files.select(*keep, let(F.try_parse_json(clean), whole).alias("_h")).select(*keep, "_h.*")


_RAW_DDL = "array<struct<lon:double,lat:double,t:string,shaped:boolean>>"


def _header(fmt, vehicle, points, reason) -> Column:
    return F.struct(
        fmt.alias("format"), text.norm_vehicle(vehicle).alias("vehicle_no"), points.cast(_RAW_DDL).alias("raw"), reason.alias("reason")
    )


def strict_points(headers: DataFrame, keep: tuple[str, ...] = ("trace_key",)) -> DataFrame:
    """Raw points of accepted formats, one row each."""
    long = headers.where(F.col("reason").isNull()).select(*keep, "format", F.posexplode("raw").alias("seq", "p"))
    return long.select(*keep, "format", F.col("seq").cast("bigint").alias("seq"), "p.*")


def _say(name: str, *values: Column) -> Column:
    return F.format_string(REASONS[name], *values)


def _coordinate_error(value: Column, name: str, bound: int, place: Column) -> Column:
    return F.when(value.isNull(), _say("number", place, F.lit(name))).when(
        F.isnan(value) | (F.abs(value) > bound), _say("range", place, F.lit(name), text.general(value))
    )


def point_errors(points: DataFrame) -> DataFrame:
    """Adds ``error``: what refuses this point, null when nothing does. A point's shape
    is checked first (over the whole file), then its values."""
    place = (F.col("seq") + 1).cast("string")
    shape = F.when(F.col("format") == "geojson", _say("pair", place)).otherwise(_say("object", place))
    value = F.coalesce(
        _coordinate_error(F.col("lon"), "longitude", 180, place),
        _coordinate_error(F.col("lat"), "latitude", 90, place),
        F.when((F.col("lon") == 0) & (F.col("lat") == 0), _say("zero", place)),
        F.when(F.coalesce(text.strip(F.col("t")), F.lit("")) == "", _say("no_time", place)),
        F.when(F.col("epoch_us").isNull(), _say("bad_time", place)),
    )
    shaped = F.coalesce("shaped", F.lit(True))
    return points.withColumns(
        {"stage": F.when(~shaped, F.lit(0)).otherwise(F.lit(1)), "error": F.when(~shaped, shape).otherwise(value)}
    )


def validate_traces(points: DataFrame, keys=TRACE_KEYS, block: int = ops.STEP_BLOCK) -> tuple[DataFrame, DataFrame]:
    """(points of accepted traces with times, ``keys`` and the first reason of the rest).

    ``points`` has format, seq (0-based, dense), lon, lat, t and optionally shaped.
    Reasons rank: a point's shape, the point count, the first bad value, mixed
    offsets, time running backwards."""
    keys = list(keys)
    if "shaped" not in points.columns:
        points = points.withColumn("shaped", F.lit(True))
    if "format" not in points.columns:
        points = points.withColumn("format", F.lit("points"))
    timed = ops.with_times(points.withColumn("t", text.strip(F.col("t"))))
    judged = ops.block_summary(point_errors(timed), keys, block)

    bad, stage, back = F.col("bad.error"), F.col("bad.stage"), F.col("back")
    reason = (
        F.when(stage == 0, bad)
        .when(F.col("n_points") < MIN_POINTS, F.lit(REASONS["few"]))
        .when(F.col("n_points") > MAX_POINTS, F.lit(REASONS["many"]))
        .when(stage == 1, bad)
        .when((F.col("naive") > 0) & (F.col("aware") > 0), F.lit(REASONS["mixed"]))
        .when(
            back.isNotNull(),
            _say("backwards", (back["seq"] + 1).cast("string"), iso_text(back["now"]), iso_text(back["before"])),
        )
    )
    verdicts = judged.select(*keys, reason.alias("reason"))
    accepted = timed.join(verdicts.where(F.col("reason").isNull()).select(*keys), keys, "left_semi")
    return accepted.drop("shaped"), verdicts.where(F.col("reason").isNotNull())


def read_geojson_traces(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(points, refused files) of strict trace files."""
    headers = strict_headers(read_texts(spark, path))
    good, bad = validate_traces(strict_points(headers), ("trace_key",))
    refused = headers.where(F.col("reason").isNotNull()).select("trace_key", "reason").unionByName(bad)
    return good, refused


def trace_summary(points: DataFrame, keys=TRACE_KEYS, route_limit: int | None = 300, block: int = ops.STEP_BLOCK) -> DataFrame:
    """Per accepted trace: size, start, end, distance, top speed, gap, box, remarks and
    the thinned route."""
    keys = list(keys)
    joined = ops.block_summary(points, keys, block)
    joined = joined.withColumns({"departure": F.col("first.at"), "last_fix": F.col("last.at")})
    jump = F.col("max_kmh")
    remarks = F.array_compact(
        F.array(
            F.when(F.col("departure.offset_min").isNull(), F.lit(REMARKS["local"])),
            F.when(F.col("repeats") > 0, F.format_string(REMARKS["repeats"], F.col("repeats").cast("string"))),
            F.when(jump > JUMP_KMH, F.format_string(REMARKS["jump"], text.fixed0(jump))),
        )
    )
    out = joined.select(
        *keys, "n_points", iso_text(F.col("departure")).alias("start_time"), iso_text(F.col("last_fix")).alias("end_time"),
        round_half_even(F.col("distance_m"), 1).alias("distance_m"), round_half_even(jump, 1).alias("max_kmh"),
        round_half_even(F.col("max_gap_s"), 1).alias("max_gap_s"), "min_lon", "min_lat", "max_lon", "max_lat",
        remarks.alias("warnings"),
    )
    return out if route_limit is None else out.join(ops.thin_route(points, keys, route_limit), keys)
