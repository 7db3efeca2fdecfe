"""Geometry files: drain and site collections, mapped ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.rounding import round_half_even

FEATURES_DDL = (
    "struct<features:array<struct<geometry:struct<type:string,coordinates:string>,properties:struct<drainId:string,"
    "dumpsiteId:string,name:string,lengthM:double,widthM:double,depthM:double,plausibleMaxTonnes:double,"
    "claimedTonnes:double,centreline:array<array<double>>,center:array<double>>>>>"
)
WAYS_DDL = (
    "struct<elements:array<struct<type:string,id:bigint,geometry:array<struct<lat:double,lon:double>>,tags:map<string,string>>>>"
)

# Way classes.
MAJOR_ROADS = ["motorway", "trunk", "primary", "secondary", "motorway_link", "trunk_link"]
MINOR_ROADS = ["tertiary", "residential", "unclassified", "living_street", "tertiary_link"]
MIN_ROAD_M = 40.0
SECTION_MAX_M = 600.0
#: Sections that a task sorts, about.
SORTED_ROWS = 250_000


def _point(p: Column) -> Column:
    return geo.pt(F.get(p, F.lit(0)), F.get(p, F.lit(1)))


def parse_features(files: DataFrame, content: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per feature, geometry as polygons of rings; null for another geometry type."""
    long = files.select(*keep, F.explode(F.from_json(F.col(content), FEATURES_DDL)["features"]).alias("f"))
    g = F.col("f.geometry")
    polygon = F.from_json(g["coordinates"], "array<array<array<double>>>")
    multi = F.from_json(g["coordinates"], "array<array<array<array<double>>>>")
    rings = F.when(g["type"] == "Polygon", F.array(polygon)).when(g["type"] == "MultiPolygon", multi)
    shape = F.transform(rings, lambda poly: F.transform(poly, lambda ring: F.transform(ring, _point)))
    p = F.col("f.properties")
    return long.select(
        *keep,
        p["drainId"].alias("drain_id"),
        p["dumpsiteId"].alias("site_id"),
        p["name"].alias("name"),
        p["lengthM"].alias("length_m"),
        p["widthM"].alias("width_m"),
        p["depthM"].alias("depth_m"),
        p["plausibleMaxTonnes"].alias("plausible_max_tonnes"),
        p["claimedTonnes"].alias("claimed_tonnes"),
        shape.alias("geofence"),
        F.transform(p["centreline"], _point).alias("centreline"),
        F.when(p["center"].isNotNull(), _point(p["center"])).alias("center"),
    )


def read_features(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).withColumnRenamed("value", "content")
    return parse_features(files).orderBy(F.coalesce(F.col("drain_id").try_cast("int"), F.lit(0)))


def parse_ways(files: DataFrame, content: str = "content") -> DataFrame:
    """Ways with at least two valid vertices: id, tags, line and rounded length."""
    elements = F.explode(F.from_json(F.col(content), WAYS_DDL)["elements"]).alias("e")
    valid = F.filter("e.geometry", lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())
    line = F.transform(valid, lambda p: geo.pt(p["lon"], p["lat"]))
    ways = files.select(elements).where(F.col("e.type") == "way")
    ways = ways.select(F.col("e.id").alias("osm_id"), F.col("e.tags").alias("tags"), line.alias("line"))
    ways = ways.where(F.size("line") >= 2)
    return ways.withColumn("raw_length_m", geo.line_length_m(F.col("line"))).withColumn(
        "length_m", round_half_even(F.col("raw_length_m"), 1)
    )


def osm_lines(ways: DataFrame) -> DataFrame:
    """Named polylines, longest first."""
    return ways.select(
        "osm_id", F.try_element_at("tags", F.lit("name")).alias("name"), F.try_element_at("tags", F.lit("waterway")).alias("waterway"),
        "line", "length_m",
    ).orderBy(F.desc("length_m"))


def read_osm_lines(spark: SparkSession, path: str) -> DataFrame:
    return osm_lines(parse_ways(spark.read.text(path, wholetext=True).withColumnRenamed("value", "content")))


def classify_ways(ways: DataFrame) -> DataFrame:
    """Roads (major, minor) and water (body, line); other ways and road stubs drop out,
    closed bodies become polygons."""

    def tag(name):
        return F.coalesce(F.try_element_at("tags", F.lit(name)), F.lit(""))

    highway = tag("highway")
    body = (tag("natural") == "water") | tag("landuse").isin("reservoir", "basin")
    label = (
        F.when(highway.isin(MAJOR_ROADS), F.lit("road major"))
        .when(highway.isin(MINOR_ROADS), F.lit("road minor"))
        .when(body, F.lit("water body"))
        .when(tag("waterway").isin("river", "canal"), F.lit("water line"))
    )
    closed = (F.get("line", F.lit(0)) == F.get("line", F.size("line") - 1)) & (F.size("line") > 3)
    rows = ways.withColumn("_label", label).where(F.col("_label").isNotNull())
    kept = rows.where(~F.col("_label").startswith("road") | (F.col("raw_length_m") >= MIN_ROAD_M))
    shape = F.when((F.col("_label") == "water body") & closed, F.lit("Polygon")).otherwise(F.lit("LineString"))
    parts = F.split("_label", " ")
    return kept.select(
        "osm_id", F.get(parts, F.lit(0)).alias("kind"), F.get(parts, F.lit(1)).alias("class"), shape.alias("shape"), "line"
    )


def split_lines(lines: DataFrame, max_m: float = SECTION_MAX_M) -> DataFrame:
    """Long lines cut into sections of evenly divided vertices that share one vertex.
    Short lines stay whole with a null section. Longest first: ranges of lengths, as many as a
    count of the sections asks for, each sorted by a task of its own. Sections of one length,
    most of a regular network, are dealt to several ranges by a digest of their row."""
    pieces = F.greatest(F.lit(1), F.ceil(F.col("length_m") / max_m).cast("int"))
    n = F.size("line")
    total = lines.agg(F.sum(pieces.cast("bigint"))).first()[0] or 0
    # Rows are cut by explode; a piece is a slice of its own line.
    cut = lines.withColumn("_pieces", pieces).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)))
    start = F.floor(F.col("_i") * n / F.col("_pieces")).cast("int")
    end = F.least(n, F.floor((F.col("_i") + 1) * n / F.col("_pieces")).cast("int") + 1)
    whole = F.col("_pieces") == 1
    piece = F.when(whole, F.col("line")).otherwise(F.slice("line", start + 1, F.greatest(end - start, F.lit(0))))
    out = cut.withColumn("_line", piece).where(whole | (F.size("_line") >= 2))
    length = F.when(whole, F.col("length_m")).otherwise(round_half_even(geo.line_length_m(F.col("_line")), 1))
    out = out.select(
        *[c for c in lines.columns if c not in ("line", "length_m")], F.col("_line").alias("line"), length.alias("length_m"),
        F.when(~whole, F.col("_i") + 1).alias("section"),
    )
    digest = F.xxhash64(*[F.col(f.name) for f in out.schema if "map<" not in f.dataType.simpleString()])
    return out.repartitionByRange(max(1, -(-total // SORTED_ROWS)), F.desc("length_m"), digest).sortWithinPartitions(F.desc("length_m"))
