"""Geometry columns. A point is ``struct<lon,lat>``, a line an array of points,
a ring a line (open or closed), a geometry ``array<polygon>`` where a polygon is
``array<ring>`` with the outer ring first."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

# Metres per degree of latitude and the earth's radius in metres.
M_PER_DEG_LAT = 111_320.0
EARTH_RADIUS_M = 6_371_000.0

POINT_DDL = "struct<lon:double,lat:double>"
LINE_DDL = f"array<{POINT_DDL}>"
GEOMETRY_DDL = f"array<array<array<{POINT_DDL}>>>"


def pt(lon, lat) -> Column:
    lon = lon if isinstance(lon, Column) else F.lit(float(lon))
    lat = lat if isinstance(lat, Column) else F.lit(float(lat))
    return F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat"))


def line_literal(points) -> Column:
    """A fixed line from ``[(lon, lat), ...]``."""
    return F.array(*[pt(lon, lat) for lon, lat in points])


def m_per_deg_lon(lat: Column) -> Column:
    return F.cos(F.radians(lat)) * M_PER_DEG_LAT


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    # Not ``least``: it would turn a missing coordinate into half the globe.
    return F.asin(F.when(h > 1, F.lit(1.0)).otherwise(F.sqrt(h))) * (2 * EARTH_RADIUS_M)


def metres_between(a: Column, b: Column) -> Column:
    return haversine_m(a["lon"], a["lat"], b["lon"], b["lat"])


def to_local_m(p: Column, origin: Column) -> Column:
    """``struct<x,y>`` in metres east and north of ``origin``."""
    return F.struct(
        ((p["lon"] - origin["lon"]) * m_per_deg_lon(origin["lat"])).alias("x"),
        ((p["lat"] - origin["lat"]) * M_PER_DEG_LAT).alias("y"),
    )


def from_local_m(xy: Column, origin: Column) -> Column:
    return pt(
        origin["lon"] + xy["x"] / m_per_deg_lon(origin["lat"]),
        origin["lat"] + xy["y"] / M_PER_DEG_LAT,
    )


def offset_m(p: Column, east_m, north_m) -> Column:
    return pt(p["lon"] + F.lit(east_m) / m_per_deg_lon(p["lat"]), p["lat"] + F.lit(north_m) / M_PER_DEG_LAT)


def lerp(a: Column, b: Column, fraction) -> Column:
    f = F.lit(fraction)
    return pt(a["lon"] + (b["lon"] - a["lon"]) * f, a["lat"] + (b["lat"] - a["lat"]) * f)


def _pairs(line: Column, fn) -> Column:
    """``fn(a, b)`` over consecutive vertices; the line has at least two."""
    n = F.size(line)
    return F.zip_with(F.slice(line, F.lit(1), n - 1), F.slice(line, F.lit(2), n - 1), fn)


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd rule with strict comparisons; the last vertex joins the first."""
    n = F.size(ring)
    successor = F.concat(F.slice(ring, F.lit(2), n - 1), F.slice(ring, F.lit(1), F.lit(1)))

    def crosses(a, b):
        straddles = (a["lat"] > lat) != (b["lat"] > lat)
        x_at = a["lon"] + (lat - a["lat"]) * (b["lon"] - a["lon"]) / (b["lat"] - a["lat"])
        return F.when(straddles, (lon < x_at).cast("int")).otherwise(F.lit(0))

    crossings = F.aggregate(F.zip_with(ring, successor, crosses), F.lit(0), lambda acc, x: acc + x)
    return F.when(n > 0, crossings % 2 == 1).otherwise(F.lit(False))


def in_geometry(lon: Column, lat: Column, geometry: Column) -> Column:
    """Inside a polygon's outer ring and none of its holes. Null or empty: false."""

    def in_polygon(polygon):
        holes = F.slice(polygon, F.lit(2), F.greatest(F.size(polygon) - 1, F.lit(0)))
        return (
            F.when(F.size(polygon) <= 0, F.lit(False))
            .when(~in_ring(lon, lat, F.get(polygon, F.lit(0))), F.lit(False))
            .otherwise(~F.exists(holes, lambda hole: in_ring(lon, lat, hole)))
        )

    return F.when(geometry.isNull() | lon.isNull() | lat.isNull(), F.lit(False)).otherwise(
        F.coalesce(F.exists(geometry, in_polygon), F.lit(False))
    )


def geometry_bbox(geometry: Column) -> Column:
    """``struct<min_lon,min_lat,max_lon,max_lat>`` over the outer rings."""
    outer = F.flatten(F.transform(geometry, lambda polygon: F.get(polygon, F.lit(0))))
    return line_bbox(outer)


def line_bbox(line: Column, margin_m: float = 0.0) -> Column:
    lons = F.transform(line, lambda p: p["lon"])
    lats = F.transform(line, lambda p: p["lat"])
    west, east, south, north = F.array_min(lons), F.array_max(lons), F.array_min(lats), F.array_max(lats)
    if margin_m:
        mean_lat = F.aggregate(lats, F.lit(0.0), lambda a, x: a + x) / F.size(lats)
        dlat = F.lit(margin_m / M_PER_DEG_LAT)
        dlon = F.lit(margin_m) / m_per_deg_lon(mean_lat)
        west, east = F.round(west - dlon, 6), F.round(east + dlon, 6)
        south, north = F.round(south - dlat, 6), F.round(north + dlat, 6)
    return F.struct(
        west.alias("min_lon"), south.alias("min_lat"), east.alias("max_lon"), north.alias("max_lat")
    )


def in_fence(lon: Column, lat: Column, geometry: Column, bbox: Column) -> Column:
    """``in_geometry`` behind a cheap box test, for scans where most points are outside."""
    in_box = lon.between(bbox["min_lon"], bbox["max_lon"]) & lat.between(bbox["min_lat"], bbox["max_lat"])
    return F.when(in_box, in_geometry(lon, lat, geometry)).otherwise(F.lit(False))


def dist_to_segment_m(p: Column, a: Column, b: Column) -> Column:
    """Flat projection around ``a``; a zero-length segment is its point."""
    k = m_per_deg_lon(a["lat"])
    px, py = (p["lon"] - a["lon"]) * k, (p["lat"] - a["lat"]) * M_PER_DEG_LAT
    bx, by = (b["lon"] - a["lon"]) * k, (b["lat"] - a["lat"]) * M_PER_DEG_LAT
    length_sq = bx * bx + by * by
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * bx + py * by) / length_sq))
    return F.when(length_sq == 0, F.hypot(px, py)).otherwise(F.hypot(px - t * bx, py - t * by))


def dist_to_line_m(p: Column, line: Column) -> Column:
    """Infinity for a missing or empty line."""
    n = F.size(line)
    first = F.get(line, F.lit(0))
    return (
        F.when(line.isNull() | (n <= 0), F.lit(float("inf")))
        .when(n == 1, metres_between(p, first))
        .otherwise(F.array_min(_pairs(line, lambda a, b: dist_to_segment_m(p, a, b))))
    )


def line_length_m(line: Column) -> Column:
    steps = _pairs(line, metres_between)
    return F.when(F.size(line) < 2, F.lit(0.0)).otherwise(
        F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x)
    )


def ring_centroid(ring: Column) -> Column:
    """Area centroid rounded to 7, or the vertex mean of a ring without area."""
    n_all = F.size(ring)
    closed = (n_all > 0) & (F.get(ring, F.lit(0)) == F.get(ring, n_all - 1))
    opened = F.when(closed, F.slice(ring, F.lit(1), n_all - 1)).otherwise(ring)
    return let(opened, _open_ring_centroid)


def _open_ring_centroid(vertices: Column) -> Column:
    n = F.size(vertices)
    successor = F.concat(F.slice(vertices, F.lit(2), n - 1), F.slice(vertices, F.lit(1), F.lit(1)))

    def edge(a, b):
        cross = a["lon"] * b["lat"] - b["lon"] * a["lat"]
        return F.struct(
            cross.alias("area"),
            ((a["lon"] + b["lon"]) * cross).alias("cx"),
            ((a["lat"] + b["lat"]) * cross).alias("cy"),
        )

    zero = F.struct(F.lit(0.0).alias("area"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"))
    total = F.aggregate(
        F.zip_with(vertices, successor, edge),
        zero,
        lambda acc, e: F.struct(
            (acc["area"] + e["area"]).alias("area"),
            (acc["cx"] + e["cx"]).alias("cx"),
            (acc["cy"] + e["cy"]).alias("cy"),
        ),
    )
    mean = F.aggregate(
        vertices,
        pt(0.0, 0.0),
        lambda acc, p: pt(acc["lon"] + p["lon"], acc["lat"] + p["lat"]),
        lambda acc: pt(acc["lon"] / n, acc["lat"] / n),
    )
    by_area = let(
        total,
        lambda t: F.when(
            F.abs(t["area"]) >= 1e-12,
            pt(F.round(t["cx"] / (t["area"] * 3), 7), F.round(t["cy"] / (t["area"] * 3), 7)),
        ),
    )
    return F.when(n > 0, F.coalesce(by_area, mean))


def downsample(points: Column, limit: int = 60) -> Column:
    """At most ``limit`` points at even index steps, both ends kept."""
    n = F.size(points)
    step = n / F.lit(float(limit - 1))
    kept = F.transform(F.sequence(F.lit(0), F.lit(limit - 2)), lambda i: F.get(points, (i * step).cast("int")))
    return F.when(n <= limit, points).otherwise(F.concat(kept, F.slice(points, F.lit(-1), F.lit(1))))


def keeps_index(index: Column, n: Column, limit: int = 60) -> Column:
    """The row form of ``downsample``: is this 0-based position one of those kept?"""
    step = n / F.lit(float(limit - 1))
    near = F.floor(index / step)
    hits = [
        ((near + d).between(0, limit - 2)) & (F.floor((near + d) * step) == index) for d in (0, 1, 2)
    ]
    return (n <= limit) | (index == n - 1) | hits[0] | hits[1] | hits[2]


def circle(p: Column, radius_m: Column, segments: int = 48) -> Column:
    """A closed ring around ``p``."""
    turn = 2 * math.pi / segments
    vertices = [
        offset_m(p, radius_m * math.cos(turn * i), radius_m * math.sin(turn * i)) for i in range(segments)
    ]
    return F.array(*vertices, vertices[0])


def square(p: Column, half_side_m: float) -> Column:
    corners = [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)]
    moved = [offset_m(p, x * half_side_m, y * half_side_m) for x, y in corners]
    return F.array(*[pt(F.round(c["lon"], 7), F.round(c["lat"], 7)) for c in moved])


def site_fence(site: Column) -> Column:
    """Geometry of ``struct<point,radius_m,polygon>``: the polygon, else a circle of 150 m."""
    radius = F.coalesce(site["radius_m"], F.lit(150.0))
    return (
        F.when(site.isNull(), F.lit(None))
        .when(F.size(site["polygon"]) > 0, F.array(F.array(site["polygon"])))
        .otherwise(F.array(F.array(circle(site["point"], radius))))
    )


def slice_line(line: Column, fraction) -> Column:
    """The first ``fraction`` of a line by distance, its end interpolated."""
    frac = F.lit(fraction)
    start = F.struct(
        F.slice(line, F.lit(1), F.lit(1)).alias("out"), F.lit(0.0).alias("run"), F.lit(False).alias("done")
    )

    def step(acc, b, target):
        a = F.element_at(acc["out"], -1)
        seg = metres_between(a, b)
        reached = acc["run"] + seg >= target
        t = F.when(seg == 0, F.lit(0.0)).otherwise((target - acc["run"]) / seg)
        vertex = F.when(reached, lerp(a, b, t)).otherwise(b)
        return F.when(acc["done"], acc).otherwise(
            F.struct(
                F.concat(acc["out"], F.array(vertex)).alias("out"),
                F.when(reached, acc["run"]).otherwise(acc["run"] + seg).alias("run"),
                reached.alias("done"),
            )
        )

    rest = F.slice(line, F.lit(2), F.greatest(F.size(line) - 1, F.lit(0)))
    cut = let(
        line_length_m(line) * F.greatest(F.lit(0.0), frac),
        lambda target: F.aggregate(rest, start, lambda acc, b: step(acc, b, target), lambda acc: acc["out"]),
    )
    return F.when((frac >= 1) | (F.size(line) < 2), line).otherwise(cut)


def bearing(a: Column, b: Column) -> Column:
    k = F.cos(F.radians(a["lat"]))
    return F.degrees(F.atan2((b["lon"] - a["lon"]) * k, b["lat"] - a["lat"]))


def swapped_hint(p: Column, reference: Column) -> Column:
    """Over 500 km away as given, under 50 km with the coordinates exchanged."""
    as_given = metres_between(p, reference)
    exchanged = haversine_m(p["lat"], p["lon"], reference["lon"], reference["lat"])
    return F.coalesce(
        p["lon"].between(-90, 90) & (as_given > 500_000) & (exchanged < 50_000), F.lit(False)
    )
