"""Data-quality jobs: reconciliation, audits, nearest drain."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, hashing
from ..plans.staging import stage
from .ordered import neighbours, range_buckets
from .photos import near_hashes

# Slip fields whose misreading blocks, those that only warn, tolerances.
BLOCKING = ["vehicle_no", "net", "time_in"]
WARNING = ["ticket_no", "gross", "tare", "time_out", "site"]
WEIGHTS = ["net", "gross", "tare"]
WEIGHT_TOLERANCE_T = 0.005


def reconcile(printed: DataFrame, read: DataFrame, key: str = "s3_key") -> DataFrame:
    """(level, key, field, read, printed) where a reading differs from what was printed;
    a slip that is absent or not OK blocks as a whole."""
    names = BLOCKING + WARNING
    left = printed.select(key, *[F.col(c).alias(f"p_{c}") for c in names])
    right = read.select(key, F.col("status").alias("_status"), *[F.col(c).alias(f"r_{c}") for c in names])
    both = left.join(right, key, "left")

    def spoken(c):
        return F.upper(F.trim(F.regexp_replace(c.cast("string"), r"\s+", " ")))

    def same(name):
        r, p = F.col(f"r_{name}"), F.col(f"p_{name}")
        present = r.isNotNull() & p.isNotNull()
        equal = F.abs(r.cast("double") - p.cast("double")) <= WEIGHT_TOLERANCE_T if name in WEIGHTS else spoken(r) == spoken(p)
        return F.when(present, equal).otherwise(r.isNull() & p.isNull())

    def row(level, name, r, p):
        return F.struct(F.lit(level).alias("level"), F.lit(name).alias("field"), r.cast("string").alias("read"), p.cast("string").alias("printed"))

    differing = [
        F.when(~same(n), row("blocking" if n in BLOCKING else "warning", n, F.col(f"r_{n}"), F.col(f"p_{n}"))) for n in names
    ]
    unread = F.coalesce(F.col("_status") != "OK", F.lit(True))
    problems = F.when(unread, F.array(row("blocking", "status", F.col("_status"), F.lit("OK")))).otherwise(F.array_compact(F.array(*differing)))
    return both.select(key, F.explode(problems).alias("_p")).select(key, "_p.*")


def verdict_diff(expected: DataFrame, actual: DataFrame, keys: list[str], exact: list[str], tonnes: list[str] = (), tolerance: float = 0.05) -> DataFrame:
    """(keys, field, expected, actual) wherever two results differ; a row on one side
    only differs in every field. Amounts may differ by ``tolerance``."""
    columns = [*exact, *tonnes]
    e = expected.select(*keys, *[F.col(c).alias(f"e_{c}") for c in columns])
    a = actual.select(*keys, *[F.col(c).alias(f"a_{c}") for c in columns])
    both = e.join(a, keys, "full_outer")

    def differs(c):
        x, y = F.col(f"e_{c}"), F.col(f"a_{c}")
        if c in tonnes:
            near = F.abs(x.cast("double") - y.cast("double")) <= tolerance
            return ~F.coalesce(near, x.isNull() & y.isNull())
        return ~x.eqNullSafe(y)

    def shown(side, c):
        column = F.col(f"{side}_{c}")
        text = F.array_join(column, ",") if dict(expected.dtypes)[c].startswith("array") else column.cast("string")
        return text

    rows = [
        F.when(differs(c), F.struct(F.lit(c).alias("field"), shown("e", c).alias("expected"), shown("a", c).alias("actual"))) for c in columns
    ]
    return both.select(*keys, F.explode(F.array_compact(F.array(*rows))).alias("_d")).select(*keys, "_d.*")


def check_targets(summary: DataFrame, targets: DataFrame, drains: DataFrame, colours: DataFrame, tolerance: float = 0.51) -> DataFrame:
    """(what, expected, actual) where a total drifted from its target or a drain from its
    planned colour; a drain without a plan should be GREEN. ``summary`` and ``targets``
    are (bill_id, name, value); ``colours`` is (bill_id, drain_id, colour)."""
    drift = (
        targets.select("bill_id", "name", F.col("value").alias("_t"))
        .join(summary.select("bill_id", "name", F.col("value").alias("_a")), ["bill_id", "name"], "left")
        .where(~F.coalesce(F.abs(F.col("_a") - F.col("_t")) <= tolerance, F.lit(False)))
        .select("bill_id", F.col("name").alias("what"), F.col("_t").cast("string").alias("expected"), F.col("_a").cast("string").alias("actual"))
    )
    planned = drains.join(colours.select("bill_id", "drain_id", F.col("colour").alias("_c")), ["bill_id", "drain_id"], "left")
    want = F.coalesce("_c", F.lit("GREEN"))
    off = planned.where(want != F.col("verdict")).select(
        "bill_id", F.concat(F.lit("drain "), F.col("drain_id")).alias("what"), want.alias("expected"), F.col("verdict").alias("actual")
    )
    return drift.unionByName(off)


# ------------------------------------------------------------ image hashes
UNRELATED_BITS = 16


def audit_hashes(photos: DataFrame, copies: DataFrame, max_bits: int = 12, unrelated_bits: int = UNRELATED_BITS, **tuning) -> DataFrame:
    """(problem, a, b, distance, n_a, n_b): declared copies too far from their source, and
    unrelated photos too close. ``photos`` is (key, p_hash), ``copies`` (key, source,
    kind) with kind 'exact copy' or another; a source is an original.

    Photos with one hash are one side, named by their first key and counted, so a large
    group of equal images never becomes a list of all its pairs. Two sides are related
    when all their photos come from one source. The hashes and their groups are staged, as each
    is read several times."""
    hashes = stage(photos.select("key", F.col("p_hash").alias("hash")), "hashes")
    declared = copies.join(hashes, "key").join(hashes.select(F.col("key").alias("source"), F.col("hash").alias("_source")), "source")
    distance = hashing.hamming_hex(F.col("hash"), F.col("_source"))
    limit = F.when(F.col("kind") == "exact copy", 0).otherwise(max_bits)
    far = declared.withColumn("distance", distance).where(F.col("distance") > limit).select(
        F.lit("copy too far").alias("problem"), F.col("key").alias("a"), F.col("source").alias("b"), "distance",
        F.lit(1).cast("bigint").alias("n_a"), F.lit(1).cast("bigint").alias("n_b"),
    )
    family = F.coalesce("source", "key")
    groups = hashes.join(copies.select("key", "source"), "key", "left").groupBy("hash").agg(
        F.min("key").alias("first"), F.max("key").alias("last"), F.count(F.lit(1)).alias("n"),
        F.min(family).alias("f0"), F.max(family).alias("f1"),
    )
    groups = stage(groups, "hash-groups")
    identical = groups.where(F.col("f0") != F.col("f1")).select(
        F.col("first").alias("a"), F.col("last").alias("b"), F.lit(0).alias("distance"), F.col("n").alias("n_a"), F.col("n").alias("n_b")
    )
    pairs = near_hashes(groups.select("hash"), [], unrelated_bits, **tuning).where(F.col("hash") < F.col("other"))
    left = groups.select("hash", F.col("first").alias("a"), F.col("n").alias("n_a"), F.col("f0").alias("a0"), F.col("f1").alias("a1"))
    right = groups.select(F.col("hash").alias("other"), F.col("first").alias("b"), F.col("n").alias("n_b"), F.col("f0").alias("b0"), F.col("f1").alias("b1"))
    one_family = (F.col("a0") == F.col("a1")) & (F.col("b0") == F.col("b1")) & (F.col("a0") == F.col("b0"))
    differing = (
        pairs.join(left, "hash").join(right, "other").where(~one_family)
        .select("a", "b", hashing.hamming_hex(F.col("hash"), F.col("other")).alias("distance"), "n_a", "n_b")
    )
    near = identical.unionByName(differing).select(F.lit("unrelated too close").alias("problem"), "a", "b", "distance", "n_a", "n_b")
    return far.unionByName(near)


# ----------------------------------------------------------- nearest drain
#: Degrees of the finest cells, how many of them make the next level's side, and the number
#: of levels: the coarsest cell is wider than the globe.
CELL, FACTOR, LEVELS = 0.0025, 4, 10
#: Metres of a degree of a great circle, a little less than any distance here takes.
_LEAST_M_PER_DEG = 111_190.0


def _sizes(cell: float) -> list[float]:
    return [cell * FACTOR**k for k in range(LEVELS)]


def _registered(pieces: DataFrame, box: Column, cell: float) -> DataFrame:
    """A row for each cell that a piece's box meets, on its own level, the finest whose cells
    are as wide as the box, and on all coarser ones: at most four cells a level. ``own`` marks
    the piece's own level."""
    extent = F.greatest(box["max_lon"] - box["min_lon"], box["max_lat"] - box["min_lat"])
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(s).alias("size")) for k, s in enumerate(_sizes(cell))])
    fits = F.filter(levels, lambda l: (l["size"] >= extent) | (l["level"] == LEVELS - 1))
    at = pieces.withColumn("_box", box).withColumn("_levels", fits).withColumn("_l", F.explode("_levels"))
    size, b = F.col("_l.size"), F.col("_box")
    return (
        at.withColumn("x", F.explode(F.sequence(F.floor(b["min_lon"] / size), F.floor(b["max_lon"] / size))))
        .withColumn("y", F.explode(F.sequence(F.floor(b["min_lat"] / size), F.floor(b["max_lat"] / size))))
        .withColumns({"level": F.col("_l.level"), "own": F.col("_l.level") == LEVELS - F.size("_levels")})
        .drop("_box", "_levels", "_l")
    )


def locate(points: DataFrame, drains: DataFrame, by: tuple[str, ...] = (), point_id: str = "point_id", cell: float = CELL) -> DataFrame:
    """(point_id, drain_id, distance_m): the first drain that contains the point, at 0 m,
    else the nearest centreline. ``points`` has lon and lat, ``drains`` a ``place`` (ties
    keep the lower), geofence and centreline; ``by`` columns must agree.

    Exact, by equi-joins on cells alone. An occupied cell looks, level by level, for the finest
    one where its own or a neighbouring cell holds a centreline segment. That segment is no
    more than ``3 * sqrt(2)`` cell widths away, so nothing beyond the rings of that radius can be
    nearest: those rings, wider in longitude as meridians close up, give the candidates. Each of
    two steps, at that level and at the finest, keeps those within ``d + 2h`` of the cell's centre,
    ``d`` the nearest one's distance and ``h`` half the cell's diagonal. Fences are met where their box
    is. Pieces of the same shape are one, that of the lowest place. Points of a crowded cell meet the
    few pieces that are left."""
    by, sizes = list(by), _sizes(cell)
    located = points.where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    located = located.select(*by, point_id, "lon", "lat", F.floor(F.col("lon") / cell).alias("ix"), F.floor(F.col("lat") / cell).alias("iy"))
    occupied = located.select(*by, "ix", "iy").distinct()
    who = F.min(F.struct("place", "drain_id")).alias("who")

    n = F.size("centreline")
    single = F.when(n == 1, F.concat("centreline", "centreline")).otherwise(F.col("centreline"))
    ends = F.arrays_zip(F.slice(single, F.lit(1), F.size(single) - 1).alias("a"), F.slice(single, F.lit(2), F.size(single) - 1).alias("b"))
    segments = drains.where(n > 0).select(*by, "drain_id", "place", F.explode(ends).alias("s"), (n == 1).alias("lone"))
    segments = segments.groupBy(*by, F.col("s.a").alias("a"), F.col("s.b").alias("b"), "lone").agg(who)
    fences = drains.where(F.size("geofence") > 0).groupBy(*by, "geofence").agg(who).withColumn("box", geo.geometry_bbox(F.col("geofence")))
    lines = _registered(segments, geo.line_bbox(F.array("a", "b")), cell)

    def ancestor(c: str, level: Column) -> Column:
        return F.floor(F.col(c) / F.pow(F.lit(float(FACTOR)), level))

    up = occupied.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    up = up.withColumns({"x": ancestor("ix", F.col("level")), "y": ancestor("iy", F.col("level"))})
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = lines.select(*by, "level", "x", "y").distinct().withColumn("_o", F.explode(around))
    near = near.select(*by, "level", (F.col("x") + F.col("_o.i")).alias("x"), (F.col("y") + F.col("_o.j")).alias("y")).distinct()
    found = up.join(near, [*by, "level", "x", "y"], "left_semi").groupBy(*by, "ix", "iy").agg(F.min(F.struct("level", "x", "y")).alias("_f"))
    found = found.select(*by, "ix", "iy", F.col("_f.level").alias("l"), F.col("_f.x").alias("cx"), F.col("_f.y").alias("cy"))

    def size_of(level: Column) -> Column:
        return F.lit(cell) * F.pow(F.lit(float(FACTOR)), level)

    # The rings of every level that can hold a piece within reach of a cell.
    s, t = size_of(F.col("l")), size_of(F.col("level"))
    reach_deg = 3 * math.sqrt(2) * s * geo.M_PER_DEG_LAT / _LEAST_M_PER_DEG * (1 + 1e-9)
    lat = F.least(F.abs((F.col("cy") + 0.5) * s) + s + reach_deg + t, F.lit(89.9))
    rings_y = F.ceil(reach_deg / t)
    rings_x = F.least(F.ceil(reach_deg / F.cos(F.radians(lat)) / t), F.ceil(F.lit(720.0) / t) + 1)
    cells = found.select(*by, "l", "cx", "cy").distinct().withColumn("level", F.explode(F.sequence(F.col("l"), F.lit(LEVELS - 1))))
    ratio = F.pow(F.lit(float(FACTOR)), F.col("level") - F.col("l"))
    cells = cells.withColumns({"_x": F.floor(F.col("cx") / ratio), "_y": F.floor(F.col("cy") / ratio), "_rx": rings_x, "_ry": rings_y})
    cells = cells.withColumn("x", F.explode(F.sequence(F.col("_x") - F.col("_rx"), F.col("_x") + F.col("_rx"))))
    cells = cells.withColumn("y", F.explode(F.sequence(F.col("_y") - F.col("_ry"), F.col("_y") + F.col("_ry")))).drop("_x", "_y", "_rx", "_ry")

    def distance(p: Column) -> Column:
        far = geo.metres_between(p, F.col("a"))
        return F.when(F.col("lone"), far).otherwise(geo.dist_to_segment_m(p, F.col("a"), F.col("b")))

    def nearest(df: DataFrame, keys: list[str], size: Column) -> DataFrame:
        """The pieces that may be nearest to some point of the cell that ``keys`` name."""
        x, y = (F.col(k) for k in keys[-2:])
        measured = df.withColumn("_d", distance(geo.pt((x + 0.5) * size, (y + 0.5) * size)))
        least = F.min("_d").over(Window.partitionBy(*keys))
        slack = geo.M_PER_DEG_LAT * size * math.sqrt(2) * (1 + 1e-9) + 1e-3
        return measured.withColumn("_least", least).where(F.col("_d") <= F.col("_least") + slack).drop("_d", "_least")

    met = cells.join(lines, [*by, "level", "x", "y"]).where(F.col("own") | (F.col("level") == F.col("l")))
    shape = ["a", "b", "lone", "who"]
    met = nearest(met.select(*by, "l", "cx", "cy", *shape).distinct(), [*by, "l", "cx", "cy"], size_of(F.col("l")))
    fine = nearest(found.join(met, [*by, "l", "cx", "cy"]).select(*by, "ix", "iy", *shape), [*by, "ix", "iy"], F.lit(cell))

    box, west, south = F.col("box"), F.col("ix") * cell, F.col("iy") * cell
    over = (
        (box["min_lon"] <= west + cell + 1e-9) & (box["max_lon"] >= west - 1e-9) & (box["min_lat"] <= south + cell + 1e-9) & (box["max_lat"] >= south - 1e-9)
    )
    fenced = up.join(_registered(fences, F.col("box"), cell).where("own"), [*by, "level", "x", "y"]).where(over).select(*by, "ix", "iy", "geofence", "box", "who")
    pieces = fine.unionByName(fenced, allowMissingColumns=True)

    measured = located.join(pieces, [*by, "ix", "iy"], "left")
    inside = geo.in_fence(F.col("lon"), F.col("lat"), F.col("geofence"), F.col("box"))
    d = F.when(F.col("geofence").isNotNull(), F.when(inside, F.lit(-1.0))).otherwise(distance(geo.pt(F.col("lon"), F.col("lat"))))
    ranked = measured.select(*by, point_id, d.alias("d"), "who")
    best = ranked.groupBy(*by, point_id).agg(F.min(F.when(F.col("d").isNotNull(), F.struct("d", "who"))).alias("_b"))
    return best.select(
        *by, point_id, F.col("_b.who.drain_id").alias("drain_id"), F.when(F.col("_b.d").isNotNull(), F.greatest("_b.d", F.lit(0.0))).otherwise(F.lit(float("inf"))).alias("distance_m")
    )


def field_report(photos: DataFrame, drains: DataFrame, by: tuple[str, ...] = (), band_m: float = 60.0) -> tuple[DataFrame, DataFrame]:
    """(a row per file, counts): no camera tags, no GPS, outside every fence with its
    distance, in the soft band, the previous file with the identical hash.

    ``photos`` has name, problems, has_gps, lon, lat, p_hash."""
    by = list(by)
    tagged = ~F.array_contains("problems", "no_exif")
    base = photos.withColumn("_state", F.when(~tagged, F.lit("no_exif")).when(~F.coalesce("has_gps", F.lit(False)), F.lit("no_gps")).otherwise(F.lit("gps")))
    placed = base.where(F.col("_state") == "gps")
    where = locate(placed.withColumnRenamed("name", "point_id"), drains, tuple(by)).withColumnRenamed("point_id", "name")
    hashed = range_buckets(placed.select(*by, "name", "p_hash"), [*by, "p_hash"], ["name"], "_range")
    twins = neighbours(hashed, [*by, "p_hash"], ["name"], F.col("_range"), ["name"]).select(
        *by, "name", F.col("prev.name").alias("identical_to")
    )
    rows = base.join(where, [*by, "name"], "left").join(twins, [*by, "name"], "left")
    outside = F.col("distance_m") > 0
    state = F.when(F.col("_state") != "gps", F.col("_state")).when(outside, F.lit("outside")).otherwise(F.lit("inside"))
    report = rows.select(
        *by, "name", state.alias("state"), "drain_id", "distance_m", F.coalesce(outside & (F.col("distance_m") <= band_m), F.lit(False)).alias("in_band"), "identical_to"
    )
    counts = report.groupBy(*by).agg(
        *[F.count_if(F.col("state") == s).alias(s) for s in ("no_exif", "no_gps", "outside", "inside")],
        F.count_if("in_band").alias("in_band"), F.count("identical_to").alias("identical"),
    )
    return report, counts
