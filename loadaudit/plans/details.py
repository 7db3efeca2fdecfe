"""Case details as supplied: JSON text in, typed columns and errors by field out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import clock, coerce, geo, text
from ..functions.binding import let
from ..functions.coerce import kind_of
from ..functions.rounding import round_half_even

# The detail names, sources and bounds.
NAMES = ["drainLocation", "disposalSite", "claim", "workWindow", "truck"]
SOURCES = ["manual_point", "map_selected", "field_approximate", "user_geometry"]
BOUNDS = {
    "toleranceM": (5, 500, True), "lengthM": (0, 20000, False), "widthM": (0, 200, False), "depthM": (0, 50, False),
    "radiusM": (20, 2000, True), "quantityTonnes": (0, 100_000, False), "ratePerTonne": (0, 1_000_000, False),
    "amountRupees": (0, 1e10, True), "capacityTonnes": (0, 100, False),
}


def _at(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _given(v: Column, name: str) -> Column:
    """Present and not null."""
    return F.coalesce(F.schema_of_variant(_at(v, name)) != "VOID", F.lit(False))


def _number(v: Column, name: str) -> Column:
    return F.when(kind_of(_at(v, name)) == "number", F.try_variant_get(v, f"$.{name}", "double"))


def _number_error(v: Column, name: str) -> Column:
    low, high, inclusive = BOUNDS[name]
    return F.when(_given(v, name), coerce.check_number(_number(v, name), low, high, inclusive))


def _text_error(v: Column, name: str, limit: int) -> Column:
    plain = kind_of(_at(v, name)) == "text"
    checked = text.clean_text_max(F.try_variant_get(v, f"$.{name}", "string"), limit)
    return F.when(_given(v, name), F.when(plain, checked["error"]).otherwise(F.lit("must be text")))


def _text(v: Column, name: str, limit: int) -> Column:
    return F.when(kind_of(_at(v, name)) == "text", text.clean_text_max(F.try_variant_get(v, f"$.{name}", "string"), limit)["value"])


def _as_point(p: Column) -> Column:
    """A VARIANT ``[lon, lat]`` as a point; null when it is not a list of two numbers."""
    pair = p.try_cast("array<variant>")
    numbers = (F.size(pair) == 2) & (kind_of(F.get(pair, F.lit(0))) == "number") & (kind_of(F.get(pair, F.lit(1))) == "number")
    return F.when(numbers, geo.pt(F.try_variant_get(p, "$[0]", "double"), F.try_variant_get(p, "$[1]", "double")))


def _point(v: Column, name: str) -> Column:
    return _as_point(_at(v, name))


def _line(v: Column, name: str) -> Column:
    return F.transform(_at(v, name).try_cast("array<variant>"), _as_point)


def _rounded(p: Column) -> Column:
    return geo.pt(round_half_even(p["lon"], 7), round_half_even(p["lat"], 7))


def _errors(prefix: str, entries: dict[str, Column]) -> list[Column]:
    return [
        F.when(e.isNotNull(), F.struct(F.lit(f"{prefix}.{name}").alias("field"), e.alias("message"))) for name, e in entries.items()
    ]


def _drain(v: Column) -> tuple[Column, list[Column]]:
    point_given, line_given = _given(v, "point"), _given(v, "line")
    source = F.coalesce(_text(v, "source", 80), F.lit("manual_point"))
    source_ok = ~_given(v, "source") | F.coalesce(source.isin(SOURCES), F.lit(False))
    derived_ok = ~_given(v, "derivedFromPhotos") | (kind_of(_at(v, "derivedFromPhotos")) == "bool")
    errors = {
        "point": F.when(~point_given & ~line_given, F.lit("give a point or a line")).when(point_given, coerce.check_lonlat(_point(v, "point"))),
        "line": F.when(line_given, coerce.check_line(_line(v, "line"), 2, 200)),
        "toleranceM": _number_error(v, "toleranceM"),
        "source": F.when(
            ~source_ok,
            F.lit(f"must be one of {', '.join(SOURCES)}; a trial location is never an official or surveyed drain map"),
        ),
        "derivedFromPhotos": F.when(~derived_ok, F.lit("must be true or false")),
        "name": _text_error(v, "name", 80),
        **{n: _number_error(v, n) for n in ("lengthM", "widthM", "depthM")},
    }
    line = F.when(line_given, F.transform(_line(v, "line"), _rounded))
    pin = F.when(point_given, _rounded(_point(v, "point"))).otherwise(
        let(line, lambda x: F.get(x, F.floor(F.size(x) / 2).cast("int")))
    )
    value = F.struct(
        pin.alias("point"), line.alias("line"), F.coalesce(_number(v, "toleranceM"), F.lit(30.0)).alias("tolerance_m"), source.alias("source"),
        F.coalesce(F.try_variant_get(v, "$.derivedFromPhotos", "boolean"), F.lit(False)).alias("derived_from_photos"),
        _text(v, "name", 80).alias("name"), _number(v, "lengthM").alias("length_m"), _number(v, "widthM").alias("width_m"),
        _number(v, "depthM").alias("depth_m"),
    )
    return value.cast(schemas.DRAIN_LOCATION_DDL), _errors("drainLocation", errors)


def _site(v: Column) -> tuple[Column, list[Column]]:
    given = _given(v, "polygon")
    ring = F.when(given, coerce.closed_line(_line(v, "polygon")))
    listed = coerce.check_line(_line(v, "polygon"), 3, 200)
    errors = {
        "point": coerce.check_lonlat(_point(v, "point")),
        "radiusM": _number_error(v, "radiusM"),
        "polygon": F.when(given, F.coalesce(listed, F.when(F.size(ring) < 4, F.lit("needs at least three distinct corners")))),
        "name": _text_error(v, "name", 80),
    }
    value = F.struct(
        _rounded(_point(v, "point")).alias("point"), F.coalesce(_number(v, "radiusM"), F.lit(150.0)).alias("radius_m"), ring.alias("polygon"),
        F.coalesce(_text(v, "name", 80), F.lit("Designated disposal site")).alias("name"),
    )
    return value.cast(schemas.DISPOSAL_SITE_DDL), _errors("disposalSite", errors)


def _claim(v: Column) -> tuple[Column, list[Column]]:
    amounts = ("quantityTonnes", "ratePerTonne", "amountRupees")
    usable = [_given(v, n) & _number_error(v, n).isNull() for n in amounts]
    none = ~(usable[0] | usable[1] | usable[2])
    errors = {n: _number_error(v, n) for n in amounts}
    errors["quantityTonnes"] = F.when(none, F.lit("give at least one of quantity, rate or amount")).otherwise(errors["quantityTonnes"])
    errors |= {"contractor": _text_error(v, "contractor", 120), "reference": _text_error(v, "reference", 80)}
    value = F.struct(
        *[round_half_even(_number(v, n), 3).alias(c) for n, c in zip(amounts, ("quantity_tonnes", "rate_per_tonne", "amount_rupees"))],
        _text(v, "contractor", 120).alias("contractor"), _text(v, "reference", 80).alias("reference"),
    )
    return value.cast(schemas.CLAIM_DDL), _errors("claim", errors)


def _window(v: Column) -> tuple[Column, list[Column]]:
    def stamp(name):
        return clock.iso_parts(text.strip(F.when(kind_of(_at(v, name)) == "text", F.try_variant_get(v, f"$.{name}", "string"))))

    start, end = stamp("start"), stamp("end")
    unread = F.lit("must be an ISO 8601 date-time")
    both = start.isNotNull() & end.isNotNull()
    span = end["epoch_us"] - start["epoch_us"]
    order = (
        F.when(~both, F.when(end.isNull(), unread))
        .when(start["offset_min"].isNull() != end["offset_min"].isNull(), F.lit("give both times with a timezone offset, or neither"))
        .when(span <= 0, F.lit("must be after the start"))
        .when(F.floor(span / F.lit(clock.DAY_US)) > 366, F.lit("the window can be at most a year"))
    )
    value = F.struct(clock.iso_text(start).alias("start"), clock.iso_text(end).alias("end"))
    return value.cast(schemas.WINDOW_DDL), _errors("workWindow", {"start": F.when(start.isNull(), unread), "end": order})


def _truck(v: Column) -> tuple[Column, list[Column]]:
    vehicle = text.norm_vehicle(_text(v, "vehicleNo", 20))
    capacity = _number(v, "capacityTonnes")
    capacity_ok = _given(v, "capacityTonnes") & _number_error(v, "capacityTonnes").isNull()
    neither = vehicle.isNull() & ~capacity_ok
    errors = {
        "vehicleNo": F.when(neither, F.lit("give a vehicle number, a capacity, or both")).otherwise(_text_error(v, "vehicleNo", 20)),
        "capacityTonnes": _number_error(v, "capacityTonnes"),
    }
    value = F.struct(vehicle.alias("vehicle_no"), capacity.alias("capacity_tonnes"))
    return value.cast(schemas.TRUCK_DDL), _errors("truck", errors)


_READERS = {"drainLocation": ("drain", _drain), "disposalSite": ("site", _site), "claim": ("claim", _claim), "workWindow": ("window", _window), "truck": ("truck", _truck)}


def validate_details(rows: DataFrame, content: str = "details", keep: tuple[str, ...] = ("case_id",)) -> tuple[DataFrame, DataFrame]:
    """(case_id with a column per accepted detail and ``cleared``, case_id with field and
    message). A detail with any error is not accepted; a null detail clears it; unknown
    names and an empty request are errors."""
    parsed = rows.select(*keep, F.try_parse_json(F.col(content)).alias("_v"))
    cut = parsed.select(*keep, "_v", *[_at(F.col("_v"), name).alias(f"_{name}") for name in NAMES])
    values, problems, clears = {}, [], []
    for name, (column, reader) in _READERS.items():
        part = F.col(f"_{name}")
        is_object = F.coalesce(F.schema_of_variant(part).startswith("OBJECT"), F.lit(False))
        is_null = F.coalesce(F.schema_of_variant(part) == "VOID", F.lit(False))
        value, errors = reader(part)
        found = F.when(is_object, F.array_compact(F.array(*errors)))
        other = F.when(
            part.isNotNull() & ~is_object & ~is_null, F.array(F.struct(F.lit(name).alias("field"), F.lit("must be an object").alias("message")))
        )
        problems.append(F.coalesce(found, other, F.array().cast("array<struct<field:string,message:string>>")).alias(f"e_{column}"))
        values[column] = F.when(is_object & (F.size(f"e_{column}") == 0), value)
        clears.append(F.when(is_null, F.lit(name)))
    keys = F.map_keys(F.col("_v").try_cast("map<string,variant>"))
    unknown = F.transform(
        F.array_sort(F.array_except(keys, F.array(*[F.lit(n) for n in NAMES]))),
        lambda n: F.struct(n.alias("field"), F.lit("is not a trial detail").alias("message")),
    )
    judged = cut.select("*", *problems, unknown.alias("e_unknown")).withColumn("cleared", F.array_compact(F.array(*clears)))
    listed = F.flatten(F.array_compact(F.array("e_unknown", *[f"e_{c}" for c, _ in _READERS.values()])))
    empty = (F.size(listed) == 0) & (F.size(keys) == 0)
    nothing = F.array(F.struct(F.lit("body").alias("field"), F.lit("nothing to update").alias("message")))
    errors = judged.select(*keep, F.explode(F.when(empty, nothing).otherwise(listed)).alias("_e")).select(*keep, "_e.*")
    accepted = judged.select(*keep, *[v.alias(c) for c, v in values.items()], "cleared")
    return accepted, errors
