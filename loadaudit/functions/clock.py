"""Times. An ISO text keeps its own wall clock and its offset, because a slip's
clock is compared with the clock on the truck's side, not with an instant.
All arithmetic is on BIGINT microseconds, so no result depends on the session
time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let, let_all

DAY_US = 86_400_000_000
TIME_DDL = "struct<wall_us:bigint,offset_min:int,epoch_us:bigint>"

_CAMERA_COLONS = r"^\d{4}:\d{1,2}:\d{1,2} \d{1,2}:\d{1,2}(:\d{1,2})?$"
_CAMERA_DASHES = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"
_ISO = r"^\d{4}-\d\d-\d\d(.\d\d:\d\d(:\d\d([.,]\d+)?)?(Z|[+-]\d\d(:?\d\d)?)?)?$"


def _extended(c: Column) -> Column:
    """Compact and hour-only ISO forms with their dashes and colons written out."""
    dashed = F.regexp_replace(c, r"^(\d{4})(\d\d)(\d\d)(?![\d-])", "$1-$2-$3")
    day = r"^(\d{4}-\d\d-\d\d.)(\d\d)"
    seconds = F.regexp_replace(dashed, day + r"(\d\d)(\d\d)(?!\d)", "$1$2:$3:$4")
    minutes = F.regexp_replace(seconds, day + r"(\d\d)(?![\d:])", "$1$2:$3")
    return F.regexp_replace(minutes, day + r"(?=$|[Z+-])", "$1$2:00")


def iso_parts(c: Column) -> Column:
    """ISO 8601 text to ``struct<wall_us,offset_min,epoch_us>``; null when unreadable.
    Date and time may be compact (``20261009T070000``) and the time may end with its hour.
    A text without an offset has a null ``offset_min`` and reads as UTC; an offset of a day
    or more is unreadable."""
    return let(_extended(c), _iso_parts)


def _iso_parts(c: Column) -> Column:
    has_seconds = F.substring(c, 17, 1) == ":"

    def number(start, default=0):
        return F.coalesce(F.substring(c, start, 2).try_cast("int"), F.lit(default))

    def from_fields(v):
        fraction = F.rpad(F.substring(F.regexp_extract(v["tail"], r"^[.,](\d+)", 1), 1, 6), 6, "0").try_cast("int")
        wall = (
            v["day"].cast("bigint") * DAY_US
            + (v["hour"] * 3600 + v["minute"] * 60 + v["second"]).cast("bigint") * 1_000_000
            + F.coalesce(fraction, F.lit(0)).cast("bigint")
        )
        zone = F.regexp_extract(v["tail"], r"(Z|[+-]\d\d(?::?\d\d)?)$", 1)
        readable = v["day"].isNotNull() & (v["hour"] <= 23) & (v["minute"] <= 59) & (v["second"] <= 59) & F.coalesce(F.abs(_offset(zone)) < 1440, F.lit(True))
        return F.when(readable, let_all(lambda t: _time(t["wall"], t["offset"]), wall=wall, offset=_offset(zone)))

    fields = let_all(
        from_fields,
        day=F.unix_date(F.substring(c, 1, 10).try_cast("date")),
        hour=number(12),
        minute=number(15),
        second=F.when(has_seconds, number(18)).otherwise(F.lit(0)),
        tail=F.when(has_seconds, F.substring(c, 20, 99)).otherwise(F.substring(c, 17, 99)),
    )
    return F.when(c.rlike(_ISO), fields)


def _offset(zone: Column) -> Column:
    def minutes(z):
        digits = F.rpad(F.regexp_replace(z, "[^0-9]", ""), 4, "0")
        size = F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")
        sign = F.when(F.substring(z, 1, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
        return F.when(z == "Z", F.lit(0)).when(z != "", sign * size)

    return let(zone, minutes)


def _time(wall: Column, offset: Column) -> Column:
    shift = F.coalesce(offset, F.lit(0)).cast("bigint") * 60_000_000
    return F.struct(wall.alias("wall_us"), offset.cast("int").alias("offset_min"), (wall - shift).alias("epoch_us"))


def wall_us(c: Column) -> Column:
    """The wall clock of a TIMESTAMP_NTZ column in microseconds, whatever the session's
    time zone."""
    second = F.extract(F.lit("SECOND"), c)
    in_day = (F.hour(c) * 3600 + F.minute(c) * 60).cast("bigint") * 1_000_000 + (second * 1_000_000).cast("bigint")
    return F.unix_date(c.cast("date")).cast("bigint") * DAY_US + in_day


def aligned_us(stamp: Column, like: Column) -> Column:
    """Microseconds of ``stamp`` comparable with ``like['epoch_us']``: when only one of
    them has an offset, ``stamp`` is read on the other's clock."""
    borrow = like["offset_min"].isNotNull() & stamp["offset_min"].isNull()
    drop = like["offset_min"].isNull() & stamp["offset_min"].isNotNull()
    return (
        F.when(borrow, stamp["wall_us"] - like["offset_min"].cast("bigint") * 60_000_000)
        .when(drop, stamp["wall_us"])
        .otherwise(stamp["epoch_us"])
    )


def in_window(t: Column, start: Column, end: Column) -> Column:
    """Inclusive at both ends; every argument is ``iso_parts``."""
    at = aligned_us(t, start)
    return (at >= start["epoch_us"]) & (at <= end["epoch_us"])


def date_text(wall_us: Column) -> Column:
    return F.date_from_unix_date(F.floor(wall_us / F.lit(DAY_US)).cast("int")).cast("string")


def hhmm_text(wall_us: Column) -> Column:
    minute = F.floor(F.pmod(wall_us, F.lit(DAY_US)) / F.lit(60_000_000)).cast("int")
    return F.format_string("%02d:%02d", F.floor(minute / 60).cast("int"), minute % 60)


def iso_text(parts: Column) -> Column:
    return let(parts, _iso_text)


def _iso_text(parts: Column) -> Column:
    """Parts back to ISO text: seconds always, microseconds and offset when present."""
    in_day = F.pmod(parts["wall_us"], F.lit(DAY_US))
    second = (F.floor(in_day / F.lit(1_000_000)) % 60).cast("int")
    micro = (in_day % 1_000_000).cast("int")
    offset = parts["offset_min"]
    zone = F.format_string(
        "%s%02d:%02d",
        F.when(offset < 0, F.lit("-")).otherwise(F.lit("+")),
        F.floor(F.abs(offset) / 60).cast("int"),
        F.abs(offset) % 60,
    )
    return F.when(
        parts.isNotNull(),
        F.concat(
            date_text(parts["wall_us"]),
            F.lit("T"),
            hhmm_text(parts["wall_us"]),
            F.format_string(":%02d", second),
            F.when(micro == 0, F.lit("")).otherwise(F.format_string(".%06d", micro)),
            F.when(offset.isNull(), F.lit("")).otherwise(zone),
        ),
    )


def minutes_apart(hhmm: Column, arrival_wall_us: Column) -> Column:
    """Signed minutes from an arrival to the nearest printing of ``hhmm`` on its own
    clock: yesterday, today or tomorrow, the earlier day on a tie."""
    def nearest(v):
        def shifted(days):
            delta = (v["base"] + F.lit(days * DAY_US) - v["wall"]) / F.lit(60_000_000.0)
            return F.struct(F.abs(delta).alias("size"), F.lit(days).alias("day"), delta.alias("minutes"))

        best = F.array_min(F.array(shifted(-1), shifted(0), shifted(1)))["minutes"]
        return F.when(v["wall"].isNotNull() & v["hour"].between(0, 23) & v["minute"].between(0, 59), best)

    def placed(v):
        clock = (v["hour"] * 60 + v["minute"]).cast("bigint") * 60_000_000
        midnight = v["wall"] - F.pmod(v["wall"], F.lit(DAY_US))
        return let_all(nearest, base=midnight + clock, wall=v["wall"], hour=v["hour"], minute=v["minute"])

    return let_all(
        placed,
        hour=F.substring_index(hhmm, ":", 1).try_cast("int"),
        # All that follows the first colon: a text with seconds is no reading.
        minute=F.regexp_extract(hhmm, "^[^:]*:(.*)$", 1).try_cast("int"),
        wall=arrival_wall_us,
    )


def hhmm(c: Column) -> Column:
    """The clock of an ISO text as written."""
    return F.nullif(F.regexp_extract(c, r"T(\d{2}:\d{2})", 1), F.lit(""))


def minute_of_day(c: Column) -> Column:
    fields = F.split(c, ":")
    return F.get(fields, F.lit(0)).try_cast("int") * 60 + F.get(fields, F.lit(1)).try_cast("int")


def exif_time(c: Column, offset: Column) -> Column:
    """Camera date text, with its optional offset, to ISO text."""
    def stamped(v):
        shift = F.when((v["h"] < 24) & v["m"].isNotNull(), v["sign"] * (v["h"] * 60 + v["m"]))
        return F.when(v["at"].isNotNull(), iso_text(_time(v["at"]["wall_us"], shift)))

    def from_text(v):
        fields = F.split(v["text"], "[-: ]")

        def two(i):
            return F.lpad(F.coalesce(F.get(fields, F.lit(i)), F.lit("00")), 2, "0")

        iso = F.concat(
            F.get(fields, F.lit(0)), F.lit("-"), two(1), F.lit("-"), two(2),
            F.lit("T"), two(3), F.lit(":"), two(4), F.lit(":"), two(5),
        )
        shaped = v["text"].rlike(_CAMERA_COLONS) | v["text"].rlike(_CAMERA_DASHES)
        parts = F.split(F.substring(v["zone"], 2, 99), ":")
        minute = F.coalesce(F.nullif(F.get(parts, F.lit(1)), F.lit("")), F.lit("0"))
        return let_all(
            stamped,
            at=iso_parts(F.when(shaped, iso)),
            h=F.get(parts, F.lit(0)).try_cast("int"),
            m=minute.try_cast("int"),
            sign=F.when(F.substring(v["zone"], 1, 1) == "-", F.lit(-1)).otherwise(F.lit(1)),
        )

    return let_all(
        from_text,
        text=F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), "/", ":"),
        zone=F.regexp_replace(offset, r"^\s+|\s+$", ""),
    )


def dms_deg(d: Column, m: Column, s: Column, ref: Column) -> Column:
    degrees = d + m / 60.0 + s / 3600.0
    west_or_south = F.upper(F.trim(ref)).isin("S", "W")
    return F.round(F.when(west_or_south, -degrees).otherwise(degrees), 7)
