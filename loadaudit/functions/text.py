"""Readings of printed text: weights, clocks, plates, free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let, let_all
from .rounding import round_half_even, rounded

# Texts that mean "no answer", and digits commonly misread as letters.
NO_ANSWER = ["", "-", "--", "---", "n/a", "na", "none", "nil", "?"]
MISREAD_FROM = "OolIL|S"
MISREAD_TO = "0011115"


#: White space of any script, and the four separators of ASCII.
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


ASCII_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "


def strip(c: Column) -> Column:
    """Without white space at both ends; a pattern is only tried on a text beyond ASCII."""

    def stripped(text):
        plain = F.octet_length(text) == F.length(text)
        return F.when(plain, F.btrim(text, F.lit(ASCII_SPACE))).otherwise(F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", ""))

    return let(c, stripped)


def fix_digits(c: Column) -> Column:
    return F.translate(c, MISREAD_FROM, MISREAD_TO)


def _unanswered(lowered: Column) -> Column:
    return lowered.isNull() | lowered.isin(NO_ANSWER)


def parse_weight_t(c: Column) -> Column:
    """Printed weight to tonnes, null when it is not one."""

    def from_text(text):
        bare = F.regexp_replace(text, r"(kgs|kg|mt|tonnes|tonne|ton|tons|t)\b", "")
        digits = fix_digits(F.regexp_replace(bare, "[, ]", ""))
        number = F.regexp_extract(digits, r"[0-9]+(?:\.[0-9]+)?", 0).try_cast("double")
        return let(number, lambda value: from_number(text, value))

    def from_number(text, value):
        in_kg = text.contains("kg") | (value > 200)
        readable = ~_unanswered(text) & text.rlike("[0-9]") & (value != 0)
        return F.when(readable, F.when(in_kg, rounded(value / 1000.0, 3)).otherwise(rounded(value, 3)))

    return let(F.lower(strip(c)), from_text)


_CLOCK = rf"([0-9]{{1,2}}){SPACE}*[:.\-h]{SPACE}*([0-9]{{2}})"


def parse_hhmm(c: Column) -> Column:
    """Printed clock to ``HH:MM``, null when it is not one."""

    def from_text(text):
        cleaned = fix_digits(strip(F.regexp_replace(text, r"[ap]\.?m\.?", "")))
        return let_all(
            lambda v: let_all(
                lambda t: finish(text, t),
                h=F.when(v["hour"] != "", v["hour"])
                .when(F.length(v["digits"]).isin(3, 4), F.substring(v["digits"], F.lit(1), F.length(v["digits"]) - 2))
                .try_cast("int"),
                m=F.when(v["hour"] != "", v["minute"])
                .when(F.length(v["digits"]).isin(3, 4), F.substring(v["digits"], F.length(v["digits"]) - 1, F.lit(2)))
                .try_cast("int"),
            ),
            hour=F.regexp_extract(cleaned, _CLOCK, 1),
            minute=F.regexp_extract(cleaned, _CLOCK, 2),
            digits=F.regexp_replace(cleaned, r"[^0-9]", ""),
        )

    def finish(text, t):
        pm, am = text.contains("pm"), text.contains("am")
        h24 = F.when(pm & (t["h"] < 12), t["h"] + 12).when(~pm & am & (t["h"] == 12), F.lit(0)).otherwise(t["h"])
        readable = ~_unanswered(text) & text.rlike("[0-9]") & h24.between(0, 23) & t["m"].between(0, 59)
        return F.when(readable, F.format_string("%02d:%02d", h24, t["m"]))

    return let(F.lower(strip(c)), from_text)


def parse_plate(c: Column) -> Column:
    """Printed plate in capitals, digits corrected only in its second and fourth group."""

    def from_text(text):
        spaced = strip(F.regexp_replace(F.regexp_replace(text, "[^A-Z0-9 ]", " "), f"{SPACE}+", " "))
        groups = F.transform(
            F.split(spaced, " "), lambda part, i: F.when(i.isin(1, 3), fix_digits(part)).otherwise(part)
        )
        readable = ~_unanswered(F.lower(text)) & text.rlike("[0-9]")
        return F.when(readable, F.nullif(F.array_join(groups, " "), F.lit("")))

    return let(F.upper(strip(c)), from_text)


def clean_text(c: Column) -> Column:
    return let(
        strip(F.regexp_replace(c, f"{SPACE}+", " ")), lambda text: F.when(~_unanswered(F.lower(text)), text)
    )


def clean_text_max(c: Column, max_len: int) -> Column:
    """``struct<value,error>``: control characters become spaces; too long is an error."""
    spaced = strip(F.regexp_replace(c, r"[\x00-\x1f\x7f]", " "))
    return let(
        F.regexp_replace(spaced, f"{SPACE}+", " "),
        lambda text: F.struct(
            F.when(F.length(text) <= max_len, F.nullif(text, F.lit(""))).alias("value"),
            F.when(F.length(text) > max_len, F.lit(f"must be {max_len} characters or fewer")).alias("error"),
        ),
    )


def norm_vehicle(c: Column) -> Column:
    return F.nullif(strip(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", " ")), F.lit(""))


def basename(key: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(key, r"([^/]*)$", 1), F.lit("")), F.lit("photo"))


def spaced_json(c: Column, limit: int | None = None) -> Column:
    """Compact JSON with a space behind every comma and colon outside of texts, and with
    characters beyond ASCII escaped; ``limit`` keeps the first so many characters.

    Escaped backslashes and quotes are set aside as control characters, which JSON never holds,
    so the quotes that are left alternate between the outside and the inside of texts. Each
    step is one pass over the characters."""

    def escaped(ch):
        code = F.ascii(ch)
        unit = lambda x: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(x), 4, "0")))
        high, low = 0xD7C0 + F.shiftright(code, 10), 0xDC00 + code % 1024
        return F.when(code < 128, ch).when(code < 0x10000, unit(code)).otherwise(F.concat(unit(high), unit(low)))

    aside = F.replace(F.replace(c, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    parts = F.transform(F.split(aside, '"'), lambda part, i: F.when(i % 2 == 0, F.regexp_replace(part, "([,:])", "$1 ")).otherwise(part))
    spaced = F.replace(F.replace(F.array_join(parts, '"'), F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))

    def ascii_only(text):
        # Escaping only lengthens a text, so what is cut here is cut afterwards anyway.
        wide = F.array_join(F.transform(F.split(text, ""), escaped), "")
        return F.when(text.rlike(r"[^\x00-\x7F]"), wide).otherwise(text)

    if limit is None:
        return let(spaced, ascii_only)
    return F.substring(let(F.substring(spaced, 1, limit), ascii_only), 1, limit)


# ---- number text, as messages print it
def fixed0(x: Column) -> Column:
    """No decimals, halves to even."""
    return F.bround(x.cast("double"), 0).cast("decimal(38,0)").cast("string")


def fixed(x: Column, decimals: int) -> Column:
    return F.format_string(f"%.{decimals}f", round_half_even(x, decimals))


def grouped(x: Column, decimals: int) -> Column:
    return F.format_number(round_half_even(x, decimals), decimals)


def general(x: Column) -> Column:
    """Six significant digits without trailing zeros."""

    def plain(v):
        decimals = F.array(*[F.format_string(f"%.{n}f", v) for n in (5, 4, 3, 2, 1, 0)])
        place = F.when(F.abs(v) < 10, 0).otherwise(F.floor(F.log10(F.abs(v))).cast("int"))
        return F.get(decimals, F.least(place, F.lit(5)))

    def trimmed(c):
        return F.regexp_replace(F.regexp_replace(c, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")

    def whole(v):
        power = F.split(F.format_string("%.5e", v), "e")
        return F.when(F.abs(v) < 999_999.5, trimmed(plain(v))).otherwise(F.concat(trimmed(power[0]), F.lit("e"), power[1]))

    return let(x.cast("double"), whole)
