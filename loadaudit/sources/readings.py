"""Raw service answers as rows: slip readings, vision verdicts, routes, camera tags.
Every answer is parsed within its own row; nothing is joined or shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock, coerce, geo, text
from ..functions.binding import let, let_all
from ..functions.rounding import round_half_even

# Query aliases with their field names, the verdict tool and its enum.
FIELDS = {
    "TICKET_NO": "ticketNo", "VEHICLE_NO": "vehicleNo", "GROSS_WEIGHT": "gross", "TARE_WEIGHT": "tare",
    "NET_WEIGHT": "net", "TIME_IN": "timeIn", "TIME_OUT": "timeOut", "SITE": "site",
}
LOW_CONFIDENCE = 80.0
VERDICT_TOOL = "record_photo_check"
LOAD_TYPES = ["silt", "debris", "unclear"]
NOTES_MAX = 500

OCR_DDL = (
    "struct<Blocks:array<struct<BlockType:string,Id:string,Query:struct<Alias:string>,"
    "Relationships:array<struct<Type:string,Ids:array<string>>>,Text:string,Confidence:double>>>"
)


# -------------------------------------------------------------------- slips
def _answers(content: Column) -> Column:
    """``array<struct<alias,best struct<confidence,turn,text>>>`` of one response."""
    blocks = F.from_json(content, OCR_DDL)["Blocks"]

    def best_answer(query, backwards, all_blocks):
        ids = F.flatten(
            F.transform(
                F.filter(query["Relationships"], lambda r: r["Type"] == "ANSWER"),
                lambda r: F.coalesce(r["Ids"], F.array().cast("array<string>")),
            )
        )
        answers = F.transform(
            F.transform(ids, lambda i: let(F.array_position(backwards, i), lambda p: F.when(p > 0, F.get(all_blocks, F.size(all_blocks) - p.cast("int"))))),
            lambda b, i: F.struct(
                F.coalesce(b["Confidence"], F.lit(0.0)).alias("confidence"), (-i).alias("turn"), text.strip(b["Text"]).alias("text")
            ),
        )
        return F.array_max(F.filter(answers, lambda a: F.length(a["text"]) > 0))

    def answers_of(v):
        queries = F.filter(v["blocks"], lambda b: (b["BlockType"] == "QUERY") & (F.length(b["Query"]["Alias"]) > 0))
        return F.transform(
            queries, lambda q: F.struct(q["Query"]["Alias"].alias("alias"), best_answer(q, v["ids"], v["blocks"]).alias("best"))
        )

    def last_of_alias(found):
        names = F.reverse(F.transform(found, lambda a: a["alias"]))
        return let(names, lambda n: F.filter(found, lambda a, i: F.array_position(n, a["alias"]) == F.size(found) - i))

    # Ids from the last block to the first: a repeated id means its last block.
    indexed = let(blocks, lambda b: let_all(answers_of, blocks=b, ids=F.reverse(F.transform(b, lambda x: x["Id"]))))
    return let(indexed, last_of_alias)


def ocr_answers(docs: DataFrame, content: str = "content", keep: tuple[str, ...] = ("doc",)) -> DataFrame:
    """(doc, alias, text, confidence): per query the non-empty answer of highest
    confidence, the first on a tie; a query without one keeps nulls. A later query of
    the same alias replaces an earlier one."""
    rows = docs.select(*keep, F.explode(_answers(F.col(content))).alias("a"))
    return rows.select(*keep, "a.alias", F.col("a.best.text").alias("text"), F.col("a.best.confidence").alias("confidence"))


def slip_records(answers: DataFrame, keys: tuple[str, ...] = ("doc",)) -> DataFrame:
    """One row per document with eight typed fields
    ``struct<value,raw,confidence,ok,low_confidence,derived>``, the sorted names of the
    missing and the doubtful ones, and the mean confidence of the readable ones."""
    wide = answers.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("alias") == alias, F.struct(F.col("text").alias("raw"), "confidence"))).alias(f"_{name}")
            for alias, name in FIELDS.items()
        ]
    )
    return _typed(wide, keys)


def read_slips(docs: DataFrame, content: str = "content", keep: tuple[str, ...] = ("doc",)) -> DataFrame:
    """Slip records straight from the responses: within each row, without a shuffle."""
    found = docs.select(*keep, _answers(F.col(content)).alias("_found"))

    def answer(alias):
        best = F.get(F.filter("_found", lambda a: a["alias"] == alias), F.lit(0))["best"]
        return F.struct(best["text"].alias("raw"), best["confidence"].alias("confidence"))

    return _typed(found.select(*keep, *[answer(alias).alias(f"_{name}") for alias, name in FIELDS.items()]), keep)


def _typed(wide: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    readers = {
        "ticketNo": text.clean_text, "vehicleNo": text.parse_plate, "gross": text.parse_weight_t,
        "tare": text.parse_weight_t, "net": text.parse_weight_t, "timeIn": text.parse_hhmm,
        "timeOut": text.parse_hhmm, "site": text.clean_text,
    }

    def field(name, value):
        raw = F.col(f"_{name}.raw")
        confidence = round_half_even(F.coalesce(F.when(raw.isNotNull(), F.col(f"_{name}.confidence")), F.lit(0.0)), 2)
        return F.struct(
            value.alias("value"), raw.alias("raw"), confidence.alias("confidence"), value.isNotNull().alias("ok"),
            (raw.isNotNull() & (confidence < LOW_CONFIDENCE)).alias("low_confidence"), F.lit(None).cast("string").alias("derived"),
        )

    typed = wide.withColumns({f"v_{n}": read(F.col(f"_{n}.raw")) for n, read in readers.items()})
    fields = typed.select(*keys, *[field(n, F.col(f"v_{n}")).alias(n) for n in FIELDS.values()])
    computed = F.struct(
        round_half_even(F.col("gross.value") - F.col("tare.value"), 3).alias("value"),
        F.lit(None).cast("string").alias("raw"),
        F.least("gross.confidence", "tare.confidence").alias("confidence"),
        F.lit(True).alias("ok"),
        F.lit(True).alias("low_confidence"),
        F.lit("gross-tare").alias("derived"),
    )
    recoverable = F.col("net.value").isNull() & (F.col("gross.value") > F.col("tare.value"))
    fields = fields.withColumn("net", F.when(recoverable, computed).otherwise(F.col("net")))

    def names(condition):
        hits = [F.when(condition(F.col(n)), F.lit(n)) for n in FIELDS.values()]
        return F.array_sort(F.array_compact(F.array(*hits)))

    sure = F.array_compact(F.array(*[F.when(F.col(n)["ok"], F.col(n)["confidence"]) for n in FIELDS.values()]))
    mean = let(
        sure,
        lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a)).otherwise(F.lit(0.0)),
    )
    return fields.withColumns(
        {
            "missing_fields": names(lambda f: ~f["ok"]),
            "low_confidence_fields": names(lambda f: f["low_confidence"]),
            "confidence_avg": round_half_even(mean, 2),
        }
    )


def slip_rows(records: DataFrame, key: str = "doc") -> DataFrame:
    """Slip records flattened to the ``slips`` table of the rules."""
    return records.select(
        F.col(key).alias("s3_key"), F.lit("OK").alias("status"), F.lit(None).cast("string").alias("error"),
        F.col("ticketNo.value").alias("ticket_no"), F.col("vehicleNo.value").alias("vehicle_no"),
        F.col("gross.value").alias("gross"), F.col("tare.value").alias("tare"), F.col("net.value").alias("net"),
        F.col("timeIn.value").alias("time_in"), F.col("timeOut.value").alias("time_out"), F.col("site.value").alias("site"),
        "missing_fields", F.col("net.derived").alias("net_derived"),
    )


# ------------------------------------------------------------------- vision
def vision_verdicts(raw: DataFrame, content: str = "content", keep: tuple[str, ...] = ("doc",)) -> DataFrame:
    """(doc, cleared, load_type, confidence, notes, ok, source, problems) of raw model
    answers: the tool's input, else JSON inside prose, else unusable. Never fails."""

    def is_object(v):
        return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))

    def tool_input(blocks):
        # The first use of the tool whose input is an object.
        inputs = F.transform(
            blocks,
            lambda b: F.when(
                F.try_variant_get(b, "$.toolUse.name", "string") == VERDICT_TOOL, F.try_variant_get(b, "$.toolUse.input", "variant")
            ),
        )
        return F.get(F.filter(inputs, is_object), F.lit(0))

    def prose(blocks):
        parts = F.transform(blocks, lambda b: F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit("")))
        return text.strip(F.array_join(parts, ""))

    def inside(words):
        fenced = F.nullif(F.regexp_extract(words, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
        braces = F.nullif(F.regexp_extract(words, r"(?s)\{.*\}", 0), F.lit(""))
        return let(F.try_parse_json(F.coalesce(fenced, braces)), lambda v: F.when(is_object(v), v))

    def judged(v):
        payload = F.coalesce(v["tool"], v["found"])
        notes = F.try_variant_get(payload, "$.notes", "variant")
        load = F.try_variant_get(payload, "$.load_type", "variant")
        return let_all(
            verdict,
            none=payload.isNull(),
            source=F.when(v["tool"].isNotNull(), F.lit("tool_use")).when(v["found"].isNotNull(), F.lit("text_json")).otherwise(F.lit("none")),
            words=v["words"],
            cleared=coerce.coerce_bool(F.try_variant_get(payload, "$.cleared", "variant")),
            confidence=coerce.coerce_confidence(F.try_variant_get(payload, "$.confidence", "variant")),
            load=F.when(coerce.kind_of(load) == "text", F.lower(text.strip(F.try_variant_get(payload, "$.load_type", "string")))),
            notes_ok=F.coalesce(coerce.kind_of(notes) == "text", F.lit(False)),
            notes=F.when(coerce.kind_of(notes) == "text", F.try_variant_get(payload, "$.notes", "string")).otherwise(
                F.when(F.schema_of_variant(notes) != "VOID", text.spaced_json(F.to_json(notes), NOTES_MAX))
            ),
        )

    def verdict(v):
        known = F.coalesce(v["load"].isin(LOAD_TYPES), F.lit(False))
        problems = F.array_compact(
            F.array(
                F.when(~v["cleared"]["ok"], F.lit("cleared_not_boolean")),
                F.when(~known, F.lit("load_type_out_of_enum")),
                F.when(~v["confidence"]["ok"], F.lit("confidence_not_a_number")),
                F.when(~v["notes_ok"], F.lit("notes_not_a_string")),
            )
        )
        unusable = F.coalesce(F.nullif(F.substring(v["words"], 1, NOTES_MAX), F.lit("")), F.lit("Model returned no usable answer."))
        notes = F.substring(text.strip(F.coalesce(v["notes"], F.lit(""))), 1, NOTES_MAX)
        return F.struct(
            (~v["none"] & v["cleared"]["value"]).alias("cleared"),
            F.when(~v["none"] & known, v["load"]).otherwise(F.lit("unclear")).alias("load_type"),
            F.when(v["none"], F.lit(0.0)).otherwise(v["confidence"]["value"]).alias("confidence"),
            F.when(v["none"], unusable).otherwise(notes).alias("notes"),
            (~v["none"] & (F.size(problems) == 0)).alias("ok"),
            v["source"].alias("source"),
            F.when(v["none"], F.array(F.lit("no_structured_output"))).otherwise(problems).alias("problems"),
        )

    def read(blocks):
        return let_all(
            lambda v: let_all(judged, tool=v["tool"], words=v["words"], found=F.when(v["tool"].isNull(), inside(v["words"]))),
            tool=tool_input(blocks), words=F.coalesce(prose(blocks), F.lit("")),
        )

    blocks = F.try_variant_get(F.try_parse_json(F.col(content)), "$.output.message.content", "array<variant>")
    return raw.select(*keep, let(blocks, read).alias("_v")).select(*keep, "_v.*")


# ------------------------------------------------------------------- routes
ROUTE_DDL = (
    "struct<Summary:struct<Distance:double,Duration:double>,"
    "Legs:array<struct<VehicleLegDetails:struct<Summary:struct<Overview:struct<Distance:double,Duration:double>>>>>>"
)
_NODES = "array<struct<path:array<int>,json:string>>"


def _line_strings(json: Column) -> Column:
    """``array<string>``: every non-empty ``Geometry.LineString`` at any depth of a JSON
    text, an object's own before those of its members, else in the order of the text.

    Each step opens the objects and arrays of one level; what a ``Geometry`` holds is not
    searched. Objects are read as maps of texts, which keep the order of their members."""

    def node(path, value):
        return F.struct(path.alias("path"), value.alias("json"))

    def opened(n):
        members = F.when(n["json"].startswith("{"), F.from_json(n["json"], "map<string,string>"))
        items = F.when(n["json"].startswith("["), F.from_json(n["json"], "array<string>"))
        named = F.transform(F.map_entries(members), lambda e: F.when(e["key"] != "Geometry", e["value"]))
        children = F.transform(F.coalesce(named, items, F.array().cast("array<string>")), lambda v, i: node(F.concat(n["path"], F.array(i)), v))
        line = F.get_json_object(F.try_element_at(members, F.lit("Geometry")), "$.LineString")
        return F.struct(
            F.filter(children, lambda c: c["json"].startswith("{") | c["json"].startswith("[")).alias("below"),
            F.when(line.rlike(r"^\[\s*[^\s\]]"), node(F.concat(n["path"], F.array(F.lit(-1))), line)).alias("line"),
        )

    def step(acc):
        each = F.transform(acc["open"], opened)
        return let(
            each,
            lambda found: F.struct(
                F.flatten(F.transform(found, lambda x: x["below"])).alias("open"),
                F.concat(acc["lines"], F.array_compact(F.transform(found, lambda x: x["line"]))).alias("lines"),
            ),
        )

    # A level takes a bracket; those of bare points hold no level below them.
    brackets = F.regexp_replace(F.regexp_replace(json, r"\[[-+0-9.eE,\s]*\]", ""), r"[^\[{]", "")
    none = F.array().cast(_NODES)
    start = F.struct(F.array(node(F.array().cast("array<int>"), json)).alias("open"), none.alias("lines"))
    levels = F.sequence(F.lit(0), F.length(brackets))
    walked = F.aggregate(levels, start, lambda acc, _: F.when(F.size(acc["open"]) > 0, step(acc)).otherwise(acc), lambda acc: acc["lines"])
    return F.transform(F.array_sort(walked), lambda n: n["json"])


def route_points(raw: DataFrame, content: str = "content", keep: tuple[str, ...] = ("doc",)) -> DataFrame:
    """(doc, points, distance_m, duration_s, ok) of route answers: the points of every
    geometry of the first route, wherever it lies; consecutive repeats dropped, also across
    geometries; distance and duration of the route, else of a leg."""

    def read(v):
        lines = F.transform(_line_strings(v["json"]), lambda t: F.coalesce(F.from_json(t, "array<array<double>>"), F.array().cast("array<array<double>>")))
        valid = F.filter(F.flatten(lines), lambda p: F.size(p) >= 2)
        points = F.transform(valid, lambda p: geo.pt(F.get(p, F.lit(0)), F.get(p, F.lit(1))))
        kept = let(points, lambda ps: F.filter(ps, lambda p, i: (i == 0) | (p != F.get(ps, i - 1))))

        def of_legs(name):
            values = F.transform(v["route"]["Legs"], lambda leg: leg["VehicleLegDetails"]["Summary"]["Overview"][name])
            return F.coalesce(v["route"]["Summary"][name], F.get(F.array_compact(values), F.lit(0)))

        return F.struct(kept.alias("points"), of_legs("Distance").alias("distance_m"), of_legs("Duration").alias("duration_s"))

    first = F.get_json_object(F.col(content), "$.Routes[0]")
    found = let(first, lambda t: let_all(read, json=t, route=F.from_json(t, ROUTE_DDL)))
    rows = raw.select(*keep, found.alias("_r")).select(*keep, "_r.*")
    return rows.withColumn("ok", F.coalesce(F.size("points") >= 2, F.lit(False)))


# -------------------------------------------------------------- camera tags
def photo_facts(tags: DataFrame, keep: tuple[str, ...] = ("s3_key",)) -> DataFrame:
    """(key, lat, lon, timestamp, has_gps, has_timestamp, problems) from decoded camera
    tags: has_exif, original, digitized, modified, offset, has_gps_tags,
    ``gps_lat``/``gps_lon`` as ``array<double>`` of degrees, minutes, seconds, and
    ``gps_lat_ref``/``gps_lon_ref``. A photo without tags is kept and marked."""

    def degrees(name):
        parts = F.col(name)
        value = clock.dms_deg(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), F.coalesce(f"{name}_ref", F.lit("")))
        return F.when(F.size(parts) >= 3, value)

    has_exif = F.coalesce("has_exif", F.lit(False))
    read = tags.withColumns(
        {
            "_t": F.when(
                has_exif,
                F.coalesce(*[clock.exif_time(F.col(c), F.col("offset")) for c in ("original", "digitized", "modified")]),
            ),
            "_lat": degrees("gps_lat"),
            "_lon": degrees("gps_lon"),
            "_tagged": has_exif & F.coalesce("has_gps_tags", F.lit(False)),
        }
    )
    lat, lon = F.col("_lat"), F.col("_lon")
    readable = F.col("_tagged") & lat.isNotNull() & lon.isNotNull()
    real = F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0)), F.lit(False))
    located = readable & real
    problems = F.array_compact(
        F.array(
            F.when(~has_exif, F.lit("no_exif")),
            F.when(has_exif & F.col("_t").isNull(), F.lit("no_timestamp")),
            F.when(has_exif & ~F.col("_tagged"), F.lit("no_gps")),
            F.when(F.col("_tagged") & ~readable, F.lit("gps_unparseable")),
            F.when(readable & ~real, F.lit("gps_out_of_range")),
        )
    )
    return read.select(
        *keep, F.when(located, lat).alias("lat"), F.when(located, lon).alias("lon"), F.col("_t").alias("timestamp"),
        located.alias("has_gps"), F.col("_t").isNotNull().alias("has_timestamp"), problems.alias("problems"),
    )
