"""Lists of files: photo manifests, upload requests, licensed sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.ordered import numbered

# Roles, limits per group, accepted licences.
ROLES = ["before", "after", "load"]
PHOTO_ROLES = ["before", "after", "current", "additional"]
MB = 1024 * 1024
GROUPS = {
    "photo": {"types": ["image/jpeg", "image/png"], "max_mb": 15, "max_files": 12},
    "slip": {"types": ["image/jpeg", "image/png", "application/pdf"], "max_mb": 10, "max_files": 6},
    "bill": {"types": ["application/pdf", "image/jpeg", "image/png"], "max_mb": 10, "max_files": 2},
    "trace": {"types": ["application/json", "application/geo+json"], "max_mb": 2, "max_files": 4},
}
SOURCE_COLUMNS = ["file", "drainId", "role", "sourceUrl", "author", "licence"]
LICENCES = ["CC0-1.0", "PDM-1.0", "CC-BY-2.0", "CC-BY-3.0", "CC-BY-4.0", "Unsplash", "Pexels"]


def _filled(name: str) -> Column:
    return text.strip(F.coalesce(F.col(name), F.lit("")))


def split_manifest(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rows, skipped rows): a row needs a filename, a drain and a known role."""
    clean = rows.withColumns(
        {"filename": _filled("filename"), "drainId": _filled("drainId"), "role": F.lower(_filled("role")), "note": _filled("note")}
    )
    usable = (F.col("filename") != "") & (F.col("drainId") != "") & F.col("role").isin(ROLES)
    return clean.where(usable), clean.where(~usable)


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.csv(path, header=True, comment="#", schema="filename string, drainId string, role string, note string")
    return split_manifest(rows)


def number_photos(rows: DataFrame, order: str, bucket: Column | None = None) -> DataFrame:
    """Adds ``sequence``: 1, 2, … per drain and role in manifest order."""
    return numbered(rows, ["drainId", "role"], [order], bucket if bucket is not None else F.floor(F.col(order) / 4096), "sequence")


def validate_uploads(rows: DataFrame) -> DataFrame:
    """Upload requests with the first failing ``code`` and its ``message`` (null when
    accepted), the settled role, type and file name. ``size`` is text as supplied."""
    group = F.col("group")
    kind = F.lower(text.strip(F.coalesce("content_type", F.lit(""))))
    kind = F.when(kind == "image/jpg", F.lit("image/jpeg")).otherwise(kind)
    size = F.col("size").try_cast("bigint")
    whole = F.coalesce(F.col("size").rlike(r"^-?[0-9]+$"), F.lit(False))
    role = F.coalesce("role", F.lit(""))
    settled = F.when((group == "photo") & (role == ""), F.lit("current")).otherwise(F.nullif(role, F.lit("")))

    def by_group(value):
        out = F.when(F.lit(False), value(GROUPS["photo"]))
        for name, spec in GROUPS.items():
            out = out.when(group == name, value(spec))
        return out

    typed = by_group(lambda spec: kind.isin(spec["types"]))
    cap = by_group(lambda spec: F.lit(spec["max_mb"]))
    accepted = by_group(lambda spec: F.lit(", ".join(sorted(spec["types"]))))
    cleaned = text.strip(F.regexp_replace(F.regexp_replace(F.coalesce("filename", F.lit("")), r"[\x00-\x1f\x7f]", " "), r"\s+", " "))
    too_long = F.length(cleaned) > 200
    steps = [
        (~F.coalesce(group.isin(list(GROUPS)), F.lit(False)), "UNSUPPORTED_GROUP", F.lit("group must be one of bill, photo, slip, trace")),
        (~F.coalesce(typed, F.lit(False)), "UNSUPPORTED_TYPE", F.concat(group, F.lit(" files must be one of "), accepted)),
        (~whole, "INVALID_REQUEST", F.lit("sizeBytes must be a whole number of bytes")),
        (size <= 0, "EMPTY_FILE", F.lit("the file is empty")),
        (size > cap * MB, "FILE_TOO_LARGE", F.concat(group, F.lit(" files can be at most "), cap.cast("string"), F.lit(" MB"))),
        ((group == "photo") & ~settled.isin(PHOTO_ROLES), "INVALID_ROLE", F.lit("photo role must be one of before, after, current, additional")),
        ((group != "photo") & (role != ""), "INVALID_ROLE", F.lit("only photos take a role")),
        (too_long, "INVALID_REQUEST", F.lit("filename must be text")),
    ]
    code = message = F.when(F.lit(False), F.lit(""))
    for condition, name, words in steps:
        code, message = code.when(condition, F.lit(name)), message.when(condition, words)
    name = F.substring(F.regexp_replace(F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("upload")), r"[\\/]", "_"), 1, 120)
    return rows.withColumns(
        {"code": code, "message": message, "settled_role": F.when(code.isNull(), settled), "settled_type": F.when(code.isNull(), kind),
         "settled_name": F.when(code.isNull(), name)}
    )


def slot_gaps(rows: DataFrame, slots: DataFrame, keys: tuple[str, ...] = ("drainId", "role")) -> tuple[DataFrame, DataFrame]:
    """(slots nothing fills, rows whose slot is unknown)."""
    keys = list(keys)
    return slots.join(rows, keys, "left_anti"), rows.join(slots, keys, "left_anti")


def audit_sources(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """(row_number, problem) for licensed photo sources: missing columns, licence,
    address, unknown slot, slot filled before, slot left empty, file used twice.
    ``rows`` has row_number and the source columns; a filled slot is the first row's."""
    filled = {c: _filled(c) for c in SOURCE_COLUMNS}
    clean = rows.withColumns(filled)
    where = F.format_string("row %s (%s)", F.col("row_number").cast("string"), F.coalesce(F.nullif(F.col("file"), F.lit("")), F.lit("no file")))
    missing = F.array_compact(F.array(*[F.when(F.col(c) == "", F.lit(c)) for c in SOURCE_COLUMNS]))
    clean = clean.withColumns({"_missing": missing, "_where": where})
    complete = clean.where(F.size("_missing") == 0)
    known = complete.join(slots.select("drainId", "role", F.lit(True).alias("_slot")), ["drainId", "role"], "left")
    firsts = known.where("_slot").groupBy("drainId", "role").agg(F.min("row_number").alias("_first"))
    placed = known.join(firsts, ["drainId", "role"], "left")
    slot = F.format_string("drain %s %s", F.col("drainId"), F.col("role"))
    told = F.array_compact(
        F.array(
            F.when(~F.col("licence").isin(LICENCES), F.concat("_where", F.lit(": licence '"), "licence", F.lit("' is not accepted (allowed: "), F.lit(", ".join(sorted(LICENCES))), F.lit(")"))),
            F.when(~F.col("sourceUrl").rlike("^https?://"), F.concat("_where", F.lit(": sourceUrl must be the page the photograph came from"))),
            F.when(F.col("_slot").isNull(), F.concat("_where", F.lit(": no generated photo for drain "), "drainId", F.lit(" role '"), "role", F.lit("'"))),
            F.when(F.col("row_number") > F.col("_first"), F.concat("_where", F.lit(": "), slot, F.lit(" is already filled by row "), F.col("_first").cast("string"))),
        )
    )
    by_row = placed.select("row_number", F.explode(told).alias("problem"))
    incomplete = clean.where(F.size("_missing") > 0).select(
        "row_number", F.concat("_where", F.lit(": missing "), F.array_join("_missing", ", ")).alias("problem")
    )
    empty = slots.join(complete, ["drainId", "role"], "left_anti").select(
        F.lit(None).cast("bigint").alias("row_number"), F.concat(F.lit("no photograph for "), slot).alias("problem")
    )
    twice = (
        clean.where(F.col("file") != "").groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        .select(F.lit(None).cast("bigint").alias("row_number"),
                F.concat("file", F.lit(" is used for more than one slot; each slot needs its own photograph")).alias("problem"))
    )
    return incomplete.unionByName(by_row).unionByName(empty).unionByName(twice)
