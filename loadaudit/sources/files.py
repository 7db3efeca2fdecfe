"""Object listings: what a key says, what the bytes are, what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Key layouts, file signatures.
KINDS = {"photos/": "PHOTO", "slips/": "SLIP", "traces/": "TRACE"}
PHOTO_KEY = r"^photos/([^/]+)/drain([^/]+)/(before|after|load)-([^.]+)\."
SLIP_KEY = r"^slips/([^/]+)/([^-/]+)-([^.]+)\."
TRACE_KEY = r"^traces/([^/]+)/([^-/]+)-([^.]+)\."
JPEG, PNG, PDF = "FFD8FF", "89504E470D0A1A0A", "255044462D"
PDF_PAGE = r"/Type\s*/Page(?![a-zA-Z])"
HEAD = 64


def _group(c: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))


def key_fields(df: DataFrame, key: str = "key") -> DataFrame:
    """Adds kind, bill_id, drain_id, trip_no and role; a key off the convention keeps
    its kind and has nulls for the rest."""
    k = F.col(key)
    kind = F.when(F.lit(False), F.lit(""))
    for prefix, name in KINDS.items():
        kind = kind.when(k.startswith(prefix), F.lit(name))
    kind = kind.otherwise(F.lit("UNKNOWN"))
    photo, slip = k.startswith("photos/"), k.startswith("slips/")

    def pick(i_photo, i_trip):
        of_photo = _group(k, PHOTO_KEY, i_photo) if i_photo else F.lit(None)
        of_trip = F.when(slip, _group(k, SLIP_KEY, i_trip)).otherwise(_group(k, TRACE_KEY, i_trip)) if i_trip else F.lit(None)
        return F.when(photo, of_photo).otherwise(of_trip).cast("string")

    return df.withColumns(
        {"kind": kind, "bill_id": pick(1, 1), "drain_id": pick(2, 2), "trip_no": pick(None, 3), "role": pick(3, None)}
    )


def evidence_paths(spark: SparkSession, root: str) -> DataFrame:
    """Every object below ``root`` with its key's fields; contents are not read."""
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select("path", "length", "modificationTime")
    )
    key = F.regexp_extract("path", r"/((?:photos|slips|traces)/.*)$", 1)
    return key_fields(listed.withColumn("key", F.coalesce(F.nullif(key, F.lit("")), F.col("path"))))


def content_digest(df: DataFrame, content: str = "content") -> DataFrame:
    return df.withColumns({"sha256": F.sha2(F.col(content), 256), "size": F.length(content).cast("bigint")})


def signature_ok(content_type: Column, content: Column) -> Column:
    """Does the file begin like its declared type?"""
    head = F.substring(content, 1, HEAD)
    begins = F.hex(head)
    # Whole bytes only: the marker and white space may precede the bracket.
    is_json = begins.rlike("^(?:EF|BB|BF|20|09|0D|0A)*(?:7B|5B)")
    return (
        F.when(content_type == "image/jpeg", begins.startswith(JPEG))
        .when(content_type == "image/png", begins.startswith(PNG))
        .when(content_type == "application/pdf", begins.startswith(PDF))
        .when(content_type.isin("application/json", "application/geo+json"), is_json)
        .otherwise(F.lit(False))
    )


def signature_audit(files: DataFrame) -> DataFrame:
    """Adds ``signature_ok`` to rows of content_type and content."""
    return files.withColumn("signature_ok", signature_ok(F.col("content_type"), F.col("content")))


def pdf_pages(files: DataFrame) -> DataFrame:
    """Adds ``pages``, a rough count over the whole file; 0 means unknown."""
    return files.withColumn("pages", F.regexp_count(F.decode("content", "ISO-8859-1"), F.lit(PDF_PAGE)))


def changed_objects(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Objects that no longer are what was registered: another size, or bytes that do
    not fit the registered type."""
    now = files.select("key", "content")
    joined = registry.select("key", "declared_size", "content_type").join(now, "key")
    other_size = F.length("content") != F.col("declared_size")
    return joined.where(other_size | ~signature_ok(F.col("content_type"), F.col("content"))).select("key")


def canonical_keys(items: DataFrame) -> DataFrame:
    """Adds ``ok``: the key is exactly that of this bill's and drain's image, and the
    item's recorded owner does not say otherwise.

    ``items`` has key, kind (photo or slip), bill_id, drain_id, owner_bill, owner_drain."""
    bill, drain, key = F.col("bill_id"), F.col("drain_id"), F.col("key")
    named = bill.rlike("^[A-Za-z0-9_-]{1,32}$") & drain.rlike("^[A-Za-z0-9_-]{1,32}$")
    photo_tail = F.substring(key, F.length(F.concat(F.lit("photos/"), bill, F.lit("/drain"), drain, F.lit("/"))) + 1, F.lit(4096))
    photo = key.startswith(F.concat(F.lit("photos/"), bill, F.lit("/drain"), drain, F.lit("/"))) & photo_tail.rlike(
        r"^(before|after|load)-[A-Za-z0-9_-]{1,32}\.(jpe?g|png)\z"
    )
    slip_tail = F.substring(key, F.length(F.concat(F.lit("slips/"), bill, F.lit("/"), drain, F.lit("-"))) + 1, F.lit(4096))
    slip = key.startswith(F.concat(F.lit("slips/"), bill, F.lit("/"), drain, F.lit("-"))) & slip_tail.rlike(
        r"^[0-9]{3}\.(png|jpe?g)\z"
    )
    owned = F.coalesce(F.col("owner_bill") == bill, F.lit(True)) & F.coalesce(F.col("owner_drain") == drain, F.lit(True))
    fits = F.when(F.col("kind") == "photo", photo).when(F.col("kind") == "slip", slip).otherwise(F.lit(False))
    return items.withColumn("ok", F.coalesce(owned & named & fits, F.lit(False)))
