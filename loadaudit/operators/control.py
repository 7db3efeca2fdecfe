"""Control of evidence: states, stalls, allowances, budgets, retention."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import numbered

# Seconds a processor may hold an item, and an item may wait in the queue.
LEASE_S = 120
QUEUE_STALL_S = 600


def is_stalled(now_epoch: Column) -> Column:
    """Processing past its lease, or queued too long or since an unreadable time."""
    processing = (F.col("state") == "PROCESSING") & (F.coalesce("lease_until", F.lit(0)) < now_epoch)
    queued = (F.col("state") == "QUEUED") & F.coalesce(F.col("updated_at") + QUEUE_STALL_S < now_epoch, F.lit(True))
    return F.coalesce(processing | queued, F.lit(False))


# ------------------------------------------------------------------ stalls
# Error codes a retry cannot change, and the number of attempts.
FINAL_ERRORS = ["UNREADABLE_IMAGE", "PDF_TOO_MANY_PAGES", "FILE_TOO_LARGE", "IMAGE_TOO_LARGE", "CHANGED_AFTER_UPLOAD"]
MAX_ATTEMPTS = 3


def stalled(items: DataFrame, now_epoch: Column) -> DataFrame:
    """Adds ``stalled`` and ``retryable``. ``items`` has state, grp, attempts, error_code,
    vision_ran, lease_until and updated_at (epoch seconds)."""
    stuck = is_stalled(now_epoch)
    tries_left = F.coalesce("attempts", F.lit(0)) < MAX_ATTEMPTS
    failed = (F.col("state") == "FAILED") & ~F.coalesce(F.col("error_code").isin(FINAL_ERRORS), F.lit(False))
    unseen = (F.col("state") == "READY") & (F.col("grp") == "photo") & ~F.coalesce("vision_ran", F.lit(False))
    again = tries_left & ((F.col("grp").isin("photo", "slip") & stuck) | failed | unseen)
    return items.withColumns({"stalled": stuck, "retryable": F.coalesce(again, F.lit(False))})


# --------------------------------------------------------------- retention
LIFETIME_S = 48 * 3600
QUOTA_LIFETIME_S = 3 * 24 * 3600


def expire(rows: DataFrame, now_epoch: Column, created: str = "created_at", lifetime_s: int = LIFETIME_S) -> DataFrame:
    """Rows still kept: their lifetime since ``created`` (epoch seconds) is not over."""
    return rows.where(F.col(created) + lifetime_s > now_epoch)


# -------------------------------------------------------------- allowances
def admit_calls(calls: DataFrame, daily: DataFrame, per_case: DataFrame, order: list[str], bucket: Column) -> DataFrame:
    """Adds ``admitted``: the first calls per case and kind, then the first of those per
    day and kind. ``calls`` has case_id, kind, day; ``daily`` and ``per_case`` give a
    ``limit`` per kind; a limit of 0 or none admits nothing."""

    def within(df, keys, limits, flag):
        ranked = numbered(df, keys, order, bucket, "_k")
        capped = ranked.join(limits.select("kind", F.col("limit").alias("_limit")), "kind", "left")
        return capped.withColumn(flag, F.col("_k") <= F.coalesce("_limit", F.lit(0))).drop("_k", "_limit")

    first = within(calls, ["case_id", "kind"], per_case, "_case_ok")
    kept = within(first.where("_case_ok"), ["day", "kind"], daily, "admitted")
    refused = first.where(~F.col("_case_ok")).withColumn("admitted", F.lit(False))
    return kept.unionByName(refused).drop("_case_ok")


# ----------------------------------------------------------------- budgets
@dataclass
class Budget:
    max_files: int = 24
    max_bytes: int = 120 * 1024 * 1024
    group_files: dict[str, int] = field(default_factory=lambda: {"photo": 12, "slip": 6, "bill": 2, "trace": 4})


def admit_files(uploads: DataFrame, order: str, budget: Budget | None = None) -> DataFrame:
    """(case_id, order, admitted) of uploads (case_id, grp, size_bytes and the unique
    ``order``): each is admitted when a file slot, a slot of its group and its bytes are
    still free; a refused file uses nothing, so a later one may fit.

    One way for cases of every size: in ``max_files`` rounds each case takes the smallest ``order``
    behind its last one that still fits. What a round knows of a case is one short row (bytes and
    groups so far, and the orders taken), so a round is a join with these rows and an
    aggregation that starts where the uploads lie; no upload is gathered by case. Rounds
    are part of one frame: nothing runs while it is built."""
    b = budget or Budget()
    caps = F.create_map(*[F.lit(x) for kv in b.group_files.items() for x in kv])
    marked = uploads.where(F.col("size_bytes") <= b.max_bytes).where(F.coalesce(F.try_element_at(caps, F.col("grp")), F.lit(0)) > 0)
    marked = marked.select("case_id", "grp", F.col("size_bytes").cast("bigint").alias("size"), F.col(order).cast("bigint").alias("o"))
    begin = F.struct(
        F.lit(0).cast("bigint").alias("bytes"), F.array().cast("array<bigint>").alias("taken"), F.array().cast("array<string>").alias("groups")
    )
    state = marked.select("case_id").distinct().withColumn("s", begin)
    for _ in range(b.max_files):
        s = F.col("s")
        used = F.size(F.filter(s["groups"], lambda g: g == F.col("grp")))
        later = F.coalesce(F.col("o") > F.element_at(s["taken"], F.when(F.size(s["taken"]) > 0, -1)), F.lit(True))
        fits = later & (s["bytes"] + F.col("size") <= b.max_bytes) & (used < F.try_element_at(caps, F.col("grp")))
        found = marked.join(state, "case_id").groupBy("case_id").agg(
            F.any_value("s").alias("s"), F.min(F.when(fits, F.struct("o", "grp", "size"))).alias("f")
        )
        grown = F.struct(
            (s["bytes"] + F.col("f.size")).alias("bytes"), F.concat(s["taken"], F.array("f.o")).alias("taken"), F.concat(s["groups"], F.array("f.grp")).alias("groups")
        )
        state = found.select("case_id", F.when(F.col("f").isNull(), s).otherwise(grown).alias("s"))
    taken = state.select("case_id", F.explode("s.taken").alias("_o")).withColumn("admitted", F.lit(True))
    flags = taken.withColumnRenamed("case_id", "_case")
    rows = uploads.select("case_id", order)
    joined = rows.join(flags, (rows["case_id"] == flags["_case"]) & (rows[order].cast("bigint") == flags["_o"]), "left")
    return joined.select("case_id", order, F.coalesce("admitted", F.lit(False)).alias("admitted"))


# ------------------------------------------------------------------ states
# The states of an evidence item and the moves between them.
STATES = ["UPLOADING", "UPLOADED", "QUEUED", "PROCESSING", "READY", "FAILED", "REJECTED"]
MOVES = {
    "UPLOADING": ["UPLOADED", "READY", "REJECTED"],
    "UPLOADED": ["UPLOADED", "QUEUED", "READY", "REJECTED"],
    "QUEUED": ["PROCESSING", "UPLOADED", "QUEUED"],
    "PROCESSING": ["READY", "FAILED", "QUEUED", "PROCESSING"],
    "READY": ["QUEUED"],
    "FAILED": ["QUEUED"],
    "REJECTED": [],
}
DIRECT_GROUPS = ["trace", "bill"]


def _legal(start: Column, target: Column, grp: Column) -> Column:
    """May an item move from ``start`` to ``target``? Traces and bills become READY at
    once and are never queued; photos and slips must be processed first."""
    moves = F.create_map(*[x for s, targets in MOVES.items() for x in (F.lit(s), F.array(*[F.lit(t) for t in targets]).cast("array<string>"))])
    listed = F.coalesce(F.array_contains(F.try_element_at(moves, start), target), F.lit(False))
    direct = grp.isin(DIRECT_GROUPS)
    early = start.isin("UPLOADING", "UPLOADED") & (target == "READY")
    return listed & F.when(direct, ~target.isin("QUEUED", "PROCESSING", "FAILED")).otherwise(~early)


#: Buckets of an item that are folded together; the blocks are folded in turn.
FOLD_BLOCK = 256


def evidence_state(log: DataFrame, order: str, bucket: Column) -> tuple[DataFrame, DataFrame]:
    """(latest legal state per item, illegal moves) of a log of item_id, grp, state.

    An item begins UPLOADING. An illegal move is listed and leaves the state alone.
    Each bucket of an item's log is folded to a map from any state to the state after
    it; the maps of an item are then folded in order, block by block, each once. So a long
    log is spread over its buckets and no item is replayed as a whole."""
    rows = log.select("item_id", "grp", F.col(order).alias("_o"), F.col("state").alias("_to"), bucket.alias("_bucket"))
    moves = F.array_sort(F.collect_list(F.struct(F.col("_o").alias("o"), F.col("_to").alias("to"))))
    chunks = rows.groupBy("item_id", "grp", "_bucket").agg(moves.alias("_moves"))

    def after(start):
        return F.aggregate("_moves", start, lambda s, m: F.when(_legal(s, m["to"], F.col("grp")), m["to"]).otherwise(s))

    table = F.map_from_arrays(F.array(*[F.lit(s) for s in STATES]), F.array(*[after(F.lit(s)) for s in STATES]))
    mapped = chunks.withColumn("_table", table)
    # One short map per bucket: the only thing gathered per item.
    paths = mapped.groupBy("item_id", "grp").agg(F.array_sort(F.collect_list(F.struct(F.col("_bucket").alias("b"), F.map_entries("_table").alias("t")))).alias("_path"))

    def after_step(s, x):
        return F.coalesce(F.try_element_at(F.map_from_entries(x["t"]), s), s)

    def run(steps, start):
        return F.aggregate(steps, start, after_step)

    def listed(steps, start, kind, item, after):
        """The items made of each step and the state before it."""
        begin = F.struct(start.alias("s"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(
            steps, begin, lambda acc, x: F.struct(after(acc["s"], x).alias("s"), F.concat(acc["out"], F.array(item(acc["s"], x))).alias("out")), lambda acc: acc["out"]
        )

    latest = paths.select("item_id", "grp", run(F.col("_path"), F.lit("UPLOADING")).alias("state"))
    path_type = paths.schema["_path"].dataType.simpleString()
    bucket_type = paths.schema["_path"].dataType.elementType["b"].dataType.simpleString()
    firsts = F.sequence(F.lit(1), F.size("_path"), F.lit(FOLD_BLOCK))
    blocks = paths.withColumn("_blocks", F.transform(firsts, lambda i: F.slice("_path", i, FOLD_BLOCK)))
    entered = listed(
        F.col("_blocks"), F.lit("UPLOADING"), f"struct<s:string,steps:{path_type}>", lambda s, block: F.struct(s.alias("s"), block.alias("steps")), lambda s, block: run(block, s)
    )
    entered = blocks.select("item_id", "grp", F.explode(entered).alias("_e"))
    starts = entered.select(
        "item_id", "grp",
        F.explode(listed(
            F.col("_e.steps"), F.col("_e.s"), f"struct<_bucket:{bucket_type},_start:string>", lambda s, x: F.struct(x["b"].alias("_bucket"), s.alias("_start")), after_step
        )).alias("_s"),
    ).select("item_id", "grp", "_s.*")
    opened = chunks.join(starts, ["item_id", "grp", "_bucket"])
    begin = F.struct(F.col("_start").alias("s"), F.array().cast("array<struct<o:bigint,from:string,to:string>>").alias("bad"))

    def step(acc, m):
        ok = _legal(acc["s"], m["to"], F.col("grp"))
        refused = F.struct(m["o"].cast("bigint").alias("o"), acc["s"].alias("from"), m["to"].alias("to"))
        return F.struct(F.when(ok, m["to"]).otherwise(acc["s"]).alias("s"), F.when(ok, acc["bad"]).otherwise(F.concat(acc["bad"], F.array(refused))).alias("bad"))

    illegal = opened.select("item_id", F.explode(F.aggregate("_moves", begin, step, lambda acc: acc["bad"])).alias("_b"))
    return latest, illegal.select("item_id", F.col("_b.o").alias(order), F.col("_b.from").alias("from_state"), F.col("_b.to").alias("to_state"))
