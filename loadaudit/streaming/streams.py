"""Structured Streaming forms.

A micro-batch reads itself and what it touches, never the history: pairs of photos come from
the state of a stream-stream join or, where bands are no index, from the stored hashes of their
groups, legs from the time cells of the new legs, runs and trace facts
from the few that are still open, items and evidence from the buckets of their keys. What a
batch finds is written under its batch id, so a batch that is repeated after a failure
replaces itself; readers put the pieces together. Late rows need no special case."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions import clock, hashing
from ..operators import control, photos as reuse, traces
from ..operators.ordered import neighbours
from ..plans.staging import stage
from ..sources import runs as published
from ..sources.files import key_fields
from ..sources.tables import ERROR_MAX, new_objects

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _start(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer).start()


def append_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", once: bool = False) -> StreamingQuery:
    """Every micro-batch as its own partition ``batch_id=…`` below ``path``."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return _start(stream, checkpoint, each, mode, once)


def newest(df: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each key from its latest batch."""
    rest = [c for c in df.columns if c not in (*keys, "batch_id")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_r")).select(*keys, "_r.*")


def _stored(spark: SparkSession, path: str, schema: StructType, *partitions: str) -> DataFrame:
    """What earlier batches wrote below ``path``, which may be nothing yet."""
    kinds = {"batch_id": LongType(), "bucket": IntegerType(), "cell": LongType()}
    whole = StructType([*schema.fields, *[StructField(p, kinds[p]) for p in partitions]])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(whole).option("basePath", path).parquet(path) if there else spark.createDataFrame([], whole)


# ------------------------------------------------------------------ ingest
ITEM = "key string, etag string, ts timestamp, status string, error string"
ITEM_BUCKETS = 64


def stream_ingest(objects: DataFrame, process: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Arriving objects (key, etag, ts): what is already stored as OK with the same etag is
    skipped, the rest is given to ``process``, which returns key, etag, ts and ``error`` (null: it
    went well). A content that failed is therefore tried again when it arrives again. Unknown
    kinds are ignored. A batch reads the items in the buckets of its own keys."""

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = key_fields(batch.groupBy("key", "etag").agg(F.max("ts").alias("ts"))).where(F.col("kind") != "UNKNOWN")
        arrived = stage(known.select("key", "etag", "ts", published.bucket_of(F.col("key"), ITEM_BUCKETS).alias("bucket")), "arrived")
        touched = [r.bucket for r in arrived.select("bucket").distinct().collect()]
        before = current_items(spark, path, before=batch_id, buckets=touched)
        done = process(new_objects(arrived.select("key", "etag", "ts"), before))
        error = F.substring("error", 1, ERROR_MAX)
        rows = done.select(
            "key", "etag", "ts", F.when(F.col("error").isNull(), F.lit("OK")).otherwise(F.lit("ERROR")).alias("status"), error.alias("error"),
            published.bucket_of(F.col("key"), ITEM_BUCKETS).alias("bucket"),
        )
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch_id={batch_id}")

    return _start(objects, checkpoint, each, "append", once)


def current_items(spark: SparkSession, path: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """One row per key: its item of the latest batch, of the latest object in it. An item that
    is OK is not replaced by a later failure of an older object of the same key."""
    rows = _stored(spark, path, StructType.fromDDL(ITEM), "batch_id", "bucket")
    if before is not None:
        rows = rows.where(F.col("batch_id") < before)
    if buckets is not None:
        rows = rows.where(F.col("bucket").isin(buckets))
    return rows.groupBy("key").agg(F.max_by(F.struct("etag", "ts", "status", "error"), F.struct("ts", "batch_id", "etag")).alias("_r")).select("key", "_r.*")


# --------------------------------------------------- summaries of open keys
def _merged(stream: DataFrame, part: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame], last: str, delay_s: float, path: str,
            checkpoint: str, once: bool) -> StreamingQuery:
    """Per batch: ``merge`` what is open with the ``part`` summaries of the batch; rows whose
    ``last`` time is ``delay_s`` behind the newest time ever seen are closed and leave, the others
    are the open rows that the next batch starts from. So a batch reads and keeps no more than
    what is open, whatever came before. A row that is later than that gives one more closed
    row, which the reader merges again."""

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = part(batch)
        kept = StructType([*new.schema.fields, StructField("_seen", LongType())])
        before = _stored(spark, f"{path}/open/batch_id={batch_id - 1}", kept) if batch_id else spark.createDataFrame([], kept)
        both = stage(merge(new.unionByName(before.where(F.col(last).isNotNull()).drop("_seen"))), "open")
        seen = max(
            (r[0] for r in (both.agg(F.max(F.unix_micros(last))).first(), before.agg(F.max("_seen")).first()) if r[0] is not None), default=None
        )
        if seen is None:
            both.withColumn("_seen", F.lit(None).cast("bigint")).write.mode("overwrite").parquet(f"{path}/open/batch_id={batch_id}")
            return
        over = F.unix_micros(last) < F.lit(seen - int(delay_s * 1_000_000))
        both.where(over).write.mode("overwrite").parquet(f"{path}/closed/batch_id={batch_id}")
        # A row of nulls keeps the newest time when nothing is open.
        mark = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in both.schema.fields])
        both.where(~over).unionByName(mark).withColumn("_seen", F.lit(seen)).write.mode("overwrite").parquet(f"{path}/open/batch_id={batch_id}")

    return _start(stream, checkpoint, each, "append", once)


def _all_merged(spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], last: str) -> DataFrame:
    opened = spark.read.parquet(f"{path}/open")
    newest_batch = opened.agg(F.max("batch_id")).first()[0]
    opened = opened.where((F.col("batch_id") == newest_batch) & F.col(last).isNotNull()).drop("_seen", "batch_id")
    closed = _stored(spark, f"{path}/closed", opened.schema, "batch_id").drop("batch_id")
    return merge(opened.unionByName(closed))


# ------------------------------------------------------------------ traces
KEYS = ("bill_id", "trace_key")


def runs_of(points: DataFrame, gap_s: float, keys=KEYS, bucket_us: int = traces.GAP_BUCKET_US) -> DataFrame:
    """Runs of fixes (``ts``) no more than ``gap_s`` apart: n, first_ts, last_ts. Built per
    time bucket first, so a hot trace is spread; its buckets' runs are merged."""
    bucket = F.floor(F.unix_micros("ts") / F.lit(bucket_us)).alias("_b")
    parts = points.where(F.col("ts").isNotNull()).groupBy(*keys, bucket, F.session_window("ts", f"{gap_s} seconds")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    return merge_runs(parts.select(*keys, "n", "first_ts", "last_ts"), gap_s, keys)


def merge_runs(runs: DataFrame, gap_s: float, keys=KEYS) -> DataFrame:
    """Runs that overlap or lie no more than ``gap_s`` apart become one."""
    order = Window.partitionBy(*keys).orderBy("first_ts", "last_ts")
    reached = F.max("last_ts").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = reached.isNull() | (F.unix_micros("first_ts") - F.unix_micros(reached) > F.lit(int(gap_s * 1_000_000)))
    marked = runs.withColumn("_new", starts.cast("int"))
    grouped = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "_run").agg(
        F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")
    ).drop("_run")


def stream_gaps(points: DataFrame, path: str, checkpoint: str, gap_s: float = 180, delay_s: float = 600, once: bool = False) -> StreamingQuery:
    """Runs of fixes. Only runs that may still grow are kept from batch to batch."""
    return _merged(points, lambda b: runs_of(b, gap_s), lambda r: merge_runs(r, gap_s), "last_ts", delay_s + gap_s, path, checkpoint, once)


def current_runs(spark: SparkSession, path: str, gap_s: float = 180) -> DataFrame:
    """All runs, closed and open."""
    return _all_merged(spark, path, lambda r: merge_runs(r, gap_s), "last_ts")


def gaps_of(runs: DataFrame, keys=KEYS, bucket_us: int = traces.GAP_BUCKET_US) -> DataFrame:
    """(keys, gap_s) between neighbouring runs of a trace."""
    stamped = runs.withColumns({"_a": F.unix_micros("first_ts"), "_z": F.unix_micros("last_ts")})
    near = neighbours(stamped, list(keys), ["_a"], F.floor(F.col("_a") / F.lit(bucket_us)), ["_z"])
    gap = (F.col("_a") - F.col("prev._z")) / F.lit(1_000_000.0)
    return near.where(F.col("prev").isNotNull()).select(*keys, gap.alias("gap_s"))


def _arrival(placed: DataFrame, keys) -> DataFrame:
    inside_seq = F.when(F.col("inside"), F.col("seq"))
    return placed.groupBy(*keys).agg(
        F.min(F.when(inside_seq.isNotNull(), F.struct(inside_seq.alias("seq"), F.col("ts").alias("ts")))).alias("entry"),
        F.max(F.struct("seq", "ts")).alias("final"),
        F.max("ts").alias("newest_ts"),
        F.count(F.lit(1)).alias("n"),
    )


def _merge_arrivals(facts: DataFrame, keys) -> DataFrame:
    return facts.groupBy(*keys).agg(F.min("entry").alias("entry"), F.max("final").alias("final"), F.max("newest_ts").alias("newest_ts"), F.sum("n").alias("n"))


def stream_arrivals(points: DataFrame, sites: DataFrame, path: str, checkpoint: str, keys=KEYS, delay_s: float = 86_400, once: bool = False) -> StreamingQuery:
    """First fix inside the site and latest fix per trace. The site table is static; its
    measured size decides how it is joined. Traces without a fix for ``delay_s`` are closed."""
    part = lambda b: _arrival(traces.points_in_site(b, sites), keys)
    return _merged(points, part, lambda f: _merge_arrivals(f, keys), "newest_ts", delay_s, path, checkpoint, once)


def current_arrivals(spark: SparkSession, path: str, keys=KEYS) -> DataFrame:
    facts = _all_merged(spark, path, lambda f: _merge_arrivals(f, keys), "newest_ts")
    return facts.select(
        *keys, F.col("entry.seq").alias("inside_seq"), F.col("entry.ts").alias("inside_ts"), F.col("final.ts").alias("last_ts"), "n"
    )


# ------------------------------------------------------------ turnaround
#: Legs are stored by cells of thirty days of their start.
CELL_US = 30 * 24 * 3600 * 1_000_000
TRUCK = ("bill_id", "vehicle_no")


def stream_turnaround(legs: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Pairs of neighbouring legs of a truck. A batch opens the time cells of its own legs,
    pairs the legs of every (truck, time bucket) it touches again, and stores the first and
    last leg of each of these buckets. ``current_turnaround`` pairs those across buckets,
    so a leg that arrives late changes both its neighbours however far they lie."""
    bucket = F.floor(F.col("start_us") / F.lit(traces.LEG_BUCKET_US))

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = stage(traces.timed_legs(batch, TRUCK).withColumn("cell", F.floor(F.col("start_us") / F.lit(CELL_US))), "legs")
        dealt = new.hint("rebalance", F.col("cell"))
        dealt.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/legs/batch_id={batch_id}")
        cells = [r.cell for r in new.select("cell").distinct().collect()]
        old = _stored(spark, f"{path}/legs", new.drop("cell").schema, "batch_id", "cell")
        old = old.where((F.col("batch_id") < batch_id) & F.col("cell").isin(cells)).drop("batch_id")
        touched = new.select(*TRUCK, bucket.alias("bucket")).distinct()
        legs_of = new.unionByName(old).drop("cell").withColumn("bucket", bucket).join(touched, [*TRUCK, "bucket"], "left_semi")
        inside = Window.partitionBy(*TRUCK, "bucket").orderBy("start_us", "leg_id")
        leg = F.struct("leg_id", "start_us", "end_us", "from_point", "to_point")
        near = legs_of.withColumns({"leg": leg, "next": F.lead(leg).over(inside)})
        near = stage(near.select(*TRUCK, "bucket", "leg", "next"), "near")
        pairs = near.where(F.col("next").isNotNull())
        pairs.write.mode("overwrite").parquet(f"{path}/pairs/batch_id={batch_id}")
        order = F.struct("leg.start_us", "leg.leg_id")
        edges = near.groupBy(*TRUCK, "bucket").agg(F.min_by("leg", order).alias("first"), F.max_by("leg", order).alias("last"))
        edges.write.mode("overwrite").parquet(f"{path}/edges/batch_id={batch_id}")

    return _start(legs, checkpoint, each, "append", once)


def current_turnaround(spark: SparkSession, path: str, speed_kmh: float = 40.0) -> DataFrame:
    """(truck, leg_id, other, minutes, km, kmh) of each leg and the next one of its truck that
    would take more than ``speed_kmh``."""
    edges = spark.read.parquet(f"{path}/edges")
    last = edges.groupBy(*TRUCK, "bucket").agg(F.max_by(F.struct("first", "last", "batch_id"), "batch_id").alias("_e")).select(*TRUCK, "bucket", "_e.*")
    across = Window.partitionBy(*TRUCK).orderBy("bucket")
    over = last.withColumn("next", F.lead("first").over(across)).where(F.col("next").isNotNull()).select(*TRUCK, F.col("last").alias("leg"), "next")
    inside = spark.read.parquet(f"{path}/pairs").join(last.select(*TRUCK, "bucket", "batch_id"), [*TRUCK, "bucket", "batch_id"], "left_semi")
    both = over.unionByName(inside.select(*TRUCK, "leg", "next"))
    found = both.select(*TRUCK, F.col("leg.leg_id").alias("leg_id"), traces.between(F.col("leg"), F.col("next"), F.col("next")).alias("after"))
    return found.where(F.col("after.kmh") > speed_kmh).select(*TRUCK, "leg_id", "after.*")


# ----------------------------------------------------------------- photos
def stream_reuse(photos: DataFrame, path: str, checkpoint: str, max_bits: int = reuse.MAX_BITS, bands: int = 4, keys=("bill_id",), once: bool = False) -> list[StreamingQuery]:
    """Pairs of near hashes as they appear, and the photos themselves.

    Distinct hashes are joined with themselves on (keys, band, value). The state of that join is
    the band index: a batch looks up and extends its own values only, and each pair comes once, in
    the batch of its later hash. Copies of one image never reach the join. The state is held in
    RocksDB unless the session names another store; it is one row for each probe of a distinct
    hash and stays as long as the stream.

    Bands that would not tell hashes apart are no index: every hash meets all of its group. There
    a batch compares its new hashes with each other and with the stored ones of its groups."""
    spark = photos.sparkSession
    names = [*keys, "s3_key", "drain_id", "timestamp", "p_hash"]
    valid = photos.where(hashing.is_hex(F.col("p_hash"))).select(*names)
    if reuse.meetings(max_bits, bands) >= 1:
        first = _compare_batches(valid, path, f"{checkpoint}/pairs", max_bits, list(keys), once)
        return [first, append_batches(valid, f"{path}/photos", f"{checkpoint}/photos", once=once)]
    hashes = valid.select(*keys, F.col("p_hash").alias("hash")).dropDuplicates([*keys, "hash"])
    pairs = reuse.meeting(hashes, hashes, list(keys), max_bits, bands)
    named = spark.conf.get(PROVIDER, None)
    default = named is None or named.endswith("HDFSBackedStateStoreProvider")
    if default:
        spark.conf.set(PROVIDER, ROCKSDB)
    try:
        first = append_batches(pairs, f"{path}/pairs", f"{checkpoint}/pairs", once=once)
    finally:
        if default:
            spark.conf.set(PROVIDER, named) if named else spark.conf.unset(PROVIDER)
    return [first, append_batches(valid, f"{path}/photos", f"{checkpoint}/photos", once=once)]


def _compare_batches(photos: DataFrame, path: str, checkpoint: str, max_bits: int, keys: list[str], once: bool) -> StreamingQuery:
    """Pairs of near hashes below ``path/pairs``, in both directions, where all hashes of a group
    are compared. Distinct hashes are kept below ``path/hashes``, dealt to buckets by their
    group: a batch opens the buckets of its own groups, drops the hashes that are there and
    compares the others."""

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        named = batch.select(*keys, F.col("p_hash").alias("hash")).dropna(subset=keys or None).distinct()
        arrived = stage(named.withColumn("bucket", F.pmod(F.xxhash64(F.lit(0), *keys), F.lit(published.BUCKETS)).cast("int")), "hashes")
        buckets = [r.bucket for r in arrived.select("bucket").distinct().collect()]
        stored = _stored(spark, f"{path}/hashes", named.schema, "batch_id", "bucket")
        old = stored.where((F.col("batch_id") < batch_id) & F.col("bucket").isin(buckets)).select(*keys, "hash")
        known = not old.isEmpty()
        if known:
            arrived = arrived.join(old, [*keys, "hash"], "left_anti")
        own = f"{path}/hashes/batch_id={batch_id}"
        published.spread(arrived).write.mode("overwrite").partitionBy("bucket").parquet(own)
        new = spark.read.schema(named.schema).parquet(own).select(*keys, "hash")
        pairs = reuse.every_pair(new, new, keys, max_bits)
        if known:
            pairs = pairs.unionByName(reuse.both_ways(reuse.every_pair(new, old, keys, max_bits), keys))
        pairs.write.mode("overwrite").parquet(f"{path}/pairs/batch_id={batch_id}")

    return _start(photos, checkpoint, each, "append", once)


def current_reuse(spark: SparkSession, path: str, keys=("bill_id",)) -> DataFrame:
    """Copies with their originals; an earlier photo that arrived late is the original of its
    copies."""
    photos, pairs = spark.read.parquet(f"{path}/photos"), spark.read.parquet(f"{path}/pairs")
    return reuse.originals(photos.drop("batch_id"), list(keys), pairs.select(*keys, "hash", "other"))


# ------------------------------------------------------ touched keys again
def reevaluate(stream: DataFrame, keys: list[str], evaluate: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
               partition_by: tuple[str, ...] = (), once: bool = False) -> StreamingQuery:
    """Keep every row below ``path/rows``; per batch, run ``evaluate`` over all rows of
    the keys it touches and keep the result below ``path/results``. For results that need a
    key's whole history; rows are dealt to buckets by key, and only touched buckets are read."""
    names, schema = stream.columns, stream.schema

    def number(df: DataFrame) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(published.BUCKETS)).cast("int")

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = stage(batch.withColumn("bucket", number(batch)), "rows")
        published.spread(new).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/batch_id={batch_id}")
        touched = new.select(*keys).distinct()
        touched.write.mode("overwrite").parquet(f"{path}/touched/batch_id={batch_id}")
        touched = spark.read.schema(touched.schema).parquet(f"{path}/touched/batch_id={batch_id}")
        buckets = [r.bucket for r in new.select("bucket").distinct().collect()]
        old = _stored(spark, f"{path}/rows", schema, "batch_id", "bucket").where((F.col("batch_id") < batch_id) & F.col("bucket").isin(buckets))
        rows = new.select(*names).unionByName(old.select(*names))
        evaluate(rows.join(touched, keys, "left_semi")).write.mode("overwrite").parquet(f"{path}/results/batch_id={batch_id}")

    return _start(stream, checkpoint, each, "append", once)


def current_results(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The results of each key from the last batch that touched it; a key whose last
    evaluation found nothing has no rows."""
    latest = spark.read.parquet(f"{path}/touched").groupBy(*keys).agg(F.max("batch_id").alias("batch_id"))
    return spark.read.parquet(f"{path}/results").join(latest, [*keys, "batch_id"], "left_semi").drop("batch_id")


def stream_states(log: DataFrame, path: str, checkpoint: str, order: str = "n", bucket: int = 4096, once: bool = False) -> StreamingQuery:
    """Latest legal state per evidence item from a transition log."""

    def evaluate(rows: DataFrame) -> DataFrame:
        return control.evidence_state(rows, order, F.floor(F.col(order) / bucket))[0]

    return reevaluate(log, ["item_id"], evaluate, path, checkpoint, once=once)


def stream_verify(changes: DataFrame, load: Callable[[SparkSession, DataFrame], object], write: Callable[[object], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Changed evidence (bill_id) re-verifies exactly the touched bills: ``load`` gives the
    evidence of those bills (``tables.load_case(spark, root, touched=…)`` opens their buckets
    alone), ``write`` audits it and publishes the result, which replaces those bills."""

    def each(batch: DataFrame, batch_id: int) -> None:
        touched = stage(batch.select("bill_id").distinct(), "touched")
        write(load(batch.sparkSession, touched))

    return _start(changes, checkpoint, each, "append", once)


def typed_points(points: DataFrame) -> DataFrame:
    """Adds ``ts`` from ISO text so that event-time operators can use it."""
    parts = clock.iso_parts(F.col("t"))
    return points.withColumn("ts", F.timestamp_micros(parts["epoch_us"]))
