"""Photo reuse: for every photo, the first earlier photo within a bit distance."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing

MAX_BITS = 12
#: Hashes of a block, about, when all pairs of a group are compared.
BLOCK = 16384
#: Cells that a group is counted in, so that no task has a large group whole.
CELLS = 64
#: At least so many pairs of two blocks are compared in the time of one pair that meets by a band
#: value (measured: 4 and 230 ns).
MEETING_COST = 10


def _widths(bands: int) -> list[int]:
    return [64 // bands + (1 if i < 64 % bands else 0) for i in range(bands)]


def _masks(width: int, radius: int) -> list[int]:
    """Every value of ``width`` bits with at most ``radius`` set."""
    return [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(width), k)]


def choose_bands(max_bits: int, hashes_per_group: int) -> int:
    """Band count with the least estimated work: probes written plus candidate pairs."""

    def work(bands):
        radius = max_bits // bands
        total = 0.0
        for width in _widths(bands):
            probes = sum(comb(width, k) for k in range((radius + 1) // 2 + 1))
            probes += sum(comb(width, k) for k in range(radius // 2 + 1))
            share = min(1.0, sum(comb(width, k) for k in range(radius + 1)) / 2**width)
            total += hashes_per_group * probes + share * hashes_per_group**2
        return total

    return min(range(2, 9), key=work)


def measured_group(hashes: DataFrame, keys: list[str]) -> int:
    """How many hashes a hash meets in its own group, on average: one aggregation of two
    numbers."""
    if not keys:
        return hashes.count()
    n = hashes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return int(n.agg(F.coalesce(F.sum(F.col("n").cast("double") * F.col("n")) / F.sum("n"), F.lit(0.0))).first()[0])


def near_hashes(hashes: DataFrame, keys: list[str], max_bits: int = MAX_BITS, bands: int | None = None,
                hashes_per_group: int | None = None) -> DataFrame:
    """Pairs ``(keys, hash, other)`` of distinct hashes within ``max_bits``, each hash with
    itself included; a pair comes from the first band where it meets. The number of bands
    follows the measured size of the groups unless ``hashes_per_group`` gives it.

    Exact: of ``bands`` bands, some band differs in at most ``max_bits // bands``
    bits, so the two sides, each varied by half of that, share a band value. The
    join key is (keys, hash length, band, value), and every hash appears once
    however many photos carry it. Where so many pairs share a band value that comparing all
    of a group costs less, all are compared."""
    base = hashes.select(*keys, "hash").where(hashing.is_hex(F.col("hash"))).distinct()
    if not bands:
        bands = choose_bands(max_bits, measured_group(base, keys) if hashes_per_group is None else hashes_per_group)
    if meetings(max_bits, bands) * MEETING_COST >= 1:
        pairs = every_pair(base, base, keys, max_bits)
    else:
        pairs = meeting(base, base, keys, max_bits, bands).distinct()
    # Pairs may be thousands of times what an estimate from their hashes sees: never broadcast.
    return pairs.unionAll(base.select(*keys, "hash", F.col("hash").alias("other"))).hint("merge")


def meetings(max_bits: int, bands: int) -> float:
    """How often two random hashes meet in the bands. From 1 on, bands compare more than all
    pairs of a group."""
    radius = max_bits // bands
    probes = lambda width, share: sum(comb(width, k) for k in range(share + 1))
    return sum(probes(w, (radius + 1) // 2) * probes(w, radius // 2) / 2**w for w in _widths(bands))


def _near(max_bits: int):
    """Whether two different hashes are near, from their first 64 bits: the test that discards
    nearly every candidate before the full comparison."""
    return F.bit_count(F.col("_bits").bitwiseXOR(F.col("_other_bits"))) <= max_bits


def _whole(max_bits: int):
    """The same for hashes of any length, of which the first 64 bits are near."""
    return (F.col("_len") <= 16) | (hashing.hamming_hex(F.col("hash"), F.col("other")) <= max_bits)


def meeting(hashes: DataFrame, others: DataFrame, keys: list[str], max_bits: int, bands: int) -> DataFrame:
    """Pairs (keys, hash, other) of two tables of distinct hashes, without a hash and itself,
    that are within ``max_bits``. Each pair comes from the first band where it meets, once for
    each way of meeting there; a plain equi-join, so the tables may also be streams. Bands too wide
    to tell hashes apart are left out: all pairs of a group are compared, and streams are not taken."""
    if meetings(max_bits, bands) >= 1:
        return every_pair(hashes, others, keys, max_bits)
    radius = max_bits // bands

    def base(df):
        return df.select(*keys, "hash", hashing.hash_bits(F.col("hash")).alias("_bits"), F.length("hash").alias("_len"))

    def probes(share: int):
        def varied(band, low, width):
            value = F.shiftrightunsigned("_bits", low).bitwiseAND(F.lit((1 << width) - 1))
            masks = F.array(*[F.lit(m).cast("bigint") for m in _masks(width, share)])
            return F.transform(
                masks, lambda m: F.struct(F.lit(band).alias("band"), value.bitwiseXOR(m).alias("value"))
            )

        widths = _widths(bands)
        return F.explode(F.concat(*[varied(i, sum(widths[:i]), w) for i, w in enumerate(widths)]))

    left = base(hashes).select(*keys, "_len", "hash", "_bits", probes((radius + 1) // 2).alias("_probe"))
    left = left.select(*keys, "_len", "hash", "_bits", "_probe.*")
    right = base(others).select(*keys, "_len", F.col("hash").alias("other"), F.col("_bits").alias("_other_bits"), probes(radius // 2).alias("_probe"))
    right = right.select(*keys, "_len", "other", "_other_bits", "_probe.*")
    close = (F.col("hash") != F.col("other")) & _near(max_bits)
    apart = F.col("_bits").bitwiseXOR(F.col("_other_bits"))
    widths = _widths(bands)
    meets = [
        F.when(F.bit_count(F.shiftrightunsigned(apart, sum(widths[:i])).bitwiseAND(F.lit((1 << w) - 1))) <= radius, i) for i, w in enumerate(widths)
    ]
    first = F.col("band") == F.coalesce(*meets)
    # A probe table is hundreds of times its hashes, which an estimate from the files does not see:
    # without the hint it would be collected and broadcast as if it were as small as they are.
    return left.join(right.hint("merge"), [*keys, "_len", "band", "value"]).where(close & first & _whole(max_bits)).select(*keys, "hash", "other")


def every_pair(hashes: DataFrame, others: DataFrame, keys: list[str], max_bits: int) -> DataFrame:
    """``meeting`` without bands, each pair once. The hashes of a group are dealt to blocks of
    about ``BLOCK`` by a digest, and two blocks are a unit of work, however large the group. A hash
    is a row for each block it meets; the rows of a unit are compared by numpy, and what leaves
    are near pairs only, in parts. A table with itself compares two hashes once and gives both
    pairs. Not for streams: the groups are counted first."""
    itself = hashes is others
    group = [*keys, "_len"]
    digest, cell = F.xxhash64("hash"), F.pmod(F.xxhash64("hash"), F.lit(CELLS)).alias("_cell")

    def rows(df):
        return df.select(*keys, F.length("hash").alias("_len"), "hash", hashing.hash_bits(F.col("hash")).alias("_bits"), cell).where(F.col("_bits").isNotNull())

    def blocks(df, name):
        """(group, cell, name): the number of blocks of a group, at each of its cells."""
        cells = df.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("_rows"))
        total = cells.groupBy(*group).agg(F.ceil(F.sum("_rows") / F.lit(BLOCK)).alias(name))
        return cells.select(*group, "_cell").join(total.hint("merge"), group)

    def dealt(df, sizes, own, opposite, unit, side):
        """A row for each block of the other side."""
        placed = df.join(sizes.hint("merge"), [*group, "_cell"]).withColumn("_own", F.pmod(digest, F.col(own)))
        met = placed.select(*group, "hash", "_bits", "_own", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(opposite) - 1)).alias("_met"))
        return met.select(*group, *unit, side.alias("_right"), "_bits", "hash")

    mine, met = F.col("_own"), F.col("_met")
    own = rows(hashes)
    if itself:
        unit = [F.least(mine, met).alias("_a"), F.greatest(mine, met).alias("_b")]
        units = dealt(own, blocks(own, "_n"), "_n", "_n", unit, mine > met)
    else:
        opposite = rows(others)
        of_own, of_others = blocks(own, "_n"), blocks(opposite, "_m")
        n, m = of_own.drop("_cell").distinct(), of_others.drop("_cell").distinct()
        left = dealt(own, of_own.join(m.hint("merge"), group), "_n", "_m", [mine.alias("_a"), met.alias("_b")], F.lit(False))
        right = dealt(opposite, of_others.join(n.hint("merge"), group), "_m", "_n", [met.alias("_a"), mine.alias("_b")], F.lit(True))
        units = left.unionByName(right)
    names = [*group, "_a", "_b"]
    kinds = {f.name: f.dataType.simpleString() for f in units.schema.fields}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], "hash string", "other string"])
    pairs = units.repartition(*names).sortWithinPartitions(*names).mapInArrow(_comparer(names, len(keys), max_bits, itself), schema)
    whole = (F.length("hash") <= 16) | (hashing.hamming_hex(F.col("hash"), F.col("other")) <= max_bits)
    pairs = pairs.where((F.col("hash") != F.col("other")) & whole)
    return both_ways(pairs, keys) if itself else pairs


def both_ways(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Each pair (keys, hash, other) and its reverse."""
    turned = [F.struct("hash", "other"), F.struct(F.col("other").alias("hash"), F.col("hash").alias("other"))]
    return pairs.select(*keys, F.explode(F.array(*turned)).alias("_pair")).select(*keys, "_pair.*")


def _comparer(names: list[str], n_keys: int, max_bits: int, itself: bool):
    """A function over Arrow batches of (names, _right, _bits, hash), sorted by ``names``: the pairs
    (keys, hash, other) of each unit that are within ``max_bits`` in their 64 bits."""
    tall, wide, most = 8, 4096, 65536

    def run(batches):
        # Nothing of this module is named here, so workers need not have it.
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        apart, bits, flags = np.empty(tall * wide, np.uint64), np.empty(tall * wide, np.uint8), np.empty(tall * wide, bool)

        def near(a, b, same):
            """Indices of near pairs; of a block with itself, those above the diagonal."""
            for i in range(0, len(a), tall):
                x = a[i : i + tall, None]
                for j in range(i if same else 0, len(b), wide):
                    y = b[j : j + wide]
                    n, shape = len(x) * len(y), (len(x), len(y))
                    c = np.bitwise_count(np.bitwise_xor(x, y, out=apart[:n].reshape(shape)), out=bits[:n].reshape(shape))
                    hit = np.less_equal(c.ravel(), max_bits, out=flags[:n])
                    if n % 8:
                        at = np.flatnonzero(hit)
                    else:  # eight flags at once, as few are set
                        words = np.flatnonzero(hit.view(np.uint64))
                        word, place = np.nonzero(hit.reshape(-1, 8)[words])
                        at = words[word] * 8 + place
                    if len(at):
                        p, q = at // len(y) + i, at % len(y) + j
                        yield (p[p < q], q[p < q]) if same else (p, q)

        def made(rows, found):
            p, q = (np.concatenate(x) for x in zip(*found, strict=True))
            hashes = rows.column("hash")
            columns = [*[rows.column(k).take(p) for k in range(n_keys)], hashes.take(p), hashes.take(q)]
            return pa.RecordBatch.from_arrays(columns, names=[*names[:n_keys], "hash", "other"])

        def unit(parts):
            rows = pa.concat_batches(parts) if len(parts) > 1 else parts[0]
            right = rows.column("_right").to_numpy(zero_copy_only=False)
            values = rows.column("_bits").to_numpy().view(np.uint64)
            same = itself and rows.column("_a")[0] == rows.column("_b")[0]
            left, opposite = np.flatnonzero(~right), np.flatnonzero(right)
            if same:
                opposite = left
            found, size = [], 0
            for p, q in near(values[left], values[opposite], same):
                found.append((left[p], opposite[q]))
                size += len(p)
                if size >= most:
                    yield made(rows, found)
                    found, size = [], 0
            if size:
                yield made(rows, found)

        def units():
            """The rows of each unit, in parts of batches."""
            parts, last = [], None
            for b in batches:
                if not b.num_rows:
                    continue
                new = np.zeros(b.num_rows, bool)
                new[0] = last is None or any(b.column(c)[0] != last.column(c)[last.num_rows - 1] for c in names)
                for c in names:
                    column = b.column(c)
                    new[1:] |= pc.not_equal(column.slice(1), column.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
                cuts = [*np.flatnonzero(new).tolist(), b.num_rows]
                if cuts[0]:
                    parts.append(b.slice(0, cuts[0]))
                for lo, hi in zip(cuts, cuts[1:]):
                    if parts:
                        yield parts
                    parts = [b.slice(lo, hi - lo)]
                last = b
            if parts:
                yield parts

        for parts in units():
            yield from unit(parts)

    return run


def first_originals(photos: DataFrame, keys=("bill_id",), key_col: str = "s3_key", owner_col: str | None = "drain_id",
                    max_bits: int = MAX_BITS, bands: int | None = None, hashes_per_group: int | None = None) -> DataFrame:
    """``(keys, key_col, original, original_owner, distance)`` for every copy.

    Photos are ordered by their timestamp *text*, then key, a missing one first. A
    photo's original is the first photo of all within ``max_bits`` of its hash, so
    it depends on the hash alone and copies never multiply the work. The original
    may itself be a copy of something else."""
    keys = list(keys)
    usable = _usable(photos, keys, key_col, owner_col)
    # One row per distinct hash before anything is compared.
    pairs = near_hashes(usable, keys, max_bits, bands, hashes_per_group)
    return originals(photos, keys, pairs, key_col, owner_col)


def _usable(photos: DataFrame, keys: list[str], key_col: str, owner_col: str | None) -> DataFrame:
    owner = F.col(owner_col) if owner_col else F.lit(None).cast("string")
    return photos.where(hashing.is_hex(F.col("p_hash"))).select(
        *keys,
        F.col(key_col),
        F.col("p_hash").alias("hash"),
        F.coalesce(F.col("timestamp").cast("string"), F.lit("")).alias("_ts"),
        owner.alias("_owner"),
    )


def originals(photos: DataFrame, keys: list[str], pairs: DataFrame, key_col: str = "s3_key", owner_col: str | None = "drain_id") -> DataFrame:
    """As ``first_originals``, from known ``pairs`` (keys, hash, other) of near hashes; a hash and
    itself need not be among them, and a pair may be there more than once."""
    usable = _usable(photos, keys, key_col, owner_col)
    order = F.struct(F.col("_ts").alias("ts"), F.coalesce(F.col(key_col), F.lit("")).alias("key"))
    firsts = usable.groupBy(*keys, "hash").agg(
        F.min(F.struct(order.alias("at"), F.col("_owner").alias("owner"))).alias("_first")
    )
    own = firsts.select(*keys, "hash", F.col("hash").alias("other"), "_first")
    candidate = firsts.select(*keys, F.col("hash").alias("other"), "_first")
    near = pairs.where(F.col("hash") != F.col("other")).join(candidate, [*keys, "other"]).select(*keys, "hash", "other", "_first")
    best = near.unionByName(own).groupBy(*keys, "hash").agg(F.min(F.struct("_first.at", "_first.owner", "other")).alias("_best"))
    return (
        usable.join(best, [*keys, "hash"])
        .where(F.col("_best.at") < order)
        .select(
            *keys,
            key_col,
            F.col("_best.at.key").alias("original"),
            F.col("_best.owner").alias("original_owner"),
            hashing.hamming_hex(F.col("hash"), F.col("_best.other")).alias("distance"),
        )
    )
