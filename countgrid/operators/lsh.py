"""Sign-random-projection signatures and the pair searches on them.

Bit b of a row's signature tells on which side of a random hyperplane the
standardised row lies; a share m / L of differing bits estimates the similarity
as cos(pi m / L). Signatures are arrays of signed 64-bit words, first bit highest.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countgrid.operators.similarity import PAIRS, best_of_block, block_pairs, dot_tiles, packed, pairs_table, top_k
from countgrid.operators.sliced import OWN_ROWS, MultiSearch, SlicedSearch, against_all
from countgrid.session import Scratch, shuffle_partitions

SEED = 231
#: Signatures of one block of the search of all pairs: 8 MB at 1,024 bits.
BLOCK_SIGNATURES = 65_536
#: Plane components that a worker keeps or draws at once.
PLANE_VALUES = 64_000_000
#: Values of a dense slice of rows during projection.
SLICE_VALUES = 8_000_000
#: Rows of a tile whose errors are put into bins at once.
SLAB_ROWS = 32
#: Checked candidates that a block of rows holds at once.
CHECKED_PAIRS = 8_000_000


def hyperplanes(features: np.ndarray, bits: int, seed: int) -> np.ndarray:
    """Normal components of each feature, from a generator keyed by seed and feature: nothing is broadcast."""
    return np.stack([np.random.Generator(np.random.Philox(key=[seed, int(f)])).standard_normal(bits) for f in features]) if len(features) else np.zeros((0, bits))


def md5_planes(features: np.ndarray, bits: int, seed: int) -> np.ndarray:
    """Components +1 and -1 from MD5 of ``seed:feature:block``, 128 bits a block, which any SQL engine can repeat."""
    blocks = range(-(-bits // 128))
    raw = b"".join(hashlib.md5(f"{seed}:{int(f)}:{b}".encode()).digest() for f in features for b in blocks)
    flags = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(len(features), len(blocks) * 128)[:, :bits]
    return flags.astype(np.float64) * 2 - 1


@lru_cache(maxsize=2)
def _plane_matrix(planes: Callable, n: int, bits: int, seed: int) -> np.ndarray:
    """All planes, once per worker process, in single precision; only for as many values as a worker may keep."""
    return planes(np.arange(n), bits, seed).astype(np.float32)


@lru_cache(maxsize=2)
def _plane_totals(planes: Callable, n: int, bits: int, seed: int) -> np.ndarray:
    step = max(1, PLANE_VALUES // 16 // bits)
    return sum((planes(np.arange(at, min(n, at + step)), bits, seed).astype(np.float32).astype(np.float64).sum(axis=0) for at in range(0, n, step)), np.zeros(bits))


def signatures(values: DataFrame, n: int, bits: int = 1024, seed: int = SEED, row: str = "cell_id", feature: str = "gene_id", value: str = "count", planes: Callable = hyperplanes) -> DataFrame:
    """``id, sig``: the signature of every row over ``n`` features.

    ``planes(features, bits, seed)`` gives the planes' components. Subtracting the row mean is folded
    into the projection: n (x - mean) u = n x u - sum(x) sum(u), which is exact for whole numbers.
    Rows are projected in slices whose dense form is bounded, whatever the number of features.
    """

    def project(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _plane_totals(planes, n, bits, seed)
        kept = _plane_matrix(planes, n, bits, seed) if n * bits <= PLANE_VALUES else None
        words = -(-bits // 64)
        for frame in frames:
            at = 0
            while at < frame.num_rows:
                part = frame.slice(at, max(1, min(4096, SLICE_VALUES // max(n, 1))))
                at += part.num_rows
                lists = part.column(1)
                f, v = lists.flatten().to_numpy(), part.column(2).flatten().to_numpy()
                bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                own, spot = np.unique(f, return_inverse=True)
                x = np.zeros((part.num_rows, len(own)))
                x[np.repeat(np.arange(part.num_rows), np.diff(bounds)), spot] = v
                side = -x.sum(axis=1)[:, None] * total
                step = max(1, PLANE_VALUES // 16 // bits)
                for low in range(0, len(own), step):
                    some = own[low : low + step]
                    u = kept[some] if kept is not None else planes(some, bits, seed).astype(np.float32)
                    side += n * (x[:, low : low + step] @ u.astype(np.float64))
                flags = np.zeros((part.num_rows, words * 64), bool)
                flags[:, :bits] = side > 0
                packed_bits = np.packbits(flags, axis=1).view(">u8").astype(np.uint64).view(np.int64)
                sig = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * words), pa.array(packed_bits.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), sig], ["id", "sig"])

    return packed(values, row, feature, value).select("id", "features", "values").mapInArrow(project, "id bigint, sig array<bigint>")


def mismatches(a: str = "sig0", b: str = "sig1") -> Column:
    """Bits in which two signatures differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def common_prefix(a: str = "sig0", b: str = "sig1") -> Column:
    """Leading bits that two signatures share, up to the length of their words."""
    zeros = F.transform(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), lambda x: F.when(x == 0, 64).otherwise(64 - F.length(F.bin(x))))
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("open"))
    step = lambda s, z: F.struct((s["n"] + F.when(s["open"], z).otherwise(0)).alias("n"), (s["open"] & (z == 64)).alias("open"))
    return F.aggregate(zeros, start, step, lambda s: s["n"])


def from_mismatches(m: Column, bits: int) -> Column:
    return F.cos(m * math.pi / bits)


def most_mismatches(threshold: float, bits: int) -> int:
    """The largest number of differing bits with a similarity of at least the threshold."""
    if not -1 < threshold <= 1:
        raise ValueError("the threshold must be above -1 and at most 1")
    m = int(math.floor(bits * math.acos(threshold) / math.pi))
    while m + 1 <= bits and math.cos((m + 1) * math.pi / bits) >= threshold:
        m += 1
    while m > 0 and math.cos(m * math.pi / bits) < threshold:
        m -= 1
    return m


def lsh_pairs_all(sigs: DataFrame, bits: int, k: int = 100, threshold: float = 0.2, inclusive: bool = False) -> DataFrame:
    """All pairs by signature, the k best per row above the threshold (or at it, if ``inclusive``)."""
    table = np.cos(np.arange(bits + 1) * math.pi / bits)
    passing = np.nonzero(table >= threshold if inclusive else table > threshold)[0]
    # the product of +-1 rows is L - 2 * mismatches, exact in single precision
    limit = bits - 2 * passing.max() - 1 if len(passing) else bits

    def kernel(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        sides = []
        for t in (left, right):
            flags = bit_rows(t["sig"].chunk(0), bits) if t.num_rows else np.zeros((0, bits), np.uint8)
            sides.append((t["id"].to_numpy(), flags.astype(np.float32) * 2 - 1))
        (idx, x), (idy, y) = sides
        product = x @ y.T
        if same:
            np.fill_diagonal(product, -bits - 2)
        parts = best_of_block(idx, idy, product, k, limit)
        if not same:
            parts = tuple(p + q for p, q in zip(parts, best_of_block(idy, idx, product.T, k, limit)))
        found = [table[((bits - v) / 2).round().astype(np.int64)] for v in parts[2]]
        return pairs_table((parts[0], parts[1], found))

    return top_k(block_pairs(sigs, ["sig"], kernel, PAIRS, BLOCK_SIGNATURES, k=k), k)


def bit_rows(column: pa.Array, bits: int) -> np.ndarray:
    """One row of 0 and 1 per signature."""
    words = column.flatten().to_numpy().astype(">i8").view(np.uint8).reshape(len(column), -1) if len(column) else np.zeros((0, -(-bits // 8)), np.uint8)
    return np.unpackbits(words, axis=1)[:, :bits]


def _checked_length(length: int, bits: int) -> int:
    if not 1 <= length <= min(63, bits):
        raise ValueError("a slice has 1 to 63 bits and no more than the signature")
    return length


def _compared(candidates: DataFrame, sigs: DataFrame) -> DataFrame:
    a = sigs.select(F.col("id").alias("id0"), F.col("sig").alias("sig0"))
    b = sigs.select(F.col("id").alias("id1"), F.col("sig").alias("sig1"))
    return candidates.join(a, "id0").join(b, "id1").select("id0", "id1", mismatches().alias("m"))


def _verified(candidates: DataFrame, sigs: DataFrame, bits: int) -> DataFrame:
    return _compared(candidates, sigs).select("id0", "id1", from_mismatches(F.col("m"), bits).alias("similarity"))


def _classes(sigs: DataFrame, most: int) -> DataFrame:
    """``sig, rep, ids``: the smallest id of the rows with equal signatures and their ``most`` smallest ids in order."""
    few = sigs.select("id", "sig").withColumn("r", F.row_number().over(Window.partitionBy("sig").orderBy("id"))).filter(F.col("r") <= most)
    return few.groupBy("sig").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids"))


def lsh_pairs_sliced(sigs: DataFrame, bits: int, length: int = 0, overflow: int = 1000, k: int = 100, threshold: float = 0.2) -> DataFrame:
    """Candidates share a slice of ``length`` bits (0: about log2 of the rows); they are verified with the whole signature.

    No bucket is skipped, so that ``overflow``, the size above which the reference skips one, changes nothing.
    Each block of rows keeps its k best while all signatures are streamed past it; rows of equal signatures are compared once in a block.
    """
    if length == 0:
        length = max(1, math.ceil(math.log2(max(2, sigs.count()))))
    length = _checked_length(min(length, 63), bits)
    classes = _classes(sigs, k + 1).select(F.col("rep").alias("id"), "sig", "ids")
    return against_all(sigs, classes, lambda: SlicedSearch(bits, length, k, threshold))


def lsh_pairs_multi_slice(sigs: DataFrame, bits: int, lengths: list[int], max_check: int = 100, k: int = 100, threshold: float = 0.2, inclusive: bool = False, log2_buckets: int = 0) -> DataFrame:
    """Slices of several lengths, longest first; each row checks its first ``max_check`` distinct candidates.

    Candidates come in the order of (slice length, slice, id), so that only the ``max_check`` + 1
    smallest ids of a bucket can be among them, however large it is; no bucket is skipped. Kept are
    those with fewer differing bits than the threshold allows (as many, if ``inclusive``); the best k
    by differing bits, then id. With ``log2_buckets`` slices at least that long are hashed to so many
    buckets, whose collisions give further candidates.
    """
    ordered = [_checked_length(length, bits) for length in sorted(set(lengths), reverse=True)]
    limit = most_mismatches(threshold, bits) - (not inclusive)
    own_rows = max(1024, min(OWN_ROWS, CHECKED_PAIRS // max(1, max_check)))
    return against_all(sigs, sigs.select("id", "sig"), lambda: MultiSearch(bits, ordered, max_check, k, limit, log2_buckets), own_rows)


def random_orders(bits: int, permutations: int, length: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(bits)[:length] for _ in range(permutations)])


def md5_orders(bits: int, permutations: int, length: int, seed: int) -> np.ndarray:
    """The bits in the order of MD5 of ``seed:permutation:bit``, which any SQL engine can repeat."""
    texts = lambda p: sorted(range(bits), key=lambda b: hashlib.md5(f"{seed}:{p}:{b}".encode()).hexdigest())
    return np.array([texts(p)[:length] for p in range(permutations)])


def lsh_pairs_permuted(sigs: DataFrame, bits: int, permutations: int = 16, search: int = 20, k: int = 100, threshold: float = 0.2, seed: int = SEED, permuted_bits: int = 63, orders: Callable = random_orders) -> DataFrame:
    """Sorted neighbourhoods: rows near each other in the order of a permuted prefix are candidates.

    Each permutation of the bits gives a key of its first ``permuted_bits`` bits. Rows are ordered
    by (permutation, key, id); each takes the ``search`` rows before and after it in that
    order, across the borders of partitions, and the candidates are verified with the whole
    signature. The result doesn't depend on the partitioning.
    """
    order = orders(bits, permutations, min(permuted_bits, 63, bits), seed)

    def keys(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            flags = bit_rows(frame.column(1), bits).astype(np.int64)
            for p, places in enumerate(order):
                key = np.zeros(frame.num_rows, np.int64)
                for b in places:
                    key = (key << 1) | flags[:, b]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(frame.num_rows, p, np.int32)), pa.array(key), frame.column(0)], ["p", "key", "id"])

    placed = sigs.select("id", "sig").mapInArrow(keys, "p int, key bigint, id bigint")
    candidates = neighbours_in_order(placed, search, Scratch(sigs.sparkSession, "permuted")).distinct()
    return top_k(_verified(candidates, sigs, bits).filter(F.col("similarity") > threshold), k)


#: Consecutive rows that one group of a windowed scan handles.
SCAN_ROWS = 8192


def neighbours_in_order(placed: DataFrame, search: int, scratch: Scratch) -> DataFrame:
    """``id0, id1`` of rows at most ``search`` places apart in the order of ``p, key, id`` within one ``p``.

    The rows are range-partitioned and sorted once, and each gets its place from the sizes of
    the partitions before its own (one number a partition). Groups of ``SCAN_ROWS`` consecutive
    places then meet, each with the ``search`` rows before it.
    """
    tasks = shuffle_partitions(placed.sparkSession)

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for frame in frames:
            place = np.arange(at, at + frame.num_rows)
            at += frame.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(frame.num_rows, part, np.int32)), pa.array(place), frame.column(0), frame.column(2)], ["part", "place", "p", "id"])

    ordered = placed.repartitionByRange(tasks, "p", "key", "id").sortWithinPartitions("p", "key", "id")
    ordered = scratch.keep(ordered.mapInArrow(count, "part int, place bigint, p int, id bigint"))
    sizes = dict(ordered.groupBy("part").agg(F.max("place").alias("last")).collect())  # one row per task
    starts, at = {}, 0
    for part in sorted(sizes):
        starts[part] = at
        at += sizes[part] + 1
    offsets = ordered.sparkSession.createDataFrame(list(starts.items()), "part int, start bigint")
    rows = ordered.join(F.broadcast(offsets), "part").select((F.col("start") + F.col("place")).alias("place"), "p", "id")
    group = F.floor(F.col("place") / SCAN_ROWS)
    near_end = F.col("place") % SCAN_ROWS >= SCAN_ROWS - search
    groups = F.when(near_end, F.array(group, group + 1)).otherwise(F.array(group))
    spread = rows.select(F.explode(groups).alias("g"), "place", "p", "id")

    def pairs(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        place, p, ids = table["place"].to_numpy(), table["p"].to_numpy(), table["id"].to_numpy()
        own = place // SCAN_ROWS == table["g"][0].as_py()
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for step in range(1, min(search, len(ids) - 1) + 1):
            later = np.nonzero(own[step:] & (p[step:] == p[:-step]))[0] + step
            a += [ids[later], ids[later - step]]
            b += [ids[later - step], ids[later]]
        return pa.table({"id0": np.concatenate(a), "id1": np.concatenate(b)})

    if search >= SCAN_ROWS:
        raise ValueError(f"search must be below {SCAN_ROWS}")
    return spread.groupBy("g").applyInArrow(pairs, "id0 bigint, id1 bigint")


def error_bins(pairs: DataFrame, bits: int | None = None) -> DataFrame:
    """Estimated minus exact similarity in bins of width 0.01 of the exact one: mean, rms about 0, bins of two and more.

    ``pairs`` has ``similarity`` and ``exact``. With ``bits`` comes the error that theory expects.
    """
    bin_ = F.least(F.floor((F.col("exact") + 1) / 0.01), F.lit(199)).cast("int")
    d = F.col("similarity") - F.col("exact")
    out = pairs.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rms")).filter("n >= 2")
    return _with_theory(out, bits)


def error_bins_of_all(values: DataFrame, sigs: DataFrame, n: int, bits: int, row: str = "cell_id", feature: str = "gene_id", value: str = "count") -> DataFrame:
    """``error_bins`` over all unordered pairs of rows. Each task folds its pairs into 200 bins; no pair leaves it."""
    table = np.cos(np.arange(bits + 1) * math.pi / bits)

    def kernel(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        dots, (sx, cx), (sy, cy) = dot_tiles(left, right, n)
        x, y = (bit_rows(t["sig"].chunk(0), bits).astype(np.float32) * 2 - 1 if t.num_rows else np.zeros((0, bits), np.float32) for t in (left, right))
        product = x @ y.T
        sums = np.zeros((3, 200))
        for i in range(0, len(x), SLAB_ROWS):  # few rows at a time stay in the processor's cache
            some = slice(i, i + SLAB_ROWS)
            use = np.outer(cx[some] > 0, cy > 0)
            if same:
                use &= np.arange(len(y)) > np.arange(len(x))[some, None]
            pick = (lambda v: v.ravel()) if use.all() else (lambda v: v[use])  # noqa: B023
            s = pick(np.round((dots[some] - np.outer(sx[some], sy) / n) * cx[some, None] * cy, 9))
            d = table[pick((bits - product[some]) / 2).round().astype(np.int64)] - s
            at = np.minimum((s + 1) / 0.01, 199).astype(np.int64)  # not negative but for rounding errors, which also go to 0
            sums += [np.bincount(at, minlength=200), np.bincount(at, d, 200), np.bincount(at, d * d, 200)]
        hit = np.nonzero(sums[0])[0]
        return pa.table({"bin": hit.astype(np.int32), "n": sums[0][hit].astype(np.int64), "d": sums[1][hit], "dd": sums[2][hit]})

    rows = packed(values, row, feature, value).join(sigs.select("id", "sig"), "id")
    parts = block_pairs(rows, ["features", "values", "sig"], kernel, "bin int, n bigint, d double, dd double")
    sums = parts.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.sum("dd").alias("dd")).filter("n >= 2")
    return _with_theory(sums.select("bin", "n", (F.col("d") / F.col("n")).alias("bias"), F.sqrt(F.col("dd") / F.col("n")).alias("rms")), bits)


def _with_theory(bins: DataFrame, bits: int | None) -> DataFrame:
    out = bins.withColumn("center", F.col("bin") * 0.01 - 0.995)
    if bits:
        theta = F.acos("center")
        p = 1 - theta / math.pi
        out = out.withColumn("expected", math.pi * F.sin(theta) * F.sqrt(p * (1 - p) / bits))
    return out


def signature_counts(sigs: DataFrame) -> DataFrame:
    """How many rows have each signature, most frequent first."""
    return sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).orderBy(F.desc("n"), "first_id")


def signature_size_histogram(sigs: DataFrame) -> DataFrame:
    """Signatures and rows by bucket size, with a running sum of rows (one row per distinct size)."""
    sizes = sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("signatures"))
    sizes = sizes.withColumn("rows", F.col("size") * F.col("signatures"))
    return sizes.withColumn("running", F.sum("rows").over(Window.orderBy("size").rowsBetween(Window.unboundedPreceding, 0)))


def bit_counts(sigs: DataFrame, bits: int) -> DataFrame:
    """How often each bit is set and not set, from one partial sum per task."""

    def partial(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, n = np.zeros(bits, np.int64), 0
        for frame in frames:
            ones += bit_rows(frame.column(0), bits).sum(axis=0, dtype=np.int64)
            n += frame.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(bits, dtype=np.int32)), pa.array(ones), pa.array(n - ones)], ["bit", "set", "unset"])

    parts = sigs.select("sig").mapInArrow(partial, "bit int, set bigint, unset bigint")
    return parts.groupBy("bit").agg(F.sum("set").alias("set"), F.sum("unset").alias("unset"))


def compare_pair_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose number of partners or lowest similarity differs between two pair sets."""
    side = lambda df, k: df.groupBy("id0").agg(F.count(F.lit(1)).alias(f"count{k}"), (F.min("similarity") + 0.0).alias(f"lowest{k}"))
    both = side(a, 0).join(side(b, 1), "id0", "full_outer").na.fill(0, ["count0", "count1"]).na.fill(1.0, ["lowest0", "lowest1"])
    return both.filter("count0 != count1 OR lowest0 != lowest1")


def text_bits(sig: Column, bits: int) -> Column:
    """A signature as text, ``x`` for set and ``_`` for unset bits."""
    words = F.transform(sig, lambda w: F.lpad(F.bin(w), 64, "0"))
    return F.translate(F.substring(F.concat_ws("", words), 1, bits), "01", "_x")
