"""The k most similar rows of every row by shifted space-filling curves.

Standardised rows are projected to a few dimensions, and each of several curves
lays its own projection, shifted at random, along a Hilbert curve. Only (curve, key, id)
is range-partitioned and sorted by Spark, which gives every row its place on every
curve. Rows then travel, packed, to the groups of consecutive places that they belong
to or border on. There rows near each other on a curve are compared exactly, block
against neighbouring blocks as matrix products, and each row's best of all curves merge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countgrid.llm.hilbert import hilbert_key
from countgrid.llm.vectors import flat_lists, hashed, pack_rows, standardised, unpack_rows
from countgrid.operators.graphs import with_places
from countgrid.session import Scratch, shuffle_partitions

#: Curves for up to 100,000 rows; each tenfold of rows beyond takes eight more.
CURVES = 16
#: Rows on either side of a row that its curve window covers at least.
WINDOW = 256
#: Consecutive places of a group, and groups that one task compares.
GROUP_ROWS = 8_192
TASK_GROUPS = 12
#: Dimensions and bits per dimension of a curve: 10 * 6 bits make one key.
CURVE_DIMS = 10
CURVE_BITS = 6
#: Rows to which the projection is fitted, and principal directions kept of them. The index holds every row.
SAMPLE_ROWS = 4_000
DIRECTIONS = 200
#: Features beyond this number are hashed to so many columns for the keys; similarities stay exact.
KEY_COLUMNS = 2_048


def curves_for(n: int) -> int:
    return CURVES + 8 * max(0, int(np.ceil(np.log10(max(n, 1) / 100_000))))


def fit_curves(rows: DataFrame, n: int, dims: int, curves: int, seed: int) -> dict:
    """Projections and shifts, fitted to a bounded sample of the ``n`` rows, drawn by a hash of their ids."""
    chance = F.pmod(F.xxhash64("cell_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    few = rows.filter(chance < min(1.0, SAMPLE_ROWS / max(n, 1))).select("genes", "counts")
    rng = np.random.default_rng(seed)
    table = few.toArrow().combine_chunks()
    width = min(dims, KEY_COLUMNS)
    if table.num_rows == 0:
        vectors = np.zeros((1, width), np.float32)
    else:
        vectors = hashed(table["genes"].chunk(0), table["counts"].chunk(0), dims, KEY_COLUMNS)
    keep = min(DIRECTIONS, width)
    # Principal directions of the sample: random mixtures of them spread the rows better than random axes.
    _, axes = np.linalg.eigh(vectors.T.astype(np.float64) @ vectors)
    axes = axes[:, ::-1][:, :keep]
    projections = np.stack([axes @ rng.standard_normal((keep, CURVE_DIMS)) for _ in range(curves)]).astype(np.float32)
    spread = np.abs(np.einsum("nd,cdk->cnk", vectors, projections)).max(axis=(1, 2)) * 1.05 + 1e-9
    shifts = rng.random((curves, CURVE_DIMS)).astype(np.float32)
    return {"projections": projections, "spread": spread.astype(np.float32), "shifts": shifts}


def curve_keys(vectors: np.ndarray, fitted: dict, curve: int) -> np.ndarray:
    """Keys on one curve: the projected box fills half of the cube and is moved inside it by the shift."""
    spread = fitted["spread"][curve]
    unit = np.clip((vectors @ fitted["projections"][curve] / spread + 1) / 2, 0, 1)
    cube = (unit + fitted["shifts"][curve]) / 2
    return hilbert_key(np.minimum(cube * (1 << CURVE_BITS), (1 << CURVE_BITS) - 1).astype(np.int64), CURVE_BITS)


def nearest_rows(rows: DataFrame, dims: int, k: int, *, curves: int | None = None, window: int = WINDOW, group_rows: int = GROUP_ROWS, seed: int = 11) -> DataFrame:
    """``cell_id, other_id, similarity, rank`` of the ``k`` most similar rows found for every row.

    Rows of equal lists are indexed once, by their smallest id; their ``k`` + 1 smallest ids
    then stand for the group in the result, so that its size doesn't matter.

    ``rows`` has ``cell_id`` (integer, unique), ``genes`` and ``counts``. The order is
    similarity descending, then id ascending. Rows whose values are all equal have
    no correlation: they are nobody's neighbour and have none. Rows with a null id
    or null lists are left out; an empty table gives an empty result.

    The result doesn't depend on the number of partitions: places on the curves are those of all
    rows, and a group gets the ``window`` rows before and after its own.
    """
    spark = rows.sparkSession
    rows = rows.filter("cell_id IS NOT NULL AND genes IS NOT NULL AND counts IS NOT NULL").select(F.col("cell_id").cast("bigint").alias("cell_id"), "genes", "counts")
    scratch = Scratch(spark, "nearest")
    rows, ids = _distinct_rows(rows, k + 1, scratch)
    # A few fixed-size matrices: their size doesn't depend on the number of rows.
    n = rows.count()
    curves = curves or curves_for(n)
    fitted = spark.sparkContext.broadcast(fit_curves(rows, n, dims, curves, seed))

    def keys(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for at in range(0, frame.num_rows, 4096):
                part = frame.slice(at, 4096)
                vectors = hashed(part.column("genes"), part.column("counts"), dims, KEY_COLUMNS)
                moving = np.nonzero(np.abs(vectors).sum(axis=1) > 0)[0]
                own, vectors = part.column("cell_id").take(pa.array(moving)), vectors[moving]
                for curve in range(curves):
                    number = pa.array(np.full(len(moving), curve, np.int32))
                    yield pa.RecordBatch.from_arrays([number, pa.array(curve_keys(vectors, fitted.value, curve)), own], ["curve", "key", "cell_id"])

    def packing(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            yield pa.RecordBatch.from_arrays([frame.column("cell_id"), pack_rows(frame.column("genes"), frame.column("counts"), dims)], ["cell_id", "v"])

    def scan(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _windows(frames, dims, k, window, group_rows)

    keyed = scratch.keep(rows.mapInArrow(keys, "curve int, key bigint, cell_id bigint"))
    placed = with_places(keyed, [F.asc("curve"), F.asc("key"), F.asc("cell_id")], "place", scratch)
    group, spot = F.floor(F.col("place") / group_rows).cast("int"), F.col("place") % group_rows
    groups = F.array_compact(F.array(group, F.when(spot < window, group - 1), F.when(spot >= group_rows - window, group + 1)))
    sent = placed.select("cell_id", "curve", "place", F.explode(groups).alias("g"))
    tasks = max(shuffle_partitions(spark), -(-n * curves // (group_rows * TASK_GROUPS)))
    moved = sent.join(rows.mapInArrow(packing, "cell_id bigint, v binary"), "cell_id").repartition(tasks, "g").sortWithinPartitions("g", "curve", "place")
    best = moved.select("g", "curve", "place", "cell_id", "v").mapInArrow(scan, "cell_id bigint, found array<struct<s:double,o:bigint>>")
    # curves * k candidates per row; -id makes the greatest struct the first in order.
    merged = best.groupBy("cell_id").agg(F.flatten(F.collect_list("found")).alias("found"))
    merged = merged.select("cell_id", F.slice(F.sort_array(F.array_distinct("found"), asc=False), 1, k).alias("found"))
    out = _with_copies(scratch.keep(merged), ids, k)
    return out.select("cell_id", (-F.col("f.o")).alias("other_id"), F.col("f.s").alias("similarity"), (F.col("rank") + 1).alias("rank"))


def _distinct_rows(rows: DataFrame, most: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """One row per distinct content, by its smallest id; and ``cell_id, first, ids`` of every row: that id and the group's ``most`` smallest.

    Groups are found by a 128-bit hash of the entries in the order of the features.
    """
    entries = F.array_sort(F.filter(F.arrays_zip("genes", "counts"), lambda e: e["counts"] != 0))
    keyed = scratch.keep(rows.select("cell_id", F.xxhash64(entries).alias("h"), F.xxhash64(F.lit(1), entries).alias("g")))
    few = keyed.withColumn("r", F.row_number().over(Window.partitionBy("h", "g").orderBy("cell_id"))).filter(F.col("r") <= most)
    groups = scratch.keep(few.groupBy("h", "g").agg(F.min("cell_id").alias("first"), F.sort_array(F.collect_list("cell_id")).alias("ids")))
    ids = scratch.keep(keyed.join(groups, ["h", "g"]).select("cell_id", "first", "ids"))
    return rows.join(groups.select(F.col("first").alias("cell_id")), "cell_id", "left_semi"), ids


def _with_copies(merged: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """``cell_id, rank, f`` of every row from the ``k`` best groups (``cell_id, found``) of its group.

    A group that k others precede by (similarity, smallest id) has no row among the k best.
    """
    groups = ids.filter("cell_id = first").select("first", "ids")
    other = merged.select("cell_id", F.explode("found").alias("f")).select("cell_id", F.col("f.s").alias("s"), (-F.col("f.o")).alias("first"))
    rows = other.join(groups, "first").select("cell_id", "s", F.explode(F.slice("ids", 1, k)).alias("o"))
    best = rows.groupBy(F.col("cell_id").alias("first")).agg(F.collect_list(F.struct("s", (-F.col("o")).alias("o"))).alias("found"))
    # Rows without a correlation aren't in ``merged``.
    best = merged.select(F.col("cell_id").alias("first")).join(best, "first", "left")
    kind = "array<struct<s:double,o:bigint>>"
    own = F.transform("ids", lambda i: F.struct(F.lit(1.0).alias("s"), (-i).alias("o")))
    every = F.concat(own.cast(kind), F.coalesce(F.col("found"), F.array().cast(kind)))
    every = F.filter(every, lambda f: f["o"] != -F.col("cell_id"))
    return ids.join(best, "first").select("cell_id", F.posexplode(F.slice(F.sort_array(every, asc=False), 1, k)).alias("rank", "f"))


class _Block:
    """Rows as standardised vectors in single precision, and what their exact similarities need."""

    def __init__(self, key: tuple[int, int], ids: np.ndarray, own: np.ndarray, packed: pa.Array, dims: int):
        self.key, self.ids, self.own, self.dims = key, ids, own, dims
        genes, counts = unpack_rows(packed, dims)
        self.vectors = standardised(genes, counts, dims)
        self.gene, bounds = flat_lists(genes)
        self.value = flat_lists(counts)[0].astype(np.float64)
        self.row = np.repeat(np.arange(len(ids)), np.diff(bounds))
        self.counts = np.zeros((len(ids), dims), np.float32)
        self.counts[self.row, self.gene] = self.value
        self.total = np.bincount(self.row, self.value, len(ids)).astype(np.float64)
        self.spread = dims * np.bincount(self.row, self.value * self.value, len(ids)) - self.total * self.total


def _windows(frames: Iterator[pa.RecordBatch], dims: int, k: int, block: int, group_rows: int) -> Iterator[pa.RecordBatch]:
    """Compares each block of a sorted stream with itself and the blocks beside it; keeps three blocks in memory."""
    before: _Block | None = None
    now: _Block | None = None
    for following in _then_none(_blocks(frames, dims, block, group_rows)):
        if now is not None and now.own.any():
            yield _best(now, [b for b in (before, now, following) if b is not None and b.key == now.key], k)
        before, now = now, following


def _then_none(blocks: Iterator) -> Iterator:
    yield from blocks
    yield None


def _blocks(frames: Iterator[pa.RecordBatch], dims: int, block: int, group_rows: int) -> Iterator[_Block]:
    """Up to ``block`` rows of one group and curve each."""
    waiting: pa.Table | None = None

    def cut(table: pa.Table, last: bool) -> Iterator[_Block]:
        group, curve, place = (table[c].to_numpy() for c in ("g", "curve", "place"))
        borders = [0, *(np.nonzero((np.diff(curve) != 0) | (np.diff(group) != 0))[0] + 1).tolist(), len(curve)]
        for low, high in zip(borders[:-1], borders[1:]):
            closed = last or high < len(curve)
            at = low
            while high - at >= block or (closed and at < high):
                part = table.slice(at, min(block, high - at)).combine_chunks()
                own = place[at : at + part.num_rows] // group_rows == group[at]
                yield _Block((int(group[at]), int(curve[at])), part["cell_id"].to_numpy(), own, part["v"].chunk(0), dims)
                at += part.num_rows
        rest.append(table.slice(at) if not last else None)

    rest: list = []
    for frame in frames:
        table = pa.Table.from_batches([frame])
        waiting = table if waiting is None else pa.concat_tables([waiting, table])
        if waiting.num_rows < 4 * block:
            continue
        yield from cut(waiting, False)
        waiting = rest.pop()
    if waiting is not None and waiting.num_rows:
        yield from cut(waiting, True)


def _best(now: _Block, beside: list[_Block], k: int) -> pa.RecordBatch:
    own = np.nonzero(now.own)[0]
    ids, others = now.ids[own], np.concatenate([b.ids for b in beside])
    score = np.concatenate([now.vectors[own] @ b.vectors.T for b in beside], axis=1)
    score[ids[:, None] == others[None, :]] = -np.inf
    m = min(k + 3, score.shape[1])  # a few more than k, as single precision may swap near ties
    pick = np.argpartition(-score, m - 1, axis=1)[:, :m]
    # exact similarities of the picked: sums of products of counts over the row's own entries
    mine = np.isin(now.row, own)
    at = np.searchsorted(own, now.row[mine])
    gene, value = now.gene[mine], now.value[mine]
    total, spread = (np.concatenate([getattr(b, c) for b in beside]) for c in ("total", "spread"))
    first = np.cumsum([0] + [len(b.ids) for b in beside])
    exact = np.empty(pick.shape)
    for c in range(m):
        other = pick[at, c]
        theirs = np.empty(len(at))
        for b, low, high in zip(beside, first[:-1], first[1:]):
            use = (other >= low) & (other < high)
            theirs[use] = b.counts[other[use] - low, gene[use]]
        exact[:, c] = np.bincount(at, value * theirs, len(own))
    down = np.sqrt(now.spread[own])[:, None] * np.sqrt(spread[pick])
    exact = np.round((now.dims * exact - now.total[own][:, None] * total[pick]) / down, 9)
    found_ids = others[pick]
    exact[np.take_along_axis(score, pick, axis=1) == -np.inf] = -np.inf
    order = np.lexsort((found_ids, -exact), axis=1)[:, :k]
    exact, found_ids = np.take_along_axis(exact, order, 1), np.take_along_axis(found_ids, order, 1)
    good = np.isfinite(exact)
    bounds = np.concatenate([[0], np.cumsum(good.sum(axis=1))]).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(exact[good]), pa.array(-found_ids[good].astype(np.int64))], ["s", "o"])
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(bounds), pairs)], ["cell_id", "found"])
