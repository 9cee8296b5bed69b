"""Clusters of mutually similar rows by k-means over hashed features with parallel oversampled seeding.

Seeding goes in rounds. A round draws a bounded number of rows at random from those that no
centre explains yet (their cost is 1, that of explained rows 0, so the draw is in proportion to
the cost), many more than there will be new centres. The drawn rows are reclustered on the
driver: those similar to one of them form a centre, the mean of their vectors, whose inner
product with a row is the row's mean similarity to them. All unexplained rows are then
assigned to the best centre, if it explains them. When no row is left, the centroids are
updated: every row is scored against the exact mean of its cluster, and rows that are no
longer explained by it go through the next iteration of seeding and assignment.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countgrid.llm.vectors import flat_lists, hashed
from countgrid.session import Scratch, shuffle_partitions

#: Rows drawn per round, and values of the centres broadcast (24 MB), at most.
SEEDS = 4_000
CENTRE_VALUES = 6_000_000
#: Columns of hashed vectors; up to so many features have columns of their own.
BUCKETS = 8_192


def _vectors(frames: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    step = max(16, min(2048, 4_000_000 // max(min(dims, BUCKETS), 1)))
    for frame in frames:
        for at in range(0, frame.num_rows, step):
            part = frame.slice(at, step)
            yield part, hashed(part.column("genes"), part.column("counts"), dims, BUCKETS)


def led_means(vectors: np.ndarray, similarity: float) -> np.ndarray:
    """The mean of each leader and its followers: a row not yet taken leads, and takes all others similar to itself."""
    free = np.ones(len(vectors), bool)
    means = []
    for at in range(0, len(vectors), 512):
        near = vectors[at : at + 512] @ vectors.T >= similarity
        for i in np.nonzero(free[at : at + 512])[0]:
            if free[at + i]:
                own = free & near[i]
                own[at + i] = True
                means.append(vectors[own].mean(axis=0))
                free &= ~own
    return np.stack(means) if means else np.zeros((0, vectors.shape[1]), np.float32)


class Rounds:
    """Places rows at centres. ``similarity`` is the mean similarity to a centre's rows from which it takes a row."""

    def __init__(self, dims: int, similarity: float, scratch: Scratch, *, seeds: int = SEEDS, seed: int = 5):
        # A drawn row must reach its own centre in single precision.
        self.dims, self.similarity, self.scratch, self.seed = dims, min(similarity, 1 - 1e-5), scratch, seed
        self.seeds = max(1, min(seeds, CENTRE_VALUES // max(min(dims, BUCKETS), 1)))
        self.number = self.centres = 0

    def _draw(self, left: DataFrame, n: int, expected: int) -> np.ndarray:
        """Vectors of about ``expected`` of the ``n`` rows; at most that number where all are drawn, else twice as many."""
        # A hash of the id makes the draw the same when a lost task is run again.
        chance = F.pmod(F.xxhash64("cell_id", F.lit(self.seed + self.number)), F.lit(1 << 30)) / float(1 << 30)
        drawn = left.filter(chance < expected / n).limit(2 * expected).select("genes", "counts").toArrow().combine_chunks()
        if drawn.num_rows == 0:
            return np.zeros((0, min(self.dims, BUCKETS)), np.float32)
        return hashed(drawn["genes"].chunk(0), drawn["counts"].chunk(0), self.dims, BUCKETS)

    def place(self, rows: DataFrame) -> DataFrame | None:
        """``cell_id, c, genes, counts`` of the rows with their centres; None without rows.

        Goes on until no row is left: a drawn row is placed at least where it leads and nothing follows.
        """
        left, parts = rows, []
        while n := left.count():
            # At first no more than needed to hit the large clusters.
            drawn = self._draw(left, n, min(n, self.seeds, n if parts else max(256, n // 64)))
            self.number += 1
            if not len(drawn):
                continue
            # Explained and other rows are kept apart, so that no later round reads the explained ones.
            done = self.scratch.keep(self._placed(left, led_means(drawn, self.similarity)), "explained")
            parts.append(done.filter("explained = 1").drop("explained"))
            left = done.filter("explained = 0").drop("c", "explained")
        return functools.reduce(DataFrame.unionByName, parts) if parts else None

    def _placed(self, rows: DataFrame, means: np.ndarray) -> DataFrame:
        shared, dims, similarity, first = rows.sparkSession.sparkContext.broadcast(means), self.dims, self.similarity, self.centres
        self.centres += len(means)

        def best(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, vectors in _vectors(frames, dims):
                score = vectors @ shared.value.T
                at = score.argmax(axis=1)
                c = np.where(score[np.arange(len(at)), at] >= similarity, at + first, -1)
                moving = pa.array(np.nonzero(np.abs(vectors).max(axis=1) > 0)[0])
                kept = part.take(moving)
                yield pa.RecordBatch.from_arrays([kept.column("cell_id"), pa.array(c).take(moving), kept.column("genes"), kept.column("counts")], ["cell_id", "c", "genes", "counts"])

        placed = rows.select("cell_id", "genes", "counts").mapInArrow(best, "cell_id bigint, c bigint, genes array<int>, counts array<float>")
        return placed.withColumn("explained", (F.col("c") >= 0).cast("int"))


def similarity_clusters(
    rows: DataFrame,
    dims: int,
    *,
    join_similarity: float = 0.39,
    min_size: int = 2,
    typical: int = 3,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Members and descriptions of the clusters of mutually similar rows.

    ``rows`` has ``cell_id`` (integer, unique), ``genes`` and ``counts``; ``dims`` is the number
    of features. Returns ``(members, clusters)``:

    * members: ``cell_id, cluster_id, mean_similarity`` (to all members of its cluster);
    * clusters: ``cluster_id`` (its smallest member), ``vertex_count``, ``mean_similarity``
      and ``typical_cells``, the members nearest to the centroid, in that order.

    The similarity is the Pearson correlation. A row belongs to a cluster when its
    exact mean similarity to the members is at least ``join_similarity``. Where all
    pairs within clusters are more similar, and all pairs across less, that value
    decides every row rightly: a centre is the mean of rows of one cluster only, and an inner
    product with it is a mean of similarities, which lies on the same side as each of them. With
    more features than ``BUCKETS`` these means have a standard error of 0.011 times the length of the
    centre, and the exact check decides. Clusters smaller than ``min_size`` are left out.

    Defined results for odd input: rows with a null id or null lists, and rows whose
    values are all equal (they have no correlation), are in no cluster; ties among
    typical members go to the smaller id; an empty table gives empty results.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "clusters")
    rows = rows.filter("cell_id IS NOT NULL AND genes IS NOT NULL AND counts IS NOT NULL").select(F.col("cell_id").cast("bigint").alias("cell_id"), "genes", "counts")
    model = Rounds(dims, join_similarity, scratch, **options)
    checked, pending = [], rows
    while (placed := model.place(pending)) is not None:
        good = _checked(placed, dims, join_similarity, scratch)
        checked.append(good)
        if good.count() in (0, placed.count()):
            break
        pending = scratch.keep(placed.select("cell_id", "genes", "counts").join(good.select("cell_id"), "cell_id", "left_anti"))
    placed = functools.reduce(DataFrame.unionByName, checked) if checked else spark.createDataFrame([], "cell_id bigint, c bigint, score double")
    sizes = placed.groupBy("c").agg(F.count(F.lit(1)).alias("vertex_count"), F.min("cell_id").alias("cluster_id"), F.avg("score").alias("mean_similarity"))
    sizes = scratch.keep(sizes.filter(F.col("vertex_count") >= min_size))
    members = placed.select("cell_id", "c", "score").join(sizes.select("c", "cluster_id"), "c").select("cell_id", "cluster_id", F.col("score").alias("mean_similarity"))
    # A bounded aggregate: each task keeps the best few per cluster before the shuffle.
    typical_cells = _nearest_members(placed, typical)
    clusters = sizes.join(typical_cells, "c", "left").select("cluster_id", "vertex_count", "mean_similarity", "typical_cells")
    return members, clusters


def _nearest_members(placed: DataFrame, typical: int) -> DataFrame:
    def best(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for frame in frames:
            table = pa.Table.from_batches([frame])
            table = table if kept is None else pa.concat_tables([kept, table])
            order = np.lexsort((table["cell_id"].to_numpy(), -table["score"].to_numpy().round(9), table["c"].to_numpy()))
            c = table["c"].to_numpy()[order]
            first = np.concatenate([[True], c[1:] != c[:-1]]) if len(c) else np.zeros(0, bool)
            rank = np.arange(len(c)) - np.maximum.accumulate(np.where(first, np.arange(len(c)), 0)) if len(c) else np.zeros(0)
            kept = table.take(pa.array(order[rank < typical]))
        if kept is not None:
            yield from kept.to_batches()

    few = placed.select("c", "cell_id", "score").mapInArrow(best, "c bigint, cell_id bigint, score double")
    ordered = F.sort_array(F.collect_list(F.struct((-F.round("score", 9)).alias("s"), "cell_id")))
    return few.groupBy("c").agg(F.slice(ordered, 1, typical).alias("t")).select("c", F.col("t.cell_id").alias("typical_cells"))


def _checked(placed: DataFrame, dims: int, join_similarity: float, scratch: Scratch) -> DataFrame:
    """Keeps the rows whose exact mean similarity to the rows of their cluster is high enough.

    The exact centroid of a cluster is the mean of its standardised rows; a row's
    inner product with it is its mean similarity to all members. Rows are shuffled once, by
    cluster. A cluster of more than ``HOT_ROWS`` rows is spread over several tasks, to each of
    which its centroid, summed up with partial aggregation, is sent along.
    """
    sizes = placed.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    salts = F.ceil(F.col("n") / HOT_ROWS).cast("int")
    hot = scratch.keep(sizes.filter(F.col("n") > HOT_ROWS).select("c", salts.alias("salts")))
    tasks = max(shuffle_partitions(placed.sparkSession), hot.count())
    rows = placed.select("c", "cell_id", "genes", "counts")
    small = rows.join(hot, "c", "left_anti").repartition(tasks, "c").sortWithinPartitions("c")
    scored = small.mapInArrow(functools.partial(_score_whole, dims=dims), SCORES)
    spread = _with_moments(rows.join(hot, "c"), dims).withColumn("salt", F.pmod(F.xxhash64("cell_id"), F.col("salts")).cast("int"))
    entries = spread.select("c", F.explode(F.arrays_zip("genes", "counts")).alias("e"), "scale")
    sums = entries.groupBy("c", F.col("e.genes").alias("gene")).agg(F.sum(F.expr("cast(e.counts as double) * scale")).alias("sx"))
    moments = spread.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("mean * scale")).alias("sb"))
    # one row of at most ``dims`` values per hot cluster
    centroids = sums.groupBy("c").agg(F.collect_list(F.struct("gene", "sx")).alias("s")).join(moments, "c").join(hot, "c")
    centroids = centroids.select("c", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("bigint").alias("cell_id"), F.col("s.gene").alias("genes"), F.col("s.sx").alias("values"), "n", "sb")
    members = spread.select("c", "salt", "cell_id", "genes", F.col("counts").cast("array<double>").alias("values"), F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("sb"))
    ordered = centroids.unionByName(members).repartition(tasks, "c", "salt").sortWithinPartitions("c", "salt", F.asc_nulls_first("cell_id"))
    scored = scored.unionByName(ordered.mapInArrow(functools.partial(_score_spread, dims=dims), SCORES))
    return scratch.keep(scored.filter(F.col("score") >= join_similarity).select("cell_id", "c", "score"))


#: Rows of a cluster that one task takes.
HOT_ROWS = 10_000
SCORES = "cell_id bigint, c bigint, score double"


class _Sparse:
    """Sparse rows, scaled: the entries x = value * scale, their rows and genes, and b = mean * scale of each row."""

    def __init__(self, genes: pa.Array, values: pa.Array, dims: int):
        self.gene, bounds = flat_lists(genes)
        value = flat_lists(values)[0].astype(np.float64)
        self.n = len(bounds) - 1
        self.row = np.repeat(np.arange(self.n), np.diff(bounds))
        total, squares = np.bincount(self.row, value, self.n), np.bincount(self.row, value * value, self.n)
        spread = squares - total * total / dims
        scale = np.where(spread > 1e-12 * np.maximum(squares, 1e-300), 1.0 / np.sqrt(np.maximum(spread, 1e-300)), 0.0)
        self.x, self.b, self.rx = value * scale[self.row], total / dims * scale, total * scale

    def dot(self, at_entry: np.ndarray, tx: np.ndarray | float, sb: np.ndarray | float, dims: int) -> np.ndarray:
        """<row, centroid sum> over all features, zeros included: with row = x - b and sum = sx - sb."""
        return np.bincount(self.row, self.x * at_entry, self.n) - sb * self.rx - self.b * tx + dims * self.b * sb


def _score_whole(frames: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """Scores rows that come in the order of their clusters, many whole clusters at once."""
    held: list[pa.RecordBatch] = []

    def scores(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        c = table["c"].to_numpy()
        cluster = np.cumsum(np.concatenate([[0], c[1:] != c[:-1]])) if len(c) else c
        rows = _Sparse(table["genes"].combine_chunks(), table["counts"].combine_chunks(), dims)
        m = int(cluster[-1]) + 1
        _, key = np.unique(cluster[rows.row] * np.int64(dims) + rows.gene, return_inverse=True)
        sx = np.bincount(key.ravel(), rows.x)
        n, sb, tx = np.bincount(cluster, minlength=m), np.bincount(cluster, rows.b, m), np.bincount(cluster, rows.rx, m)
        score = rows.dot(sx[key.ravel()], tx[cluster], sb[cluster], dims) / n[cluster]
        return pa.RecordBatch.from_arrays([table["cell_id"].combine_chunks(), pa.array(c), pa.array(score)], ["cell_id", "c", "score"])

    for frame in frames:
        if not frame.num_rows:
            continue
        held.append(frame)
        if held[0].column(0)[0].as_py() == frame.column(0)[-1].as_py():
            continue
        # all but the last cluster are whole
        table = pa.Table.from_batches(held).combine_chunks()
        c = table["c"].to_numpy()
        cut = int(np.searchsorted(c, c[-1]))
        yield scores(table.slice(0, cut))
        held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield scores(pa.Table.from_batches(held))


def _score_spread(frames: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """Scores rows of large clusters; the row without an id before those of a cluster holds its centroid."""
    centroid, n, sb = np.zeros(dims), 1, 0.0
    for frame in frames:
        table = pa.Table.from_batches([frame])
        heads = np.nonzero(table["cell_id"].combine_chunks().is_null().to_numpy(zero_copy_only=False))[0].tolist()
        for low, high in zip([0, *heads], [*heads, table.num_rows]):
            part = table.slice(low, high - low).combine_chunks()
            if low in heads and high > low:
                centroid = np.zeros(dims)
                centroid[np.array(part["genes"][0].as_py(), np.int64)] = part["values"][0].as_py()
                n, sb = part["n"][0].as_py(), part["sb"][0].as_py()
                part = part.slice(1).combine_chunks()
            if part.num_rows:
                rows = _Sparse(part["genes"].chunk(0), part["values"].chunk(0), dims)
                score = rows.dot(centroid[rows.gene], centroid.sum(), sb, dims) / n
                yield pa.RecordBatch.from_arrays([part["cell_id"].chunk(0), part["c"].chunk(0), pa.array(score)], ["cell_id", "c", "score"])


def _with_moments(rows: DataFrame, dims: int) -> DataFrame:
    """With the mean and 1 / (length of the centred row) of each sparse row."""
    total = F.aggregate("counts", F.lit(0.0), lambda a, x: a + x.cast("double"))
    squares = F.aggregate("counts", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = rows.withColumn("_total", total).withColumn("_spread", squares - F.col("_total") * F.col("_total") / dims)
    scale = F.when(F.col("_spread") > 0, 1.0 / F.sqrt("_spread")).otherwise(0.0)
    return rows.withColumn("mean", F.col("_total") / dims).withColumn("scale", scale).drop("_total", "_spread")
