"""Exact Pearson similarity: of given pairs, and of all pairs with the k best per row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructField, StructType

from countgrid.session import spread

#: Rows of a tile: two tiles are compared as one matrix product.
TILE_ROWS = 1024
#: Rows of a block at most; a group of a pair of blocks holds twice as many packed rows.
BLOCK_ROWS = 32_768
#: Dense values of a tile at once: wider tiles are multiplied by ranges of their features.
TILE_VALUES = 4_000_000
#: Whole numbers below this are exact in single precision.
MOST_EXACT = 1 << 24
#: Features up to which pairs are first bounded in the space of the principal directions, and the number of these.
BOUND_FEATURES, DIRECTIONS = 8192, 64
#: Candidates that a pair of blocks collects before those below the bounds of their rows are dropped.
MOST_CANDIDATES = 2_000_000
#: Tasks over which the pairs of blocks are spread, at most.
MOST_TASKS = 20_000


def pearson(n: Column | int, sx: str, sy: str, sxx: str, syy: str, sxy: str) -> Column:
    """From the sums over all n features, zeros included; null where a side is constant."""
    n = F.lit(n) if isinstance(n, int) else n
    x, y = n * F.col(sxx) - F.col(sx) * F.col(sx), n * F.col(syy) - F.col(sy) * F.col(sy)
    down = F.sqrt(F.greatest(x, F.lit(0.0))) * F.sqrt(F.greatest(y, F.lit(0.0)))
    return F.try_divide(n * F.col(sxy) - F.col(sx) * F.col(sy), F.nullif(down, F.lit(0.0)))


def pair_similarity(values: DataFrame, pairs: DataFrame, n: int, row: str = "cell_id", feature: str = "gene_id", value: str = "count") -> DataFrame:
    """Adds ``exact`` to ``pairs`` (``id0, id1, ...``): the similarity over ``n`` features.

    Every pair meets the packed values of its two rows, so that a pair is one row in each shuffle.
    The joins are merges: pairs and rows grow with the data and are never sent to the driver.
    """
    kind = "float" if values.schema[value].dataType == FloatType() else "double"  # single-precision counts travel as they are
    rows = packed(values, row, feature, value, kind, ordered=True)
    side = lambda k: rows.select(F.col("id").alias(f"id{k}"), F.col("features").alias(f"f{k}"), F.col("values").alias(f"v{k}")).hint("merge")
    kept = ["id0", "id1", *(c for c in pairs.columns if c not in ("id0", "id1"))]
    known = pairs.filter("id0 IS NOT NULL AND id1 IS NOT NULL").select(*kept)
    joined = known.join(side(0), "id0", "left").join(side(1), "id1", "left")
    lists = [F.coalesce(f"{c}{k}", F.array().cast(of)).alias(f"{c}{k}") for k in (0, 1) for c, of in (("f", "array<int>"), ("v", f"array<{kind}>"))]
    sums = ("_sx", "_sxx", "_sy", "_syy", "_sxy")

    def add(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            m, sides, out = frame.num_rows, [], []
            for at in (len(kept), len(kept) + 2):
                own = np.repeat(np.arange(m), pc.list_value_length(frame.column(at)).to_numpy())
                v = frame.column(at + 1).flatten().to_numpy().astype(np.float64)
                sides.append((own, frame.column(at).flatten().to_numpy().astype(np.int64), v))
                out += [np.bincount(own, v, m), np.bincount(own, v * v, m)]
            (own0, f0, v0), (own1, f1, v1) = sides
            dots = np.zeros(m)
            if len(f0) and len(f1):
                span = max(f0.max(), f1.max()) + 1
                keys0, keys1 = own0 * span + f0, own1 * span + f1
                order = np.argsort(keys0, kind="stable")
                spot = np.minimum(np.searchsorted(keys0, keys1, sorter=order), len(order) - 1)
                hit = keys0[order[spot]] == keys1
                dots = np.bincount(own1[hit], v1[hit] * v0[order[spot[hit]]], m)
            yield pa.RecordBatch.from_arrays([*frame.columns[: len(kept)], *(pa.array(x.astype(np.float64)) for x in (*out, dots))], [*kept, *sums])

    schema = StructType([known.schema[c] for c in kept] + [StructField(c, DoubleType()) for c in sums])
    summed = joined.select(*kept, *lists).mapInArrow(add, schema)
    return summed.select(*kept, pearson(n, "_sx", "_sy", "_sxx", "_syy", "_sxy").alias("exact"))


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    """The k most similar partners of every ``id0``, with their rank; ties go to the smaller partner.

    Spark prunes each task's groups to k rows before the shuffle (WindowGroupLimit).
    """
    order = Window.partitionBy("id0").orderBy(F.desc("similarity"), "id1")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def packed(values: DataFrame, row: str, feature: str, value: str, kind: str = "double", ordered: bool = False) -> DataFrame:
    """``id, features, values`` with the features of a row in one pair of arrays, the values as ``kind``; ``ordered`` features compress better."""
    entries = F.collect_list(F.struct(F.col(feature).cast("int").alias("f"), F.col(value).cast(kind).alias("v")))
    pairs = spread(values.withColumn("id", F.col(row)), "id").groupBy("id").agg((F.sort_array(entries) if ordered else entries).alias("p"))
    return pairs.select(F.col("id").cast("bigint").alias("id"), F.col("p.f").alias("features"), F.col("p.v").alias("values"))


def block_count(n: int, block_rows: int, tasks: int) -> int:
    """Blocks of at most ``block_rows`` rows; more, down to half a tile, where their pairs would leave tasks idle."""
    return max(1, -(-n // block_rows), min(-(-2 * n // TILE_ROWS), int(np.ceil(np.sqrt(4 * tasks)))))


def block_pairs(rows: DataFrame, columns: list[str], kernel, schema: str, block_rows: int = BLOCK_ROWS, tile_rows: int = TILE_ROWS, k: int | None = None, *, whole=None) -> DataFrame:
    """Runs ``kernel(table of tile a, table of tile b, same)`` on every unordered pair of row tiles.

    ``whole(table of block a, table of block b, same, tile rows)`` does a pair of blocks at once, unless it gives None.

    Rows are spread over blocks by a hash of their id; a block joins each pair it is part of, so
    that a row travels as often as there are blocks. A group holds two blocks of bounded size and
    goes through them tile by tile. The kernel decides what little comes out; with ``k`` only the
    k best of a row leave a group. The work is quadratic in the rows, as it is for any exact search.
    """
    n = rows.count()
    blocks = block_count(n, block_rows, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    placed = rows.select("id", *columns, own.alias("block")).select("*", other.alias("other"))
    placed = placed.select("id", *columns, "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))

    def tiles(block: pa.Table) -> list[pa.Table]:
        return [block.slice(at, tile_rows).combine_chunks() for at in range(0, block.num_rows, tile_rows)]

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        a, b = group["a"][0].as_py(), group["b"][0].as_py()
        block = group["block"].to_numpy()
        order = np.argsort(group["id"].to_numpy(), kind="stable")
        first = group.take(pa.array(order[block[order] == a])).combine_chunks()
        second = first if a == b else group.take(pa.array(order[block[order] == b])).combine_chunks()
        del group
        if whole is not None and (out := whole(first, second, a == b, tile_rows)) is not None:
            return out
        left = tiles(first)
        right = left if a == b else tiles(second)
        parts = [kernel(x, y, a == b and i == j) for i, x in enumerate(left) for j, y in enumerate(right) if a != b or i <= j]
        out = pa.concat_tables(parts) if parts else kernel(first.slice(0, 0).combine_chunks(), second.slice(0, 0).combine_chunks(), False)
        return out if k is None or len(parts) < 2 else _best_rows(out, k)

    tasks = min(blocks * (blocks + 1) // 2, MOST_TASKS)
    return placed.repartition(tasks, "a", "b").groupBy("a", "b").applyInArrow(run, schema)


def _best_rows(pairs: pa.Table, k: int) -> pa.Table:
    """The k best pairs of every ``id0``, ties by ``id1``."""
    id0 = pairs["id0"].to_numpy()
    order = np.lexsort((pairs["id1"].to_numpy(), -pairs["similarity"].to_numpy(), id0))
    first = np.ones(len(order), bool)
    first[1:] = id0[order][1:] != id0[order][:-1]
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return pairs.take(pa.array(order[place < k]))


def _entries(table: pa.Table, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of the entries of packed rows, and the place among ``features`` and the value of each entry."""
    if not table.num_rows:
        return np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0)
    lists = table["features"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    values = table["values"].combine_chunks()
    values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
    bounds = lists.offsets.to_numpy().astype(np.int64)
    return bounds - bounds[0], np.searchsorted(features, lists.flatten().to_numpy()), values.flatten().to_numpy().astype(np.float64)


def _features(*tables: pa.Table) -> np.ndarray:
    lists = [pc.unique(c.flatten()).to_numpy() for t in tables for c in t["features"].chunks if len(c)]
    return np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.int64)


def _scales(s: np.ndarray, ss: np.ndarray, n: int) -> np.ndarray:
    """One over the length of each centred row; 0 where a row is constant."""
    spread = ss - s * s / n
    return np.where(spread > 1e-12 * np.maximum(ss, 1e-300), 1 / np.sqrt(np.maximum(spread, 1e-300)), 0)


def dot_tiles(left: pa.Table, right: pa.Table, n: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Products of two tiles of packed rows, and for each side the sums of its rows and one over their centred lengths.

    The dense form of the tiles is made for a range of their features at a time, so that it is bounded for rows of any length.
    Whole numbers are multiplied in single precision where no product of two rows exceeds what it holds exactly.
    """
    features = _features(left, right)
    step = max(1, TILE_VALUES // max(1, left.num_rows, right.num_rows))
    sides, whole, longest = [], True, 1.0
    for t in (left, right):
        bounds, at, v = _entries(t, features)
        own = np.repeat(np.arange(t.num_rows), np.diff(bounds))
        s, ss = np.bincount(own, v, t.num_rows), np.bincount(own, v * v, t.num_rows)
        whole, longest = whole and bool((v == np.floor(v)).all()), longest * np.sqrt(ss.max(initial=0))
        order = np.argsort(at // step, kind="stable") if len(features) > step else slice(None)
        sides.append((own[order], at[order], v[order], s, _scales(s, ss, n)))
    # every partial sum of a product is at most the product of the rows' lengths, also of values of both signs
    kind = np.float32 if whole and longest < MOST_EXACT else np.float64

    def dense(side: tuple, m: int, low: int) -> np.ndarray:
        own, at, v = side[:3]
        some = slice(*np.searchsorted(at // step, [low // step, low // step + 1])) if len(features) > step else slice(None)
        out = np.zeros((m, min(step, len(features) - low)), kind)
        out[own[some], at[some] - low] = v[some]
        return out

    score = None
    for low in range(0, len(features), step):
        part = dense(sides[0], left.num_rows, low) @ dense(sides[1], right.num_rows, low).T
        score = part if score is None else score + part
    return np.zeros((left.num_rows, right.num_rows), kind) if score is None else score, sides[0][3:], sides[1][3:]


def pearson_tiles(left: pa.Table, right: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of two tiles of packed rows and their similarities over ``n`` features; -2 where a row is constant."""
    score, (sx, cx), (sy, cy) = dot_tiles(left, right, n)
    # centred product without densifying the zeros outside the tiles' features
    score = (score - np.outer(sx, sy) / n) * cx[:, None] * cy[None, :]
    return left["id"].to_numpy(), right["id"].to_numpy(), np.round(np.where((cx[:, None] > 0) & (cy[None, :] > 0), score, -2), 9)


class _Side:
    """The rows of a block that aren't constant, in the order they are compared, with what is known of their k best."""

    def __init__(self, table: pa.Table, features: np.ndarray, n: int, k: int, least: float):
        self.ids, (self.bounds, self.at, self.v), self.n, self.width = table["id"].to_numpy(), _entries(table, features), n, len(features)
        own = np.repeat(np.arange(len(self.ids)), np.diff(self.bounds))
        self.s = np.bincount(own, self.v, len(self.ids))
        self.scale = _scales(self.s, np.bincount(own, self.v * self.v, len(self.ids)), n)
        self.base = -self.s / n * self.scale
        self.z = (self.v * self.scale[own] + self.base[own]).astype(np.float32)
        self.rows = np.nonzero(self.scale > 0)[0]
        self.best = np.full((len(self.rows), k), -np.inf, np.float32)
        self.low = np.full(len(self.rows), least, np.float32)
        self.found: list[tuple] = []
        self.size = 0

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each entry of some rows the place of its row among them, and of the entry."""
        lengths = self.bounds[rows + 1] - self.bounds[rows]
        ends = np.cumsum(lengths)
        return np.repeat(np.arange(len(rows)), lengths), np.arange(lengths.sum()) + np.repeat(self.bounds[rows] - (ends - lengths), lengths)

    def dense(self, rows: np.ndarray) -> np.ndarray:
        """Centred rows of length 1; a last column stands for the zeros of all features that no row has."""
        out = np.empty((len(rows), self.width + 1), np.float32)
        out[:] = self.base[rows, None]
        out[:, -1] *= np.sqrt(self.n - self.width)
        own, e = self.entries(rows)
        out[own, self.at[e]] = self.z[e]
        return out

    def project(self, basis: np.ndarray, tile: int) -> None:
        parts = [self.dense(self.rows[at : at + tile]) @ basis for at in range(0, len(self.rows), tile)]
        inside = np.concatenate(parts) if parts else np.zeros((0, basis.shape[1]), np.float32)
        rest = np.sqrt(np.maximum(1 - (inside.astype(np.float64) ** 2).sum(axis=1), 0) + 1e-5)
        self.space = np.hstack([inside, rest[:, None].astype(np.float32)])

    def arrange(self, leaders: np.ndarray) -> None:
        """Rows near the same leader stand together, those far from the directions last, so that tiles are far apart as a whole."""
        nearest = np.argmax(self.space[:, :-1] @ leaders.T, axis=1) if len(leaders) else np.zeros(len(self.rows), np.int64)
        order = np.lexsort((nearest, self.space[:, -1] > 0.8))
        self.rows, self.space = self.rows[order], self.space[order]

    def offer(self, places: np.ndarray, others: np.ndarray, score: np.ndarray, k: int, slack: float) -> None:
        """Takes what may be among the k best; of many in one tile only those around the k best in it."""
        low = self.low[places]
        hit = score > low[:, None]
        many = np.nonzero(np.count_nonzero(hit, axis=1) > 2 * k)[0]
        if len(many):
            some = score[many]
            least = np.maximum(low[many], np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k] - 2 * slack)
            hit[many] = some > least[:, None]
        i, j = np.nonzero(hit)
        if not len(i):
            return
        value = score[i, j]
        self.found.append((places[i].astype(np.int32), others[j].astype(np.int32), value))
        self.size += len(i)
        u, row = np.unique(i, return_inverse=True)
        row, value = np.concatenate([np.repeat(np.arange(len(u)), k), row]), np.concatenate([self.best[places[u]].ravel(), value])
        order = np.lexsort((-value, row))
        starts = np.searchsorted(row[order], np.arange(len(u)))
        self.best[places[u]] = value[order][starts[:, None] + np.arange(k)]
        self.low[places[u]] = np.maximum(self.low[places[u]], self.best[places[u], -1] - 2 * slack)
        if self.size > MOST_CANDIDATES:
            self.candidates()

    def candidates(self) -> tuple[np.ndarray, np.ndarray]:
        places, others, value = (np.concatenate(c) if self.found else np.zeros(0, np.int32) for c in (zip(*self.found) if self.found else ((), (), ())))
        kept = value > self.low[places]
        self.found = [(places[kept], others[kept], value[kept])]
        self.size = 0
        return self.found[0][:2]

    def exact(self, rows: np.ndarray, other: _Side, others: np.ndarray) -> np.ndarray:
        """Similarities in double precision."""
        order = np.argsort(rows, kind="stable")
        out = np.zeros(len(rows))
        longest = int((other.bounds[1:] - other.bounds[:-1]).max(initial=1))
        step = max(1, min(TILE_VALUES // max(1, longest), TILE_VALUES // max(1, self.width)))
        for at in range(0, len(rows), step):
            some = order[at : at + step]
            own, row = np.unique(rows[some], return_inverse=True)
            x = np.zeros((len(own), self.width))
            place, e = self.entries(own)
            x[place, self.at[e]] = self.v[e]
            pair, e = other.entries(others[some])
            out[some] = np.bincount(pair, x[row[pair], other.at[e]] * other.v[e], len(some))
        return np.round((out - self.s[rows] * other.s[others] / self.n) * self.scale[rows] * other.scale[others], 9)


def _basis(sides: list[_Side]) -> np.ndarray:
    """Orthonormal columns near the principal directions of some rows of both sides; any such columns give right bounds."""
    some = np.concatenate([s.dense(s.rows[:: max(1, len(s.rows) // 512)][:512]) for s in sides])
    basis = np.random.default_rng(1).standard_normal((some.shape[1], min(DIRECTIONS, some.shape[1])))
    for _ in range(4):
        basis = np.linalg.qr(some.T @ (some @ basis))[0]
    return basis.astype(np.float32)


def _leaders(space: np.ndarray) -> np.ndarray:
    """Of some rows near the directions those that are far from each other."""
    near = space[space[:, -1] < 0.8]
    near = near[:: max(1, len(near) // 1024), :-1]
    near, picked = near / np.linalg.norm(near, axis=1, keepdims=True), []
    while len(near) and len(picked) < 128:
        picked.append(near[0])
        near = near[near @ near[0] < 0.6]
    return np.array(picked)


def _nearest(left: pa.Table, right: pa.Table, same: bool, n: int, k: int, threshold: float, tile: int) -> pa.Table | None:
    """The k best partners of every row of two blocks, exactly; None if the rows have too many features for it.

    A similarity is at most the product within some directions plus that of the lengths outside of
    them. Only pairs for which this, and then the product in single precision, exceed the k best
    so far (less the error of single precision) can be among the k best; these are compared in double precision.
    """
    features = _features(left, right)
    if len(features) > min(n, BOUND_FEATURES):
        return None
    slack = 1.2e-7 * (len(features) + 100)
    a = _Side(left, features, n, k, threshold - slack)
    b = a if same else _Side(right, features, n, k, threshold - slack)
    sides = [a] if same else [a, b]
    basis = _basis(sides)
    for side in sides:
        side.project(basis, tile)
    leaders = _leaders(a.space)
    for side in sides:
        side.arrange(leaders)
    # tiles of the same leaders first: what these leave to find is little, so that most of the others are left out
    grid = [(i, j) for i in range(0, len(a.rows), tile) for j in range(i if same else 0, len(b.rows), tile)]
    apart = lambda i, j: abs(i * len(b.rows) - j * len(a.rows)) > tile * max(len(a.rows), len(b.rows))
    near, far = ([t for t in grid if apart(*t) == side] for side in (False, True))
    before, x = -1, None
    for i, j in near + far:
            x, before = x if i == before else None, i
            bound = a.space[i : i + tile] @ b.space[j : j + tile].T
            hit = bound > a.low[i : i + tile, None]
            hit |= bound > b.low[None, j : j + tile]
            r = np.nonzero(hit.any(axis=1))[0]
            if not len(r):
                continue
            c = np.nonzero(hit.any(axis=0))[0]
            x = a.dense(a.rows[i : i + tile]) if x is None else x
            score = (x if len(r) == len(x) else x[r]) @ b.dense(b.rows[j + c]).T
            diagonal = same and i == j
            if diagonal:
                score[r[:, None] == c[None, :]] = -3
            a.offer(i + r, j + c, score, k, slack)
            if not diagonal:
                b.offer(j + c, i + r, np.ascontiguousarray(score.T), k, slack)
    parts = []
    for side, other in [(a, b)] if same else [(a, b), (b, a)]:
        places, others = side.candidates()
        rows, others = side.rows[places], other.rows[others]
        value = side.exact(rows, other, others)
        good = value > threshold
        parts.append(_best_rows(pairs_table(([side.ids[rows[good]]], [other.ids[others[good]]], [value[good]])), k))
    return pa.concat_tables(parts).combine_chunks()


def best_of_block(ids0: np.ndarray, ids1: np.ndarray, score: np.ndarray, k: int, threshold: float) -> tuple[list, list, list]:
    """Up to k best columns above the threshold for each row of a score matrix, ties by id."""
    good = score > threshold
    columns = score.shape[1]
    if columns > k and good.any():
        good &= score >= np.partition(score, columns - k, axis=1)[:, columns - k, None]
    row, column = np.nonzero(good)
    value = score[row, column]
    order = np.lexsort((ids1[column], -value, row))
    row, column, value = row[order], column[order], value[order]
    counts = np.bincount(row, minlength=len(ids0))
    keep = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) < k
    return [ids0[row[keep]]], [ids1[column[keep]]], [value[keep]]


PAIRS = "id0 bigint, id1 bigint, similarity double"


def pairs_table(parts: tuple[list, list, list]) -> pa.Table:
    names, types = ("id0", "id1", "similarity"), (np.int64, np.int64, np.float64)
    return pa.table({n: np.concatenate(p).astype(t) if p else np.zeros(0, t) for n, p, t in zip(names, parts, types)})


def exact_pairs(values: DataFrame, n: int, k: int = 100, threshold: float = 0.2, row: str = "cell_id", feature: str = "gene_id", value: str = "count") -> DataFrame:
    """The k most similar rows of every row with a similarity above ``threshold``: ``id0, id1, similarity, rank``.

    ``n`` is the number of features, zeros included. Both directions are ranked on their own.
    """

    def kernel(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        idx, idy, score = pearson_tiles(left, right, n)
        if same:
            np.fill_diagonal(score, -2)
        parts = best_of_block(idx, idy, score, k, threshold)
        if not same:
            parts = tuple(p + q for p, q in zip(parts, best_of_block(idy, idx, score.T, k, threshold)))
        return pairs_table(parts)

    rows = packed(values, row, feature, value)
    whole = lambda left, right, same, tile: _nearest(left, right, same, n, k, threshold, tile)
    return top_k(block_pairs(rows, ["features", "values"], kernel, PAIRS, k=k, whole=whole), k)


#: Rows of one block of queries, and of one block of the rows they are compared with.
QUERY_ROWS, AGAINST_ROWS = 4096, 16_384


def query_pairs(queries: DataFrame, rows: DataFrame, n: int, k: int, row: str = "cell_id", features: str = "genes", values: str = "counts") -> DataFrame:
    """``id0, id1, similarity``: the k most similar rows, within each block of ``rows``, of each row of ``queries``.

    Both sides hold packed rows. A query meets each block of rows once, and only k rows leave a block;
    ``top_k`` gives the best of all. The work is that of a stated set of queries against all rows.
    """

    def side(df: DataFrame, most: int, name: str) -> tuple[DataFrame, int]:
        blocks = max(1, -(-df.count() // most))
        own = F.pmod(F.xxhash64(row), F.lit(blocks)).cast("int").alias(name)
        return df.select(F.col(row).cast("bigint").alias("id"), F.col(features).alias("features"), F.col(values).cast("array<double>").alias("values"), own), blocks

    (asked, n_asked), (held, n_held) = side(queries, QUERY_ROWS, "a"), side(rows, AGAINST_ROWS, "b")
    asked = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_held - 1))).alias("b"), F.lit(True).alias("asked"))
    held = held.select("id", "features", "values", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))).alias("a"), "b", F.lit(False).alias("asked"))

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        flag = group["asked"].to_numpy(zero_copy_only=False)
        left, right = (group.take(pa.array(np.nonzero(flag == side)[0])) for side in (True, False))
        parts = []
        for i in range(0, left.num_rows, TILE_ROWS):
            for j in range(0, right.num_rows, TILE_ROWS):
                ids0, ids1, score = pearson_tiles(left.slice(i, TILE_ROWS).combine_chunks(), right.slice(j, TILE_ROWS).combine_chunks(), n)
                score[ids0[:, None] == ids1[None, :]] = -2
                parts.append(pairs_table(best_of_block(ids0, ids1, score, k, -1.5)))
        return _best_rows(pa.concat_tables(parts), k) if parts else pairs_table(([], [], []))

    tasks = min(n_asked * n_held, MOST_TASKS)
    return asked.unionByName(held).repartition(tasks, "a", "b").groupBy("a", "b").applyInArrow(run, PAIRS)
