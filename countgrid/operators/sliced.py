"""Searches by slices of signatures: a block of rows keeps its best while all rows are streamed past it.

Only a row's own best leave its task. A signature travels as often as there are blocks, candidates never do.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block at most, rows that are streamed past it at once, and pairs that are compared at once.
OWN_ROWS, CHUNK_ROWS, PAIRS_AT_ONCE = 65_536, 131_072, 1 << 17
#: Rows of both sides from which a bucket is compared as a matrix product, and rows of a tile of it.
PRODUCT_ROWS, PRODUCT_TILE = 24, 2048
#: Found pairs after which those that are no longer among the best are dropped.
MOST_FOUND = 1 << 18
#: Rows whose candidates are told apart at once.
ROWS_AT_ONCE = 4096

FOUND = "id0 bigint, id1 bigint, similarity double, rank int"


def against_all(rows: DataFrame, others: DataFrame, search: Callable, own_rows: int = OWN_ROWS) -> DataFrame:
    """Streams ``others`` (``id, sig`` and maybe ``ids``) past each block of ``rows`` (``id, sig``), in chunks ordered by id.

    ``search()`` makes an object with ``begin(ids, words)``, ``meet(ids, words, lists)`` for each chunk and ``finish()``.
    """
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // own_rows), min(2 * cores, -(-n // 1024)))
    chunks = max(1, -(-n // CHUNK_ROWS))
    place = lambda of: F.pmod(F.xxhash64("id"), F.lit(of)).cast("int")
    lists = F.col("ids") if "ids" in others.columns else F.lit(None).cast("array<bigint>")
    own = rows.select(place(blocks).alias("a"), F.lit(-1).alias("chunk"), "id", "sig", F.lit(None).cast("array<bigint>").alias("ids"))
    every = others.select(place(chunks).alias("chunk"), "id", "sig", lists.alias("ids")).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("a"), "*")
    placed = own.unionByName(every).repartitionById(blocks, F.col("a")).sortWithinPartitions("a", "chunk", "id")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, parts = None, None, []

        def meet() -> None:
            table = pa.Table.from_batches(parts).combine_chunks()
            ids = table["id"].to_numpy()
            words = table["sig"].chunk(0).flatten().to_numpy().reshape(len(ids), -1)
            if at[1] < 0:
                state.begin(ids, words)
            else:
                state.meet(ids, words, table["ids"].chunk(0))
            parts.clear()

        for frame in frames:
            if not frame.num_rows:
                continue
            a, chunk = (frame.column(c).to_numpy() for c in (0, 1))
            cuts = [0, *(np.nonzero((np.diff(a) != 0) | (np.diff(chunk) != 0))[0] + 1).tolist(), len(a)]
            for low, high in zip(cuts[:-1], cuts[1:]):
                now = (int(a[low]), int(chunk[low]))
                if now != at:
                    if parts:
                        meet()
                    if at is None or now[0] != at[0]:
                        if state is not None:
                            yield from state.finish()
                        state = search()
                        if now[1] >= 0:  # no row of this block
                            state = _Nothing()
                    at = now
                parts.append(frame.slice(low, high - low))
        if parts:
            meet()
            yield from state.finish()

    return placed.mapInArrow(run, FOUND)


class _Nothing:
    def meet(self, *_) -> None:
        pass

    def finish(self) -> list:
        return []


def raw_bytes(words: np.ndarray) -> np.ndarray:
    """The bits of signatures in their order, eight a byte."""
    return words.astype(">i8").view(np.uint8).reshape(len(words), -1)


def slice_values(raw: np.ndarray, at: int, length: int) -> np.ndarray:
    """The number that the ``length`` bits of each row from bit ``at`` on make."""
    kind = next(t for t, most in ((np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if length <= most)
    if at % 16 == 0 and length == 16:
        return raw[:, at // 8 : at // 8 + 2].copy().view(">u2").ravel().astype(kind)
    first, last = at // 8, -(-(at + length) // 8)
    flags = np.unpackbits(raw[:, first:last], axis=1)[:, at - 8 * first :][:, :length]
    wide = np.zeros((len(raw), 8 * np.dtype(kind).itemsize), np.uint8)
    wide[:, wide.shape[1] - length :] = flags
    return np.packbits(wide, axis=1).view(np.dtype(kind).newbyteorder(">")).ravel().astype(kind)


def hashed(values: np.ndarray, log2_buckets: int) -> np.ndarray:
    """Spark's ``pmod(xxhash64(value), 2 ** log2_buckets)`` of whole numbers."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    rotated = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    h = np.full(len(values), np.uint64(42) + p5 + np.uint64(8)) ^ (rotated(values.astype(np.uint64) * p2, 31) * p1)
    h = rotated(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))) & np.uint64((1 << log2_buckets) - 1)


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which the rows of two sets of words differ."""
    counts = np.bitwise_count((x ^ y).view(np.uint64))  # of signed words it would count the bits of their absolute value
    if counts.shape[1] % 8:
        return counts.sum(axis=1, dtype=np.int64)
    bytes_ = counts.view(np.uint64)  # eight counts of at most 64 each, added up in lanes of 16 bits
    mask = np.uint64(0x00FF00FF00FF00FF)
    lanes = sum((bytes_[:, c] & mask) + ((bytes_[:, c] >> np.uint64(8)) & mask) for c in range(bytes_.shape[1]))
    fold = (lanes & np.uint64(0x0000FFFF0000FFFF)) + ((lanes >> np.uint64(16)) & np.uint64(0x0000FFFF0000FFFF))
    return ((fold & np.uint64(0xFFFFFFFF)) + (fold >> np.uint64(32))).astype(np.int64)


def _ramps(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` of each length, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(lengths.sum())


def _places(rows: np.ndarray) -> np.ndarray:
    """The place of each within its run of equal numbers."""
    first = np.ones(len(rows), bool)
    first[1:] = rows[1:] != rows[:-1]
    at = np.arange(len(rows))
    return at - np.maximum.accumulate(np.where(first, at, 0))


def _found(id0: np.ndarray, id1: np.ndarray, m: np.ndarray, rank: np.ndarray, bits: int) -> pa.RecordBatch:
    similarity = np.cos(np.arange(bits + 1) * math.pi / bits)[m]
    return pa.RecordBatch.from_arrays([pa.array(id0), pa.array(id1), pa.array(similarity), pa.array(rank.astype(np.int32))], ["id0", "id1", "similarity", "rank"])


class SlicedSearch:
    """The k best of every row among those that share a slice. Others come as the smallest ``k`` + 1 ids of each signature."""

    def __init__(self, bits: int, length: int, k: int, threshold: float):
        self.bits, self.length, self.k = bits, length, k
        passing = np.nonzero(np.cos(np.arange(bits + 1) * math.pi / bits) > threshold)[0]
        self.most = int(passing.max()) if len(passing) else -1

    def begin(self, ids: np.ndarray, words: np.ndarray) -> None:
        self.ids = ids
        _, first, self.own = np.unique(np.ascontiguousarray(words).view(f"V{8 * words.shape[1]}").ravel(), return_index=True, return_inverse=True)
        self.words, self.raw = words[first], raw_bytes(words[first])
        self.values = self._all_values(self.raw)
        self.limit = np.full(len(first), self.most)
        self.kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.new: list[tuple] = []
        self.size = 0

    def _all_values(self, raw: np.ndarray) -> np.ndarray:
        return np.stack([slice_values(raw, s * self.length, self.length) for s in range(self.bits // self.length)], axis=1)

    def meet(self, ids: np.ndarray, words: np.ndarray, lists: pa.ListArray) -> None:
        if self.most < 0:
            return
        self.members, self.bounds = lists.flatten().to_numpy(), lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        self.others, self.other_raw = words, raw_bytes(words)
        self.other_values = self._all_values(self.other_raw)
        for s in range(self.values.shape[1]):
            a, b = (np.argsort(v[:, s], kind="stable") for v in (self.values, self.other_values))
            (u, starts, n), (v, others, m) = (np.unique(x[o, s], return_index=True, return_counts=True) for x, o in ((self.values, a), (self.other_values, b)))
            _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
            large = np.minimum(n[i], m[j]) >= PRODUCT_ROWS
            for p, q in zip(i[large], j[large]):
                self._product(s, a[starts[p] : starts[p] + n[p]], b[others[q] : others[q] + m[q]])
            i, j = i[~large], j[~large]
            rows, at, many = a[_ramps(starts[i], n[i])], np.repeat(others[j], n[i]), np.repeat(m[j], n[i])
            ends = np.cumsum(many)
            low = 0
            while low < len(rows):
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS_AT_ONCE, "right")))
                x, y = np.repeat(rows[low:high], many[low:high]), b[_ramps(at[low:high], many[low:high])]
                d = differing(self.words[x], words[y])
                good = d <= self.limit[x]
                self._offer(s, x[good], y[good], d[good])
                low = high

    def _product(self, s: int, rows: np.ndarray, others: np.ndarray) -> None:
        signs = lambda raw: np.unpackbits(raw, axis=1)[:, : self.bits].astype(np.float32) * 2 - 1
        for low in range(0, len(others), PRODUCT_TILE):
            some = others[low : low + PRODUCT_TILE]
            y = signs(self.other_raw[some])
            for at in range(0, len(rows), PRODUCT_TILE):
                own = rows[at : at + PRODUCT_TILE]
                product = signs(self.raw[own]) @ y.T
                least = (self.bits - 2 * self.limit[own]).astype(np.float32)
                hit = product >= least[:, None]
                many = np.nonzero(np.count_nonzero(hit, axis=1) > 2 * (self.k + 1))[0]
                if len(many):  # those below k + 1 others in the tile are not among the best, whichever of these came before
                    part = product[many]
                    hit[many] = part >= np.partition(part, part.shape[1] - self.k - 1, axis=1)[:, part.shape[1] - self.k - 1, None]
                i, j = np.nonzero(hit)
                self._offer(s, own[i], some[j], ((self.bits - product[i, j]) / 2).round().astype(np.int64))

    def _offer(self, s: int, rows: np.ndarray, others: np.ndarray, m: np.ndarray) -> None:
        """Takes pairs that share slice ``s`` and none before it, so that each is taken once."""
        if not len(rows):
            return
        if s:
            once = ~(self.values[rows, :s] == self.other_values[others, :s]).any(axis=1)
            rows, others, m = rows[once], others[once], m[once]
        many = self.bounds[others + 1] - self.bounds[others]
        self.new.append((np.repeat(rows, many), np.repeat(m, many), self.members[_ramps(self.bounds[others], many)]))
        self.size += int(many.sum())
        if self.size > MOST_FOUND + len(self.kept[0]) // 2:
            self._prune()

    def _prune(self) -> None:
        rows, m, ids = (np.concatenate(c) for c in zip(self.kept, *self.new))
        near = m <= self.limit[rows]
        rows, m, ids = rows[near], m[near], ids[near]
        order = np.lexsort((ids, rows * (self.bits + 1) + m))
        rows, m, ids = rows[order], m[order], ids[order]
        place = _places(rows)
        keep = place <= self.k
        last = place == self.k
        self.limit[rows[last]] = m[last]
        self.kept, self.new, self.size = (rows[keep], m[keep], ids[keep]), [], 0

    def finish(self) -> Iterator[pa.RecordBatch]:
        self._prune()
        rows, m, ids = self.kept
        starts = np.searchsorted(rows, np.arange(len(self.limit)))
        many = np.diff(np.append(starts, len(rows)))
        for low in range(0, len(self.ids), ROWS_AT_ONCE):
            own = self.own[low : low + ROWS_AT_ONCE]
            at = _ramps(starts[own], many[own])
            id0 = np.repeat(self.ids[low : low + ROWS_AT_ONCE], many[own])
            id1, d = ids[at], m[at]
            apart = id0 != id1
            id0, id1, d = id0[apart], id1[apart], d[apart]
            place = _places(id0)
            first = place < self.k
            yield _found(id0[first], id1[first], d[first], place[first] + 1, self.bits)


class MultiSearch:
    """The k best among the first ``checks`` candidates of every row, in the order of (slice length, slice, id).

    ``most`` is the largest number of differing bits. Of a chunk each row takes its own first candidates; those of several chunks are merged.
    """

    def __init__(self, bits: int, lengths: list[int], checks: int, k: int, most: int, log2_buckets: int = 0):
        self.bits, self.checks, self.k, self.most, self.log2_buckets = bits, checks, k, most, log2_buckets
        self.slices = [(length, s * length) for length in lengths for s in range(bits // length)]

    def _values(self, raw: np.ndarray, p: int) -> np.ndarray:
        length, at = self.slices[p]
        values = slice_values(raw, at, length)
        return hashed(values, self.log2_buckets) if self.log2_buckets and length >= self.log2_buckets else values

    def begin(self, ids: np.ndarray, words: np.ndarray) -> None:
        self.ids, self.words, self.raw = ids, words, raw_bytes(words)
        self.last = np.full(len(ids), len(self.slices))
        none = tuple(np.zeros(0, t) for t in (np.int16, np.int16, np.int64, np.int16))
        self.held = [none for _ in range(0, len(ids), ROWS_AT_ONCE)]  # row within its few, slice, id, differing bits

    def meet(self, ids: np.ndarray, words: np.ndarray, _) -> None:
        raw, n = raw_bytes(words), len(self.ids)
        counts = np.zeros(n, np.int64)
        seen = [np.zeros(0, np.int64) for _ in range(0, n, ROWS_AT_ONCE)]
        parts: list[list] = [[] for _ in seen]
        for p in range(len(self.slices)):
            if not ((counts < self.checks) & (self.last >= p)).any():
                break
            values = self._values(raw, p)
            order = np.argsort(values, kind="stable")
            values, own = values[order], self._values(self.raw, p)
            for block, low in enumerate(range(0, n, ROWS_AT_ONCE)):
                some = slice(low, low + ROWS_AT_ONCE)
                rows = low + np.nonzero((counts[some] < self.checks) & (self.last[some] >= p))[0]
                if not len(rows):
                    continue
                by = np.argsort(own[rows], kind="stable")
                start = np.empty(len(rows), np.int64)
                many = np.empty(len(rows), np.int64)
                start[by] = np.searchsorted(values, own[rows][by])
                many[by] = np.minimum(np.searchsorted(values, own[rows][by], "right") - start[by], self.checks + 1)
                row, other = np.repeat(rows, many), order[_ramps(start, many)]
                key = row * len(ids) + other
                new = self.ids[row] != ids[other]
                if len(seen[block]):
                    spot = np.minimum(np.searchsorted(seen[block], key), len(seen[block]) - 1)
                    new &= seen[block][spot] != key
                row, other, key = row[new], other[new], key[new]
                first = counts[row] + _places(row) < self.checks
                row, other, key = row[first], other[first], key[first]
                counts[some] += np.bincount(row - low, minlength=len(counts[some]))
                seen[block] = np.sort(np.concatenate([seen[block], key]), kind="stable")
                for at in range(0, len(row), PAIRS_AT_ONCE):
                    i, j = row[at : at + PAIRS_AT_ONCE], other[at : at + PAIRS_AT_ONCE]
                    parts[block].append(((i - low).astype(np.int16), np.full(len(i), p, np.int16), ids[j], differing(self.words[i], words[j]).astype(np.int16)))
        for block, low in enumerate(range(0, n, ROWS_AT_ONCE)):
            fresh, held = not len(self.held[block][0]), tuple(np.concatenate(c) for c in zip(self.held[block], *parts[block]))
            parts[block], seen[block] = [], None
            if not fresh:
                order = np.lexsort((held[2], held[0].astype(np.int64) * len(self.slices) + held[1]))
                order = order[_places(held[0][order]) < self.checks]
                held = tuple(c[order] for c in held)
            self.held[block] = held
            some = self.last[low : low + ROWS_AT_ONCE]
            last = np.zeros(len(some), np.int64)
            np.maximum.at(last, held[0], held[1])
            some[:] = np.where(np.bincount(held[0], minlength=len(some)) >= self.checks, last, len(self.slices))

    def finish(self) -> Iterator[pa.RecordBatch]:
        for block, (rows, _, ids, m) in enumerate(self.held):
            own, near = self.ids[block * ROWS_AT_ONCE :][:ROWS_AT_ONCE], m <= self.most
            rows, ids, m = rows[near], ids[near], m[near].astype(np.int64)
            order = np.lexsort((ids, rows.astype(np.int64) * (self.bits + 1) + m))
            place = _places(rows[order])
            order, place = order[place < self.k], place[place < self.k]
            yield _found(own[rows[order]], ids[order], m[order], place + 1, self.bits)
