"""Searches by slices against brute force, in several chunks and tiles."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from countgrid.operators import lsh, sliced

BITS, N = 128, 700


def _rows(rng):
    base = rng.random((12, BITS)) < 0.5
    flags = base[rng.integers(12, size=N)] ^ (rng.random((N, BITS)) < rng.choice([0.0, 0.02, 0.15], size=(N, 1)))
    words = np.packbits(flags, axis=1).view(">u8").astype(np.uint64).view(np.int64)
    m = (flags[:, None] != flags[None]).sum(axis=2)
    return flags, words, m


def _best(m, allowed, k):
    out = set()
    for i in range(N):
        near = sorted((m[i, j], j) for j in np.nonzero(allowed[i])[0] if j != i)
        out |= {(i, r + 1, int(j), int(d)) for r, (d, j) in enumerate(near[:k])}
    return out


def _rows_of(batches, bits=BITS):
    table = pa.Table.from_batches(list(batches))
    m = (np.arccos(np.clip(table["similarity"].to_numpy(), -1, 1)) * bits / math.pi).round().astype(int)
    return set(zip(table["id0"].to_pylist(), table["rank"].to_pylist(), table["id1"].to_pylist(), m.tolist()))


@pytest.mark.parametrize("tile", [16, 2048])
def test_sliced_search_in_chunks(monkeypatch, tile):
    monkeypatch.setattr(sliced, "PRODUCT_TILE", tile)
    monkeypatch.setattr(sliced, "PRODUCT_ROWS", 8)
    monkeypatch.setattr(sliced, "PAIRS_AT_ONCE", 50)
    monkeypatch.setattr(sliced, "MOST_FOUND", 300)
    flags, words, m = _rows(np.random.default_rng(3))
    k, ids = 6, np.arange(N)
    parts = flags[:, :120].reshape(N, 1, 12, 10)
    share = (parts == parts.reshape(1, N, 12, 10)).all(axis=3).any(axis=2)
    want = _best(m, share & (np.cos(np.pi * m / BITS) > 0.5), k)
    search = sliced.SlicedSearch(BITS, 10, k, 0.5)
    search.begin(ids, words)
    text = [w.tobytes() for w in words]
    for chunk in range(3):
        firsts = [i for i in range(N) if text.index(text[i]) == i and i % 3 == chunk]
        lists = pa.array([[j for j in range(N) if text[j] == text[i]][: k + 1] for i in firsts], pa.list_(pa.int64()))
        search.meet(np.array(firsts), words[firsts], lists)
    got = _rows_of(search.finish())
    assert got == want and len(got) > 2 * N


@pytest.mark.parametrize("chunks", [1, 4])
def test_multi_slice_search_in_chunks(monkeypatch, chunks):
    monkeypatch.setattr(sliced, "ROWS_AT_ONCE", 150)
    flags, words, m = _rows(np.random.default_rng(4))
    k, checks, ids, most = 5, 25, np.arange(N), lsh.most_mismatches(0.5, BITS) - 1
    share = [(flags[:, None, at : at + n] == flags[None, :, at : at + n]).all(axis=2) for n in (15, 9) for at in range(0, BITS - n + 1, n)]
    allowed = np.zeros((N, N), bool)
    for i in range(N):
        seen = dict.fromkeys(int(j) for same in share for j in np.nonzero(same[i])[0] if j != i)
        allowed[i, list(seen)[:checks]] = True
    search = sliced.MultiSearch(BITS, [15, 9], checks, k, most)
    search.begin(ids, words)
    for chunk in range(chunks):
        search.meet(ids[chunk::chunks], words[chunk::chunks], None)
    assert _rows_of(search.finish()) == _best(m, allowed & (m <= most), k)


def test_hash_of_slices_is_that_of_spark(spark):
    values = [0, 1, 5, 65_535, (1 << 40) + 7, (1 << 62) + 3]
    rows = spark.createDataFrame([(v,) for v in values], "v bigint").select("v", F.pmod(F.xxhash64("v"), F.lit(1 << 12)).alias("h")).collect()
    assert sliced.hashed(np.array(values), 12).tolist() == [r["h"] for r in sorted(rows, key=lambda r: values.index(r["v"]))]


def test_sliced_searches_shuffle_no_candidates(spark):
    """One bucket of 3,000 rows with signatures of their own: 9 million candidates, of which none may leave its task as a row of a plan."""
    rng = np.random.default_rng(9)
    n = 3000
    flags = np.concatenate([np.ones((n, 16), bool), rng.random((n, 112)) < 0.5], axis=1)
    words = np.packbits(flags, axis=1).view(">u8").astype(np.uint64).view(np.int64)
    sigs = spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(words)], "id bigint, sig array<bigint>").cache()
    for found in (lsh.lsh_pairs_sliced(sigs, 128, 16, 0, 3, 0.5), lsh.lsh_pairs_multi_slice(sigs, 128, [16], 200, 3, 0.5)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and found.count() == len({(r["id0"], r["id1"]) for r in found.collect()})
