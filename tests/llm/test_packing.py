import random

import numpy as np
import pytest

from countgrid.llm.packing import pack_texts, sum_of_squares, token_counts


def slow(sizes, capacity):
    """Tries every choice and recomputes the sum of squares."""
    bins = []
    for s in sizes:
        options = []
        for gap in sorted({capacity - b for b in bins if capacity - b >= s}) + [capacity]:
            trial = [capacity - b for b in bins]
            if gap == capacity:
                trial.append(capacity - s)
            else:
                trial[trial.index(gap)] = gap - s
            counts = np.bincount(np.array(trial), minlength=capacity + 1)[1:]
            options.append((int((counts.astype(int) ** 2).sum()), gap == capacity, gap))
        best = min(options)
        if best[1]:
            bins.append(s)
        else:
            k = max(k for k, b in enumerate(bins) if capacity - b == best[2])
            bins[k] += s
    return sorted(bins)


def test_places_by_the_sum_of_squares():
    rng = random.Random(1)
    for capacity in (1, 7, 20):
        for _ in range(20):
            sizes = [rng.randint(1, capacity) for _ in range(40)]
            got = np.bincount(sum_of_squares(np.array(sizes), capacity), sizes)
            assert sorted(got.astype(int).tolist()) == slow(sizes, capacity)


@pytest.mark.parametrize("share_items", [50_000, 150])
def test_containers(spark, share_items):
    rng = random.Random(2)
    sizes = [(i, rng.choice([0, 1, 5, 99, 100, 101, 250, rng.randint(1, 400)]), "x") for i in range(800)] + [(None, 30, "x"), (3, 44, "x"), (3, 44, "x"), (9000, None, "x")]
    rows = pack_texts(spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint, container string"), 100, share_items=share_items).collect()
    placed = [r for r in rows if r["container"] is not None]
    fill = {}
    for r in placed:
        fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
    total = sum(n or 0 for _, n, _ in sizes)
    assert max(fill.values()) <= 100 and sum(fill.values()) == total
    assert sorted(r["doc_id"] for r in rows if r["container"] is None) == sorted(i for i, n, _ in sizes if not n)
    for i, n, _ in sizes[:800]:
        own = sorted((r["first_token"], r["tokens"]) for r in placed if r["doc_id"] == i) if i != 3 else None
        if own is not None and n:
            assert [a for a, _ in own] == list(range(0, n, 100)) and all(t == 100 for _, t in own[:-1]) and sum(t for _, t in own) == n
    assert len(fill) <= 1.03 * total / 100 + 3


def test_odd_input(spark):
    empty = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert pack_texts(empty, 10).count() == 0
    with pytest.raises(ValueError):
        pack_texts(empty, 0)
    counted = token_counts(spark.createDataFrame([(1, None), (2, ""), (3, "a a <|endoftext|>"), (4, "word " * 50_000)], "doc_id bigint, text string"))
    got = {r["doc_id"]: r["n_tokens"] for r in counted.collect()}
    assert got[1] == got[2] == 0 and got[3] > 4 and got[4] == 50_001
