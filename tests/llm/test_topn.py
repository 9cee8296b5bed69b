import math
import random

from countgrid.llm.topn import top_n_per_group

SCHEMA = "g int, h string, score double, item bigint, n int, _hi string, _group int, tags map<string,int>"


def brute(rows, n=None):
    groups = {}
    for g, h, s, i, k, *_ in rows:
        if s is not None and not math.isnan(s) and i is not None and k is not None:
            groups.setdefault((g, h), {})[(-s + 0.0, i)] = k
    out = set()
    for key, items in groups.items():
        limit = n if n is not None else max(items.values())
        out |= {(*key, *x) for x in sorted(items)[: max(limit, 0)]}
    return out


def run(spark, rows, n="n", **kw):
    df = top_n_per_group(spark.createDataFrame(rows, SCHEMA), ["g", "h"], "score", "item", n, **kw)
    got = df.collect()
    keys = [(r["g"], r["h"], -r["score"] + 0.0, r["item"]) for r in got]
    assert len(keys) == len(set(keys)) and df.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    return set(keys)


def rows_of(rng, count, groups):
    rows = []
    for _ in range(count):
        g = rng.choice([None, *range(groups)])
        h = rng.choice([None, "", "x", "y" * 2000]) if g == 1 else "x"
        s = rng.choice([None, float("nan"), 0.0, -0.0, 0.5, 0.5, -3.5, rng.random(), 1e300, -1e300, float("inf")])
        rows.append((g, h, s, rng.choice([None, 2**62, -(2**62), *range(20)]), 3, "clash", 1, {"a": 1}))
    return rows


def test_against_brute_force(spark):
    rows = rows_of(random.Random(1), 1500, 6)
    assert run(spark, rows + rows[:200]) == brute(rows)


def test_hot_group_is_salted_and_ties_go_by_item(spark):
    rng = random.Random(2)
    rows = [(0, "x", rng.choice([0.5, 0.75]), i, 7, None, None, None) for i in range(3000)] + rows_of(rng, 300, 3)
    rows = [(*r[:4], 7, *r[5:]) for r in rows]
    assert run(spark, rows, hot_rows=100, bits=4) == brute(rows) == run(spark, rows, 7)


def test_nothing_to_keep(spark):
    assert run(spark, []) == set()
    row = (1, "x", 0.5, 1, 0, None, None, None)
    assert run(spark, [row]) == set() and run(spark, [row], -2) == set() and len(run(spark, [row], 5)) == 1
