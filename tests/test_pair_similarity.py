import numpy as np

from countgrid.operators import similarity


def test_given_pairs_against_numpy_without_broadcasts(spark):
    rng = np.random.default_rng(3)
    x = rng.poisson(0.4, (30, 40)).astype(float)
    x[7] = 0
    values = spark.createDataFrame([(i, j, float(x[i, j])) for i, j in np.argwhere(x).tolist()], "cell_id int, gene_id int, count float")
    wanted = [(a, b, 0.5) for a in range(30) for b in range(30) if a != b] + [(1, 2, 0.25), (1, 99, 0.5), (None, 1, 0.5)]
    pairs = spark.createDataFrame(wanted, "id0 int, id1 int, similarity double")
    made = similarity.pair_similarity(values, pairs, 40)
    assert made.columns == ["id0", "id1", "similarity", "exact"]
    rows = made.collect()
    assert sorted((r["id0"], r["id1"], r["similarity"]) for r in rows) == sorted(w for w in wanted if w[0] is not None)
    for r in rows:
        if 7 in (r["id0"], r["id1"]) or r["id1"] == 99:
            assert r["exact"] is None
        else:
            assert abs(r["exact"] - np.corrcoef(x[r["id0"]], x[r["id1"]])[0, 1]) < 1e-9
    alone = similarity.pair_similarity(values, pairs.filter("id1 = 99").withColumn("id0", (pairs.id0 + 97).cast("int")), 40)
    assert [r["exact"] for r in alone.collect()] == [None]
    made.write.format("noop").mode("overwrite").save()
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") >= 2
