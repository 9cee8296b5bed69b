import datetime as dt
from decimal import Decimal

from countgrid.operators.pivot import pivot_wide

T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
SCHEMA = "cell_id int, ord int, meta_name string, meta_value string, loaded_at timestamp, field string"
TYPES = {"n": "integer", "x": "decimal", "ok": "boolean", "day": "date"}


def wide(spark, rows, **kw):
    df, kinds = pivot_wide(spark.createDataFrame(rows, SCHEMA), TYPES, **kw)
    return {r["entity_id"]: r.asDict() for r in df.collect()}, kinds


ROWS = [
    (1, 0, "N", " +007 ", T0, "extra"),
    (1, 1, " n\t", "12x", T0, "extra"),  # equal time: the higher ord holds, and is not readable
    (2, 5, "n", "-3", T0, None),
    (2, 1, "n", "9", T1, None),  # the later row holds
    (2, 2, "X", "5e-3", T0, None),
    (2, 3, "ok", "YES", T0, None),
    (2, 4, "day", "2021-02-30", T0, None),
    (3, 0, "day", "2024-02-29", T0, None),
    (3, 1, "note", "N/A", T0, None),
    (3, 1, "note", "N/A", T0, None),
    (4, 0, "entity_id", "a`b", T0, None),
    (4, 0, "we.ird `q`", "v", T0, None),
    (5, 0, "note", None, T0, None),
    (None, 0, "note", "x", T0, None),
    (6, 0, None, "x", T0, None),
]


def test_values_and_ties(spark):
    got, kinds = wide(spark, ROWS)
    assert kinds["note"] == "string" and kinds["n"] == "integer"
    assert got[1]["n"] is None and got[2]["n"] == Decimal(9)
    assert got[2]["x"] == 0.005 and got[2]["ok"] is True and got[2]["day"] is None
    assert got[3]["day"] == dt.date(2024, 2, 29) and got[3]["note"] is None
    assert got[4]["entity_id (field)"] == "a`b" and got[4]["we.ird `q`"] == "v"
    assert set(got) == {1, 2, 3, 4, 5}


def test_blocks_agree(spark):
    assert wide(spark, ROWS)[0] == wide(spark, ROWS, block_columns=2)[0]


def test_blocks_join_without_another_shuffle(spark):
    df, _ = pivot_wide(spark.createDataFrame(ROWS, SCHEMA), TYPES, block_columns=3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    blocks = plan.count("SortMergeJoin")
    assert blocks >= 2 and plan.count("Exchange hashpartitioning") == blocks + 1  # of the ids and each block


def test_many_fields_are_read_block_by_block(spark):
    rows = [(c, f, f"Field {f}", f"{c}-{f}", T0, None) for c in range(20) for f in range(c % 3, 250)]
    df, kinds = pivot_wide(spark.createDataFrame(rows, SCHEMA), {}, block_columns=40)
    assert df.columns == ["entity_id", *sorted(f"field {f}" for f in range(250))] and len(kinds) == 250
    for r in df.collect():
        c = r["entity_id"]
        assert [r[f"field {f}"] for f in range(250)] == [f"{c}-{f}" if f >= c % 3 else None for f in range(250)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(block") >= 4  # each block reads its own folder


def test_empty(spark):
    got, kinds = wide(spark, [])
    assert got == {} and kinds == {}


def test_long_values_and_hot_entity(spark):
    rows = [(7, i, "note", "z" * 5000, T0, None) for i in range(500)] + [(7, 900, "n", "9" * 38, T0, None), (7, 901, "x", "1" * 400, T0, None)]
    got, _ = wide(spark, rows)
    assert len(got[7]["note"]) == 5000 and got[7]["n"] == Decimal("9" * 38)
