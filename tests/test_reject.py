import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from countgrid.operators.reject import Failed, count_rows, diagnose, parse_block, parse_lines, split_strict, typed_meta

LINES = "line_id bigint, file_id int, line_no int, raw_line string, file_kind string"
FILES = "file_id int, file_kind string, separator_chars string, n_fields int, note string"
TYPES = {"ok": "boolean", "n": "integer", "day": "date", "x": "decimal"}
META = ["ok", "N", " day", "note"]


def parsed(spark, lines, files):
    df = parse_lines(spark.createDataFrame(lines, LINES), spark.createDataFrame(files, FILES), TYPES)
    return {r["line_id"]: r for r in df.collect()}, df


@pytest.mark.parametrize(
    "line,reason",
    [
        ("a,yes,1,2024-02-29,x", None),
        ('"a, b" ,"no",+01, 2020-01-01 ,"q\\"\\\\"', None),
        ("a,NA,?,-,", None),
        ("a,yes,1,2024-02-30,x", "value"),
        ("a,maybe,1,2024-02-28,x", "value"),
        ("a,yes,1.0,2024-02-28,x", "value"),
        (" ,yes,1,2024-02-28,x", "value"),
        ("a,yes,1,2024-02-28", "column_count"),
        ("", "column_count"),
        (' "a"b,yes,1,2024-02-28', "quoting"),
        ('a"b,yes,1,2024-02-28,x', "quoting"),
        ("a\\b,yes,1,2024-02-28,x", "quoting"),
        ('a,yes,1,2024-02-28,"x\\n"', "quoting"),
        ('a,yes,1,2024-02-28,"x', "quoting"),
        ('a,yes,1,2024-02-28,"x\\"', "quoting"),
        ("a\x1f,yes,1,2024-02-28,x", None),
    ],
)
def test_reasons(line, reason):
    types = ["boolean", "integer", "date", "string"]
    assert diagnose(line, "MetaData", ",", 5, types)[0] == reason
    try:
        columns, _ = parse_block(pa.array([line]), "MetaData", ",", 5, types)
    except Failed:
        assert reason is not None or "\x1f" in line
    else:
        assert reason is None
        assert [c[0].as_py() for c in columns] == split_strict(line, ",")


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet='ab1-." \\,;\t', max_size=14), st.sampled_from([",", ";", ",;", "\t", "|"]), st.sampled_from(["MetaData", "ExpressionMatrix"]))
def test_columnar_path_never_accepts_what_the_strict_parser_rejects(line, separators, kind):
    fields = split_strict(line, separators)
    width = len(fields) if fields else 3
    reason, fields = diagnose(line, kind, separators, width, ["integer"])
    try:
        columns, numbers = parse_block(pa.array([line]), kind, separators, width, ["integer"])
    except Failed:
        assert reason is not None
    else:
        assert reason is None and [c[0].as_py() for c in columns] == fields


def test_mixed_file_is_bisected(spark):
    rng = random.Random(3)
    lines, want = [(0, 1, 1, "﻿cell,ok,N, day,note", "x")], {}
    for i in range(1, 3000):
        if rng.random() < 0.05:
            want[i] = rng.choice(["quoting", "column_count", "value"])
        bad = {"quoting": 'c,"yes,1,2020-01-01,z', "column_count": "c,yes", "value": "c,yes,one,2020-01-01,z"}
        lines.append((i, 1, i + 1, bad.get(want.get(i), f'"c{i}",yes,{i},2020-01-01,z\r'), "x"))
    rng.shuffle(lines)
    got, df = parsed(spark, lines + lines[:500], [(1, "MetaData", ",", 5, "n")])
    assert len(got) == 2999 and {k: r["reason"] for k, r in got.items() if r["reason"]} == want
    meta = typed_meta(df).filter("field = 'n' and line_id = 17 or field = 'day' and line_id = 17")
    assert 17 in want or {r["field"]: (r["integer_value"], str(r["date_value"])) for r in meta.collect()} == {"n": (17, "None"), "day": (None, "2020-01-01")}


def test_matrix_and_odd_input(spark):
    lines = [
        (1, 7, 1, "c1|c2", None),
        (2, 7, 2, "g1|1e1|0", None),
        (3, 7, 3, "g2|-0|.5", None),
        (4, 7, 4, "g3|-1|5", None),
        (5, 7, 5, "g4|nan|5", None),
        (6, 7, 6, None, None),
        (7, 8, 2, "x", None),  # the file isn't listed
        (8, None, 2, "x", None),
        (None, 7, 2, "x", None),
        (9, 9, 2, "a;" + "b" * 100_000, None),  # no header line
        (10, 7, 9, "g1|2|2", None),  # a repeated name is no failure
    ]
    got, df = parsed(spark, lines, [(7, "ExpressionMatrix", "|", 3, None), (9, "MetaData", ",;", 2, None)])
    assert {k: r["reason"] for k, r in got.items()} == {2: None, 3: None, 4: "value", 5: "value", 6: "column_count", 7: "unknown_file", 9: None, 10: None}
    counts = {(r["gene_name"], r["cell_name"], r["line_id"]): r["count"] for r in count_rows(df).collect()}
    assert counts == {("g1", "c1", 2): 10.0, ("g2", "c2", 3): 0.5, ("g1", "c1", 10): 2.0, ("g1", "c2", 10): 2.0}


def test_empty(spark):
    assert parsed(spark, [], [])[0] == {}
