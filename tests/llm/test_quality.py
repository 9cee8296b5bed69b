import pyarrow as pa

from countgrid.llm.quality import classify_lines, lines_of, text_quality

LIST = "\n".join(f"{b} item {k}" for k, b in enumerate(["-", "*", "•", "1.", "(2)", "a)", "- [ ]", "- [x]"] * 4))
TABLE = "a;b;c\n" + "\n".join(f"row{k};1.5;{k}" for k in range(20))
GRID = "| a | b |\n|---|---|\n" + "\n".join(f"| x{k} | 1 |" for k in range(20))
ALIGNED = "\n".join(f"name{k}     1.5     2{k}" for k in range(20))
JUNK = "\n".join(["=" * 30, "a1z" * 12, "%$§°!?<>{}|^%", "kjh]fds[;lkj", "xkcd bcdfg hjklm npqrst", "00000010  de ad be ef 00 11 22 33"] * 4)
PROSE = "The first step is to read the counts. It is done with one line of code and takes a while.\r\n" * 12
CODE = "import sums as s\r\nfor k in values:\r    print(k, total)\nresult = {'a': 1, 'b': [2, 3]}\n" * 6


def test_layouts_and_reasons(spark):
    texts = {1: LIST, 2: TABLE, 3: GRID, 4: ALIGNED, 5: JUNK, 6: PROSE, 7: CODE, 8: None, 9: "", 10: " \t\r\n ", 11: PROSE + "\n" + TABLE}
    texts[12] = "\n".join("# " + line for line in TABLE.split("\n"))
    texts[13] = "z" * 3_000_000
    rows = [(k, t, "clash") for k, t in texts.items()] + [(None, PROSE, "x"), (6, PROSE, "again")]
    got = text_quality(spark.createDataFrame(rows, "doc_id bigint, text string, layout string")).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    want = {1: "list", 2: "table", 3: "table", 4: "table", 5: "junk", 6: None, 7: None, 8: None, 9: None, 10: None, 11: None, 12: "table", 13: "junk", None: None}
    assert {k: r["layout"] for k, r in by.items()} == want
    assert by[8]["reasons"] == by[9]["reasons"] == by[10]["reasons"] == ["empty"] and by[8]["words"] == 0 == by[10]["lines"]
    assert by[6]["reasons"] == [] and "layout_list" in by[1]["reasons"] and "bullet_lines_max" in by[1]["reasons"]
    assert by[6]["lines"] == 12 and by[6]["punctuation_line_share"] == 1.0 and by[6]["common_words"] >= 5
    assert "mean_word_max" in by[13]["reasons"] and by[13]["words"] == 1


def test_statistics(spark):
    row = text_quality(spark.createDataFrame([(1, "The cat, the DOG 42!\n# a…")], "doc_id bigint, text string")).first()
    assert (row["words"], row["lines"], row["common_words"]) == (6, 2, 2)
    assert abs(row["mean_word_length"] - 15 / 6) < 1e-9 and abs(row["common_word_share"] - 3 / 6) < 1e-9
    assert abs(row["symbol_share"] - 4 / 25) < 1e-9 and abs(row["symbol_word_ratio"] - 2 / 6) < 1e-9
    assert abs(row["alpha_word_share"] - 5 / 6) < 1e-9 and row["ellipsis_line_share"] == 0.5


def test_empty_table_and_line_ends(spark):
    assert text_quality(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    lines = lines_of(pa.array(["a\r\nb\rc\n\n \n#> d", None]))
    assert lines.text.to_pylist() == ["a", "b", "c", "d"] and lines.owner.tolist() == [0] * 4
    assert classify_lines(lines_of(pa.array(["", None]))).tolist() == []


def test_kinds_of_lines():
    """Columns must agree with a line beside; junk by characters; code and prose of like signs stay."""
    kinds = lambda text: classify_lines(lines_of(pa.array([text]))).tolist()
    assert kinds("Hello, dear friend, good day\nThis is text. It goes on.") == [0, 0]
    assert kinds("a,b,c\n1,2,3\n4,5,6") == [2, 2, 2] and kinds("a;b\nplain text\nc;d") == [0, 0, 0]
    assert kinds("x   y   z\n1   2   3") == [2, 2] and kinds("x   y   z") == [0]
    assert kinds("010 010 010 010\n¶¤¼ Ãœ€¼Ÿ¶ ½§µ\nab]cd;ef'g\nqpwoeirutyalskd") == [3] * 4
    assert kinds("x['key'];\nitems[0];\nsum(values)\nVisualisierung\nimport\ndon't stop\nDas Maß für 20 °C ist «neu»") == [0] * 7
