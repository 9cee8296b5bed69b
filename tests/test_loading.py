import time

import pytest
from pyspark.sql import functions as F

from countgrid.operators import matrix
from countgrid.sources import delimited
from countgrid.store import MatrixStore


def test_lines_of_a_folder_are_numbered_by_name_and_not_by_size(spark, tmp_path):
    for name, first, n in (("part-00000.txt", 0, 2), ("part-00001.txt", 2, 3), ("part-00002.txt", 5, 4000)):
        (tmp_path / name).write_text("".join(f"line{i}\n" for i in range(first, first + n)))
    rows = {r["line"]: r["line_no"] for r in delimited.numbered_lines(spark, str(tmp_path)).collect()}
    assert rows == {f"line{i}": i + 1 for i in range(4005)}


def test_dense_rows_with_many_places(spark):
    n = 100_000
    genes = spark.range(n).select(F.col("id").cast("int").alias("gene_id"))
    counts = genes.filter("gene_id % 2 = 1").select(F.lit(4).alias("cell_id"), "gene_id", F.col("gene_id").cast("float").alias("count"))
    cells = spark.createDataFrame([(4,), (5,)], "cell_id int")
    began = time.time()
    rows = {r["cell_id"]: r["expression"] for r in matrix.dense_rows(counts, genes, cells).collect()}
    assert time.time() - began < 10  # looking each place up among the row's counts took longer by far
    assert rows == {4: [i if i % 2 else 0 for i in range(n)], 5: [0] * n}


def test_zeros_of_a_cells_line_are_left_out_as_they_are_parsed(spark, tmp_path):
    (tmp_path / "P1.csv").write_text('cell,batch,G0,G1,last\n"c0",0,0,3,0\nc1,1,0,0,x\n')
    lines, names = delimited.open_table(spark, str(tmp_path / "P1.csv"))
    rows = delimited.long_rows(lines, ",", len(names), without=("0",), within=range(1, 3)).collect()
    assert sorted((r["name"], r["position"], r["text"]) for r in rows) == [("c0", 0, "0"), ("c0", 2, "3"), ("c0", 3, "0"), ("c1", 0, "1"), ("c1", 3, "x")]
    store = MatrixStore(spark, str(tmp_path / "store"))
    store.add_cells_by_row(str(tmp_path / "P1.csv"), 1, 1)
    assert [store.get_cell_meta_data_value(0, f) for f in ("batch", "last")] == ["0", "0"] and store.gene_count() == 2
    assert [(r["cell_id"], r["gene_id"], r["count"]) for r in store.table("counts").collect()] == [(0, 1, 3.0)]
    (tmp_path / "P2.csv").write_text("cell,G0,G0\nc2,0,0\n")
    with pytest.raises(ValueError, match="repeats"):
        store.add_cells_by_row(str(tmp_path / "P2.csv"), 0, 0)
