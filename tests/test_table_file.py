from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from countgrid.plans import store_queries


def test_counts_travel_one_by_one_to_the_lines_of_a_table_file(spark, tmp_path, monkeypatch):
    schemas = []
    kind = type(spark.range(1))
    real = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **k: (schemas.append(self.schema), real(self, *a, **k))[1])
    monkeypatch.setattr(store_queries, "LINES_AT_ONCE", 2)
    n = 40
    filled = {(r, c): r + c / 4 for r in range(n) for c in range(n) if r != 3 and (r * 7 + c) % 3}
    counts = spark.createDataFrame([(r, c, v) for (r, c), v in filled.items()] + [(n + 5, 1, 4.0), (1, n + 9, 4.0)], "row int, column int, count float")
    rows = spark.createDataFrame([(i, f'r"{i}') for i in reversed(range(n))], "id int, label string")
    columns = spark.createDataFrame([(i, f"c,{i}") for i in reversed(range(n))], "id int, label string")
    path = store_queries._write_dense(counts, rows, columns, f"{tmp_path}/table.csv", ",last", F.concat(F.lit(",z"), "id"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "table.csv").glob("part*"))).splitlines()
    text = lambda r, c: "0" if not filled.get((r, c)) else str(filled[r, c])
    head = "name," + ",".join(f'"c,{i}"' for i in range(n)) + ",last"
    assert path.endswith("table.csv")
    assert lines == [head, *(f'"r\\"{r}",' + ",".join(text(r, c) for c in range(n)) + f",z{r}" for r in range(n))]
    assert schemas and not any(isinstance(f.dataType, ArrayType) for s in schemas for f in s)
