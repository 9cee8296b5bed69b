"""A directory of Parquet tables that holds a matrix, its meta data, sets, pairs and graphs.

Each table is a list of part folders. Adding rows writes only these, as a new part;
removing an object drops its parts from the list; only an update of values writes a
table anew. Every change ends with a new numbered manifest, written beside and renamed
into place: the highest number is the store, so a change that fails leaves the one
before. Methods take and give names and ids; the DataFrame operators do the work.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countgrid import sinks
from countgrid.functions.values import DECIMAL_PATTERN, full_match
from countgrid.operators import graphs, lsh, matrix, meta, sets, similarity
from countgrid.schema import NORMALISATIONS, SCHEMAS
from countgrid.session import Scratch
from countgrid.sources import delimited, tenx

ALL_CELLS, ALL_GENES = "AllCells", "AllGenes"


class MatrixStore:
    def __init__(self, spark: SparkSession, path: str, read_only: bool = False):
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._parts: dict[str, list[dict[str, str]]] = {}
        self._version = max(self._versions(), default=0)
        if self._version:
            text = spark.read.text(f"{self.path}/manifests/{self._version:012d}.json", wholetext=True).first()[0]
            self._parts = json.loads(text)
        elif read_only:
            raise FileNotFoundError(path)

    # --- tables ---

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]

    def table(self, name: str, only: str | None = None) -> DataFrame:
        """A table, or the rows of one object in it, for which only that object's parts are read."""
        parts = [p["path"] for p in self._parts.get(name, []) if only is None or p["of"] == only]
        if not parts:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.path}/{p}" for p in parts])

    def _write(self, name: str, rows: DataFrame, of: str) -> dict[str, str]:
        part = f"{name}/{uuid.uuid4().hex}"
        types = self.spark.createDataFrame([], SCHEMAS[name]).schema
        rows.select(*[F.col(f.name).cast(f.dataType) for f in types]).write.parquet(f"{self.path}/{part}")
        return {"path": part, "of": of}

    def _save(self, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None, drop: list[tuple[str, str]] = (), of: str = "") -> None:
        """Makes changes of several tables current together. Appended rows belong to the object ``of``; ``drop`` lists (table, object)."""
        if self.read_only:
            raise PermissionError("the store was opened for reading")
        new = {t: [p for p in parts if (t, p["of"]) not in drop] for t, parts in self._parts.items()}
        for name, rows in (replace or {}).items():
            new[name] = [self._write(name, rows, of)]
        for name, rows in (append or {}).items():
            new[name] = [*new.get(name, []), self._write(name, rows, of)]
        self._publish(new)

    def _publish(self, new: dict[str, list[dict[str, str]]]) -> None:
        version = self._version + 1
        fresh, final = (self._path(f"{self.path}/manifests/{version:012d}.{end}") for end in (f"{uuid.uuid4().hex}.new", "json"))
        out = self._fs.create(fresh, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(fresh, final):
            self._fs.delete(fresh, False)
            raise RuntimeError("another writer has changed the store; open it again")
        self._parts, self._version = new, version

    def compact(self, *tables: str) -> None:
        """Writes tables of many small parts, as streams make them, anew; parts of objects stay apart."""
        if self.read_only:
            raise PermissionError("the store was opened for reading")
        for name in tables or [t for t, parts in self._parts.items() if len(parts) > 1]:
            objects = {p["of"] for p in self._parts.get(name, [])}
            if len(objects) < len(self._parts.get(name, [])):
                written = [self._write(name, self.table(name, of), of) for of in sorted(objects)]
                self._publish(self._parts | {name: written})

    def vacuum(self) -> int:
        """Deletes parts and manifests that the current one doesn't name; how many parts. No other session may be reading them."""
        named = {p["path"] for parts in self._parts.values() for p in parts}
        gone = 0
        for table in SCHEMAS:
            folder = self._path(f"{self.path}/{table}")
            for status in self._fs.listStatus(folder) if self._fs.exists(folder) else ():
                if f"{table}/{status.getPath().getName()}" not in named:
                    self._fs.delete(status.getPath(), True)
                    gone += 1
        for version in self._versions():
            if version < self._version:
                self._fs.delete(self._path(f"{self.path}/manifests/{version:012d}.json"), False)
        return gone

    def _names(self, kind: str) -> list[str]:
        """Names of one kind in the catalog: its rows are objects a user made, not data."""
        return sorted(r["name"] for r in self.table("catalog").filter(F.col("kind") == kind).collect())

    def _params(self, kind: str, name: str) -> dict[str, str]:
        row = self.table("catalog").filter((F.col("kind") == kind) & (F.col("name") == name)).first()
        if row is None:
            raise KeyError(f"there is no {kind} named {name}")
        return row["params"]

    def _put(self, kind: str, name: str, params: dict | None = None, **tables: DataFrame) -> None:
        if name in self._names(kind) or (kind == "cell_set" and name == ALL_CELLS) or (kind == "gene_set" and name == ALL_GENES):
            raise ValueError(f"a {kind} named {name} exists")
        row = self.spark.createDataFrame([(kind, name, {k: str(v) for k, v in (params or {}).items()})], SCHEMAS["catalog"])
        self._save(append={"catalog": row, **tables}, of=f"{kind}/{name}")

    def _drop(self, kind: str, name: str) -> None:
        self._params(kind, name)
        self._save(drop=[(t, f"{kind}/{name}") for t in SCHEMAS])

    # --- genes, cells, counts ---

    def gene_count(self) -> int:
        return self.table("genes").count()

    def cell_count(self) -> int:
        return self.table("cells").count()

    def gene_name(self, gene_id: int) -> str | None:
        row = self.table("genes").filter(F.col("gene_id") == gene_id).first()
        return row and row["gene_name"]

    def gene_id_from_name(self, name: str) -> int | None:
        row = self.table("genes").filter(F.col("gene_name") == name).first()
        return row and row["gene_id"]

    def _id_from_string(self, table: str, key: str, name: str, text: str) -> int | None:
        rows = self.table(table)
        if text.isdigit() and int(text) < 2**31 and not rows.filter(F.col(key) == int(text)).isEmpty():
            return int(text)
        row = rows.filter(F.col(name) == text).first()
        return row and row[key]

    def cell_id_from_string(self, text: str) -> int | None:
        return self._id_from_string("cells", "cell_id", "cell_name", text)

    def gene_id_from_string(self, text: str) -> int | None:
        return self._id_from_string("genes", "gene_id", "gene_name", text)

    def _new_ids(self, table: str, key: str, name: str, wanted: DataFrame, scratch: Scratch) -> DataFrame:
        """The new entries of a dictionary: names (``name, ord``) that it lacks get ids in order after the last."""
        old = self.table(table)
        new = wanted.join(old, name, "left_anti").groupBy(name).agg(F.min("ord").alias("ord"))
        start = old.agg(F.max(key)).first()[0]
        numbered = graphs.with_places(new, [F.asc("ord"), F.asc(name)], "_place", scratch)
        return numbered.select((F.col("_place") + (0 if start is None else start + 1)).cast("int").alias(key), name)

    def _add(self, genes: DataFrame, cells: DataFrame, counts: DataFrame, meta_rows: DataFrame) -> None:
        """Adds a batch after checking all of it. ``genes``: gene_name, ord; ``cells``: cell_name, ord;
        ``counts``: cell_name, gene_name, count; ``meta_rows``: cell_name, name, value, ord."""
        scratch = Scratch(self.spark, "batch")
        genes, cells, counts, meta_rows = (scratch.keep(x) for x in (genes, cells, counts, meta_rows))
        problems = [
            ("cell names repeat", cells.groupBy("cell_name").count().filter("count > 1")),
            ("cell names exist", cells.join(self.table("cells"), "cell_name", "left_semi")),
            ("a cell has no name", cells.filter("cell_name IS NULL OR cell_name = ''")),
            ("counts are negative or no numbers", counts.filter("count IS NULL OR count < 0 OR isnan(count)")),
            ("a gene repeats within a cell", counts.groupBy("cell_name", "gene_name").count().filter("count > 1")),
            ("meta data names repeat within a cell", meta_rows.groupBy("cell_name", "name").count().filter("count > 1")),
        ]
        for text, bad in problems:
            row = bad.first()
            if row is not None:
                raise ValueError(f"{text}: {row.asDict()}")
        new_genes = scratch.keep(self._new_ids("genes", "gene_id", "gene_name", genes, scratch))
        new_cells = scratch.keep(self._new_ids("cells", "cell_id", "cell_name", cells, scratch))
        all_genes = self.table("genes").unionByName(new_genes)
        own = counts.filter("count > 0").join(all_genes, "gene_name").join(new_cells, "cell_name")
        named = meta_rows.filter("name != 'CellName'").unionByName(cells.select("cell_name", F.lit("CellName").alias("name"), F.col("cell_name").alias("value"), F.lit(-1).alias("ord")))
        self._save(
            append={
                "genes": new_genes,
                "cells": new_cells,
                "counts": own.select("cell_id", "gene_id", "count"),
                "cell_meta": named.join(new_cells, "cell_name").select("cell_id", "name", "value", "ord"),
                "gene_meta": new_genes.select("gene_id", F.lit("GeneName").alias("name"), F.col("gene_name").alias("value"), F.lit(-1).alias("ord")),
            }
        )
        scratch.clear()

    def add_gene(self, name: str) -> bool:
        """Whether the gene is new."""
        if self.gene_id_from_name(name) is not None:
            return False
        last = self.table("genes").agg(F.max("gene_id")).first()[0]
        gene_id = 0 if last is None else last + 1
        make = self.spark.createDataFrame
        self._save(append={"genes": make([(gene_id, name)], SCHEMAS["genes"]), "gene_meta": make([(gene_id, "GeneName", name, -1)], SCHEMAS["gene_meta"])})
        return True

    def add_cell(self, meta_data: list[tuple[str, str]] | dict[str, str], expression_counts: list[tuple[str, float]] | dict[str, float]) -> int:
        """Adds one cell and gives its id. Many cells are better added at once, by ``add_cell_batch``."""
        self.add_cell_batch([(meta_data, expression_counts)])
        name = dict(meta_data)["CellName"]
        return self.cell_id_from_string(name) if not name.isdigit() else self.table("cells").filter(F.col("cell_name") == name).first()["cell_id"]

    def add_cell_batch(self, batch: list[tuple]) -> None:
        cells, counts, rows, genes = [], [], [], {}
        for at, (meta_data, expression) in enumerate(batch):
            pairs = list(meta_data.items()) if isinstance(meta_data, dict) else list(meta_data)
            values = list(expression.items()) if isinstance(expression, dict) else list(expression)
            if "CellName" not in dict(pairs):
                raise ValueError("CellName is missing")
            name = dict(pairs)["CellName"]
            cells.append((name, at))
            rows += [(name, n, v, i) for i, (n, v) in enumerate(pairs)]
            counts += [(name, g, float(c)) for g, c in values]
            for g, _ in values:
                genes.setdefault(g, len(genes))
        make = self.spark.createDataFrame
        self._add(make(list(genes.items()), "gene_name string, ord int"), make(cells, "cell_name string, ord int"), make(counts, "cell_name string, gene_name string, count double"), make(rows, "cell_name string, name string, value string, ord int"))

    def add_cells_from_json(self, texts: DataFrame, column: str = "value") -> None:
        """One JSON object per row: ``metaData`` (texts, with CellName) and ``expressionCounts`` (numbers)."""
        parsed = texts.select(F.from_json(column, "metaData MAP<STRING,STRING>, expressionCounts MAP<STRING,DOUBLE>").alias("j"), F.monotonically_increasing_id().alias("ord")).select("j.*", "ord")
        parsed = parsed.withColumn("cell_name", F.try_element_at("metaData", F.lit("CellName")))
        counts = parsed.select("cell_name", "ord", F.explode("expressionCounts").alias("gene_name", "count"))
        rows = parsed.select("cell_name", F.posexplode(F.map_entries("metaData")).alias("ord", "m")).select("cell_name", F.col("m.key").alias("name"), F.col("m.value").alias("value"), "ord")
        self._add(counts.groupBy("gene_name").agg(F.min("ord").alias("ord")), parsed.select("cell_name", "ord"), counts.drop("ord"), rows)

    def add_cell_from_json(self, text: str) -> None:
        self.add_cells_from_json(self.spark.createDataFrame([(text,)], "value string"))

    def _counts_file(self, path: str, separators: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Of a genes-by-cells file: counts other than zero with places, cells in column order, genes in line order."""
        lines, names = delimited.open_table(self.spark, path, separators)
        rows = delimited.long_rows(lines, separators, len(names), without=("0", "0.0"))
        columns = self.spark.createDataFrame(list(enumerate(names)), "position int, cell_name string")
        number = F.when(full_match(F.trim("text"), DECIMAL_PATTERN), F.col("text").try_cast("double"))
        counts = rows.join(columns, "position").select("cell_name", F.col("name").alias("gene_name"), number.alias("count"), "line_no")
        genes = delimited.row_names(lines, separators).select(F.col("name").alias("gene_name"), F.col("line_no").alias("ord"))
        twice = genes.groupBy("gene_name").count().filter("count > 1").first()
        if twice is not None:
            raise ValueError(f"gene {twice['gene_name']} repeats")
        return counts, columns.select("cell_name", F.col("position").alias("ord")), genes

    def add_cells(self, counts_file: str, counts_separators: str, meta_file: str, meta_separators: str, additional: list[tuple[str, str]] = ()) -> None:
        """Cells in both files; ids follow the columns of the counts file. All genes are registered."""
        counts, cells, genes = self._counts_file(counts_file, counts_separators)
        rows, fields = delimited.read_long(self.spark, meta_file, meta_separators)
        names = self.spark.createDataFrame(list(enumerate(fields)), "position int, field string")
        listed = rows.filter("position = 0").select(F.col("name").alias("cell_name"))
        twice = listed.groupBy("cell_name").count().filter("count > 1").first()
        if twice is not None:
            raise ValueError(f"cell {twice['cell_name']} repeats")
        cells = cells.join(listed, "cell_name", "left_semi")
        kept = rows.join(names, "position").filter("field != ''").select(F.col("name").alias("cell_name"), F.col("field").alias("name"), F.col("text").alias("value"), (F.col("position") + len(additional)).alias("ord"))
        kept = kept.join(cells, "cell_name", "left_semi")
        self._add(genes, cells, counts.join(cells.select("cell_name"), "cell_name", "left_semi").drop("line_no"), self._with_constants(kept, cells, additional))

    def add_cells_from_texts(self, counts_text: str, counts_separators: str, meta_text: str, meta_separators: str, additional: list[tuple[str, str]] = ()) -> None:
        """``add_cells`` of two files given as texts, as a client uploads them."""
        paths = []
        scratch = Scratch(self.spark, "upload")
        for name, text in (("counts", counts_text), ("meta", meta_text)):
            paths.append(f"{scratch.root}/{name}.csv")
            out = self._path(paths[-1]).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(self._path(paths[-1]), True)
            out.write(bytearray(text.encode()))
            out.close()
        self.add_cells(paths[0], counts_separators, paths[1], meta_separators, additional)
        scratch.clear()

    def _with_constants(self, rows: DataFrame, cells: DataFrame, additional) -> DataFrame:
        for at, (name, value) in enumerate(additional):
            rows = rows.unionByName(cells.select("cell_name", F.lit(name).alias("name"), F.lit(value).alias("value"), F.lit(at).alias("ord")))
        return rows

    def add_cells_without_meta(self, counts_file: str, separators: str = ",", additional: list[tuple[str, str]] = ()) -> None:
        """A genes-by-cells file alone; genes without any count are not registered."""
        counts, cells, genes = self._counts_file(counts_file, separators)
        used = counts.filter("count > 0 OR count IS NULL OR count < 0")
        none = self.spark.createDataFrame([], "cell_name string, name string, value string, ord int")
        self._add(genes.join(used, "gene_name", "left_semi"), cells, used.drop("line_no"), self._with_constants(none, cells, additional))

    def add_cells_by_row(self, cells_file: str, n_first: int, n_last: int, plates_file: str | None = None, plate: str | None = None, separators: str = ",") -> None:
        """One cell per line: name, ``n_first`` fields, genes, ``n_last`` fields; the plate's fields come from a second file."""
        lines, names = delimited.open_table(self.spark, cells_file, separators)
        middle = range(n_first, len(names) - n_last)
        twice = [n for n, times in Counter(names[i] for i in middle).items() if times > 1]
        if twice:
            raise ValueError(f"a gene repeats within a cell: {twice[0]}")
        scratch = Scratch(self.spark, "by-row")
        rows = scratch.keep(delimited.long_rows(lines, separators, len(names), without=("0", "0.0"), within=middle))
        labels = self.spark.createDataFrame(list(enumerate(names)), "position int, label string")
        rows = rows.join(labels, "position")
        in_middle = (F.col("position") >= middle.start) & (F.col("position") < middle.stop)
        cells = delimited.row_names(lines, separators).select(F.col("name").alias("cell_name"), F.col("line_no").alias("ord"))
        counts = rows.filter(in_middle).select(F.col("name").alias("cell_name"), F.col("label").alias("gene_name"), F.when(full_match(F.trim("text"), DECIMAL_PATTERN), F.col("text").try_cast("double")).alias("count"))
        own = rows.filter(~in_middle).select(F.col("name").alias("cell_name"), F.col("label").alias("name"), F.col("text").alias("value"), F.col("position").alias("ord"))
        extra = []
        if plates_file is not None:
            key = plate if plate is not None else cells_file.rstrip("/").split("/")[-1].split(".")[0]
            plates, fields = delimited.read_long(self.spark, plates_file, separators)
            found = {r["position"]: r["text"] for r in plates.filter(F.col("name") == key).collect()}
            if not found:
                raise ValueError(f"plate {key} is not listed")
            extra = [("PlateName", key)] + [(f, found[i]) for i, f in enumerate(fields)]
        genes = self.spark.createDataFrame([(names[i], i) for i in middle], "gene_name string, ord int")
        self._add(genes, cells, counts, self._with_constants(own.withColumn("ord", F.col("ord") + len(extra)), cells, extra))
        scratch.clear()

    def add_cells_from_hdf5(self, path: str, prefix: str = "", additional: list[tuple[str, str]] = (), min_total: float = 0.0, opener=None) -> None:
        """Cells in the order of their barcodes, also those without counts if their total of 0 reaches ``min_total``."""
        self._add_matrices([(path, prefix, list(additional))], min_total, opener)

    def _add_matrices(self, files: list[tuple[str, str, list[tuple[str, str]]]], min_total: float, opener) -> None:
        scratch = Scratch(self.spark, "matrices")
        none = self.spark.createDataFrame([], "cell_name string, name string, value string, ord int")
        parts = []
        for number, (path, prefix, constants) in enumerate(files):
            counts, cells, genes = tenx.read_matrix(self.spark, path, prefix, min_total, scratch, opener)
            order = (F.lit(number << 40) + F.col("ord")).alias("ord")
            named = self.spark.createDataFrame([(g, (number << 40) + i) for i, g in enumerate(genes)], "gene_name string, ord bigint")
            parts.append((named, cells.select("cell_name", order), counts, self._with_constants(none, cells, constants)))
        genes, cells, counts, rows = (functools.reduce(DataFrame.unionByName, p) for p in zip(*parts))
        self._add(genes.groupBy("gene_name").agg(F.min("ord").alias("ord")), cells, counts, rows)
        scratch.clear()

    def add_cells_of_plates(self, plates_file: str, separators: str = ",", min_total: float = 0.0, path_field: str = "aws-s3-hdf5", opener=None) -> None:
        """One HDF5 file per listed plate, at any path the executors can open; all plates are added as one batch."""
        rows, fields = delimited.read_long(self.spark, plates_file, separators)
        if path_field not in fields:
            raise ValueError(f"{path_field} is missing")
        plates: dict[str, dict[int, str]] = {}
        for r in rows.orderBy("line_no", "position").collect():  # one row per plate and field
            plates.setdefault(r["name"], {})[r["position"]] = r["text"]
        files = []
        for name, values in plates.items():
            constants = [("PlateName", name)] + [(f, values[i]) for i, f in enumerate(fields) if f != path_field]
            files.append((values[fields.index(path_field)], name, constants))
        self._add_matrices(files, min_total, opener)

    # --- values ---

    def get_cell_expression_count(self, cell_id: int, gene: int | str) -> float:
        gene_id = self.gene_id_from_name(gene) if isinstance(gene, str) else gene
        if gene_id is None:
            raise KeyError(gene)
        row = self.table("counts").filter((F.col("cell_id") == cell_id) & (F.col("gene_id") == gene_id)).first()
        return float(row["count"]) if row else 0.0

    def get_cell_expression_counts(self, cell_id: int) -> DataFrame:
        return self.table("counts").filter(F.col("cell_id") == cell_id).select("gene_id", "count").orderBy("gene_id")

    def _wanted(self, cell_ids: list[int]) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(cell_ids)), "place int, cell_id int")

    def get_cells_expression_count(self, cell_ids: list[int], gene: int | str) -> DataFrame:
        """``place, cell_id, count`` in the order of the list, zeros included."""
        gene_id = self.gene_id_from_name(gene) if isinstance(gene, str) else gene
        if gene_id is None:
            raise KeyError(gene)
        own = self.table("counts").filter(F.col("gene_id") == gene_id).select("cell_id", "count")
        return self._wanted(cell_ids).join(own, "cell_id", "left").select("place", "cell_id", F.coalesce("count", F.lit(0.0)).alias("count")).orderBy("place")

    def get_cells_expression_counts(self, cell_ids: list[int], gene_ids: list[int] | None = None) -> DataFrame:
        """``place, cell_id, counts`` (sorted gene and count pairs), restricted to the genes if given."""
        counts = self.table("counts")
        if gene_ids is not None:
            counts = counts.join(self.spark.createDataFrame([(g,) for g in gene_ids], "gene_id int"), "gene_id", "left_semi")
        packed = counts.join(self._wanted(cell_ids).select("cell_id").distinct(), "cell_id", "left_semi").groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("gene_id", "count"))).alias("counts"))
        return self._wanted(cell_ids).join(packed, "cell_id", "left").orderBy("place").select("place", "cell_id", F.coalesce("counts", F.array().cast("array<struct<gene_id:int,count:float>>")).alias("counts"))

    def get_dense_expression_matrix(self, gene_set: str = ALL_GENES, cell_set: str = ALL_CELLS, normalization: str = "none") -> DataFrame:
        return matrix.dense_rows(self.table("counts"), self.gene_set(gene_set), self.cell_set(cell_set), self._method(normalization))

    @staticmethod
    def _method(name: str) -> str:
        if name not in NORMALISATIONS:
            raise ValueError(f"normalization is one of {NORMALISATIONS}")
        return name

    # --- meta data ---

    def get_cell_meta_data_value(self, cell_id: int, name: str) -> str:
        row = self.table("cell_meta").filter((F.col("cell_id") == cell_id) & (F.col("name") == name)).first()
        return row["value"] if row else ""

    def get_cell_meta_data(self, cell_ids: int | list[int]) -> DataFrame:
        ids = [cell_ids] if isinstance(cell_ids, int) else cell_ids
        return self._wanted(ids).join(self.table("cell_meta"), "cell_id").orderBy("place", "ord").select("place", "cell_id", "name", "value")

    def get_gene_meta_data(self, gene_id: int, name: str) -> str:
        row = self.table("gene_meta").filter((F.col("gene_id") == gene_id) & (F.col("name") == name)).first()
        return row["value"] if row else ""

    def set_cell_meta_data(self, updates: DataFrame) -> None:
        """``cell_id, name, value``; an existing value is replaced."""
        self._save(replace={"cell_meta": meta.upsert(self.table("cell_meta"), updates)})

    def set_gene_meta_data(self, gene_id: int, name: str, value: str) -> None:
        row = self.spark.createDataFrame([(gene_id, name, value)], "gene_id int, name string, value string")
        self._save(replace={"gene_meta": meta.upsert(self.table("gene_meta"), row, "gene_id")})

    def add_cell_meta_data(self, path: str, separators: str = ",") -> None:
        rows, fields = delimited.read_long(self.spark, path, separators)
        names = self.spark.createDataFrame(list(enumerate(fields)), "position int, field string")
        cells = self.table("cells")
        unknown = rows.select(F.col("name").alias("cell_name")).join(cells, "cell_name", "left_anti").first()
        if unknown is not None:
            raise ValueError(f"cell {unknown['cell_name']} is unknown")
        updates = rows.join(names, "position").filter("field != ''").select(F.col("name").alias("cell_name"), F.col("field").alias("name"), F.col("text").alias("value")).join(cells, "cell_name")
        self.set_cell_meta_data(updates.select("cell_id", "name", "value"))

    def remove_cell_meta_data(self, cell_set: str, name: str) -> None:
        self._save(replace={"cell_meta": meta.remove_field(self.table("cell_meta"), self.cell_set(cell_set, True), name)})

    def meta_data_histogram(self, name: str, cell_set: str = ALL_CELLS) -> DataFrame:
        return meta.histogram(self.table("cell_meta"), self.cell_set(cell_set), name)

    def meta_data_contingency_table(self, name0: str, name1: str, cell_set: str = ALL_CELLS) -> DataFrame:
        return meta.contingency(self.table("cell_meta"), self.cell_set(cell_set), name0, name1)

    def compute_meta_data_rand_index(self, cell_set: str, name0: str, name1: str) -> tuple[float, float]:
        row = meta.rand_index(self.table("cell_meta"), self.cell_set(cell_set, True), name0, name1).first()
        return row["rand_index"], row["adjusted_rand_index"]

    # --- sets ---

    def cell_set(self, name: str, strict: bool = False) -> DataFrame:
        if name == ALL_CELLS:
            return self.table("cells").select("cell_id")
        if strict and name not in self._names("cell_set"):
            raise KeyError(f"there is no cell set {name}")
        return self.table("cell_sets", f"cell_set/{name}").select("cell_id")

    def gene_set(self, name: str) -> DataFrame:
        if name == ALL_GENES:
            return self.table("genes").select("gene_id")
        self._params("gene_set", name)
        return self.table("gene_sets", f"gene_set/{name}").select("gene_id")

    def get_cell_set_names(self) -> list[str]:
        return sorted([ALL_CELLS, *self._names("cell_set")])

    def get_gene_set_names(self) -> list[str]:
        return sorted([ALL_GENES, *self._names("gene_set")])

    def cell_set_sizes(self) -> DataFrame:
        """``set_name, n`` of every cell set."""
        return self._set_sizes("cell_sets", "cell_set", ALL_CELLS, "cells")

    def gene_set_sizes(self) -> DataFrame:
        """``set_name, n`` of every gene set."""
        return self._set_sizes("gene_sets", "gene_set", ALL_GENES, "genes")

    def _set_sizes(self, table: str, kind: str, every: str, entities: str) -> DataFrame:
        sizes = self.table(table).groupBy("set_name").agg(F.count(F.lit(1)).alias("n"))
        named = self.table("catalog").filter(F.col("kind") == kind).select(F.col("name").alias("set_name"))
        listed = named.join(sizes, "set_name", "left").select("set_name", F.coalesce("n", F.lit(0)).alias("n"))
        return self.table(entities).agg(F.lit(every).alias("set_name"), F.count(F.lit(1)).alias("n")).unionByName(listed)

    def listing(self) -> DataFrame:
        """``kind, name`` of everything that was made from the matrix."""
        return self.table("catalog").select("kind", "name").orderBy("kind", "name")

    def _put_set(self, kind: str, name: str, members: DataFrame) -> None:
        key, table = ("cell_id", "cell_sets") if kind == "cell_set" else ("gene_id", "gene_sets")
        self._put(kind, name, {"hash": sets.content_hash(members, key)}, **{table: members.select(F.lit(name).alias("set_name"), key)})

    def create_cell_set(self, name: str, cell_ids: list[int]) -> None:
        wanted = self.spark.createDataFrame([(c,) for c in cell_ids], "cell_id int").distinct()
        if not wanted.join(self.table("cells"), "cell_id", "left_anti").isEmpty():
            raise ValueError("a cell id is unknown")
        self._put_set("cell_set", name, wanted)

    def create_cell_set_using_meta_data(self, name: str, field: str, match: str, use_regex: bool = False) -> None:
        pick = sets.cells_by_regex if use_regex else sets.cells_by_value
        self._put_set("cell_set", name, pick(self.table("cell_meta"), field, match))

    def create_cell_set_using_numeric_meta_data(self, name: str, field: str, lower: float | None = None, upper: float | None = None) -> None:
        self._put_set("cell_set", name, sets.cells_by_number(self.table("cell_meta"), field, lower, upper))

    def create_cell_set_using_numeric_meta_data_greater_than(self, name: str, field: str, lower: float) -> None:
        """The bound is included."""
        self.create_cell_set_using_numeric_meta_data(name, field, lower, None)

    def create_cell_set_using_numeric_meta_data_less_than(self, name: str, field: str, upper: float) -> None:
        """The bound is included."""
        self.create_cell_set_using_numeric_meta_data(name, field, None, upper)

    def create_cell_set_using_numeric_meta_data_between(self, name: str, field: str, lower: float, upper: float) -> None:
        self.create_cell_set_using_numeric_meta_data(name, field, lower, upper)

    def create_cell_set_union(self, name: str, inputs: list[str]) -> None:
        self._put_set("cell_set", name, sets.union([self.cell_set(i, True) for i in inputs]))

    def create_cell_set_intersection(self, name: str, inputs: list[str]) -> None:
        self._put_set("cell_set", name, sets.intersection([self.cell_set(i, True) for i in inputs]))

    def create_cell_set_difference(self, name: str, first: str, second: str) -> None:
        self._put_set("cell_set", name, sets.difference(self.cell_set(first, True), self.cell_set(second, True)))

    def downsample_cell_set(self, cell_set: str, name: str, probability: float, seed: int = 231) -> None:
        self._put_set("cell_set", name, sets.downsample(self.cell_set(cell_set, True), probability, seed))

    def remove_cell_set(self, name: str) -> None:
        if name == ALL_CELLS:
            raise ValueError("AllCells can't be removed")
        self._drop("cell_set", name)

    def create_gene_set_from_regex(self, name: str, pattern: str) -> None:
        self._put_set("gene_set", name, sets.genes_by_regex(self.table("genes"), pattern))

    def create_gene_set_from_gene_names(self, name: str, names: list[str] | str, strict: bool = True) -> None:
        words = names.replace(",", " ").split() if isinstance(names, str) else names
        self._put_set("gene_set", name, sets.genes_by_name(self.table("genes"), words, strict))

    def create_gene_set(self, name: str, gene_ids: list[int]) -> None:
        self._put_set("gene_set", name, self.spark.createDataFrame([(g,) for g in gene_ids], "gene_id int").distinct())

    def create_gene_set_union(self, name: str, inputs: list[str]) -> None:
        self._put_set("gene_set", name, sets.union([self.gene_set(i) for i in inputs]))

    def create_gene_set_intersection(self, name: str, inputs: list[str]) -> None:
        self._put_set("gene_set", name, sets.intersection([self.gene_set(i) for i in inputs]))

    def create_gene_set_difference(self, name: str, first: str, second: str) -> None:
        self._put_set("gene_set", name, sets.difference(self.gene_set(first), self.gene_set(second)))

    def create_well_expressed_gene_set(self, name: str, gene_set: str = ALL_GENES, cell_set: str = ALL_CELLS, min_cell_count: int = 1) -> None:
        self._put_set("gene_set", name, sets.well_expressed_genes(self.table("counts"), self.gene_set(gene_set), self.cell_set(cell_set, True), min_cell_count))

    def create_gene_set_using_information_content(self, name: str, gene_set: str = ALL_GENES, cell_set: str = ALL_CELLS, normalization: str = "L2", threshold: float = 2.0) -> None:
        self._put_set("gene_set", name, sets.high_information_genes(self.table("counts"), self.gene_set(gene_set), self.cell_set(cell_set, True), threshold, self._method(normalization)))

    def remove_gene_set(self, name: str) -> None:
        if name == ALL_GENES:
            raise ValueError("AllGenes can't be removed")
        self._drop("gene_set", name)

    def gene_information_content(self, gene_set: str = ALL_GENES, cell_set: str = ALL_CELLS, normalization: str = "none") -> DataFrame:
        return matrix.information_content(self.table("counts"), self.gene_set(gene_set), self.cell_set(cell_set), self._method(normalization))

    # --- similar pairs ---

    def _subset(self, gene_set: str, cell_set: str) -> tuple[DataFrame, int]:
        genes = self.gene_set(gene_set)
        n = genes.count()
        cells = self.cell_set(cell_set, True)
        if not n or cells.isEmpty():
            raise ValueError("the gene set or the cell set is empty")
        return matrix.restrict(self.table("counts"), genes, cells), n

    def _put_pairs(self, name: str, pairs: DataFrame, gene_set: str, cell_set: str, method: str, table: str = "similar_pairs", **params) -> None:
        params |= {"gene_set": gene_set, "cell_set": cell_set, "method": method, "gene_hash": sets.content_hash(self.gene_set(gene_set), "gene_id"), "cell_hash": sets.content_hash(self.cell_set(cell_set), "cell_id")}
        self._put(table, name, params, **{table: pairs.select(F.lit(name).alias("name"), "id0", "id1", "similarity", "rank")})

    def similar_pairs(self, name: str, table: str = "similar_pairs") -> DataFrame:
        """The stored pairs; an error if their sets have changed since."""
        params = self._params(table, name)
        if params["gene_hash"] != sets.content_hash(self.gene_set(params["gene_set"]), "gene_id") or params["cell_hash"] != sets.content_hash(self.cell_set(params["cell_set"]), "cell_id"):
            raise ValueError(f"the sets of {name} have changed since it was made")
        return self.table(table, f"{table}/{name}").select("id0", "id1", "similarity", "rank")

    def compute_cell_similarity(self, cell0: int, cell1: int, gene_set: str = ALL_GENES) -> float | None:
        genes = self.gene_set(gene_set)
        pair = self.spark.createDataFrame([(cell0, cell1)], "id0 int, id1 int")
        return similarity.pair_similarity(matrix.restrict(self.table("counts"), genes), pair, genes.count()).first()["exact"]

    def find_similar_pairs0(self, name: str, gene_set: str = ALL_GENES, cell_set: str = ALL_CELLS, k: int = 100, threshold: float = 0.2) -> None:
        counts, n = self._subset(gene_set, cell_set)
        self._put_pairs(name, similarity.exact_pairs(counts, n, k, threshold), gene_set, cell_set, "exact", k=k, threshold=threshold)

    def compute_lsh_signatures(self, name: str, gene_set: str = ALL_GENES, cell_set: str = ALL_CELLS, lsh_count: int = 1024, seed: int = lsh.SEED) -> None:
        sigs = self._signatures(gene_set, cell_set, lsh_count, seed)
        self._put("signatures", name, {"gene_set": gene_set, "cell_set": cell_set, "lsh_count": lsh_count, "seed": seed}, signatures=sigs.select(F.lit(name).alias("name"), "id", "sig"))

    def _signatures(self, gene_set: str, cell_set: str, bits: int, seed: int) -> DataFrame:
        counts, _ = self._subset(gene_set, cell_set)
        # planes belong to gene ids, so the sum over all planes runs over the ids up to the last
        last = self.table("genes").agg(F.max("gene_id")).first()[0] + 1
        return Scratch(self.spark, "sig").keep(lsh.signatures(counts, last, bits, seed))

    def find_similar_pairs4(self, name: str, gene_set: str = ALL_GENES, cell_set: str = ALL_CELLS, k: int = 100, threshold: float = 0.2, lsh_count: int = 1024, seed: int = lsh.SEED) -> None:
        sigs = self._signatures(gene_set, cell_set, lsh_count, seed)
        self._put_pairs(name, lsh.lsh_pairs_all(sigs, lsh_count, k, threshold), gene_set, cell_set, "lsh_all", k=k, threshold=threshold, lsh_count=lsh_count, seed=seed)

    def find_similar_pairs5(self, name: str, slice_length: int, gene_set: str = ALL_GENES, cell_set: str = ALL_CELLS, k: int = 100, threshold: float = 0.2, lsh_count: int = 1024, bucket_overflow: int = 1000, seed: int = lsh.SEED) -> None:
        sigs = self._signatures(gene_set, cell_set, lsh_count, seed)
        self._put_pairs(name, lsh.lsh_pairs_sliced(sigs, lsh_count, slice_length, bucket_overflow, k, threshold), gene_set, cell_set, "lsh_sliced", k=k, threshold=threshold, lsh_count=lsh_count, seed=seed)

    def find_similar_pairs6(self, name: str, gene_set: str = ALL_GENES, cell_set: str = ALL_CELLS, k: int = 100, threshold: float = 0.2, lsh_count: int = 1024, permutation_count: int = 64, search_count: int = 16, permuted_bit_count: int = 63, seed: int = lsh.SEED) -> None:
        sigs = self._signatures(gene_set, cell_set, lsh_count, seed)
        self._put_pairs(name, lsh.lsh_pairs_permuted(sigs, lsh_count, permutation_count, search_count, k, threshold, seed, permuted_bit_count), gene_set, cell_set, "lsh_permuted", k=k, threshold=threshold, lsh_count=lsh_count, seed=seed)

    def find_similar_pairs7(self, name: str, slice_lengths: list[int], gene_set: str = ALL_GENES, cell_set: str = ALL_CELLS, k: int = 100, threshold: float = 0.2, lsh_count: int = 1024, max_check: int = 100, log2_bucket_count: int = 0, seed: int = lsh.SEED) -> None:
        """With ``log2_bucket_count`` above 0 slices at least that long are hashed to so many buckets."""
        sigs = self._signatures(gene_set, cell_set, lsh_count, seed)
        self._put_pairs(name, lsh.lsh_pairs_multi_slice(sigs, lsh_count, slice_lengths, max_check, k, threshold, log2_buckets=log2_bucket_count), gene_set, cell_set, "lsh_multi_slice", k=k, threshold=threshold, lsh_count=lsh_count, seed=seed)

    def find_similar_gene_pairs0(self, name: str, gene_set: str = ALL_GENES, cell_set: str = ALL_CELLS, normalization: str = "L2", k: int = 100, threshold: float = 0.2) -> None:
        counts, _ = self._subset(gene_set, cell_set)
        values = matrix.normalised(counts, self._method(normalization))
        pairs = similarity.exact_pairs(values, self.cell_set(cell_set).count(), k, threshold, "gene_id", "cell_id", "value")
        self._put_pairs(name, pairs, gene_set, cell_set, "exact", "similar_gene_pairs", normalization=normalization, k=k, threshold=threshold)

    def get_similar_pairs_names(self) -> list[str]:
        return self._names("similar_pairs")

    def get_similar_gene_pairs_names(self) -> list[str]:
        return self._names("similar_gene_pairs")

    def get_lsh_names(self) -> list[str]:
        return self._names("signatures")

    def gene_sets_of_similar_pairs(self, name: str) -> list[str]:
        """All gene sets with the members that the pairs were made from, by content hash."""
        wanted = self._params("similar_pairs", name)["gene_hash"]
        known = {r["name"]: r["params"].get("hash") for r in self.table("catalog").filter("kind = 'gene_set'").collect()}
        known[ALL_GENES] = sets.content_hash(self.gene_set(ALL_GENES), "gene_id")
        return sorted(n for n, h in known.items() if h == wanted)

    def write_similar_pairs(self, name: str, path: str) -> None:
        """CSV with both names, the stored similarity and the exact one over all genes."""
        n = self.gene_count()
        pairs = similarity.pair_similarity(self.table("counts"), self.similar_pairs(name).select("id0", "id1", "similarity"), n)
        sinks.write_csv(sinks.similar_pairs_table(pairs, self.table("cells")), path)

    def write_similar_gene_pairs(self, name: str, path: str) -> None:
        """CSV of the stored gene pairs with both names, each pair in both orientations."""
        pairs = self.similar_pairs(name, "similar_gene_pairs")
        either = pairs.select("id0", "id1", "similarity").unionByName(pairs.select(F.col("id1").alias("id0"), F.col("id0").alias("id1"), "similarity"))
        side = lambda k: self.table("genes").select(F.col("gene_id").alias(f"id{k}"), F.col("gene_name").alias(f"Gene{k}"))
        named = either.groupBy("id0", "id1").agg(F.max("similarity").alias("Similarity")).join(side(0), "id0").join(side(1), "id1")
        sinks.write_csv(named.select("Gene0", "Gene1", "Similarity"), path)

    def analyze_lsh(self, name: str) -> DataFrame:
        """Errors of all pairs by stored signatures, beside those that theory expects."""
        params = self._params("signatures", name)
        bits = int(params["lsh_count"])
        sigs = self.table("signatures", f"signatures/{name}").select("id", "sig")
        genes = self.gene_set(params["gene_set"])
        return lsh.error_bins_of_all(matrix.restrict(self.table("counts"), genes), sigs, genes.count(), bits)

    def remove_similar_pairs(self, name: str) -> None:
        self._drop("similar_pairs", name)

    def remove_similar_gene_pairs(self, name: str) -> None:
        self._drop("similar_gene_pairs", name)

    def _with_exact(self, name: str) -> DataFrame:
        pairs, params = self.similar_pairs(name), self._params("similar_pairs", name)
        genes = self.gene_set(params["gene_set"])
        return similarity.pair_similarity(matrix.restrict(self.table("counts"), genes), pairs.select("id0", "id1", "similarity"), genes.count())

    def analyze_similar_pairs(self, name: str) -> DataFrame:
        return lsh.error_bins(self._with_exact(name))

    def sample_similar_pairs(self, name: str, share: float, seed: int = 231) -> DataFrame:
        """Stored beside exact similarity of a share of the pairs, chosen by MD5, for a scatter plot."""
        digits = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id0").cast("string"), F.col("id1").cast("string")))
        kept = self._with_exact(name)
        return kept if share >= 1 else kept.filter(digits < f"{int(max(share, 0.0) * 16**16):016x}")

    def analyze_lsh_signatures(self, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        bits = int(self._params("signatures", name)["lsh_count"])
        sigs = self.table("signatures", f"signatures/{name}").select("id", "sig")
        return lsh.signature_counts(sigs), lsh.signature_size_histogram(sigs), lsh.bit_counts(sigs, bits)

    def compare_similar_pairs(self, name0: str, name1: str) -> DataFrame:
        return lsh.compare_pair_sets(self.similar_pairs(name0), self.similar_pairs(name1))

    # --- graphs ---

    def _put_graph(self, kind: str, name: str, vertices: DataFrame, edges: DataFrame, params: dict, **tables: DataFrame) -> None:
        tag = F.lit(f"{kind}/{name}").alias("name")
        cluster = F.col("cluster_id") if "cluster_id" in vertices.columns else F.lit(None)
        own = {"vertices": vertices.select(tag, "id", cluster.cast("bigint").alias("cluster_id")), "edges": edges.select(tag, "src", "dst", "similarity")}
        self._put(kind, name, params, **own, **tables)

    def graph(self, kind: str, name: str) -> tuple[DataFrame, DataFrame]:
        self._params(kind, name)
        own = f"{kind}/{name}"
        return self.table("vertices", own).select("id", "cluster_id"), self.table("edges", own).select("src", "dst", "similarity")

    def create_cell_graph(self, name: str, similar_pairs: str, cell_set: str = ALL_CELLS, threshold: float = 0.5, k: int = 20, keep_isolated: bool = False) -> None:
        members = self.cell_set(cell_set, True).select(F.col("cell_id").cast("bigint").alias("id"))
        vertices, edges = graphs.knn_graph(self.similar_pairs(similar_pairs), members, threshold, k, keep_isolated)
        self._put_graph("cell_graph", name, vertices, edges, {"cell_set": cell_set, "similar_pairs": similar_pairs, "threshold": threshold, "k": k})

    def create_gene_graph(self, name: str, similar_gene_pairs: str, gene_set: str = ALL_GENES, threshold: float = 0.5, k: int = 20) -> None:
        members = self.gene_set(gene_set).select(F.col("gene_id").cast("bigint").alias("id"))
        vertices, edges = graphs.knn_graph(self.similar_pairs(similar_gene_pairs, "similar_gene_pairs"), members, threshold, k)
        self._put_graph("gene_graph", name, vertices, edges, {"gene_set": gene_set, "threshold": threshold, "k": k})

    def get_gene_graph_connectivity(self, name: str) -> DataFrame:
        return graphs.connectivity(self.graph("gene_graph", name)[1])

    def create_signature_graph(self, name: str, signatures: str, min_cell_count: int = 100) -> None:
        bits = int(self._params("signatures", signatures)["lsh_count"])
        sigs = self.table("signatures", f"signatures/{signatures}").select("id", "sig")
        vertices, edges = graphs.signature_graph(sigs, bits, min_cell_count)
        self._put_graph("signature_graph", name, vertices, edges.withColumn("similarity", F.lit(None).cast("double")), {"signatures": signatures})

    def create_cluster_graph(self, cell_graph: str, name: str, gene_set: str = ALL_GENES, **options) -> None:
        """Options as in ``graphs.cluster_graph``; cells of dissolved clusters keep a null cluster."""
        vertices, edges = self.graph("cell_graph", cell_graph)
        genes = self.gene_set(gene_set)
        made = graphs.cluster_graph(vertices.select("id"), edges, matrix.restrict(self.table("counts"), genes), genes.count(), **options)
        members = made["members"].unionByName(made["unclustered"].withColumn("cluster_id", F.lit(None).cast("bigint")))
        tag = F.lit(f"cluster_graph/{name}").alias("name")
        self._put_graph("cluster_graph", name, members, made["edges"].select(F.col("c0").alias("src"), F.col("c1").alias("dst"), "similarity"), {"cell_graph": cell_graph, "gene_set": gene_set}, profiles=made["profiles"].select(tag, "cluster_id", "gene_id", "average"))

    def get_cell_graph_names(self) -> list[str]:
        return self._names("cell_graph")

    def get_cluster_graph_names(self) -> list[str]:
        return self._names("cluster_graph")

    def get_gene_graph_names(self) -> list[str]:
        return self._names("gene_graph")

    def get_signature_graph_names(self) -> list[str]:
        return self._names("signature_graph")

    def compute_cell_graph_layout(self, name: str) -> None:
        """Positions of the vertices of a small graph, for display; they replace those made before."""
        vertices, edges = self.graph("cell_graph", name)
        ids = [r[0] for r in vertices.select("id").orderBy("id").collect()]
        placed = sinks.spring_layout(ids, [tuple(r) for r in edges.select("src", "dst").orderBy("src", "dst").collect()])
        rows = self.spark.createDataFrame([(f"cell_graph/{name}", v, x, y) for v, (x, y) in placed.items()], SCHEMAS["positions"])
        self._save(drop=[("positions", f"cell_graph/{name}")], append={"positions": rows}, of=f"cell_graph/{name}")

    def get_cell_graph_vertices(self, name: str) -> DataFrame:
        """``id, x, y``; an error before the layout was computed."""
        self._params("cell_graph", name)
        own = self.table("positions", f"cell_graph/{name}")
        if own.isEmpty():
            raise ValueError(f"the layout of {name} wasn't computed")
        return own.select("id", "x", "y")

    def get_cell_graph_edges(self, name: str) -> DataFrame:
        return self.graph("cell_graph", name)[1]

    def store_cluster_id(self, cell_graph: str, field: str, **options) -> None:
        """The labels that spread over a cell graph as a field of its cells."""
        vertices, edges = self.graph("cell_graph", cell_graph)
        labels = graphs.label_propagation(vertices.select("id"), edges, **options)
        self.set_cell_meta_data(labels.select(F.col("id").cast("int").alias("cell_id"), F.lit(field).alias("name"), F.col("cluster_id").cast("string").alias("value")))

    def compare_cell_graphs(self, name0: str, name1: str) -> tuple[DataFrame, DataFrame]:
        """Counts of common vertices and edges, and the changes of similarity."""
        (v0, e0), (v1, e1) = self.graph("cell_graph", name0), self.graph("cell_graph", name1)
        return graphs.compare_graphs(v0, e0, v1, e1), graphs.similarity_changes(e0, e1)

    def colored_cell_graph(self, name: str, field: str, numeric: bool = False, as_color: bool = False) -> DataFrame:
        """The vertices with a colour by category, on a scale if ``numeric``, or that which the field names if ``as_color``."""
        vertices = self.graph("cell_graph", name)[0].select("id")
        values = self.table("cell_meta").filter(F.col("name") == field).select(F.col("cell_id").cast("bigint").alias("id"), "value")
        if numeric:
            return graphs.scale_colors(vertices, values.select("id", F.col("value").try_cast("double").alias("value")).filter("value IS NOT NULL"))
        return graphs.given_colors(vertices, values) if as_color else graphs.category_colors(vertices, values)

    def cell_graph_colored_by_gene(self, name: str, gene: int | str, normalization: str = "L2") -> DataFrame:
        """The vertices on a scale of the gene's normalised counts."""
        gene_id = self.gene_id_from_name(gene) if isinstance(gene, str) else gene
        values = matrix.normalised(self.table("counts"), self._method(normalization)).filter(F.col("gene_id") == gene_id)
        return graphs.scale_colors(self.graph("cell_graph", name)[0].select("id"), values.select(F.col("cell_id").cast("bigint").alias("id"), "value"))

    def cell_graph_colored_by_similarity(self, name: str, cell_id: int, gene_set: str = ALL_GENES) -> DataFrame:
        """The vertices on a scale of their similarity to one cell, from 0 to 1."""
        vertices, genes = self.graph("cell_graph", name)[0].select("id"), self.gene_set(gene_set)
        pairs = vertices.select(F.lit(cell_id).alias("id0"), F.col("id").alias("id1"))
        values = similarity.pair_similarity(matrix.restrict(self.table("counts"), genes), pairs, genes.count())
        return graphs.scale_colors(vertices, values.select(F.col("id1").alias("id"), F.col("exact").alias("value")), 0.0, 1.0)

    def colored_gene_graph(self, name: str, field: str) -> DataFrame:
        values = self.table("gene_meta").filter(F.col("name") == field).select(F.col("gene_id").cast("bigint").alias("id"), "value")
        return graphs.category_colors(self.graph("gene_graph", name)[0].select("id"), values)

    def signature_graph_shares(self, name: str, field: str) -> DataFrame:
        """``id, value, fraction``: the shares of a field's values among the cells of each vertex, as pies show them."""
        signatures = self._params("signature_graph", name)["signatures"]
        sigs = self.table("signatures", f"signatures/{signatures}").select("id", "sig")
        own = sigs.join(self.graph("signature_graph", name)[0].select("id"), "id", "left_semi").select("sig", "id")
        sizes = sigs.join(own.select("sig"), "sig", "left_semi").groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
        values = self.table("cell_meta").filter(F.col("name") == field).select(F.col("cell_id").cast("bigint").alias("id"), "value")
        return graphs.signature_categories(sigs, own.join(sizes, "sig"), values)

    def write_svg(self, name: str, path: str, field: str | None = None) -> None:
        """A drawing of a cell graph with a layout, its vertices coloured by a field if one is given."""
        vertices, edges = self.get_cell_graph_vertices(name), self.get_cell_graph_edges(name)
        colors = self.colored_cell_graph(name, field) if field is not None else vertices.select("id", F.lit("#000000").alias("color"))
        sinks.write_svg(vertices.join(colors.select("id", "color"), "id"), edges, path)

    def write_graph(self, kind: str, name: str, path: str) -> None:
        """Graphviz text of a stored graph."""
        sinks.write_dot(*self.graph(kind, name), path)

    def get_cluster_graph_vertices(self, name: str) -> list[int]:
        rows = self.graph("cluster_graph", name)[0].select("cluster_id").distinct().collect()  # one row per cluster
        return sorted(r["cluster_id"] for r in rows if r["cluster_id"] is not None)

    def get_cluster_graph_genes(self, name: str) -> DataFrame:
        """The genes that the cluster graph was made with."""
        return self.gene_set(self._params("cluster_graph", name)["gene_set"]).orderBy("gene_id")

    def get_cluster_cells_report(self, name: str, cluster_id: int, fields: list[str]) -> DataFrame:
        return meta.pivot_fields(self.table("cell_meta"), self.get_cluster_cells(name, cluster_id), fields)

    def get_cluster_cells(self, name: str, cluster_id: int) -> DataFrame:
        return self.graph("cluster_graph", name)[0].filter(F.col("cluster_id") == cluster_id).select(F.col("id").alias("cell_id")).orderBy("cell_id")

    def get_cluster_average_expression(self, name: str, cluster_id: int) -> DataFrame:
        own = self.table("profiles", f"cluster_graph/{name}").filter(F.col("cluster_id") == cluster_id)
        if own.isEmpty():
            raise KeyError(cluster_id)
        return own.select("gene_id", "average").orderBy(F.desc("average"), "gene_id")

    def compare_clusters(self, name: str, first: list[int], second: list[int]) -> DataFrame:
        """Size-weighted L2 profiles of two groups of clusters with their ratios, by the greater value."""
        vertices = self.graph("cluster_graph", name)[0]
        sizes = vertices.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
        profiles = self.table("profiles", f"cluster_graph/{name}").join(sizes, "cluster_id")

        def mean(ids: list[int], column: str) -> DataFrame:
            sums = profiles.filter(F.col("cluster_id").isin(ids)).groupBy("gene_id").agg(F.sum(F.col("n") * F.col("average")).alias("w"))
            norm = sums.agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
            return sums.join(F.broadcast(norm)).select("gene_id", F.try_divide("w", "norm").alias(column))

        both = mean(first, "a").join(mean(second, "b"), "gene_id", "full_outer").na.fill(0.0, ["a", "b"])
        return both.select("gene_id", "a", "b", F.try_divide("a", "b").alias("a_to_b"), F.try_divide("b", "a").alias("b_to_a"), F.greatest("a", "b").alias("most")).orderBy(F.desc("most"), "gene_id")

    def create_meta_data_from_cluster_graph(self, name: str, field: str) -> None:
        """The cluster as a field of its cells; cells of dissolved clusters get ``Unclustered-<id>``."""
        vertices = self.graph("cluster_graph", name)[0]
        value = F.coalesce(F.col("cluster_id").cast("string"), F.concat(F.lit("Unclustered-"), F.col("id").cast("string")))
        self.set_cell_meta_data(vertices.select(F.col("id").cast("int").alias("cell_id"), F.lit(field).alias("name"), value.alias("value")))

    def remove_cell_graph(self, name: str) -> None:
        self._drop("cell_graph", name)

    def remove_cluster_graph(self, name: str) -> None:
        self._drop("cluster_graph", name)

    def remove_gene_graph(self, name: str) -> None:
        self._drop("gene_graph", name)

    def remove_signature_graph(self, name: str) -> None:
        self._drop("signature_graph", name)

    # --- reports ---

    def summary(self) -> dict[str, int]:
        return {"genes": self.gene_count(), "cells": self.cell_count(), "counts": self.table("counts").count()}

    def gene_report(self, gene_id: int, cell_set: str = ALL_CELLS, fields: list[str] = ()) -> DataFrame:
        counts = matrix.restrict(self.table("counts"), None, self.cell_set(cell_set))
        l1, l2 = (matrix.normalised(counts, m).filter(F.col("gene_id") == gene_id).select("cell_id", F.col("value").alias(m)) for m in ("L1", "L2"))
        own = counts.filter(F.col("gene_id") == gene_id).select("cell_id", "count").join(l1, "cell_id").join(l2, "cell_id")
        wide = meta.pivot_fields(self.table("cell_meta"), own, ["CellName", *fields])
        return own.join(wide, "cell_id").orderBy(F.desc("L2"), "cell_id")

    def cell_report(self, cell_id: int, gene_set: str = ALL_GENES) -> DataFrame:
        own = matrix.restrict(self.table("counts"), self.gene_set(gene_set)).filter(F.col("cell_id") == cell_id)
        l1, l2 = (matrix.normalised(own, m).select("gene_id", F.col("value").alias(m)) for m in ("L1", "L2"))
        return own.select("gene_id", "count").join(l1, "gene_id").join(l2, "gene_id").join(self.table("genes"), "gene_id").orderBy(F.desc("count"), "gene_id")

    def compare_two_cells(self, cell0: int, cell1: int, gene_set: str = ALL_GENES) -> DataFrame:
        return matrix.compare_cells(self.table("counts"), cell0, cell1, self.gene_set(gene_set)).join(self.table("genes"), "gene_id").orderBy(F.desc("total"), F.desc("gene_id"))

    def compare_two_genes(self, gene0: int, gene1: int, cell_set: str = ALL_CELLS, normalization: str = "L2", norm_gene_set: str = ALL_GENES) -> tuple[float | None, DataFrame]:
        """The similarity of two genes over the cells, and their values side by side."""
        cells = self.cell_set(cell_set, True)
        values = matrix.normalised(matrix.restrict(self.table("counts"), self.gene_set(norm_gene_set), cells), self._method(normalization))
        pair = self.spark.createDataFrame([(gene0, gene1)], "id0 int, id1 int")
        exact = similarity.pair_similarity(values, pair, cells.count(), "gene_id", "cell_id", "value").first()["exact"]
        side = lambda g, c: values.filter(F.col("gene_id") == g).select("cell_id", F.col("value").alias(c))
        return exact, cells.join(side(gene0, "value0"), "cell_id", "left").join(side(gene1, "value1"), "cell_id", "left").na.fill(0.0)

    def cell_set_report(self, cell_set: str, fields: list[str]) -> DataFrame:
        return meta.pivot_fields(self.table("cell_meta"), self.cell_set(cell_set), fields)
