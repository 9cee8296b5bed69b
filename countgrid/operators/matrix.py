"""The sparse count matrix: current counts, packed rows, sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countgrid.session import spread

#: Values of dense rows that a task holds at once.
DENSE_VALUES = 2_000_000


def latest_counts(rows: DataFrame, cell: str = "cell_id", gene: str = "gene_id", count: str = "expr_count", order: str = "loaded_at") -> DataFrame:
    """``cell_id, gene_id, count`` of the latest row per pair; only counts above zero.

    Null, NaN, zero and negative counts are 0 and leave no row. The aggregate is
    partial before its shuffle, so resent and corrected rows don't travel.
    """
    last = F.max(F.struct(F.col(f"`{order}`"), F.col(f"`{count}`"))).alias("_last")
    current = rows.filter(F.col(f"`{cell}`").isNotNull() & F.col(f"`{gene}`").isNotNull())
    current = current.groupBy(F.col(f"`{cell}`").alias("cell_id"), F.col(f"`{gene}`").alias("gene_id")).agg(last)
    current = current.select("cell_id", "gene_id", F.col(f"_last.`{count}`").alias("count"))
    return current.filter("count > 0 AND NOT isnan(count)")


def packed_rows(counts: DataFrame) -> DataFrame:
    """``cell_id, genes ARRAY<INT>, counts ARRAY<FLOAT>``: at most as long as there are genes."""
    pairs = spread(counts, "cell_id").groupBy("cell_id").agg(F.collect_list(F.struct("gene_id", F.col("count").cast("float").alias("count"))).alias("p"))
    return pairs.select("cell_id", F.col("p.gene_id").alias("genes"), F.col("p.count").alias("counts"))


def cell_sums(counts: DataFrame) -> DataFrame:
    """Per cell: sum, sum of squares, Euclidean length and the inverses (null for a length of 0)."""
    x = F.col("count").cast("double")
    sums = counts.groupBy("cell_id").agg(F.sum(x).alias("sum1"), F.sum(x * x).alias("sum2"))
    sums = sums.withColumn("norm2", F.sqrt("sum2"))
    return sums.withColumn("norm1_inverse", F.try_divide(F.lit(1.0), "sum1")).withColumn("norm2_inverse", F.try_divide(F.lit(1.0), "norm2"))


def restrict(counts: DataFrame, genes: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """The part of the matrix within a gene set and a cell set (semi joins; small sets are broadcast by size)."""
    if genes is not None:
        counts = counts.join(genes.select("gene_id").distinct(), "gene_id", "left_semi")
    if cells is not None:
        counts = counts.join(cells.select("cell_id").distinct(), "cell_id", "left_semi")
    return counts.select("cell_id", "gene_id", "count")


def normalised(counts: DataFrame, method: str = "L2") -> DataFrame:
    """Counts divided by their cell's sum (``L1``) or Euclidean length (``L2``), or as they are (``none``)."""
    if method == "none":
        return counts.withColumn("value", F.col("count").cast("double")).select("cell_id", "gene_id", "value")
    norm = {"L1": "sum1", "L2": "norm2"}[method]
    joined = counts.join(cell_sums(counts).select("cell_id", norm), "cell_id")
    return joined.select("cell_id", "gene_id", F.try_divide(F.col("count").cast("double"), F.col(norm)).alias("value"))


def average_profiles(counts: DataFrame, groups: DataFrame, method: str = "L2") -> DataFrame:
    """Mean normalised profile of each group of cells, normalised again by the same method.

    ``groups``: ``cell_id, group_id``. The mean is over all cells of the group, also
    those without counts. Result: ``group_id, gene_id, average``; zeros are left out.
    """
    sizes = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("cells"))
    sums = normalised(counts, method).join(groups.select("cell_id", "group_id"), "cell_id").groupBy("group_id", "gene_id").agg(F.sum("value").alias("value"))
    means = sums.join(sizes, "group_id").select("group_id", "gene_id", (F.col("value") / F.col("cells")).alias("average"))
    if method == "none":
        return means
    total = F.sum("average") if method == "L1" else F.sqrt(F.sum(F.col("average") * F.col("average")))
    norms = means.groupBy("group_id").agg(total.alias("norm"))
    return means.join(norms, "group_id").select("group_id", "gene_id", F.try_divide("average", "norm").alias("average"))


def information_content(counts: DataFrame, genes: DataFrame, cells: DataFrame, method: str = "none") -> DataFrame:
    """Bits of information of each gene of ``genes`` over the cells of ``cells``.

    With the shares p of a gene's total over the cells it is log2 N + sum(p log2 p). Counts
    are normalised over all genes of a cell. One aggregation gives both sums, as
    sum(p ln p) = sum(c ln c) / S - ln S. A gene without counts has log2 N.
    """
    c = F.col("value")
    values = normalised(counts.join(cells.select("cell_id").distinct(), "cell_id", "left_semi"), method).join(genes.select("gene_id").distinct(), "gene_id", "left_semi")
    sums = values.filter(c > 0).groupBy("gene_id").agg(F.sum(c).alias("s"), F.sum(c * F.log(c)).alias("t"))
    size = cells.select("cell_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    bits = (F.log("n") + F.coalesce(F.col("t") / F.col("s") - F.log("s"), F.lit(0.0))) / F.log(F.lit(2.0))
    return genes.select("gene_id").distinct().join(sums, "gene_id", "left").join(F.broadcast(size)).select("gene_id", bits.alias("information_content"))


def aligned_counts(counts: DataFrame, cells: DataFrame, gene_id: int) -> DataFrame:
    """The count of one gene in each listed cell, zeros included."""
    own = counts.filter(F.col("gene_id") == gene_id).select("cell_id", F.col("count").alias("c"))
    return cells.select("cell_id").join(own, "cell_id", "left").select("cell_id", F.coalesce(F.col("c").cast("double"), F.lit(0.0)).alias("count"))


def compare_cells(counts: DataFrame, cell0: int, cell1: int, genes: DataFrame | None = None) -> DataFrame:
    """The union of the genes of two cells with both counts, largest total first."""
    own = restrict(counts, genes)
    a = own.filter(F.col("cell_id") == cell0).select("gene_id", F.col("count").cast("double").alias("count0"))
    b = own.filter(F.col("cell_id") == cell1).select("gene_id", F.col("count").cast("double").alias("count1"))
    both = a.join(b, "gene_id", "full_outer").na.fill(0.0, ["count0", "count1"])
    return both.withColumn("total", F.col("count0") + F.col("count1")).orderBy(F.desc("total"), F.desc("gene_id"))


def dense_rows(counts: DataFrame, genes: DataFrame, cells: DataFrame, method: str = "none") -> DataFrame:
    """One array per cell with a value for every gene, in the order of the gene ids."""
    ids = genes.select("gene_id").distinct().agg(F.sort_array(F.collect_list("gene_id")).alias("ids"))  # as long as the gene dictionary
    values = normalised(restrict(counts, genes, cells), method).join(ids.select(F.posexplode("ids").alias("place", "gene_id")), "gene_id")
    own = values.groupBy("cell_id").agg(F.collect_list(F.struct("place", F.coalesce("value", F.lit(0.0)).alias("value"))).alias("p"))
    none = F.array().cast("array<struct<place:int,value:double>>")
    rows = cells.select("cell_id").distinct().join(own, "cell_id", "left").join(F.broadcast(ids.select(F.size("ids").alias("n"))))
    p = F.coalesce("p", none)

    def fill(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            at = 0
            while at < frame.num_rows:
                n = frame.column(3)[0].as_py()
                part = frame.slice(at, max(1, DENSE_VALUES // max(n, 1)))
                at += part.num_rows
                out = np.zeros((part.num_rows, n))
                lengths = pc.list_value_length(part.column(1)).to_numpy()
                out[np.repeat(np.arange(part.num_rows), lengths), part.column(1).flatten().to_numpy()] = part.column(2).flatten().to_numpy()
                bounds = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * n, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(bounds, pa.array(out.ravel()))], ["cell_id", "expression"])

    key = cells.schema["cell_id"].dataType.simpleString()
    return rows.select("cell_id", p["place"].alias("places"), p["value"].alias("values"), "n").mapInArrow(fill, f"cell_id {key}, expression array<double>")
