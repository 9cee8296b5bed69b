"""Cell sets and gene sets: predicates, algebra, samples, statistics.

A cell set is a DataFrame with ``cell_id``, a gene set one with ``gene_id``; members are distinct.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countgrid.functions.values import DECIMAL_PATTERN, full_match
from countgrid.operators.matrix import information_content, restrict


def _members(df: DataFrame) -> DataFrame:
    return df.select("cell_id").distinct()


def cells_by_value(meta: DataFrame, field: str, value: str) -> DataFrame:
    """Cells whose field equals the value; cells without the field are left out."""
    return _members(meta.filter((F.col("name") == field) & (F.col("value") == value)))


def cells_by_regex(meta: DataFrame, field: str, pattern: str) -> DataFrame:
    """Cells whose field matches the whole Java regular expression."""
    return _members(meta.filter((F.col("name") == field) & full_match(F.col("value"), pattern)))


def cells_by_number(meta: DataFrame, field: str, lower: float | None = None, upper: float | None = None) -> DataFrame:
    """Cells whose field is a number within the inclusive bounds; other texts are left out."""
    number = F.when(full_match(F.col("value"), DECIMAL_PATTERN), F.col("value").try_cast("double"))
    keep = number.isNotNull()
    if lower is not None:
        keep &= number >= lower
    if upper is not None:
        keep &= number <= upper
    return _members(meta.filter((F.col("name") == field) & keep))


def union(sets: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, sets).distinct()


def intersection(sets: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.intersect, sets)


def difference(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.subtract(second)


def downsample(cells: DataFrame, probability: float, seed: int) -> DataFrame:
    """Keeps each cell with the given chance, by MD5 of ``seed:id``: the same at every partitioning and in any engine."""
    digits = 16
    bound = min(int(probability * 16**digits), 16**digits)
    if bound >= 16**digits:
        return cells
    return cells.filter(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("cell_id").cast("string"))) < f"{max(bound, 0):0{digits}x}")


def downsample_stream(ids: list[int], probability: float, seed: int) -> list[int]:
    """The sample that a standard 32-bit Mersenne Twister draws over the sorted ids; for sets that fit the driver."""
    legacy = np.random.RandomState(seed)
    draws = legacy.randint(0, 2**32, size=len(ids), dtype=np.uint64).astype(np.float64) / 2**32
    return [i for i, u in zip(sorted(ids), draws) if u < probability]


def genes_by_regex(genes: DataFrame, pattern: str) -> DataFrame:
    return genes.filter(full_match(F.col("gene_name"), pattern)).select("gene_id").distinct()


def genes_by_name(genes: DataFrame, names: list[str], strict: bool = True) -> DataFrame:
    """Genes with the listed names; ``strict`` refuses empty and unknown ones."""
    wanted = genes.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(names)], "gene_name string")
    if strict:
        missing = [r[0] for r in wanted.join(genes, "gene_name", "left_anti").limit(5).collect()]
        if missing or "" in names:
            raise ValueError(f"unknown or empty gene names: {missing}")
    return genes.join(wanted, "gene_name", "left_semi").select("gene_id").distinct()


def well_expressed_genes(counts: DataFrame, genes: DataFrame, cells: DataFrame, min_cells: int) -> DataFrame:
    """Genes of the set with a count in at least ``min_cells`` cells of the set."""
    if min_cells <= 0:
        return genes.select("gene_id").distinct()
    return restrict(counts, genes, cells).groupBy("gene_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_cells).select("gene_id")


def high_information_genes(counts: DataFrame, genes: DataFrame, cells: DataFrame, threshold: float, method: str = "L2") -> DataFrame:
    """Genes of the set with more information content than the threshold."""
    return information_content(counts, genes, cells, method).filter(F.col("information_content") > threshold).select("gene_id")


def content_hash(members: DataFrame, key: str) -> str:
    """A hash of the members that doesn't depend on their order, from an aggregate of bounded size."""
    h = F.xxhash64(F.col(key))
    row = members.select(key).distinct().agg(F.count(F.lit(1)), F.sum(F.pmod(h, F.lit(2**31))), F.bit_xor(h)).first()
    return "-".join(str(v or 0) for v in row)


def same_members(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
