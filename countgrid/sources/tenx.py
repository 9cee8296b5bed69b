"""Compressed-sparse-row matrices in HDF5 (one group with barcodes, genes, indptr, indices, data)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countgrid.session import Scratch

#: Cells a task reads at once, through slices of the index.
CELLS_PER_TASK = 4096


def open_hdf5(path: str):
    """An HDF5 file at a local path, or at an address of a file system that pyarrow knows (such as s3:// or hdfs://)."""
    try:
        import h5py
    except ImportError as missing:
        raise RuntimeError("reading HDF5 needs h5py") from missing
    if "://" not in path:
        return h5py.File(path, "r")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return h5py.File(system.open_input_file(inner), "r")


def read_matrix(spark: SparkSession, path: str, prefix: str, min_total: float, scratch: Scratch, opener: Callable | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """``cell_name, gene_name, count``; ``cell_name, ord`` of the cells whose total reaches ``min_total``,
    with or without counts, in the order of the barcodes; and the gene names.

    ``opener`` opens a path as a mapping of one group to its arrays, on the driver and in each task
    (by default through h5py). Tasks read disjoint ranges of cells; the driver reads the gene names only.
    """
    opener = opener or open_hdf5
    with opener(path) as file:
        if len(file.keys()) != 1:
            raise ValueError("the file must have exactly one group")
        group = next(iter(file.keys()))
        genes = [g.decode() for g in file[group]["genes"][:]]
        cells, pointers = len(file[group]["barcodes"]), len(file[group]["indptr"])
    if len(set(genes)) != len(genes):
        raise ValueError("gene names repeat")
    if pointers != cells + 1:
        raise ValueError("indptr has the wrong length")

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with opener(path) as file:
            g = file[group]
            for frame in frames:
                for first in frame.column(0).to_pylist():
                    last = min(first + CELLS_PER_TASK, cells)
                    at = g["indptr"][first : last + 1].astype(np.int64)
                    data, index = g["data"][at[0] : at[-1]].astype(np.float64), g["indices"][at[0] : at[-1]].astype(np.int64)
                    names = np.array([f"{prefix}-{b.decode()}" if prefix else b.decode() for b in g["barcodes"][first:last]], object)
                    own = np.repeat(np.arange(last - first), np.diff(at))
                    kept = np.bincount(own, data, last - first) >= min_total
                    use = np.nonzero(kept[own] & (data != 0))[0]
                    whole = np.nonzero(kept)[0]
                    # a row at position -1 stands for the cell itself
                    row = np.concatenate([whole, own[use]])
                    place = np.concatenate([np.full(len(whole), -1), index[use]]).astype(np.int32)
                    count = pa.array(np.concatenate([np.zeros(len(whole)), data[use]]))
                    yield pa.RecordBatch.from_arrays([pa.array(names[row], pa.string()), pa.array(row + first), pa.array(place), count], ["cell_name", "ord", "position", "count"])

    starts = spark.range(0, max(cells, 1), CELLS_PER_TASK, max(1, -(-cells // CELLS_PER_TASK))).filter(F.col("id") < cells).select("id")
    rows = scratch.keep(starts.mapInArrow(read, "cell_name string, ord bigint, position int, count double"))
    dictionary = spark.createDataFrame(list(enumerate(genes)), "position int, gene_name string")
    return rows.join(dictionary, "position").select("cell_name", "gene_name", "count"), rows.filter("position = -1").select("cell_name", "ord"), genes
