"""Results as files: CSV tables, dense arrays and Graphviz text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def similar_pairs_table(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """Pairs with names: ``Cell0, Cell1, Computed`` and, where known, ``Exact``."""
    side = lambda k: cells.select(F.col("cell_id").alias(f"id{k}"), F.col("cell_name").alias(f"Cell{k}"))
    named = pairs.join(side(0), "id0").join(side(1), "id1")
    extra = [F.col("exact").alias("Exact")] if "exact" in pairs.columns else []
    return named.select("Cell0", "Cell1", F.col("similarity").alias("Computed"), *extra)


def dense_array(dense: DataFrame) -> tuple[list[int], np.ndarray]:
    """Cell ids and a [cell][gene] array on the driver; for selections that fit there."""
    table = dense.orderBy("cell_id").toArrow()
    return table["cell_id"].to_pylist(), np.array(table["expression"].to_pylist(), np.float64)


def dot_lines(vertices: DataFrame, edges: DataFrame, name: str = "G", label: str | None = None, color: str | None = None) -> DataFrame:
    """The graph in Graphviz syntax as ordered lines of text: ``part, line``."""
    attributes = [F.concat(F.lit('label="'), F.col(label).cast("string"), F.lit('"'))] if label else []
    attributes += [F.concat(F.lit('fillcolor="'), F.col(color), F.lit('"'))] if color else []
    inside = F.concat(F.lit(" ["), F.concat_ws(", ", *attributes), F.lit("]")) if attributes else F.lit("")
    nodes = vertices.select(F.lit(1).alias("part"), F.concat(F.lit("  "), F.col("id").cast("string"), inside, F.lit(";")).alias("line"))
    links = edges.select(F.lit(2).alias("part"), F.concat(F.lit("  "), F.col("src").cast("string"), F.lit(" -- "), F.col("dst").cast("string"), F.lit(' [weight="'), F.format_string("%.6f", F.col("similarity").cast("double")), F.lit('"];')).alias("line"))
    frame = vertices.sparkSession.createDataFrame([(0, f"graph {name} {{"), (3, "}")], "part int, line string")
    return frame.unionByName(nodes).unionByName(links).orderBy("part", "line")


def write_dot(vertices: DataFrame, edges: DataFrame, path: str, **options) -> None:
    """Files whose contents in the order of their names are the graph; a small graph is one file."""
    dot_lines(vertices, edges, **options).select("line").write.mode("overwrite").text(path)


def write_svg(vertices: DataFrame, edges: DataFrame, path: str, size: int = 1000) -> None:
    """A drawing of ``vertices`` (``id, x, y, color``) and ``edges``, as files that follow each other by name."""
    span = vertices.agg(*[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))])
    scale = F.greatest(F.col("highx") - F.col("lowx"), F.col("highy") - F.col("lowy"), F.lit(1e-9)) / (0.94 * size)
    placed = vertices.join(F.broadcast(span)).select("id", "color", *[((F.col(c) - F.col(f"low{c}")) / scale + 0.03 * size).alias(c) for c in "xy"])
    side = lambda k, c: placed.select(F.col("id").alias(c), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    lines = edges.join(side(0, "src"), "src").join(side(1, "dst"), "dst")
    lines = lines.select(F.lit(1).alias("part"), F.format_string('<line x1="%.2f" y1="%.2f" x2="%.2f" y2="%.2f" stroke="#999999"/>', "x0", "y0", "x1", "y1").alias("line"))
    dots = placed.select(F.lit(2).alias("part"), F.format_string('<circle cx="%.2f" cy="%.2f" r="4" fill="%s"><title>%d</title></circle>', "x", "y", "color", "id").alias("line"))
    frame = vertices.sparkSession.createDataFrame([(0, f'<svg xmlns="http://www.w3.org/2000/svg" width="{size}" height="{size}">'), (3, "</svg>")], "part int, line string")
    frame.unionByName(lines).unionByName(dots).orderBy("part", "line").select("line").write.mode("overwrite").text(path)


def spring_layout(ids: list[int], edges: list[tuple[int, int]], rounds: int = 60, seed: int = 1) -> dict[int, tuple[float, float]]:
    """A deterministic force layout of a small graph on the driver, for display only."""
    at = {v: i for i, v in enumerate(ids)}
    n = len(ids)
    if not n:
        return {}
    position = np.random.default_rng(seed).random((n, 2))
    ends = np.array([(at[a], at[b]) for a, b in edges], np.int64).reshape(-1, 2)
    ideal = 1 / np.sqrt(n)
    for step in range(rounds):
        delta = position[:, None] - position[None]
        distance = np.maximum(np.sqrt((delta**2).sum(-1)), 1e-6)
        move = (delta * (ideal**2 / distance**2)[..., None]).sum(axis=1)
        pull = position[ends[:, 0]] - position[ends[:, 1]]
        force = pull * (np.sqrt((pull**2).sum(-1, keepdims=True)) / ideal)
        np.add.at(move, ends[:, 0], -force)
        np.add.at(move, ends[:, 1], force)
        length = np.maximum(np.sqrt((move**2).sum(-1, keepdims=True)), 1e-9)
        position += move / length * np.minimum(length, 0.1 * (1 - step / rounds))
    return {v: (float(position[i, 0]), float(position[i, 1])) for v, i in at.items()}
