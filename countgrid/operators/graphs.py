"""Nearest-neighbour graphs, label propagation, cluster graphs, signature graphs.

Graphs are DataFrames: vertices with ``id``, edges with ``src < dst`` and ``similarity``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countgrid.operators.matrix import average_profiles
from countgrid.operators.similarity import pair_similarity
from countgrid.session import Scratch, shuffle_partitions


def knn_graph(pairs: DataFrame, members: DataFrame, threshold: float = 0.5, k: int = 20, keep_isolated: bool = False) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of the graph of at most k neighbours at or above the threshold.

    ``pairs``: ``id0, id1, similarity``; ``members``: ``id``. Neighbours outside the set
    don't use up k. Edges are undirected; of two directions the greater similarity holds.
    """
    ids = members.select("id").distinct()
    own = pairs.filter((F.col("similarity") >= threshold) & (F.col("id0") != F.col("id1")))
    for side in ("id0", "id1"):
        own = own.join(ids.withColumnRenamed("id", side), side, "left_semi")
    order = Window.partitionBy("id0").orderBy(F.desc("similarity"), "id1")
    best = own.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    edges = best.groupBy(F.least("id0", "id1").alias("src"), F.greatest("id0", "id1").alias("dst")).agg(F.max("similarity").alias("similarity"))
    if keep_isolated:
        return ids, edges
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct(), edges


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end: ``id, other, similarity``."""
    there = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), "similarity")
    return there.unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), "similarity"))


def connectivity(edges: DataFrame) -> DataFrame:
    """The neighbours of each vertex, most similar first."""
    return both_ways(edges).groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "other"))), lambda x: F.struct(x.other.alias("other"), (-x.s).alias("similarity"))).alias("neighbours"))


def label_propagation(vertices: DataFrame, edges: DataFrame, seed: int = 231, stable_iterations: int = 3, max_iterations: int = 100) -> DataFrame:
    """``id, cluster_id``: labels spread by the greatest sum of similarities among the neighbours.

    In each iteration a random half of the vertices, chosen by MD5 of ``id:seed:iteration``, takes
    its best label (ties, to nine digits, keep the present one, then the smaller one); updating only
    a half keeps two-coloured parts from swapping for ever. It ends after
    ``stable_iterations`` iterations without a change. Clusters are numbered by size,
    then by smallest member. Lineage is cut in shared storage each iteration.
    """
    scratch = Scratch(vertices.sparkSession, "labels")
    links = scratch.keep(both_ways(edges))
    labels = scratch.keep(vertices.select("id", F.col("id").alias("label")))
    quiet = 0
    for number in range(max_iterations):
        weights = links.join(labels.select(F.col("id").alias("other"), "label"), "other").groupBy("id", "label").agg(F.round(F.sum("similarity"), 9).alias("w"))
        now = labels.withColumnRenamed("label", "present")
        ranked = weights.join(now, "id").groupBy("id").agg(F.max(F.struct("w", (F.col("label") == F.col("present")).alias("stay"), (-F.col("label")).alias("neg"))).alias("best"))
        turn = F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed)), F.lit(str(number)))), 1, 1) < "8"
        fresh = now.join(ranked, "id", "left").select("id", "present", F.when(turn & F.col("best").isNotNull(), -F.col("best.neg")).otherwise(F.col("present")).alias("label"))
        fresh = scratch.keep(fresh)
        changed = not fresh.filter("label != present").isEmpty()
        scratch.drop(labels)
        labels = fresh.select("id", "label")
        labels._countgrid_path = fresh._countgrid_path
        quiet = 0 if changed else quiet + 1
        if quiet >= stable_iterations:
            break
    return numbered(labels, "label")


def numbered(labels: DataFrame, label: str = "label") -> DataFrame:
    """Cluster numbers from 0 by size (largest first), then by smallest member."""
    sizes = labels.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    ranked = with_places(sizes, [F.desc("n"), F.asc("first")], "cluster_id", Scratch(labels.sparkSession, "numbers"))
    return labels.join(ranked.select(label, "cluster_id"), label).select("id", "cluster_id")


def with_places(rows: DataFrame, order: list, name: str, scratch: Scratch) -> DataFrame:
    """Adds ``name``: 0, 1, ... in a total order of all rows, without gathering them in one task.

    Rows are range-partitioned and sorted; each partition counts from the number of rows
    before it, for which one number a partition goes through the driver.
    """
    parted = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    # within a partition the low 33 bits count the rows in order
    parted = scratch.keep(parted.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    starts, at = [], 0
    for part, size in sorted(parted.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):  # one row per task
        starts.append((part, at))
        at += size
    offsets = rows.sparkSession.createDataFrame(starts, "_part bigint, _start bigint")
    place = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return parted.join(F.broadcast(offsets), "_part").withColumn(name, place).drop("_at", "_part", "_start")


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component``: the smallest id of the connected component, by hooking and shortcutting on tables."""
    scratch = Scratch(vertices.sparkSession, "components")
    links = scratch.keep(both_ways(edges).select("id", "other").distinct())
    state = scratch.keep(vertices.select("id", F.col("id").alias("component")))
    while True:
        seen = links.join(state.select(F.col("id").alias("other"), F.col("component").alias("c")), "other").groupBy("id").agg(F.min("c").alias("c"))
        lower = state.join(seen, "id", "left").select("id", F.col("component").alias("before"), F.least("component", F.coalesce("c", "component")).alias("component"))
        # shortcut: the component of the component
        jump = lower.select(F.col("id").alias("component"), F.col("component").alias("further"))
        fresh = scratch.keep(lower.join(jump, "component", "left").select("id", "before", F.least("component", F.coalesce("further", "component")).alias("component")))
        scratch.drop(state)
        state = fresh.select("id", "component")
        if fresh.filter("before != component").isEmpty():
            return state
        state._countgrid_path = fresh._countgrid_path


def cluster_edges(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Pairs of clusters joined by an edge: ``c0 < c1``."""
    a = clusters.select(F.col("id").alias("src"), F.col("cluster_id").alias("a"))
    b = clusters.select(F.col("id").alias("dst"), F.col("cluster_id").alias("b"))
    return edges.join(a, "src").join(b, "dst").filter("a != b").select(F.least("a", "b").alias("c0"), F.greatest("a", "b").alias("c1")).distinct()


def cluster_graph(
    vertices: DataFrame,
    edges: DataFrame,
    counts: DataFrame,
    n_genes: int,
    *,
    labels: DataFrame | None = None,
    min_cluster_size: int = 100,
    merge_similarity: float = 0.9,
    threshold: float = 0.5,
    k: int = 3,
    parity_merge: bool = False,
    **propagation,
) -> dict[str, DataFrame]:
    """The graph of clusters: ``members`` (id, cluster_id), ``unclustered`` (id), ``profiles``, ``edges``.

    Steps: label propagation; clusters are vertices, joined where their cells are;
    neighbouring clusters with more similar L2 profiles than ``merge_similarity`` merge
    (their other edges are kept, unless ``parity_merge``); clusters below
    ``min_cluster_size`` dissolve; profiles, edge similarities; edges below ``threshold``
    go; of the others those among the k best of either end stay; numbering by size.
    """
    scratch = Scratch(vertices.sparkSession, "clustergraph")
    own = scratch.keep(labels if labels is not None else label_propagation(vertices, edges, **propagation))

    def profiles_of(members: DataFrame) -> DataFrame:
        return average_profiles(counts, members.select(F.col("id").alias("cell_id"), F.col("cluster_id").alias("group_id")), "L2")

    def scored(members: DataFrame, profiles: DataFrame, links: DataFrame) -> DataFrame:
        pairs = links.select(F.col("c0").alias("id0"), F.col("c1").alias("id1"))
        return pair_similarity(profiles, pairs, n_genes, "group_id", "gene_id", "average").select(F.col("id0").alias("c0"), F.col("id1").alias("c1"), F.col("exact").alias("similarity"))

    links = scratch.keep(cluster_edges(edges, own))
    close = scored(own, scratch.keep(profiles_of(own)), links).filter(F.col("similarity") > merge_similarity)
    ids = own.select(F.col("cluster_id").alias("id")).distinct()
    merged = components(ids, close.select(F.col("c0").alias("src"), F.col("c1").alias("dst"), "similarity"))
    own = scratch.keep(own.join(merged.select(F.col("id").alias("cluster_id"), "component"), "cluster_id").select("id", F.col("component").alias("cluster_id")))
    if parity_merge:
        links = links.join(own.select(F.col("cluster_id").alias("c0")).distinct(), "c0", "left_semi").join(own.select(F.col("cluster_id").alias("c1")).distinct(), "c1", "left_semi")
    else:
        links = cluster_edges(edges, own)
    large = own.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_cluster_size).select("cluster_id")
    unclustered = own.join(large, "cluster_id", "left_anti").select("id")
    kept = own.join(large, "cluster_id", "left_semi")
    final = scratch.keep(kept.join(numbered(kept.select("id", F.col("cluster_id").alias("label"))).withColumnRenamed("cluster_id", "number"), "id"))
    names = final.select("cluster_id", "number").distinct()
    members = final.select("id", F.col("number").alias("cluster_id"))
    renamed = links.join(names.select(F.col("cluster_id").alias("c0"), F.col("number").alias("n0")), "c0").join(names.select(F.col("cluster_id").alias("c1"), F.col("number").alias("n1")), "c1")
    links = renamed.select(F.least("n0", "n1").alias("c0"), F.greatest("n0", "n1").alias("c1")).distinct()
    profiles = scratch.keep(profiles_of(members))
    strong = scored(members, profiles, links).filter(F.col("similarity") >= threshold)
    return {"members": members, "unclustered": unclustered, "profiles": profiles.withColumnRenamed("group_id", "cluster_id"), "edges": best_edges(strong, k)}


def best_edges(edges: DataFrame, k: int, a: str = "c0", b: str = "c1") -> DataFrame:
    """Edges among the k most similar of at least one of their ends."""
    ways = edges.select(F.col(a).alias("v"), F.col(b).alias("w"), "similarity", a, b).unionByName(edges.select(F.col(b).alias("v"), F.col(a).alias("w"), "similarity", a, b))
    rank = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("similarity"), "w"))
    return ways.withColumn("r", rank).filter(F.col("r") <= k).select(a, b, "similarity").distinct()


def signature_graph(sigs: DataFrame, bits: int, min_rows: int = 100) -> tuple[DataFrame, DataFrame]:
    """Vertices: signatures of at least ``min_rows`` rows; edges: those that differ in one bit.

    Each vertex looks up its neighbours by turning on each of its zero bits, one equi-join.
    """
    vertices = sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).filter(F.col("n") >= min_rows)
    words = -(-bits // 64)
    bit = F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit")
    turned = vertices.select("id", "sig", bit)
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), (63 - F.col("bit") % 64).cast("int"))
    word = (F.col("bit") / 64).cast("int")
    turned = turned.withColumn("mask", mask).withColumn("word", word).filter(F.expr("(element_at(sig, word + 1) & mask) = 0"))
    on = F.array(*[F.when(F.col("word") == w, F.element_at("sig", w + 1).bitwiseOR(F.col("mask"))).otherwise(F.element_at("sig", w + 1)) for w in range(words)])
    lookup = turned.select(F.col("id").alias("a"), on.alias("sig"))
    pairs = lookup.join(vertices.select("sig", F.col("id").alias("b")), "sig").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    return vertices, pairs


def signature_categories(sigs: DataFrame, vertices: DataFrame, groups: DataFrame) -> DataFrame:
    """``id, value, fraction``: the share of each value among the rows of a signature vertex."""
    own = sigs.join(vertices.select("sig", F.col("id").alias("vertex"), "n"), "sig").join(groups, "id", "left")
    counts = own.groupBy("vertex", "n", F.coalesce("value", F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias("m"))
    return counts.select(F.col("vertex").alias("id"), "value", (F.col("m") / F.col("n")).alias("fraction"))


def compare_graphs(vertices0: DataFrame, edges0: DataFrame, vertices1: DataFrame, edges1: DataFrame) -> DataFrame:
    """Counts of vertices and edges in either, both, and with equal similarity."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    both = edges0.withColumnRenamed("similarity", "s0").join(edges1.withColumnRenamed("similarity", "s1"), ["src", "dst"])
    parts = [count(vertices0, "vertices0"), count(vertices1, "vertices1"), count(vertices0.join(vertices1, "id", "left_semi"), "common_vertices"), count(edges0, "edges0"), count(edges1, "edges1"), both.agg(F.count(F.lit(1)).alias("common_edges"), F.coalesce(F.sum((F.col("s0") == F.col("s1")).cast("bigint")), F.lit(0)).alias("equal_edges"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(F.broadcast(part))  # one row each
    return out


def similarity_changes(edges0: DataFrame, edges1: DataFrame) -> DataFrame:
    """Common edges by the change of their similarity, rounded to 0.01."""
    both = edges0.withColumnRenamed("similarity", "s0").join(edges1.withColumnRenamed("similarity", "s1"), ["src", "dst"])
    return both.groupBy((F.round((F.col("s1") - F.col("s0")) / 0.01) * 0.01).alias("change")).agg(F.count(F.lit(1)).alias("n")).orderBy("change")


def group_frequencies(vertices: DataFrame, groups: DataFrame) -> DataFrame:
    """Values of a field over the vertices, most frequent first; ties in falling order of value."""
    return vertices.join(groups, "id", "left").groupBy(F.coalesce("value", F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("value"))


# Twelve well separated display colours.
CATEGORY_COLORS = ("#1f78b4", "#33a02c", "#e31a1c", "#ff7f00", "#6a3d9a", "#b15928", "#a6cee3", "#b2df8a", "#fb9a99", "#fdbf6f", "#cab2d6", "#ffff99")


def category_colors(vertices: DataFrame, groups: DataFrame, other: str = "#000000") -> DataFrame:
    """``id, value, color``: the twelve most frequent values that aren't empty get a colour each."""
    own = vertices.join(groups, "id", "left").select("id", F.coalesce("value", F.lit("")).alias("value"))
    counts = own.filter("value != ''").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), F.desc("value")).limit(len(CATEGORY_COLORS))
    place = F.row_number().over(Window.orderBy(F.desc("n"), F.desc("value")))
    colors = F.array(*[F.lit(c) for c in CATEGORY_COLORS])
    top = top.select("value", F.element_at(colors, place).alias("color"))
    return own.join(F.broadcast(top), "value", "left").select("id", "value", F.coalesce("color", F.lit(other)).alias("color"))


def scale_colors(vertices: DataFrame, numbers: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """``id, value, color``: numbers on a scale from red over yellow to green between two values, their extremes unless given."""
    span = numbers.agg((F.min("value") if low is None else F.lit(low)).alias("low"), (F.max("value") if high is None else F.lit(high)).alias("high"))
    own = vertices.join(numbers, "id", "left").join(F.broadcast(span))
    x = F.when(F.col("high") > F.col("low"), (F.col("value") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    part = lambda c: F.round(F.greatest(F.least(F.lit(1.0), c), F.lit(0.0)) * 255).cast("int")
    color = F.when(F.col("value").isNotNull(), F.format_string("#%02x%02x%02x", part(2 - 2 * x), part(2 * x), F.lit(0))).otherwise("#000000")
    return own.select("id", "value", color.alias("color"))


def given_colors(vertices: DataFrame, colors: DataFrame, other: str = "#000000") -> DataFrame:
    """``id, value, color``: values that are colours themselves, as #rrggbb or a name; others are ``other``."""
    own = vertices.join(colors, "id", "left").select("id", "value")
    return own.withColumn("color", F.when(F.col("value").rlike(r"\A(#[0-9A-Fa-f]{6}|[A-Za-z]+)\z"), F.col("value")).otherwise(other))


def greedy_group_colors(edges: DataFrame, groups: DataFrame) -> dict[str, int]:
    """The smallest colour not used by lower-numbered neighbouring groups; groups number as many as display categories."""
    a = groups.select(F.col("id").alias("src"), F.col("value").alias("g0"))
    b = groups.select(F.col("id").alias("dst"), F.col("value").alias("g1"))
    links = edges.join(a, "src").join(b, "dst").filter("g0 != g1").select(F.least("g0", "g1").alias("g0"), F.greatest("g0", "g1").alias("g1")).distinct()
    order = [r["value"] for r in groups.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").collect()]
    beside: dict[str, set[str]] = {}
    for r in links.collect():
        beside.setdefault(r["g0"], set()).add(r["g1"])
        beside.setdefault(r["g1"], set()).add(r["g0"])
    colors: dict[str, int] = {}
    for value in order:
        used = {colors[o] for o in beside.get(value, ()) if o in colors}
        colors[value] = next(c for c in range(len(used) + 1) if c not in used)
    return colors
