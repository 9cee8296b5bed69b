"""Meta data as (entity, name, value, ord) rows: updates, frequencies, agreement of two fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(meta: DataFrame, updates: DataFrame, key: str = "cell_id") -> DataFrame:
    """Replaces or adds (entity, name) values. A replaced value keeps its place, a new one goes last.

    Of several updates of one value that with the highest ``ord`` holds, if they have one, then the greatest.
    """
    order = F.struct(*[F.col(c) for c in ("ord", "value") if c in updates.columns])
    new = updates.groupBy(key, "name").agg(F.max(order).getField("value").alias("new_value"))
    last = meta.groupBy(key).agg(F.max("ord").alias("last_ord"))
    joined = meta.join(new, [key, "name"], "full_outer").join(last, key, "left")
    place = F.coalesce("ord", F.coalesce("last_ord", F.lit(-1)) + 1)
    return joined.select(key, "name", F.coalesce("new_value", "value").alias("value"), place.cast("int").alias("ord"))


def remove_field(meta: DataFrame, cells: DataFrame, field: str, key: str = "cell_id") -> DataFrame:
    """Without the field for the entities of the set."""
    gone = cells.select(key).distinct().withColumn("name", F.lit(field))
    return meta.join(gone, [key, "name"], "left_anti")


def field_of(meta: DataFrame, cells: DataFrame, field: str, key: str = "cell_id") -> DataFrame:
    """The field's value for every entity of the set, the empty text where it is missing."""
    own = meta.filter(F.col("name") == field).select(key, "value")
    return cells.select(key).distinct().join(own, key, "left").select(key, F.coalesce("value", F.lit("")).alias("value"))


def histogram(meta: DataFrame, cells: DataFrame, field: str, key: str = "cell_id") -> DataFrame:
    """How often each value occurs, most frequent first, then by value."""
    return field_of(meta, cells, field, key).groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


def contingency(meta: DataFrame, cells: DataFrame, field0: str, field1: str, key: str = "cell_id") -> DataFrame:
    """Counts of value pairs, with totals of rows, columns and all where a value is null."""
    a = field_of(meta, cells, field0, key).withColumnRenamed("value", "value0")
    b = field_of(meta, cells, field1, key).withColumnRenamed("value", "value1")
    return a.join(b, key).cube("value0", "value1").agg(F.count(F.lit(1)).alias("n"))


def rand_index(meta: DataFrame, cells: DataFrame, field0: str, field1: str, key: str = "cell_id") -> DataFrame:
    """Rand and adjusted Rand index of the partitions by two fields, from the contingency table alone."""
    table = contingency(meta, cells, field0, field1, key)
    pairs = F.col("n").cast("double") * (F.col("n") - 1) / 2
    level = F.when(F.col("value0").isNull() & F.col("value1").isNull(), "d").when(F.col("value0").isNull(), "c").when(F.col("value1").isNull(), "b").otherwise("a")
    sums = table.select(level.alias("level"), pairs.alias("p")).agg(*[F.coalesce(F.sum(F.when(F.col("level") == k, F.col("p"))), F.lit(0.0)).alias(k) for k in "abcd"])
    four = sums.select("a", F.expr("b - a").alias("b"), F.expr("c - a").alias("c"), F.expr("d - b - c + a").alias("d"))
    n2, t = "(a + b + c + d)", "((a + b) * (a + c) + (c + d) * (b + d))"
    return four.select(F.expr(f"try_divide(a + d, {n2})").alias("rand_index"), F.expr(f"try_divide({n2} * (a + d) - {t}, {n2} * {n2} - {t})").alias("adjusted_rand_index"))


def pivot_fields(meta: DataFrame, cells: DataFrame, fields: list[str], key: str = "cell_id") -> DataFrame:
    """The named fields side by side for every entity of the set, empty where missing."""
    own = meta.filter(F.col("name").isin(fields))
    wide = own.groupBy(key).agg(*[F.max(F.when(F.col("name") == f, F.col("value"))).alias(f) for f in fields])
    return cells.select(key).distinct().join(wide, key, "left").na.fill("", fields)
