"""Entity-attribute-value rows into one wide row per entity with typed columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countgrid.functions.values import SPARK_TYPES, field_key, typed
from countgrid.session import Scratch, shuffle_partitions

#: Attributes pivoted in one aggregation, on average.
BLOCK_COLUMNS = 100


def latest_values(rows: DataFrame, entity: str, name: str, value: str, order: list[str]) -> DataFrame:
    """One row per entity and field: the one highest in ``order``.

    Partial aggregation reduces repeated and corrected rows before the shuffle,
    whose key is as fine as entity and field, so a hot entity is spread out.
    Ties in ``order`` go to the greatest value, null last.
    """
    last = F.max(F.struct(*[F.col(f"`{c}`") for c in order], F.col(f"`{value}`").alias("_value")))
    keyed = rows.filter(F.col(f"`{entity}`").isNotNull() & F.col(f"`{name}`").isNotNull())
    keyed = keyed.groupBy(F.col(f"`{entity}`").alias("entity_id"), field_key(F.col(f"`{name}`")).alias("field")).agg(last.alias("_last"))
    return keyed.select("entity_id", "field", F.col("_last._value").alias("value"))


def wide_name(field: str) -> str:
    """The wide column of a field; only a field named like the key gets another name."""
    return field if field != "entity_id" else "entity_id (field)"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def pivot_wide(
    rows: DataFrame,
    types: dict[str, str],
    entity: str = "cell_id",
    name: str = "meta_name",
    value: str = "meta_value",
    order: tuple[str, ...] = ("loaded_at", "ord"),
    block_columns: int = BLOCK_COLUMNS,
    partitions: int | None = None,
) -> tuple[DataFrame, dict[str, str]]:
    """The wide table (``entity_id`` and one typed column per field) and the fields' types.

    The fields are dealt by hash to blocks of about ``block_columns``. The current values are
    written once, in one folder a block. Each block's rows are then moved once, to the same hash
    partitioning of the entity, and pivoted there; the blocks join to the entities on that
    partitioning without another shuffle. Every row is read and shuffled once per step however
    many blocks there are, and no aggregation is wider than a block.

    Only the list of distinct field names comes to the driver, as it is the
    schema of the result. ``types`` maps fields, in lower case and without blanks
    at the ends, to ``string``, ``integer``, ``decimal``, ``boolean`` or ``date``;
    others are strings.

    Defined results for odd input: rows with a null entity or null field name
    are left out; an entity of which no value is readable keeps a row of nulls;
    an empty table gives an empty table with the entity column only; a field
    named ``entity_id`` becomes the column ``entity_id (field)``; integers of
    more than 38 digits are null; columns of ``rows`` not named are ignored.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "pivot")
    n = partitions or shuffle_partitions(spark)
    key = field_key(F.col(f"`{name}`"))
    fields = sorted(r[0] for r in rows.filter(F.col(f"`{entity}`").isNotNull() & key.isNotNull()).select(key).distinct().collect())
    kinds = {f: types.get(f, "string") for f in fields}
    count = max(1, -(-len(fields) // block_columns))
    block = F.pmod(F.xxhash64("field"), F.lit(count)).cast("int").alias("block")
    latest = scratch.keep(latest_values(rows, entity, name, value, list(order)).select("entity_id", "field", "value", block), "block")
    blocks: dict[int, list[str]] = {}
    for field, number in spark.createDataFrame([(f,) for f in fields], "field string").select("field", block).collect():
        blocks.setdefault(number, []).append(field)

    def pivoted(number: int) -> DataFrame:
        own = latest.filter(F.col("block") == number).repartition(n, "entity_id")
        cells = [F.max(F.when(F.col("field") == f, typed(F.col("value"), kinds[f]))).cast(SPARK_TYPES[kinds[f]]).alias(wide_name(f)) for f in blocks[number]]
        return own.groupBy("entity_id").agg(*cells)

    # Left joins keep the partitioning of the left side; a full outer join would lose it.
    ids = latest.select("entity_id").repartition(n, "entity_id").distinct()
    wide = reduce(lambda a, b: a.join(b, "entity_id", "left"), map(pivoted, sorted(blocks)), ids)
    return wide.select("entity_id", *[F.col(quoted(wide_name(f))) for f in fields]), kinds
