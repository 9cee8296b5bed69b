"""Top N items within every group by simultaneous bisection.

No group is ever gathered or sorted. Every row gets an order-preserving code
made of its score and its identifier; per group, a dyadic interval of codes that
holds the cutoff is refined for all groups at once by counting rows above the
midpoints of the interval, until each group keeps exactly N rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countgrid.session import Scratch

#: Bits of a code settled per pass; a pass counts at 2**BITS - 1 midpoints of every open interval.
BITS = 8
#: Rows beyond which a group is spread over several join keys.
HOT_ROWS = 500_000
#: At most this many groups count as hot, which bounds the broadcast of their keys.
MOST_HOT = 10_000
_LOW = -(2**63)


@F.pandas_udf(T.LongType())
def _ordered_bits(values: pd.Series) -> pd.Series:
    """Signed 64-bit integers in the order of the doubles; -0.0 equals 0.0, NaN is null."""
    x = values.to_numpy(np.float64) + 0.0
    bits = x.view(np.int64)
    code = np.where(bits >= 0, bits, bits ^ np.int64(0x7FFFFFFFFFFFFFFF))
    return pd.Series(code, dtype="Int64").mask(np.isnan(x))


def _span_bits(low: str, high: str) -> Column:
    """How many low bits differ between two codes (0 to 64)."""
    x = F.expr(f"{low} ^ {high}")
    return F.when(x == 0, F.lit(0)).when(x < 0, F.lit(64)).otherwise(F.length(F.bin(x)))


def top_n_per_group(
    df: DataFrame,
    group: list[str],
    score: str,
    item: str,
    n: int | str,
    *,
    bits: int = BITS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Rows of ``df`` that are among the first ``n`` of their group.

    The order is ``score`` descending, then ``item`` (an integer column)
    ascending. ``n`` is a number or the name of a column that is constant within
    a group. Defined results for odd input:

    * rows whose score is null or NaN, or whose item or ``n`` is null, are no
      items; a null group key is a group of its own;
    * rows equal in group, score and item are one item sent several times: one
      of them is returned (columns besides group, score and item come from the
      smallest such row);
    * ``n`` of 0 or less keeps nothing; an empty table gives an empty result;
    * further columns pass through unchanged, whatever their names.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "topn")
    keys = [f"_g{i}" for i in range(len(group))]
    extra = [c for c in df.columns if c not in {*group, score, item}]
    # NULL group keys join and group like values once they carry a flag of their own.
    rows = df.select(
        *[F.struct(F.col(f"`{c}`").isNull().alias("null"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias("v")).alias(k) if dict(df.dtypes)[c] not in _PLAIN else F.coalesce(F.col(f"`{c}`").cast("bigint"), F.lit(_LOW)).alias(k) for c, k in zip(group, keys)],
        F.struct(*[F.col(f"`{c}`") for c in group]).alias("_group"),
        F.col(f"`{score}`").alias("_score"),
        F.col(f"`{item}`").alias("_item"),
        (F.lit(n) if isinstance(n, int) else F.col(f"`{n}`")).cast("bigint").alias("_n"),
        *([F.struct(*[F.col(f"`{c}`") for c in extra]).alias("_extra")] if extra else []),
    )
    rows = rows.withColumn("_hi", _ordered_bits(F.col("_score").cast("double"))).withColumn("_lo", F.expr("~cast(_item as bigint)"))
    rows = rows.filter("_hi IS NOT NULL AND _lo IS NOT NULL AND _n > 0")
    # Maps have no order; among their rows any one is returned.
    smallest = F.first if extra and "map<" in dict(rows.dtypes)["_extra"] else F.min
    # One row per item: the key is as fine as the data, so no group meets in one task here.
    rows = scratch.keep(
        rows.groupBy(*keys, "_hi", "_lo").agg(F.first("_group").alias("_group"), F.first("_score").alias("_score"), F.first("_item").alias("_item"), F.max("_n").alias("_n"), *([smallest("_extra").alias("_extra")] if extra else []))
    )

    sizes = scratch.keep(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.max("_n").alias("_need"), F.min("_hi").alias("_min"), F.max("_hi").alias("_max")))
    small = sizes.filter("_rows <= _need").select(*keys, F.lit(_LOW).alias("_cut_hi"), F.lit(_LOW).alias("_cut_lo"))
    total = sizes.agg(F.sum("_rows")).first()[0] or 0
    hot_from = max(hot_rows, total // MOST_HOT + 1)
    hot = sizes.filter((F.col("_rows") > hot_from) & (F.col("_rows") > F.col("_need"))).select(*keys, F.expr(f"cast(ceil(_rows / {hot_from}) as int)").alias("_salts"))
    any_hot = not hot.isEmpty()

    def salted(side: DataFrame, copies: bool) -> DataFrame:
        """Spreads the rows of hot groups over salts, or copies a group's state to each of them."""
        if not any_hot:
            return side.withColumn("_salt", F.lit(0))
        side = side.join(F.broadcast(hot), keys, "left")  # at most MOST_HOT rows
        salt = F.explode(F.expr("sequence(0, coalesce(_salts, 1) - 1)")) if copies else F.expr("cast(pmod(xxhash64(_lo), coalesce(_salts, 1)) as int)")
        return side.withColumn("_salt", salt).drop("_salts")

    # An open interval: the codes that agree with _low above the lowest _span bits.
    state = sizes.filter("_rows > _need").select(*keys, "_need", F.lit(0).alias("_level"), _span_bits("_min", "_max").cast("int").alias("_span"), F.col("_min").alias("_low"), F.lit(0).cast("bigint").alias("_score_code"))
    cuts = [small]
    live, decided = salted(rows.select(*keys, "_hi", "_lo"), False), None
    while not state.isEmpty():
        step = F.expr(f"greatest(_span - {bits}, 0)")
        inside = live.join(salted(state, True), [*keys, "_salt"]).filter("_level = 0 OR _hi = _score_code")
        inside = inside.withColumn("_code", F.expr("CASE WHEN _level = 0 THEN _hi ELSE _lo END"))
        inside = inside.filter("_span >= 64 OR shiftrightunsigned(_code ^ _low, _span) = 0")
        # Only rows of open intervals stay alive; the rest is decided.
        inside = scratch.keep(inside.select(*keys, "_hi", "_lo", "_salt", "_code", F.call_function("shiftright", "_code", step).alias("_bucket")))
        if decided is not None:
            scratch.drop(decided)
        decided = inside
        counts = inside.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_count"), *[f(c).alias(f"_{n}{c}") for c in ("_code", "_lo") for n, f in (("min", F.min), ("max", F.max))])
        live = inside.drop("_code", "_bucket")
        order = Window.partitionBy(*keys).orderBy(F.desc("_bucket"))  # at most 2**bits rows a group
        counts = counts.withColumn("_above", F.sum("_count").over(order) - F.col("_count"))
        crossing = scratch.keep(counts.join(state, keys).filter("_above < _need AND _above + _count >= _need"))
        settled = "(_min_code = _max_code AND _level = 0)"
        done = crossing.filter("_above + _count = _need")
        cuts.append(done.select(*keys, F.expr("CASE WHEN _level = 0 THEN _min_code ELSE _score_code END").alias("_cut_hi"), F.expr(f"CASE WHEN _level = 0 THEN {_LOW} ELSE _min_code END").alias("_cut_lo")))
        # The next interval is the smallest dyadic one around the rows of the crossing bucket;
        # where they all tie in score, it is one of identifiers among them.
        state = crossing.filter("_above + _count > _need").select(
            *keys,
            F.expr("_need - _above").alias("_need"),
            F.expr(f"CASE WHEN {settled} THEN 1 ELSE _level END").alias("_level"),
            F.when(F.expr(settled), _span_bits("_min_lo", "_max_lo")).otherwise(_span_bits("_min_code", "_max_code")).cast("int").alias("_span"),
            F.expr(f"CASE WHEN {settled} THEN _min_lo ELSE _min_code END").alias("_low"),
            F.expr(f"CASE WHEN {settled} THEN _min_code ELSE _score_code END").alias("_score_code"),
        )
    cut = cuts[0]
    for more in cuts[1:]:
        cut = cut.unionByName(more)
    cut = scratch.keep(cut)
    kept = salted(rows, False).join(salted(cut, True), [*keys, "_salt"]).filter("_hi > _cut_hi OR (_hi = _cut_hi AND _lo >= _cut_lo)")
    back = {c: F.col(f"_group.`{c}`") for c in group} | {score: F.col("_score"), item: F.col("_item")} | {c: F.col(f"_extra.`{c}`") for c in extra}
    return kept.select(*[back[c].alias(c) for c in df.columns])


_PLAIN = {"tinyint", "smallint", "int"}
