"""Relational operators that Spark has no ready form for, as compositions of DataFrame operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: str, left_at: str, right_at: str, columns: list[str], slices: int = 1) -> DataFrame:
    """left plus the columns of right's last row (same `by`) at or before left's time; null where there is none.

    Both sides are stacked and one window per key carries the last right row forward: one shuffle, no pairs. Of right
    rows at one time the largest by their columns counts. A null key or time finds nothing.

    slices: for keys with very many rows. Time is cut into so many stretches, at quantiles of all rows' times; a window is
    one key's rows of one stretch, and each stretch's last right row is handed on to the key's later ones: one row a key
    and stretch. Rows of one key at one time stay together.
    """
    taken = F.struct(*columns)
    l_rows = left.select(F.col(by).alias("__by"), F.col(left_at).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(right.select(taken.alias("r")).schema["r"].dataType).alias("__right"))
    r_rows = right.where(F.col(by).isNotNull() & F.col(right_at).isNotNull()).select(F.col(by).alias("__by"), F.col(right_at).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType).alias("__left"), taken.alias("__right"))
    stacked, keys = l_rows.unionByName(r_rows), ["__by"]
    if slices > 1:
        cuts = sorted({c for c in stacked.agg(F.percentile_approx("__at", [i / slices for i in range(1, slices)], 10_000)).first()[0] or () if c is not None})
        past = [F.when(F.col("__at") > F.lit(c), 1).otherwise(0) for c in cuts]
        stacked, keys = stacked.withColumn("__slice", reduce(lambda a, b: a + b, past, F.lit(0))), ["__by", "__slice"]
    before = Window.partitionBy(*keys).orderBy(F.col("__at").asc_nulls_first(), "__side", "__right").rowsBetween(Window.unboundedPreceding, 0)
    carried = stacked.withColumn("__last", F.last("__right", ignorenulls=True).over(before))
    if slices > 1:
        latest = F.max(F.when(F.col("__side") == 0, F.struct("__at", "__right")))
        handed = stacked.where("__by IS NOT NULL").groupBy(*keys).agg(latest.alias("__latest"))
        earlier = Window.partitionBy("__by").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
        handed = handed.select(*keys, F.last("__latest.__right", ignorenulls=True).over(earlier).alias("__earlier"))
        carried = carried.join(handed, keys, "left").withColumn("__last", F.coalesce("__last", "__earlier"))
    found = F.when(F.col("__by").isNotNull() & F.col("__at").isNotNull(), F.col("__last"))
    return carried.where("__side = 1").select("__left.*", *(found[c].alias(c) for c in columns))


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= point <= high: both sides fall into buckets of `width`, joined by equality, then filtered.

    An interval is copied into each bucket it touches, so width should be about the intervals' usual length.
    """
    bucket = lambda c: F.floor(c / F.lit(width))
    spread = right.where(F.col(low) <= F.col(high)).withColumn("__bucket", F.explode(F.sequence(bucket(F.col(low)), bucket(F.col(high)))))
    return left.withColumn("__bucket", bucket(F.col(point))).join(spread, "__bucket").where(F.col(point).between(F.col(low), F.col(high))).drop("__bucket")


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; pruned before the shuffle by the optimizer's group limit."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)
