"""Window assignment. Every mode adds window_start and window_end (epoch seconds) to rows that have `sec`.

Assignment is arithmetic on the row, so nothing is shuffled until a query groups by the window. An anchor, where a mode
has one, is the second at which windows begin (the first accepted event).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the polled modes: seconds of lateness, slide, and session gap.
LATENESS, SLIDE, GAP = 3, 60, 300


def anchor_of(events: DataFrame) -> int | None:
    """The first event's second: one value from the whole input; null for an empty one."""
    return events.agg(F.min("sec")).first()[0]


def _anchor(events: DataFrame, anchor: int | None) -> Column:
    found = anchor_of(events) if anchor is None else anchor
    return F.lit(found if found is not None else 0).cast("bigint")


def _assigned(events: DataFrame, starts: Column, size: int) -> DataFrame:
    """One row for each of an array of window starts."""
    return events.withColumn("window_start", F.explode(starts)).withColumn("window_end", F.col("window_start") + size)


def anchored_inclusive(events: DataFrame, size: int, anchor: int | None = None) -> DataFrame:
    """Tumbling from the anchor, both ends inclusive: an event on a boundary is in the window it ends and the one it begins."""
    t0 = _anchor(events, anchor)
    past = F.col("sec") - t0
    own = t0 + F.floor(past / size) * size
    both = F.when((past % size == 0) & (past > 0), F.array(own - size, own)).otherwise(F.array(own))
    return _assigned(events.where(F.col("sec") >= t0), both, size)


def half_open(events: DataFrame, size: int, anchor: int | None = None) -> DataFrame:
    """Tumbling from the anchor; the end is exclusive."""
    t0 = _anchor(events, anchor)
    start = t0 + F.floor((F.col("sec") - t0) / size) * size
    return events.where(F.col("sec") >= t0).withColumn("window_start", start).withColumn("window_end", F.col("window_start") + size)


def epoch_aligned(events: DataFrame, size: int) -> DataFrame:
    """Tumbling from the epoch; the end is exclusive."""
    start = F.floor(F.col("sec") / size) * size
    return events.withColumn("window_start", start).withColumn("window_end", F.col("window_start") + size)


def sliding(events: DataFrame, size: int, slide: int = SLIDE, anchor: int | None = None) -> DataFrame:
    """Windows of `size` every `slide` seconds, the first at the anchor; a slide above the size leaves gaps."""
    t0 = _anchor(events, anchor)
    past = F.col("sec") - t0
    low = F.greatest(F.floor((past - size) / slide) + 1, F.lit(0).cast("bigint"))
    high = F.floor(past / slide)
    starts = F.when(low <= high, F.transform(F.sequence(low, high), lambda k: t0 + k * slide))
    return _assigned(events.where(F.col("sec") >= t0), starts, size)


def sessions(events: DataFrame, key: str, gap: int = GAP) -> DataFrame:
    """(key, window_start, window_end, events): an entity's events merge while they are at most `gap` seconds apart.

    A session ends with its last event. Null keys are no entity.
    """
    at = F.timestamp_seconds("sec")
    grouped = events.where(F.col(key).isNotNull()).groupBy(key, F.session_window(at, f"{gap} seconds"))
    return grouped.agg(F.min("sec").alias("window_start"), F.max("sec").alias("window_end"), F.count("*").alias("events")).drop("session_window")


def session_windows(events: DataFrame, key: str, gap: int = GAP) -> DataFrame:
    """events plus entity (the key as a string) and the window of the event's session; rows with a null key are left out.

    Sessions follow from an entity's distinct seconds, which are gathered before they are ordered: an entity with very
    many events costs one row a second there, and its events are joined back by entity and second.
    """
    own = events.where(F.col(key).isNotNull()).withColumn("entity", F.col(key).cast("string"))
    seconds = own.select("entity", "sec").distinct()
    in_order = Window.partitionBy("entity").orderBy("sec")
    begins = F.coalesce(F.col("sec") - F.lag("sec").over(in_order) > gap, F.lit(True))
    numbered = seconds.withColumn("__begins", begins.cast("int")).withColumn("__session", F.sum("__begins").over(in_order))
    one = Window.partitionBy("entity", "__session")
    bounds = numbered.select("entity", "sec", F.min("sec").over(one).alias("window_start"), F.max("sec").over(one).alias("window_end"))
    return own.join(bounds, ["entity", "sec"])


def closed(windowed: DataFrame, now: int | Column, lateness: int = 0) -> DataFrame:
    """Windows that have fired: time, less the lateness, is past their end."""
    return windowed.where(F.col("window_end") < F.lit(now) - lateness)


def nonempty_windows(windowed: DataFrame) -> DataFrame:
    """(window_start, window_end, events) of the windows that hold any."""
    return windowed.groupBy("window_start", "window_end").agg(F.count("*").alias("events"))


def clock(sec: Column) -> Column:
    """A second of the epoch as HH:MM:SS, in UTC whatever the session's time zone."""
    part = lambda size, wrap: F.lpad(F.pmod(F.floor(sec / size), F.lit(wrap)).cast("string"), 2, "0")
    return F.concat_ws(":", part(3600, 24), part(60, 60), part(1, 60))


def retained(events: DataFrame, window_end: int, size: int) -> DataFrame:
    """What stays buffered after the window that ended at window_end has fired: later than two sizes before it."""
    return events.where(F.col("sec") > window_end - 2 * size)


def retained_for(events: DataFrame, pending_starts: DataFrame) -> DataFrame:
    """What stays buffered for a source's queries: from the earliest pending start on (one row a query)."""
    least = pending_starts.agg(F.min("window_start").alias("__least"))
    return events.join(F.broadcast(least), F.col("sec") >= F.col("__least"), "left_semi")
