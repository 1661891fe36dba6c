"""Arbitrary SQL per window, for all windows in one plan.

A query is written over `events`, as if one window were all there is. Lifting runs it as a lateral subquery of the table
of windows, with `events` defined inside as the window's rows; the optimizer turns the correlation into a join and groups
on the window, so there is no loop over windows. What the optimizer cannot decorrelate runs window by window.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

KEYS = ("window_start", "window_end")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@contextmanager
def views(spark: SparkSession, frames: dict[str, DataFrame]) -> Iterator[dict[str, str]]:
    """Names of temporary views of the frames, gone from the catalog afterwards; plans analysed meanwhile keep them."""
    mark = uuid4().hex
    made = {name: f"__lift_{k}_{mark}" for k, name in enumerate(frames)}
    try:
        for name, frame in frames.items():
            frame.createOrReplaceTempView(made[name])
        yield made
    finally:
        for view in made.values():
            spark.catalog.dropTempView(view)


def named_once(found: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """found with every name once: of a query's columns with one name the last counts; one named like a key gets a `_`."""
    names = [n + "_" if n in keys and i >= len(keys) else n for i, n in enumerate(found.columns)]
    last = {n: i for i, n in enumerate(names)}
    if len(last) == len(found.columns) and names == found.columns:
        return found
    places = [f"c{i}" for i in range(len(names))]
    placed = found.toDF(*places)
    return placed.select(*(placed[places[i]].alias(n) for n, i in sorted(last.items(), key=lambda x: x[1])))


def lifted(spark: SparkSession, windowed: DataFrame, query: str, references: dict[str, DataFrame] | None = None, most_windows: int = 1000, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The keys (window_start, window_end) and the query's columns, for every non-empty window of `windowed`.

    windowed: events with the keys, of which the query sees those that are not window_start and window_end. references
    are tables by name, which the query sees before views of the same name; no view is left in the catalog. Windows
    without events yield nothing, not even a count of zero. Of output columns with one name the last counts. The
    fallback for what cannot be decorrelated refuses more than most_windows windows.
    """
    own = ", ".join(quoted(c) for c in windowed.columns if c not in keys)
    given = references or {}
    with views(spark, {"": windowed, **given}) as view:
        same = " AND ".join(f"e.{quoted(k)} = w.{quoted(k)}" for k in keys)
        tables = "".join(f", {quoted(name)} AS (SELECT * FROM {view[name]})" for name in given)
        inner = f"WITH events AS (SELECT {own} FROM {view['']} e WHERE {same}){tables} SELECT * FROM ({query})"
        listed = ", ".join(quoted(k) for k in keys)
        windows = f"(SELECT DISTINCT {listed} FROM {view['']})"
        try:
            return named_once(spark.sql(f"SELECT {', '.join('w.' + quoted(k) for k in keys)}, q.* FROM {windows} w, LATERAL ({inner}) q"), keys)
        except AnalysisException as e:
            if "SUBQUERY" not in (e.getCondition() or ""):
                raise
    return window_by_window(spark, windowed, query, most_windows, given, keys)


def window_by_window(spark: SparkSession, windowed: DataFrame, query: str, most_windows: int = 1000, references: dict[str, DataFrame] | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The same result as a union of one query a window. windowed is read once a window: keep it stored or cached."""
    found = windowed.select(*keys).distinct().orderBy(*keys).limit(most_windows + 1).collect()
    if len(found) > most_windows:
        raise ValueError(f"the query needs a plan for each window, and there are more than {most_windows}")
    given, kinds = references or {}, {f.name: f.dataType.simpleString() for f in windowed.schema.fields}
    parts = []
    for w in found or [None]:
        rows = windowed.where(reduce(lambda a, b: a & b, (windowed[k].eqNullSafe(w[k]) for k in keys))) if w else windowed.limit(0)
        with views(spark, {"": rows.drop(*keys), **given}) as view:
            tables = "".join(f", {quoted(name)} AS (SELECT * FROM {view[name]})" for name in given)
            values = ", ".join(f"CAST(:k{i} AS {kinds[k]}) AS {quoted(k)}" for i, k in enumerate(keys))
            sql = f"WITH events AS (SELECT * FROM {view['']}){tables} SELECT {values}, q.* FROM ({query}) q"
            part = named_once(spark.sql(sql, {f"k{i}": w[k] if w else None for i, k in enumerate(keys)}), keys)
            parts.append(part if w else part.limit(0))
    return reduce(DataFrame.unionByName, parts)
