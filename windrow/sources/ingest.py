"""From raw messages to the typed `events` relation of a source."""

from __future__ import annotations

from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from windrow.config import RefTable, SourceSpec
from windrow.types import spark_type, time_pattern

SOURCE_FIELD = "_source"


def decode_push(messages: DataFrame, value: str = "value") -> DataFrame:
    """raw: the JSON inside a push envelope {"message": {"data": base64}}; null where there is none."""
    data = F.try_to_binary(F.get_json_object(F.col(value), "$.message.data"), F.lit("base64"))
    return messages.withColumn("raw", F.decode(data, "UTF-8"))


def parse_messages(messages: DataFrame, sources: dict[str, SourceSpec], raw: str = "raw") -> DataFrame:
    """raw, fields (map of strings), source, ts, sec, reason: every message, with the reason it is dropped for, if any.

    reason: 'not JSON', 'unknown source', 'bad time', or null. sec is the event time's epoch second, in the session's
    time zone, as the source's layout gives it. Byte-identical messages are one event: see distinct_messages.
    """
    fields = F.from_json(F.col(raw), "map<string,string>")
    parsed = messages.select(F.col(raw).alias("raw"), fields.alias("fields"))
    source = F.col("fields")[SOURCE_FIELD]
    ts: Column = F.lit(None).cast("timestamp")
    for s in sources.values():
        ts = F.when(F.col("source") == s.name, F.try_to_timestamp(F.col("fields")[s.timestamp_field], F.lit(time_pattern(s.timestamp_format)))).otherwise(ts)
    known = F.col("source").isin(*sources) if sources else F.lit(False)
    out = parsed.withColumn("source", source).withColumn("ts", ts)
    reason = F.when(F.col("fields").isNull(), "not JSON").when(F.col("source").isNull() | ~known, "unknown source").when(F.col("ts").isNull(), "bad time")
    return out.withColumn("sec", F.unix_timestamp("ts")).withColumn("reason", reason)


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason IS NULL").drop("reason")


def drop_counts(parsed: DataFrame) -> DataFrame:
    """reason, messages: how many messages went which way ('accepted' for those that stayed)."""
    return parsed.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("messages"))


def observed(parsed: DataFrame, observation: Observation | str) -> DataFrame:
    """parsed, counting as it passes: messages, accepted, and the dropped of each reason. A name instead of an
    observation makes the counts part of a streaming query's progress."""
    kinds = {"not_json": "not JSON", "unknown_source": "unknown source", "bad_time": "bad time"}
    counts = [F.count_if(F.col("reason") == reason).alias(name) for name, reason in kinds.items()]
    return parsed.observe(observation, F.count("*").alias("messages"), F.count_if(F.col("reason").isNull()).alias("accepted"), *counts)


def distinct_messages(events: DataFrame) -> DataFrame:
    """One event for byte-identical messages of a source. On a stream with a watermark on ts, within the watermark.

    message, a digest of raw, stands for raw where events have been logged without it.
    """
    keys = [*(["source"] if "source" in events.columns else []), "message" if "message" in events.columns else "raw"]
    return events.dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def present(value: Column) -> Column:
    return value.isNotNull() & (value != "")


def cast_field(value: Column, kind: T.DataType, strict: bool = False) -> Column:
    """A field's text as a type; empty text is null. A malformed value is null, or an error if strict."""
    value = F.when(value != "", value)
    if isinstance(kind, T.StringType):
        return value
    return value.cast(kind) if strict else value.try_cast(kind)


def typed_events(events: DataFrame, source: SourceSpec, strict: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """The `events` relation: the source's columns by name, then ts and sec; before them the columns of keep as they are.

    Rows without a value in a required field are dropped before anything is cast; unknown fields are not read.
    """
    field = lambda c: F.col("fields")[c.from_field]
    rows = events.where(F.col("source") == source.name)
    for c in source.columns.values():
        if c.required:
            rows = rows.where(present(field(c)))
    own = [cast_field(field(source.columns[n]), spark_type(source.columns[n].type), strict).alias(n) for n in sorted(source.columns)]
    return rows.select(*keep, *own, *(x for x in ("ts", "sec") if x not in source.columns))


def reference_frame(spark: SparkSession, ref: RefTable) -> DataFrame:
    """A reference table's inline rows, as a relation whose size the planner knows.

    What it is joined with may grow: the reference is the small side of the plan, and is broadcast up to Spark's threshold.
    """
    schema = T.StructType([T.StructField(n, spark_type(t)) for n, t in ref.columns.items()])
    made = lambda v, f: float(v) if v is not None and isinstance(f.dataType, (T.DoubleType, T.FloatType)) else str(v) if v is not None and isinstance(f.dataType, T.StringType) else v
    rows = [[made(r[f.name], f) for r in ref.rows] for f in schema]
    kinds = to_arrow_schema(schema)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(rows, kinds, strict=True)], schema=kinds), schema)


def ordered(events: DataFrame, *ties: str) -> DataFrame:
    """Events by second, then by the columns of `ties` (raw, where it is there): the order of a range read."""
    return events.orderBy("sec", *(ties or [c for c in ("raw", "message") if c in events.columns]))


def window_scan(events: DataFrame, start: int, end: int, stored: str | None = None) -> DataFrame:
    """Events whose second lies in one window, both ends inclusive.

    stored: a timestamp column that the files hold. A bound on a computed second stays above the scan, so the same bounds
    are stated on that column too: files and row groups outside the window are not read.
    """
    if stored:
        kind = events.schema[stored].dataType
        at = (lambda s: F.timestamp_seconds(F.lit(s))) if isinstance(kind, T.TimestampType) else (lambda s: F.lit(datetime.fromtimestamp(s, UTC).replace(tzinfo=None)).cast(kind))
        events = events.where((F.col(stored) >= at(start)) & (F.col(stored) < at(end + 1)))
    return events.where(F.col("sec").between(start, end))


def store_events(events: DataFrame, path: str, hours: int = 24, mode: str = "append") -> None:
    """Events (with source and sec) laid out for window reads: a folder for each source and period of so many hours, files
    of narrow ranges of seconds inside.

    Ranges are cut by the seconds that are there, so a busy period is written by many tasks. Rows without source or second
    lie in no window: they are left out.
    """
    placed = events.where("source IS NOT NULL AND sec IS NOT NULL").withColumn("period", _period(F.col("sec"), hours))
    placed.repartitionByRange("source", "sec").sortWithinPartitions("source", "sec").write.mode(mode).partitionBy("source", "period").parquet(path)


def stored_events(spark: SparkSession, path: str, start: int, end: int, sources: list[str] | None = None, hours: int = 24) -> DataFrame:
    """Events of one window, both ends inclusive, from what store_events() has written with the same hours.

    Folders of other periods and sources are not listed for reading; sec is a stored column, so its bounds reach files and
    row groups.
    """
    rows = spark.read.parquet(path).where(F.col("period").between(start // (hours * 3600) * hours * 3600, end))
    if sources is not None:
        rows = rows.where(F.col("source").isin(sources))
    return window_scan(rows, start, end).drop("period")


def _period(sec: Column, hours: int) -> Column:
    return (F.floor(sec / (hours * 3600)) * (hours * 3600)).cast("bigint")
