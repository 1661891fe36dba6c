"""CSV sources: bulk import, and replay with scaled time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.config import SourceSpec
from windrow.sources.ingest import SOURCE_FIELD
from windrow.types import time_pattern

# Field names of vessel-position files and the keys that imported messages use.
IMPORTED = {
    "Type of mobile": "typeOfMobile", "ROT": "rot", "COG": "cog", "Heading": "heading", "IMO": "imo", "Callsign": "callsign", "Ship type": "shipType", "Cargo type": "cargoType",
    "Width": "width", "Length": "length", "Type of position fixing device": "positionFixingDevice", "Draught": "draught", "Destination": "destination", "ETA": "eta", "Data source type": "dataSourceType",
    "A": "a", "B": "b", "C": "c", "D": "d",
}


def read_csv(spark: SparkSession, source: SourceSpec, path: str | None = None, multiline: bool = False) -> DataFrame:
    """The source's rows as strings, by header name. Only the delimiter's first character counts.

    Quotes are read lazily: one inside an unquoted field, or an undoubled one inside a quoted field, is a character like
    others; a quoted field ends with a quote before a delimiter or the line's end. A row with another number of fields
    stops the read. multiline: quoted fields may hold line ends, for which files cannot be split.
    """
    lazy = {"quote": '"', "escape": '"', "unescapedQuoteHandling": "STOP_AT_CLOSING_QUOTE", "multiLine": multiline}
    return spark.read.options(header=True, sep=source.csv_delimiter[0], mode="FAILFAST", inferSchema=False, **lazy).csv(path or source.csv_path)


def event_time(rows: DataFrame, source: SourceSpec) -> DataFrame:
    """rows plus ts; rows whose time does not parse are dropped."""
    return rows.withColumn("ts", F.try_to_timestamp(F.col(f"`{source.timestamp_field}`"), F.lit(time_pattern(source.timestamp_format)))).where("ts IS NOT NULL")


def as_messages(rows: DataFrame, source: SourceSpec, fields: list[str]) -> DataFrame:
    """raw: one flat JSON text a row, all values strings, nulls as empty strings, tagged with the source."""
    values = [F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")).alias(f) for f in fields]
    return rows.select(F.to_json(F.struct(*values, F.lit(source.name).alias(SOURCE_FIELD))).alias("raw"), "ts")


def import_csv(spark: SparkSession, source: SourceSpec, path: str | None = None) -> DataFrame:
    """Messages (raw, ts) of a bulk import, with the imported keys; byte-identical ones once."""
    rows = read_csv(spark, source, path).withColumnsRenamed(IMPORTED)
    fields = list(rows.columns)
    return as_messages(event_time(rows, source), source, fields).dropDuplicates(["raw"])


def scaled(rows: DataFrame, source: SourceSpec, start: int, first: int | None = None) -> DataFrame:
    """rows plus replay_ts: start + (event time - first event time) / scale_factor, at microseconds.

    first is the first row's event second; without it, the least event time is looked up.
    """
    if first is None:
        first = rows.agg(F.unix_micros(F.min("ts"))).first()[0] or 0
    else:
        first = first * 1_000_000
    shift = ((F.unix_micros("ts") - F.lit(first)) / F.lit(source.scale_factor)).cast("bigint")
    return rows.withColumn("replay_ts", F.timestamp_micros(F.lit(start * 1_000_000) + shift))


def replay_messages(spark: SparkSession, source: SourceSpec, start: int, path: str | None = None) -> DataFrame:
    """Messages of a replay in which the timestamp field is rewritten to the replay's time, at its own precision."""
    rows = read_csv(spark, source, path)
    fields = list(rows.columns)
    moved = scaled(event_time(rows, source), source, start)
    stamped = moved.withColumn(source.timestamp_field, F.date_format("replay_ts", time_pattern(source.timestamp_format)))
    return as_messages(stamped.drop("ts").withColumnRenamed("replay_ts", "ts"), source, fields)


def publish(messages: DataFrame, path: str, per_file: int = 10_000) -> None:
    """Messages as JSON lines in files of a bounded number, in the order of ts: what message_stream() reads. The reader's
    files_per_trigger then paces them."""
    messages.repartitionByRange("ts").sortWithinPartitions("ts").select("raw").write.mode("append").option("maxRecordsPerFile", per_file).text(path)
