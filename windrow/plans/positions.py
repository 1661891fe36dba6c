"""The configured queries over vessel positions, as plans over all windows at once.

`positions` has event_id, mmsi, name, ship_type, sog, lon, lat, nav_status, sec. Each query takes windowed positions (see
operators.windows) and returns window_start, window_end and its columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windrow.functions.spatial import near_zones
from windrow.sources.ingest import reference_frame
from windrow.config import RefTable

KEYS = ("window_start", "window_end")


def event_second(ts: Column) -> Column:
    """Epoch second of a timestamp without zone, whatever the session's time zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts).cast("bigint")


def positions(events: DataFrame) -> DataFrame:
    """A synthetic position view of the events table: integer and IEEE arithmetic only; every 97th has no latitude."""
    n = F.col("event_id")
    return events.select(
        "event_id",
        F.col("user_id").cast("string").alias("mmsi"),
        F.concat(F.lit("V"), F.col("user_id").cast("string")).alias("name"),
        F.col("event_type").alias("ship_type"),
        F.col("value").alias("sog"),
        (F.lit(7.0) + (n * 104729 % 95000).cast("double") / F.lit(10000.0)).alias("lon"),
        F.when(n % 97 != 0, F.lit(54.0) + (n * 7919 % 50000).cast("double") / F.lit(10000.0)).alias("lat"),
        F.when(F.col("event_type") == "view", "At anchor").when(F.col("event_type") == "error", "Moored").otherwise("Under way").alias("nav_status"),
        event_second(F.col("ts")).alias("sec"),
    )


def valid(rows: DataFrame) -> DataFrame:
    """Positions with the required coordinates."""
    return rows.where("lat IS NOT NULL AND lon IS NOT NULL")


def rounded(x: Column, digits: int) -> Column:
    """Half up, on the binary double, for values that are not negative: the same in every engine."""
    scale = F.lit(float(10**digits))
    return F.floor(x * scale + F.lit(0.5)) / scale


def vessel_count(windowed: DataFrame) -> DataFrame:
    return windowed.groupBy(*KEYS).agg(F.count_distinct("mmsi").alias("vessel_count"))


def stationary_vessels(windowed: DataFrame) -> DataFrame:
    """Windows with events, none of which is stationary, count 0."""
    return windowed.groupBy(*KEYS).agg(F.count_if(F.col("nav_status").isin("At anchor", "Moored")).alias("stationary_count"))


def avg_speed_by_type(windowed: DataFrame) -> DataFrame:
    speeds = windowed.where("sog IS NOT NULL").groupBy(*KEYS, "ship_type")
    mean = F.sum(F.col("sog").cast("decimal(18,6)")).cast("double") / F.count("*")
    return speeds.agg(rounded(mean, 2).alias("avg_speed"))


def wind_exclusion_zone(windowed: DataFrame) -> DataFrame:
    inside = F.col("lat").between(55.5, 56.0) & F.col("lon").between(7.5, 8.0) & F.col("sog").isNotNull() & (F.col("sog") > 0.5)
    return windowed.where(inside).select(*KEYS, "event_id", "name", "mmsi", "lat", "lon", "sog")


def kattegat_knn(windowed: DataFrame, k: int = 5) -> DataFrame:
    """The k nearest positions of each window by planar distance in degrees; ties by event_id."""
    away = F.sqrt(F.pow(F.col("lat") - 57.25, 2) + F.pow(F.col("lon") - 10.25, 2))
    near = windowed.where("lat IS NOT NULL").withColumn("approx_distance", rounded(away, 4))
    order = Window.partitionBy(*KEYS).orderBy("approx_distance", "event_id")
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select(*KEYS, "place", "event_id", "mmsi", "approx_distance")


def zones(spark: SparkSession) -> DataFrame:
    """The hazard zones of the example configuration."""
    box = lambda x0, x1, y0, y1: f"POLYGON(({x0} {y0}, {x1} {y0}, {x1} {y1}, {x0} {y1}, {x0} {y0}))"
    # Names, bounds and thresholds.
    rows = [
        {"zone_name": "Subsea Pipeline Corridor Kattegat", "geom_wkt": box(10.0, 10.5, 57.0, 57.5), "threshold_nm": 2.0},
        {"zone_name": "Offshore Wind Exclusion North Sea", "geom_wkt": box(7.5, 8.0, 55.5, 56.0), "threshold_nm": 2.0},
        {"zone_name": "Restricted Zone Skagerrak", "geom_wkt": box(10.5, 11.0, 58.0, 58.5), "threshold_nm": 2.0},
        {"zone_name": "Military Exercise Area Bornholm", "geom_wkt": box(15.5, 16.0, 55.5, 56.0), "threshold_nm": 3.0},
    ]
    return reference_frame(spark, RefTable("zones", {"zone_name": "VARCHAR", "geom_wkt": "VARCHAR", "threshold_nm": "DOUBLE"}, rows))


def hazard_zones(windowed: DataFrame, zone_table: DataFrame, axis_order: str = "authority") -> DataFrame:
    found = near_zones(windowed, zone_table, "lon", "lat", axis_order=axis_order)
    return found.select(*KEYS, "event_id", "mmsi", "name", "sog", "nav_status", "zone_name", "threshold_nm", rounded(F.col("distance_nm"), 2).alias("distance_nm"))
