"""Registered queries of the library and the SQL to hold them against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windrow.config import ColumnSpec, QuerySpec, SourceSpec
from windrow.functions.alerts import alerts
from windrow.functions.spatial import near_zones, register
from windrow.operators import panes, relational, sinks
from windrow.operators import windows as win
from windrow.plans import positions as plans
from windrow.plans.lift import lifted
from windrow.sources import ingest, replay

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

HOUR, DAY = 3600, 86400

#: SQL for the position view and for its windows.
POSITIONS = """pos AS (SELECT event_id, CAST(user_id AS VARCHAR) AS mmsi, 'V' || CAST(user_id AS VARCHAR) AS name, event_type AS ship_type, value AS sog,
    7e0 + CAST((event_id * 104729) % 95000 AS DOUBLE) / 10000e0 AS lon, CASE WHEN event_id % 97 <> 0 THEN 54e0 + CAST((event_id * 7919) % 50000 AS DOUBLE) / 10000e0 END AS lat,
    CASE event_type WHEN 'view' THEN 'At anchor' WHEN 'error' THEN 'Moored' ELSE 'Under way' END AS nav_status, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events),
valid AS (SELECT * FROM pos WHERE lat IS NOT NULL), t0 AS (SELECT min(sec) AS t0 FROM valid)"""


def inclusive_sql(size: int) -> str:
    return f"""{POSITIONS}, w AS (SELECT valid.*, t0 + (sec - t0) // {size} * {size} AS window_start FROM valid, t0
    UNION ALL SELECT valid.*, sec - {size} FROM valid, t0 WHERE (sec - t0) % {size} = 0 AND sec > t0), win AS (SELECT *, window_start + {size} AS window_end FROM w)"""


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def valid_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.valid(plans.positions(read(spark, sf_dir, "events")))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.anchored_inclusive(valid_positions(spark, sf_dir), HOUR)


# --- windows and the configured queries -----------------------------------------------------------------------------


@query(f"WITH {inclusive_sql(HOUR)} SELECT window_start, window_end, count(DISTINCT mmsi) AS vessel_count FROM win GROUP BY ALL")
def vessel_count_tumbling(spark, sf_dir):
    return plans.vessel_count(hourly(spark, sf_dir))


@query(f"WITH {POSITIONS} SELECT sec // 30 * 30 AS window_start, sec // 30 * 30 + 30 AS window_end, count(DISTINCT mmsi) AS vessel_count FROM valid GROUP BY ALL")
def vessel_count_epoch30s(spark, sf_dir):
    return plans.vessel_count(win.epoch_aligned(valid_positions(spark, sf_dir), 30))


@query(f"WITH {inclusive_sql(HOUR)} SELECT window_start, window_end, count(*) FILTER (nav_status IN ('At anchor', 'Moored')) AS stationary_count FROM win GROUP BY ALL")
def stationary_vessels(spark, sf_dir):
    return plans.stationary_vessels(hourly(spark, sf_dir))


@query(f"""WITH {inclusive_sql(HOUR)} SELECT window_start, window_end, ship_type,
    floor(CAST(sum(CAST(sog AS DECIMAL(18,6))) AS DOUBLE) / count(*) * 100e0 + 0.5e0) / 100e0 AS avg_speed FROM win WHERE sog IS NOT NULL GROUP BY ALL""")
def avg_speed_by_type(spark, sf_dir):
    return plans.avg_speed_by_type(hourly(spark, sf_dir))


@query(f"WITH {inclusive_sql(HOUR)} SELECT window_start, window_end, event_id, name, mmsi, lat, lon, sog FROM win WHERE lat BETWEEN 55.5e0 AND 56e0 AND lon BETWEEN 7.5e0 AND 8e0 AND sog > 0.5e0")
def wind_exclusion_zone(spark, sf_dir):
    return plans.wind_exclusion_zone(hourly(spark, sf_dir))


@query(f"""WITH {inclusive_sql(HOUR)}, d AS (SELECT *, floor(sqrt(power(lat - 57.25e0, 2) + power(lon - 10.25e0, 2)) * 10000e0 + 0.5e0) / 10000e0 AS approx_distance FROM win),
    r AS (SELECT *, row_number() OVER (PARTITION BY window_start, window_end ORDER BY approx_distance, event_id) AS place FROM d)
    SELECT window_start, window_end, CAST(place AS INT) AS place, event_id, mmsi, approx_distance FROM r WHERE place <= 5""")
def kattegat_knn(spark, sf_dir):
    return plans.kattegat_knn(hourly(spark, sf_dir))


def hazard_sql(axis_order: str) -> str:
    """Zones are rectangles along the axes, so the distance to one is that to its nearest corner or side."""
    lon, lat = ("lat", "lon") if axis_order == "authority" else ("lon", "lat")
    mx = lambda v: f"6378137e0 * radians({v})"
    my = lambda v: f"6378137e0 * ln(tan(0.7853981633974483e0 + radians({v}) / 2))"
    x0, x1, y0, y1 = ("y0", "y1", "x0", "x1") if axis_order == "authority" else ("x0", "x1", "y0", "y1")
    # Names, bounds and thresholds of the zones.
    return f"""{inclusive_sql(HOUR)}, z(zone_name, x0, x1, y0, y1, threshold_nm) AS (VALUES ('Subsea Pipeline Corridor Kattegat', 10.0e0, 10.5e0, 57.0e0, 57.5e0, 2e0),
    ('Offshore Wind Exclusion North Sea', 7.5e0, 8.0e0, 55.5e0, 56.0e0, 2e0), ('Restricted Zone Skagerrak', 10.5e0, 11.0e0, 58.0e0, 58.5e0, 2e0), ('Military Exercise Area Bornholm', 15.5e0, 16.0e0, 55.5e0, 56.0e0, 3e0)),
    pr AS (SELECT win.*, z.zone_name, z.threshold_nm, sqrt(power(greatest({mx('z.' + x0)} - {mx(lon)}, 0, {mx(lon)} - {mx('z.' + x1)}), 2) + power(greatest({my('z.' + y0)} - {my(lat)}, 0, {my(lat)} - {my('z.' + y1)}), 2)) / 1852e0 AS d FROM win, z),
    haz AS (SELECT window_start, window_end, event_id, mmsi, name, sog, nav_status, zone_name, threshold_nm, floor(d * 100e0 + 0.5e0) / 100e0 AS distance_nm FROM pr WHERE d < threshold_nm)"""


@query(f"WITH {hazard_sql('authority')} SELECT * FROM haz")
def hazard_zones_authority(spark, sf_dir):
    return plans.hazard_zones(hourly(spark, sf_dir), plans.zones(spark), "authority")


@query(f"WITH {hazard_sql('xy')} SELECT * FROM haz")
def hazard_zones_xy(spark, sf_dir):
    return plans.hazard_zones(hourly(spark, sf_dir), plans.zones(spark), "xy")


@query(f"""WITH {hazard_sql('xy')} SELECT window_start, event_id, mmsi || ' (' || name || ') — ' || CAST(CAST(round(distance_nm * 100) AS BIGINT) AS VARCHAR) || ' cnm from "' || zone_name || '" | status=' || nav_status AS alert FROM haz""")
def hazard_alert_lines(spark, sf_dir):
    found = plans.hazard_zones(hourly(spark, sf_dir), plans.zones(spark), "xy").withColumn("distance_cnm", F.round(F.col("distance_nm") * 100).cast("bigint"))
    return alerts(found, '{mmsi} ({name}) — {distance_cnm} cnm from "{zone_name}" | status={nav_status}').select("window_start", "event_id", "alert")


# Every customer has a rectangle; distances are to the nearest corner or side, in Mercator metres.
ZONES_OF_CUSTOMERS = """z AS (SELECT c_custkey AS zone_id, 7e0 + CAST((c_custkey * 7919) % 9500 AS DOUBLE) / 1000e0 AS x0, 54e0 + CAST((c_custkey * 104729) % 5000 AS DOUBLE) / 1000e0 AS y0,
    CAST(1 + c_custkey % 20 AS DOUBLE) / 100e0 AS wide, CAST(1 + c_custkey % 7 AS DOUBLE) / 50e0 AS high, CAST(1 + c_custkey % 4 AS DOUBLE) / 2e0 AS threshold_nm FROM customer)"""
_PROJECTED = {"px": "6378137e0 * radians(lon)", "py": "6378137e0 * ln(tan(0.7853981633974483e0 + radians(lat) / 2))", "zx0": "6378137e0 * radians(x0)", "zx1": "6378137e0 * radians(x0 + wide)", "zy0": "6378137e0 * ln(tan(0.7853981633974483e0 + radians(y0) / 2))", "zy1": "6378137e0 * ln(tan(0.7853981633974483e0 + radians(y0 + high) / 2))"}


def customer_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """zone_id, geom_wkt, threshold_nm: a rectangle for every customer."""
    k, number = F.col("c_custkey"), lambda c: c.cast("double")
    x0, y0 = F.lit(7.0) + number(k * 7919 % 9500) / 1000, F.lit(54.0) + number(k * 104729 % 5000) / 1000
    placed = read(spark, sf_dir, "customer").select(k.alias("zone_id"), x0.alias("x0"), y0.alias("y0"), (x0 + number(1 + k % 20) / 100).alias("x1"), (y0 + number(1 + k % 7) / 50).alias("y1"), (number(1 + k % 4) / 2).alias("threshold_nm"))
    corner = lambda x, y: F.concat_ws(" ", F.col(x).cast("string"), F.col(y).cast("string"))
    ring = F.concat_ws(", ", corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"), corner("x0", "y0"))
    return placed.select("zone_id", F.concat(F.lit("POLYGON(("), ring, F.lit("))")).alias("geom_wkt"), "threshold_nm")


@query(f"""WITH {POSITIONS}, {ZONES_OF_CUSTOMERS}, p AS (SELECT event_id, {_PROJECTED['px']} AS px, {_PROJECTED['py']} AS py FROM valid),
    g AS (SELECT zone_id, threshold_nm, {', '.join(f'{v} AS {k}' for k, v in _PROJECTED.items() if k[0] == 'z')} FROM z),
    d AS (SELECT event_id, zone_id, sqrt(power(greatest(zx0 - px, 0, px - zx1), 2) + power(greatest(zy0 - py, 0, py - zy1), 2)) / 1852e0 AS d, threshold_nm FROM p, g)
    SELECT event_id, zone_id, floor(d * 100e0 + 0.5e0) / 100e0 AS distance_nm FROM d WHERE d < threshold_nm""")
def zones_by_cells(spark, sf_dir):
    found = near_zones(valid_positions(spark, sf_dir).select("event_id", "lon", "lat"), customer_zones(spark, sf_dir), "lon", "lat", axis_order="xy")
    return found.select("event_id", "zone_id", plans.rounded(F.col("distance_nm"), 2).alias("distance_nm"))


@query(f"""WITH {POSITIONS}, k AS (SELECT valid.*, t0, unnest(range(greatest(CAST(floor((sec - t0 - 7200) / 3600.0) AS BIGINT) + 1, 0), (sec - t0) // 3600 + 1)) AS i FROM valid, t0)
    SELECT t0 + i * 3600 AS window_start, t0 + i * 3600 + 7200 AS window_end, count(*) AS events FROM k GROUP BY ALL""")
def sliding_count(spark, sf_dir):
    return win.nonempty_windows(win.sliding(valid_positions(spark, sf_dir), 2 * HOUR, HOUR))


@query(f"WITH {POSITIONS} SELECT t0 + (sec - t0) // 60 * 60 AS window_start, t0 + (sec - t0) // 60 * 60 + 30 AS window_end, count(*) AS events FROM valid, t0 WHERE (sec - t0) % 60 < 30 GROUP BY ALL")
def sliding_gap_count(spark, sf_dir):
    return win.nonempty_windows(win.sliding(valid_positions(spark, sf_dir), 30, 60))


SLIDING_HOURS = f"""{POSITIONS}, k AS (SELECT valid.*, t0, unnest(range(greatest(CAST(floor((sec - t0 - 21600) / 3600.0) AS BIGINT) + 1, 0), (sec - t0) // 3600 + 1)) AS i FROM valid, t0),
    s AS (SELECT *, t0 + i * 3600 AS window_start, t0 + i * 3600 + 21600 AS window_end FROM k)"""


@query(f"""WITH {SLIDING_HOURS} SELECT window_start, window_end, ship_type, count(*) AS events, min(sog) AS slowest, max(sog) AS fastest,
    CAST(sum(CAST(sog AS DECIMAL(18,6))) AS DOUBLE) / count(sog) AS mean_speed FROM s GROUP BY ALL""")
def sliding_by_panes(spark, sf_dir):
    speed = F.col("sog")
    aggregates = {"events": panes.count(), "slowest": panes.least(speed), "fastest": panes.most(speed), "mean_speed": panes.mean(speed.cast("decimal(18,6)"))}
    return panes.sliding_aggregate(valid_positions(spark, sf_dir), 6 * HOUR, HOUR, aggregates, ("ship_type",))


@query(f"WITH {SLIDING_HOURS} SELECT window_start, window_end, count(DISTINCT mmsi) AS vessels, true AS within FROM s GROUP BY ALL")
def sliding_distinct_sketch(spark, sf_dir):
    """Exact counts, and whether the sketches' estimates lie within four standard errors of them."""
    rows = valid_positions(spark, sf_dir)
    anchor = win.anchor_of(rows) or 0
    exact = win.sliding(rows.select("mmsi", (F.floor((F.col("sec") - anchor) / HOUR) * HOUR + anchor).alias("sec")).distinct(), 6 * HOUR, HOUR, anchor).groupBy("window_start", "window_end").agg(F.count_distinct("mmsi").alias("vessels"))
    about = panes.sliding_aggregate(rows, 6 * HOUR, HOUR, {"about": panes.distinct(F.col("mmsi"))}, anchor=anchor)
    near = F.abs(F.col("about") - F.col("vessels")) <= 4 * 1.04 / 2 ** (panes.HLL_LOG / 2) * F.col("vessels") + 1
    return exact.join(about, ["window_start", "window_end"]).select("window_start", "window_end", "vessels", near.alias("within"))


@query("SELECT l_returnflag, count(l_quantity) AS n, true AS within FROM lineitem GROUP BY l_returnflag")
def quantile_sketch(spark, sf_dir):
    """Whether the values that partial sketches give for some ranks lie at those ranks, exactly counted, within 3 %."""
    rows, ranks = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity"), (0.1, 0.5, 0.9)
    spec = panes.quantiles(F.col("l_extendedprice"), ranks)
    about = rows.groupBy("l_returnflag").agg(spec.partial[0].alias("sketch")).select("l_returnflag", spec.final(F.col("sketch")).alias("at"))
    below = [F.count_if(F.col("l_extendedprice") < F.col("at")[i]).alias(f"b{i}") for i in range(3)]
    upto = [F.count_if(F.col("l_extendedprice") <= F.col("at")[i]).alias(f"u{i}") for i in range(3)]
    counted = rows.join(F.broadcast(about), "l_returnflag").groupBy("l_returnflag").agg(F.count("l_quantity").alias("n"), *below, *upto)
    near = [(F.col(f"b{i}") / F.col("n") <= r + 0.03) & (F.col(f"u{i}") / F.col("n") >= r - 0.03) for i, r in enumerate(ranks)]
    return counted.select("l_returnflag", "n", (near[0] & near[1] & near[2]).alias("within"))


def session_sql(gap: int) -> str:
    return f"""WITH {POSITIONS}, l AS (SELECT mmsi, sec, CASE WHEN sec - lag(sec) OVER (PARTITION BY mmsi ORDER BY sec) <= {gap} THEN 0 ELSE 1 END AS fresh FROM valid),
    s AS (SELECT mmsi, sec, sum(fresh) OVER (PARTITION BY mmsi ORDER BY sec ROWS UNBOUNDED PRECEDING) AS k FROM l)
    SELECT mmsi, min(sec) AS window_start, max(sec) AS window_end, count(*) AS events FROM s GROUP BY mmsi, k"""


@query(session_sql(300))
def sessions_300s(spark, sf_dir):
    return win.sessions(valid_positions(spark, sf_dir), "mmsi", 300)


@query(session_sql(6 * HOUR))
def sessions_6h(spark, sf_dir):
    return win.sessions(valid_positions(spark, sf_dir), "mmsi", 6 * HOUR)


@query(f"WITH {POSITIONS}, m AS (SELECT max(sec) - 3 AS now FROM valid) SELECT t0 + (sec - t0) // 3600 * 3600 AS window_start, t0 + (sec - t0) // 3600 * 3600 + 3600 AS window_end, count(*) AS events FROM valid, t0, m WHERE t0 + (sec - t0) // 3600 * 3600 + 3600 < now GROUP BY ALL")
def polled_nonempty_windows(spark, sf_dir):
    rows = valid_positions(spark, sf_dir)
    now = rows.agg(F.max("sec")).first()[0]
    return win.nonempty_windows(win.closed(win.half_open(rows, HOUR), now, win.LATENESS))


@query(f"WITH {POSITIONS}, m AS (SELECT t0 + (max(sec) - t0) // 3600 * 3600 AS e FROM valid, t0 GROUP BY t0) SELECT event_id, sec FROM valid, m WHERE sec > e - 7200")
def retention_boundary(spark, sf_dir):
    rows = valid_positions(spark, sf_dir)
    first, last = rows.agg(F.min("sec"), F.max("sec")).first()
    return win.retained(rows, first + (last - first) // HOUR * HOUR, HOUR).select("event_id", "sec")


@query(f"WITH {POSITIONS}, q(name, window_start) AS (SELECT 'a', max(sec) - 7200 FROM valid UNION ALL SELECT 'b', max(sec) - 86400 FROM valid) SELECT event_id, sec FROM valid WHERE sec >= (SELECT min(window_start) FROM q)")
def retention_by_pending_start(spark, sf_dir):
    rows = valid_positions(spark, sf_dir)
    last = rows.agg(F.max("sec").alias("last"))
    starts = last.select(F.explode(F.array(F.col("last") - 7200, F.col("last") - DAY)).alias("window_start"))
    return win.retained_for(rows, starts).select("event_id", "sec")


@query(f"WITH {POSITIONS} SELECT event_id, sec FROM valid, t0 WHERE sec BETWEEN t0 + 3600 AND t0 + 7200")
def window_range_scan(spark, sf_dir):
    start = win.anchor_of(valid_positions(spark, sf_dir))
    events = read(spark, sf_dir, "events").withColumn("sec", plans.event_second(F.col("ts")))
    own = ingest.window_scan(events, start + HOUR, start + 2 * HOUR, "ts").drop("sec")
    return plans.valid(plans.positions(own)).select("event_id", "sec")


@query(f"""WITH {inclusive_sql(HOUR)} SELECT window_start, strftime(make_timestamp(window_start * 1000000), '%H:%M:%S') AS opens, strftime(make_timestamp(window_end * 1000000), '%H:%M:%S') AS closes, event_id,
    CAST(row_number() OVER (PARTITION BY window_start ORDER BY sec, event_id) AS INT) AS place FROM win""")
def ordered_window_read(spark, sf_dir):
    """Every window's events in the order of a range read: by second, ties by id; and its bounds as times of day."""
    in_order = Window.partitionBy("window_start").orderBy("sec", "event_id")
    return hourly(spark, sf_dir).select("window_start", win.clock(F.col("window_start")).alias("opens"), win.clock(F.col("window_end")).alias("closes"), "event_id", F.row_number().over(in_order).alias("place"))


# --- ingest ---------------------------------------------------------------------------------------------------------

SOURCE = SourceSpec(
    "positions",
    {c.name: c for c in (ColumnSpec("mmsi", "MMSI"), ColumnSpec("Latitude", "Latitude", "DOUBLE", True), ColumnSpec("SOG", "SOG", "DOUBLE"), ColumnSpec("event_id", "id", "BIGINT", True))},
    id_field="MMSI",
    timestamp_field="# Timestamp",
    timestamp_format="02/01/2006 15:04:05",
    lat_field="Latitude",
    lon_field="Longitude",
    scale_factor=4.0,
)


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a flat JSON message; some without latitude, time, source, or as no JSON; every 50th twice."""
    rows = read(spark, sf_dir, "events")
    n = F.col("event_id")
    stamp = F.when(n % 41 == 0, "soon").otherwise(F.date_format("ts", "dd/MM/yyyy HH:mm:ss"))
    fields = F.struct(
        F.when(n % 53 == 0, "elsewhere").otherwise("positions").alias("_source"),
        stamp.alias("# Timestamp"),
        F.col("user_id").cast("string").alias("MMSI"),
        F.when(n % 97 == 0, "").otherwise((n % 90).cast("string")).alias("Latitude"),
        F.when(n % 31 == 0, "fast").otherwise((n % 25).cast("string")).alias("SOG"),
        n.cast("string").alias("id"),
    )
    raw = F.when(n % 61 == 0, F.concat(F.lit("no json "), n.cast("string"))).otherwise(F.to_json(fields))
    return rows.select(F.explode(F.array_repeat(raw, F.when(n % 50 == 0, 2).otherwise(1))).alias("raw"))


def parsed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.parse_messages(raw_messages(spark, sf_dir), {"positions": SOURCE})


MESSAGES = """m AS (SELECT *, CASE WHEN event_id % 61 = 0 THEN 'not JSON' WHEN event_id % 53 = 0 THEN 'unknown source' WHEN event_id % 41 = 0 THEN 'bad time' ELSE 'accepted' END AS reason,
    CASE WHEN event_id % 50 = 0 THEN 2 ELSE 1 END AS copies FROM events)"""


@query(f"WITH {MESSAGES} SELECT reason, CAST(sum(copies) AS BIGINT) AS messages FROM m GROUP BY reason")
def bad_message_drops(spark, sf_dir):
    return ingest.drop_counts(parsed_messages(spark, sf_dir))


@query(f"WITH {MESSAGES} SELECT CAST(count(*) AS BIGINT) AS events, CAST(sum(epoch(ts)::BIGINT) AS BIGINT) AS seconds FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM m WHERE reason = 'accepted')")
def dedup_payload(spark, sf_dir):
    kept = ingest.distinct_messages(ingest.accepted(parsed_messages(spark, sf_dir)))
    second = plans.event_second(F.to_timestamp_ntz(F.col("fields")["# Timestamp"], F.lit("dd/MM/yyyy HH:mm:ss")))
    return kept.agg(F.count("*").alias("events"), F.sum(second).alias("seconds"))


@query(f"WITH {MESSAGES} SELECT event_id, CAST(event_id % 90 AS DOUBLE) AS Latitude, CASE WHEN event_id % 31 <> 0 THEN CAST(event_id % 25 AS DOUBLE) END AS SOG, CAST(user_id AS VARCHAR) AS mmsi FROM m WHERE reason = 'accepted' AND event_id % 97 <> 0")
def required_cast_rename(spark, sf_dir):
    kept = ingest.distinct_messages(ingest.accepted(parsed_messages(spark, sf_dir)))
    return ingest.typed_events(kept, SOURCE).drop("ts", "sec")


@query("SELECT event_id, props AS payload FROM events")
def push_envelope_decode(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    envelope = F.to_json(F.struct(F.struct(F.base64(F.col("props").cast("binary")).alias("data")).alias("message")))
    return ingest.decode_push(rows.select("event_id", envelope.alias("value"))).select("event_id", F.col("raw").alias("payload"))


@query("SELECT coalesce(json_extract_string(props, '$.k'), '') AS k, coalesce(json_extract_string(props, '$.none'), '') AS missing, count(*) AS n FROM events GROUP BY ALL")
def json_defaults(spark, sf_dir):
    fields = F.from_json("props", "map<string,string>")
    rows = read(spark, sf_dir, "events").select(F.coalesce(fields["k"], F.lit("")).alias("k"), F.coalesce(fields["none"], F.lit("")).alias("missing"))
    return rows.groupBy("k", "missing").agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // 4 + 1700000000000000 AS BIGINT) AS replay_us FROM events")
def replay_scaled(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return replay.scaled(rows, SOURCE, 1_700_000_000).select("event_id", F.unix_micros("replay_ts").alias("replay_us"))


# --- SQL over windows, results --------------------------------------------------------------------------------------


def lifted_query(spark: SparkSession, sf_dir: str, sql: str, size: int = DAY) -> DataFrame:
    return lifted(spark, win.anchored_inclusive(valid_positions(spark, sf_dir), size), sql, {"zones": plans.zones(spark)})


LIFTED = {
    "distinct": ("SELECT DISTINCT ship_type, nav_status FROM events", "SELECT DISTINCT window_start, window_end, ship_type, nav_status FROM win"),
    "count_distinct": ("SELECT COUNT(DISTINCT mmsi) AS vessels, COUNT(*) AS n FROM events", "SELECT window_start, window_end, count(DISTINCT mmsi) AS vessels, count(*) AS n FROM win GROUP BY ALL"),
    "topk": ("SELECT event_id, sog FROM events ORDER BY sog DESC, event_id LIMIT 3", "SELECT window_start, window_end, event_id, sog FROM win QUALIFY row_number() OVER (PARTITION BY window_start ORDER BY sog DESC, event_id) <= 3"),
    "union": (
        "SELECT mmsi FROM events WHERE sog > 100 UNION SELECT mmsi FROM events WHERE ship_type = 'error'",
        "SELECT window_start, window_end, mmsi FROM win WHERE sog > 100 UNION SELECT window_start, window_end, mmsi FROM win WHERE ship_type = 'error'",
    ),
    "selfjoin": (
        "SELECT a.event_id AS first, b.event_id AS second FROM events a JOIN events b ON a.mmsi = b.mmsi AND a.sec < b.sec AND a.ship_type = 'signup' AND b.ship_type = 'purchase'",
        "SELECT a.window_start, a.window_end, a.event_id AS first, b.event_id AS second FROM win a JOIN win b ON a.window_start = b.window_start AND a.mmsi = b.mmsi AND a.sec < b.sec AND a.ship_type = 'signup' AND b.ship_type = 'purchase'",
    ),
    "having_cte": (
        "WITH t AS (SELECT ship_type, COUNT(*) AS n FROM events GROUP BY ship_type HAVING COUNT(*) > 2) SELECT ship_type, n, RANK() OVER (ORDER BY n DESC) AS place FROM t",
        "SELECT window_start, window_end, ship_type, n, CAST(rank() OVER (PARTITION BY window_start ORDER BY n DESC) AS INT) AS place FROM (SELECT window_start, window_end, ship_type, count(*) AS n FROM win GROUP BY ALL HAVING count(*) > 2)",
    ),
    "rollup_fallback": ("SELECT ship_type, COUNT(*) AS n FROM events GROUP BY ROLLUP (ship_type)", "SELECT window_start, window_end, ship_type, count(*) AS n FROM win GROUP BY GROUPING SETS ((window_start, window_end, ship_type), (window_start, window_end))"),
}
for _name, (_query, _oracle) in LIFTED.items():
    query(f"WITH {inclusive_sql(DAY)} {_oracle}", f"lifted_{_name}")(lambda spark, sf_dir, q=_query: lifted_query(spark, sf_dir, q))


@query(f"WITH {hazard_sql('xy').replace(str(HOUR), str(DAY))} SELECT window_start, window_end, event_id, zone_name, distance_nm FROM haz")
def lifted_spatial_sql(spark, sf_dir):
    register(spark, "xy", zone_texts(spark))
    return lifted_query(
        spark,
        sf_dir,
        """SELECT v.event_id, z.zone_name, floor(ST_Distance(ST_Transform(ST_Point(v.lon, v.lat), 'EPSG:4326', 'EPSG:3857'), ST_Transform(ST_GeomFromText(z.geom_wkt), 'EPSG:4326', 'EPSG:3857')) / 1852.0 * 100e0 + 0.5e0) / 100e0 AS distance_nm
           FROM events v CROSS JOIN zones z WHERE v.lat IS NOT NULL
           AND ST_Distance(ST_Transform(ST_Point(v.lon, v.lat), 'EPSG:4326', 'EPSG:3857'), ST_Transform(ST_GeomFromText(z.geom_wkt), 'EPSG:4326', 'EPSG:3857')) / 1852.0 < z.threshold_nm""",
    )


def zone_texts(spark):
    return [r.geom_wkt for r in plans.zones(spark).collect()]


# Fixed value: the active query of the example configuration, word for word.
HAZARD_QUERY = "SELECT v.MMSI AS mmsi, v.Name AS name, v.SOG AS sog, v.NavigationalStatus AS navigationalStatus, v.Timestamp AS timestamp, z.zone_name, z.threshold_nm, ROUND(ST_Distance(ST_Transform(ST_Point(v.Longitude, v.Latitude), 'EPSG:4326', 'EPSG:3857'), ST_Transform(ST_GeomFromText(z.geom_wkt), 'EPSG:4326', 'EPSG:3857')) / 1852.0, 2) AS distance_nm FROM events v CROSS JOIN zones z WHERE v.Latitude IS NOT NULL AND ST_Distance(ST_Transform(ST_Point(v.Longitude, v.Latitude), 'EPSG:4326', 'EPSG:3857'), ST_Transform(ST_GeomFromText(z.geom_wkt), 'EPSG:4326', 'EPSG:3857')) / 1852.0 < z.threshold_nm ORDER BY distance_nm"


@query(f"""WITH {hazard_sql('authority').replace(str(HOUR), str(DAY))} SELECT window_start, window_end, mmsi, name, sog, nav_status AS "navigationalStatus", CAST(sec AS VARCHAR) AS timestamp,
    zone_name, threshold_nm, round(d, 2) AS distance_nm FROM pr WHERE d < threshold_nm""")
def configured_hazard_query(spark, sf_dir):
    register(spark, "authority", zone_texts(spark))
    names = {"mmsi": "MMSI", "name": "Name", "sog": "SOG", "nav_status": "NavigationalStatus", "lat": "Latitude", "lon": "Longitude"}
    windowed = win.anchored_inclusive(valid_positions(spark, sf_dir), DAY)
    events = windowed.select("window_start", "window_end", *(F.col(a).alias(b) for a, b in names.items()), F.col("sec").cast("string").alias("Timestamp"))
    return lifted(spark, events, HAZARD_QUERY, {"zones": plans.zones(spark)})


@query(f"WITH {inclusive_sql(DAY)} SELECT window_start, window_end, mmsi AS id, max(lat) AS north FROM win GROUP BY ALL")
def generic_template(spark, sf_dir):
    columns = {c.name: c for c in (ColumnSpec("mmsi", "MMSI"), ColumnSpec("lat", "Latitude", "DOUBLE"), ColumnSpec("lon", "Longitude", "DOUBLE"))}
    source = SourceSpec("positions", columns, id_field="MMSI", timestamp_field="# Timestamp", lat_field="Latitude", lon_field="Longitude")
    spec = QuerySpec("north", "SELECT {id_field} AS id, MAX({lat_field}) AS north FROM events GROUP BY {id_field}", DAY, data_source="generic")
    return lifted_query(spark, sf_dir, spec.text(source))


@query(f"WITH {inclusive_sql(DAY)} SELECT window_start, window_end, 'vessel_count' AS query, 'aggregate' AS return_type, CAST(1 AS INT) AS n_results, count(DISTINCT mmsi) AS vessel_count FROM win GROUP BY ALL")
def result_document(spark, sf_dir):
    counted = plans.vessel_count(win.anchored_inclusive(valid_positions(spark, sf_dir), DAY))
    documents = sinks.result_documents(counted, "vessel_count", "aggregate")
    return documents.select("window_start", "window_end", "query", "return_type", F.size("results").alias("n_results"), F.col("results")[0]["vessel_count"].alias("vessel_count"))


# --- joins ----------------------------------------------------------------------------------------------------------

MONEY = "decimal(18,2)"


def money(c: str):
    return F.sum(F.col(c).cast(MONEY)).cast("double")


@query("SELECT n_name, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_inner(spark, sf_dir):
    orders, customer, nation = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    return joined.groupBy("n_name").agg(F.count("*").alias("orders"), money("o_totalprice").alias("total"))


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
def join_left(spark, sf_dir):
    orders, customer = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), read(spark, sf_dir, "customer")
    return customer.join(orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@query("SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000")
def join_right(spark, sf_dir):
    supplier, nation = read(spark, sf_dir, "supplier").where("s_acctbal > 5000"), read(spark, sf_dir, "nation")
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "right").select("s_suppkey", "n_name")


@query("SELECT a.nation, b.nation AS supplier_nation, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS nation, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS nation, count(*) AS n FROM supplier WHERE s_acctbal > 9000 GROUP BY 1) b ON a.nation = b.nation")
def join_full(spark, sf_dir):
    a = read(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    b = read(spark, sf_dir, "supplier").where("s_acctbal > 9000").groupBy(F.col("s_nationkey").alias("supplier_nation")).agg(F.count("*").alias("suppliers"))
    return a.join(b, a.nation == b.supplier_nation, "full")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_semi(spark, sf_dir):
    large = read(spark, sf_dir, "orders").where("o_totalprice > 300000")
    return read(spark, sf_dir, "customer").join(large, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, sf_dir):
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("WITH z(band, lo, hi) AS (VALUES ('low', 0e0, 99.5e0), ('mid', 50e0, 200e0), ('high', 150e0, 1000e0)) SELECT band, count(*) AS n FROM events JOIN z ON value BETWEEN lo AND hi GROUP BY band")
def join_range(spark, sf_dir):
    bands = spark.createDataFrame([("low", 0.0, 99.5), ("mid", 50.0, 200.0), ("high", 150.0, 1000.0)], "band string, lo double, hi double")
    return relational.range_join(read(spark, sf_dir, "events").select("value"), bands, "value", "lo", "hi", 50.0).groupBy("band").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT * FROM events WHERE event_type = 'view')
    SELECT p.event_id, v.event_id AS seen_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def join_asof(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("seen_id"))
    return relational.asof_join(bought, seen, "user_id", "ts", "ts", ["seen_id"]).select("event_id", "seen_id")


@query("""WITH s AS (SELECT event_id, ts, event_type = 'purchase' AS bought, CASE WHEN event_type = 'view' THEN event_id END AS seen FROM events WHERE event_type IN ('purchase', 'view')),
    c AS (SELECT *, last_value(seen IGNORE NULLS) OVER (ORDER BY ts, bought, seen ROWS UNBOUNDED PRECEDING) AS seen_id FROM s) SELECT event_id, seen_id FROM c WHERE bought""")
def join_asof_one_key(spark, sf_dir):
    """The last view by anybody before each purchase: one key, cut into stretches of time."""
    events = read(spark, sf_dir, "events").withColumn("site", F.lit(1))
    bought = events.where("event_type = 'purchase'").select("event_id", "site", "ts")
    seen = events.where("event_type = 'view'").select("site", "ts", F.col("event_id").alias("seen_id"))
    return relational.asof_join(bought, seen, "site", "ts", "ts", ["seen_id"], slices=16).select("event_id", "seen_id")


@query("SELECT r_name, t.n_name FROM region r, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r.r_regionkey ORDER BY n_name LIMIT 2) t")
def join_lateral(spark, sf_dir):
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    first = nation.where(F.col("n_regionkey") == F.col("r_regionkey").outer()).orderBy("n_name").limit(2).select("n_name")
    return region.lateralJoin(first).select("r_name", "n_name")


@query("SELECT count(*) AS n, CAST(sum(s_suppkey * r_regionkey) AS BIGINT) AS mix FROM supplier, region")
def join_cross(spark, sf_dir):
    pairs = read(spark, sf_dir, "supplier").crossJoin(F.broadcast(read(spark, sf_dir, "region")))
    return pairs.agg(F.count("*").alias("n"), F.sum(F.col("s_suppkey") * F.col("r_regionkey")).alias("mix"))


# --- aggregates -----------------------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price,
    count(*) AS n, min(l_discount) AS least, max(l_tax) AS most, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_qty FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def agg_pricing_summary(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02 00:00:00").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        money("l_quantity").alias("sum_qty"), money("l_extendedprice").alias("sum_price"), F.count("*").alias("n"), F.min("l_discount").alias("least"), F.max("l_tax").alias("most"), (money("l_quantity") / F.count("*")).alias("avg_qty")
    )


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(*) FILTER (value > 100) AS large, arg_max(event_id, event_id) AS last_id FROM events GROUP BY event_type")
def agg_distinct_filter_argmax(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_if(F.col("value") > 100).alias("large"), F.max_by("event_id", "event_id").alias("last_id"))


@query("SELECT l_returnflag, floor(stddev_samp(l_quantity) * 1000 + 0.5) / 1000 AS spread, median(l_quantity) AS middle, quantile_cont(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag")
def agg_spread_quantiles(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(plans.rounded(F.stddev_samp("l_quantity"), 3).alias("spread"), F.median("l_quantity").alias("middle"), F.percentile("l_quantity", 0.9).alias("p90"))


def grouping_sql(sets: str) -> str:
    return f"SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY {sets}"


@query(grouping_sql("ROLLUP (l_returnflag, l_linestatus)"))
def agg_rollup(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query(grouping_sql("CUBE (l_returnflag, l_linestatus)"))
def agg_cube(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query(grouping_sql("GROUPING SETS ((l_returnflag), (l_linestatus))"))
def agg_grouping_sets(spark, sf_dir):
    a, b = F.col("l_returnflag"), F.col("l_linestatus")
    return read(spark, sf_dir, "lineitem").groupingSets([[a], [b]], a, b).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("SELECT o_custkey, count(*) AS orders FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def agg_having(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders")).where("orders > 12")


# --- analytic windows, order, sets ----------------------------------------------------------------------------------


@query("""SELECT event_id, row_number() OVER w AS n, lag(event_id) OVER w AS before, lead(event_id, 2) OVER w AS after, ntile(4) OVER w AS quarter, first_value(event_id) OVER w AS first_id,
    count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS near FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def win_rank_frames(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.row_number().over(w).cast("bigint").alias("n"),
        F.lag("event_id").over(w).alias("before"),
        F.lead("event_id", 2).over(w).alias("after"),
        F.ntile(4).over(w).cast("bigint").alias("quarter"),
        F.first("event_id").over(w).alias("first_id"),
        F.count("*").over(w.rowsBetween(-3, 0)).alias("near"),
    )


@query("SELECT p_partkey, CAST(rank() OVER w AS BIGINT) AS place, CAST(dense_rank() OVER w AS BIGINT) AS dense, percent_rank() OVER w AS share, cume_dist() OVER w AS upto FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)")
def win_distribution(spark, sf_dir):
    w = Window.partitionBy("p_brand").orderBy("p_size")
    return read(spark, sf_dir, "part").select("p_partkey", F.rank().over(w).cast("bigint").alias("place"), F.dense_rank().over(w).cast("bigint").alias("dense"), F.percent_rank().over(w).alias("share"), F.cume_dist().over(w).alias("upto"))


@query("SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS last_day FROM events")
def win_range_frame(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("sec", plans.event_second(F.col("ts")))
    return rows.select("user_id", "event_id", F.count("*").over(Window.partitionBy("user_id").orderBy("sec").rangeBetween(-DAY, 0)).alias("last_day"))


@query("SELECT c_mktsegment, c_custkey, c_acctbal, place FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) WHERE place <= 3")
def order_topk(spark, sf_dir):
    found = relational.top_k(read(spark, sf_dir, "customer"), ["c_mktsegment"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3)
    return found.select("c_mktsegment", "c_custkey", "c_acctbal", F.col("place").cast("bigint").alias("place"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def order_limit_offset(spark, sf_dir):
    return read(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(10).select("o_orderkey", "o_totalprice")


def set_sql(op: str) -> str:
    return f"SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9500 {op} SELECT s_nationkey FROM supplier WHERE s_acctbal > 0"


def set_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = read(spark, sf_dir, "customer").where("c_acctbal > 9500").select(F.col("c_nationkey").alias("k"))
    return a, read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("k"))


for _op, _run in {"union all": lambda a, b: a.union(b), "union": lambda a, b: a.union(b).distinct(), "intersect": lambda a, b: a.intersect(b), "except": lambda a, b: a.subtract(b), "intersect all": lambda a, b: a.intersectAll(b), "except all": lambda a, b: a.exceptAll(b)}.items():
    query(set_sql(_op.upper()), f"set_{_op.replace(' ', '_')}")(lambda spark, sf_dir, f=_run: f(*set_sides(spark, sf_dir)))


# --- scalar functions -----------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, upper(p_name) AS up, length(p_name) AS n, substring(p_name, 2, 4) AS part, replace(p_type, ' ', '_') AS flat, p_name LIKE '%a%' AS has_a, regexp_matches(p_brand, '[0-9]+$') AS ends_digit,
    split_part(p_type, ' ', 1) AS head, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, concat_ws('-', p_brand, CAST(p_size AS VARCHAR)) AS code, trim('  ' || p_brand || ' ') AS trimmed FROM part""")
def fn_string(spark, sf_dir):
    c = F.col
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.upper("p_name").alias("up"), F.length("p_name").cast("bigint").alias("n"), F.substring("p_name", 2, 4).alias("part"), F.replace(c("p_type"), F.lit(" "), F.lit("_")).alias("flat"), c("p_name").like("%a%").alias("has_a"),
        c("p_brand").rlike("[0-9]+$").alias("ends_digit"), F.split_part(c("p_type"), F.lit(" "), F.lit(1)).alias("head"), F.lpad(c("p_size").cast("string"), 4, "0").alias("padded"), F.concat_ws("-", "p_brand", c("p_size").cast("string")).alias("code"), F.trim(F.concat(F.lit("  "), c("p_brand"), F.lit(" "))).alias("trimmed"),
    )


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q, CAST(dayofyear(o_orderdate) AS INT) AS doy, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start,
    CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INT) AS days, strftime(o_orderdate, '%d/%m/%Y') AS written, CAST(last_day(o_orderdate) AS DATE) AS month_end FROM orders""")
def fn_date(spark, sf_dir):
    d = F.col("o_orderdate")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", F.year(d).alias("y"), F.quarter(d).alias("q"), F.dayofyear(d).alias("doy"), F.trunc(d.cast("date"), "month").alias("month_start"), F.date_diff(d.cast("date"), F.lit("1992-01-01").cast("date")).alias("days"), F.date_format(d, "dd/MM/yyyy").alias("written"), F.last_day(d.cast("date")).alias("month_end")
    )


@query("""SELECT event_id, abs(event_id - 500) AS away, event_id % 7 AS rest, floor(value) AS low, ceil(value) AS high, greatest(value, 50e0) AS top, least(value, 50e0) AS bottom, coalesce(nullif(event_type, 'view'), 'none') AS kind,
    CASE WHEN value < 50 THEN 'small' WHEN value < 100 THEN 'middle' ELSE 'large' END AS size, sign(value - 50) AS side, sqrt(abs(value)) AS root, TRY_CAST(event_type AS INT) AS number FROM events""")
def fn_math_conditional(spark, sf_dir):
    v, n = F.col("value"), F.col("event_id")
    return read(spark, sf_dir, "events").select(
        "event_id", F.abs(n - 500).alias("away"), (n % 7).alias("rest"), F.floor(v).cast("double").alias("low"), F.ceil(v).cast("double").alias("high"), F.greatest(v, F.lit(50.0)).alias("top"), F.least(v, F.lit(50.0)).alias("bottom"), F.coalesce(F.nullif(F.col("event_type"), F.lit("view")), F.lit("none")).alias("kind"),
        F.when(v < 50, "small").when(v < 100, "middle").otherwise("large").alias("size"), F.signum(v - 50).cast("tinyint").alias("side"), F.sqrt(F.abs(v)).alias("root"), F.col("event_type").try_cast("int").alias("number"),
    )


@query("""SELECT user_id, list_sort(list(DISTINCT event_type)) AS kinds, CAST(len(list(DISTINCT event_type)) AS INT) AS n, array_to_string(list_sort(list(DISTINCT event_type)), '+') AS joined, list_contains(list(event_type), 'error') AS failed FROM events GROUP BY user_id""")
def fn_array(spark, sf_dir):
    rows = read(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("kinds"))
    return rows.select("user_id", "kinds", F.size("kinds").alias("n"), F.array_join("kinds", "+").alias("joined"), F.array_contains("kinds", "error").alias("failed"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def fn_json(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query("SELECT * FROM (SELECT user_id, event_type FROM events) PIVOT (count(*) FOR event_type IN ('view', 'click', 'purchase') GROUP BY user_id)")
def reshape_pivot(spark, sf_dir):
    counted = read(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).count()
    return counted.na.fill(0)
