"""Planar geometry in native expressions: WKT, spherical Mercator, point-to-polygon distance; no extension, no UDF.

A geometry is struct<kind, rings>: a ring is an array of (x, y) points; a point has one ring of one point.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the sphere's radius in metres of EPSG:3857; metres of a nautical mile.
RADIUS, NAUTICAL_MILE = 6378137.0, 1852.0
#: Zones that every position is compared with; more are looked up by cells.
FEW_ZONES = 64
RINGS = "array<array<struct<x:double,y:double>>>"
#: A geometry of the SQL functions: a point's coordinates or a text, and what it is projected to.
SHAPE = "struct<x:double,y:double,wkt:string,srid:string>"


def point(x: Column, y: Column) -> Column:
    return F.struct(F.lit("POINT").alias("kind"), F.array(F.array(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))).alias("rings"))


def from_wkt(wkt: Column) -> Column:
    """POINT, LINESTRING and POLYGON (with holes) texts; anything else has kind null and no rings."""
    kind = F.nullif(F.upper(F.regexp_extract(wkt, r"^\s*([A-Za-z]+)\s*\(", 1)), F.lit(""))
    rings = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))
    words = lambda r: F.transform(F.split(r, ","), lambda p: F.split(F.trim(p), r"\s+"))

    def pair(xy: Column) -> Column:
        return F.struct(F.get(xy, F.lit(0)).try_cast("double").alias("x"), F.get(xy, F.lit(1)).try_cast("double").alias("y"))

    return F.struct(kind.alias("kind"), F.transform(rings, lambda r: F.transform(words(r), pair)).alias("rings"))


def mercator(geometry: Column, axis_order: str = "authority") -> Column:
    """EPSG:4326 to EPSG:3857. 'authority': the first coordinate is the latitude; 'xy': it is the longitude."""
    swap = {"authority": True, "xy": False}[axis_order]

    def project(p: Column) -> Column:
        lon, lat = (p.y, p.x) if swap else (p.x, p.y)
        return F.struct((F.lit(RADIUS) * F.radians(lon)).alias("x"), (F.lit(RADIUS) * F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2))).alias("y"))

    return F.struct(geometry.kind.alias("kind"), F.transform(geometry.rings, lambda r: F.transform(r, project)).alias("rings"))


def segments(geometry: Column) -> Column:
    """array<struct<x1, y1, x2, y2>> of all rings; a lone point is a segment of no length."""

    def of_ring(r: Column) -> Column:
        ends = F.when(F.size(r) > 1, F.slice(r, F.lit(2), F.size(r) - 1)).otherwise(r)
        begins = F.slice(r, F.lit(1), F.size(ends))
        return F.zip_with(begins, ends, lambda a, b: F.struct(a.x.alias("x1"), a.y.alias("y1"), b.x.alias("x2"), b.y.alias("y2")))

    return F.flatten(F.transform(geometry.rings, of_ring))


def distance_to_segments(x: Column, y: Column, lines: Column, closed: bool | Column = True) -> Column:
    """Least distance of (x, y) to the segments; 0 inside a polygon's (closed) rings, by the crossing number."""

    def to_one(s: Column) -> Column:
        dx, dy = s.x2 - s.x1, s.y2 - s.y1
        length = dx * dx + dy * dy
        t = F.when(length == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - s.x1) * dx + (y - s.y1) * dy) / F.when(length == 0, F.lit(1.0)).otherwise(length))))
        return F.hypot(x - (s.x1 + t * dx), y - (s.y1 + t * dy))

    least = F.array_min(F.transform(lines, to_one))
    if closed is False:
        return least
    closed = F.lit(closed) if isinstance(closed, bool) else closed
    return F.when(closed & within(x, y, lines), F.lit(0.0)).otherwise(least)


def within(x: Column, y: Column, lines: Column) -> Column:
    """Whether (x, y) lies inside the rings, by the crossing number."""

    def crosses(s: Column) -> Column:
        straddles = (s.y1 > y) != (s.y2 > y)
        rise = F.when(s.y2 == s.y1, F.lit(1.0)).otherwise(s.y2 - s.y1)
        return straddles & (x < s.x1 + (y - s.y1) / rise * (s.x2 - s.x1))

    return F.size(F.filter(lines, crosses)) % 2 == 1


def distance(a: Column, b: Column) -> Column:
    """Distance of a point and any geometry."""
    p = F.get(F.get(a.rings, F.lit(0)), F.lit(0))
    return distance_to_segments(p.x, p.y, segments(b), b.kind == "POLYGON")


def with_zone_geometry(zones: DataFrame, wkt: str = "geom_wkt", axis_order: str = "authority") -> DataFrame:
    """zones plus zone_lines, zone_closed (a polygon) and the bounds of their points: projected once, on the small side of a join."""
    shape = from_wkt(F.col(wkt))
    lines = zones.withColumns({"zone_lines": segments(mercator(shape, axis_order)), "zone_closed": F.coalesce(shape.kind == "POLYGON", F.lit(False))})
    bound = lambda f, a, b: f(F.concat(F.transform("zone_lines", lambda s: s[a]), F.transform("zone_lines", lambda s: s[b])))
    return lines.withColumns({"zone_x0": bound(F.array_min, "x1", "x2"), "zone_x1": bound(F.array_max, "x1", "x2"), "zone_y0": bound(F.array_min, "y1", "y2"), "zone_y1": bound(F.array_max, "y1", "y2")})


def mercator_point(lon: Column, lat: Column, axis_order: str = "authority") -> tuple[Column, Column]:
    """The projected x and y of a position, as scalars."""
    lon, lat = {"authority": (lat, lon), "xy": (lon, lat)}[axis_order]
    return F.lit(RADIUS) * F.radians(lon), F.lit(RADIUS) * F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2))


def near_zones(events: DataFrame, zones: DataFrame, lon: str, lat: str, threshold: str = "threshold_nm", axis_order: str = "authority") -> DataFrame:
    """Pairs of an event and a zone nearer than the zone's threshold, plus distance_nm (unrounded).

    A theta join with a static dimension. Up to FEW_ZONES, such as a configuration's inline rows, are broadcast; events are
    not shuffled, and may be a stream. The zone's bounds guard the exact distance: both stand in one expression, which no
    optimizer takes apart, so only positions within the bounds cost more than comparisons. More zones are joined by cells.
    """
    if zones.limit(FEW_ZONES + 1).count() > FEW_ZONES:
        from windrow.functions.cells import near_zones_by_cells

        return near_zones_by_cells(events, zones, lon, lat, threshold, axis_order)
    x, y = mercator_point(F.col(lon), F.col(lat), axis_order)
    at = events.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).withColumns({"__x": x, "__y": y})
    z = F.broadcast(with_zone_geometry(zones, axis_order=axis_order))
    x, y, reach = F.col("__x"), F.col("__y"), F.col(threshold) * NAUTICAL_MILE
    box = (x > F.col("zone_x0") - reach) & (x < F.col("zone_x1") + reach) & (y > F.col("zone_y0") - reach) & (y < F.col("zone_y1") + reach)
    found = at.crossJoin(z).withColumn("distance_nm", F.when(box, distance_to_segments(x, y, F.col("zone_lines"), F.col("zone_closed")) / NAUTICAL_MILE))
    return found.where(F.col("distance_nm") < F.col(threshold)).drop("__x", "__y", "zone_lines", "zone_closed", "zone_x0", "zone_x1", "zone_y0", "zone_y1")


def known_segments(wkt: str, axis_order: str) -> list[tuple[float, float, float, float]]:
    """A polygon's projected segments (x1, y1, x2, y2), for a text that comes with a configuration; none for other texts."""
    if not re.fullmatch(r"\s*POLYGON\s*\((?:\s*\([^()]+\)\s*,?)+\s*\)\s*", wkt, re.I):
        return []
    out = []
    for ring in re.findall(r"\(([^()]+)\)", wkt):
        pairs = [tuple(map(float, p.split())) for p in ring.split(",")]
        at = [(RADIUS * math.radians(x), RADIUS * math.log(math.tan(0.7853981633974483 + math.radians(y) / 2))) for x, y in (p[::-1] if axis_order == "authority" else p for p in pairs)]
        out += [(*a, *b) for a, b in zip(at, at[1:])]
    return out


def segments_sql(lines: list[tuple[float, float, float, float]]) -> str:
    return "array(" + ", ".join("named_struct({})".format(", ".join(f"'{n}', {v!r}D" for n, v in zip(("x1", "y1", "x2", "y2"), s))) for s in lines) + ")"


def bounds_of_box(lines: list[tuple[float, float, float, float]]) -> tuple[float, float, float, float] | None:
    """(x0, x1, y0, y1) if the segments are the four sides of a rectangle along the axes."""
    if len(lines) != 4 or lines[0][:2] != lines[3][2:] or any((x1 == x2) == (y1 == y2) for x1, y1, x2, y2 in lines):
        return None
    if any((a[0] == a[2]) == (b[0] == b[2]) for a, b in zip(lines, lines[1:])):
        return None
    xs, ys = [s[0] for s in lines], [s[1] for s in lines]
    return min(xs), max(xs), min(ys), max(ys)


def register(spark: SparkSession, axis_order: str = "authority", known: Iterable[str] = ()) -> None:
    """st_point, st_geomfromtext, st_transform and st_distance as SQL functions of the session, inlined by the optimizer.

    A geometry stays a point's coordinates or a text until st_distance reads it, so nesting them repeats no work. known:
    texts of polygons that queries will meet, such as those of a configuration's reference tables; they are parsed and
    projected here, once, and stand in the plan as constants. Other texts are read row by row.
    """
    lon, lat = ("y", "x") if axis_order == "authority" else ("x", "y")
    literal = lambda text: "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
    lines = {wkt: made for wkt in dict.fromkeys(known) if (made := known_segments(wkt, axis_order))}
    chosen = " ".join(f"WHEN {literal(wkt)} THEN {segments_sql(made)}" for wkt, made in lines.items())
    boxes = {wkt: box for wkt, made in lines.items() if (box := bounds_of_box(made))}
    # to a rectangle along the axes the distance is a line of arithmetic, which is compiled; loops are not
    of_box = lambda x0, x1, y0, y1: f"hypot(greatest({x0!r}D - px, 0D, px - {x1!r}D), greatest({y0!r}D - py, 0D, py - {y1!r}D))"
    boxed = " ".join(f"WHEN {literal(wkt)} THEN {of_box(*box)}" for wkt, box in boxes.items())
    read = "__st_lines(__st_project(__st_rings(wkt)))"
    east = lambda v: f"{RADIUS}e0 * radians({v})"
    north = lambda v: f"{RADIUS}e0 * ln(tan(0.7853981633974483e0 + radians({v}) / 2))"
    number = lambda k: f"try_cast(regexp_extract(g.wkt, '\\\\(\\\\s*([^\\\\s(),]+)\\\\s+([^\\\\s(),]+)', {k}) AS DOUBLE)"
    segment = "struct<x1:double,y1:double,x2:double,y2:double>"
    definitions = (
        f"st_point(x DOUBLE, y DOUBLE) RETURNS {SHAPE} RETURN named_struct('x', x, 'y', y, 'wkt', CAST(NULL AS STRING), 'srid', '')",
        f"st_geomfromtext(wkt STRING) RETURNS {SHAPE} RETURN named_struct('x', CAST(NULL AS DOUBLE), 'y', CAST(NULL AS DOUBLE), 'wkt', wkt, 'srid', '')",
        f"""st_transform(g {SHAPE}, source STRING, target STRING) RETURNS {SHAPE} RETURN CASE WHEN source = target THEN g WHEN source = 'EPSG:4326' AND target = 'EPSG:3857'
            THEN named_struct('x', g.x, 'y', g.y, 'wkt', g.wkt, 'srid', target) ELSE raise_error('st_transform: only EPSG:4326 to EPSG:3857') END""",
        f"""__st_rings(wkt STRING) RETURNS {RINGS} RETURN transform(regexp_extract_all(wkt, '\\\\(([^()]+)\\\\)', 1), r -> transform(split(r, ','), p -> named_struct('x', try_cast(get(split(trim(p), '\\\\s+'), 0) AS DOUBLE), 'y', try_cast(get(split(trim(p), '\\\\s+'), 1) AS DOUBLE))))""",
        f"__st_project(rings {RINGS}) RETURNS {RINGS} RETURN transform(rings, r -> transform(r, p -> named_struct('x', {east('p.' + lon)}, 'y', {north('p.' + lat)})))",
        f"""__st_lines(rings {RINGS}) RETURNS array<{segment}> RETURN flatten(transform(rings, r -> CASE WHEN size(r) > 1
            THEN zip_with(slice(r, 1, size(r) - 1), slice(r, 2, size(r) - 1), (a, b) -> named_struct('x1', a.x, 'y1', a.y, 'x2', b.x, 'y2', b.y))
            ELSE transform(r, a -> named_struct('x1', a.x, 'y1', a.y, 'x2', a.x, 'y2', a.y)) END))""",
        f"__st_projected(wkt STRING) RETURNS array<{segment}> RETURN {f'CASE wkt {chosen} ELSE {read} END' if lines else read}",
        f"__st_x(g {SHAPE}) RETURNS DOUBLE RETURN CASE WHEN g.wkt IS NULL THEN g.x ELSE {number(1)} END",
        f"__st_y(g {SHAPE}) RETURNS DOUBLE RETURN CASE WHEN g.wkt IS NULL THEN g.y ELSE {number(2)} END",
        f"""__st_at(x DOUBLE, y DOUBLE, srid STRING) RETURNS struct<x:double,y:double> RETURN CASE WHEN srid = '' THEN named_struct('x', x, 'y', y) ELSE named_struct('x', {east(lon)}, 'y', {north(lat)}) END""",
        # the operands are bound once, as the element of an array, so the segments' loop does not compute them again
        f"""__st_looped(a {SHAPE}, b {SHAPE}) RETURNS DOUBLE RETURN transform(array(named_struct('p', __st_at(__st_x(a), __st_y(a), a.srid), 'closed', b.wkt RLIKE '(?i)^\\\\s*POLYGON', 'lines',
            CASE WHEN b.wkt IS NULL THEN transform(array(__st_at(b.x, b.y, b.srid)), e -> named_struct('x1', e.x, 'y1', e.y, 'x2', e.x, 'y2', e.y)) WHEN b.srid = '' THEN __st_lines(__st_rings(b.wkt)) ELSE __st_projected(b.wkt) END)),
            q -> CASE WHEN q.closed AND size(filter(q.lines, s -> (s.y1 > q.p.y) != (s.y2 > q.p.y) AND q.p.x < s.x1 + (q.p.y - s.y1) / (CASE WHEN s.y2 = s.y1 THEN 1e0 ELSE s.y2 - s.y1 END) * (s.x2 - s.x1))) % 2 = 1 THEN 0e0
            ELSE array_min(transform(q.lines, s -> array_max(transform(array(least(1e0, greatest(0e0, ((q.p.x - s.x1) * (s.x2 - s.x1) + (q.p.y - s.y1) * (s.y2 - s.y1))
                / (CASE WHEN s.x2 = s.x1 AND s.y2 = s.y1 THEN 1e0 ELSE (s.x2 - s.x1) * (s.x2 - s.x1) + (s.y2 - s.y1) * (s.y2 - s.y1) END)))),
                t -> hypot(q.p.x - (s.x1 + t * (s.x2 - s.x1)), q.p.y - (s.y1 + t * (s.y2 - s.y1))))))) END)[0]""",
        f"__st_boxed(px DOUBLE, py DOUBLE, wkt STRING) RETURNS DOUBLE RETURN {f'CASE wkt {boxed} END' if boxes else 'CAST(NULL AS DOUBLE)'}",
        f"""st_distance(a {SHAPE}, b {SHAPE}) RETURNS DOUBLE RETURN {f"CASE WHEN a.srid <> '' AND b.srid <> '' AND b.wkt IN ({', '.join(map(literal, boxes))}) THEN __st_boxed({east('__st_' + lon + '(a)')}, {north('__st_' + lat + '(a)')}, b.wkt) ELSE __st_looped(a, b) END" if boxes else "__st_looped(a, b)"}""",
    )
    for d in definitions:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {d}")
