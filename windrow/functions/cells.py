"""Joins of positions with any number of zones, by a cover of grid cells.

A zone, grown by its threshold, is covered by square cells: coarse ones of a size that follows from its own, and where the
zone's boundary or the threshold's runs through one, finer ones in its place. A position lies in one cell of each level, so
candidates come from an equi-join on cells; a zone's cells do not overlap, so none comes twice. Only candidates pay for the
exact distance, and those in cells that lie inside a polygon as a whole not even that.

Rectangles along the axes are joined by themselves: their cells carry their bounds, from which a line of compiled arithmetic
has the distance, so candidates, of which there may be billions, are neither written down nor joined with anything again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.functions.spatial import NAUTICAL_MILE, distance_to_segments, from_wkt, mercator, mercator_point, segments, within

#: A cell of level n is 2**n metres wide. Levels are LOWEST and every STEP-th above it.
LOWEST, STEP = 4, 2
#: Coarse cells along a zone's longer side, about, and how often cells on a boundary are divided.
ALONG, REFINED = 8, 0
#: Metres up to which a rectangle's coordinates and threshold may go, for cells that are told apart by one number.
BOX_MOST = 2.0**30
#: What distances are widened by when cells are chosen, so that rounding loses none.
SLACK = 1e-3
#: Bytes of cells, or of zones, up to which they are broadcast, and what a row takes.
BROADCAST_BYTES, ROW_BYTES = 16 << 20, 80


def width(level: Column) -> Column:
    return F.pow(F.lit(2.0), level)


@dataclass(frozen=True)
class ZoneCover:
    """cells: (key, level, cx, cy, inside); shapes: the zones with key, zone_lines and zone_closed; levels that cells have."""

    cells: DataFrame
    shapes: DataFrame
    levels: list[int]


def lines_and_key(zones: DataFrame, wkt: str, threshold: str, axis_order: str) -> DataFrame:
    """zones plus key (of equal geometries and thresholds), zone_lines and zone_closed; without those that cannot be read."""
    shape = from_wkt(F.col(wkt))
    key = F.unhex(F.md5(F.concat_ws("|", F.col(wkt), F.col(threshold).cast("string"))))
    # as the element of an array a text is read once, not once for each use of its lines
    read = zones.withColumn("zone_lines", F.explode(F.array(segments(mercator(shape, axis_order))))).withColumns({"key": key, "zone_closed": F.coalesce(shape.kind == "POLYGON", F.lit(False))})
    whole = F.forall("zone_lines", lambda s: s.x1.isNotNull() & s.y1.isNotNull() & s.x2.isNotNull() & s.y2.isNotNull())
    return read.where((F.size("zone_lines") > 0) & whole & (F.col(threshold) > 0))


def square_to_segments(x: Column, y: Column, lines: Column) -> Column:
    """At most the squared distance of (x, y) to the segments: the larger of those to a segment's bounds and to its line."""

    def to_one(s: Column) -> Column:
        across = F.greatest(F.least(s.x1, s.x2) - x, x - F.greatest(s.x1, s.x2), F.lit(0.0))
        up = F.greatest(F.least(s.y1, s.y2) - y, y - F.greatest(s.y1, s.y2), F.lit(0.0))
        dx, dy = s.x2 - s.x1, s.y2 - s.y1
        area = (x - s.x1) * dy - (y - s.y1) * dx
        return F.greatest(across * across + up * up, F.coalesce(F.try_divide(area * area, dx * dx + dy * dy), F.lit(0.0)))

    return F.array_min(F.transform(lines, to_one))


def touched(cells: DataFrame) -> DataFrame:
    """(key, reach, zone_lines, zone_closed, level, cx, cy), without cells beyond reach, plus inside: the cell is in the polygon as a whole."""
    w = width(F.col("level"))
    x, y, half = (F.col("cx") + 0.5) * w, (F.col("cy") + 0.5) * w, w * F.lit(0.5**0.5)
    edge, margin = F.sqrt(square_to_segments(x, y, F.col("zone_lines"))), half + SLACK
    # one number a cell, computed once: 2 in the polygon as a whole, 1 within reach, 0 beyond
    place = F.when(F.col("zone_closed") & within(x, y, F.col("zone_lines")), F.when(edge > margin, 2).otherwise(1)).when(edge <= F.col("reach") + margin, 1).otherwise(0)
    kept = cells.withColumn("__place", F.explode(F.array(place))).where(F.col("__place") > 0)
    return kept.withColumn("inside", F.col("__place") == 2).drop("__place")


def zone_cover(zones: DataFrame, wkt: str = "geom_wkt", threshold: str = "threshold_nm", axis_order: str = "authority", refined: int = REFINED) -> ZoneCover:
    """The cells of zones. Equal zones share their cells; unreadable ones, and those without a positive threshold, have none."""
    shapes = lines_and_key(zones, wkt, threshold, axis_order)
    once = shapes.select("key", (F.col(threshold) * NAUTICAL_MILE).alias("reach"), "zone_lines", "zone_closed")
    # dealt by number, as few rows make many cells
    once = once.repartition(int(zones.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key").dropDuplicates(["key"])
    bound = lambda f, a, b: f(F.concat(F.transform("zone_lines", lambda s: s[a]), F.transform("zone_lines", lambda s: s[b])))
    boxed = once.withColumns({"__x0": bound(F.array_min, "x1", "x2") - F.col("reach"), "__x1": bound(F.array_max, "x1", "x2") + F.col("reach"), "__y0": bound(F.array_min, "y1", "y2") - F.col("reach"), "__y1": bound(F.array_max, "y1", "y2") + F.col("reach")})
    side = F.greatest(F.col("__x1") - F.col("__x0"), F.col("__y1") - F.col("__y0")) / ALONG
    least = LOWEST + STEP * refined
    level = F.greatest(F.lit(least), F.lit(least) + STEP * F.ceil((F.log2(side) - least) / STEP)).cast("int")
    leveled = boxed.withColumn("level", level)
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width(F.col("level"))), F.floor(F.col(hi) / width(F.col("level")))))
    shape = ("key", "reach", "zone_lines", "zone_closed")
    coarse = leveled.select(*shape, "level", "__y0", "__y1", span("__x0", "__x1").alias("cx")).select(*shape, "level", "cx", span("__y0", "__y1").alias("cy"))
    current, done = touched(coarse), []
    for _ in range(refined):
        done.append(current.where("inside"))
        part = F.explode(F.sequence(F.lit(0), F.lit(2**STEP - 1)))
        split = current.where("NOT inside").withColumn("__i", part).withColumn("__j", part)
        finer = split.select(*shape, (F.col("level") - STEP).alias("level"), (F.col("cx") * 2**STEP + F.col("__i")).alias("cx"), (F.col("cy") * 2**STEP + F.col("__j")).alias("cy"))
        current = touched(finer)
    cells = reduce(DataFrame.unionByName, (*done, current)).select("key", "level", "cx", "cy", "inside")
    tops = [r.level for r in leveled.select("level").distinct().collect()]  # as many as there are orders of size
    return ZoneCover(cells, shapes, sorted({t - STEP * k for t in tops for k in range(refined + 1)}))


def cell_number(level: Column | int, cx: Column, cy: Column) -> Column:
    """One number for a cell. Cells of one level share it only if they lie 2**28 cells apart, farther than any zone's."""
    low = F.lit(2**28 - 1)
    level = F.lit(level) if isinstance(level, int) else level
    return F.shiftleft(level.cast("bigint"), 56).bitwiseOR(F.shiftleft(cx.bitwiseAND(low), 28)).bitwiseOR(cy.bitwiseAND(low))


def with_box(read: DataFrame, threshold: str) -> DataFrame:
    """lines_and_key()'s rows plus __box (a rectangle along the axes), its bounds, and level, first cell and numbers of cells of its cover."""
    s, reach = [F.get("zone_lines", F.lit(i)) for i in range(4)], F.col(threshold) * NAUTICAL_MILE
    closes = reduce(Column.__and__, ((a.x2 == b.x1) & (a.y2 == b.y1) for a, b in zip(s, [*s[1:], s[0]])))
    along = [(a.y1 == a.y2) & (a.x1 != a.x2) for a in s]
    across = [(a.x1 == a.x2) & (a.y1 != a.y2) for a in s]
    turns = (along[0] & across[1] & along[2] & across[3]) | (across[0] & along[1] & across[2] & along[3])
    small = (F.greatest(*(F.abs(c) for c in (s[0].x1, s[0].y1, s[2].x1, s[2].y1))) < BOX_MOST) & (reach < BOX_MOST)
    corner = lambda f, c: f(s[0][c], s[2][c])
    bounds = {"__x0": corner(F.least, "x1"), "__x1": corner(F.greatest, "x1"), "__y0": corner(F.least, "y1"), "__y1": corner(F.greatest, "y1")}
    boxed = read.withColumns({"__box": F.coalesce(F.col("zone_closed") & (F.size("zone_lines") == 4) & closes & turns & small, F.lit(False)), **bounds})
    side = (F.greatest(F.col("__x1") - F.col("__x0"), F.col("__y1") - F.col("__y0")) + 2 * reach) / ALONG
    leveled = boxed.withColumn("__level", F.when(F.col("__box"), F.greatest(F.lit(LOWEST), LOWEST + STEP * F.ceil((F.log2(side) - LOWEST) / STEP)).cast("int")))
    at = lambda c, by: F.floor((F.col(c) + by) / F.expr("double(shiftleft(1L, __level))"))
    placed = leveled.withColumns({"__cx": at("__x0", -reach - SLACK), "__cy": at("__y0", -reach - SLACK)})
    return placed.withColumns({"__wide": at("__x1", reach + SLACK) - F.col("__cx") + 1, "__high": at("__y1", reach + SLACK) - F.col("__cy") + 1})


def near_boxes(at: DataFrame, boxes: DataFrame, columns: list[str], levels: list[int], threshold: str, broadcast: bool) -> DataFrame:
    """Pairs of a position (__x, __y) and one of with_box()'s rectangles nearer than its threshold: columns plus distance_nm.

    The distance is that to the nearest corner or side. Both sides are shuffled by cell, unless the cells are broadcast.
    """
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__wide") * F.col("__high") - 1))
    bounds = ("__x0", "__x1", "__y0", "__y1")
    kept = [c for c in boxes.columns if c in columns or c in bounds]
    each = boxes.withColumn("__k", k).select(*kept, cell_number(F.col("__level"), F.col("__cx") + F.expr("__k div __high"), F.col("__cy") + F.expr("__k % __high")).alias("__of"))
    cells = F.broadcast(each) if broadcast else each.hint("merge")
    spots = F.explode(F.array(*(cell_number(n, F.floor(F.col("__x") / 2.0**n), F.floor(F.col("__y") / 2.0**n)) for n in levels)))
    found = at.withColumn("__spot", spots).join(cells, F.col("__spot") == F.col("__of"))
    x, y = F.col("__x"), F.col("__y")
    dx, dy = F.greatest(F.col("__x0") - x, F.lit(0.0), x - F.col("__x1")), F.greatest(F.col("__y0") - y, F.lit(0.0), y - F.col("__y1"))
    return found.withColumn("distance_nm", F.sqrt(dx * dx + dy * dy) / NAUTICAL_MILE).where(F.col("distance_nm") < F.col(threshold)).select(*columns, "distance_nm")


def near_zones_by_cells(events: DataFrame, zones: DataFrame, lon: str, lat: str, threshold: str = "threshold_nm", axis_order: str = "authority", wkt: str = "geom_wkt") -> DataFrame:
    """Pairs of an event and a zone nearer than the zone's threshold, plus distance_nm: as near_zones, for any number of zones.

    Cells and zones are broadcast where their number bounds their size. Otherwise events are shuffled by cell, one narrow
    copy for each of the few levels, and candidates of zones that are no rectangles by zone; a cell or zone that holds a
    great part of them is split by the engine's skew join. Events without a position and zones without a readable geometry
    are in no pair; equal rows of either side pair each. Columns of the two sides must not share names.
    """
    x, y = mercator_point(F.col(lon), F.col(lat), axis_order)
    at = events.withColumns({"__x": x, "__y": y}).where(F.col("__x").isNotNull() & F.col("__y").isNotNull())
    # dealt by number, as the texts of few files are long to read
    dealt = zones.repartition(int(zones.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    boxed = with_box(lines_and_key(dealt, wkt, threshold, axis_order), threshold)
    cell_bytes = F.col("__wide") * F.col("__high") * (ROW_BYTES + F.octet_length(wkt))
    levels, size, others = boxed.agg(F.collect_set("__level"), F.sum(F.when(F.col("__box"), cell_bytes)), F.count_if(~F.col("__box"))).first()
    if not levels:
        return near_shapes(at, dealt, [*events.columns, *zones.columns], threshold, axis_order, wkt)
    found = near_boxes(at, boxed.where("__box"), [*events.columns, *zones.columns], sorted(levels), threshold, size <= BROADCAST_BYTES)
    if others:
        found = found.unionByName(near_shapes(at, boxed.where("NOT __box").select(*zones.columns), found.columns[:-1], threshold, axis_order, wkt))
    return found


def near_shapes(at: DataFrame, zones: DataFrame, columns: list[str], threshold: str, axis_order: str, wkt: str) -> DataFrame:
    """Pairs of a position (__x, __y) and a zone of any geometry nearer than its threshold: columns plus distance_nm."""
    cover = zone_cover(zones, wkt, threshold, axis_order)
    number, size = zones.agg(F.count("*"), F.sum(F.lit(ROW_BYTES) + 4 * F.length(wkt))).first()
    cells = F.broadcast(cover.cells) if number * (ALONG + 2) ** 2 * ROW_BYTES <= BROADCAST_BYTES else cover.cells.hint("merge")
    shapes = F.broadcast(cover.shapes) if (size or 0) <= BROADCAST_BYTES else cover.shapes.hint("merge")
    if not cover.levels:
        at = at.where("false")
    of = F.explode(F.array(*(F.struct(F.lit(n).alias("level"), F.floor(F.col("__x") / 2.0**n).alias("cx"), F.floor(F.col("__y") / 2.0**n).alias("cy")) for n in cover.levels or [LOWEST])))
    placed = at.withColumn("__cell", of)
    found = placed.join(cells, (F.col("__cell.level") == F.col("level")) & (F.col("__cell.cx") == F.col("cx")) & (F.col("__cell.cy") == F.col("cy")))
    found = found.select(*at.columns, F.col("key").alias("__key"), F.col("inside").alias("__inside"))
    exact = F.when(F.col("__inside"), F.lit(0.0)).otherwise(distance_to_segments(F.col("__x"), F.col("__y"), F.col("zone_lines"), F.col("zone_closed")) / NAUTICAL_MILE)
    paired = found.join(shapes, found["__key"] == shapes["key"]).withColumn("distance_nm", exact)
    return paired.where(F.col("distance_nm") < F.col(threshold)).select(*columns, "distance_nm")
