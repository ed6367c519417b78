"""Which product footprints meet which boxes.

Footprints are polygons with holes, given as arrays of polygons, rings and ``[lon, lat]`` points.
Their longitudes are unwrapped first, so a ring that crosses the antimeridian is one piece, and a
ring around a pole is closed along it.

Boxes that fit in memory are sent to every task, sorted by bands of latitude and their western edges.
A task looks up the boxes that the extents of its polygons reach and tests these pairs exactly, as
arrays; only which boxes a polygon meets is sent on. Otherwise a product is copied to the grid cells
in which the south-west corner of a box that meets it may lie, by bands of latitude; a box lies in the
one cell of its corner. Cells meet by an equi-join, so a product and a box come together once at most,
and are tested exactly where they meet. Either way pairs are neither shuffled nor stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwatch.session import small_side, stage, without_blind_broadcast

#: Degrees a grid cell is wide and tall.
CELL = 2.0
#: Polygons of one product id that may stand in one row.
MOST_PARTS = 200
#: Pairs, and pairs of edge and box, that a task tests at once.
PAIRS, EDGE_PAIRS = 1 << 18, 1 << 18
RING = "array<array<double>>"
EDGES = "array<struct<x1:double,y1:double,x2:double,y2:double>>"


def polygons_of(geometry: Column) -> Column:
    """Polygons of a GeoJSON geometry (``type``, ``coordinates`` as text); null for other types."""
    text = geometry["coordinates"]
    return F.when(geometry["type"] == "Polygon", F.array(F.from_json(text, f"array<{RING}>"))).when(
        geometry["type"] == "MultiPolygon", F.from_json(text, f"array<array<{RING}>>")
    )


def geometry_of_text(text: Column) -> Column:
    """GeoJSON form of a polygon or multipolygon in well-known text, with or without its SRID."""
    number = r"([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    body = F.regexp_extract(text, r"(?i)POLYGON\s*(\(.*\))", 1)
    points = F.regexp_replace(body, number + r"\s+" + number + r"(?:\s+" + number + ")?", "[$1,$2]")
    kind = F.when(F.regexp_like(text, F.lit(r"(?i)MULTIPOLYGON")), "MultiPolygon").otherwise("Polygon")
    found = F.struct(kind.alias("type"), F.translate(points, "()", "[]").alias("coordinates"))
    return F.when(body != "", found)


def _unwrapped(ring: Column) -> Column:
    """The ring's points with longitudes that never jump by more than half the globe, as no edge does."""
    def follow(done: Column, point: Column) -> Column:
        before = F.element_at(done, -1)[0]
        turns = F.round((before - point[0]) / 360.0)
        return F.concat(done, F.array(F.array(point[0] + turns * 360.0, point[1])))

    lons = F.transform(ring, lambda point: point[0])
    jumps = F.array_max(lons) - F.array_min(lons) > 180.0
    walked = F.aggregate(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1), follow)
    return F.when(jumps, walked).otherwise(ring)


def _closed(ring: Column) -> Column:
    """The ring ending at the point where it began."""
    return F.when(ring[0] == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def _around_pole(ring: Column) -> Column:
    """An unwrapped ring that runs once around the globe, closed along its pole; others as they are."""
    first, last = ring[0], F.element_at(ring, -1)
    mean = F.aggregate(ring, F.lit(0.0), lambda total, point: total + point[1])
    pole = F.when(mean >= 0, 90.0).otherwise(-90.0)
    around = F.concat(ring, F.array(F.array(last[0], pole), F.array(first[0], pole), first))
    return F.when(F.abs(first[0] - last[0]) > 180.0, around).otherwise(ring)


def _middle(ring: Column) -> Column:
    lons = F.transform(ring, lambda point: point[0])
    return (F.array_min(lons) + F.array_max(lons)) / 2


def polygon_edges(products: DataFrame) -> DataFrame:
    """One row per polygon: the product's columns, its edges, and their extent with ``west`` in [-180, 180).

    Points without both coordinates are left out, and so are polygons without an outer ring of at
    least three points.
    """
    sound = lambda ring: F.filter(ring, lambda point: point[0].isNotNull() & point[1].isNotNull())
    polygons = products.withColumn("_rings", F.explode("footprint")).drop("footprint")
    rings = F.filter(F.transform(F.coalesce("_rings", F.array().cast(f"array<{RING}>")), sound), lambda ring: F.size(ring) >= 3)
    walked = polygons.withColumn("_rings", F.transform(rings, lambda ring: _around_pole(_unwrapped(_closed(ring))))).where(F.size("_rings") > 0)
    # holes lie on the same turn as their outer ring; all of it begins on the first turn
    turned = walked.withColumn("_middle", _middle(F.col("_rings")[0])).withColumn(
        "_west", F.array_min(F.transform(F.col("_rings")[0], lambda point: point[0]))
    )
    home = -360.0 * F.floor((F.col("_west") + 180.0) / 360.0)

    def edges(ring: Column) -> Column:
        shift = home + 360.0 * F.round((F.col("_middle") - _middle(ring)) / 360.0)
        pairs = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b"))
        return F.transform(pairs, lambda pair: F.struct(
            (pair["a"][0] + shift).alias("x1"), pair["a"][1].alias("y1"), (pair["b"][0] + shift).alias("x2"), pair["b"][1].alias("y2")
        ))

    out = turned.withColumn("edges", F.flatten(F.transform("_rings", edges)).cast(EDGES)).drop("_rings", "_middle", "_west")
    extent = {"west": (F.array_min, "x1"), "east": (F.array_max, "x1"), "south": (F.array_min, "y1"), "north": (F.array_max, "y1")}
    return out.withColumns({name: f(F.col(f"edges.{c}")) for name, (f, c) in extent.items()})


def meets_box(edges: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Whether the polygon of these edges and the closed box have a point in common.

    Either an edge meets the box: their extents overlap and the box's corners are not all on one side
    of the edge. Or the box lies whole inside or outside, which the crossings of a ray from one of its
    corners tell; holes count by themselves.
    """
    def crosses(e: Column) -> Column:
        near = (F.least(e["x1"], e["x2"]) <= east) & (F.greatest(e["x1"], e["x2"]) >= west) & (F.least(e["y1"], e["y2"]) <= north) & (F.greatest(e["y1"], e["y2"]) >= south)
        side = lambda x, y: (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        sides = [side(x, y) for x in (west, east) for y in (south, north)]
        return near & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)

    def passed(e: Column) -> Column:
        spans = (e["y1"] > south) != (e["y2"] > south)
        return spans & (west < (e["x2"] - e["x1"]) * (south - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])

    return F.exists(edges, crosses) | (F.size(F.filter(edges, passed)) % 2 == 1)


def _cells(part: Column, delta: float, cell: float, turn: int) -> Column:
    """The cells in which a box that meets the polygon may have its south-west corner.

    Per band of latitude those between the polygon's outermost points in what such boxes cover, and
    one width of a box to the west. Columns are counted around the globe.
    """
    # a hair more on all sides, as the points on the band's edges are rounded
    hair, width = 1e-9, 360.0 / turn

    def columns(row: Column) -> Column:
        low, high = row * cell - hair, (row + 1) * cell + 2 * delta + hair

        def ends(e: Column) -> Column:
            """Longitudes at which the edge enters and leaves the band."""
            flat = e["y1"] == e["y2"]
            at = lambda y: F.when(flat, e["x1"]).otherwise(e["x1"] + (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]))
            clamp = lambda y: F.least(F.greatest(y, low), high)
            return F.array(at(clamp(e["y1"])), F.when(flat, e["x2"]).otherwise(at(clamp(e["y2"]))))

        inside = F.filter(part["edges"], lambda e: (F.least(e["y1"], e["y2"]) <= high) & (F.greatest(e["y1"], e["y2"]) >= low))
        span = lambda lons: F.sequence(F.floor((F.array_min(lons) - 2 * delta - hair) / width), F.floor((F.array_max(lons) + hair) / width))
        # as an array of one, so that the longitudes are worked out once
        span = F.transform(F.array(F.flatten(F.transform(inside, ends))), span)[0]
        cells = F.transform(span, lambda column: F.struct(row.alias("row"), F.pmod(column, F.lit(turn)).alias("column")))
        return F.coalesce(cells, F.array().cast("array<struct<row:bigint,column:bigint>>"))

    rows = F.sequence(F.floor((part["south"] - 2 * delta - hair) / cell), F.floor((part["north"] + hair) / cell))
    return F.flatten(F.transform(rows, columns))


def _hits(shapes: DataFrame, boxes: DataFrame, delta: float, cell: float, turn: int) -> DataFrame:
    """``region_id, product_id, first`` of the products and boxes that meet; each pair of rows once."""
    def meets(part: Column) -> Column:
        def at(shift: Column) -> Column:
            west = F.col("box_west") + shift
            east = west + 2 * delta
            return (part["west"] <= east) & (part["east"] >= west) & meets_box(part["edges"], west, south, east, north)

        south, north = F.col("box_south"), F.col("box_north")
        level = (part["south"] <= north) & (part["north"] >= south)
        # polygons begin in [-180, 180) and span one turn at most
        return level & (at(F.lit(0.0)) | ((part["east"] >= 180.0) & at(F.lit(360.0))) | at(F.lit(-360.0)))

    placed = shapes.withColumn("_cell", F.explode(F.array_distinct(F.flatten(F.transform("parts", lambda part: _cells(part, delta, cell, turn))))))
    placed = placed.select("product_id", "parts", "_cell.*")
    side = small_side(boxes)
    near = (placed if side is not boxes else without_blind_broadcast(placed, shapes, 64)).join(side, ["row", "column"])
    met = near.where(F.exists("parts", meets))
    first = F.when(F.size("parts") == 1, F.col("parts")[0]["own"]).otherwise(
        F.array_min(F.transform(F.filter("parts", meets), lambda part: part["own"]))
    )
    return met.select("region_id", "product_id", first.alias("first"))


def _met(edges: np.ndarray, first: np.ndarray, count: np.ndarray, west: np.ndarray, south: np.ndarray, east: np.ndarray, north: np.ndarray) -> np.ndarray:
    """:func:`meets_box` for pairs of a polygon, whose edges are ``count`` from ``first`` on, and a box."""
    out, ends, start = np.zeros(len(first), bool), np.cumsum(count), 0
    while start < len(first):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + EDGE_PAIRS, "right")))
        size = count[start:stop]
        begin = ends[start:stop] - size - done
        x1, y1, x2, y2 = edges[:, np.arange(int(size.sum())) + np.repeat(first[start:stop] - begin, size)]
        w, s, e, n = (np.repeat(side[start:stop], size) for side in (west, south, east, north))
        dx, dy = x2 - x1, y2 - y1
        near = (np.minimum(x1, x2) <= e) & (np.maximum(x1, x2) >= w) & (np.minimum(y1, y2) <= n) & (np.maximum(y1, y2) >= s)
        at_south, at_north, at_west, at_east = dx * (s - y1), dx * (n - y1), dy * (w - x1), dy * (e - x1)
        sides = at_south - at_west, at_north - at_west, at_south - at_east, at_north - at_east
        crosses = near & (np.minimum.reduce(sides) <= 0) & (np.maximum.reduce(sides) >= 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            passed = ((y1 > s) != (y2 > s)) & (w < at_south / dy + x1)
        out[start:stop] = np.logical_or.reduceat(crosses, begin) | (np.add.reduceat(passed, begin, dtype=np.int64) % 2 == 1)
        start = stop
    return out


def _meeting(boxes, delta: float, cell: float):
    """Parts that meet boxes, with the places of these; a place counts for the first part of its product.

    ``boxes`` has arrays sorted by row and western edge: row, west, south, north, and the place, as a
    position in the last array, of the places.
    """
    def lookups(extent: dict[str, np.ndarray], box_row: np.ndarray, box_west: np.ndarray) -> tuple[np.ndarray, ...]:
        """Part, shift and range of boxes of each band that a part reaches, by part."""
        # more than enough room for rounding, as extents are compared exactly afterwards
        hair, width = 1e-6, 1024.0
        low = np.floor((extent["south"] - 2 * delta - hair) / cell).astype(np.int64)
        bands = np.floor((extent["north"] + hair) / cell).astype(np.int64) - low + 1
        part = np.repeat(np.arange(len(low)), bands)
        row = low[part] + np.arange(len(part)) - np.repeat(np.cumsum(bands) - bands, bands)
        keys, found = box_row * width + box_west, []
        # polygons begin in [-180, 180) and span one turn at most
        for shift, of in ((0.0, part >= 0), (360.0, extent["east"][part] >= 180.0), (-360.0, part >= 0)):
            at = row[of] * width
            ends = (extent["west"][part[of]] - 2 * delta - shift - hair, extent["east"][part[of]] - shift + hair)
            first, last = (np.searchsorted(keys, at + np.clip(lon, -200.0, 200.0), side) for lon, side in zip(ends, ("left", "right")))
            found.append((part[of], np.full(len(first), shift), first, np.maximum(last - first, 0)))
        part, shift, first, count = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(part, kind="stable")
        order = order[count[order] > 0]
        return part[order], shift[order], first[order], count[order]

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box_row, box_west, box_south, box_north, place, places = boxes.value
        for batch in batches:
            listed = batch.column("parts")
            flat = listed.flatten()
            product = np.repeat(np.arange(batch.num_rows), pc.list_value_length(listed).to_numpy(zero_copy_only=False))
            extent = {name: flat.field(name).to_numpy(zero_copy_only=False) for name in ("west", "east", "south", "north")}
            n_edges = pc.list_value_length(flat.field("edges")).to_numpy(zero_copy_only=False).astype(np.int64)
            lines, first_edge = flat.field("edges").flatten(), np.cumsum(n_edges) - n_edges
            edges = np.stack([lines.field(name).to_numpy(zero_copy_only=False) for name in ("x1", "y1", "x2", "y2")])
            part, shift, first, count = lookups(extent, box_row, box_west)
            # products stay whole, as a place counts for one part of each
            ends = np.flatnonzero(np.diff(product[part], append=-1)) + 1
            totals, done, start = np.cumsum(count)[ends - 1], 0, 0
            while start < len(ends):
                stop = max(start + 1, int(np.searchsorted(totals, done + PAIRS, "right")))
                some = slice(ends[start - 1] if start else 0, ends[stop - 1])
                size = count[some]
                box = np.arange(int(size.sum())) + np.repeat(first[some] - (np.cumsum(size) - size), size)
                of, west = np.repeat(part[some], size), box_west[box] + np.repeat(shift[some], size)
                east, south, north = west + 2 * delta, box_south[box], box_north[box]
                near = np.flatnonzero((extent["west"][of] <= east) & (extent["east"][of] >= west) & (extent["south"][of] <= north) & (extent["north"][of] >= south))
                near = near[_met(edges, first_edge[of[near]], n_edges[of[near]], west[near], south[near], east[near], north[near])]
                key = product[of[near]] * len(places) + place[box[near]]
                order = np.argsort(key, kind="stable")
                once = np.sort(order[np.diff(key[order], prepend=-1) != 0])
                parts, starts = np.unique(of[near][once], return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(once)).astype(np.int32)), pa.array(places[place[box[near][once]]]))
                yield pa.RecordBatch.from_arrays([batch.column("product_id").take(pa.array(product[parts])), flat.field("own").take(pa.array(parts)), lists], ["product_id", "first", "places"])
                done, start = totals[stop - 1], stop

    return meeting


def _sent(boxes: DataFrame):
    """The boxes as arrays, as :func:`_meeting` takes them, for every task."""
    found = boxes.select("row", "box_west", "box_south", "box_north", "place").toArrow()
    row, west, south, north, place = (found[c].to_numpy() for c in found.column_names)
    order = np.lexsort((west, row))
    places, place = np.unique(place, return_inverse=True)
    return boxes.sparkSession.sparkContext.broadcast((row[order], west[order], south[order], north[order], place[order], places))


def meeting_boxes(products: DataFrame, regions: DataFrame, delta: float = 0.5, cell: float = CELL) -> DataFrame:
    """Products and the regions whose box of ``delta`` degrees around ``lat, lon`` their footprint meets.

    ``products`` has ``product_id``, ``footprint`` and any columns but those named here; ``regions``
    has ``region_id, lat, lon``. One row per product and region, of repeated products the first by
    their other columns. Boxes may cross the antimeridian. Products without a footprint and regions
    without a position meet nothing.

    The polygons of a product travel in one row. Only pairs of a product id of more than ``MOST_PARTS``
    polygons are grouped afterwards, and those of a region id that stands for several boxes if the boxes
    are too many for one task.
    """
    others = [c for c in products.columns if c not in ("product_id", "footprint")]
    turn = max(1, round(360.0 / cell))
    own = F.struct(*others) if others else F.struct(F.lit(1).alias("none"))
    part = F.struct(own.alias("own"), "edges", "west", "east", "south", "north").alias("part")
    polygons = stage(polygon_edges(products).select("product_id", part), "footprints")
    many = polygons.groupBy("product_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_PARTS)
    many = stage(many.select(F.col("product_id").alias("_id")), "footprints-many")
    listed, heavy = polygons, None
    if not many.isEmpty():
        same = polygons["product_id"].eqNullSafe(many["_id"])
        listed, heavy = polygons.join(many, same, "left_anti"), polygons.join(many, same, "left_semi").select("product_id", F.array("part").alias("parts"))
    shapes = listed.groupBy("product_id").agg(F.collect_list("part").alias("parts"))

    west = F.col("lon") - delta
    home = -360.0 * F.floor((west + 180.0) / 360.0)
    boxes = regions.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        "region_id", (F.col("lat") - delta).alias("box_south"), (F.col("lat") + delta).alias("box_north"), (west + home).alias("box_west"),
    ).withColumns({"row": F.floor(F.col("box_south") / cell), "column": F.pmod(F.floor(F.col("box_west") / (360.0 / turn)), F.lit(turn))})
    # all boxes of a region have one place
    own_region = Window.partitionBy("region_id")
    boxes = boxes.withColumn("number", F.monotonically_increasing_id()).withColumns({"again": F.count(F.lit(1)).over(own_region) > 1, "place": F.min("number").over(own_region)})
    boxes = stage(boxes, "boxes")

    if small_side(boxes) is not boxes:
        sent, names = _sent(boxes), F.broadcast(boxes.where("number = place").select("place", "region_id"))
        sorted_parts = shapes.select("product_id", F.array_sort("parts").alias("parts"))
        schema = T.StructType([shapes.schema["product_id"], T.StructField("first", polygons.schema["part"].dataType["own"].dataType), T.StructField("places", T.ArrayType(T.LongType()))])

        def hits(shapes: DataFrame) -> DataFrame:
            met = shapes.mapInArrow(_meeting(sent, delta, cell), schema)
            return met.select("product_id", "first", F.explode("places").alias("place")).join(names, "place").select("region_id", "product_id", "first")

        found, several = hits(sorted_parts), [hits(heavy)] if heavy is not None else []
    else:
        once, again = boxes.where("NOT again"), boxes.where("again")
        found = _hits(shapes, once, delta, cell, turn)
        several = ([_hits(shapes, again, delta, cell, turn)] if not again.isEmpty() else []) + ([_hits(heavy, boxes, delta, cell, turn)] if heavy is not None else [])
    if several:
        pairs = several[0] if len(several) == 1 else several[0].unionByName(several[1])
        found = found.unionByName(pairs.groupBy("region_id", "product_id").agg(F.min("first").alias("first")))
    return found.select("region_id", "product_id", *(["first.*"] if others else []))
