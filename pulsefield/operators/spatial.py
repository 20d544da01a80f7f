"""Polygons and grids: point-in-polygon, overlay areas, coverage, nearest points.

A spatial join is an equi-join on grid buckets that a polygon's bounds cover, then an exact test.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsefield.operators.nearest import by_tiles

#: Buckets that a shape covers on average, and that a table of few shapes covers in all.
COVER, LEAST_COVER = 4, 4096
#: Rows of a grid that `nearest_index` sends to the points as an array.
SMALL = 1000


def _next(ring: str, i: Column) -> Column:
    return F.element_at(ring, (F.pmod(i + 1, F.size(ring)) + 1).cast("int"))


def polygon_stats(polys: DataFrame, ring: str = "ring") -> DataFrame:
    """Adds bounds and area (shoelace, holes are rows of their own)."""
    cross = F.transform(ring, lambda p, i: p["x"] * _next(ring, i)["y"] - _next(ring, i)["x"] * p["y"])
    area = F.abs(F.aggregate(cross, F.lit(0.0), lambda a, v: a + v)) / 2
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return polys.withColumns({"x_min": F.array_min(xs), "x_max": F.array_max(xs), "y_min": F.array_min(ys), "y_max": F.array_max(ys), "area": area})


def cells_from_centres(df: DataFrame, width: float, height: float) -> DataFrame:
    """Rectangles around centres X, Y: bounds and ring."""
    x0, x1, y0, y1 = F.col("X") - width / 2, F.col("X") + width / 2, F.col("Y") - height / 2, F.col("Y") + height / 2
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return df.withColumns({"x_min": x0, "x_max": x1, "y_min": y0, "y_max": y1, "ring": F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1))})


def inside(ring: str, x: Column, y: Column) -> Column:
    """Even-odd ray test; a point on an edge that two polygons share is in exactly one of them.

    An edge is read from its lower end, so that one walked both ways (between the parts of a ring with
    holes) crosses twice or not at all.
    """
    def crosses(a: Column, i: Column) -> Column:
        b = _next(ring, i)
        up = (a["y"] < b["y"]) | ((a["y"] == b["y"]) & (a["x"] <= b["x"]))
        p, q = F.when(up, a).otherwise(b), F.when(up, b).otherwise(a)
        at = p["x"] + (y - p["y"]) / F.when(q["y"] != p["y"], q["y"] - p["y"]) * (q["x"] - p["x"])
        return F.when(((p["y"] > y) != (q["y"] > y)) & (x < at), 1).otherwise(0)

    return F.aggregate(F.transform(ring, crosses), F.lit(0), lambda a, v: a + v) % 2 == 1


def _sides(shapes: DataFrame, prefix: str = "") -> DataFrame:
    """One row: wx, wy, the sides of a bucket.

    They follow the mean sides of a shape, whatever the unit of the coordinates, so that the shapes cover
    about `COVER` buckets each; few shapes get smaller buckets, so that points spread over many keys.
    """
    w, h = (F.col(f"{prefix}{v}_max") - F.col(f"{prefix}{v}_min") for v in "xy")
    means = shapes.agg(F.avg(w).alias("w"), F.avg(h).alias("h"), F.avg(w * h).alias("wh"), F.count("*").alias("n"))
    cover = F.greatest(F.lit(float(COVER)), F.try_divide(F.lit(float(LEAST_COVER)), F.col("n")))
    longer = F.sqrt(F.coalesce(F.try_divide("wh", F.col("w") * F.col("h")), F.lit(1.0)) / cover)
    side = lambda c: F.when(F.col(c) > 0, F.col(c) * longer).otherwise(1.0)
    return F.broadcast(means.select(side("w").alias("wx"), side("h").alias("wy")))


def _bucket(v: str | Column, side: str) -> Column:
    return F.floor((F.col(v) if isinstance(v, str) else v) / F.col(side))


def _bucketed(points: DataFrame, sides: DataFrame, x: str, y: str) -> DataFrame:
    return points.crossJoin(sides).withColumns({"bx": _bucket(x, "wx"), "by": _bucket(y, "wy")}).drop("wx", "wy")  # one row


def _covered(df: DataFrame, sides: DataFrame, prefix: str = "") -> DataFrame:
    """A row for each bucket that the bounds touch; keeps wx and wy."""
    span = lambda v: F.explode(F.sequence(_bucket(f"{prefix}{v}_min", "w" + v), _bucket(f"{prefix}{v}_max", "w" + v)))
    return df.crossJoin(sides).withColumn("bx", span("x")).withColumn("by", span("y"))  # one row


#: A covering of up to so many bytes is sent to the points.
SMALL_COVER = 64 << 20
#: Corners of all polygons together that are sent to the points as they are, a ring in each of some 4,096 buckets.
FEW_CORNERS = 256
_EDGE_TYPE = "array<struct<x1:double,y1:double,x2:double,y2:double>>"


def _edges(ring: str) -> Column:
    """The edges of a ring, each from its lower end, as `inside` reads them."""
    def edge(a: Column, i: Column) -> Column:
        b = _next(ring, i)
        up = (a["y"] < b["y"]) | ((a["y"] == b["y"]) & (a["x"] <= b["x"]))
        p, q = F.when(up, a).otherwise(b), F.when(up, b).otherwise(a)
        return F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))

    return F.transform(ring, edge)


def _x_at(e, y: Column) -> Column:
    """Where an edge is at height y; null for a level one."""
    return e["x1"] + (y - e["y1"]) / F.when(e["y2"] != e["y1"], e["y2"] - e["y1"]) * (e["x2"] - e["x1"])


def _y_at(e, x: Column) -> Column:
    return e["y1"] + (x - e["x1"]) / F.when(e["x2"] != e["x1"], e["x2"] - e["x1"]) * (e["y2"] - e["y1"])


class Cover:
    """Polygons cut into cells: a cell is inside its polygon, or has the edges that touch it.

    `cells` has bx, by, _odd (whether the cell's lower left corner is inside), _edges and the polygon's columns but its
    ring; cells that are outside are left out. Cells follow the mean size of a polygon, so that there are about four for
    each, `LEAST_COVER` in all, and as many as there are corners, so that a polygon of very many corners has few edges
    in each. Edges are dealt to cells row by row; no ring meets a point. `of` says where a point is by its own cell alone:
    the corner, and the edges crossed on the way from the corner up and then across. Cells' sides lie where no corner
    does, and ties go as in `inside`, so the answers are those of the whole ring.
    """

    def __init__(self, polys: DataFrame, ring: str = "ring"):
        self.columns = [c for c in polys.columns if c != ring]
        self.spark = polys.sparkSession
        shapes = polygon_stats(polys.filter(F.size(ring) > 0), ring).withColumn("_n", F.size(ring))
        w, h = F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")
        row = shapes.agg(F.count("*").alias("n"), F.sum("_n").alias("edges"), F.avg(w).alias("w"), F.avg(h).alias("h"), F.avg(w * h).alias("wh"), F.min("x_min").alias("x"), F.min("y_min").alias("y")).first()
        self.empty = not row["n"]
        if self.empty:
            return
        cover = max(COVER, LEAST_COVER / row["n"], row["edges"] / row["n"])
        longer = math.sqrt((row["wh"] / (row["w"] * row["h"]) if row["w"] * row["h"] > 0 else 1.0) / cover)
        self.wx, self.wy = (v * longer if v > 0 else 1.0 for v in (row["w"], row["h"]))
        self.ox, self.oy = row["x"] - 0.6180339887498949 * self.wx, row["y"] - 0.6180339887498949 * self.wy
        # Equal rows are one shape here and so many in the end.
        named = polys.filter(F.size(ring) > 0).groupBy(*polys.columns).agg(F.count("*").alias("_times")).withColumn("_key", F.xxhash64(*[F.col(f"`{c}`") for c in polys.columns]))
        self.cells, self.small = self._cells(named, ring)

    def at(self, v: Column, axis: str) -> Column:
        return F.floor((v - (self.ox if axis == "x" else self.oy)) / (self.wx if axis == "x" else self.wy))

    def corner(self, b: Column, axis: str) -> Column:
        return F.lit(self.ox if axis == "x" else self.oy) + b * (self.wx if axis == "x" else self.wy)

    def _cells(self, named: DataFrame, ring: str) -> tuple[DataFrame, bool]:
        edges = named.select("_key", F.inline(_edges(ring)))
        low = lambda axis: F.least(axis + "1", axis + "2")
        high = lambda axis: F.greatest(axis + "1", axis + "2")
        span = lambda axis: (self.at(low(axis), axis), self.at(high(axis), axis))
        met = edges.select("*", F.explode(F.sequence(*span("x"))).alias("bx")).select("*", F.explode(F.sequence(*span("y"))).alias("by"))
        x0, y0 = self.corner(F.col("bx"), "x"), self.corner(F.col("by"), "y")
        side = lambda x, y: (F.col("x2") - F.col("x1")) * (y - F.col("y1")) - (F.col("y2") - F.col("y1")) * (x - F.col("x1"))
        sides = F.array(side(x0, y0), side(x0 + self.wx, y0), side(x0, y0 + self.wy), side(x0 + self.wx, y0 + self.wy))
        near = 1e-9 * (F.abs(F.col("x2") - F.col("x1")) + self.wx) * (F.abs(F.col("y2") - F.col("y1")) + self.wy)
        touching = met.filter((F.array_min(sides) <= near) & (F.array_max(sides) >= -near))
        of_cell = touching.groupBy("_key", "bx", "by").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_edges"))
        # The places at which a row's lower line crosses the polygon.
        lines = edges.select("*", F.explode(F.sequence(*span("y"))).alias("by")).withColumn("_y", self.corner(F.col("by"), "y"))
        e = {c: F.col(c) for c in ("x1", "y1", "x2", "y2")}
        crossed = lines.filter((F.col("y1") > F.col("_y")) != (F.col("y2") > F.col("_y"))).groupBy("_key", "by").agg(F.collect_list(_x_at(e, F.col("_y"))).alias("_xs"))
        bounds = polygon_stats(named, ring)
        box = bounds.select("_key", *[f(F.col(f"{v}_{end}"), v).alias(f"{end}_{v}") for v in "xy" for end in ("min", "max") for f in (self.at,)])
        rows = box.select("_key", "min_x", "max_x", F.explode(F.sequence("min_y", "max_y")).alias("by")).join(crossed, ["_key", "by"], "left")
        every = rows.select("_key", "by", "_xs", F.explode(F.sequence("min_x", "max_x")).alias("bx"))
        odd = F.coalesce(F.size(F.filter("_xs", lambda v: v > self.corner(F.col("bx"), "x"))) % 2 == 1, F.lit(False))
        cells = every.select("_key", "bx", "by", odd.alias("_odd")).join(of_cell, ["_key", "bx", "by"], "left")
        cells = cells.filter(F.col("_odd") | F.col("_edges").isNotNull()).withColumn("_edges", F.coalesce("_edges", F.array().cast(_EDGE_TYPE)))
        cells = cells.join(named.select("_key", "_times", *self.columns), "_key")
        width = lambda axis: self.at(high(axis), axis) - self.at(low(axis), axis) + 1
        most = edges.agg(F.sum(width("x") * width("y"))).first()[0] * 40 + box.agg(F.sum((F.col("max_x") - F.col("min_x") + 1) * (F.col("max_y") - F.col("min_y") + 1))).first()[0] * 100
        return cells.drop("_key"), most <= SMALL_COVER

    def of(self, x: Column, y: Column) -> Column:
        """Whether a point is inside the polygon of a cell that holds it."""
        x0, y0 = self.corner(F.col("bx"), "x"), self.corner(F.col("by"), "y")

        def crosses(e: Column) -> Column:
            up = ((e["x1"] > x0) != (e["x2"] > x0)) & (_y_at(e, x0) > y0) & (_y_at(e, x0) <= y)
            over = ((e["y1"] > y) != (e["y2"] > y)) & (_x_at(e, y) > x0) & (_x_at(e, y) <= x)
            one = lambda c: F.when(c, 1).otherwise(0)
            return one(up) + one(over)

        return (F.aggregate("_edges", F.lit(0), lambda a, e: a + crosses(e)) % 2 == 1) != F.col("_odd")


def pip_join(points: DataFrame, polys: DataFrame, how: str = "inner", x: str = "X", y: str = "Y") -> DataFrame:
    """Points with the columns of the polygon that holds them; `left` keeps the points that none holds.

    Polygons of a few corners in all are sent to the points as whole rings, by buckets. Otherwise points meet the cells
    of a `Cover`, which is broadcast if it is measured small, and joined by cell if it is not.
    """
    corners = polys.agg(F.sum(F.size("ring"))).first()[0] or 0
    if 0 < corners <= FEW_CORNERS:
        shapes = polygon_stats(polys)
        sides = _sides(shapes)
        left, right = _bucketed(points, sides, x, y), F.broadcast(_covered(shapes, sides).select("bx", "by", *polys.columns))
        return left.join(right, (left["bx"] == right["bx"]) & (left["by"] == right["by"]) & inside("ring", F.col(x), F.col(y)), how).drop("bx", "by", "ring")
    cover = Cover(polys)
    if cover.empty:
        none = points.select("*", *[F.lit(None).cast(polys.schema[c].dataType).alias(c) for c in cover.columns])
        return none if how == "left" else none.limit(0)
    left = points.withColumns({"_bx": cover.at(F.col(x), "x"), "_by": cover.at(F.col(y), "y")})
    right = F.broadcast(cover.cells) if cover.small else cover.cells
    met = left.join(right, (F.col("_bx") == F.col("bx")) & (F.col("_by") == F.col("by")) & cover.of(left[x], left[y]), how)
    if cover.cells.agg(F.max("_times")).first()[0] != 1:
        met = met.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.coalesce("_times", F.lit(1)).cast("int")))).drop("_copy")
    return met.drop("_bx", "_by", "bx", "by", "_odd", "_edges", "_times")


def rect_join(points: DataFrame, cells: DataFrame, x: str = "X", y: str = "Y", x_end: float = 1.0, y_end: float = 1.0) -> DataFrame:
    """Points with the columns of the rectangle that holds them: half-open, but closed at the domain's end."""
    sides = _sides(cells)
    left = _bucketed(points, sides, x, y)
    right = _covered(cells, sides).drop("wx", "wy")
    below = lambda v, top, end: (F.col(v) < right[top]) | ((F.col(v) == right[top]) & (right[top] >= end))
    hit = (F.col(x) >= right["x_min"]) & below(x, "x_max", x_end) & (F.col(y) >= right["y_min"]) & below(y, "y_max", y_end)
    return left.join(right, (left["bx"] == right["bx"]) & (left["by"] == right["by"]) & hit).drop("bx", "by", "x_min", "x_max", "y_min", "y_max")


def coverage_errors(points: DataFrame, joined: DataFrame, key: str = "point_id") -> DataFrame:
    """Points that are in no polygon, or in more than one."""
    hits = joined.groupBy(key).agg(F.count("*").alias("hits"))
    return points.select(key).join(hits, key, "left").select(key, F.coalesce("hits", F.lit(0)).alias("hits")).filter("hits != 1")


def clip_to_domain(points: DataFrame, polys: DataFrame, key: str = "point_id", x: str = "X", y: str = "Y") -> DataFrame:
    """The points inside any of the polygons, each once."""
    held = pip_join(points.select(key, x, y), polys, x=x, y=y).select(key)
    return points.join(held, key, "left_semi")


def _clipped_area(ring: str, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Area of a ring within a rectangle.

    Each edge adds the area below it, held to the rectangle's height, over its stretch between x0 and x1;
    edges that run back subtract.
    """
    held = lambda v, low, high: F.greatest(low, F.least(v, high))
    # The integral of a height that is held between 0 and the rectangle's, from its lower side up to y.
    below = lambda y: F.pow(held(y, y0, y1) - y0, 2) / 2 + F.greatest(y - y1, F.lit(0.0)) * (y1 - y0)

    def under(a: Column, i: Column) -> Column:
        b = _next(ring, i)
        run = b["x"] - a["x"]
        at = lambda x: a["y"] + F.coalesce(F.try_divide(x - a["x"], run), F.lit(0.0)) * (b["y"] - a["y"])
        begin, end = held(a["x"], x0, x1), held(b["x"], x0, x1)
        p, q = at(begin), at(end)
        flat = F.abs(q - p) <= 1e-7 * (y1 - y0)
        mean = F.when(flat, held((p + q) / 2, y0, y1) - y0).otherwise(F.try_divide(below(q) - below(p), q - p))
        return F.when(begin == end, F.lit(0.0)).otherwise(mean * (end - begin))

    return F.abs(F.aggregate(F.transform(ring, under), F.lit(0.0), lambda acc, v: acc + v))


def overlay_polygons(grid: DataFrame, polys: DataFrame, least: float = 1e-10) -> DataFrame:
    """cell_id, poly_id, area of the common part of each grid cell and polygon; slivers are dropped."""
    near = _touching(grid, polygon_stats(polys).select("poly_id", "ring", *(F.col(c).alias("p_" + c) for c in ("x_min", "x_max", "y_min", "y_max"))))
    area = _clipped_area("ring", *(F.col(c) for c in ("x_min", "x_max", "y_min", "y_max")))
    return near.select("cell_id", "poly_id", area.alias("area")).filter(F.col("area") >= least)


def _touching(grid: DataFrame, other: DataFrame) -> DataFrame:
    """Pairs of cells and shapes whose bounds overlap; each pair once, in the bucket of its lower corner."""
    sides = _sides(grid)
    low_x, low_y = F.greatest("x_min", "p_x_min"), F.greatest("y_min", "p_y_min")
    both = _covered(grid, sides).join(_covered(other, sides, "p_").drop("wx", "wy"), ["bx", "by"])
    own = (_bucket(low_x, "wx") == F.col("bx")) & (_bucket(low_y, "wy") == F.col("by"))
    return both.filter(own & (low_x <= F.least("x_max", "p_x_max")) & (low_y <= F.least("y_max", "p_y_max"))).drop("wx", "wy")


def overlay_rectangles(grid: DataFrame, cells: DataFrame, key: str = "cov_id", least: float = 1e-10) -> DataFrame:
    """cell_id, the key and area of the common part of each grid cell and rectangle."""
    near = _touching(grid, cells.select(key, *(F.col(c).alias("p_" + c) for c in ("x_min", "x_max", "y_min", "y_max"))))
    side = lambda v: F.greatest(F.lit(0.0), F.least(v + "_max", f"p_{v}_max") - F.greatest(v + "_min", f"p_{v}_min"))
    return near.select("cell_id", key, (side("x") * side("y")).alias("area")).filter(F.col("area") >= least)


def cells_in_domain(grid: DataFrame, polys: DataFrame, touching: bool = False) -> DataFrame:
    """Grid cells that overlap a polygon; with `touching`, those of zero common area too."""
    least = -1.0 if touching else 1e-10
    return grid.join(overlay_polygons(grid, polys, least).select("cell_id").distinct(), "cell_id", "left_semi")


def nearest_index(points: DataFrame, grid: DataFrame, keys: tuple[str, ...], key: str = "point_id", idx: str = "idx", small: int = SMALL) -> DataFrame:
    """The nearest grid point of each row, the lower index on ties; in one to three dimensions, for grids of any size.

    A grid of up to `small` rows is sent to the points as an array. A larger one meets them by tiles, see `nearest.by_tiles`.
    Rows of a coordinate that is null or NaN have no answer, and such grid points are none.
    """
    if not 1 <= len(keys) <= 3:
        raise ValueError("one to three coordinates")
    ok = " and ".join(f"not isnan({k}) and {k} is not null" for k in keys)
    points, grid = points.filter(ok).select(key, *keys), grid.filter(ok).select(F.col(idx).alias("_idx"), *keys)
    if grid.limit(small + 1).count() > small:
        places = [F.col(k).cast("double").alias(k) for k in keys]
        return by_tiles(points.select(key, *places), grid.select("_idx", *places), keys, key)
    whole = grid.agg(F.collect_list(F.struct("_idx", *keys)).alias("_grid"))
    distance = lambda g: sum((F.pow(F.col(k) - g[k], 2) for k in keys), F.lit(0.0))
    best = F.array_min(F.transform("_grid", lambda g: F.struct(distance(g).alias("d"), g["_idx"].alias("idx"))))["idx"]
    return points.crossJoin(F.broadcast(whole)).select(key, best.alias("idx"))  # one row of `small` points at most


def require_same_srid(a: int, b: int) -> None:
    if a != b:
        raise ValueError(f"spatial references differ: {a} and {b}")
