"""Point in polygon as an equi-join.

A polygon is a row ``(geoid, ring array<struct<lon, lat>>)``. A polygon is cut into grid cells of a
size that fits it, so a very large one has no more cells than a small one. Cells outside the shape are dropped, cells inside it
need no test, and only for cells on its border does the ring decide; it is fetched by id then and not repeated per cell. A point on a border belongs to
the polygon whose ring reports it, the smallest geoid winning where several do.
Each pair of coordinates is looked up once, however many points share it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindermap.operators.relate import skew_join
from cindermap.session import materialize


def ring_bounds(ring: Column) -> dict[str, Column]:
    lon = F.transform(ring, lambda p: p["lon"])
    lat = F.transform(ring, lambda p: p["lat"])
    return {"x0": F.array_min(lon), "x1": F.array_max(lon), "y0": F.array_min(lat), "y1": F.array_max(lat)}


def contains(ring: Column, lon: Column, lat: Column) -> Column:
    """The point lies inside the ring or on its border. The ring need not repeat its first point."""
    edges = _edges(ring)

    def crosses(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["lon"], e["a"]["lat"], e["b"]["lon"], e["b"]["lat"]
        at = F.try_divide((bx - ax) * (lat - ay), by - ay) + ax
        return ((ay > lat) != (by > lat)) & (lon < at)

    def touches(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["lon"], e["a"]["lat"], e["b"]["lon"], e["b"]["lat"]
        straight = (bx - ax) * (lat - ay) == (by - ay) * (lon - ax)
        within = lon.between(F.least(ax, bx), F.greatest(ax, bx)) & lat.between(F.least(ay, by), F.greatest(ay, by))
        return straight & within

    crossings = F.aggregate(
        edges, F.lit(0), lambda n, e: n + F.when(F.coalesce(crosses(e), F.lit(False)), F.lit(1)).otherwise(F.lit(0))
    )
    return F.exists(edges, touches) | (F.pmod(crossings, F.lit(2)) == 1)


def _edges(ring: Column) -> Column:
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, following, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _meets(edge: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """An edge touches the rectangle: their boxes overlap, and the corners are not all on one side of the edge's line."""
    ax, ay, bx, by = edge["a"]["lon"], edge["a"]["lat"], edge["b"]["lon"], edge["b"]["lat"]
    overlap = (F.least(ax, bx) <= x1) & (F.greatest(ax, bx) >= x0) & (F.least(ay, by) <= y1) & (F.greatest(ay, by) >= y0)
    sides = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x in (x0, x1) for y in (y0, y1)]
    return overlap & ~((F.least(*sides) > 0) | (F.greatest(*sides) < 0))


ACROSS = 8  # cells of a polygon's level along the longer side of its box, about


def shape_cells(polygons: DataFrame, cell: float) -> DataFrame:
    """(__geoid, level, cx, cy, inner): the grid cells of every polygon, of size ``cell * 2^level``; at most about ``(ACROSS + 2)^2`` each.

    A cell that no edge touches lies wholly inside or outside, as its middle does; those outside are left out.
    """
    boxed = polygons.select(F.col("geoid").alias("__geoid"), "ring", *[c.alias(n) for n, c in ring_bounds(F.col("ring")).items()]).filter(F.size("ring") > 0)
    span = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(span, F.lit(cell)) / F.lit(cell * ACROSS)))).cast("int")
    sized = boxed.withColumn("level", level).withColumn("size", F.lit(cell) * F.pow(F.lit(2.0), F.col("level")))
    steps = lambda lo, hi: F.sequence(F.floor(F.col(lo) / F.col("size")), F.floor(F.col(hi) / F.col("size")))
    celled = sized.withColumn("cx", F.explode(steps("x0", "x1"))).withColumn("cy", F.explode(steps("y0", "y1")))
    # a little more than the cell, so that rounding makes border cells and never inner ones
    slack = F.col("size") * F.lit(1e-9)
    x, y = F.col("cx") * F.col("size"), F.col("cy") * F.col("size")
    border = F.exists(_edges(F.col("ring")), lambda e: _meets(e, x - slack, y - slack, x + F.col("size") + slack, y + F.col("size") + slack))
    half = F.col("size") / 2
    marked = celled.withColumn("border", border).filter(F.col("border") | contains(F.col("ring"), x + half, y + half))
    return marked.select("__geoid", "level", "cx", "cy", (~F.col("border")).alias("inner"))


def assign_polygon(
    points: DataFrame,
    polygons: DataFrame,
    lon: str = "lon",
    lat: str = "lat",
    cell: float = 0.1,
    out: str = "geoid",
) -> DataFrame:
    """Attach the polygon id to every point; points outside all polygons or without coordinates get NULL.

    The answer depends on the coordinates alone, so no column needs to identify a point.

    ``cell`` is the smallest grid step in degrees; a polygon takes the level that suits its size. Each place is looked up once on every level in
    use (their number grows with the logarithm of the largest polygon). A cell with a large share of the points, or a polygon with
    a large share of the border cells, is spread over several tasks.
    """
    placed = points.withColumns({"__x": F.col(lon).cast("double"), "__y": F.col(lat).cast("double")})
    located = placed.select("__x", "__y").filter(F.col("__x").isNotNull() & F.col("__y").isNotNull()).distinct()
    cells = materialize(shape_cells(polygons, float(cell)), "cells")
    levels = sorted(r[0] for r in cells.select("level").distinct().collect())
    sizes = [F.struct(F.lit(k).alias("level"), F.floor(F.col("__x") / F.lit(cell * 2.0**k)).alias("cx"), F.floor(F.col("__y") / F.lit(cell * 2.0**k)).alias("cy")) for k in levels]
    if not sizes:
        return points.withColumn(out, F.lit(None).cast(polygons.schema["geoid"].dataType))
    asked = located.select("__x", "__y", F.explode(F.array(*sizes)).alias("c")).select("__x", "__y", "c.*")
    near = materialize(skew_join(asked, cells, ["level", "cx", "cy"], "inner").select("__x", "__y", "__geoid", "inner"), "near")
    rings = polygons.select(F.col("geoid").alias("__geoid"), "ring")
    tested = skew_join(near.filter(~F.col("inner")), rings, "__geoid", "inner").filter(contains(F.col("ring"), F.col("__x"), F.col("__y")))
    inside = near.filter("inner").select("__x", "__y", "__geoid").union(tested.select("__x", "__y", "__geoid"))
    found = inside.groupBy("__x", "__y").agg(F.min("__geoid").alias(out))
    return skew_join(placed, found, ["__x", "__y"], "left", probe=placed.select("__x", "__y")).select(*points.columns, out)


def attach_scores(polygons: DataFrame, scores: DataFrame, score_key: str) -> DataFrame:
    """Scores onto shapes by geoid; shapes without a score stay."""
    return polygons.join(scores.withColumnRenamed(score_key, "geoid"), "geoid", "left")
