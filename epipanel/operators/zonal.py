"""Gridded values to regions: containment, zonal statistics, adjacency, hexagons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epipanel.functions.hexgrid import hex_column_row, hex_id
from epipanel.schema import DATE, GID_2, require_columns


def edges(vertices: DataFrame) -> DataFrame:
    """Polygon edges from the vertices ``GID_2, ring, seq, x, y``; rings close themselves."""
    require_columns(vertices, [GID_2, "ring", "seq", "x", "y"])
    w = Window.partitionBy(GID_2, "ring").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    return vertices.select(
        GID_2, "ring", F.col("x").alias("x1"), F.col("y").alias("y1"),
        nxt("x").alias("x2"), nxt("y").alias("y2"))


def boxes(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy(GID_2).agg(
        F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"))


def _tiles(lo: Column, hi: Column, size: float) -> Column:
    return F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size)))


def locate_points(points: DataFrame, vertices: DataFrame, tile: float = 1.0) -> DataFrame:
    """Distinct points (``x, y``) with the regions that contain them.

    Points meet the boxes of regions by map tile, then the region's edges in
    their own band of ``y``; an odd number of edges to the right means inside.
    Edges are half open, so a point on a shared border has one region.
    ``tile`` should be about the size of a region.
    """
    spots = points.select("x", "y").distinct()
    box = boxes(vertices)
    box = box.withColumn("_tx", _tiles(F.col("xmin"), F.col("xmax"), tile))
    box = box.withColumn("_ty", _tiles(F.col("ymin"), F.col("ymax"), tile))
    tiled = spots.withColumns({"_tx": F.floor(F.col("x") / tile), "_ty": F.floor(F.col("y") / tile)})
    near = tiled.join(box, ["_tx", "_ty"]).where(
        F.col("x").between(F.col("xmin"), F.col("xmax")) & F.col("y").between(F.col("ymin"), F.col("ymax")))
    sides = edges(vertices).where(F.col("y1") != F.col("y2"))
    banded = sides.withColumn("_ty", _tiles(F.least("y1", "y2"), F.greatest("y1", "y2"), tile))
    crosses = (
        ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y")))
        & (F.col("x") < F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    )
    hits = near.select("x", "y", GID_2, "_ty").join(banded.drop("ring"), [GID_2, "_ty"]).where(crosses)
    return hits.groupBy("x", "y", GID_2).agg(F.count("*").alias("_n")).where("_n % 2 = 1").drop("_n")


def zonal_stats(cells: DataFrame, vertices: DataFrame, tile: float = 1.0) -> DataFrame:
    """Mean and sum of cell values per region, date and metric.

    Each distinct cell place is located once, whatever the number of dates.
    """
    require_columns(cells, ["metric", DATE, "x", "y", "value"])
    where = locate_points(cells, vertices, tile)
    return cells.join(where, ["x", "y"]).groupBy(GID_2, DATE, "metric").agg(
        F.avg("value").alias("mean"), F.sum("value").alias("sum"))


def measured(stats: DataFrame) -> DataFrame:
    """Statistics with a mean; a missing sum counts as 0."""
    return stats.where(F.col("mean").isNotNull()).withColumn("sum", F.coalesce("sum", F.lit(0.0)))


def neighbours(vertices: DataFrame, digits: int = 6) -> DataFrame:
    """Pairs of regions whose boundaries share a vertex, both ways round."""
    corner = vertices.select(GID_2, F.round("x", digits).alias("_x"), F.round("y", digits).alias("_y")).distinct()
    other = corner.withColumnRenamed(GID_2, "neighbour")
    pairs = corner.join(other, ["_x", "_y"]).where(F.col(GID_2) != F.col("neighbour"))
    return pairs.select(GID_2, "neighbour").distinct()


def centroids(vertices: DataFrame) -> DataFrame:
    """Area centroid of each region (holes wind the other way)."""
    e = edges(vertices)
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    sums = e.groupBy(GID_2).agg(
        F.sum(cross).alias("a"), F.sum((F.col("x1") + F.col("x2")) * cross).alias("sx"),
        F.sum((F.col("y1") + F.col("y2")) * cross).alias("sy"))
    return sums.select(GID_2, (F.col("sx") / (3 * F.col("a"))).alias("x"), (F.col("sy") / (3 * F.col("a"))).alias("y"))


def _origin(vertices: DataFrame) -> Column:
    return vertices.agg(F.struct(F.min("x").alias("x"), F.min("y").alias("y"))).scalar()


def hex_of_points(points: DataFrame, origin: Column, side: float) -> DataFrame:
    """Points with the hexagon that holds them."""
    col, row = hex_column_row(F.col("x") - F.col("_o.x"), F.col("y") - F.col("_o.y"), side)
    return points.withColumn("_o", origin).withColumn("hex_id", hex_id(col, row)).drop("_o")


def hex_by_centroid(values: DataFrame, vertices: DataFrame, side: float, column: str) -> DataFrame:
    """Mean value of the regions whose centroid falls into a hexagon."""
    placed = hex_of_points(centroids(vertices), _origin(vertices), side)
    return placed.join(values.select(GID_2, column), GID_2).groupBy("hex_id").agg(F.avg(column).alias(column))


def hex_by_area(values: DataFrame, vertices: DataFrame, cells: DataFrame, side: float, column: str,
                tile: float = 1.0) -> DataFrame:
    """Area-weighted mean per hexagon, areas measured in equal cells.

    ``cells`` samples the map evenly; a region weighs as many cells as it
    shares with the hexagon.
    """
    located = hex_of_points(locate_points(cells, vertices, tile), _origin(vertices), side)
    shares = located.groupBy("hex_id", GID_2).agg(F.count("*").alias("_n"))
    return shares.join(values.select(GID_2, column), GID_2).where(F.col(column).isNotNull()).groupBy("hex_id").agg(
        (F.sum(F.col(column) * F.col("_n")) / F.sum("_n")).alias(column))
