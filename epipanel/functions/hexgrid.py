"""Flat-top hexagon grid: columns 1.5 sides apart, odd columns half a step up."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_column_row(x: Column, y: Column, side: float) -> tuple[Column, Column]:
    """Column and row of the hexagon that holds a point (origin at a hexagon centre)."""
    q = x * (2.0 / (3.0 * side))
    r = y / (math.sqrt(3.0) * side) - q / 2
    s = -q - r
    rq, rr, rs = F.round(q), F.round(r), F.round(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    # of the three rounded coordinates the one that moved most follows from the others
    q_far = (dq > dr) & (dq > ds)
    r_far = ~q_far & (dr > ds)
    col = F.when(q_far, -rr - rs).otherwise(rq).cast("long")
    axial = F.when(r_far, -rq - rs).otherwise(rr).cast("long")
    row = axial + F.floor(col / 2)
    return col, row.cast("long")


def hex_centre(col: Column, row: Column, side: float) -> tuple[Column, Column]:
    """Centre of a hexagon relative to the origin."""
    dy = math.sqrt(3.0) * side
    return col * (1.5 * side), row * dy + F.pmod(col, F.lit(2)) * (dy / 2)


def hex_id(col: Column, row: Column) -> Column:
    return F.concat(F.lit("h_"), col.cast("string"), F.lit("_"), row.cast("string"))
