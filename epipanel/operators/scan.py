"""Recursions along a series as scans of affine maps.

A recursive mean moves by ``m -> a * m + b`` from row to row. Such maps compose to one of the same kind, so the series is cut into blocks:
rows compose within their block, blocks within a block of blocks, and those over the series. A row holds at most ``BLOCK`` maps of
its block, ``BLOCK`` of the block of blocks, and one for each ``BLOCK**2`` rows before: ten at ten thousand rows, not ten thousand. All
windows share the shuffle by the series' keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 32


def _composed(maps: Column) -> Column:
    """The map of a list of maps, the first applied first."""
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    return F.aggregate(maps, start, lambda s, m: F.struct((m["a"] * s["a"]).alias("a"), (m["a"] * s["b"] + m["b"]).alias("b")))


def affine_scan(df: DataFrame, keys: Sequence[str], order: str, maps: dict[str, tuple[Column, Column]], start: float = 0.0) -> DataFrame:
    """Add a column per entry of ``maps``: the value after the row's map ``(a, b)``, from ``start`` before the first row.

    A map with a null part leaves the value as it is. Rows of a series with equal ``order`` come in any order.
    """
    out, names = df, list(maps)
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    identity = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    out = out.withColumns({f"_map_{n}": F.when(a.isNotNull() & b.isNotNull(), F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"))).otherwise(
        identity) for n, (a, b) in maps.items()})
    out = out.withColumn("_row", row).withColumns({
        "_block": F.floor(F.col("_row") / BLOCK).cast("int"), "_group": F.floor(F.col("_row") / (BLOCK * BLOCK)).cast("int")})
    block = Window.partitionBy(*keys, "_block").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({f"_in_{n}": _composed(F.collect_list(f"_map_{n}").over(block)) for n in names})
    # only a block's last row stands for the block
    ends = F.col("_row") % BLOCK == BLOCK - 1
    group = Window.partitionBy(*keys, "_group").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumns({f"_of_{n}": _composed(F.collect_list(F.when(ends, F.col(f"_in_{n}"))).over(group)) for n in names})
    last = F.col("_row") % (BLOCK * BLOCK) == BLOCK * BLOCK - 1
    whole = Window.partitionBy(*keys).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumns({f"_up_{n}": _composed(F.collect_list(F.when(last, _composed(F.array(f"_of_{n}", f"_in_{n}")))).over(whole)) for n in names})
    value = {n: _composed(F.array(f"_up_{n}", f"_of_{n}", f"_in_{n}")) for n in names}
    out = out.withColumns({n: v["a"] * start + v["b"] for n, v in value.items()})
    return out.drop("_row", "_block", "_group", *[f"_{k}_{n}" for n in names for k in ("map", "in", "of", "up")])
