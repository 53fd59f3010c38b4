"""Quantiles of what a series held before each of its rows.

Per row the values so far, sorted, would cost T² work and memory per series. Here each series is laid out once as a wavelet matrix:
its ranks are split bit by bit, stably, with a running count of zeros per bit. The value of any rank among any stretch of the
series is then found in log T look-ups, for all rows and levels at once. A series is one row while that is done, as long as the
calendar; series are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epipanel.schema import spread


class Order:
    """Order statistics of any stretch of ``values``."""

    def __init__(self, values: np.ndarray):
        self.sorted = np.sort(values, kind="stable")
        ranks = np.empty(len(values), "i8")
        ranks[np.argsort(values, kind="stable")] = np.arange(len(values))
        self.levels = []
        for bit in range(max(len(values) - 1, 0).bit_length() - 1, -1, -1):
            ones = (ranks >> bit) & 1
            zeros = np.append(0, np.cumsum(1 - ones))
            self.levels.append((bit, zeros))
            ranks = np.concatenate([ranks[ones == 0], ranks[ones == 1]])

    def at(self, start: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The ``k``-th smallest (from 0) of ``values[start:end]``, elementwise; 0 <= k < end - start."""
        start, end, k = (np.array(x, "i8") for x in np.broadcast_arrays(start, end, k))
        rank = np.zeros(k.shape, "i8")
        for bit, zeros in self.levels:
            lo, hi, all_zeros = zeros[start], zeros[end], zeros[-1]
            low = k < hi - lo
            rank += np.where(low, 0, 1 << bit)
            k = np.where(low, k, k - (hi - lo))
            start, end = np.where(low, lo, all_zeros + start - lo), np.where(low, hi, all_zeros + end - hi)
        return self.sorted[rank] if len(self.sorted) else np.zeros(k.shape)


def stretch_quantiles(values: np.ndarray, start: np.ndarray, end: np.ndarray, levels: Sequence[float], mirrored: bool = False) -> np.ndarray:
    """Interpolated quantiles of ``values[start:end]``, a row per stretch; NaN for empty ones.

    With ``mirrored`` the values are absolute and stand for themselves and their negatives.
    """
    order, n = Order(values), (end - start)[:, None]
    count = n * 2 if mirrored else n
    place = np.asarray(levels, "f8")[None, :] * (count - 1)
    some = np.broadcast_to(n > 0, place.shape)

    def at(i: np.ndarray) -> np.ndarray:
        i = np.where(some, i, 0).astype("i8")
        k = np.where(i < n, n - 1 - i, i - n) if mirrored else i
        found = order.at(start[:, None], np.maximum(end[:, None], start[:, None] + 1) if len(values) else end[:, None], np.where(some, k, 0)) if len(values) else np.zeros(place.shape)
        return np.where(i < n, -found, found) if mirrored else found

    low, high = at(np.floor(place)), at(np.ceil(place))
    return np.where(some, low + (high - low) * (place - np.floor(place)), np.nan)


def _history(series: pa.Array, places: pa.Array, levels: Sequence[float], before: bool, most: int | None, mirrored: bool) -> pa.Array:
    """Per series of a batch a list of ``q`` and ``n`` for each of its rows; the numbers stay in flat arrays."""
    ends = np.append(0, np.cumsum(pc.list_value_length(series).to_numpy(zero_copy_only=False))).astype("i4")
    all_values = pc.cast(series.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    all_places = places.flatten().to_numpy(zero_copy_only=False)
    found, counts = np.empty((len(all_values), len(levels))), np.zeros(len(all_values), "i4")
    for lo, hi in zip(ends[:-1], ends[1:]):
        v, t = all_values[lo:hi], all_places[lo:hi]
        known = ~np.isnan(v)
        seen = np.append(0, np.cumsum(known))
        # rows of equal order are no history of each other
        end = seen[np.searchsorted(t, t, "left")] if before else seen[np.arange(1, len(v) + 1)]
        start = np.zeros(len(v), "i8") if most is None else np.maximum(end - most, 0)
        found[lo:hi], counts[lo:hi] = stretch_quantiles(v[known], start, end, levels, mirrored), end - start
    some = counts > 0
    # a row without history has a null list
    marks = np.append(0, np.cumsum(np.where(some, len(levels), 0))).astype("i4")
    lists = pa.ListArray.from_arrays(pa.array(marks), pa.array(found[some].ravel()), mask=pa.array(~some))
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([lists, pa.array(counts)], ["q", "n"]))


def add_history_quantiles(df: DataFrame, keys: Sequence[str], order: str, value: str | Column, levels: Sequence[float], name: str, before: bool = False,
                          most: int | None = None, mirrored: bool = False, rows: int | None = 0) -> DataFrame:
    """Add ``name``: quantiles at ``levels`` of the series' values up to each row (strictly ``before`` it, by ``order``); null without values.

    Null values do not count; with ``most`` only the last so many that do. ``<name>_n`` says how many there were. ``rows`` is what the
    result grows to, see :func:`spread`; None when ``df`` lies by ``keys`` already.
    """
    levels, keys = list(levels), list(keys)

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("q", T.ArrayType(T.DoubleType())), T.StructField("n", T.IntegerType())])))
    def quantiles(series: pa.Array, places: pa.Array) -> pa.Array:
        return _history(series, places, levels, before, most, mirrored)

    value = F.col(value) if isinstance(value, str) else value
    others = [c for c in df.columns if c not in keys]
    place = F.unix_date(order) if df.schema[order].dataType == T.DateType() else F.col(order).cast("long")
    cell = F.struct(F.col(order).alias("_o"), place.alias("_t"), value.cast("double").alias("_v"), F.struct(*others).alias("_row"))
    placed = df if rows is None else spread(df, *keys, rows=rows)
    packed = placed.groupBy(*keys).agg(F.array_sort(F.collect_list(cell), lambda a, b: F.when(a["_t"] < b["_t"], -1).when(a["_t"] > b["_t"], 1).otherwise(0)).alias("_s"))
    packed = packed.withColumn("_found", quantiles(F.transform("_s", lambda c: c["_v"]), F.transform("_s", lambda c: c["_t"])))
    cells = packed.select(*keys, F.explode(F.arrays_zip(F.col("_s._row").alias("r"), F.col("_found").alias("f"))).alias("_c"))
    out = cells.select(*keys, "_c.r.*", F.col("_c.f.q").alias(name), F.col("_c.f.n").alias(f"{name}_n"))
    return out.select(*[F.col(c).alias(c, metadata=df.schema[c].metadata) for c in df.columns], name, f"{name}_n")
