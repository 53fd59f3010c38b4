"""Weighted ensembles of quantile forecasts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epipanel.operators.calibrate import lift_tiny_violations
from epipanel.schema import CASES, DATE, GID_2, HORIZON, MODEL, PREDICTION, QUANTILE, spread
from epipanel.sources.stage import stage

# differences of mean losses and slopes up to this are rounding
NOISE = 1e-8
# points that a block of forecasts is scored at in one go, and sums that a task holds before it hands them on
POINTS, HELD = 64, 500_000
LEVELS = 62  # levels that are made columns of a forecast; with more, each is a row
CUT = 1024  # rows scored at a time, so that what is computed stays in a core's cache


def stack_models(forecasts: dict[str, DataFrame] | Sequence[DataFrame]) -> DataFrame:
    """One table of several forecasts with a ``model`` column (``model_0``, ... without names)."""
    if not isinstance(forecasts, dict):
        forecasts = {f"model_{i}": f for i, f in enumerate(forecasts)}
    out = None
    for name, df in forecasts.items():
        tagged = df.withColumn(MODEL, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def stack_horizons(forecasts: dict[int, DataFrame]) -> DataFrame:
    """One table of single-horizon forecasts with a ``horizon`` column."""
    out = None
    for h, df in forecasts.items():
        tagged = df.withColumn(HORIZON, F.lit(h))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def _by(df: DataFrame) -> list[str]:
    return [HORIZON] if HORIZON in df.columns else []


def in_all_models(df: DataFrame, column: str, n_models: int) -> DataFrame:
    """Values of ``column`` that every model has (per horizon)."""
    return (
        df.groupBy(*_by(df), column).agg(F.count_distinct(MODEL).alias("_n"))
        .where(F.col("_n") == n_models).drop("_n")
    )


def common_part(df: DataFrame, n_models: int) -> DataFrame:
    """Rows whose quantile level and date every model has.

    Levels and dates are few and stored first: of a known size they are broadcast, and the forecasts are not shuffled for them.
    """
    for column in (QUANTILE, DATE):
        df = df.join(stage(in_all_models(df, column, n_models)), [*_by(df), column], "left_semi")
    return df


def common_regions(df: DataFrame, n_models: int) -> DataFrame:
    """Rows of the regions every model has."""
    return df.join(in_all_models(df, GID_2, n_models), [*_by(df), GID_2], "left_semi")


def _wide(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """A row per forecast and level with all models' predictions, by one shuffle, as a stored table.

    ``_in``: a bit per model that has the row. ``_p``: each model's largest prediction, of rows with a prediction and a truth, ``_y``
    their truth. ``_s`` (sum of a model's predictions) and ``_f`` (the first model's largest), of all its rows, are null where
    ``_p`` says the same, ``_y`` where ``Cases`` (the first model's) does. :func:`_sum`, :func:`_lead` and :func:`_truth` read them.
    """
    by, n = _by(df), len(models)
    keys = [*by, GID_2, DATE]
    place = (F.array_position(F.array(*map(F.lit, models)), F.col(MODEL)) - 1).cast("int").alias("_m")
    rows = df.select(*keys, F.coalesce(place, F.lit(-1)).alias("_m"), QUANTILE, F.col(PREDICTION).cast("double").alias(PREDICTION), CASES)
    rows = spread(rows, *by, GID_2, rows=df.count())
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    of = lambda i, c: F.when(F.col("_m") == i, F.col(c))
    rows = rows.withColumn("_k", F.when(known(PREDICTION) & known(CASES), F.col(PREDICTION)))
    wide = rows.groupBy(*keys, QUANTILE).agg(
        F.bit_or(F.when(F.col("_m") >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_m"))).otherwise(F.lit(0).cast("long"))).alias("_in"),
        *[F.max(of(i, "_k")).alias(f"_p{i}") for i in range(n)], *[F.sum(of(i, PREDICTION)).alias(f"_s{i}") for i in range(n)],
        F.max(of(0, PREDICTION)).alias("_f"), F.max(of(0, CASES)).alias(CASES),
        F.max_by(F.col(CASES).cast("double"), F.when(F.col("_k").isNotNull() & (F.col("_m") >= 0), -F.col("_m"))).alias("_y"))
    other = lambda c, as_: F.when(~F.col(c).eqNullSafe(F.col(as_)), F.col(c)).alias(c)
    marked = [F.col(c).alias(c, metadata=df.schema[c].metadata) for c in (*keys, QUANTILE)]
    return stage(wide.select(
        *marked, "_in", *[f"_p{i}" for i in range(n)], *[other(f"_s{i}", f"_p{i}") for i in range(n)], other("_f", "_p0"), CASES,
        F.when(~F.col("_y").eqNullSafe(F.col(CASES).cast("double")), F.col("_y")).alias("_y")).sortWithinPartitions(*by, DATE))


def _sum(i: int) -> Column:
    return F.coalesce(F.col(f"_s{i}"), F.col(f"_p{i}"))


def _lead() -> Column:
    return F.coalesce(F.col("_f"), F.col("_p0"))


def _truth() -> Column:
    return F.coalesce(F.col("_y"), F.col(CASES).cast("double"))


def _common(wide: DataFrame, by: list[str], n: int) -> DataFrame:
    """:func:`common_part` of wide rows."""
    for column in (QUANTILE, DATE):
        everywhere = wide.groupBy(*by, column).agg(F.bit_or("_in").alias("_in")).where(F.col("_in") == (1 << n) - 1).drop("_in")
        wide = wide.join(stage(everywhere), [*by, column], "left_semi")
    return wide


def _blocks(wide: DataFrame, by: list[str], n: int) -> DataFrame:
    """Rows to learn from, in blocks of one horizon and one date ``_at`` from which on they count, as a stored table.

    ``_data`` holds level, truth and predictions of each row as doubles. Rows that a model lacks, of a region that it has, are a
    block without data (``_gap``).
    """
    any_known, all_known = F.lit(False), F.lit(True)
    for i in range(n):
        any_known, all_known = any_known | F.col(f"_p{i}").isNotNull(), all_known & F.col(f"_p{i}").isNotNull()
    rows = wide.where(any_known)
    # a region counts from the date on which every model has it; regions that all models have from their first date on need no mark
    firsts = [F.min(F.when(F.col(f"_p{i}").isNotNull(), F.col(DATE))) for i in range(n)]
    entry = rows.groupBy(*by, GID_2).agg(
        *[f.alias(f"_e{i}") for i, f in enumerate(firsts)], F.min(DATE).alias("_lo"), F.bool_or(F.col(DATE).isNull()).alias("_undated"))
    everyone = F.lit(True)
    for i in range(n):
        everyone = everyone & F.col(f"_e{i}").isNotNull()
    last = F.greatest(*[F.col(f"_e{i}") for i in range(n)]) if n > 1 else F.col("_e0")
    entry = entry.withColumn("_entry", F.when(everyone, last)).where(F.col("_entry").isNull() | (F.col("_entry") > F.col("_lo")) | F.col("_undated"))
    marks = stage(entry.select(*[F.col(c).alias(f"_of_{c}") for c in (*by, GID_2)], "_entry", F.lit(True).alias("_late")))
    same = F.lit(True)
    for c in (*by, GID_2):
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    rows = rows.join(marks, same, "left").where(F.col("_late").isNull() | F.col("_entry").isNotNull())
    rows = rows.select(*by, F.greatest(DATE, "_entry").alias("_at"), (~all_known).alias("_gap"), F.col(QUANTILE).cast("double").alias(QUANTILE),
                       _truth().alias("_y"), *[f"_p{i}" for i in range(n)])
    keys = [*by, "_at", "_gap"]
    values = [QUANTILE, "_y", *[f"_p{i}" for i in range(n)]]
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("_data", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [pc.fill_null(batch.column(k).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False) for k in keys]
            order = np.lexsort(codes)
            sorted_codes = np.stack(codes)[:, order]
            starts = np.flatnonzero(np.append(True, (sorted_codes[:, 1:] != sorted_codes[:, :-1]).any(0)))
            data = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype("f8") for c in values])[order]
            first = pa.array(order[starts])
            gaps = batch.column("_gap").take(first).to_pylist()
            parts = [None if gap else np.ascontiguousarray(part).tobytes() for gap, part in zip(gaps, np.split(data, starts[1:]))]
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(first) for k in keys], pa.array(parts, pa.binary())], schema.fieldNames())

    return stage(rows.mapInArrow(cut, schema))


def _scores(data: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Per point (row of weights) the loss, the number of rows, and the slope per model, summed over the rows of a block."""
    q, y, p = data[:, 0], data[:, 1], data[:, 2:]
    rows, leveled = len(q), ~np.isnan(q)
    if not leveled.all():  # rows without a level count, and have no loss
        q, y, p = q[leveled], y[leveled], p[leveled]
    out = np.zeros((len(points), 2 + p.shape[1]))
    ones = np.ones(CUT)
    for lo in range(0, len(q), CUT):
        some = slice(lo, lo + CUT)
        above, each = np.ascontiguousarray(1 - q[some]), np.ascontiguousarray(p[some])
        for at in range(0, len(points), POINTS):
            part = slice(at, at + POINTS)
            miss = each @ points[part].T
            np.subtract(y[some, None], miss, out=miss)
            # a forecast that hits the truth but for rounding counts as below it
            below = (miss >= -1e-9).astype("f8")
            out[part, 2:] += above @ each - below.T @ each
            # the pinball loss is q * miss where the truth is above, else (q - 1) * miss
            out[part, 0] += (1 - above) @ miss
            out[part, 0] -= ones[:len(miss)] @ np.minimum(miss, 0.0, out=miss)
    out[:, 1] = rows
    return out


def _losses(blocks: DataFrame, by: list[str], points: DataFrame, n: int) -> DataFrame:
    """Loss, slope per model and row count of each point at each date of its history: sums over all dates up to it.

    ``points``: ``_w`` with the last date ``_last`` it is asked for, numbered by ``_i``. One pass over the blocks, summed within
    tasks, then a running sum over dates.
    """
    asked = points.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_i", "_w", F.unix_date("_last").alias("_last")))).alias("_z"))
    known = blocks.where(~F.col("_gap") & F.col("_at").isNotNull()).select(*by, F.unix_date("_at").alias("_t"), "_data")
    met = (known.join(asked, by) if by else known.crossJoin(asked)).select(
        *by, "_t", "_data", F.col("_z._i").alias("_i"), F.flatten("_z._w").alias("_w"), F.col("_z._last").alias("_last"))
    sums = ["_l", "_n", *[f"_g{i}" for i in range(n)]]
    schema = T.StructType([*[met.schema[k] for k in by], T.StructField("_t", T.IntegerType()), T.StructField("_i", T.IntegerType()),
                           *[T.StructField(c, T.DoubleType()) for c in sums]])

    def listed(held: dict) -> pa.RecordBatch:
        size = [len(i) for i, _ in held.values()]
        groups = [pa.array(np.repeat([k[j] for k in held], size), pa.int32() if j == len(by) else key_types[j]) for j in range(len(by) + 1)]
        cells = np.concatenate([s for _, s in held.values()])
        return pa.RecordBatch.from_arrays([*groups, pa.array(np.concatenate([i for i, _ in held.values()]), pa.int32()),
                                           *[pa.array(cells[:, j]) for j in range(len(sums))]], schema.fieldNames())

    key_types: list[pa.DataType] = []

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        for batch in batches:
            key_types[:] = [batch.column(k).type for k in by]
            for *key, t, data, i, w, last in zip(*[batch.column(k).to_pylist() for k in by], batch.column("_t").to_pylist(), batch.column("_data"),
                                                 batch.column("_i"), batch.column("_w"), batch.column("_last")):
                wanted = last.values.to_numpy() >= t
                if not wanted.any():
                    continue
                weights = w.values.to_numpy().reshape(-1, n)[wanted]
                found = _scores(np.frombuffer(data.as_buffer()).reshape(-1, n + 2), weights)
                place = (*key, t)
                if place in held:
                    held[place][1][:] += found
                else:
                    held[place] = (i.values.to_numpy()[wanted], found)
            if sum(len(i) for i, _ in held.values()) > HELD:
                yield listed(held)
                held = {}
        if held:
            yield listed(held)

    daily = met.mapInArrow(score, schema).groupBy(*by, "_i", F.date_from_unix_date("_t").alias("_at")).agg(*[F.sum(c).alias(c) for c in sums])
    history = Window.partitionBy(*by, "_i").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    total = {c: F.sum(c).over(history) for c in sums}
    # means over rows, rounded, so that the order of summing does not show in comparisons
    return daily.withColumns(total).select(
        *by, "_i", F.col("_at").alias(DATE), F.round(F.col("_l") / F.col("_n"), 9).alias("_loss"),
        F.array(*[F.round(F.col(f"_g{i}") / F.col("_n"), 9) for i in range(n)]).alias("_slope"))


def _transfer(n: int) -> Column:
    """The next point to try: up to ``_h`` of weight moved from the model whose slope is steepest up to the one steepest down.

    Null when no transfer can lower the loss.
    """
    held = F.zip_with("_w", "_slope", lambda w, g: F.when(w > 0, g))
    highest, lowest = F.array_max(held), F.array_min("_slope")
    # of slopes that are equal but for rounding the first model's
    source = F.array_position(F.transform(held, lambda g: g >= highest - NOISE), F.lit(True)) - 1
    target = F.array_position(F.transform("_slope", lambda g: g <= lowest + NOISE), F.lit(True)) - 1
    amount = F.least(F.col("_h"), F.get("_w", source.cast("int")))
    moved = F.transform("_w", lambda w, i: F.round(F.when(i == target, w + amount).when(i == source, w - amount).otherwise(w), 12))
    return F.when(highest > lowest + NOISE, moved)


def train_weights(df: DataFrame, models: Sequence[str], step: float = 0.05, max_passes: int = 24) -> DataFrame:
    """Weights per date that are best over all dates up to it.

    The loss is the mean pinball loss of the weighted forecast. It is convex in the weights and a sum over dates, so one
    aggregate and a running sum give loss and slopes of a point for every history. The search starts at the best of equal
    weights and single models. Then weight is moved from the model with the highest slope to the one with the lowest, by
    up to 1/2 at first; where that does not lower the loss, the move is halved, until one of at most ``step`` fails. All dates
    search at once: a pass evaluates the distinct points that they want next, so its cost does not depend on the number of
    weight vectors there are, and the plan does not grow with it. After ``max_passes`` passes dates keep the best point they
    have come to; ``gap`` tells how good it is.

    A region counts from the date on which every model has it, with all its history. Where a model lacks rows the others
    have, weights are equal. Returns long rows ``Date, model, weight, loss, gap`` (and horizon). ``gap`` bounds by how much the mean loss is
    above the least possible one: the slopes say no point of the simplex is better by more.
    """
    return _trained(_wide(df, models), models, step, max_passes)


def _trained(wide: DataFrame, models: Sequence[str], step: float, max_passes: int = 24) -> DataFrame:
    """:func:`train_weights` of wide rows."""
    by, n = _by(wide), len(models)
    blocks = _blocks(wide, by, n)
    over_time = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(DATE).rowsBetween(
        Window.unboundedPreceding, 0)
    dates = blocks.groupBy(*by, F.col("_at").alias(DATE)).agg(F.bool_or("_gap").alias("_gap")).withColumn("_gap", F.max("_gap").over(over_time))
    cutoffs = stage(dates)
    state = _search(blocks, cutoffs.where(~F.col("_gap")).drop("_gap"), by, n, step, max_passes)

    # dates without new rows keep the weights of the date before
    best = cutoffs.join(state, [*by, DATE], "left")
    listed = wide.select(*by, DATE).distinct().join(best.select(*by, DATE, "_gap", F.struct("_w", "_loss", "_slope").alias("_best")), [*by, DATE], "left")
    filled = listed.withColumns({
        "_best": F.last(F.when(F.col("_best._w").isNotNull(), F.col("_best")), ignorenulls=True).over(over_time),
        "_gap": F.coalesce(F.last("_gap", ignorenulls=True).over(over_time), F.lit(True))})
    names = F.array(*map(F.lit, models))
    chosen = F.when(F.col("_gap"), F.array(*[F.lit(1.0 / n)] * n)).otherwise(F.col("_best._w"))
    reach = F.aggregate(F.zip_with("_best._w", "_best._slope", lambda w, g: w * g), F.lit(0.0), lambda s, v: s + v) - F.array_min("_best._slope")
    return filled.withColumn("_m", F.explode(F.arrays_zip(names.alias("m"), chosen.alias("w")))).select(
        *by, DATE, F.col("_m.m").alias(MODEL), F.col("_m.w").alias("weight"),
        F.when(~F.col("_gap"), F.col("_best._loss")).alias("loss"), F.when(~F.col("_gap"), reach).alias("gap"))


def _search(blocks: DataFrame, cutoffs: DataFrame, by: list[str], n: int, step: float, max_passes: int) -> DataFrame:
    """``_w``, ``_loss`` and ``_slope`` per cutoff."""
    order = Window.partitionBy(*by).orderBy("_w") if by else Window.partitionBy(F.lit(0)).orderBy("_w")

    def numbered(wanted: DataFrame) -> DataFrame:
        points = wanted.groupBy(*by, "_w").agg(F.max(DATE).alias("_last"))
        return stage(points.withColumn("_i", F.row_number().over(order)))

    starts = [[1.0 / n] * n, *[[float(i == j) for j in range(n)] for i in range(n)]]
    first = F.explode(F.array(*[F.array(*map(F.lit, w)) for w in starts]))
    points = numbered(cutoffs.withColumn("_w", first))
    scored = _losses(blocks, by, points, n).join(points.select(*by, "_i", "_w"), [*by, "_i"])
    # of equal losses equal weights come first, then the earlier model
    rank = F.when(F.col("_w")[0] == 1.0 / n, 0).otherwise(F.array_position("_w", F.lit(1.0))) if n > 1 else F.lit(0)
    state = scored.groupBy(*by, DATE).agg(F.min_by(F.struct("_w", "_loss", "_slope"), F.struct(F.round("_loss", 7), rank.alias("r"))).alias("_s"))
    state = state.select(*by, DATE, "_s.*", F.lit(0.5).alias("_h"), F.lit(False).alias("_done"))
    for _ in range(max_passes):
        state = stage(state.withColumn("_next", F.when(~F.col("_done"), _transfer(n))))
        wanted = state.where(F.col("_next").isNotNull()).select(*by, DATE, F.col("_next").alias("_w"))
        if wanted.isEmpty():
            return state.select(*by, DATE, "_w", "_loss", "_slope")
        points = numbered(wanted)
        there = _losses(blocks, by, points, n).join(points.select(*by, "_i", "_w"), [*by, "_i"]).select(
            *by, DATE, F.col("_w").alias("_next"), F.col("_loss").alias("_l2"), F.col("_slope").alias("_s2"))
        better = F.coalesce(F.col("_l2") < F.col("_loss") - NOISE, F.lit(False))
        halved = ~better & ~F.col("_done")
        state = state.join(there, [*by, DATE, "_next"], "left").select(
            *by, DATE, F.when(better, F.col("_next")).otherwise(F.col("_w")).alias("_w"),
            F.when(better, F.col("_l2")).otherwise(F.col("_loss")).alias("_loss"),
            F.when(better, F.col("_s2")).otherwise(F.col("_slope")).alias("_slope"),
            F.when(halved, F.col("_h") / 2).otherwise(F.col("_h")).alias("_h"),
            (F.col("_done") | F.col("_next").isNull() | (halved & (F.col("_h") <= step))).alias("_done"))
    return state.select(*by, DATE, "_w", "_loss", "_slope")


def apply_weights(df: DataFrame, weights: DataFrame, models: Sequence[str], lag: int = 1,
                  name: str = "ensemble") -> DataFrame:
    """Weighted sum of the forecasts, weights taken ``lag`` dates earlier.

    Rows follow the first model. A model without a row or a weight adds
    nothing. Dates without earlier weights keep the first model's values and
    say so in ``ensemble_ready``.
    """
    return _mixed(_wide(df, models), weights, models, lag, name)


def _mixed(wide: DataFrame, weights: DataFrame, models: Sequence[str], lag: int = 1, name: str = "ensemble") -> DataFrame:
    """:func:`apply_weights` to wide rows."""
    by, n = _by(wide), len(models)
    window = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(DATE)
    dates = wide.select(*by, DATE).distinct().withColumn("_r", F.dense_rank().over(window))
    then = dates.select(*by, F.col(DATE).alias("_then"), (F.col("_r") + lag).alias("_r"))
    shift = dates.join(then, [*by, "_r"]).drop("_r")
    # one row per date: stored, so that its size is known and the forecasts are not shuffled for it
    each = weights.withColumnRenamed(DATE, "_then").groupBy(*by, "_then").agg(
        *[F.sum(F.when(F.col(MODEL) == m, F.col("weight"))).alias(f"_w{i}") for i, m in enumerate(models)])
    due = stage(shift.join(each, [*by, "_then"]).drop("_then").withColumn("_ready", F.lit(True)))
    rows = wide.where(F.col("_in").bitwiseAND(F.lit(1).cast("long")) == 1).join(due, [*by, DATE], "left")
    done = F.coalesce(F.col("_ready"), F.lit(False))
    mix = sum((F.coalesce(F.col(f"_w{i}") * _sum(i), F.lit(0.0)) for i in range(n)), F.lit(0.0))
    return rows.select(
        *by, GID_2, DATE, QUANTILE, F.when(done, mix).otherwise(_lead()).alias(PREDICTION),
        CASES, F.lit(name).alias(MODEL), done.alias("ensemble_ready"))


def combine_fixed(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted sum with one weight per model, scaled to add up to 1; all zero means equal."""
    total = sum(weights.values())
    share = {m: (w / total if total > 0 else 1.0 / len(weights)) for m, w in weights.items()}
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col(MODEL))
    keys = [*_by(df), GID_2, DATE]
    rows = df.where(F.col(MODEL).isin(*share)).select(*keys, QUANTILE, (weight * F.col(PREDICTION)).alias(PREDICTION), CASES)
    # levels are few: as columns, a forecast's key is shuffled once and not with each of its levels
    levels = [r[0] for r in rows.select(QUANTILE).distinct().limit(LEVELS + 1).collect()]
    if not 0 < len(levels) <= LEVELS:
        return rows.groupBy(*keys, QUANTILE).agg(F.sum(PREDICTION).alias(PREDICTION), F.max(CASES).alias(CASES))
    kind = df.schema[QUANTILE].dataType
    at = [F.lit(q).cast(kind) for q in levels]
    is_ = [F.col(QUANTILE).eqNullSafe(q) for q in at]
    wide = rows.groupBy(*keys).agg(
        F.bit_or(sum((F.when(x, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, x in enumerate(is_)), F.lit(0).cast("long"))).alias("_in"),
        *[F.sum(F.when(x, F.col(PREDICTION))).alias(f"_p{i}") for i, x in enumerate(is_)], *[F.max(F.when(x, F.col(CASES))).alias(f"_c{i}") for i, x in enumerate(is_)])
    cells = F.array(*[F.when(F.col("_in").bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.struct(
        q.alias("q"), F.col(f"_p{i}").alias("p"), F.col(f"_c{i}").alias("c"))) for i, q in enumerate(at)])
    each = wide.select(*keys, F.explode(cells).alias("_c")).where(F.col("_c").isNotNull())
    return each.select(*keys, F.col("_c.q").alias(QUANTILE), F.col("_c.p").alias(PREDICTION), F.col("_c.c").alias(CASES))


def create_ensemble(forecasts: dict[str, DataFrame], step: float = 0.05, lag: int = 1,
                    quantile_fix: bool = False) -> tuple[DataFrame, DataFrame]:
    """Ensemble and its weights from forecasts by model name; all horizons together.

    The forecasts are shuffled and staged once, as wide rows that the common
    part, the weights and the mixture all read; so are the weights.
    """
    models = list(forecasts)
    shared = _common(_wide(stack_models(forecasts), models), _by(next(iter(forecasts.values()))), len(models))
    weights = stage(_trained(shared, models, step))
    out = _mixed(shared, weights, models, lag)
    return (lift_tiny_violations(out) if quantile_fix else out), weights


def weights_wide(weights: DataFrame, models: Sequence[str]) -> DataFrame:
    """One column per model."""
    return weights.groupBy(*_by(weights), DATE).pivot(MODEL, list(models)).agg(F.max("weight"))


def smooth_weights(weights: DataFrame, window: int = 6) -> DataFrame:
    """Moving average of each model's weights, from the first date on."""
    w = Window.partitionBy(*_by(weights), MODEL).orderBy(DATE).rowsBetween(-(window - 1), 0)
    return weights.withColumn("weight", F.avg("weight").over(w))
