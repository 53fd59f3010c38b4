"""Exact quantiles of groups of any size.

Spark's ``percentile`` keeps a whole group in one task. Here the distinct
values are range-partitioned by group and value, whatever the groups' sizes:
a large group spreads over many parts, many small ones share one. Counts per
part tell which part holds the wanted ranks, and only those parts are read
again. The result is exact, and no part depends on how values are spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epipanel.schema import QUANTILE, QUANTILE_LEVELS, literal_array
from epipanel.sources.stage import stage

# distinct values in a block of pooled values; shapes the work only
BLOCK_ROWS = 1_000


def _ranged(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``counts`` by ranges of (keys, v), written once, with the range's number as ``bucket``."""
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(counts.repartitionByRange(parts, *keys, "v").withColumn("bucket", F.spark_partition_id().cast("long")))


def _wanted_ranks(levels: Sequence[float], n: Column) -> Column:
    """For every level the one or two 0-based ranks it lies between, with weights."""
    def ranks(q: Column) -> Column:
        place = q * (n - 1)
        low = F.floor(place)
        part = place - low
        return F.array(
            F.struct(q.alias("q"), low.alias("rank"), (1 - part).alias("weight")),
            F.struct(q.alias("q"), F.ceil(place).alias("rank"), part.alias("weight")),
        )

    both = F.flatten(F.transform(literal_array(levels), ranks))
    return F.filter(both, lambda r: r["weight"] > 0)


def _targets(hist: DataFrame, keys: Sequence[str], levels: Sequence[float]) -> DataFrame:
    """Ranks to look for in each bucket, counted from the bucket's start.

    ``hist`` has one row per (keys, bucket) with its row count ``m``.
    """
    whole = Window.partitionBy(*keys)
    below = F.coalesce(
        F.sum("m").over(whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    placed = hist.withColumns({"below": below, "n": F.sum("m").over(whole)})
    inside = F.filter(
        _wanted_ranks(levels, F.col("n")),
        lambda r: (r["rank"] >= F.col("below")) & (r["rank"] < F.col("below") + F.col("m")),
    )
    found = F.transform(
        inside, lambda r: F.struct(r["q"].alias("q"), (r["rank"] - F.col("below")).alias("at"),
                                   r["weight"].alias("weight"))
    )
    return placed.withColumn("want", found).where(F.size("want") > 0).select(*keys, "bucket", "n", "want")


def _pick(values: DataFrame, keys: Sequence[str], n_name: str = "n") -> DataFrame:
    """Read the wanted ranks off the values of their buckets.

    ``values`` has (keys, bucket, v, c, want, n): distinct value, its count, the ranks.
    """
    upto = F.sum("c").over(Window.partitionBy(*keys, "bucket").orderBy("v").rowsBetween(
        Window.unboundedPreceding, 0))
    hits = values.withColumn("upto", upto).withColumn(
        "hit", F.explode(F.filter(
            F.col("want"),
            lambda r: (r["at"] < F.col("upto")) & (r["at"] >= F.col("upto") - F.col("c"))))
    )
    return hits.groupBy(*keys, F.col("hit.q").alias(QUANTILE)).agg(
        F.sum(F.col("v") * F.col("hit.weight")).alias("value"), F.max("n").alias(n_name)
    )


def _long(df: DataFrame, keys: Sequence[str], levels: Sequence[float], extra: Sequence[str]) -> DataFrame:
    pairs = F.arrays_zip(literal_array(levels).alias("q"), F.col("_values").alias("v"))
    return df.withColumn("_pair", F.explode(pairs)).select(
        *keys, F.col("_pair.q").alias(QUANTILE), F.col("_pair.v").alias("value"), *extra
    )


def quantiles_of_sorted(values: Column, levels: Sequence[float], mirrored: bool = False) -> Column:
    """Interpolated quantiles of a sorted array, as an array; null for an empty one.

    With ``mirrored`` the array holds absolute values that stand for
    themselves and their negatives. For window frames this is much cheaper
    than ``percentile``, which sorts boxed values for every row.
    """
    n = F.size(values)
    count = n * 2 if mirrored else n

    def at(i: Column) -> Column:
        if not mirrored:
            return F.get(values, i)
        return F.when(i < n, -F.get(values, n - 1 - i)).otherwise(F.get(values, i - n))

    def one(level: Column) -> Column:
        place = level * (count - 1)
        low = F.floor(place).cast("int")
        high = F.ceil(place).cast("int")
        return at(low) + (at(high) - at(low)) * (place - low)

    return F.when(n > 0, F.transform(literal_array(levels), one))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    levels: Sequence[float] = QUANTILE_LEVELS, carry: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolation quantiles per group, long: keys, ``quantile``, ``value``.

    Equal values meet before the shuffle. Null and NaN values do not count; a
    group of nothing else keeps its rows, with null quantiles. ``carry``
    columns come along with their largest value per group.
    """
    keys, carry = list(keys), list(carry)
    v = F.col(value).cast("double")
    counts = df.groupBy(*keys, F.when(~F.isnan(v), v).alias("v")).agg(
        F.count("*").alias("c"), *[F.max(c).alias(c) for c in carry])
    ranged = _ranged(counts, keys)
    groups = ranged.groupBy(*keys).agg(*[F.max(c).alias(c) for c in carry], F.count("v").alias("_some"))
    known = ranged.where(F.col("v").isNotNull())
    hist = known.groupBy(*keys, "bucket").agg(F.sum("c").alias("m"))
    wanted = _targets(hist, keys, levels)
    same = [F.col(f"g.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys]
    near = known.select(*keys, "bucket", "v", "c").alias("g").join(
        wanted.alias("w"), [*same, F.col("g.bucket") == F.col("w.bucket")]).select(
        *[F.col(f"g.{k}").alias(k) for k in keys], "g.bucket", "v", "c", "want", "n")
    found = _pick(near, keys).drop("n")
    if carry:
        found = found.alias("g").join(groups.alias("w"), same).select(
            *[F.col(f"g.{k}").alias(k) for k in keys], QUANTILE, "value", *carry)
    empty = groups.where("_some = 0").select(
        *keys, F.explode(literal_array(levels)).alias(QUANTILE), F.lit(None).cast("double").alias("value"), *carry)
    return found.select(*keys, QUANTILE, "value", *carry).unionByName(empty)


def column_quantiles(df: DataFrame, columns: Sequence[str], levels: Sequence[float]) -> DataFrame:
    """Quantiles of whole columns: rows of ``column``, ``quantile``, ``value``."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "_value")
    return exact_quantiles(long, ["column"], "_value", levels)


def prefix_quantiles(df: DataFrame, keys: Sequence[str], at: str, value: str, cutoffs: DataFrame,
                     levels: Sequence[float] = QUANTILE_LEVELS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Quantiles of all values before each cutoff.

    ``at`` is an integer time; ``cutoffs`` has the keys and the wanted ``at``
    values. Returns keys, ``at``, ``quantile``, ``value`` and the number ``n``
    of values before the cutoff. Times are first numbered by cutoffs. Values
    lie in blocks of at most ``block_rows``; running counts by block name the
    blocks that hold a cutoff's ranks, and a cutoff meets the values of those
    only.
    """
    keys = list(keys)
    asked = cutoffs.select(*keys, F.col(at).cast("int").alias("_at")).distinct()
    rows = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(at).cast("int").alias("_at"), F.col(value).cast("double").alias("v"))
    # the calendar: how many cutoffs lie at or before each time
    calendar = rows.select("_at", F.lit(0).alias("_is")).unionByName(asked.select("_at", F.lit(1).alias("_is"))).groupBy(
        "_at").agg(F.max("_is").alias("_is"))
    numbered = calendar.select("_at", F.sum("_is").over(Window.orderBy("_at")).cast("int").alias("_t"))
    counts = rows.join(numbered, "_at").groupBy(*keys, "v", "_t").agg(F.count("*").alias("c"))
    placed = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy("v", "_t")) - 1
    counts = stage(_ranged(counts, keys).withColumn("_block", F.floor(placed / block_rows)).withColumn(
        "bucket", F.shiftleft("bucket", 32) + F.col("_block")).drop("_block"))

    asked = asked.join(numbered, "_at").select(*keys, "_at", F.col("_t").alias("_cut"))
    last = asked.agg(F.max("_cut")).scalar()
    series = Window.partitionBy(*keys, "bucket").orderBy("_t")
    steps = (
        counts.groupBy(*keys, "bucket", "_t").agg(F.sum("c").alias("m"))
        .withColumns({
            "m": F.sum("m").over(series.rowsBetween(Window.unboundedPreceding, 0)),
            "_until": F.coalesce(F.lead("_t").over(series), last),
        })
        .where(F.col("_until") > F.col("_t"))
    )
    # a time numbered t lies before cutoff t + 1 and all later ones
    hist = (
        steps.withColumn("_cut", F.explode(F.sequence(F.col("_t") + 1, F.col("_until"))))
        .join(asked, [*keys, "_cut"])
        .select(*keys, "_at", "_cut", "bucket", "m")
    )
    wanted = _targets(hist, [*keys, "_at", "_cut"], levels)
    near = (
        counts.join(wanted, [*keys, "bucket"]).where(F.col("_t") < F.col("_cut"))
        .groupBy(*keys, "_at", "_cut", "bucket", "v")
        .agg(F.sum("c").alias("c"), F.first("want").alias("want"), F.first("n").alias("n"))
    )
    return _pick(near, [*keys, "_at", "_cut"]).drop("_cut").withColumnRenamed("_at", at)


def recent_quantiles(df: DataFrame, keys: Sequence[str], at: str, order: str, value: str,
                     cutoffs: DataFrame, last: int, levels: Sequence[float] = QUANTILE_LEVELS) -> DataFrame:
    """Quantiles of the last ``last`` values, by (``at``, ``order``), before each cutoff.

    At most ``last`` values of a time can matter; the rank filter drops the
    others before the shuffle. Values are numbered in order and cutoffs look
    them up by blocks of ``last`` numbers, so a cutoff meets two blocks only.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(at).cast("int").alias("_t"), F.col(order).alias("_o"), F.col(value).cast("double").alias("v"))
    per_time = rows.groupBy(*keys, "_t").agg(F.count("*").alias("_m"))
    through = F.sum("_m").over(Window.partitionBy(*keys).orderBy("_t").rowsBetween(Window.unboundedPreceding, 0))
    totals = per_time.withColumn("_through", through)
    newest = Window.partitionBy(*keys, "_t").orderBy(F.desc("_o"))
    kept = (
        rows.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= last)
        .join(totals.select(*keys, "_t", "_through"), [*keys, "_t"])
        .withColumn("_no", F.col("_through") - F.col("_r") + 1)
        .select(*keys, "v", "_no", F.floor(F.col("_no") / last).alias("_block"))
    )
    # a cutoff sees the values through the latest earlier time
    asked = cutoffs.select(*keys, F.col(at).cast("int").alias("_t")).distinct().withColumn("_ask", F.lit(True))
    line = totals.select(*keys, "_t", "_through").unionByName(asked, allowMissingColumns=True)
    seen = F.max("_through").over(
        Window.partitionBy(*keys).orderBy("_t").rangeBetween(Window.unboundedPreceding, -1))
    ends = line.withColumn("_end", seen).where("_ask and _end is not null").select(*keys, "_t", "_end")
    blocks = ends.withColumn("_block", F.explode(F.array_distinct(F.array(
        F.floor(F.greatest(F.col("_end") - last + 1, F.lit(1)) / last), F.floor(F.col("_end") / last)))))
    matched = kept.join(blocks, [*keys, "_block"]).where(
        (F.col("_no") <= F.col("_end")) & (F.col("_no") > F.col("_end") - last))
    found = matched.groupBy(*keys, "_t").agg(
        F.percentile("v", literal_array(levels)).alias("_values"), F.count("*").alias("n"))
    return _long(found, [*keys, "_t"], levels, ["n"]).withColumnRenamed("_t", at)
