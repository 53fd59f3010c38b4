"""Joining covariates onto a panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epipanel.functions.periods import align_dates
from epipanel.functions.scalars import incidence_rate
from epipanel.schema import CASES, DATE, GID_2, PREDICTION, require_columns
from epipanel.sources.registry import SourceRegistry, merge_new_columns

# Metrics meant by "*", and the last year of constrained population counts.
CLIMATE_METRICS = ("tmin", "tmax", "prec")
POPULATION_METRICS = ("pop_count", "pop_estimate_constrained", "pop_estimate_unconstrained")
LAST_CONSTRAINED_YEAR = 2020


def join_climate_index(panel: DataFrame, index: DataFrame) -> DataFrame:
    """A monthly index, the same for all regions."""
    return panel.join(align_dates(index, panel), DATE, "left")


def wide_stats(stats: DataFrame, metrics: Sequence[str], measures: Sequence[str] = ("mean",)) -> DataFrame:
    """Statistics rows to columns ``<metric>_<measure>``; ``_mean`` is left out of the name."""
    columns = [
        F.max(F.when(F.col("metric") == m, F.col(s))).alias(m if s == "mean" else f"{m}_{s}")
        for m in metrics for s in measures
    ]
    return stats.where(F.col("metric").isin(*metrics)).groupBy(GID_2, DATE).agg(*columns)


def join_climate(panel: DataFrame, stats: DataFrame, metrics: Sequence[str] | None = None,
                 measures: Sequence[str] = ("mean",)) -> DataFrame:
    """Climate statistics by region and date, one column per metric (``*`` = all)."""
    if not metrics or list(metrics) == ["*"]:
        metrics = CLIMATE_METRICS
    known = align_dates(stats.where(F.col("mean").isNotNull()), panel)
    return panel.join(wide_stats(known, metrics, measures), [GID_2, DATE], "left")


def best_source(sources: dict[str, DataFrame], keys: Sequence[str] = (GID_2, DATE, "metric")) -> DataFrame:
    """Rows of several sources, each key from the first source that has it.

    The sources stand in order of preference; ``source`` tells which one it was.
    """
    stacked = None
    for rank, (name, df) in enumerate(sources.items()):
        tagged = df.withColumns({"source": F.lit(name), "_rank": F.lit(rank)})
        stacked = tagged if stacked is None else stacked.unionByName(tagged)
    values = [c for c in stacked.columns if c not in (*keys, "_rank")]
    best = stacked.groupBy(*keys).agg(F.min_by(F.struct(*values), "_rank").alias("_b"))
    return best.select(*keys, *[F.col("_b")[c].alias(c) for c in values])


def observed_until(df: DataFrame, last_year: int) -> DataFrame:
    """The part of an observed source it can serve: up to a year."""
    return df.where(F.col(DATE) <= F.make_date(F.lit(last_year), F.lit(12), F.lit(31)))


def join_population(panel: DataFrame, yearly: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """Yearly population sums (``GID_2, year, metric, sum``) on every period of the year.

    ``pop_count`` takes the unconstrained estimate after the last constrained
    year; a region without a sum counts 0 inhabitants.
    """
    metrics = list(POPULATION_METRICS) if metrics and list(metrics) == ["*"] else list(metrics or ["pop_count"])
    unknown = [m for m in metrics if m not in POPULATION_METRICS]
    if unknown:
        raise ValueError(f"unsupported population metric(s) {unknown}")
    require_columns(yearly, [GID_2, "year", "metric", "sum"])
    served = yearly.where(
        (F.col("metric") != "pop_count") | (F.col("year") <= LAST_CONSTRAINED_YEAR))
    late = yearly.where(
        (F.col("metric") == "pop_estimate_unconstrained") & (F.col("year") > LAST_CONSTRAINED_YEAR)
    ).withColumn("metric", F.lit("pop_count"))
    by_year = served.unionByName(late).where(F.col("metric").isin(*metrics)).groupBy(GID_2, "year").agg(*[
        F.max(F.when(F.col("metric") == m, F.coalesce(F.col("sum"), F.lit(0.0)))).alias(m) for m in metrics])
    return panel.withColumn("year", F.year(DATE)).join(by_year, [GID_2, "year"], "left").drop("year")


def join_drought(panel: DataFrame, stats: DataFrame) -> DataFrame:
    """Drought index means by region and date as ``SPI6``; of several, the largest."""
    known = stats.where(F.col("mean").isNotNull()).select(GID_2, DATE, F.col("mean").alias("SPI6"))
    return panel.join(align_dates(known, panel).groupBy(GID_2, DATE).agg(F.max("SPI6").alias("SPI6")), [GID_2, DATE], "left")


def add_incidence(df: DataFrame, target: str = "DIR", cases: str = CASES, population: str = "pop_count",
                  per: float = 1e5) -> DataFrame:
    """Cases per ``per`` inhabitants."""
    return df.withColumn(target, incidence_rate(F.col(cases), F.col(population), per))


def to_incidence(forecast: DataFrame, population: DataFrame, per: float = 1e5) -> DataFrame:
    """Truth and prediction as incidence, by the population of region and date."""
    known = population.select(DATE, GID_2, F.col("pop_count").alias("_pop"))
    out = forecast.drop("pop_count").join(known, [DATE, GID_2], "left")
    for c in (CASES, PREDICTION):
        out = out.withColumn(c, incidence_rate(F.col(c), F.col("_pop"), per))
    return out.drop("_pop")


def attach_cases(forecast: DataFrame, panel: DataFrame) -> DataFrame:
    """Observed cases onto forecasts, dates brought to the panel's periods."""
    observed = panel.select(GID_2, DATE, CASES)
    return align_dates(forecast.drop(CASES), panel).join(observed, [GID_2, DATE], "left")


def attach_median(panel: DataFrame, forecast: DataFrame, horizon: int | None = None) -> DataFrame:
    """Median forecast of one horizon (default: the shortest) onto the panel."""
    from epipanel.operators.access import pick

    rows = forecast
    if "horizon" in rows.columns:
        first = rows.agg(F.min("horizon")).scalar() if horizon is None else F.lit(horizon)
        rows = rows.where(F.col("horizon") == first)
    if "quantile" in rows.columns:
        rows = pick(rows, quantile=0.5)
    elif "sample" in rows.columns:
        from epipanel.operators.samples import median_of_samples

        rows = median_of_samples(rows)
    return panel.join(rows.select(GID_2, DATE, PREDICTION), [GID_2, DATE], "left")


def keep_regions_with(df: DataFrame, features: DataFrame) -> DataFrame:
    """Rows of regions that have features."""
    return df.join(features.select(GID_2), GID_2, "left_semi")


def regions_without(df: DataFrame, features: DataFrame) -> DataFrame:
    """Regions that lack features."""
    return df.select(GID_2).distinct().join(features.select(GID_2), GID_2, "left_anti")


def attach_embeddings(df: DataFrame, embeddings: DataFrame, check: bool = True) -> DataFrame:
    """A region's embedding onto each of its rows; a region without one is an error.

    The embeddings are hashed by region: Spark measures a forecast before its
    horizons and levels multiply it, and would send it whole to the driver as
    the smaller side.
    """
    if check:
        lost = regions_without(df, embeddings).limit(5).collect()
        if lost:
            raise ValueError(f"no embedding for regions such as {[r[0] for r in lost]}")
    return df.join(embeddings.hint("shuffle_hash"), GID_2)


def standard_sources(climate: DataFrame, drought: DataFrame, index: DataFrame, population: DataFrame) -> SourceRegistry:
    """Registry with the four usual origins over given tables."""
    registry = SourceRegistry()
    registry.register("worldclim", lambda panel, fields: join_climate(panel, climate, fields))
    registry.register("edo", lambda panel, fields: join_drought(panel, drought))
    registry.register("noaa", lambda panel, fields: join_climate_index(panel, index))
    registry.register("worldpop", lambda panel, fields: join_population(panel, population, fields))
    return registry


def covariate_panel(panel: DataFrame, registry: SourceRegistry,
                    requests: Sequence[str] = ("worldclim.*", "edo.spi6", "noaa.oni", "worldpop.pop_count")) -> DataFrame:
    """Panel with all covariates and the incidence rate."""
    return add_incidence(registry.merge(panel, requests))

