"""Covariate sources by name: ``origin.field`` requests go to registered functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epipanel.schema import DATE, GID_2

CovariateSource = Callable[[DataFrame, list[str]], DataFrame]


class SourceRegistry:
    """Maps an origin to a function ``(panel, fields) -> panel with more columns``."""

    def __init__(self) -> None:
        self._sources: dict[str, CovariateSource] = {}

    def register(self, origin: str, source: CovariateSource) -> None:
        self._sources[origin] = source

    def __contains__(self, origin: str) -> bool:
        return origin in self._sources

    def merge(self, panel: DataFrame, requests: Iterable[str]) -> DataFrame:
        """Run every origin once, with all the fields asked of it."""
        fields_of: dict[str, list[str]] = {}
        for request in requests:
            if request.count(".") != 1:
                raise ValueError(f"{request!r} is not of the form 'origin.field'")
            origin, field = request.split(".")
            fields_of.setdefault(origin, []).append(field)
        unknown = [o for o in fields_of if o not in self._sources]
        if unknown:
            raise ValueError(f"unknown covariate source(s) {unknown}; have {sorted(self._sources)}")
        for origin, fields in fields_of.items():
            panel = self._sources[origin](panel, fields)
        return panel

    def merge_new(self, panel: DataFrame, requests: Iterable[str]) -> DataFrame:
        """Like :meth:`merge` for one request at a time, joining new columns by region and date."""
        for request in requests:
            panel = merge_new_columns(panel, self.merge(panel, [request]))
        return panel


def new_columns(panel: DataFrame, other: DataFrame) -> list[str]:
    """Columns of ``other`` that ``panel`` lacks, in ``other``'s order."""
    return [c for c in other.columns if c not in panel.columns]


def merge_new_columns(panel: DataFrame, covariates: DataFrame) -> DataFrame:
    """Left-join only the columns the panel lacks, on (GID_2, Date)."""
    fresh = new_columns(panel, covariates)
    return panel.join(covariates.select(GID_2, F.col(DATE), *fresh), [GID_2, DATE], "left")
