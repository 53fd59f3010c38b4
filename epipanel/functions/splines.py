"""Natural cubic spline columns from given knots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def natural_basis(x: Column, knots: list[Column], df: int) -> list[Column]:
    """``df`` columns that span the natural cubic splines with ``df + 1`` knots.

    Truncated-power form: linear outside the outer knots, cubic between. The
    first column is ``x`` itself; together with a constant the columns span
    the usual natural basis.
    """
    last, before = knots[df], knots[df - 1]

    def cube(at: Column) -> Column:
        return F.pow(F.greatest(x - at, F.lit(0.0)), F.lit(3.0))

    def part(at: Column) -> Column:
        return (cube(at) - cube(last)) / F.nullif(last - at, F.lit(0.0))

    out = [x.cast("double")]
    for i in range(df - 1):
        out.append(F.when(x.isNotNull(), F.coalesce(part(knots[i]) - part(before), F.lit(0.0))))
    return out


def knot_levels(df: int) -> list[float]:
    """Quantile levels of the knots: the ends and ``df - 1`` points between."""
    return [i / df for i in range(df + 1)]


def fit_knots(data: DataFrame, columns: dict[str, int]) -> dict[str, list[float]]:
    """Knots of each column at its quantiles, for the wanted number of basis columns.

    Runs one job; the result is a few numbers per column, null where a column
    has no values.
    """
    from epipanel.operators.quantiles import column_quantiles

    levels = sorted({q for df in columns.values() for q in knot_levels(df)})
    found: dict[str, dict[float, float]] = {}
    for r in column_quantiles(data, list(columns), levels).collect():
        found.setdefault(r["column"], {})[r["quantile"]] = r["value"]
    return {c: [found.get(c, {}).get(q) for q in knot_levels(df)] for c, df in columns.items()}


def add_natural_basis(data: DataFrame, knots: dict[str, list[float]],
                      prefixes: dict[str, str] | None = None) -> DataFrame:
    """Add ``<prefix>_1 ... <prefix>_df`` for every column with knots."""
    new = {}
    for c, marks in knots.items():
        prefix = (prefixes or {}).get(c, c)
        at = [F.lit(m).cast("double") for m in marks]
        for i, col in enumerate(natural_basis(F.col(c), at, len(marks) - 1)):
            new[f"{prefix}_{i + 1}"] = col
    return data.withColumns(new)
