"""Calendar periods, kept as the last date of the period.

Frequencies: ``M`` month, ``W``/``W-SUN`` week Monday-Sunday, ``W-SAT`` week
Sunday-Saturday, ``D`` day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epipanel.schema import DATE, period_freq, with_period

# Week frequencies and the weekday that closes the week.
WEEK_END = {"W": "SUN", "W-SUN": "SUN", "W-SAT": "SAT"}

# Three-month season codes, by the month in their centre.
SEASON_CENTRE = {
    "DJF": 1, "JFM": 2, "FMA": 3, "MAM": 4, "AMJ": 5, "MJJ": 6,
    "JJA": 7, "JAS": 8, "ASO": 9, "SON": 10, "OND": 11, "NDJ": 12,
}

# The first Sunday (Saturday) on or after the epoch, the origin of week counting.
_EPOCH_WEEK_END = {"SUN": "1970-01-04", "SAT": "1970-01-03"}


def _check(freq: str) -> None:
    if freq not in ("M", "D") and freq not in WEEK_END:
        raise ValueError(f"unknown period frequency {freq!r}")


def period_end(date: Column, freq: str = "M") -> Column:
    """Last date of the period that holds ``date``."""
    _check(freq)
    day = F.to_date(date)
    if freq == "M":
        return F.last_day(day)
    if freq == "D":
        return day
    return F.next_day(F.date_sub(day, 1), WEEK_END[freq])


def period_start(date: Column, freq: str = "M") -> Column:
    """First date of the period that holds ``date``."""
    _check(freq)
    if freq == "M":
        return F.trunc(F.to_date(date), "month")
    if freq == "D":
        return F.to_date(date)
    return F.date_sub(period_end(date, freq), 6)


def period_index(date: Column, freq: str = "M") -> Column:
    """Consecutive integer number of the period, for range frames and arithmetic."""
    _check(freq)
    if freq == "M":
        return (F.year(date) * 12 + F.month(date) - 1).cast("int")
    if freq == "D":
        return F.datediff(F.to_date(date), F.lit("1970-01-01").cast("date"))
    origin = F.lit(_EPOCH_WEEK_END[WEEK_END[freq]]).cast("date")
    return (F.datediff(period_end(date, freq), origin) / 7).cast("int")


def add_periods(date: Column, n: int | Column, freq: str = "M") -> Column:
    """Period end ``n`` periods after ``date`` (negative ``n`` goes back)."""
    _check(freq)
    n = F.lit(n) if isinstance(n, int) else n
    if freq == "M":
        return F.last_day(F.add_months(F.trunc(F.to_date(date), "month"), n))
    if freq == "D":
        return F.date_add(F.to_date(date), n)
    return F.date_add(period_end(date, freq), n * 7)


def period_range(first: Column, last: Column, freq: str = "M") -> Column:
    """Array of the period ends from ``first`` to ``last``, both inside.

    Months step from their first day: stepping from a 31st would drift.
    """
    _check(freq)
    if freq == "M":
        starts = F.sequence(
            F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month")
        )
        return F.transform(starts, F.last_day)
    step = "interval 1 day" if freq == "D" else "interval 7 day"
    return F.sequence(period_end(first, freq), period_end(last, freq), F.expr(step))


def season_month_end(season: Column, year: Column) -> Column:
    """Month end in the centre of a three-month season code (``DJF`` -> January)."""
    months = F.create_map(*[F.lit(x) for kv in SEASON_CENTRE.items() for x in kv])
    return F.last_day(F.make_date(year.cast("int"), F.element_at(months, season), F.lit(1)))


def month_cycle(date: Column) -> tuple[Column, Column]:
    """Sine and cosine of the month on the yearly circle."""
    angle = F.lit(2.0) * F.pi() * F.month(date) / F.lit(12)
    return F.sin(angle), F.cos(angle)


def to_period(df: DataFrame, freq: str, column: str = DATE) -> DataFrame:
    """Replace ``column`` by its period end and mark the frequency."""
    return with_period(df.withColumn(column, period_end(F.col(column), freq)), freq, column)


def align_dates(df: DataFrame, like: DataFrame, column: str = DATE, like_column: str | None = None) -> DataFrame:
    """Give ``df``'s dates the type and frequency of ``like``'s.

    A marked target turns timestamps, strings, dates and periods of another
    frequency into its own periods; an unmarked target gives plain dates.
    """
    freq = period_freq(like, like_column or column)
    if freq is None:
        return df.withColumn(column, F.to_date(column))
    return to_period(df, freq, column)


def align_scalar(value: str, like: DataFrame, column: str = DATE) -> Column:
    """One date, given as text, as a date or period like those of ``like``."""
    day = F.lit(str(value)).cast("date")
    freq = period_freq(like, column)
    return period_end(day, freq) if freq else day
