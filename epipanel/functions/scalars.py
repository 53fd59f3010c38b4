"""Row-level expressions: names, ids, scales, losses."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_table() -> tuple[str, str]:
    """Accented letters and their plain letters, worked out from the Unicode data."""
    accented, plain = [], []
    for code in range(0x00C0, 0x2000):
        letter = chr(code)
        base = "".join(
            c for c in unicodedata.normalize("NFD", letter) if unicodedata.category(c) != "Mn"
        )
        if base != letter and len(base) == 1:
            accented.append(letter)
            plain.append(base)
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _accent_table()


def remove_accents(text: Column) -> Column:
    """Drop accents: whole letters through a table, loose combining marks by class."""
    return F.regexp_replace(F.translate(text, _ACCENTED, _PLAIN), r"\p{Mn}", "")


def homogenise(text: Column) -> Column:
    """Name key: no accents, no blanks, lower case."""
    return F.lower(F.replace(remove_accents(text), F.lit(" "), F.lit("")))


def sort_tokens(text: Column) -> Column:
    """Whitespace tokens in alphabetical order, joined by one blank."""
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")
    return F.array_join(F.array_sort(tokens), " ")


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, one table row per letter of ``a``."""
    letters_a = F.filter(F.split(a, ""), lambda c: c != "")
    letters_b = F.filter(F.split(b, ""), lambda c: c != "")
    blank_row = F.transform(letters_b, lambda _: F.lit(0))

    def next_row(row: Column, letter: Column) -> Column:
        def step(state: Column, pair: Column) -> Column:
            # state: finished cells, the cell on the left, the cell up and left
            cell = F.when(pair["c"] == letter, state["diag"] + 1).otherwise(
                F.greatest(state["left"], pair["up"])
            )
            return F.struct(
                F.concat(state["cells"], F.array(cell)).alias("cells"),
                cell.alias("left"),
                pair["up"].alias("diag"),
            )

        start = F.struct(
            F.array().cast("array<int>").alias("cells"),
            F.lit(0).alias("left"),
            F.lit(0).alias("diag"),
        )
        pairs = F.zip_with(letters_b, row, lambda c, up: F.struct(c.alias("c"), up.alias("up")))
        return F.aggregate(pairs, start, step, lambda s: s["cells"])

    last = F.aggregate(letters_a, blank_row, next_row)
    return F.coalesce(F.element_at(F.when(F.size(last) > 0, last), -1), F.lit(0))


def indel_ratio(a: Column, b: Column) -> Column:
    """Similarity 0-100 from insertions and deletions: 100 * 2 * LCS / (|a| + |b|)."""
    total = F.char_length(a) + F.char_length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(
        F.lit(200.0) * lcs_length(a, b) / total
    )


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Indel similarity of the two names with their words in order."""
    return indel_ratio(sort_tokens(a), sort_tokens(b))


def country_of(gid: Column) -> Column:
    """Country part of a region id: the text before the first dot."""
    return F.split_part(gid, F.lit("."), F.lit(1))


def admin1_of(gid_2: Column) -> Column:
    """State id of a municipality id: ``AAA.25.565_2`` -> ``AAA.25_1``."""
    return F.concat(F.regexp_extract(gid_2, r"^([^.]+\.\d+)", 1), F.lit("_1"))


def expm1_clipped(x: Column) -> Column:
    """Back from the log1p scale, never below zero."""
    return F.when(x.isNotNull(), F.greatest(F.expm1(x), F.lit(0.0)))


def clip(x: Column, lower: float | None = None, upper: float | None = None) -> Column:
    """Limit to [lower, upper]; null stays null."""
    out = x
    if lower is not None:
        out = F.when(x.isNotNull(), F.greatest(out, F.lit(lower)))
    if upper is not None:
        out = F.when(x.isNotNull(), F.least(out, F.lit(upper)))
    return out


def fill_null(x: Column, value: float = 0) -> Column:
    return F.coalesce(x, F.lit(value))


def incidence_rate(cases: Column, population: Column, per: float = 1e5) -> Column:
    """Cases per ``per`` inhabitants; no population gives null."""
    return F.lit(float(per)) * cases / F.nullif(population, F.lit(0))


def population_offset(population: Column, per: float = 1e5) -> Column:
    return population / F.lit(float(per))


def season_flag(date: Column, months: tuple[int, ...] = (12, 1, 2, 3, 4)) -> Column:
    """1 in the wet-season months, else 0."""
    return F.month(date).isin(*months).cast("int")


def to_number(x: Column) -> Column:
    """Text to double; what is not a number becomes null, NaN too."""
    return F.nullif(x.try_cast("double"), F.lit(float("nan")))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def quantile_of_label(label: Column) -> Column:
    """Level from a column label such as ``Cases.q.050``: last part / 1000."""
    return F.element_at(F.split(label, r"\."), -1).cast("double") / 1000


def pinball(y: Column, pred: Column, level: Column | float) -> Column:
    """Quantile loss of ``pred`` at ``level`` for the outcome ``y``."""
    q = F.lit(level) if isinstance(level, (int, float)) else level
    miss = y - pred
    return F.when(miss >= 0, q * miss).otherwise((q - 1) * miss)


def interval_score(y: Column, low: Column, high: Column, alpha: Column) -> Column:
    """Score of the central (1 - alpha) interval: width plus scaled misses."""
    outside = F.greatest(low - y, F.lit(0.0)) + F.greatest(y - high, F.lit(0.0))
    return (high - low) + F.lit(2.0) / alpha * outside


def score_bucket(score: Column, n: int) -> Column:
    """Index of a 0-1 score among ``n`` colours; null stays null."""
    return F.floor(score * (n - 1)).cast("int")
